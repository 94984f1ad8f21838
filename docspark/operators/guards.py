"""What is decided before and around retrieval: expansion, scope, canned answers, the method."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import strip

_EDGE = "[\\p{L}\\p{N}_]"


def _boundary(key: str) -> str:
    """``key`` between word boundaries, in Unicode: a boundary is a change between word and other characters."""
    first, last = (bool(re.match(r"\w", c)) for c in (key[0], key[-1]))
    return (f"(?<!{_EDGE})" if first else f"(?<={_EDGE})") + f"\\Q{key}\\E" + (f"(?!{_EDGE})" if last else f"(?={_EDGE})")


def expand(question: Column, settings: Settings = Settings()) -> Column:
    """The question with the expansions of all rules that fire, in the rules' order: keys of up to 20 characters between
    word boundaries, longer ones anywhere, without case. Rules are a fixed list, so this is one expression."""
    low = F.lower(question)
    fired = [
        F.when(low.rlike(_boundary(key.lower())) if len(key) <= 20 else F.contains(low, F.lit(key.lower())), text) for key, text in settings.rules
    ]
    return F.concat_ws(" ", question, *fired)


def out_of_scope(question: Column, settings: Settings = Settings()) -> Column:
    return F.lower(question).rlike("(?U)" + "|".join(settings.out_of_scope))


def canned(question: Column, keyword: str, markers: tuple[str, ...] = ("what is", "define", "ما هو", "ما هي")) -> Column:
    """A question for the definition of ``keyword``: the word alone, or with one of the markers."""
    low = F.lower(F.trim(question))
    return F.contains(low, F.lit(keyword)) & ((low == keyword) | low.rlike("|".join(f"\\Q{m}\\E" for m in markers)))


def early_method(question: Column, keyword: str, settings: Settings = Settings()) -> Column:
    """The methods that need no search; null for the other questions."""
    return (
        F.when(question.isNull() | (strip(question) == ""), "none")
        .when(canned(question, keyword), "generative")
        .when(out_of_scope(question, settings), "out_of_scope")
    )


def method(question: Column, cached: Column, candidates: Column, top_similarity: Column, keyword: str = "reporting portal", settings: Settings = Settings()) -> Column:
    """The first that holds: none, generative for canned definitions, out of scope, cached, not found (no candidate, or too
    far), generative."""
    return (
        early_method(question, keyword, settings)
        .when(cached, "cached")
        .when(F.coalesce(candidates, F.lit(0)) == 0, "not_found")
        .when(top_similarity < settings.low_confidence, "not_found")
        .otherwise("generative")
    )


_WORD = "([\\p{L}\\p{N}_]+)"
_GRAM = 8


def _inside(key: Column) -> Column:
    """The first word of a key that lies between two other characters of it; null if there is none."""
    inner = F.regexp_extract(key, "[^\\p{L}\\p{N}_]([\\p{L}\\p{N}_]+)[^\\p{L}\\p{N}_]", 1)
    return F.when(inner != "", inner)


def expand_by_table(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """questions: (id, question); rules: (ord, key, expansion), of which there may be many. Each question with the
    expansions of the rules that fire, in their order: keys of up to 20 characters between word boundaries, longer ones
    anywhere, without case.

    Only joins on equality, each followed by a check of the whole key: a short key has its first word as a word of the
    question; a short key without a word is a whole run of other characters; a longer key has a word inside as a word, and
    one without such a word is joined on its first eight characters. Empty and null keys never fire; a null question stays
    as it is; a rule that stands twice fires twice."""
    has = _EDGE
    low = F.lower("key")
    short = F.length("key") <= 20
    r = rules.where("key <> ''").withColumn("k", low).withColumn("short", short)
    r = r.withColumn("w", F.when(F.col("short"), F.try_element_at(F.regexp_extract_all("k", F.lit(_WORD), 1), F.lit(1))).otherwise(_inside(F.col("k"))))
    asked = questions.where("question is not null").select("id", F.lower("question").alias("q"))
    parts = lambda pattern: asked.select("id", "q", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(pattern), 1))).alias("w"))
    hits = parts(_WORD).join(r.where("w is not null"), "w")
    loose = r.where("w is null")
    kinds = {x.short for x in loose.select("short").distinct().collect()}  # one row or two
    if True in kinds:
        hits = hits.unionByName(parts("([^\\p{L}\\p{N}_]+)").join(loose.where("short").withColumn("w", F.col("k")), "w"))
    if False in kinds:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("q") - _GRAM + 1)), lambda i: F.substring(F.col("q"), i, F.lit(_GRAM))))
        hits = hits.unionByName(asked.select("id", "q", F.explode(grams).alias("w")).join(loose.where("not short").withColumn("w", F.substring("k", 1, _GRAM)), "w"))
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("k"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(F.col("k").rlike(f"^{has}"), f"(?<!{has})").otherwise(f"(?<={has})")
    behind = F.when(F.col("k").rlike(f"{has}$"), f"(?!{has})").otherwise(f"(?={has})")
    fires = F.when(F.col("short"), F.rlike("q", F.concat(before, quoted, behind))).otherwise(F.contains("q", "k"))
    text = hits.where(fires).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "expansion"))), lambda x: x["expansion"]), " ").alias("more"))
    return questions.join(text, "id", "left").select("id", F.when(F.col("question").isNotNull(), F.concat_ws(" ", "question", "more")).alias("expanded"))
