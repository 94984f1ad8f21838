"""Scoring of answered questions: routing, retrieval, grounding, failure buckets and their totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import grounding, looks_arabic, normalize_question, phrases, says_not_found


def method_verdict(expected: Column, method: Column, not_found: Column, timed_out: Column) -> Column:
    unfound = (method == "not_found") | not_found
    return (
        F.when(timed_out, "TIMEOUT")
        .when(expected == "out_of_scope", F.when(method == "out_of_scope", "CORRECT").otherwise("WRONG"))
        .when(expected.isin("not_found", "trick"), F.when(unfound, "CORRECT").otherwise("HALLUCINATED"))
        .when(method == "out_of_scope", "WRONG")
        .when(unfound, "WRONG")
        .when(method.isin("generative", "cached"), "CORRECT")
        .otherwise("UNKNOWN")
    )


def retrieval_success(method: Column, not_found: Column, timed_out: Column, category: Column) -> Column:
    return (
        F.when(timed_out, "FAIL")
        .when((method == "out_of_scope") & (category == "out_of_scope"), "EXPECTED_SKIP")
        .when((method == "not_found") | not_found, "FAIL")
        .when(method.isin("generative", "cached"), "SUCCESS")
        .otherwise("FAIL")
    )


def grounding_score(verdict: Column) -> Column:
    """Null for verdicts that don't count."""
    return F.when(verdict == "GROUNDED", 1.0).when(verdict == "PARTIAL", 0.5).when(verdict == "UNGROUNDED", 0.0)


def combined_verdict(method: Column, not_found: Column, verdict: Column, timed_out: Column, errored: Column) -> Column:
    return (
        F.when(timed_out, "TIMEOUT")
        .when(errored, "ERROR")
        .when(method.isin("out_of_scope", "not_found") | not_found, "FAIL")
        .when(verdict == "GROUNDED", "PASS")
        .otherwise("FAIL")
    )


def bucket(r: dict[str, Column], settings: Settings = Settings()) -> Column:
    """A: retrieved, but no answer or an ungrounded one; B: partly grounded; C: not retrieved; null: no failure."""
    sim = F.coalesce(r["top_sim"], F.lit(0.0))
    return (
        F.when(r["method_verdict"] == "CORRECT", F.lit(None).cast("string"))
        .when((r["method"] == "generative") & (r["not_found"] | (r["judge"] == "UNGROUNDED")), "A")
        .when((r["judge"] == "PARTIAL") & (sim >= settings.low_confidence), "B")
        .when(r["method"].isin("not_found", "timeout", "error", "unknown"), "C")
        .when((r["method"] == "out_of_scope") & (r["category"] != "out_of_scope"), "C")
        .when((sim < settings.low_confidence) & (sim > 0), "C")
    )


def judge(ratio: Column) -> Column:
    """The default for a model that judges: by the share of the answer's phrases that the sources hold."""
    return F.when(ratio >= 0.5, "GROUNDED").when(ratio > 0, "PARTIAL").otherwise("UNGROUNDED")


def evaluation_runs(messages: DataFrame, sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """:func:`score_runs` of each exchange with both texts; all are expected to be answered."""
    one = messages.where("message_id is not null").groupBy("message_id").agg(F.min("user_message").alias("question"), F.max("assistant_message").alias("answer"))
    one = one.where("question is not null and answer is not null")
    line = F.concat(F.coalesce("snippet", F.lit("")), F.lit(" "), F.coalesce("document_name", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("source_id", line.alias("t"))))
    cited = sources.groupBy("message_id").agg(
        F.array_join(F.transform(lines, lambda x: x["t"]), " ").alias("text"), F.max("similarity").alias("top_sim"), F.count("*").alias("candidates")
    )
    base = one.join(cited, "message_id", "left").select(
        "message_id", "question", "answer", F.when(looks_arabic(F.col("question")), "arabic").otherwise("regulatory").alias("category"), F.lit("correct").alias("expected"),
        F.when(F.col("candidates").isNull(), "not_found").otherwise("generative").alias("method"), F.coalesce("top_sim", F.lit(0.0)).alias("top_sim"),
        F.coalesce("candidates", F.lit(0)).alias("candidates"), "text", F.lit(False).alias("timed_out"), F.lit(False).alias("errored"),
    )
    return score_runs(base, settings)


def expectation(category: Column, expected: Column) -> Column:
    """What is expected of an answer: that of its category for trick questions and those out of scope, else what is stated;
    without a statement that it is answered."""
    return F.when(category.isin("trick", "out_of_scope"), category).otherwise(F.coalesce(expected, F.lit("correct")))


def pipeline_runs(run: DataFrame, items: DataFrame, settings: Settings = Settings(), limit_seconds: float = 420.0) -> DataFrame:
    """:func:`score_runs` of the answers of pipeline.answer_run. items: (id, category, expected, elapsed): what took longer
    than the limit timed out, a null time is an error."""
    text = F.array_join(F.transform("sources", lambda x: F.concat(F.coalesce(x["snippet"], F.lit("")), F.lit(" "), F.coalesce(x["document_name"], F.lit("")))), " ")
    late = F.coalesce(F.col("elapsed") > limit_seconds, F.lit(False))
    base = run.join(items, "id").select(
        F.col("id").alias("message_id"), "question", "answer", "category", expectation(F.col("category"), F.col("expected")).alias("expected"),
        F.when(late, "timeout").when(F.col("elapsed").isNull(), "error").otherwise(F.col("method")).alias("method"), F.coalesce("top_similarity", F.lit(0.0)).alias("top_sim"),
        "candidates", F.when(F.size("sources") > 0, text).alias("text"), late.alias("timed_out"), F.col("elapsed").isNull().alias("errored"),
    )
    return score_runs(base, settings)


def score_runs(base: DataFrame, settings: Settings = Settings(), judge_by: Callable[[Column], Column] = judge) -> DataFrame:
    """base: (message_id, question, answer, category, expected, method, top_sim, candidates, text, timed_out, errored), text:
    that of the sources. (..., not_found, phrase_ratio, matched, judge, retrieval, method_verdict, combined, bucket).
    ``judge_by`` makes the judge's verdict of the share of the answer's phrases that the sources hold."""
    base = base.withColumn("not_found", F.coalesce(says_not_found(F.col("answer"), settings), F.lit(False))).withColumn("text", F.lower("text"))
    # Generators keep what they are given from being worked out again for every use.
    base = base.withColumn("found", F.explode(F.array(phrases(F.coalesce("answer", F.lit(""))))))
    none_matched = F.struct(F.lit(0).alias("phrases"), F.array().cast("array<string>").alias("matched"))
    given = F.when(F.col("not_found") | F.col("text").isNull(), none_matched).otherwise(grounding(F.col("found"), F.col("text")))
    held = base.select(*[c for c in base.columns if c not in ("found", "text")], F.explode(F.array(given)).alias("g"))
    ratio = F.when(F.col("g.phrases") > 0, F.round(F.size("g.matched") / F.col("g.phrases"), 2)).otherwise(0.0)
    scored = held.withColumn("phrase_ratio", ratio).withColumn("matched", F.size("g.matched")).drop("g")
    answered = F.col("method").isin("generative", "cached")
    scored = scored.withColumn("judge", F.when(~answered, "SKIP").otherwise(judge_by(F.col("phrase_ratio"))))
    scored = scored.withColumn("retrieval", retrieval_success(F.col("method"), F.col("not_found"), F.col("timed_out"), F.col("category")))
    scored = scored.withColumn("method_verdict", method_verdict(F.col("expected"), F.col("method"), F.col("not_found"), F.col("timed_out")))
    scored = scored.withColumn("combined", combined_verdict(F.col("method"), F.col("not_found"), F.col("judge"), F.col("timed_out"), F.col("errored")))
    return scored.withColumn("bucket", bucket({c: F.col(c) for c in scored.columns}, settings))


def kpi_summary(runs: DataFrame) -> DataFrame:
    """By category: retrieval rate over what should be retrieved, weighted and strict grounding, accuracy, and means of what
    is above zero."""
    pct = lambda x: F.round(x * 100, 2)
    score = grounding_score(F.col("judge"))
    eligible = F.count_if(F.col("retrieval") != "EXPECTED_SKIP")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), 4)
    return runs.groupBy("category").agg(
        F.count("*").alias("questions"),
        pct(F.count_if(F.col("retrieval") == "SUCCESS") / eligible).alias("retrieval_pct"),
        pct(F.avg(score)).alias("weighted_grounding_pct"),
        pct(F.count_if(F.col("judge") == "GROUNDED") / F.count(score)).alias("strict_grounding_pct"),
        pct(F.count_if(F.col("method_verdict") == "CORRECT") / F.count("*")).alias("accuracy_pct"),
        mean("phrase_ratio").alias("mean_phrase_ratio"),
        mean("top_sim").alias("mean_top_sim"),
        mean("candidates").alias("mean_candidates"),
    )


def verdict_counts(runs: DataFrame) -> DataFrame:
    """(kind, value, n): how often each verdict of each kind is given."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("retrieval", "judge", "method_verdict", "combined", "method")])
    return runs.select(F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def failure_buckets(runs: DataFrame, members: int = 1_000) -> DataFrame:
    """(bucket, category, n, first_members): how many there are, and the least ids, at most ``members``, as a report lists
    them; all of them are the rows of ``runs``."""
    rank = F.row_number().over(Window.partitionBy("bucket", "category").orderBy("message_id"))
    counts = runs.where("bucket is not null").groupBy("bucket", "category").agg(F.count("*").alias("n"))
    listed = runs.where("bucket is not null").withColumn("r", rank).where(F.col("r") <= members).groupBy("bucket", "category").agg(F.sort_array(F.collect_list("message_id")).alias("first_members"))
    return counts.join(listed, ["bucket", "category"])


def generator_stats(tested: DataFrame) -> DataFrame:
    """tested: (category, elapsed, combined, timed_out, errored). One row for each category and one, null, for all: tested,
    passed, timeouts, errors, pass rate over what was answered, mean and greatest time in seconds."""
    done = F.count_if(~F.col("timed_out") & ~F.col("errored"))
    passed = F.count_if(F.col("combined") == "PASS")
    return tested.rollup("category").agg(
        F.count("*").alias("tested"), passed.alias("passed"), F.count_if("timed_out").alias("timeouts"), F.count_if("errored").alias("errors"),
        F.round(F.when(done > 0, passed * 100 / done), 2).alias("pass_pct"), F.round(F.avg("elapsed"), 4).alias("mean_elapsed"), F.max("elapsed").alias("max_elapsed"),
    )


def pass_rates(runs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(category, passed, total): how many are at or above the confidence threshold."""
    return runs.groupBy("category").agg(F.count_if(F.col("top_sim") >= settings.low_confidence).alias("passed"), F.count("*").alias("total"))


def run_report(runs: DataFrame) -> DataFrame:
    """(kind, message_id, line) as JSON: a totals line for each category and a results line for each run, so that a report
    of any size is a set of lines, not one value."""
    totals = runs.groupBy("category").agg(F.count("*").alias("questions"), F.count_if(F.col("combined") == "PASS").alias("passed"))
    heads = totals.select(F.lit("totals").alias("kind"), F.lit(None).cast("string").alias("message_id"), F.to_json(F.struct("category", "questions", "passed")).alias("line"))
    fields = ("category", "expected", "method", "method_verdict", "retrieval", "judge", "combined", "matched")
    lines = runs.select(F.lit("result").alias("kind"), F.col("message_id").cast("string").alias("message_id"), F.to_json(F.struct(*fields)).alias("line"))
    return heads.unionByName(lines)


def dedup_questions(questions: DataFrame) -> DataFrame:
    """questions: (id, question). The first of each normalised question."""
    key = normalize_question(F.col("question"))
    order = Window.partitionBy("key").orderBy("id")
    return questions.withColumn("key", key).where("key <> ''").withColumn("n", F.row_number().over(order)).where("n = 1").select("id", "question", "key")


def judged_sources(sources: DataFrame, most: int = 5) -> DataFrame:
    """(message_id, n, snippets): the text of the first five sources of each answer, as a judge reads it."""
    order = Window.partitionBy("message_id").orderBy(F.col("similarity").desc_nulls_last(), "source_id")
    top = sources.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    parts = F.array_sort(F.collect_list(F.struct("nth", F.coalesce("snippet", F.lit("")).alias("s"))))
    return top.groupBy("message_id").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["s"]), "\n---\n").alias("snippets"))


def similarity_scores(sources: DataFrame) -> DataFrame:
    """(message_id, top, mean, sources): how similar an answer's sources are."""
    return sources.groupBy("message_id").agg(F.max("similarity").alias("top"), F.round(F.avg("similarity"), 6).alias("mean"), F.count("*").alias("sources"))


def width_check(rows: DataFrame, vector: str, width: int) -> DataFrame:
    """(state, n): vectors that are missing, of another width, or fit."""
    state = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != width, "mismatch").otherwise("ok")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
