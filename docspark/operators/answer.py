"""From retrieved passages to an answer with sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import is_arabic, snippet, strip


def dedup_sources(sources: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """sources: (message_id, source_id, document_name, page_start, page_end, section_title, similarity, snippet). One for
    each document and pages of a message, the most similar; ``nth`` counts them from 1."""
    rank = [F.col("similarity").desc_nulls_last(), F.col("source_id")]
    key = Window.partitionBy("message_id", "document_name", "page_start", "page_end").orderBy(*rank)
    kept = sources.withColumn("n", F.row_number().over(key)).where("n = 1")
    nth = F.row_number().over(Window.partitionBy("message_id").orderBy(*rank))
    return kept.select(
        "message_id", nth.alias("nth"), "source_id", "document_name", "page_start", "page_end", "section_title",
        F.round("similarity", 4).alias("similarity"), snippet(F.col("snippet"), settings.snippet_chars).alias("snippet"),
    )


def context(sources: DataFrame) -> DataFrame:
    """sources: of :func:`dedup_sources`. (message_id, context): the numbered passages, parted by empty lines."""
    title = F.when(F.coalesce("section_title", F.lit("")) != "", F.concat(F.lit(", "), "section_title")).otherwise("")
    pages = F.concat(F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("?")))
    head = F.concat(F.lit("[Passage "), F.col("nth").cast("string"), F.lit("] ("), F.coalesce("document_name", F.lit("?")), F.lit(", Pages "), pages, title, F.lit(")\n"))
    block = F.concat(head, F.coalesce("snippet", F.lit("")))
    blocks = F.array_sort(F.collect_list(F.struct("nth", block.alias("text"))))
    return sources.groupBy("message_id").agg(F.array_join(F.transform(blocks, lambda x: x["text"]), "\n\n").alias("context"))


def prompt(question, context_col, summary=None, settings: Settings = Settings()):
    """The text for a generator: a summary if there is one, the context, the question, and how to answer."""
    how = F.when(is_arabic(question, settings), "أجب بالعربية من المقاطع فقط.").otherwise("Answer from the passages only.")
    head = F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("Conversation so far:\n"), summary, F.lit("\n\n"))).otherwise("") if summary is not None else F.lit("")
    return F.concat(head, F.lit("Context:\n"), context_col, F.lit("\n\nQuestion: "), question, F.lit("\n"), how)


def stream_events(answers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """answers: (message_id, answer), also (sources, cached, method, error) if there are such columns. (message_id, seq,
    event) as JSON lines: a token event for each blank-separated part, whose blanks come back when they are joined; a sources
    event, if there is such a column, with shortened snippets; a done event. An error event alone where ``error`` isn't null;
    null answers without an error have no events."""
    has = set(answers.columns)
    parts = F.split("answer", " ")
    n = F.size(parts)
    kind = lambda x: F.lit(x).alias("type")
    token = F.transform(parts, lambda p, i: F.to_json(F.struct(kind("token"), F.when(i < n - 1, F.concat(p, F.lit(" "))).otherwise(p).alias("text"))))
    tail = []
    if "sources" in has:
        short = F.transform("sources", lambda x: x.withField("snippet", snippet(F.coalesce(x["snippet"], F.lit("")), settings.stream_snippet_chars)))
        also = [F.coalesce("cached", F.lit(False)).alias("cached")] if "cached" in has else []
        also += [F.col("method")] if "method" in has else []
        tail.append(F.to_json(F.struct(kind("sources"), F.coalesce(short, F.array()).alias("sources"), "message_id", *also)))
    events = F.concat(token, F.array(*tail, F.to_json(F.struct(kind("done")))))
    if "error" in has:
        events = F.when(F.col("error").isNotNull(), F.array(F.to_json(F.struct(kind("error"), F.col("error").alias("message"))))).otherwise(events)
    return answers.where(F.col("answer").isNotNull() | (F.col("error").isNotNull() if "error" in has else F.lit(False))).select("message_id", F.posexplode(events).alias("seq", "event"))


def display(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers: (message_id, question, answer). (message_id, report): question, answer and numbered sources with their pages
    and similarity as text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    line = F.concat(
        F.lit("  "), F.col("nth").cast("string"), F.lit(". "), F.coalesce("document_name", F.lit("?")), F.lit(", pages "), text("page_start"), F.lit("-"), text("page_end"),
        F.lit(", similarity "), F.coalesce(F.format_string("%.4f", F.col("similarity")), F.lit("?")),
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("t")))), lambda x: x["t"])
    listed = sources.groupBy("message_id").agg(F.array_join(lines, "\n").alias("lines"))
    report = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nAnswer: "), strip(F.coalesce("answer", F.lit(""))), F.lit("\nSources:\n"), F.coalesce("lines", F.lit("  none")))
    return answers.join(listed, "message_id", "left").select("message_id", report.alias("report"))
