"""From pages to chunks: choosing an extraction, sections, chunks with overlap, loading once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import clean_text, page_language, section_title, strip
from docspark.session import written

_SPLIT = re.compile(r"(?<=[.!?؟\n])\s+|\n{2,}")


def fold(text: str, settings: Settings) -> list[tuple[str, int]]:
    """(content, tokens) of the chunks of one page: sentences are added until the next would exceed the size; the last
    ones are carried over; chunks that are too short are dropped."""
    out, now, total = [], [], 0

    def flush() -> None:
        content = " ".join(now).strip()
        if len(content) >= settings.min_chunk_chars:
            out.append((content, total))

    for s in (x.strip() for x in _SPLIT.split(text)):
        if len(s) <= settings.min_sentence_chars:
            continue
        t = max(1, len(s) // 4)
        if total + t > settings.chunk_tokens and now:
            flush()
            now = now[-settings.chunk_overlap :] if settings.chunk_overlap > 0 else []
            total = sum(max(1, len(x) // 4) for x in now)
        now = [*now, s]
        total += t
    if now:
        flush()
    return out


def chunk_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """pages: (document_name, page, text). (id, document_name, page_start, page_end, section_title, chunk_no, content,
    token_count, language); the id is a hash of place and content, so that loading again finds the same."""
    ready = pages.where(F.length(strip(F.col("text"))) >= settings.min_page_chars).select("document_name", "page", section_title(F.col("text")).alias("section_title"), "text")
    page_type = ready.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["document_name", "page", "section_title", "chunk_no", "content", "token_count"]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                who, no, content, count = [], [], [], []
                for i, text in enumerate(part.column(3).to_pylist()):
                    for n, (c, t) in enumerate(fold(text, settings), 1):
                        who.append(i)
                        no.append(n)
                        content.append(c)
                        count.append(t)
                take = pa.array(who, pa.int64())
                columns = [*(part.column(k).take(take) for k in range(3)), pa.array(no, pa.int32()), pa.array(content, pa.string()), pa.array(count, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chunks = ready.mapInArrow(run, f"document_name string, page {page_type}, section_title string, chunk_no int, content string, token_count int")
    key = F.sha2(F.concat_ws("\x01", F.coalesce("document_name", F.lit("")), F.col("page").cast("string"), F.col("chunk_no").cast("string"), "content"), 256)
    return chunks.select(
        key.alias("id"), "document_name", F.col("page").alias("page_start"), F.col("page").alias("page_end"), "section_title", "chunk_no", "content", "token_count",
        page_language(F.col("content"), settings).alias("language"),
    )


def extraction_scores(candidates: DataFrame) -> DataFrame:
    """candidates: (doc, extractor, extractor_ord, page, text). (doc, extractor, extractor_ord, chars, score): 40 for the
    share of the longest extraction, 25 for the mean share of different words of pages with ten words or more (0.3 if there
    is none), 20 for pages with paragraphs, 15 for printable characters; pages are joined by a blank."""
    found = F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+")
    # A generator keeps the words from being found anew for every use.
    page = candidates.where(F.length("text") > 0).select(
        "doc", "extractor", "extractor_ord", "text", F.explode(F.array(found)).alias("w")
    ).select(
        "doc", "extractor", "extractor_ord", "text", (F.size("w") - F.array_size(F.filter("w", lambda x: x == ""))).alias("words"),
        F.size(F.array_distinct(F.array_remove("w", ""))).alias("different"),
    ).select(
        "doc", "extractor", "extractor_ord", F.when(F.col("words") >= 10, F.col("different") / F.col("words")).alias("rich"),
        F.contains("text", F.lit("\n\n")).cast("int").alias("broken"), F.length("text").alias("chars"),
        F.length(F.regexp_replace("text", "[[\\p{C}\\p{Z}]&&[^\\n\\t ]]+", "")).alias("printable"),
    )
    total = page.groupBy("doc", "extractor", "extractor_ord").agg(
        F.coalesce(F.avg("rich"), F.lit(0.3)).alias("rich"), F.avg("broken").alias("broken"),
        (F.sum("chars") + F.count("*") - 1).alias("chars"), (F.sum("printable") + F.count("*") - 1).alias("printable"),
    )
    most = F.max("chars").over(Window.partitionBy("doc"))
    score = F.round(F.col("rich") * 25 + F.col("broken") * 20 + F.col("printable") / F.col("chars") * 15 + F.col("chars") / most * 40, 4)
    return total.select("doc", "extractor", "extractor_ord", "chars", score.alias("score"))


def extraction_winner(scores: DataFrame, close: float = 5.0) -> DataFrame:
    """(doc, extractor, score, runner_up): the best extraction, the earlier on a tie; the next one if it is close."""
    order = Window.partitionBy("doc").orderBy(F.col("score").desc(), "extractor_ord")
    ranked = scores.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead(F.struct("extractor", "score")).over(order))
    return ranked.where("n = 1").select("doc", "extractor", "score", F.when(F.col("score") - F.col("next.score") <= close, F.col("next.extractor")).alias("runner_up"))


def clean_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pages with cleaned text, without those that are too short."""
    return pages.withColumn("text", clean_text(F.col("text"))).where(F.length("text") >= settings.min_page_chars)


def not_ingested(names: DataFrame, registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """names: (document_name). Those that aren't registered with at least one chunk."""
    done = registry.select("document_name").join(chunks.select("document_name"), "document_name", "left_semi").distinct()
    return names.join(done, "document_name", "left_anti")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Insert if absent: the rows of ``incoming`` whose key isn't there, the first of each key by all columns."""
    fresh = incoming.join(existing.select(key), key, "left_anti")
    order = Window.partitionBy(key).orderBy(*[F.col(c) for c in incoming.columns if c != key])
    return fresh.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Insert or replace: the rows of ``incoming``, which has one for each key, and those of ``existing`` with other keys."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def ingest_summary(results: DataFrame) -> DataFrame:
    """results: (source_type, status, pages, chunks)."""
    s = F.col("status")
    return results.groupBy("source_type").agg(
        F.count_if(s == "ok").alias("ok"), F.count_if(s == "skipped").alias("skipped"), F.count_if(~s.isin("ok", "skipped", "found")).alias("failed"),
        F.coalesce(F.sum(F.when(s == "ok", F.col("pages"))), F.lit(0)).alias("pages"), F.coalesce(F.sum(F.when(s == "ok", F.col("chunks"))), F.lit(0)).alias("chunks"),
    )


def numbered(rows: DataFrame, order: Sequence[str | Column], out: str = "n") -> DataFrame:
    """``rows`` numbered from 1 in order, in ranges whose counts are added up, so that no task sorts the whole table. The
    ranges are written once: what is counted is what is numbered. Ties should be broken by ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__c"), F.min("__m").alias("__low"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    base = counts.select("__p", "__low", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    number = F.col("__m") - F.col("__low") + F.col("__base") + 1
    return ranged.join(F.broadcast(base), "__p").withColumn(out, number).drop("__p", "__m", "__low", "__base")


def numbered_within(rows: DataFrame, key: str, ts: str, ties: Sequence[str | Column], out: str = "n") -> DataFrame:
    """``rows`` numbered from 1 within each ``key`` in order of time, null times last: within its days, and over the counts of
    the days, so that a key with very many rows isn't one task's."""
    day = F.coalesce(F.to_date(ts), F.lit("9999-12-31").cast("date"))
    dated = rows.withColumn("__day", day)
    counts = dated.groupBy(key, "__day").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "__day", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(key, "__day").orderBy(F.col(ts).asc_nulls_last(), *ties)
    placed = dated.withColumn(out, F.row_number().over(within))
    return placed.join(base, [key, "__day"]).withColumn(out, F.col(out) + F.col("__base")).drop("__day", "__base")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with their batch number in order."""
    return numbered(rows, [order], "__n").withColumn("batch", (F.floor((F.col("__n") - 1) / size) + 1).cast("int")).drop("__n")
