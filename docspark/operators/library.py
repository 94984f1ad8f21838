"""The document library and the service's own figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import strip
from docspark.operators.ingest import numbered, numbered_within


def dedup_registry(registry: DataFrame) -> DataFrame:
    """One row for each name without outer blanks, of four characters or more, in the order of the ids: the first one, or,
    if its type is null, the first with a type."""
    named = registry.withColumn("name", strip(F.col("document_name"))).where(F.length("name") >= 4)
    order = Window.partitionBy("name").orderBy("id")
    ranked = named.withColumn("n", F.row_number().over(order))
    preference = F.when((F.col("n") == 1) & F.col("source_type").isNotNull(), 0).when(F.coalesce("source_type", F.lit("")) != "", 1).otherwise(2)
    best = Window.partitionBy("name").orderBy(preference, "id")
    return ranked.withColumn("b", F.row_number().over(best)).where("b = 1").select("name", "id", "source_type", "total_pages")


def library(registry: DataFrame, chunks: DataFrame, search: str | None = None, limit: int | None = 20, default_type: str = "Unknown") -> DataFrame:
    """(name, source_type, total_pages, chunk_count, total): documents with the number of their chunks, most first; total
    counts all that match."""
    counts = chunks.groupBy("document_name").agg(F.count("*").alias("chunk_count"))
    docs = dedup_registry(registry)
    if search:
        docs = docs.where(F.contains(F.lower("name"), F.lit(search.lower())))
    pages = F.when(F.coalesce("total_pages", F.lit("")) != "", F.col("total_pages")).otherwise("?")
    listed = docs.join(counts, docs.name == counts.document_name, "left").select(
        "name", F.coalesce("source_type", F.lit(default_type)).alias("source_type"), pages.alias("total_pages"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")
    )
    total = listed.agg(F.count("*").alias("total"))
    shown = listed if limit is None else listed.orderBy(F.col("chunk_count").desc(), "name").limit(limit)
    return shown.crossJoin(F.broadcast(total))  # one row


def stats(registry: DataFrame, chunks: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row of raw counts."""
    one = [df.agg(F.count("*").alias(name)) for df, name in ((registry, "documents"), (chunks, "chunks"), (messages, "messages"))]
    one.append(sessions.agg(F.countDistinct("session_id").alias("sessions")))
    out = one[0]
    for other in one[1:]:
        out = out.crossJoin(other)
    return out


def rolling_latency(events: DataFrame, settings: Settings = Settings(), block: int = 100_000) -> DataFrame:
    """(event_id, mean_latency): of each request the mean of the last 50, over all requests in order. They are numbered in
    ranges and taken in blocks of ``block`` numbers, each with the last 49 of the block before, so no task has them all."""
    n, before = F.col("n") - 1, settings.latency_window - 1
    block = max(block, settings.latency_window)
    rows = numbered(events.select("event_id", "ts", "value"), ["ts", "event_id"])
    own = F.floor(n / block)
    blocks = F.when(n % block >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("event_id", "n", "value", F.explode(blocks).alias("block"), own.alias("own"))
    order = Window.partitionBy("block").orderBy("n").rowsBetween(-before, 0)
    return rows.withColumn("mean", F.avg("value").over(order)).where("block = own").select("event_id", F.round("mean", 8).alias("mean_latency"))


def running_hits(events: DataFrame, hit: str = "view", block: int = 100_000) -> DataFrame:
    """(event_id, hits, requests, hit_rate): running counts over all requests in order: within blocks of numbers, and over
    the counts of the blocks."""
    rows = numbered(events.select("event_id", "ts", (F.col("event_type") == hit).cast("int").alias("hit")), ["ts", "event_id"])
    rows = rows.withColumn("block", F.floor((F.col("n") - 1) / block))
    sums = rows.groupBy("block").agg(F.sum("hit").alias("h"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    base = sums.select("block", F.coalesce(F.sum("h").over(over), F.lit(0)).alias("base"))
    order = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    hits = F.col("base") + F.coalesce(F.sum("hit").over(order), F.lit(0))
    found = rows.join(base, "block").select("event_id", hits.alias("hits"), F.col("n").alias("requests"))
    return found.withColumn("hit_rate", F.round(F.col("hits") * 100 / F.col("requests"), 1))


def rolling_latency_by_user(events: DataFrame, settings: Settings = Settings(), block: int = 100_000) -> DataFrame:
    """(user_id, event_id, mean_latency): of each request the mean of the last 50 of its user, in blocks like those of
    :func:`rolling_latency`."""
    n, before = F.col("n") - 1, settings.latency_window - 1
    block = max(block, settings.latency_window)
    rows = numbered_within(events.where("user_id is not null").select("user_id", "event_id", "ts", "value"), "user_id", "ts", ["event_id"])
    own = F.floor(n / block)
    blocks = F.when(n % block >= block - before, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("user_id", "event_id", "n", "value", F.explode(blocks).alias("block"), own.alias("own"))
    order = Window.partitionBy("user_id", "block").orderBy("n").rowsBetween(-before, 0)
    return rows.withColumn("mean", F.avg("value").over(order)).where("block = own").select("user_id", "event_id", F.round("mean", 8).alias("mean_latency"))


def name_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
