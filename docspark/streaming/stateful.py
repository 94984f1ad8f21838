"""Stateful streams over the request log: (event_id, ts, user_id, event_type, value), and over cache entries and links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docspark.config import Settings
from docspark.schemas import EVENTS
from docspark.session import new_path


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(["ts", "event_id"])


def latency_ring(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(user_id, event_id, mean_latency): each request with the mean of its user's last 50, in order within a batch; nulls
    don't count."""
    size = settings.latency_window

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(state.get[0]) if state.exists else []
        rows = _in_order(parts)
        there = rows.value.notna().to_numpy()
        values = np.concatenate((ring, rows.value.to_numpy(float)[there]))
        means = pd.Series(values).rolling(size, min_periods=1).mean().round(8).to_numpy()
        at = len(ring) + np.cumsum(there) - 1
        state.update((values[-size:].tolist(),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows.event_id.to_numpy(), "mean_latency": [means[i] if i >= 0 else None for i in at]})

    keyed = events.groupBy("user_id")
    return keyed.applyInPandasWithState(run, "user_id long, event_id long, mean_latency double", "ring array<double>", "append", GroupStateTimeout.NoTimeout)


def hit_counts(events: DataFrame, hit: str = "view") -> DataFrame:
    """Running totals (complete mode): hits, requests."""
    return events.groupBy("user_id").agg(F.count_if(F.col("event_type") == hit).alias("hits"), F.count("*").alias("requests"))


def summary_trigger(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(user_id, event_id, count): the events that are their user's sixth, twelfth and so on."""
    every = settings.summary_every

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        ids = _in_order(parts).event_id.to_numpy()
        state.update((n + len(ids),))
        fires = np.arange(every - 1 - n % every, len(ids), every)
        if len(fires):
            yield pd.DataFrame({"user_id": key[0], "event_id": ids[fires], "count": n + fires + 1})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, count long", "n long", "append", GroupStateTimeout.NoTimeout)


def live_entries(entries: DataFrame, settings: Settings = Settings(), delay: str = "0 seconds") -> DataFrame:
    """entries: a stream of (entry_id, result, stored_at). (entry_id, result, event): "new" for an entry that isn't there,
    "refreshed" for one that is, whose time begins again; "expired", with the result it had, once the watermark has passed
    its time to live."""
    ttl = settings.cache_ttl_seconds

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["entry_id", "result", "event"]
        if state.hasTimedOut:
            last = state.get[1]
            state.remove()
            yield pd.DataFrame([(key[0], last, "expired")], columns=columns)
            return
        rows = pd.concat(list(parts)).sort_values(["stored_at", "result"])
        until, last = state.get if state.exists else (None, None)
        out = []
        for at, result in zip(rows.stored_at.astype("datetime64[ms]").astype("int64"), rows.result, strict=True):
            if until is not None and at > until:
                out.append((key[0], last, "expired"))
            out.append((key[0], result, "new" if until is None or at > until else "refreshed"))
            until, last = at + ttl * 1000, result
        state.update((until, last))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    marked = entries.withWatermark("stored_at", delay)
    return marked.groupBy("entry_id").applyInPandasWithState(run, "entry_id long, result string, event string", "until long, result string", "append", GroupStateTimeout.EventTimeTimeout)


def first_seen(links: DataFrame) -> DataFrame:
    """links: a stream of (site, url, ...). The first row of each url of a site, however long ago that was."""
    return links.dropDuplicates(["site", "url"])


def run_once(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append", partitions: int | None = None) -> DataFrame:
    """All that is there now, written as a table to the shared folder. In complete mode each batch replaces the one before.
    ``partitions``: of the state, which a new checkpoint keeps for good; the session's setting if not given."""
    spark = stream.sparkSession
    path = new_path(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_path(spark, f"checkpoint-{name}")).trigger(availableNow=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if partitions:
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
        if mode == "append":
            query = writer.format("parquet").option("path", path).start()
        else:
            query = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(path)


def polled(stream: DataFrame, path: str, checkpoint: str, seconds: int = 30) -> StreamingQuery:
    """Figures that are brought up to date every ``seconds`` seconds, as a table at ``path`` (complete mode)."""
    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
    return writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
