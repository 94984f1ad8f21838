"""Reading and writing: line-delimited JSON, files, idempotent loads, the table of cached answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docspark.functions.urls import local_name
from docspark.schemas import STREAM_EVENTS
from docspark.session import written


def read_ndjson(spark: SparkSession, path: str, schema: StructType = STREAM_EVENTS) -> DataFrame:
    """The objects of the lines; blank and malformed lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = StructType(schema.fields).add("__bad", "string")
    parsed = lines.select(F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("x"))
    return parsed.where("x is not null and x.__bad is null").select("x.*").drop("__bad")


def write_ndjson(rows: DataFrame, path: str, column: str | None = None) -> None:
    """A line for each row: the text of ``column``, or the row as JSON."""
    (rows.select(F.col(column).alias("value")) if column else rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))).write.mode("append").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def export_array(rows: DataFrame, order: str) -> DataFrame:
    """One row with the rows as a JSON array: a report's export, for results that fit one value."""
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order]))), lambda x: x)).alias("json"))


def read_files(spark: SparkSession, path: str, least: int = 2_048) -> DataFrame:
    """(path, length, content) of files larger than ``least`` bytes; smaller ones are broken downloads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > least).select("path", "length", "content")


def cached_files(wanted: DataFrame, folder: str, least: int = 2_048) -> DataFrame:
    """wanted: (url). (url, name, path): the file that a link is kept in, and where it is if it is there already with more than
    ``least`` bytes; null if it has to be fetched (again). Files are only listed."""
    spark = wanted.sparkSession
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") > least)
    there = there.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"))
    return wanted.select("url", local_name(F.col("url")).alias("name")).join(there, "name", "left").select("url", "name", "path")


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at ``path``, or an empty one if there is none yet; any other error is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def append_new(rows: DataFrame, path: str, key: str | Sequence[str]) -> DataFrame:
    """Append the rows whose key isn't in the Parquet table at ``path``; gives what was appended. Loading again adds none."""
    keys = [key] if isinstance(key, str) else list(key)
    there = table_or_empty(rows.sparkSession, path, rows.schema).select(*keys)
    fresh = written(rows.dropDuplicates(keys).join(there, keys, "left_anti").select(rows.columns), "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh


def append_optional(rows: DataFrame, path: str, schema: StructType, key: str | Sequence[str]) -> DataFrame:
    """Append to a table with ``schema``: fields that ``rows`` lacks are null, other columns are left out, rows without a
    key are refused, and what is there stays. For messages and feedback, whose callers leave out what they don't know."""
    full = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    keys = [key] if isinstance(key, str) else list(key)
    return append_new(full.dropna(subset=keys), path, keys)


def store_answers(answers: DataFrame, path: str, as_of: str | None = None) -> None:
    """answers: (entry_id, embedding, result). Appended to the cache table with the time."""
    stamp = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    answers.select(F.col("entry_id").cast("bigint"), "embedding", "result", stamp.alias("stored_at")).write.mode("append").parquet(path)


def live_answers(entries: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """entries: the cache table. The latest row of each entry, which refreshes it, unless its time has run out."""
    latest = entries.groupBy("entry_id").agg(F.max_by(F.struct("embedding", "result", "stored_at"), F.struct("stored_at", "result")).alias("x"))
    return latest.select("entry_id", "x.*").where(F.unix_timestamp("stored_at") >= F.unix_timestamp(as_of) - ttl_seconds)


def resume(rows: DataFrame, path: str, schema: StructType, key: str) -> DataFrame:
    """The rows that an earlier run has not put into the JSON lines at ``path``; ``schema`` is that of the lines."""
    try:
        done = read_jsonl(rows.sparkSession, path, schema).select(key)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows
    return rows.join(done, key, "left_anti")


def paged(rows: DataFrame, order: str, size: int, page: int) -> DataFrame:
    """Page ``page``, from 0, of the rows in order."""
    return rows.orderBy(order).offset(page * size).limit(size)
