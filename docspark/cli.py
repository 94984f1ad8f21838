"""Loading pages from the command line: python -m docspark.cli (--pages TABLE | --file PATH) --chunks TABLE [--registry TABLE]
[--dry-run | --validate-only]. Prints a line for each document."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.config import from_environment
from docspark.models import Embedder, embed
from docspark.operators.ingest import chunk_pages, clean_pages, ingest_summary, not_ingested
from docspark.schemas import CHUNKS, DOC_REGISTRY
from docspark.session import written
from docspark.sources.extract import best_pages, extract
from docspark.sources.io import append_new, append_optional, read_files, table_or_empty


def pages_of_files(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """The pages of all files under ``path``, named after the files."""
    name = F.regexp_replace(F.regexp_extract("doc", "([^/]*)$", 1), "(?<=.)\\.[^.]*$", "")
    return best_pages(extract(read_files(spark, path, 0))).select(name.alias("document_name"), "page", "text", F.lit(source_type).cast("string").alias("source_type"))


def ingest(
    spark: SparkSession, pages: str | DataFrame, chunks: str, registry: str | None = None, dry_run: bool = False, validate_only: bool = False,
    chunk_tokens: int | None = None, overlap: int | None = None, model: Embedder | None = None, clean: bool = True,
) -> DataFrame:
    """pages: a table (document_name, page, text[, source_type]) or its path. (document_name, source_type, status, pages,
    chunks): found (only validated), skipped (there with chunks already), no_text, ok (loaded, or would be). Loading embeds the chunks,
    adds those that aren't there and registers the documents; loading again adds nothing."""
    settings = from_environment()
    settings = replace(settings, chunk_tokens=chunk_tokens or settings.chunk_tokens, chunk_overlap=settings.chunk_overlap if overlap is None else overlap)
    given = spark.read.parquet(pages) if isinstance(pages, str) else pages
    kind = F.col("source_type") if "source_type" in given.columns else F.lit(None).cast("string")
    given = given.select("document_name", "page", "text", kind.alias("source_type")).where("document_name is not null")
    names = given.groupBy("document_name").agg(F.min("source_type").alias("source_type"), F.count("*").alias("pages"))
    if validate_only:
        return names.select("document_name", "source_type", F.lit("found").alias("status"), "pages", F.lit(0).cast("bigint").alias("chunks"))
    there = table_or_empty(spark, chunks, CHUNKS).select("document_name")
    todo = not_ingested(names.select("document_name"), there, there)
    names = written(names.join(todo.withColumn("new", F.lit(True)), "document_name", "left"), "names")
    todo = given.where("text is not null").join(names.where("new"), "document_name", "left_semi")
    made = chunk_pages(clean_pages(todo, settings) if clean else todo, settings)
    made = written(made if dry_run else embed(made, "content", model=model), "chunks")
    counts = made.groupBy("document_name").agg(F.count("*").alias("chunks"))
    if not dry_run:
        append_new(made, chunks, "id")
        if registry:
            fresh = names.where("new").join(counts, "document_name", "left_semi")
            rows = fresh.select(F.md5("document_name").alias("id"), "document_name", "source_type", F.col("pages").cast("string").alias("total_pages"))
            append_optional(rows, registry, DOC_REGISTRY, ["document_name"])
    status = F.when(F.col("new").isNull(), "skipped").when(F.col("chunks").isNull(), "no_text").otherwise("ok")
    return names.join(counts, "document_name", "left").select("document_name", "source_type", status.alias("status"), "pages", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--pages", help="Parquet table of pages")
    source.add_argument("--file", help="a file or a folder of files")
    parser.add_argument("--chunks", required=True)
    parser.add_argument("--registry")
    parser.add_argument("--source-type")
    parser.add_argument("--dry-run", action="store_true")
    parser.add_argument("--validate-only", action="store_true")
    parser.add_argument("--chunk-size", type=int)
    parser.add_argument("--overlap", type=int)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    pages = a.pages or pages_of_files(spark, a.file, a.source_type)
    done = ingest(spark, pages, a.chunks, a.registry, a.dry_run, a.validate_only, a.chunk_size, a.overlap)
    done.orderBy("document_name").show(50, truncate=False)
    ingest_summary(done.withColumn("source_type", F.coalesce("source_type", F.lit("?")))).show(truncate=False)


if __name__ == "__main__":
    main()
