"""Search: vectors, words, both together, thresholds and the cache of answers.

Query sets are stated (a bounded set of rows against all rows): they are searched in blocks of ``block`` rows, so what is
sent to the executors at once has a fixed size however many queries there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.session import written


def _blocks(queries: DataFrame, block: int) -> Iterator[tuple[list, np.ndarray]]:
    rows = []
    for row in queries.toLocalIterator():
        if row[1] is not None:
            rows.append(row)
        if len(rows) == block:
            yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
            rows = []
    if rows:
        yield [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)


def _ids(values: pa.Array | list) -> np.ndarray:
    """Ids as an array that sorts like them."""
    return np.array(values) if isinstance(values, list) else np.array(values.to_pylist()) if pa.types.is_string(values.type) else values.to_numpy(zero_copy_only=False)


def vector_topk(
    queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, skip_self: bool = False, block: int = 2_048
) -> DataFrame:
    """queries, rows: (id, vector), ids of either are numbers or strings and not null. (query_id, id, similarity, rank): the
    rows with the highest inner product, rounded to nine decimals, more than ``floor``, ties to the smaller id; each partition keeps the best ``k`` of
    its rows, so no pairs are shuffled. Null vectors and those of another width take no part."""
    spark, out = rows.sparkSession, None
    kinds = [df.schema[0].dataType.simpleString() for df in (queries, rows)]
    kinds = ["string" if kind == "string" else "bigint" for kind in kinds]
    returned = f"query_id {kinds[0]}, id {kinds[1]}, similarity double"
    slim = rows.select(F.col(rows.columns[0]).cast(kinds[1]).alias("id"), F.col(rows.columns[1]).alias("v")).where("id is not null")
    for ids, vectors in _blocks(queries, block):
        width = vectors.shape[1]
        shared = spark.sparkContext.broadcast((ids, vectors))
        fit = slim.where(F.size("v") == width)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            asked, vectors = shared.value
            asked = _ids(asked)
            best_s = best_i = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                i = _ids(batch.column(0))
                order = np.argsort(i, kind="stable")
                i = i[order]  # places in order of the ids, so that a stable sort leaves ties to the smaller id
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)[order]
                s = np.round(vectors @ x.T, 9)
                if floor is not None:
                    s = np.where(s > floor, s, -np.inf)
                if skip_self:
                    s[asked[:, None] == i[None, :]] = -np.inf
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, i = np.take_along_axis(s, top, 1), i[top]
                if best_s is not None:
                    s, i = np.concatenate((best_s, s), 1), np.concatenate((best_i, i), 1)
                    top = np.lexsort((i, -s), axis=1)[:, :k]
                    s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                best_s, best_i = s, i
            if best_s is not None:
                q, r = np.nonzero(np.isfinite(best_s))
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q].tolist()), pa.array(best_i[q, r].tolist()), pa.array(best_s[q, r])], names=["query_id", "id", "similarity"])

        part = fit.mapInArrow(run, returned)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], returned)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([\\p{L}\\p{N}]+)"), 1)


def keyword_topk(queries: DataFrame, rows: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries, rows: (id, text). (query_id, id, score, rank) by BM25 over an inverted index. The corpus is read once: the
    empty term, which every text gets, carries its length, and of the others only the postings of asked terms are kept, before
    anything is shuffled; they are written and used for all counts."""
    q = queries.select(F.col(queries.columns[0]).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(queries.columns[1])))).alias("term"))
    r = rows.select(F.col(rows.columns[0]).alias("id"), tokens(F.col(rows.columns[1])).alias("w")).where("w is not null")
    asked = q.select("term").unionByName(q.sparkSession.createDataFrame([("",)], "term string")).distinct()
    each = r.select("id", F.size("w").alias("len"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("term"))
    postings = written(each.join(asked, "term", "left_semi").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "postings")
    size = postings.where("term = ''").agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    postings = postings.where("term <> ''")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = (
        postings.join(df, "term").join(q, "term").crossJoin(F.broadcast(size)).groupBy("query_id", "id").agg(F.round(F.sum(part), 4).alias("score"))
    )  # size is one row
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_merge(vector: DataFrame, keyword: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, id, similarity, source, place): vector hits first, then keyword hits not among them, whose similarity is
    the default one; rows without id are all kept."""
    v = vector.select("query_id", "id", "similarity", F.lit(0).alias("source"), "rank")
    w = keyword.select("query_id", "id", F.lit(settings.keyword_similarity).alias("similarity"), F.lit(1).alias("source"), "rank")
    both = v.unionByName(w)
    first = Window.partitionBy("query_id", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("?"), "source", "rank"))).orderBy("source", "rank")
    kept = both.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("source", "rank"))).drop("rank")


def word_share(question: Column, text: Column) -> Column:
    """The default for a cross-encoder: the share of the question's words that the text has."""
    asked = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(asked, F.array_distinct(tokens(text)))) / F.greatest(F.size(asked), F.lit(1)), 4)


def rerank(
    candidates: DataFrame, queries: DataFrame, rows: DataFrame, k: int | None, settings: Settings = Settings(), scorer: Callable[[Column, Column], Column] = word_share
) -> DataFrame:
    """candidates of :func:`hybrid_merge` with ``score``, best first, at most ``k``; 0 and null stand for the default.
    ``scorer`` makes a column from question and text: a pandas UDF around a model (models.pair_scorer), or the default."""
    q = queries.select(F.col(queries.columns[0]).alias("query_id"), F.col(queries.columns[1]).alias("__q"))
    r = rows.select(F.col(rows.columns[0]).alias("id"), F.col(rows.columns[1]).alias("__t"))
    scored = candidates.join(q, "query_id").join(r, "id").withColumn("score", scorer(F.col("__q"), F.col("__t"))).drop("__q", "__t")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "place")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= (k or settings.top_k))


def confidence_guard(candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, candidates, top_similarity, method): not found if the best candidate, before reranking, is too far."""
    top = candidates.groupBy("query_id").agg(F.count("*").alias("candidates"), F.round(F.max("similarity"), 4).alias("top_similarity"))
    return top.withColumn("method", F.when(F.col("top_similarity") < settings.low_confidence, "not_found").otherwise("generative"))


def threshold_sweep(top: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """top: (query_id, id, similarity, ...). (query_id, threshold, hits): hits at or above each of the fixed thresholds."""
    each = top.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in settings.thresholds])))
    return each.groupBy("query_id", "threshold").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("hits"))


def verdict(top: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, top_similarity, verdict)"""
    best = top.groupBy("query_id").agg(F.round(F.max("similarity"), 4).alias("top_similarity"))
    s = F.col("top_similarity")
    return best.withColumn("verdict", F.when(s >= settings.low_confidence, "pass").when(s >= 0.70, "close").when(s >= 0.50, "far").otherwise("very far"))


def similarity_health(top: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return top.select("query_id", "id", F.when(s < 0.3, "weak").when(s < 0.6, "fair").otherwise("ok").alias("health"))


def cache_lookup(queries: DataFrame, entries: DataFrame, mode: str = "best", settings: Settings = Settings(), as_of: Column | None = None) -> DataFrame:
    """entries: (entry_id, embedding, result, stored_at). (query_id, entry_id, similarity): the nearest entry at or above
    the threshold, or, in mode "first", the earliest such entry; entries past their time are left out."""
    if as_of is not None:
        entries = entries.where(F.unix_timestamp("stored_at") >= F.unix_timestamp(as_of) - settings.cache_ttl_seconds)
    kind = "string" if queries.schema[0].dataType.simpleString() == "string" else "bigint"
    returned, found = f"query_id {kind}, entry_id bigint, similarity double", None
    for ids, vectors in _blocks(queries, 2_048):
        shared = entries.sparkSession.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vectors = shared.value
            ids = _ids(ids)
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                s = np.round(vectors @ x.T, 9)
                q, r = np.nonzero(s >= settings.cache_similarity)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q].tolist(), None if len(q) else pa.string() if kind == "string" else pa.int64()), pa.array(batch.column(0).to_numpy()[r]), pa.array(s[q, r])], names=["query_id", "entry_id", "similarity"])

        slim = entries.select(F.col("entry_id").cast("bigint"), "embedding").where(F.size("embedding") == vectors.shape[1])
        part = slim.mapInArrow(run, returned)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return entries.sparkSession.createDataFrame([], returned)
    best = F.struct("similarity", (-F.col("entry_id")).alias("e")) if mode == "best" else F.struct((-F.col("entry_id")).alias("e"), "similarity")
    return found.groupBy("query_id").agg(F.max(best).alias("x")).select("query_id", (-F.col("x.e")).alias("entry_id"), F.round("x.similarity", 4).alias("similarity"))
