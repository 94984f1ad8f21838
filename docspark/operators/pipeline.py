"""From questions to answers in one plan. What is cheap comes first, and each later stage sees only the questions that are
left: guards, expansion, vectors, the cache of answers, search by vectors and words, the confidence guard, reranking, the
generator, and what is done to its text. Stages that are used more than once are written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions.text import clean_output, is_arabic, says_not_found, snippet, strip, strip_not_found
from docspark.models import Models, embed
from docspark.operators.answer import context, prompt
from docspark.operators.guards import early_method, expand
from docspark.operators.retrieve import cache_lookup, confidence_guard, hybrid_merge, keyword_topk, rerank, vector_topk
from docspark.session import written

SOURCES = "array<struct<document_name:string,page_start:int,page_end:int,section_title:string,similarity:double,snippet:string>>"


def _reply(early: Column, question: Column, definition: str, not_found: str) -> Column:
    refused = F.when(is_arabic(question), "هذا السؤال خارج نطاق الوثائق.").otherwise("This question is outside the scope of the documents.")
    return F.when(early == "none", "Please ask a question.").when(early == "generative", definition).when(early == "out_of_scope", refused).otherwise(not_found)


def answer_run(
    questions: DataFrame, chunks: DataFrame, cache: DataFrame | None = None, models: Models = Models(), settings: Settings = Settings(),
    keyword: str = "reporting portal", definition: str = "The reporting portal is where reports are submitted.", top_k: int | None = None, hybrid: bool = True,
) -> DataFrame:
    """questions: (id, question[, summary]), ids are unique; chunks: (id, document_name, page_start, page_end,
    section_title, content, embedding); cache: (entry_id, embedding, result). (id, question, method, cached, answer, sources,
    candidates, top_similarity, rerank_score, embedding): one row for each question.

    Null and blank questions have the method none. Chunks without text or vector are found by the other one only. Cached
    results are texts; they come without sources. Of chunks of the same document and pages, the best is a source."""
    not_found = settings.not_found[0].capitalize() + "."
    summary = F.col("summary") if "summary" in questions.columns else F.lit(None).cast("string")
    q = questions.select("id", strip(F.col("question")).alias("question"), summary.alias("summary")).withColumn("early", early_method(F.col("question"), keyword, settings))
    asked = q.where("early is null").withColumn("expanded", expand(F.col("question"), settings))
    asked = written(embed(asked, "expanded", model=models.embedder, prefix="query: ", kind="array<double>").drop("early"), "asked")

    def row(df: DataFrame, method: Column, answer: Column, **given: Column) -> DataFrame:
        kinds = {"cached": "boolean", "sources": SOURCES, "candidates": "bigint", "top_similarity": "double", "rerank_score": "double", "embedding": "array<double>"}
        empty = {"cached": F.lit(False), "sources": F.array(), "candidates": F.lit(0)}
        more = [given.get(c, empty.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in kinds.items()]
        return df.select("id", "question", method.alias("method"), answer.alias("answer"), *more)

    early = q.where("early is not null")
    out = row(early, F.col("early"), _reply(F.col("early"), F.coalesce("question", F.lit("")), definition, not_found))
    rest = asked
    if cache is not None:
        hit = cache_lookup(asked.select("id", "embedding"), cache.select("entry_id", "embedding"), "best", settings)
        hit = written(hit.join(cache.select("entry_id", "result"), "entry_id").withColumnRenamed("query_id", "id"), "cached")
        out = out.unionByName(row(asked.join(hit.select("id", "result"), "id"), F.lit("cached"), F.col("result"), cached=F.lit(True), embedding=F.col("embedding")))
        rest = asked.join(hit.select("id"), "id", "left_anti")
    near = vector_topk(rest.select("id", "embedding"), chunks.select("id", "embedding"), settings.fetch_k, settings.similarity_floor)
    words = keyword_topk(rest.select("id", "expanded"), chunks.select("id", "content"), settings.fetch_k) if hybrid else near.limit(0)
    merged = written(hybrid_merge(near, words, settings), "candidates")
    guard = confidence_guard(merged, settings)
    judged = rest.join(guard.withColumnRenamed("query_id", "id").withColumnRenamed("method", "m"), "id", "left").select(
        *rest.columns, F.coalesce("candidates", F.lit(0)).alias("candidates"), "top_similarity", F.coalesce("m", F.lit("not_found")).alias("m")
    )
    judged = written(judged, "judged")
    unfound = judged.where("m = 'not_found'")
    out = out.unionByName(row(unfound, F.col("m"), F.lit(not_found), candidates=F.col("candidates"), top_similarity=F.col("top_similarity"), embedding=F.col("embedding")))
    found = judged.where("m = 'generative'")
    kept = merged.join(found.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    top = rerank(kept, found.select("id", "question"), chunks.select("id", "content"), top_k, settings, models.scorer)
    passages = written(
        top.select(F.col("query_id").alias("message_id"), F.col("final_rank").alias("nth"), F.col("similarity").cast("double"), "score", "id").join(
            chunks.select("id", "document_name", "page_start", "page_end", "section_title", F.col("content").alias("snippet")), "id"
        ),
        "passages",
    )
    texts = context(passages).withColumnRenamed("message_id", "id")
    first = passages.groupBy("message_id", "document_name", "page_start", "page_end").agg(F.min_by(F.struct("nth", "section_title", "similarity", "snippet", "score"), "nth").alias("x"))
    one = F.struct("document_name", "page_start", "page_end", "x.section_title", F.round("x.similarity", 4).alias("similarity"), snippet(F.col("x.snippet"), settings.snippet_chars).alias("snippet"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("x.nth", one.alias("s")))), lambda x: x["s"])
    cited = first.groupBy(F.col("message_id").alias("id")).agg(listed.alias("sources"), F.max("x.score").alias("rerank_score"))
    ready = found.join(texts, "id").join(cited, "id")
    said = models.generate(F.col("context"), F.col("question"), prompt(F.col("question"), F.col("context"), F.col("summary"), settings))
    ready = ready.withColumn("said", said)
    text = strip_not_found(clean_output(F.col("said"), F.col("question"), settings) if settings.postprocess else F.col("said"), settings)
    return out.unionByName(row(ready, F.lit("generative"), text, sources=F.col("sources"), candidates=F.col("candidates"), top_similarity=F.col("top_similarity"), rerank_score=F.col("rerank_score"), embedding=F.col("embedding")))


def cacheable(run: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(entry_id, embedding, result) of the answers worth keeping: generated from sources, and not saying that nothing was
    found. The id is a hash of the question, so that the same question refreshes its entry."""
    kept = run.where((F.col("method") == "generative") & (F.size("sources") > 0) & ~says_not_found(F.col("answer"), settings))
    return kept.select(F.xxhash64("question").alias("entry_id"), "embedding", F.col("answer").alias("result"))
