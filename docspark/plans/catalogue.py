"""The queries over the reference tables and, where SQL expresses them, the SQL that must give the same rows.

Names follow the operator inventory. All run over whole tables; a limit stands only where the report has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.functions import text as T
from docspark.functions import urls as U
from docspark.models import embed, extractive_answer, template_questions
from docspark.operators import answer as A
from docspark.operators import crawl as C
from docspark.operators import evaluate as E
from docspark.operators import guards as G
from docspark.operators import ingest as I
from docspark.operators import library as L
from docspark.operators import retrieve as R
from docspark.operators import sessions as S
from docspark.session import read
from docspark.streaming import stateful as ST

#: The rules for the test tables.
SETTINGS = Settings(
    drift=("in conclusion", "where two directors disagree", "in general terms"),
    out_of_scope=("\\bweather\\b", "\\brecipes?\\b", "\\bfootball\\b", "\\bwhistleblowing\\b", "\\bجدول الرسوم\\b"),
    rules=(
        ("AML", "anti money laundering"),
        ("aml", "financial crime controls"),
        ("bank", "banking institution"),
        ("fee schedule", "table of charges"),
        ("C+", "grade c plus"),
        ("customer complaint records", "complaints handling register"),
        ("البنك", "bank"),
        ("سجل الحوادث", "incident log"),
    ),
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# Pieces of SQL.
WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
SQUEEZE = lambda x: STRIP(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
AR = r"\x{0600}-\x{06FF}"
PAGES = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
SIX = """x AS (SELECT session_id, message_id, min(timestamp) AS ts, min(user_message) AS q FROM session_messages WHERE session_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS c, list(coalesce(q, '')) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM x WINDOW w AS (PARTITION BY session_id ORDER BY ts ASC NULLS LAST, message_id))"""
SCORE = f"""
b AS (SELECT *, coalesce(regexp_matches(lower(answer), 'not found in the documents|does not contain a clear answer|unable to answer|لا تتوفر إجابة'), false) AS not_found,
             list_filter(regexp_extract_all(coalesce(answer, ''), '[\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-zA-Z{AR}]{{3,}}')) AS w FROM b0),
p AS (SELECT *, list_filter(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), lambda q: length(q) > 10) AS ph FROM b),
m AS (SELECT *, CASE WHEN not_found OR t IS NULL THEN 0 ELSE least(5, len(list_distinct(list_filter(ph, lambda q: contains(lower(t), q))))) END AS matched FROM p),
pr AS (SELECT *, CASE WHEN matched = 0 OR len(ph) = 0 THEN 0.0 ELSE round(matched / len(ph), 2) END AS phrase_ratio FROM m),
j AS (SELECT *, CASE WHEN method NOT IN ('generative', 'cached') THEN 'SKIP' WHEN phrase_ratio >= 0.5 THEN 'GROUNDED' WHEN phrase_ratio > 0 THEN 'PARTIAL' ELSE 'UNGROUNDED' END AS judge FROM pr),
v AS (SELECT *, CASE WHEN timed_out THEN 'FAIL' WHEN method = 'out_of_scope' AND category = 'out_of_scope' THEN 'EXPECTED_SKIP' WHEN method = 'not_found' OR not_found THEN 'FAIL' WHEN method IN ('generative', 'cached') THEN 'SUCCESS' ELSE 'FAIL' END AS retrieval,
   CASE WHEN timed_out THEN 'TIMEOUT' WHEN expected = 'out_of_scope' THEN CASE WHEN method = 'out_of_scope' THEN 'CORRECT' ELSE 'WRONG' END
        WHEN expected IN ('not_found', 'trick') THEN CASE WHEN method = 'not_found' OR not_found THEN 'CORRECT' ELSE 'HALLUCINATED' END
        WHEN method = 'out_of_scope' THEN 'WRONG' WHEN method = 'not_found' OR not_found THEN 'WRONG' WHEN method IN ('generative', 'cached') THEN 'CORRECT' ELSE 'UNKNOWN' END AS method_verdict,
   CASE WHEN timed_out THEN 'TIMEOUT' WHEN errored THEN 'ERROR' WHEN method IN ('out_of_scope', 'not_found') OR not_found THEN 'FAIL' WHEN judge = 'GROUNDED' THEN 'PASS' ELSE 'FAIL' END AS combined FROM j),
runs AS (SELECT *, CASE WHEN method_verdict = 'CORRECT' THEN NULL WHEN method = 'generative' AND (not_found OR judge = 'UNGROUNDED') THEN 'A' WHEN judge = 'PARTIAL' AND top_sim >= 0.72 THEN 'B'
   WHEN method IN ('not_found', 'timeout', 'error', 'unknown') THEN 'C' WHEN method = 'out_of_scope' AND category <> 'out_of_scope' THEN 'C' WHEN top_sim < 0.72 AND top_sim > 0 THEN 'C' END AS bucket FROM v)
"""
RUNS = f"""
x AS (SELECT message_id, min(user_message) AS question, max(assistant_message) AS answer FROM session_messages WHERE message_id IS NOT NULL GROUP BY 1),
s AS (SELECT message_id, string_agg(coalesce(snippet, '') || ' ' || coalesce(document_name, ''), ' ' ORDER BY source_id) AS t, max(similarity) AS top_sim, count(*) AS candidates
      FROM answer_sources GROUP BY 1),
b0 AS (SELECT x.message_id, question, answer, t, CASE WHEN regexp_matches(question, '[{AR}]') THEN 'arabic' ELSE 'regulatory' END AS category, 'correct' AS expected,
             CASE WHEN candidates IS NULL THEN 'not_found' ELSE 'generative' END AS method, coalesce(top_sim, 0.0) AS top_sim, coalesce(candidates, 0) AS candidates, false AS timed_out, false AS errored
      FROM x LEFT JOIN s USING (message_id) WHERE question IS NOT NULL AND answer IS NOT NULL), {SCORE}"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", "text")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return E.evaluation_runs(read(spark, d, "session_messages"), read(spark, d, "answer_sources"), SETTINGS)


# Text of pages.


@query(f"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM {PAGES})
SELECT doc_id, {STRIP(f"array_to_string(list_filter(string_split(t, chr(10)), lambda l: NOT regexp_full_match({STRIP('l')}, '[^\\pL\\pN\\pM_{AR}]{{1,3}}')), chr(10))")} AS cleaned FROM c""")
def clean_text(spark, d):
    return _pages(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens FROM {PAGES}")
def approx_tokens(spark, d):
    return _pages(spark, d).select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query(f"""
WITH r AS (SELECT doc_id, length(regexp_replace(text, '[^{AR}]', '', 'g')) / greatest(length(text), 1) AS share, regexp_matches(text, '[{AR}]') AS has FROM {PAGES})
SELECT doc_id, CASE WHEN share > 0.25 THEN 'ar' ELSE 'en' END AS page_language, share > 0.3 AS is_arabic, has AS looks_arabic FROM r""")
def lang_detect(spark, d):
    c = F.col("text")
    return _pages(spark, d).select("doc_id", T.page_language(c).alias("page_language"), T.is_arabic(c).alias("is_arabic"), T.looks_arabic(c).alias("looks_arabic"))


SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟\\n]){WS}+', '\\1' || chr(57344), 'g'), chr(57344)), lambda s: {STRIP('s')}), lambda s: length(s) > 10)"


@query(f"SELECT doc_id, len({SENTENCES}) AS sentences, coalesce(list_sum(list_transform({SENTENCES}, lambda s: length(s))), 0)::BIGINT AS chars FROM {PAGES}")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    total = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return _pages(spark, d).select("doc_id", F.size(s).cast("bigint").alias("sentences"), total.alias("chars"))


@query(f"""
WITH l AS (SELECT doc_id, i, {STRIP('string_split(text, chr(10))[i]')} AS x FROM {PAGES}, range(1, 16) t(i) WHERE i <= len(string_split(text, chr(10)))),
r AS (SELECT doc_id, i, x, string_split_regex(x, '{WS}+') AS w,
   CASE WHEN length(x) < 3 THEN 9 WHEN upper(x) = x AND lower(x) <> x AND length(x) BETWEEN 6 AND 80 THEN 0
        WHEN regexp_matches(x, '(?i)^((\\d+\\.)+\\s+[\\pL\\pN_]|(article|section|chapter)\\s+\\d+)') THEN 1
        WHEN length(x) <= 60 AND regexp_matches(x, '^\\p{{Lu}}') AND NOT ends_with(x, '.') AND len(string_split_regex(x, '{WS}+')) >= 2
             AND len(list_filter(string_split_regex(x, '{WS}+'), lambda y: regexp_matches(y, '^\\p{{Lu}}'))) >= 0.7 * len(string_split_regex(x, '{WS}+')) THEN 2 ELSE 9 END AS k FROM l)
SELECT doc_id, substr(arg_min(x, k * 100 + i), 1, 120) AS title FROM r WHERE k < 9 GROUP BY doc_id""")
def section_title(spark, d):
    return _pages(spark, d).select("doc_id", T.section_title(F.col("text")).alias("title")).where("title is not null")



FOLD = f"""
fs AS (SELECT document_name, doc_id AS page, text, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟\\n]){WS}+', '\\1' || chr(57344), 'g'), '\\n{{2,}}', chr(57344), 'g'), chr(57344)), lambda x: {STRIP('x')}), lambda x: length(x) > 10) AS s
       FROM documents WHERE text IS NOT NULL AND length({STRIP('text')}) >= 30),
w(document_name, page, s, i, now, total, content, tokens) AS (
  SELECT document_name, page, s, 0, []::VARCHAR[], 0::BIGINT, NULL::VARCHAR, NULL::BIGINT FROM fs
  UNION ALL
  SELECT document_name, page, s, i + 1, CASE WHEN flush THEN now[-3:] ELSE now END || CASE WHEN i < len(s) THEN [s[i + 1]] ELSE [] END,
         CASE WHEN flush THEN coalesce(list_sum(list_transform(now[-3:], lambda x: greatest(1, length(x) // 4)))::BIGINT, 0) ELSE total END + t,
         CASE WHEN flush THEN array_to_string(now, ' ') END, CASE WHEN flush THEN total END
  FROM (SELECT *, i = len(s) OR total + t > 400 AND len(now) > 0 AS flush FROM (SELECT *, CASE WHEN i < len(s) THEN greatest(1, length(s[i + 1]) // 4) ELSE 0 END AS t FROM w) WHERE i <= len(s))),
folded AS (SELECT document_name, page, content, tokens AS token_count, row_number() OVER (PARTITION BY document_name, page ORDER BY i)::INT AS chunk_no,
        CASE WHEN length(regexp_replace(content, '[^{AR}]', '', 'g')) / greatest(length(content), 1) > 0.25 THEN 'ar' ELSE 'en' END AS language FROM w WHERE length(content) >= 80)
"""


@query(f"WITH RECURSIVE {FOLD} SELECT document_name, page AS page_start, chunk_no, content, token_count::INT AS token_count, language FROM folded")
def chunk_fold(spark, d):
    return _chunks(spark, d).select("document_name", "page_start", "chunk_no", "content", "token_count", "language")


def _chunks(spark, d):
    pages = read(spark, d, "documents").select("document_name", F.col("doc_id").alias("page"), "text").where("text is not null")
    return I.chunk_pages(pages, SETTINGS)


@query(f"WITH RECURSIVE {FOLD} SELECT language, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, max(token_count)::INT AS largest FROM folded GROUP BY 1")
def chunk_totals(spark, d):
    return _chunks(spark, d).groupBy("language").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))


@query(f"""WITH RECURSIVE {FOLD}, n AS (SELECT document_name, count(*) AS pages, min(source) AS source_type FROM documents WHERE document_name IS NOT NULL GROUP BY 1)
SELECT document_name, source_type, CASE WHEN c IS NULL THEN 'no_text' ELSE 'ok' END AS status, pages, coalesce(c, 0) AS chunks FROM n LEFT JOIN (SELECT document_name, count(*) AS c FROM folded GROUP BY 1) f USING (document_name)""")
def cli_ingest(spark, d):
    """The command's work, into new tables, on uncleaned pages; twice, so that the second run finds all there and adds nothing."""
    from docspark.cli import ingest
    from docspark.session import new_path

    pages = read(spark, d, "documents").select("document_name", F.col("doc_id").alias("page"), "text", F.col("source").alias("source_type"))
    chunks, registry = new_path(spark, "cli-chunks"), new_path(spark, "cli-registry")
    done = ingest(spark, pages, chunks, registry, clean=False)
    ingest(spark, pages, chunks, registry, clean=False)
    there = spark.read.parquet(chunks).groupBy("document_name").agg(F.count("*").alias("chunks"))
    return done.drop("chunks").join(there, "document_name", "left").select("document_name", "source_type", "status", "pages", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def _candidates(spark, d):
    """Three extractions of each page: as it is, in lower case without paragraphs, and its first half."""
    p = _pages(spark, d).where("text <> ''").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), "text")
    forms = F.array(
        F.struct(F.lit("plain").alias("extractor"), F.lit(0).alias("extractor_ord"), F.col("text").alias("text")),
        F.struct(F.lit("flat").alias("extractor"), F.lit(1).alias("extractor_ord"), F.regexp_replace(F.lower("text"), "\\n+", " ").alias("text")),
        F.struct(F.lit("half").alias("extractor"), F.lit(2).alias("extractor_ord"), F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))").alias("text")),
    )
    return p.select("doc", "page", F.explode(forms).alias("x")).select("doc", "page", "x.*")


SCORES = f"""
c AS (SELECT doc_id AS doc, 'plain' AS extractor, 0 AS extractor_ord, text FROM {PAGES} WHERE text <> ''
      UNION ALL SELECT doc_id, 'flat', 1, regexp_replace(lower(text), '\\n+', ' ', 'g') FROM {PAGES} WHERE text <> ''
      UNION ALL SELECT doc_id, 'half', 2, substr(text, 1, length(text) // 2) FROM {PAGES} WHERE text <> ''),
f AS (SELECT *, regexp_extract_all(lower(text), '[\\pL\\pN_]+') AS w, length(text) AS chars,
      length(regexp_replace(text, '[\\x{{00}}-\\x{{08}}\\x{{0b}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\p{{Cf}}\\p{{Co}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', '', 'g')) AS printable FROM c WHERE length(text) > 0),
s AS (SELECT doc, extractor, extractor_ord, chars, round(CASE WHEN len(w) >= 10 THEN len(list_distinct(w)) / len(w) ELSE 0.3 END * 25
      + CASE WHEN contains(text, chr(10) || chr(10)) THEN 20 ELSE 0 END + printable / chars * 15 + chars / max(chars) OVER (PARTITION BY doc) * 40, 4) AS score FROM f)
"""


@query(f"WITH {SCORES} SELECT doc, extractor, extractor_ord, chars, score FROM s")
def extract_score(spark, d):
    return I.extraction_scores(_candidates(spark, d))


@query(f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS s2, lead(extractor) OVER w AS e2 FROM s WINDOW w AS (PARTITION BY doc ORDER BY score DESC, extractor_ord))
SELECT doc, extractor, score, CASE WHEN score - s2 <= 5 THEN e2 END AS runner_up FROM r WHERE n = 1""")
def extract_winner(spark, d):
    return I.extraction_winner(I.extraction_scores(_candidates(spark, d)))


# Loading.


@query("""SELECT DISTINCT document_name FROM documents WHERE document_name IS NOT NULL AND document_name NOT IN
 (SELECT r.document_name FROM doc_registry r JOIN sama_nora_chunks c USING (document_name) WHERE r.document_name IS NOT NULL)""")
def ingest_antijoin(spark, d):
    names = read(spark, d, "documents").where("document_name is not null").select("document_name").distinct()
    return I.not_ingested(names, read(spark, d, "doc_registry"), read(spark, d, "sama_nora_chunks"))


@query("""
WITH n AS (SELECT document_name, count(*) AS pages, coalesce(min(source), '?') AS source_type FROM documents WHERE document_name IS NOT NULL GROUP BY 1),
c AS (SELECT document_name, count(*) AS chunks FROM sama_nora_chunks GROUP BY 1),
r AS (SELECT source_type, pages, coalesce(chunks, 0) AS chunks, CASE WHEN chunks IS NULL THEN 'no_text' WHEN document_name IN (SELECT document_name FROM doc_registry) THEN 'skipped' ELSE 'ok' END AS status FROM n LEFT JOIN c USING (document_name))
SELECT source_type, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status NOT IN ('ok', 'skipped')) AS failed,
 coalesce(sum(pages) FILTER (status = 'ok'), 0)::BIGINT AS pages, coalesce(sum(chunks) FILTER (status = 'ok'), 0)::BIGINT AS chunks FROM r GROUP BY 1""")
def ingest_summary(spark, d):
    names = read(spark, d, "documents").where("document_name is not null").groupBy("document_name").agg(F.count("*").alias("pages"), F.coalesce(F.min("source"), F.lit("?")).alias("source_type"))
    chunks = read(spark, d, "sama_nora_chunks").groupBy("document_name").agg(F.count("*").alias("chunks"))
    known = read(spark, d, "doc_registry").select("document_name").distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("chunks").isNull(), "no_text").when(F.col("known"), "skipped").otherwise("ok")
    results = names.join(chunks, "document_name", "left").join(known, "document_name", "left").select("source_type", status.alias("status"), "pages", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    return I.ingest_summary(results)


@query("""SELECT document_name, min(source_type) AS source_type FROM (SELECT document_name, coalesce(source, '?') AS source_type FROM documents WHERE document_name IS NOT NULL)
 WHERE document_name NOT IN (SELECT document_name FROM doc_registry WHERE document_name IS NOT NULL AND upper(source_type) = 'CSB') GROUP BY 1""")
def upsert_new(spark, d):
    """Documents that one source has not registered."""
    incoming = read(spark, d, "documents").where("document_name is not null").select("document_name", F.coalesce("source", F.lit("?")).alias("source_type"))
    return I.new_rows(incoming, read(spark, d, "doc_registry").where("document_name is not null and upper(source_type) = 'CSB'"), "document_name")


@query("""WITH i AS (SELECT session_id, min(user_id) AS user_id FROM session_messages WHERE session_id IS NOT NULL GROUP BY 1),
e AS (SELECT session_id, min(user_id) AS user_id FROM chat_sessions WHERE session_id IS NOT NULL GROUP BY 1)
SELECT * FROM i UNION ALL SELECT * FROM e WHERE session_id NOT IN (SELECT session_id FROM i)""")
def upsert_sessions(spark, d):
    one = lambda t: read(spark, d, t).where("session_id is not null").groupBy("session_id").agg(F.min("user_id").alias("user_id"))
    return I.upsert(one("chat_sessions"), one("session_messages"), "session_id")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 25 + 1 AS INT) AS batch FROM documents")
def batch_scan(spark, d):
    return I.batches(read(spark, d, "documents").select("doc_id"), "doc_id", 25)


# Search.


def _vectors(spark, d, k=20, floor=None):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    return R.vector_topk(rows.where("vec_id % 100 = 0"), rows, k, floor)


PAIRS = """p AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)"""
TOP = f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM p)"


@query(f"{TOP} SELECT query_id, id, round(s, 4) AS similarity, rank::INT AS rank FROM t WHERE rank <= 20")
def vector_topk(spark, d):
    return _vectors(spark, d).select("query_id", "id", F.round("similarity", 4).alias("similarity"), "rank")


@query(f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank FROM p WHERE s > 0.2) SELECT query_id, id, round(s, 4) AS similarity FROM t WHERE rank <= 20")
def vector_floor(spark, d):
    return _vectors(spark, d, floor=0.2).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


@query(f"{TOP} SELECT query_id, threshold, count(*) FILTER (s >= threshold) AS hits FROM t, (SELECT unnest([0.79, 0.75, 0.72, 0.70, 0.65, 0.60])::DOUBLE AS threshold) WHERE rank <= 20 GROUP BY ALL")
def threshold_sweep(spark, d):
    return R.threshold_sweep(_vectors(spark, d))


@query(f"{TOP}, b AS (SELECT query_id, round(max(s), 4) AS top_similarity FROM t WHERE id <> query_id GROUP BY 1) SELECT *, CASE WHEN top_similarity >= 0.72 THEN 'pass' WHEN top_similarity >= 0.7 THEN 'close' WHEN top_similarity >= 0.5 THEN 'far' ELSE 'very far' END AS verdict FROM b")
def retrieval_verdict(spark, d):
    return R.verdict(_vectors(spark, d).where("id <> query_id"))


@query(f"{TOP} SELECT query_id, id, CASE WHEN s < 0.3 THEN 'weak' WHEN s < 0.6 THEN 'fair' ELSE 'ok' END AS health FROM t WHERE rank <= 20")
def similarity_health(spark, d):
    return R.similarity_health(_vectors(spark, d))


def _cache(spark, d, mode):
    rows = read(spark, d, "embeddings").select("vec_id", "embedding")
    entries = rows.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("entry_id"), "embedding")
    return R.cache_lookup(rows.where("vec_id % 100 = 0"), entries, mode, Settings(cache_similarity=0.3))


CACHED = f"WITH {PAIRS}, h AS (SELECT query_id, id AS entry_id, round(s, 9) AS s FROM p WHERE id % 100 <> 0 AND round(s, 9) >= 0.3)"


@query(f"{CACHED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entry_id) AS n FROM h) SELECT query_id, entry_id, round(s, 4) AS similarity FROM o WHERE n = 1")
def semantic_cache_best(spark, d):
    return _cache(spark, d, "best")


@query(f"{CACHED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY entry_id) AS n FROM h) SELECT query_id, entry_id, round(s, 4) AS similarity FROM o WHERE n = 1")
def semantic_cache_first(spark, d):
    return _cache(spark, d, "first")


KEYWORD = """
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(question), '[\\pL\\pN]+'))) AS term FROM eval_items WHERE item_id % 100 = 0),
r AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS w FROM documents WHERE text IS NOT NULL),
z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM r),
tp AS (SELECT id, len(w) AS len, unnest(w) AS term FROM r),
po AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM tp WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM po JOIN df USING (term) JOIN q USING (term), z GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
"""


def _keyword(spark, d):
    asked = read(spark, d, "eval_items").where("item_id % 100 = 0").select("item_id", "question")
    return R.keyword_topk(asked, read(spark, d, "documents").select("doc_id", "text"), SETTINGS.fetch_k)


@query(f"WITH {KEYWORD} SELECT query_id, id, score, rank::INT AS rank FROM kw WHERE rank <= 20")
def keyword_topk(spark, d):
    return _keyword(spark, d)


def _library(spark, d):
    """The chunks with vectors of their contents, made by the default model, which also makes those of the questions."""
    chunks = read(spark, d, "sama_nora_chunks").select("id", "document_name", "page_start", "page_end", "section_title", "content")
    return embed(chunks, "content", kind="array<double>")


def _hybrid(spark, d):
    """Vector and keyword hits of the same chunks for the questions whose number is divisible by 100."""
    asked = embed(read(spark, d, "eval_items").where("item_id % 100 = 0").select("item_id", "question"), "question", prefix="query: ", kind="array<double>")
    chunks = _library(spark, d)
    near = R.vector_topk(asked.select("item_id", "embedding"), chunks.select("id", "embedding"), SETTINGS.fetch_k, SETTINGS.similarity_floor)
    words = R.keyword_topk(asked.select("item_id", "question"), chunks.select("id", "content"), SETTINGS.fetch_k)
    return R.hybrid_merge(near, words, SETTINGS)


def hashed(name, table, key, text, prefix):
    """SQL of the default embedder: {name}p(id, p, v), the places that aren't zero, and {name}n(id, n), the lengths."""
    return f"""
{name}w AS (SELECT {key} AS id, unnest(regexp_extract_all(lower('{prefix}' || {text}), '[\\pL\\pN]+')) AS w FROM {table} WHERE {text} IS NOT NULL),
{name}p AS (SELECT id, ('0x' || substr(md5(w), 1, 4))::INT % 64 AS p, sum(CASE WHEN substr(md5(w), 5, 1) < '8' THEN 1 ELSE -1 END) AS v FROM {name}w GROUP BY 1, 2),
{name}n AS (SELECT id, sqrt(sum(v * v)) AS n FROM {name}p GROUP BY 1 HAVING sum(v * v) > 0)"""


def searched(asked, query, terms):
    """SQL of the hybrid search over the chunks: ``asked`` has an id, a text for vectors and one for words; gives the hits
    h(query_id, id, similarity, source, place) and the guard's figures g."""
    return f"""{hashed('q', asked, 'id', query, 'query: ')}, {hashed('c', 'sama_nora_chunks', 'id', 'content', 'passage: ')},
sim AS (SELECT q.id AS query_id, c.id, round(sum(q.v * c.v) / any_value(qn.n) / any_value(cn.n), 9) AS s FROM qp q JOIN qn ON qn.id = q.id JOIN cp c USING (p) JOIN cn ON cn.id = c.id GROUP BY 1, 2),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM sim WHERE s > 0.5),
qt AS (SELECT id AS query_id, unnest(list_distinct(regexp_extract_all(lower({terms}), '[\\pL\\pN]+'))) AS term FROM {asked}),
r AS (SELECT id, regexp_extract_all(lower(content), '[\\pL\\pN]+') AS w FROM sama_nora_chunks WHERE content IS NOT NULL),
z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM r),
tp AS (SELECT id, len(w) AS len, unnest(w) AS term FROM r),
po AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM tp WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score FROM po JOIN df USING (term) JOIN qt USING (term), z GROUP BY 1, 2),
kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc),
u AS (SELECT query_id, id, s AS similarity, 0 AS source, rank FROM near WHERE rank <= 20 UNION ALL SELECT query_id, id, 0.75, 1, rank FROM kw WHERE rank <= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY source, rank) AS n FROM u),
h AS (SELECT query_id, id, similarity, source, row_number() OVER (PARTITION BY query_id ORDER BY source, rank) AS place FROM k WHERE n = 1),
g AS (SELECT query_id, count(*) AS candidates, round(max(similarity), 4) AS top_similarity FROM h GROUP BY 1)"""


HYBRID = f"WITH a AS (SELECT item_id AS id, question FROM eval_items WHERE item_id % 100 = 0), {searched('a', 'question', 'question')}"


@query(f"{HYBRID} SELECT query_id, id, round(similarity, 4) AS similarity, source::INT AS source, place::INT AS place FROM h")
def hybrid_merge(spark, d):
    return _hybrid(spark, d).withColumn("similarity", F.round("similarity", 4))


@query(f"{HYBRID} SELECT *, CASE WHEN top_similarity < 0.72 THEN 'not_found' ELSE 'generative' END AS method FROM g")
def confidence_guard(spark, d):
    return R.confidence_guard(_hybrid(spark, d), SETTINGS)


@query(f"""WITH {KEYWORD}, c AS (SELECT query_id, id, rank FROM kw WHERE rank <= 20),
qq AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(question), '[\\pL\\pN]+')) AS w FROM eval_items),
f AS (SELECT query_id, id, rank, round(len(list_intersect(qq.w, r.w)) / greatest(len(qq.w), 1), 4) AS score FROM c JOIN qq USING (query_id) JOIN r USING (id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS final_rank FROM f)
SELECT query_id, id, score, final_rank::INT AS final_rank FROM o WHERE final_rank <= 8""")
def rerank(spark, d):
    asked = read(spark, d, "eval_items").select("item_id", "question")
    hits = _keyword(spark, d).select("query_id", "id", F.col("rank").alias("place"))
    return R.rerank(hits, asked, read(spark, d, "documents").select("doc_id", "text"), 0, SETTINGS).select("query_id", "id", "score", "final_rank")


# Guards.


def _questions(spark, d):
    return read(spark, d, "session_messages").where("message_id is not null").groupBy("message_id").agg(F.min("user_message").alias("question"))


EDGE = "[^\\pL\\pN_]"
_FIRE = " ".join(
    f"|| CASE WHEN {f'''regexp_matches(lower(question), '(^|{EDGE}){k.lower()}($|{EDGE})')''' if len(k) <= 20 and k != 'C+' else f'''regexp_matches(lower(question), '(^|{EDGE})c[+][\\pL\\pN_]')''' if k == 'C+' else f'''contains(lower(question), '{k.lower()}')'''} THEN ' {v}' ELSE '' END"
    for k, v in SETTINGS.rules
)
QS = "q AS (SELECT message_id, min(user_message) AS question FROM session_messages WHERE message_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {QS} SELECT message_id, question {_FIRE} AS expanded FROM q WHERE question IS NOT NULL")
def query_expand(spark, d):
    return _questions(spark, d).where("question is not null").select("message_id", G.expand(F.col("question"), SETTINGS).alias("expanded"))


@query(f"WITH {QS} SELECT message_id, regexp_matches(lower(question), '(^|{EDGE})(weather|recipes?|football|whistleblowing|جدول الرسوم)($|{EDGE})') AS rejected FROM q WHERE question IS NOT NULL")
def scope_guard(spark, d):
    return _questions(spark, d).where("question is not null").select("message_id", G.out_of_scope(F.col("question"), SETTINGS).alias("rejected"))


@query(f"WITH {QS} SELECT message_id, contains(lower(trim(question)), 'fee schedule') AND (lower(trim(question)) = 'fee schedule' OR regexp_matches(lower(trim(question)), 'what must|define|ما هو|ما هي')) AS canned FROM q WHERE question IS NOT NULL")
def canned_guard(spark, d):
    return _questions(spark, d).where("question is not null").select("message_id", G.canned(F.col("question"), "fee schedule", ("what must", "define", "ما هو", "ما هي")).alias("canned"))


CANNED = "contains(lower(trim(question)), 'reporting portal') AND (lower(trim(question)) = 'reporting portal' OR regexp_matches(lower(trim(question)), 'what is|define|ما هو|ما هي'))"
SCOPE = f"regexp_matches(lower(question), '(^|{EDGE})(weather|recipes?|football|whistleblowing|جدول الرسوم)($|{EDGE})')"


@query(f"""WITH {QS}, s AS (SELECT message_id, count(*) AS n, max(similarity) AS top FROM answer_sources GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(question) ORDER BY message_id) > 1 AS cached FROM q)
SELECT message_id, CASE WHEN question IS NULL OR {STRIP('question')} = '' THEN 'none' WHEN {CANNED} THEN 'generative' WHEN {SCOPE} THEN 'out_of_scope' WHEN cached THEN 'cached'
 WHEN coalesce(n, 0) = 0 THEN 'not_found' WHEN top < 0.72 THEN 'not_found' ELSE 'generative' END AS method FROM k LEFT JOIN s USING (message_id)""")
def method_lattice(spark, d):
    """Questions asked before count as cached."""
    s = read(spark, d, "answer_sources").groupBy("message_id").agg(F.count("*").alias("n"), F.max("similarity").alias("top"))
    q = _questions(spark, d)
    first = q.groupBy(F.lower("question").alias("low")).agg(F.min("message_id").alias("first"))
    q = q.join(first, F.lower("question") == F.col("low"), "left").withColumn("cached", F.col("first") < F.col("message_id"))
    m = G.method(F.col("question"), F.col("cached"), F.col("n"), F.col("top"), settings=SETTINGS)
    return q.join(s, "message_id", "left").select("message_id", m.alias("method"))


# From questions to answers.

_DONE = f"string_split(regexp_replace(content, '([.!?؟]){WS}+', '\\1' || chr(57344), 'g'), chr(57344))[1:3]"
_SAID = f"array_to_string({_DONE}, ' ') || ' [1]'"
EAST = r"\p{Han}\p{Bopomofo}\p{Hangul}\x{3000}-\x{303f}\x{2e80}-\x{2eff}\x{ff00}-\x{ffef}"
MARKERS = "(?s)(?:Conversation so far:|Context:|Question:|<context>|System:|Human:|User:|Assistant:|Note:).*"
DRIFT = "'in conclusion|where two directors disagree|in general terms'"


def cleaned_output(answer, question):
    """SQL of clean_output."""
    plain = STRIP(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({answer}, '{MARKERS}', ''), '[{EAST}]+', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
    arabic = f"length(regexp_replace(coalesce({question}, ''), '[^{AR}]', '', 'g')) / greatest(length(coalesce({question}, '')), 1) > 0.3"
    kept = STRIP("array_to_string(s[1:n], ' ')")
    return f"""(SELECT CASE WHEN {arabic} OR t = '' THEN c ELSE t END FROM (SELECT c, {kept} AS t FROM (SELECT c, s, least(3, CASE WHEN fd > 0 THEN fd - 1 ELSE len(s) END) AS n FROM
 (SELECT c, s, list_position(list_transform(s, lambda x: regexp_matches(lower(x), {DRIFT})), true) AS fd FROM
  (SELECT c, string_split(regexp_replace(c, '([.!?]){WS}+', '\\1' || chr(57344), 'g'), chr(57344)) AS s FROM (SELECT {plain} AS c))))))"""


def stripped_not_found(answer):
    """SQL of strip_not_found."""
    before = [(p, STRIP(f"substr({answer}, 1, instr({answer}, '{p}') - 1)")) for p in SETTINGS.not_found]
    cases = " ".join(f"WHEN instr({answer}, '{p}') > 0 AND length({head}) > 40 THEN {head}" for p, head in before)
    return f"CASE {cases} ELSE {answer} END"


ANSWERED = f"""
q0 AS (SELECT item_id AS id, {STRIP('question')} AS question FROM eval_items),
q1 AS (SELECT *, CASE WHEN question IS NULL OR question = '' THEN 'none' WHEN {CANNED} THEN 'generative' WHEN {SCOPE} THEN 'out_of_scope' END AS early FROM q0),
q2 AS (SELECT id, question, question {_FIRE} AS expanded FROM q1 WHERE early IS NULL),
{hashed('e', 'q2', 'id', 'expanded', 'query: ')},
ce AS (SELECT item_id AS entry_id, passage AS result FROM eval_items WHERE expected IS NULL),
cf AS (SELECT item_id AS entry_id, question {_FIRE} AS expanded FROM (SELECT item_id, {STRIP('question')} AS question FROM eval_items WHERE expected IS NULL)),
{hashed('x', 'cf', 'entry_id', 'expanded', 'query: ')},
cs AS (SELECT e.id, x.id AS entry_id, round(sum(e.v * x.v) / any_value(en.n) / any_value(xn.n), 9) AS s FROM ep e JOIN en ON en.id = e.id JOIN xp x USING (p) JOIN xn ON xn.id = x.id GROUP BY 1, 2),
hit AS (SELECT id, result FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, entry_id) AS n FROM cs WHERE s >= 0.95) JOIN ce USING (entry_id) WHERE n = 1),
a AS (SELECT * FROM q2 WHERE id NOT IN (SELECT id FROM hit)),
{searched('a', 'expanded', 'expanded')},
qq AS (SELECT id AS query_id, list_distinct(regexp_extract_all(lower(question), '[\\pL\\pN]+')) AS w FROM a),
fk AS (SELECT query_id, id, similarity, place, round(len(list_intersect(qq.w, r.w)) / greatest(len(qq.w), 1), 4) AS score FROM h JOIN g USING (query_id) JOIN qq USING (query_id) JOIN r USING (id) WHERE top_similarity >= 0.72),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS nth FROM fk),
ps AS (SELECT query_id, nth, score, similarity, c.* FROM rk JOIN sama_nora_chunks c USING (id) WHERE nth <= 8),
us AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_name, page_start, page_end ORDER BY nth) AS dup FROM ps),
so AS (SELECT query_id, string_agg(concat(coalesce(document_name, '?'), '|', coalesce(page_start::VARCHAR, '?'), '|', coalesce(page_end::VARCHAR, '?'), '|', (round(similarity, 4) * 10000)::BIGINT), ';' ORDER BY nth) AS sources,
   string_agg(coalesce(substr(content, 1, 1000), '') || ' ' || coalesce(document_name, ''), ' ' ORDER BY nth) AS t, max(score) AS rerank_score FROM us WHERE dup = 1 GROUP BY 1),
sd AS (SELECT query_id, {_SAID} AS said FROM ps WHERE nth = 1),
cl AS (SELECT query_id, sources, t, rerank_score, {cleaned_output('said', 'question')} AS c FROM so JOIN sd USING (query_id) JOIN a ON a.id = query_id),
done AS (
 SELECT id, question, early AS method, CASE early WHEN 'none' THEN 'Please ask a question.' WHEN 'generative' THEN 'The reporting portal is where reports are submitted.' ELSE CASE WHEN length(regexp_replace(question, '[^{AR}]', '', 'g')) / greatest(length(question), 1) > 0.3 THEN 'هذا السؤال خارج نطاق الوثائق.' ELSE 'This question is outside the scope of the documents.' END END AS answer,
   '' AS sources, NULL AS t, 0 AS candidates, NULL AS top_similarity, NULL AS rerank_score FROM q1 WHERE early IS NOT NULL
 UNION ALL SELECT id, question, 'cached', result, '', NULL, 0, NULL, NULL FROM hit JOIN q2 USING (id)
 UNION ALL SELECT a.id, question, 'not_found', 'Not found in the documents.', '', NULL, coalesce(candidates, 0), top_similarity, NULL FROM a LEFT JOIN g ON query_id = a.id WHERE coalesce(top_similarity, 0) < 0.72
 UNION ALL SELECT a.id, question, 'generative', {stripped_not_found('c')}, sources, t, candidates, top_similarity, rerank_score FROM a JOIN cl ON query_id = a.id JOIN g ON g.query_id = a.id)
"""


def _answered(spark, d):
    """The evaluation questions answered from the chunks; those for which nothing is expected have been answered before."""
    from docspark.operators.pipeline import answer_run

    items = read(spark, d, "eval_items")
    old = items.where("expected is null").select(F.col("item_id").alias("entry_id"), G.expand(T.strip(F.col("question")), SETTINGS).alias("asked"), F.col("passage").alias("result"))
    cache = embed(old, "asked", prefix="query: ", kind="array<double>")
    return answer_run(items.select(F.col("item_id").alias("id"), "question"), _library(spark, d), cache, settings=SETTINGS)


@query(f"WITH {ANSWERED} SELECT id, method, answer, sources, candidates, top_similarity, rerank_score FROM done")
def answer_run(spark, d):
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    line = lambda x: F.concat_ws("|", text(x["document_name"]), text(x["page_start"]), text(x["page_end"]), F.round(x["similarity"] * 10000).cast("bigint").cast("string"))
    return _answered(spark, d).select("id", "method", "answer", F.array_join(F.transform("sources", line), ";").alias("sources"), "candidates", "top_similarity", "rerank_score")


@query(f"WITH {ANSWERED} SELECT count(*) AS kept, count(DISTINCT question) AS questions FROM done WHERE method = 'generative' AND sources <> '' AND NOT regexp_matches(lower(answer), 'not found in the documents|does not contain a clear answer|unable to answer|لا تتوفر إجابة')")
def cacheable_answers(spark, d):
    from docspark.operators.pipeline import cacheable

    return cacheable(_answered(spark, d), SETTINGS).agg(F.count("*").alias("kept"), F.countDistinct("entry_id").alias("questions"))


# Answers and sources.

DEDUP = """k AS (SELECT *, row_number() OVER (PARTITION BY message_id, document_name, page_start, page_end ORDER BY similarity DESC NULLS LAST, source_id) AS n FROM answer_sources),
o AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY similarity DESC NULLS LAST, source_id) AS nth FROM k WHERE n = 1)"""


@query(f"WITH {DEDUP} SELECT message_id, nth::INT AS nth, source_id, document_name, page_start, page_end, section_title, round(similarity, 4) AS similarity, substr(snippet, 1, 1000) AS snippet FROM o")
def source_dedup(spark, d):
    return A.dedup_sources(read(spark, d, "answer_sources"), SETTINGS)


@query(f"""WITH {DEDUP} SELECT message_id, string_agg('[Passage ' || nth || '] (' || coalesce(document_name, '?') || ', Pages ' || coalesce(page_start::VARCHAR, '?') || '-' || coalesce(page_end::VARCHAR, '?')
 || CASE WHEN coalesce(section_title, '') <> '' THEN ', ' || section_title ELSE '' END || ')' || chr(10) || coalesce(substr(snippet, 1, 1000), ''), chr(10) || chr(10) ORDER BY nth) AS context FROM o GROUP BY 1""")
def context_build(spark, d):
    return A.context(A.dedup_sources(read(spark, d, "answer_sources"), SETTINGS))


@query("SELECT source_id, substr(snippet, 1, 300) AS snippet, CASE WHEN round(similarity * 100) >= 85 THEN 'high' WHEN round(similarity * 100) >= 70 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN page_end IS NOT NULL AND page_end <> page_start THEN 'p. ' || page_start || '–' || page_end ELSE 'p. ' || page_start END AS pages FROM answer_sources")
def source_cards(spark, d):
    return read(spark, d, "answer_sources").select(
        "source_id", T.snippet(F.col("snippet"), SETTINGS.stream_snippet_chars).alias("snippet"), T.similarity_tier(F.col("similarity")).alias("tier"), T.page_label(F.col("page_start"), F.col("page_end")).alias("pages")
    )


def _answers(spark, d):
    return read(spark, d, "session_messages").where("message_id is not null and assistant_message is not null").groupBy("message_id").agg(F.max("assistant_message").alias("answer"), F.min("user_message").alias("question"))


ANS = "a AS (SELECT message_id, max(assistant_message) AS answer, min(user_message) AS question FROM session_messages WHERE message_id IS NOT NULL AND assistant_message IS NOT NULL GROUP BY 1)"


@query(f"""WITH {ANS}, p AS (SELECT message_id, string_split(answer, ' ') AS w FROM a), t AS (SELECT message_id, unnest(range(len(w) + 2)) AS i, w FROM p),
{DEDUP}, so AS (SELECT message_id, list(document_name ORDER BY nth) AS names, list(substr(coalesce(snippet, ''), 1, 300) ORDER BY nth) AS snippets FROM o GROUP BY 1)
SELECT message_id, i::INT AS seq, CASE WHEN i < len(w) THEN 'token' WHEN i = len(w) THEN 'sources' ELSE 'done' END AS type, CASE WHEN i < len(w) - 1 THEN w[i + 1] || ' ' WHEN i = len(w) - 1 THEN w[i + 1] END AS text,
 CASE WHEN i = len(w) THEN coalesce(names, []) END AS names, CASE WHEN i = len(w) THEN coalesce(snippets, []) END AS snippets FROM t LEFT JOIN so USING (message_id)""")
def stream_events(spark, d):
    """The events of every answer, written as lines and read again."""
    from docspark.session import new_path
    from docspark.sources.io import read_ndjson, write_ndjson

    one = F.struct("document_name", "page_start", "page_end", "section_title", "similarity", "snippet")
    cited = A.dedup_sources(read(spark, d, "answer_sources"), SETTINGS).groupBy("message_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", one.alias("s")))), lambda x: x["s"]).alias("sources"))
    events = A.stream_events(_answers(spark, d).join(cited, "message_id", "left"), SETTINGS)
    path = new_path(spark, "events")
    write_ndjson(events.select(F.to_json(F.struct(F.col("message_id").alias("message"), "seq", "event")).alias("line")), path, "line")
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    from docspark.schemas import STREAM_EVENTS

    lines = read_ndjson(spark, path, StructType([StructField("message", StringType()), StructField("seq", IntegerType()), StructField("event", StringType())]))
    x = lines.select("message", "seq", F.from_json("event", STREAM_EVENTS).alias("x"))
    return x.select(F.col("message").alias("message_id"), "seq", "x.type", "x.text", F.col("x.sources.document_name").alias("names"), F.col("x.sources.snippet").alias("snippets"))


@query(f"WITH {ANS} SELECT message_id, {stripped_not_found('answer')} AS answer FROM a")
def strip_not_found(spark, d):
    return _answers(spark, d).select("message_id", T.strip_not_found(F.col("answer"), SETTINGS).alias("answer"))


@query(f"""WITH {ANS}, p AS (SELECT message_id, answer, string_split(regexp_replace({STRIP('answer')}, '([.!?]){WS}+', '\\1' || chr(57344), 'g'), chr(57344)) AS s FROM a),
f AS (SELECT *, list_position(list_transform(s, lambda x: regexp_matches(lower(x), {DRIFT})), true) AS fd FROM p),
n AS (SELECT *, least(3, CASE WHEN fd > 0 THEN fd - 1 ELSE len(s) END) AS n FROM f)
SELECT message_id, CASE WHEN n > 0 THEN {STRIP("array_to_string(s[1:n], ' ')")} ELSE answer END AS answer FROM n""")
def drift_truncate(spark, d):
    return _answers(spark, d).select("message_id", T.truncate_at_drift(F.col("answer"), SETTINGS).alias("answer"))


@query(f"WITH {ANS} SELECT message_id, {cleaned_output('answer', 'question')} AS answer FROM a")
def clean_output(spark, d):
    return _answers(spark, d).select("message_id", T.clean_output(F.col("answer"), F.col("question"), SETTINGS).alias("answer"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '[{EAST}]+', '', 'g')) AS kept FROM documents WHERE text IS NOT NULL")
def cjk_clean(spark, d):
    return _pages(spark, d).select("doc_id", F.md5(T.without_east_asian(F.col("text"))).alias("kept"))


@query(f"""WITH {ANS}, {DEDUP}, l AS (SELECT message_id, string_agg(format('  {{}}. {{}}, pages {{}}-{{}}, similarity {{}}', nth, coalesce(document_name, '?'), coalesce(page_start::VARCHAR, '?'), coalesce(page_end::VARCHAR, '?'),
 coalesce(printf('%.4f', round(similarity, 4)), '?')), chr(10) ORDER BY nth) AS lines FROM o GROUP BY 1)
SELECT message_id, 'Question: ' || coalesce(question, '') || chr(10) || 'Answer: ' || {STRIP('answer')} || chr(10) || 'Sources:' || chr(10) || coalesce(lines, '  none') AS report FROM a LEFT JOIN l USING (message_id)""")
def answer_display(spark, d):
    return A.display(_answers(spark, d), A.dedup_sources(read(spark, d, "answer_sources"), SETTINGS))


@query(f"""WITH {DEDUP}, f AS (SELECT message_id, coalesce(substr(snippet, 1, 1000), '') AS content FROM o WHERE nth = 1) SELECT message_id, {_SAID} AS answer FROM f""")
def extractive_answers(spark, d):
    return A.context(A.dedup_sources(read(spark, d, "answer_sources"), SETTINGS)).select("message_id", extractive_answer(F.col("context")).alias("answer"))


@query(f"""WITH {ANS}, {DEDUP}, c AS (SELECT message_id, string_agg('[Passage ' || nth || '] (' || coalesce(document_name, '?') || ', Pages ' || coalesce(page_start::VARCHAR, '?') || '-' || coalesce(page_end::VARCHAR, '?')
 || CASE WHEN coalesce(section_title, '') <> '' THEN ', ' || section_title ELSE '' END || ')' || chr(10) || coalesce(substr(snippet, 1, 1000), ''), chr(10) || chr(10) ORDER BY nth) AS context FROM o GROUP BY 1),
{SIX}, m AS (SELECT message_id, any_value(substr(array_to_string(l, ' | '), 1, 480)) AS summary FROM n WHERE c % 6 = 0 GROUP BY 1)
SELECT message_id, CASE WHEN coalesce(summary, '') <> '' THEN 'Conversation so far:' || chr(10) || summary || chr(10) || chr(10) ELSE '' END || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || question || chr(10)
 || CASE WHEN length(regexp_replace(question, '[^{AR}]', '', 'g')) / greatest(length(question), 1) > 0.3 THEN 'أجب بالعربية من المقاطع فقط.' ELSE 'Answer from the passages only.' END AS prompt
FROM a JOIN c USING (message_id) LEFT JOIN m USING (message_id) WHERE question IS NOT NULL""")
def prompts(spark, d):
    """What a generator is given, with the rolling summary where one is due."""
    from docspark.models import summary

    texts = A.context(A.dedup_sources(read(spark, d, "answer_sources"), SETTINGS))
    due = S.summary_triggers(read(spark, d, "session_messages"), SETTINGS).groupBy("message_id").agg(F.min(summary(F.col("last_questions"))).alias("summary"))
    rows = _answers(spark, d).where("question is not null").join(texts, "message_id").join(due, "message_id", "left")
    return rows.select("message_id", A.prompt(F.col("question"), F.col("context"), F.col("summary"), SETTINGS).alias("prompt"))


@query(f"""WITH {hashed('e', 'eval_items', 'item_id', 'question', 'passage: ')} SELECT id AS item_id, p::INT AS place, round(v / n, 9) AS value FROM ep JOIN en USING (id) WHERE v <> 0""")
def hashed_embeddings(spark, d):
    vectors = embed(read(spark, d, "eval_items"), "question", kind="array<double>")
    return vectors.select("item_id", F.posexplode("embedding").alias("place", "value")).where("value <> 0").withColumn("value", F.round("value", 9))


@query(f"SELECT id, list_transform(['What is required under ', 'Who is responsible for ', 'When does one have to comply with '], lambda h: h || coalesce(section_title, 'this section') || '?') || list_transform(['ما المطلوب بموجب ', 'من المسؤول عن ', 'متى يجب الالتزام بـ '], lambda h: h || coalesce(section_title, 'هذا القسم') || '؟') AS questions FROM sama_nora_chunks")
def question_templates(spark, d):
    title = F.col("section_title")
    return read(spark, d, "sama_nora_chunks").select("id", F.concat(template_questions(title), template_questions(title, "ar")).alias("questions"))


@query(f"SELECT message_id, {STRIP(f'''regexp_replace({SQUEEZE('question')}, '^[0-9]+[.)]{WS}*', '')''')} AS question FROM (SELECT message_id, i || CASE WHEN i % 2 = 0 THEN '. ' ELSE ')' END || question AS question FROM (SELECT message_id, question, length(question) % 7 AS i FROM (SELECT message_id, min(user_message) AS question FROM session_messages WHERE message_id IS NOT NULL GROUP BY 1)) WHERE question IS NOT NULL)")
def clean_questions(spark, d):
    """Numbered questions without their numbers."""
    i = F.length("question") % 7
    numbered = F.concat(i.cast("string"), F.when(i % 2 == 0, ". ").otherwise(")"), F.col("question"))
    return _questions(spark, d).where("question is not null").select("message_id", T.clean_question(numbered).alias("question"))


@query(f"""WITH l AS (SELECT item_id, [{STRIP('question')}, {STRIP('passage')}] AS q FROM eval_items WHERE question IS NOT NULL AND passage IS NOT NULL)
SELECT item_id, list_filter(list_transform(q, lambda x: {STRIP(f'''regexp_replace({SQUEEZE('x')}, '^[0-9]+[.)]{WS}*', '')''')}), lambda x: x <> '') AS questions FROM l""")
def extracted_questions(spark, d):
    """A model's replies in three forms: an array, text with an array, a list."""
    q = F.array(T.strip(F.col("question")), T.strip(F.col("passage")))
    numbered = F.transform(q, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    form = F.col("item_id") % 3
    reply = F.when(form == 0, F.to_json(numbered)).when(form == 1, F.concat(F.lit("Here they are: "), F.to_json(q), F.lit(" Good luck."))).otherwise(F.concat(F.lit("- "), F.array_join(numbered, "\n* ")))
    return read(spark, d, "eval_items").where("question is not null and passage is not null").select("item_id", T.extract_questions(reply).alias("questions"))


@query("SELECT vec_id, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def stored_vectors(spark, d):
    """Vectors that went through JSON text."""
    v = read(spark, d, "embeddings").select("vec_id", T.stored_vector(F.to_json("embedding")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("vec_id", F.size("v").cast("bigint").alias("width"), F.round(total, 6).alias("total"))


# Library.

REG = f"""n AS (SELECT *, {STRIP('document_name')} AS name FROM doc_registry), f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS o FROM n WHERE length(name) >= 4),
g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN o = 1 AND source_type IS NOT NULL THEN 0 WHEN coalesce(source_type, '') <> '' THEN 1 ELSE 2 END, id) AS b FROM f),
dd AS (SELECT name, id, source_type, total_pages FROM g WHERE b = 1),
ll AS (SELECT name, coalesce(source_type, 'Unknown') AS source_type, CASE WHEN coalesce(total_pages, '') <> '' THEN total_pages ELSE '?' END AS total_pages, coalesce(c, 0) AS chunk_count
       FROM dd LEFT JOIN (SELECT document_name, count(*) AS c FROM sama_nora_chunks GROUP BY 1) c ON name = document_name)"""


@query(f"WITH {REG} SELECT * FROM dd")
def registry_dedup(spark, d):
    return L.dedup_registry(read(spark, d, "doc_registry"))


@query(f"WITH {REG} SELECT *, (SELECT count(*) FROM ll) AS total FROM ll ORDER BY chunk_count DESC, name LIMIT 20")
def doc_library(spark, d):
    return L.library(read(spark, d, "doc_registry"), read(spark, d, "sama_nora_chunks"))


@query(f"WITH {REG} SELECT *, (SELECT count(*) FROM ll WHERE contains(lower(name), 'circular')) AS total FROM ll WHERE contains(lower(name), 'circular')")
def doc_search(spark, d):
    return L.library(read(spark, d, "doc_registry"), read(spark, d, "sama_nora_chunks"), "Circular", None)


@query("SELECT (SELECT count(*) FROM doc_registry) AS documents, (SELECT count(*) FROM sama_nora_chunks) AS chunks, (SELECT count(*) FROM session_messages) AS messages, (SELECT count(DISTINCT session_id) FROM chat_sessions) AS sessions")
def system_stats(spark, d):
    return L.stats(*(read(spark, d, t) for t in ("doc_registry", "sama_nora_chunks", "session_messages", "chat_sessions")))


@query("SELECT document_name, count(*) AS n FROM sama_nora_chunks GROUP BY 1")
def chunk_counts(spark, d):
    return L.name_counts(read(spark, d, "sama_nora_chunks"), "document_name")


@query("SELECT id, CASE WHEN upper(source_type) IN ('CSB', 'NDO') THEN upper(source_type) ELSE 'OTHER' END AS badge, substr(id, 1, 8) || '...' AS short_id FROM doc_registry")
def source_badges(spark, d):
    return read(spark, d, "doc_registry").select("id", T.badge(F.col("source_type"), ("csb", "ndo")).alias("badge"), T.short_id(F.col("id")).alias("short_id"))


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 8) AS mean_latency FROM events")
def rolling_latency(spark, d):
    return L.rolling_latency(read(spark, d, "events"), SETTINGS, 1_000)


@query("""WITH w AS (SELECT event_id, sum((event_type = 'view')::INT) OVER o AS hits, count(*) OVER o AS requests FROM events WINDOW o AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, hits::BIGINT AS hits, requests, round(hits * 100 / requests, 1) AS hit_rate FROM w""")
def cache_hit_running(spark, d):
    return L.running_hits(read(spark, d, "events"), block=1_000)


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 8) AS mean_latency FROM events")
def user_latency(spark, d):
    return L.rolling_latency_by_user(read(spark, d, "events"), SETTINGS)


# Conversations.

CONV = """t AS (SELECT session_id, user_message, row_number() OVER (PARTITION BY session_id ORDER BY timestamp ASC NULLS LAST, message_id, user_message ASC NULLS LAST) AS n FROM session_messages WHERE session_id IS NOT NULL),
conv AS (SELECT session_id, substr(coalesce(nullif(user_message, ''), 'New conversation'), 1, 40) AS title, last_message, messages FROM t JOIN (SELECT session_id, epoch_us(max(timestamp)) AS last_message, count(*) AS messages FROM session_messages GROUP BY 1) USING (session_id) WHERE n = 1)"""


@query(f"WITH {CONV} SELECT * FROM conv ORDER BY last_message DESC NULLS LAST, session_id LIMIT 50")
def conversation_list(spark, d):
    return S.conversation_list(read(spark, d, "session_messages")).withColumn("last_message", F.unix_micros("last_message"))


@query(f"WITH {CONV} SELECT * FROM conv")
def conversation_totals(spark, d):
    return S.conversation_list(read(spark, d, "session_messages"), None).withColumn("last_message", F.unix_micros("last_message"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp ASC NULLS LAST, message_id, user_message ASC NULLS FIRST, assistant_message ASC NULLS FIRST) AS nth FROM session_messages WHERE session_id IS NOT NULL)
SELECT session_id, nth::INT AS nth, message_id, epoch_us(timestamp) AS timestamp FROM o WHERE nth <= 20""")
def session_messages(spark, d):
    return S.session_page(read(spark, d, "session_messages")).withColumn("timestamp", F.unix_micros("timestamp"))


@query("SELECT message_id || '_user' AS id, 'user' AS role, user_message AS content, epoch_us(timestamp) AS timestamp FROM session_messages WHERE user_message IS NOT NULL UNION ALL SELECT message_id, 'assistant', assistant_message, epoch_us(timestamp) FROM session_messages WHERE assistant_message IS NOT NULL")
def message_explode(spark, d):
    return S.message_explode(read(spark, d, "session_messages")).withColumn("timestamp", F.unix_micros("timestamp"))


@query(f"WITH {SIX} SELECT session_id, message_id, c::INT AS message_count FROM n WHERE c % 6 = 0")
def summary_triggers(spark, d):
    return S.summary_triggers(read(spark, d, "session_messages"), SETTINGS).drop("last_questions")


@query(f"WITH {SIX} SELECT session_id, message_id, array_to_string(l, ' | ') AS last_questions FROM n WHERE c % 6 = 0")
def last_six(spark, d):
    return S.summary_triggers(read(spark, d, "session_messages"), SETTINGS).drop("message_count")


@query("SELECT DISTINCT message_id, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d <= 6 THEN 'This Week' ELSE 'Older' END AS bucket FROM (SELECT message_id, date_diff('day', (timestamp AT TIME ZONE 'UTC')::DATE, DATE '2026-01-08') AS d FROM session_messages)")
def date_buckets(spark, d):
    return read(spark, d, "session_messages").select("message_id", T.date_bucket(F.col("timestamp"), F.to_date(F.lit("2026-01-08"))).alias("bucket")).distinct()


@query("SELECT user_id, count(*) FILTER (feedback = 1) AS up, count(*) FILTER (feedback = 0) AS down, count(*) FILTER (feedback IS NULL OR feedback NOT IN (0, 1)) AS rejected FROM (SELECT DISTINCT * FROM session_feedback) GROUP BY 1")
def feedback_rollup(spark, d):
    return S.feedback_rollup(read(spark, d, "session_feedback"))


@query("""WITH o AS (SELECT session_id, message_id, min(timestamp) AS ts, max(user_message) AS q FROM session_messages WHERE session_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT message_id, q AS question, lag(q) OVER (PARTITION BY session_id ORDER BY ts ASC NULLS LAST, message_id) AS previous_question FROM o)
SELECT message_id, feedback, question, previous_question FROM (SELECT DISTINCT message_id, feedback FROM session_feedback WHERE feedback IN (0, 1)) JOIN b USING (message_id)""")
def feedback_context(spark, d):
    return S.feedback_context(read(spark, d, "session_feedback"), read(spark, d, "session_messages"))


@query("""WITH l AS (SELECT session_id, message_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, message_id DESC) AS n FROM session_messages WHERE session_id IS NOT NULL AND timestamp IS NOT NULL)
SELECT session_id, l.message_id, coalesce(c, 0) AS sources FROM l LEFT JOIN (SELECT message_id, count(*) AS c FROM answer_sources GROUP BY 1) s ON s.message_id = l.message_id WHERE n = 1""")
def latest_answers(spark, d):
    return S.latest_answers(read(spark, d, "session_messages"), read(spark, d, "answer_sources"))


# Evaluation.


@query(f"WITH {RUNS} SELECT message_id, phrase_ratio, matched::INT AS matched FROM runs")
def phrase_grounding(spark, d):
    return _runs(spark, d).select("message_id", "phrase_ratio", "matched")


@query(f"WITH {RUNS} SELECT message_id, method, judge, retrieval, method_verdict, combined, bucket FROM runs")
def combined_verdict(spark, d):
    return _runs(spark, d).select("message_id", "method", "judge", "retrieval", "method_verdict", "combined", "bucket")


@query(f"""WITH {RUNS}, sr AS (SELECT *, CASE judge WHEN 'GROUNDED' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 WHEN 'UNGROUNDED' THEN 0.0 END::DOUBLE AS sc FROM runs)
SELECT category, count(*) AS questions, round(count(*) FILTER (retrieval = 'SUCCESS') / count(*) FILTER (retrieval <> 'EXPECTED_SKIP') * 100, 2) AS retrieval_pct, round(avg(sc) * 100, 2) AS weighted_grounding_pct,
 round(count(*) FILTER (judge = 'GROUNDED') / count(sc) * 100, 2) AS strict_grounding_pct, round(count(*) FILTER (method_verdict = 'CORRECT') / count(*) * 100, 2) AS accuracy_pct,
 round(coalesce(avg(phrase_ratio) FILTER (phrase_ratio > 0), 0), 4)::DOUBLE AS mean_phrase_ratio, round(coalesce(avg(top_sim) FILTER (top_sim > 0), 0), 4)::DOUBLE AS mean_top_sim,
 round(coalesce(avg(candidates) FILTER (candidates > 0), 0), 4)::DOUBLE AS mean_candidates FROM sr GROUP BY 1""")
def kpi_summary(spark, d):
    return E.kpi_summary(_runs(spark, d))


@query(f"WITH {RUNS} SELECT bucket, category, count(*) AS n FROM runs WHERE bucket IS NOT NULL GROUP BY 1, 2")
def failure_buckets(spark, d):
    return E.failure_buckets(_runs(spark, d)).drop("first_members")


@query(f"WITH {RUNS}, k AS (SELECT unnest([{{'kind': 'retrieval', 'value': retrieval}}, {{'kind': 'judge', 'value': judge}}, {{'kind': 'method_verdict', 'value': method_verdict}}, {{'kind': 'combined', 'value': combined}}, {{'kind': 'method', 'value': method}}]) AS x FROM runs) SELECT x.kind AS kind, x.value AS value, count(*) AS n FROM k GROUP BY 1, 2")
def verdict_counts(spark, d):
    return E.verdict_counts(_runs(spark, d))


@query(f"WITH {RUNS} SELECT category, count(*) FILTER (top_sim >= 0.72) AS passed, count(*) AS total FROM runs GROUP BY 1")
def pass_rates(spark, d):
    return E.pass_rates(_runs(spark, d), SETTINGS)


@query(f"""WITH {RUNS} SELECT 'totals' AS kind, NULL AS message_id, json_object('category', category, 'questions', count(*), 'passed', count(*) FILTER (combined = 'PASS'))::VARCHAR AS line FROM runs GROUP BY category
 UNION ALL SELECT 'result', message_id, json_object('category', category, 'expected', expected, 'method', method, 'method_verdict', method_verdict, 'retrieval', retrieval, 'judge', judge, 'combined', combined, 'matched', matched)::VARCHAR FROM runs""")
def run_report(spark, d):
    return E.run_report(_runs(spark, d))


# The answers of the pipeline, scored; how long they took is made up, some without a time.

ELAPSED = "CASE WHEN item_id % 17 <> 0 THEN item_id * 37 % 500 END"
ITEMS = f"""{ANSWERED}, el AS (SELECT item_id AS id, category, expected, {ELAPSED} AS elapsed FROM eval_items),
b0 AS (SELECT id AS message_id, question, answer, category, CASE WHEN category IN ('trick', 'out_of_scope') THEN category ELSE coalesce(expected, 'correct') END AS expected,
  CASE WHEN elapsed > 420 THEN 'timeout' WHEN elapsed IS NULL THEN 'error' ELSE method END AS method, coalesce(top_similarity, 0.0) AS top_sim, candidates, t, elapsed, coalesce(elapsed > 420, false) AS timed_out, elapsed IS NULL AS errored
  FROM done JOIN el USING (id)), {SCORE}"""


def _item_runs(spark, d):
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("id"), "category", "expected", F.expr(ELAPSED).alias("elapsed"))
    return E.pipeline_runs(_answered(spark, d), items, SETTINGS), items


@query(f"WITH {ITEMS} SELECT message_id, category, expected, method, judge, retrieval, method_verdict, combined, bucket, phrase_ratio FROM runs")
def item_verdicts(spark, d):
    return _item_runs(spark, d)[0].select("message_id", "category", "expected", "method", "judge", "retrieval", "method_verdict", "combined", "bucket", "phrase_ratio")


@query(f"WITH {ITEMS} SELECT bucket, category, count(*) AS n, list_sort(list(message_id))[1:1000] AS first_members FROM runs WHERE bucket IS NOT NULL GROUP BY 1, 2")
def item_buckets(spark, d):
    return E.failure_buckets(_item_runs(spark, d)[0])


@query(f"""WITH {ITEMS} SELECT category, count(*) AS tested, count(*) FILTER (combined = 'PASS') AS passed, count(*) FILTER (timed_out) AS timeouts, count(*) FILTER (errored) AS errors,
 round(count(*) FILTER (combined = 'PASS') * 100 / nullif(count(*) FILTER (NOT timed_out AND NOT errored), 0), 2) AS pass_pct, round(avg(elapsed), 4) AS mean_elapsed, max(elapsed) AS max_elapsed FROM runs GROUP BY ROLLUP (category)""")
def generator_stats(spark, d):
    runs, items = _item_runs(spark, d)
    return E.generator_stats(runs.join(items.select(F.col("id").alias("message_id"), "elapsed"), "message_id"))


_NORM = f"lower(regexp_replace({SQUEEZE('question')}, '[?.!]+$', ''))"


@query(f"""WITH {QS}, k AS (SELECT message_id AS id, question, {_NORM} AS key FROM q WHERE question IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM k WHERE key <> '')
SELECT id, question, key FROM o WHERE n = 1""")
def question_dedup(spark, d):
    return E.dedup_questions(_questions(spark, d).where("question is not null").withColumnRenamed("message_id", "id"))


@query(f"SELECT id, CASE WHEN length({SQUEEZE('content')}) <= 220 THEN {SQUEEZE('content')} ELSE substr({SQUEEZE('content')}, 1, 217) || '...' END AS preview FROM sama_nora_chunks WHERE content IS NOT NULL")
def short_previews(spark, d):
    return read(spark, d, "sama_nora_chunks").where("content is not null").select("id", T.short_preview(F.col("content")).alias("preview"))


# Links.


def _site(spark, d):
    """Pages of a made-up site, one for each registered document, that link to its files in several ways."""
    slug = F.lower(F.regexp_replace(T.strip(F.col("document_name")), "[^A-Za-z0-9]+", "-"))
    url = F.concat(F.lit("https://docs.example.org/rules/"), F.col("id"))
    html = F.concat(
        F.lit("<a href=\"/files/"), slug, F.lit(".pdf?x=1\">"), F.col("document_name"), F.lit(" (PDF, 12 kb)</a><a href='#top'>top</a><a href=\"mailto:a@example.org\">mail</a>"),
        F.lit("<a href=\"https://docs.example.org/rules/"), F.substring("id", 1, 8), F.lit("/#part\">more</a><iframe src=\"https://other.example.org/view "), slug, F.lit("\"></iframe>"),
    )
    return read(spark, d, "doc_registry").where("document_name is not null").select(url.alias("url"), html.alias("html"))


SITE = f"""r AS (SELECT id, document_name, lower(regexp_replace({STRIP('document_name')}, '[^A-Za-z0-9]+', '-', 'g')) AS slug, 'https://docs.example.org/rules/' || id AS page FROM doc_registry WHERE document_name IS NOT NULL),
l AS (SELECT page, 'https://docs.example.org/files/' || slug || '.pdf?x=1' AS link, trim(document_name || ' (PDF, 12 kb)') AS label FROM r
 UNION SELECT page, 'https://docs.example.org/rules/' || substr(id, 1, 8), 'more' FROM r UNION SELECT page, 'https://other.example.org/view%20' || slug, '' FROM r)"""


@query(f"WITH {SITE} SELECT page, link, label FROM l")
def page_links(spark, d):
    return C.page_links(_site(spark, d))


@query(f"WITH {SITE} SELECT page, link FROM l WHERE link LIKE 'https://docs%' AND link NOT LIKE '%.pdf?x=1'")
def link_filter(spark, d):
    return C.page_links(_site(spark, d)).where(U.crawlable(F.col("link"), F.col("page"), F.lit(1), SETTINGS)).select("page", "link")


@query(f"WITH {SITE} SELECT DISTINCT link, substr(md5(link), 1, 8) || '_' || substr(regexp_extract(split_part(link, '?', 1), '([^/]*)$', 1), 1, 80) AS local FROM l WHERE ends_with(split_part(link, '?', 1), '.pdf')")
def pdf_links(spark, d):
    return C.page_links(_site(spark, d)).where(U.is_pdf(F.col("link"))).select("link", U.local_name(F.col("link")).alias("local")).distinct()


@query(f"""WITH {SITE}, t AS (SELECT page, link, label, {STRIP('''regexp_replace(label, ' *[(]PDF, 12 kb[)]$', '')''')} AS s, regexp_extract(split_part(replace(link, '%20', '_'), '?', 1), '([^/]*)$', 1) AS file FROM l),
n AS (SELECT *, {SQUEEZE("regexp_replace(regexp_replace(file, '(.)[.][^.]*$', '\\1'), '[_%-]+', ' ', 'g')")} AS stem, substr(regexp_replace(regexp_extract(link, '([^/]*)$', 1), '[?].*$', ''), 1, 80) AS tail,
  length(s) <= 4 OR len(list_filter(regexp_extract_all(lower(s), '[\\pL\\pN]+'), lambda w: NOT list_contains({list(SETTINGS.generic_words)!r}, w))) = 0 OR regexp_matches(s, '(?i)^\\d+\\s*(?:pages?|bytes?|[kmg]b)$|\\.pdf$') AS generic FROM t)
SELECT page, link, substr(CASE WHEN generic THEN CASE WHEN length(stem) < 3 THEN tail ELSE stem END ELSE {SQUEEZE('s')} END, 1, 200) AS name FROM n""")
def clean_names(spark, d):
    return C.page_links(_site(spark, d)).select("page", "link", U.clean_name(F.col("label"), F.col("link"), settings=SETTINGS).alias("name"))


EDGES = "e AS (SELECT DISTINCT document_name AS src, dst FROM (SELECT document_name, lead(document_name) OVER (PARTITION BY message_id ORDER BY similarity DESC NULLS LAST, source_id) AS dst FROM answer_sources WHERE document_name IS NOT NULL) WHERE dst IS NOT NULL AND dst <> document_name)"


@query(f"""WITH RECURSIVE {EDGES}, s AS (SELECT min(src) AS url FROM e), w(url, depth) AS (SELECT url, 0 FROM s WHERE url IS NOT NULL UNION SELECT dst, depth + 1 FROM w JOIN e ON src = url WHERE depth < 3)
SELECT url, min(depth)::INT AS depth FROM w GROUP BY 1""")
def crawl_levels(spark, d):
    edges = C.citation_edges(read(spark, d, "answer_sources"))
    seeds = edges.agg(F.min("src").alias("url")).where("url is not null")
    return C.crawl_levels(edges, seeds, SETTINGS.max_depth, None)


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY similarity DESC NULLS LAST, source_id) AS nth FROM answer_sources)
SELECT message_id, count(*) AS n, string_agg(coalesce(snippet, ''), chr(10) || '---' || chr(10) ORDER BY nth) AS snippets FROM t WHERE nth <= 5 GROUP BY 1""")
def judged_sources(spark, d):
    return E.judged_sources(read(spark, d, "answer_sources"))


@query("SELECT message_id, max(similarity) AS top, round(avg(similarity), 6) AS mean, count(*) AS sources FROM answer_sources GROUP BY 1")
def similarity_scores(spark, d):
    return E.similarity_scores(read(spark, d, "answer_sources"))


@query("SELECT CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'mismatch' ELSE 'ok' END AS state, count(*) AS n FROM sama_nora_chunks GROUP BY 1")
def width_check(spark, d):
    return E.width_check(read(spark, d, "sama_nora_chunks").select("embedding"), "embedding", 64)


@query(f"WITH {SITE} SELECT split_part(link, '/', 3) AS site, link, row_number() OVER (PARTITION BY split_part(link, '/', 3) ORDER BY link)::INT AS nth, count(*) OVER (PARTITION BY split_part(link, '/', 3)) AS links FROM (SELECT DISTINCT link FROM l)")
def site_groups(spark, d):
    return C.by_site(C.page_links(_site(spark, d)).select("link"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'not found in the documents|does not contain a clear answer|unable to answer|لا تتوفر إجابة') THEN 1 ELSE 0 END AS hit FROM documents WHERE text IS NOT NULL")
def not_found_flags(spark, d):
    return _pages(spark, d).select("doc_id", T.says_not_found(F.col("text"), SETTINGS).cast("int").alias("hit"))


@query("SELECT count(*) AS n, count(DISTINCT document_name) AS names, min(page_no) AS first, max(page_no) AS last FROM documents WHERE source = 'csb' AND page_no >= 100")
def filtered_count(spark, d):
    chosen = read(spark, d, "documents").where("source = 'csb' and page_no >= 100")
    return chosen.agg(F.count("*").alias("n"), F.countDistinct("document_name").alias("names"), F.min("page_no").alias("first"), F.max("page_no").alias("last"))


@query(f"""WITH f AS (SELECT doc_id, text, [{', '.join(f"['{k.lower()}', '{v}']" for k, v in SETTINGS.rules)}] AS rules FROM documents WHERE text IS NOT NULL)
SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens, lower(regexp_replace({SQUEEZE('text')}, '[?.!]+$', '')) AS question, {SCOPE.replace('question', 'text')} AS rejected, {CANNED.replace('question', 'text')} AS canned FROM f""")
def sql_functions(spark, d):
    from docspark.functions.registry import register

    register(spark, SETTINGS)
    return _pages(spark, d).selectExpr("doc_id", "approx_tokens(text) AS tokens", "normalize_question(text) AS question", "out_of_scope(text) AS rejected", "is_definition(text, 'reporting portal') AS canned")


@query(f"WITH {QS} SELECT message_id, question {_FIRE} AS expanded FROM q WHERE question IS NOT NULL")
def sql_expand(spark, d):
    from docspark.functions.registry import register

    register(spark, SETTINGS)
    return _questions(spark, d).where("question is not null").selectExpr("message_id", "expand_question(question) AS expanded")


@query(f"WITH RECURSIVE {FOLD} SELECT page AS doc_id, chunk_no, md5(content) AS content, token_count::INT AS token_count FROM folded")
def sql_fold(spark, d):
    """The fold chunker as a table function."""
    from docspark.functions.registry import register

    register(spark, SETTINGS)
    _pages(spark, d).where(F.length(T.strip(F.col("text"))) >= 30).createOrReplaceTempView("__pages")
    return spark.sql("SELECT doc_id, f.chunk_no, md5(f.content) AS content, f.token_count FROM __pages, LATERAL fold_chunks(text) f")


@query(f"""WITH {RUNS} SELECT message_id, CASE WHEN t IS NULL THEN 0 ELSE least(5, len(list_distinct(list_filter(ph, lambda q: contains(lower(t), q))))) END::INT AS matched, len(ph)::INT AS phrases FROM m""")
def sql_grounding(spark, d):
    from docspark.functions.registry import register

    register(spark, SETTINGS)
    line = F.concat(F.coalesce("snippet", F.lit("")), F.lit(" "), F.coalesce("document_name", F.lit("")))
    text = read(spark, d, "answer_sources").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", line.alias("t")))), lambda x: x["t"]), " ").alias("t"))
    said = read(spark, d, "session_messages").where("message_id is not null").groupBy("message_id").agg(F.min("user_message").alias("question"), F.max("assistant_message").alias("answer"))
    rows = said.where("question is not null and answer is not null").join(text, "message_id", "left")
    return rows.selectExpr("message_id", "phrases_of(answer) AS p", "lower(t) AS t").selectExpr("message_id", "CASE WHEN t IS NULL THEN 0 ELSE phrases_matched(p, t) END AS matched", "size(p) AS phrases")


@query(f"""WITH r AS (SELECT item_id % 7 AS ord, substr(question, 1, 1 + item_id::INT % 40) AS key, category AS expansion FROM eval_items UNION ALL SELECT * FROM (VALUES (7, '? ', 'mark'), (8, 'customer complaint rec', 'inside'), (9, '', 'never'), (10, 'ustomer complaint records', 'mid'), (11, ', ', 'comma'))),
k AS (SELECT ord, expansion, lower(key) AS k, length(key) <= 20 AS short FROM r WHERE key <> ''),
h AS (SELECT i.item_id, ord, expansion FROM eval_items i JOIN k ON CASE WHEN NOT contains(lower(question), k) THEN false WHEN short THEN regexp_matches(lower(question), CASE WHEN regexp_matches(k, '^[\\pL\\pN_]') THEN '(?:^|{EDGE})' ELSE '[\\pL\\pN_]' END || regexp_escape(k) || CASE WHEN regexp_matches(k, '[\\pL\\pN_]$') THEN '(?:$|{EDGE})' ELSE '[\\pL\\pN_]' END) ELSE true END),
t AS (SELECT item_id, string_agg(expansion, ' ' ORDER BY ord, expansion) AS more FROM h GROUP BY 1)
SELECT item_id, question || coalesce(' ' || more, '') AS expanded FROM eval_items LEFT JOIN t USING (item_id)""")
def rules_table(spark, d):
    """Each question expanded by the rules of a table: beginnings of the questions of every length to 40, cut within words
    too, and keys without a word, in the middle of words and empty ones."""
    items = read(spark, d, "eval_items")
    rules = items.select((F.col("item_id") % 7).alias("ord"), F.expr("substring(question, 1, 1 + cast(item_id as int) % 40)").alias("key"), F.col("category").alias("expansion"))
    more = spark.createDataFrame([(7, "? ", "mark"), (8, "customer complaint rec", "inside"), (9, "", "never"), (10, "ustomer complaint records", "mid"), (11, ", ", "comma")], rules.schema)
    expanded = G.expand_by_table(items.select(F.col("item_id").alias("id"), "question"), rules.unionByName(more))
    return expanded.select(F.col("id").alias("item_id"), "expanded")


# Sources and sinks.


@query("SELECT source_id, message_id, document_name, page_start, page_end, section_title, similarity, snippet FROM answer_sources")
def ndjson_round(spark, d):
    """The table written as lines and read again, beside lines that are no objects."""
    from docspark.schemas import SOURCES
    from docspark.session import new_path
    from docspark.sources.io import read_ndjson, write_ndjson

    path = new_path(spark, "ndjson")
    write_ndjson(read(spark, d, "answer_sources"), path)
    write_ndjson(spark.createDataFrame([("{broken",), ("",), ("  ",)], "line string"), path, "line")
    return read_ndjson(spark, path, SOURCES)


@query("SELECT item_id, question FROM eval_items WHERE item_id % 3 <> 0")
def jsonl_resume(spark, d):
    """What a run has still to do whose lines hold a third of the items."""
    from pyspark.sql.types import LongType, StructField, StructType

    from docspark.session import new_path
    from docspark.sources.io import resume, write_ndjson

    items, path = read(spark, d, "eval_items").select("item_id", "question"), new_path(spark, "jsonl")
    schema = StructType([StructField("item_id", LongType())])
    everything = resume(items, path, schema, "item_id")
    write_ndjson(everything.where("item_id % 3 = 0"), path)
    return resume(items, path, schema, "item_id")


@query("SELECT category, sum(octet_length(encode(question)) + 1)::BIGINT AS length FROM eval_items WHERE question IS NOT NULL GROUP BY 1 HAVING sum(octet_length(encode(question)) + 1) > 2048")
def binary_files(spark, d):
    """One file for each category, of which those of up to 2 kB count as broken."""
    from docspark.session import new_path
    from docspark.sources.io import read_files

    path = new_path(spark, "files")
    read(spark, d, "eval_items").where("question is not null").select("category", "question").repartition(1, "category").write.partitionBy("category").text(path)
    files = read_files(spark, path).where(F.col("path").endswith(".txt"))
    return files.select(F.regexp_extract("path", "category=([^/]*)", 1).alias("category"), F.octet_length("content").cast("bigint").alias("length"))


@query("""WITH f AS (SELECT category, string_agg(question, chr(10) ORDER BY item_id) || chr(10) AS t FROM eval_items WHERE question IS NOT NULL GROUP BY 1) SELECT category, 'text' AS extractor, md5(t) AS text FROM f""")
def extracted_pages(spark, d):
    """Of the default extractors the one that keeps lines wins on plain text."""
    from docspark.session import new_path
    from docspark.sources.extract import best_pages, extract
    from docspark.sources.io import read_files

    path = new_path(spark, "files")
    rows = read(spark, d, "eval_items").where("question is not null").repartition(1, "category").sortWithinPartitions("category", "item_id")
    rows.select("category", "question").write.partitionBy("category").text(path)
    files = read_files(spark, path, 0).where(F.col("path").endswith(".txt"))
    return best_pages(extract(files)).select(F.regexp_extract("doc", "category=([^/]*)", 1).alias("category"), "extractor", F.md5("text").alias("text"))


@query("""WITH f AS (SELECT DISTINCT session_id, user_id, message_id, feedback FROM session_feedback WHERE message_id IS NOT NULL)
SELECT message_id, feedback, NULL::VARCHAR AS comments FROM (SELECT message_id, min(feedback) AS feedback FROM f GROUP BY 1)""")
def append_feedback(spark, d):
    """Feedback of which only some fields are given, twice."""
    from docspark.schemas import FEEDBACK
    from docspark.session import new_path
    from docspark.sources.io import append_optional

    path = new_path(spark, "feedback")
    rows = read(spark, d, "session_feedback").groupBy("message_id").agg(F.min("feedback").alias("feedback")).withColumn("surplus", F.lit(1))
    for _ in range(2):
        append_optional(rows, path, FEEDBACK, "message_id")
    return spark.read.schema(FEEDBACK).parquet(path).select("message_id", "feedback", "comments")


@query("""WITH e AS (SELECT label, embedding, vec_id, TIMESTAMP '2026-01-01' + to_days((vec_id % 60)::INT) AS t0 FROM embeddings),
l AS (SELECT label, max(t0) AS t0 FROM e GROUP BY 1) SELECT label::BIGINT AS entry_id, epoch_us(t0) AS stored_at FROM l WHERE epoch(t0) >= epoch(TIMESTAMP '2026-03-28') - 2592000""")
def cache_store(spark, d):
    """Entries stored again and again in a cache table: the last time counts; those past their time to live are gone."""
    from docspark.session import new_path
    from docspark.sources.io import live_answers, store_answers

    path = new_path(spark, "cache")
    rows = read(spark, d, "embeddings").select(F.col("label").alias("entry_id"), "embedding", F.col("vec_id").cast("string").alias("result"), (F.col("vec_id") % 60).alias("day"))
    store_answers(rows.where("false").drop("day"), path, "2026-01-01 00:00:00")
    stamped = rows.select(F.col("entry_id").cast("bigint"), "embedding", "result", F.expr("timestamp '2026-01-01' + make_interval(0, 0, 0, cast(day as int))").alias("stored_at"))
    stamped.write.mode("append").parquet(path)
    live = live_answers(spark.read.parquet(path), F.lit("2026-03-28").cast("timestamp"), SETTINGS.cache_ttl_seconds)
    return live.select("entry_id", F.unix_micros("stored_at").alias("stored_at"))


# Streams: the request log as files that arrive one after the other.


def _arriving(spark, d):
    from docspark.session import new_path

    path = new_path(spark, "arriving")
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) * 4 / (high - low + 1)) if low is not None else F.lit(0)
    for k in range(4):
        events.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return path


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 8) AS mean_latency FROM events")
def stream_latency(spark, d):
    return ST.run_once(ST.latency_ring(ST.event_stream(spark, _arriving(spark, d)), SETTINGS), "latency", partitions=8)


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) AS requests FROM events GROUP BY 1")
def stream_hits(spark, d):
    return ST.run_once(ST.hit_counts(ST.event_stream(spark, _arriving(spark, d))), "hits", mode="complete", partitions=8)


@query("SELECT user_id, event_id, n AS count FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 6 = 0")
def stream_triggers(spark, d):
    return ST.run_once(ST.summary_trigger(ST.event_stream(spark, _arriving(spark, d)), SETTINGS), "triggers", partitions=8)


@query("""WITH e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS before FROM events)
SELECT user_id AS entry_id, event_id::VARCHAR AS result, CASE WHEN before IS NULL OR epoch_ms(ts) > epoch_ms(before) + 3600000 THEN 'new' ELSE 'refreshed' END AS event FROM e""")
def stream_entries(spark, d):
    """Entries with an hour to live, stored and stored again; what expired is told apart and left out here, as it depends on
    the batches."""
    from dataclasses import replace

    entries = ST.event_stream(spark, _arriving(spark, d)).select(F.col("user_id").alias("entry_id"), F.col("event_id").cast("string").alias("result"), F.col("ts").alias("stored_at"))
    return ST.run_once(ST.live_entries(entries, replace(SETTINGS, cache_ttl_seconds=3_600)), "entries", partitions=8).where("event <> 'expired'")


@query("SELECT DISTINCT event_type AS site, user_id::VARCHAR AS url FROM events")
def stream_seen(spark, d):
    links = ST.event_stream(spark, _arriving(spark, d)).select(F.col("event_type").alias("site"), F.col("user_id").cast("string").alias("url"), "ts")
    return ST.run_once(ST.first_seen(links), "seen", partitions=8).select("site", "url")


@query("""SELECT * FROM (VALUES ('chunk_tokens', '300'), ('low_confidence', '0.8'), ('postprocess', 'false'), ('top_k', '8')) t(name, value)""")
def settings_from_environment(spark, d):
    """Numbers and switches from the environment: comments are left out, what can't be read keeps its default."""
    import os

    from docspark.config import from_environment

    given = {"TRY_CHUNK_TOKENS": "300 # smaller", "TRY_LOW_CONFIDENCE": "0.8", "TRY_POSTPROCESS": "off", "TRY_TOP_K": "many"}
    os.environ.update(given)
    try:
        found = from_environment("TRY_")
    finally:
        for name in given:
            del os.environ[name]
    values = [(n, str(getattr(found, n)).lower()) for n in ("chunk_tokens", "low_confidence", "postprocess", "top_k")]
    return spark.createDataFrame(values, "name string, value string")
