"""Operators against small fixtures and plain-Python versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.config import Settings
from docspark.models import HashingEmbedder, embed
from docspark.operators import answer as A
from docspark.operators import crawl as C
from docspark.operators import evaluate as E
from docspark.operators import ingest as I
from docspark.operators import library as L
from docspark.operators import retrieve as R
from docspark.operators import sessions as S
from docspark.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fold_rules():
    s = Settings(chunk_tokens=10, chunk_overlap=1, min_chunk_chars=5)
    a, b, c = "A" * 24 + ".", "B" * 24 + ".", "C" * 60 + "."
    assert I.fold(f"{a} {b} {c}", s) == [(a, 6), (f"{a} {b}", 12), (f"{b} {c}", 21)]
    assert I.fold("Too short.", Settings()) == []


def test_chunk_pages(spark):
    text = "ARTICLE ONE\n" + " ".join(f"The bank shall keep record number {i} for ten years." for i in range(80))
    df = spark.createDataFrame([("d", 1, text), ("e", 1, None), ("f", 2, "short")], "document_name string, page int, text string")
    got = I.chunk_pages(df)
    out = got.orderBy("chunk_no").collect()
    assert [(r.content, r.token_count) for r in out] == I.fold(text, Settings()) and out[0].section_title == "ARTICLE ONE"
    assert got.select("id").distinct().count() == len(out) and I.chunk_pages(df).select("id").subtract(got.select("id")).count() == 0


def test_extraction(spark):
    data = [("d", "a", 0, 1, "one two three four five six seven eight nine ten"), ("d", "b", 1, 1, "one one one one one one one one one one"), ("d", "c", 2, 1, "")]
    scores = I.extraction_scores(spark.createDataFrame(data, "doc string, extractor string, extractor_ord int, page int, text string"))
    assert scores.count() == 2 and I.extraction_winner(scores).first().extractor == "a"


def test_loading(spark):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "k string, v int")
    assert rows(I.new_rows(new, old, "k")) == [("b", 3)]
    assert rows(I.upsert(old, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), "k")) == [("a", 2), ("b", 3)]


def test_batches(spark):
    got = rows(I.batches(spark.range(103).select(F.col("id").alias("k")).repartition(5), "k", 10))
    assert got == [(k, k // 10 + 1) for k in range(103)]


def test_vector_topk(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    x[7] = x[3]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id bigint, v array<float>")
    got = R.vector_topk(df.where("id % 100 = 0"), df, 5, block=1)
    s = x.astype(float) @ x.T.astype(float)
    for q in (0, 100):
        want = sorted(range(200), key=lambda j: (-round(s[q, j], 9), j))[:5]
        assert [r.id for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want
    assert R.vector_topk(df.limit(0), df, 5).count() == 0


def test_keyword_and_hybrid(spark):
    docs = spark.createDataFrame([(1, "the fee schedule"), (2, "fee fee fee"), (3, "nothing"), (4, None)], "id bigint, t string")
    q = spark.createDataFrame([(9, "Fee schedule?")], "id bigint, q string")
    kw = R.keyword_topk(q, docs, 5)
    assert [r.id for r in kw.orderBy("rank").collect()] == [1, 2]
    vec = spark.createDataFrame([(9, 2, 0.8, 1)], "query_id bigint, id bigint, similarity double, rank int")
    merged = R.hybrid_merge(vec, kw)
    assert [(r.id, r.similarity, r.source) for r in merged.orderBy("place").collect()] == [(2, 0.8, 0), (1, 0.75, 1)]
    assert R.confidence_guard(merged).first().method == "generative"
    best = R.rerank(merged, q, docs, 0)
    assert [r.id for r in best.orderBy("final_rank").collect()] == [1, 2]


def test_keyword_topk_is_bm25(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(60)] + [(90, None)]
    asked = [(1, "w1 W2 w2 w99"), (2, ""), (3, None)]
    got = rows(R.keyword_topk(spark.createDataFrame(asked, "q bigint, t string"), spark.createDataFrame(docs, "id bigint, t string"), 5).select("query_id", "id", "score", "rank"))
    texts = {i: t.split() for i, t in docs if t is not None}
    mean = sum(map(len, texts.values())) / len(texts)
    score = {}
    for i, w in texts.items():
        for t in ("w1", "w2"):
            if tf := w.count(t):
                df = sum(t in x for x in texts.values())
                score[i] = score.get(i, 0) + np.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    want = sorted(score, key=lambda i: (-round(score[i], 4), i))[:5]
    assert [r[1] for r in sorted(got, key=lambda r: r[3])] == want and {r[0] for r in got} == {1}


def test_string_ids(spark):
    data = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), (None, [1.0, 0.0]), ("d", None)]
    df = spark.createDataFrame(data, "id string, v array<double>")
    assert rows(R.vector_topk(df.where("id = 'c' or id = 'a'"), df, 1).select("query_id", "id")) == [("a", "a"), ("c", "c")]
    assert rows(R.vector_topk(df.where("id = 'b'"), df, 2, floor=0.5).select("id", "rank")) == [("a", 1), ("b", 2)]


def test_rerank_by_a_model(spark):
    from docspark.models import judged, pair_scorer, text_model

    c = spark.createDataFrame([(1, 10, 0.9, 0, 1), (1, 11, 0.8, 0, 2)], "query_id int, id int, similarity double, source int, place int")
    q, d = spark.createDataFrame([(1, "x")], "i int, q string"), spark.createDataFrame([(10, "a"), (11, "bbb")], "i int, t string")
    assert [r.id for r in R.rerank(c, q, d, 1, scorer=pair_scorer(lambda a, b: [float(len(x)) for x in b])).collect()] == [11]
    said = spark.createDataFrame([("a",), (None,)], "p string").select(text_model(lambda p: [x and x + "!" for x in p])(F.col("p")))
    assert [r[0] for r in said.collect()] == ["a!", None]
    verdict, reason = judged(F.col("p"))
    got = spark.createDataFrame([("GROUNDED: all there",), ("maybe",), (None,)], "p string").select(verdict, reason)
    assert [tuple(r) for r in got.collect()] == [("GROUNDED", "all there"), ("UNKNOWN", ""), ("ERROR", "")]


def test_answer_run(spark):
    from docspark.operators.pipeline import answer_run, cacheable

    s = Settings(rules=(("aml", "money laundering"),), out_of_scope=("\\bweather\\b",), low_confidence=0.5)
    chunks = embed(spark.createDataFrame(
        [("a", "D", 1, 2, "T", "Money laundering reports go to the unit. They are due in May."), ("b", "D", 1, 2, "T", "Money reports."), ("c", None, None, None, None, None)],
        "id string, document_name string, page_start int, page_end int, section_title string, content string"), "content", kind="array<double>")
    asked = [(1, "aml reports?"), (2, "The weather today"), (3, " "), (4, None), (5, "reporting portal"), (6, "zzz qqq"), (7, "What is due?")]
    q = spark.createDataFrame(asked, "id int, question string")
    old = spark.createDataFrame([(7, "What is due?", "old answer")], "entry_id bigint, t string, result string")
    run = answer_run(q, chunks, embed(old, "t", prefix="query: ", kind="array<double>"), settings=s)
    got = {r.id: r for r in run.collect()}
    assert {i: r.method for i, r in got.items()} == {1: "generative", 2: "out_of_scope", 3: "none", 4: "none", 5: "generative", 6: "not_found", 7: "cached"}
    assert got[7].answer == "old answer" and got[7].cached and got[1].answer.startswith("Money laundering reports") and [x.document_name for x in got[1].sources] == ["D"]
    assert got[5].sources == [] and cacheable(run, s).count() == 1
    assert answer_run(q.limit(0), chunks.limit(0), settings=s).count() == 0


def test_running_figures(spark):
    rng = random.Random(4)
    data = [(i, f"2025-01-01 00:{i // 60:02}:{i % 60:02}", i % 3, rng.choice(["view", "buy"]), rng.choice([None, 1.0, 2.5, 7.0])) for i in range(230)]
    df = spark.createDataFrame(data, "event_id bigint, t string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    values = [r[4] for r in data]
    means = [np.mean([v for v in values[max(0, i - 9) : i + 1] if v is not None] or [np.nan]) for i in range(230)]
    got = rows(L.rolling_latency(df, Settings(latency_window=10), 16))
    assert len(got) == 230 and all(abs((g if g is not None else np.nan) - m) < 1e-6 or g is None and np.isnan(m) for (_, g), m in zip(got, means))
    hits = np.cumsum([r[3] == "view" for r in data])
    assert [r[:3] for r in rows(L.running_hits(df, block=7))] == [(i, h, i + 1) for i, h in enumerate(hits)]


@pytest.mark.parametrize("mode,entry", [("best", 2), ("first", 1)])
def test_cache(spark, mode, entry):
    e = spark.createDataFrame([(1, [0.96, 0.28], "a"), (2, [1.0, 0.0], "b"), (3, [0.0, 1.0], "c")], "entry_id bigint, embedding array<float>, result string")
    q = spark.createDataFrame([(5, [1.0, 0.0])], "id bigint, v array<float>")
    assert R.cache_lookup(q, e, mode).first().entry_id == entry


def test_stream_tokens_rejoin(spark, tmp_path):
    texts = ["a  b c", " lead", "x", "", None, "tail "]
    df = spark.createDataFrame(list(enumerate(texts)), "message_id int, answer string")
    events = A.stream_events(df.select(F.col("message_id").cast("string"), "answer"))
    for i, t in enumerate(texts):
        got = [json.loads(r.event) for r in events.where(f"message_id = '{i}'").orderBy("seq").collect()]
        assert "".join(e.get("text", "") for e in got) == (t or "")
    io.write_ndjson(events, str(tmp_path / "e"), "event")
    spark.createDataFrame([("{bad",), ("",)], "value string").write.mode("append").text(str(tmp_path / "e"))
    assert io.read_ndjson(spark, str(tmp_path / "e")).count() == events.count()


def test_sources(spark):
    data = [("m", 1, "D", 1, 2, "S", 0.9, "x"), ("m", 2, "D", 1, 2, "S", 0.95, "y"), ("m", 3, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "message_id string, source_id bigint, document_name string, page_start int, page_end int, section_title string, similarity double, snippet string")
    out = A.dedup_sources(df)
    assert [(r.source_id, r.nth) for r in out.orderBy("nth").collect()] == [(2, 1), (3, 2)]
    assert A.context(out).first().context == "[Passage 1] (D, Pages 1-2, S)\ny\n\n[Passage 2] (?, Pages ?-?)\n"


def test_append_new(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert io.append_new(df, str(tmp_path / "t"), "k").count() == 2
    assert io.append_new(df, str(tmp_path / "t"), "k").count() == 0
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_registry_trap(spark):
    data = [("1", "Name A", None), ("2", " Name A ", "X"), ("3", "Name B", ""), ("4", "Name B", "Y"), ("5", "abc", "Z"), ("6", None, "Z")]
    df = spark.createDataFrame([(i, n, None, t, None) for i, n, t in data], "id string, document_name string, document_code string, source_type string, total_pages string")
    assert rows(L.dedup_registry(df).select("name", "id", "source_type")) == [("Name A", "2", "X"), ("Name B", "3", "")]


def test_summary_every_sixth(spark):
    data = [(f"m{i:02}", "s", None, f"q{i}", "a", f"2025-01-01 00:{i:02}:00") for i in range(13)]
    df = spark.createDataFrame(data, "message_id string, session_id string, user_id string, user_message string, assistant_message string, t string").withColumn("timestamp", F.to_timestamp("t"))
    got = S.summary_triggers(df).orderBy("message_count").collect()
    assert [(r.message_count, r.last_questions) for r in got] == [(6, "q0 | q1 | q2 | q3 | q4 | q5"), (12, "q6 | q7 | q8 | q9 | q10 | q11")]
    assert [r.message_id for r in S.session_page(df, 2).orderBy("nth").collect()] == ["m00", "m01"]
    assert [r.message_id for r in S.session_page(df, 2, newest=True).orderBy("nth").collect()] == ["m12", "m11"]


def test_crawl_levels(spark):
    rng = random.Random(2)
    edges = {(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)} | {("n0", "n1"), ("n1", "n0")}
    got = dict(rows(C.crawl_levels(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame([("n0",)], "url string"), 3, None)))
    depth = {"n0": 0}
    for d in (1, 2, 3):
        for v in {b for a, b in edges if depth.get(a) == d - 1} - depth.keys():
            depth[v] = d
    assert got == depth


def test_links(spark):
    html = '<a class=x href="/r/a.pdf">Rule <b>A</b></a><a href="#x">n</a><a href="mailto:q">m</a><iframe src="f.html"></iframe>'
    df = spark.createDataFrame([("http://h.org/p/q", html), ("http://h.org", None)], "url string, html string")
    assert rows(C.page_links(df)) == [("http://h.org/p/q", "http://h.org/p/f.html", ""), ("http://h.org/p/q", "http://h.org/r/a.pdf", "Rule A")]


def test_verdicts(spark):
    cases = [
        ("correct", "generative", False, False, "CORRECT"), ("correct", "not_found", False, False, "WRONG"), ("trick", "generative", True, False, "CORRECT"),
        ("trick", "generative", False, False, "HALLUCINATED"), ("out_of_scope", "out_of_scope", False, False, "CORRECT"), ("correct", "out_of_scope", False, False, "WRONG"),
        ("correct", "generative", False, True, "TIMEOUT"), ("correct", "none", False, False, "UNKNOWN"),
    ]
    df = spark.createDataFrame([c for c in cases], "e string, m string, n boolean, t boolean, want string")
    assert df.where(E.method_verdict(F.col("e"), F.col("m"), F.col("n"), F.col("t")) != F.col("want")).count() == 0


def test_rules_table(spark):
    from docspark.operators.guards import expand, expand_by_table

    q = [(1, "what of AML at the bank"), (2, "other"), (3, None), (4, "see subcustomer complaint recordset"), (5, "a++b and c+x, or\\E"), (6, "xxmethodologicallyyy"), (7, "a " * 500)]
    r = [(2, "bank", "B"), (1, "aml", "A"), (3, "zzz", "Z"), (4, "customer complaint records", "L"), (5, "++", "P"), (6, "C+", "C"), (7, "", "E"), (8, None, "N"), (9, "methodologicallyyyyyyy", "no"),
         (10, "xxmethodologicallyyy", "M"), (11, "?!?!?!?!?!?!?!?!?!?!?!", "no"), (12, "xmethodologicallyyy,,", "no"), (13, "x, or\\E", "Q")]
    got = dict(expand_by_table(spark.createDataFrame(q, "id bigint, question string"), spark.createDataFrame(r, "ord int, key string, expansion string")).collect())
    settings = Settings(rules=tuple((k, x) for _, k, x in sorted(r, key=lambda x: x[0]) if k and "\\E" not in k))
    plain = dict(spark.createDataFrame(q, "id bigint, question string").select("id", expand(F.col("question"), settings)).collect())
    assert got[3] is None and got[4].endswith("recordset L") and got[1].endswith("bank A B") and got[6].endswith(" M") and got[5].endswith("or\\E P C Q")
    assert all(got[i] == plain[i] for i in (1, 2, 4, 6, 7))
    none = spark.createDataFrame([], "ord int, key string, expansion string")
    assert expand_by_table(spark.createDataFrame(q, "id bigint, question string"), none).count() == 7


def test_embedder(spark):
    df = spark.createDataFrame([("fee schedule",), (None,)], "t string")
    got = [r.embedding for r in embed(df, "t").collect()]
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-5 and got[1] is None
    assert len(HashingEmbedder(16)(["x"])[0]) == 16


def test_streams(spark, tmp_path):
    from docspark.streaming import stateful as ST

    data = [(i, f"2025-01-01 00:00:{i:02}", i % 2, "view" if i % 3 == 0 else "buy", float(i), None) for i in range(20)]
    df = spark.createDataFrame(data, "event_id bigint, t string, user_id bigint, event_type string, value double, props string")
    df = df.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props")
    df.where("event_id < 10").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 10").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.event_stream(spark, str(tmp_path / "in"), 10)
    fired = rows(ST.run_once(ST.summary_trigger(stream), "fired", str(tmp_path / "c1")).select("user_id", "count"))
    assert fired == [(0, 6), (1, 6)]
    ring = ST.run_once(ST.latency_ring(stream, Settings(latency_window=2)), "ring", str(tmp_path / "c2"))
    assert ring.count() == 20
    hits = {r.user_id: (r.hits, r.requests) for r in ST.run_once(ST.hit_counts(stream), "hits", str(tmp_path / "c3"), "complete").collect()}
    assert hits == {0: (4, 10), 1: (3, 10)}


def test_entries_expire(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

    from docspark.streaming import stateful as ST

    def put(*rows_):
        spark.createDataFrame(rows_, "entry_id bigint, result string, t string").select("entry_id", "result", F.to_timestamp("t").alias("stored_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    schema = StructType([StructField("entry_id", LongType()), StructField("result", StringType()), StructField("stored_at", TimestampType())])
    put((1, "a", "2025-01-01 00:00:00"), (2, "x", "2025-01-01 00:00:00"))
    put((1, "b", "2025-01-01 00:00:50"))
    put((3, "late", "2025-01-01 01:00:00"))
    put((1, "c", "2025-01-01 02:00:00"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = rows(ST.run_once(ST.live_entries(stream, Settings(cache_ttl_seconds=60)), "live", str(tmp_path / "c")))
    assert [g for g in got if g[0] < 3] == [(1, "a", "new"), (1, "b", "expired"), (1, "b", "refreshed"), (1, "c", "new"), (2, "x", "expired"), (2, "x", "new")]


def test_polled_figures(spark, tmp_path):
    import time

    from docspark.streaming import stateful as ST

    events = spark.createDataFrame([(1, 7, "view"), (2, 7, "buy")], "event_id bigint, user_id bigint, event_type string").selectExpr(
        "event_id", "timestamp '2025-01-01 00:00:00' as ts", "user_id", "event_type", "cast(null as double) as value", "cast(null as string) as props"
    )
    events.write.parquet(str(tmp_path / "in"))
    query = ST.polled(ST.hit_counts(ST.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"), 1)
    query.processAllAvailable()
    time.sleep(0.1)
    query.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(7, 1, 2)]


def test_cached_files(spark, tmp_path):
    from docspark.functions.urls import local_name

    urls = spark.createDataFrame([("http://a.org/x.pdf",), ("http://a.org/y.pdf",), ("http://a.org/z.pdf",)], "url string")
    names = {r.url: r.n for r in urls.select("url", local_name(F.col("url")).alias("n")).collect()}
    (tmp_path / names["http://a.org/x.pdf"]).write_bytes(b"x" * 3000)
    (tmp_path / names["http://a.org/y.pdf"]).write_bytes(b"broken")
    got = {r.url: r.path for r in io.cached_files(urls, str(tmp_path)).collect()}
    assert got["http://a.org/x.pdf"].endswith("x.pdf") and got["http://a.org/y.pdf"] is None and got["http://a.org/z.pdf"] is None


def test_numbers_within_keys(spark):
    rng = random.Random(3)
    data = [(f"k{rng.randrange(3)}", f"2025-01-{rng.randrange(1, 5):02} 0{rng.randrange(9)}:00:00" if rng.random() < 0.9 else None, i) for i in range(200)]
    df = spark.createDataFrame(data, "k string, t string, i int").withColumn("ts", F.to_timestamp("t"))
    got = {r.i: r.n for r in I.numbered_within(df, "k", "ts", ["i"]).collect()}
    for key in ("k0", "k1", "k2"):
        mine = sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is None, d[1] or "", d[2]))
        assert [got[d[2]] for d in mine] == list(range(1, len(mine) + 1))


def test_pages_of_each_site(spark):
    edges = spark.createDataFrame([("http://a/1", f"http://a/{i}") for i in range(2, 9)] + [("http://a/1", f"http://b/{i}") for i in range(3)], "src string, dst string")
    got = C.crawl_levels(edges, spark.createDataFrame([("http://a/1",)], "url string"), 2, 3)
    assert rows(got.select("url")) == [("http://a/1",), ("http://a/2",), ("http://a/3",), ("http://b/0",), ("http://b/1",), ("http://b/2",)]


def test_extractors(spark, tmp_path):
    from docspark.cli import pages_of_files

    (tmp_path / "a.html").write_text("<html><head><title>x</title></head><body><p>The bank shall keep records of its customers, and all of them.</p><p>It must &amp; will.</p></body></html>")
    (tmp_path / "b.txt").write_text("First page here with many words in it, all of them different\nand lines.\n\nMore.\fSecond page here with other words in it, each of which stands once\n\nonly.")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00")
    got = {(r.document_name, r.page): r.text for r in pages_of_files(spark, str(tmp_path)).collect()}
    assert got["a", 1].startswith("The bank shall keep") and "It must & will." in got["a", 1] and got["b", 2].startswith("Second page")


def test_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    from docspark.session import discard, new_path, shared_folder, written

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(cluster)
    made = written(spark.range(3), "x")
    assert made.count() == 3 and new_path(spark, "x") != new_path(spark, "x")
    other = f"file://{tmp_path}/work"
    spark.range(3).write.parquet(f"{other}/t")
    discard(spark, other)
    assert not (tmp_path / "work").exists()


def test_optional_fields_and_resume(spark, tmp_path):
    from docspark.schemas import FEEDBACK

    df = spark.createDataFrame([("m", 1, "x"), (None, 0, "y")], "message_id string, feedback int, other string")
    assert io.append_optional(df, str(tmp_path / "f"), FEEDBACK, "message_id").count() == 1
    assert spark.read.parquet(str(tmp_path / "f")).columns == FEEDBACK.names
    spark.range(3).write.json(str(tmp_path / "j"))
    assert rows(io.resume(spark.range(5), str(tmp_path / "j"), spark.range(1).schema, "id")) == [(3,), (4,)]


def test_command_line(spark, tmp_path):
    from docspark.cli import ingest

    text = "The bank shall keep the records of its customers for ten years. " * 3
    spark.createDataFrame([("A", 1, text), ("B", 1, text), ("C", 1, "short"), (None, 1, text)], "document_name string, page int, text string").write.parquet(str(tmp_path / "p"))
    args = spark, str(tmp_path / "p"), str(tmp_path / "c"), str(tmp_path / "r")
    status = lambda df: {r.document_name: (r.status, r.chunks) for r in df.collect()}
    assert set(status(ingest(*args, validate_only=True)).values()) == {("found", 0)}
    assert status(ingest(*args, dry_run=True)) == {"A": ("ok", 1), "B": ("ok", 1), "C": ("no_text", 0)} and not (tmp_path / "c").exists()
    assert status(ingest(*args)) == {"A": ("ok", 1), "B": ("ok", 1), "C": ("no_text", 0)}
    assert status(ingest(*args)) == {"A": ("skipped", 0), "B": ("skipped", 0), "C": ("no_text", 0)}
    loaded = spark.read.parquet(str(tmp_path / "c"))
    assert loaded.count() == 2 and all(len(r.embedding) == 64 for r in loaded.collect())
    assert {r.document_name for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"A", "B"}


def test_sql_functions(spark):
    from docspark.functions.registry import register

    register(spark)
    got = spark.sql("select is_pdf_url('http://a/B.PDF?x'), approx_tokens('abcdefgh'), page_language('نص عربي'), normalize_question(' What  is IT?! '), sentence_count('First sentence. Second one here!')").first()
    assert tuple(got) == (True, 2, "ar", "what is it", 2)
