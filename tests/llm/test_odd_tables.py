"""Every query of the training-data problems on empty tables, on rows of nulls, on repeated rows and beside columns whose
names clash with those that the operators use inside."""

import os

import pytest
from pyspark.sql import functions as F

from docspark.llm import queries

TYPES = {
    "sama_nora_chunks": "id string, document_id string, document_name string, page_start int, page_end int, section_title string, content string, embedding array<float>, token_count int, language string",
    "session_messages": "message_id string, session_id string, user_id string, user_message string, assistant_message string, timestamp timestamp",
    "session_feedback": "session_id string, user_id string, message_id string, feedback int, comments string, user_message string, assistant_message string",
    "answer_sources": "source_id bigint, message_id string, document_name string, page_start int, page_end int, section_title string, similarity double, snippet string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, document_name string, page_no int, fetched_at timestamp",
    "eval_items": "item_id bigint, question string, passage string, category string, expected string",
}
CLASHING = ("form", "f", "t", "h", "n", "k", "x", "r", "v", "s", "e", "at", "ch", "sub", "day", "word", "key", "kind", "link", "good", "rid", "near", "pos", "part", "base", "__id", "__text", "__key", "lang_", "mark", "role", "size")
NAMES = sorted(n for n in queries.QUERIES)


def _sentence(i):
    words = "the bank shall keep all records of every customer for ten years and must submit the annual report to the board of the authority".split()
    return " ".join(words[i % 5 :] + [f"under rule {i}"]).capitalize() + "."


def _rows(name):
    long = " ".join(_sentence(i) for i in range(40))
    if name == "sama_nora_chunks":
        texts = [_sentence(i) + ("\n" if i % 3 == 0 else " ") + _sentence(i + 1) for i in range(12)] + [long * 3, "", " ", None, _sentence(2).replace("e", "е"), _sentence(2), "x" * 2000]
        return [(f"c{i:02}", "d", "Rulebook" if i % 4 else None, i, i, None, t, [float((i * j) % 7) for j in range(64)] if i % 5 else None, 1, "en" if i % 2 else None) for i, t in enumerate(texts)]
    if name == "session_messages":
        return [(f"m{i:02}", f"S{i % 3} " if i % 4 else None, None, _sentence(i) if i % 5 else None, _sentence(i + 3) if i % 6 else "", f"2025-01-0{1 + i % 7} 00:00:00" if i % 7 else None) for i in range(30)]
    if name == "session_feedback":
        return [("s1", None, f"m{i:02}", i % 3, None, None, None) for i in range(0, 30, 4)]
    if name == "answer_sources":
        return [(i, f"m{i:02}", "Rulebook", i, i, None, 0.5, (_sentence(i) + "\n" + _sentence(i + 1))[: 60 + i] if i % 4 else None) for i in range(12)]
    if name == "documents":
        shared = " ".join(_sentence(i) for i in range(6))
        return [(i, {0: None, 1: "", 2: " "}.get(i, f"Document {i} begins here. {shared if i % 2 else _sentence(i)}"), None, None, None, "Rulebook", i, None) for i in range(12)]
    return [(i, _sentence(i) if i else None, _sentence(i + 7) if i != 3 else None, "regulatory", None) for i in range(6)]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for variant in ("plain", "empty", "nulls", "odd"):
        folder = tmp_path_factory.mktemp(variant)
        for name, kind in TYPES.items():
            loose = kind.replace("timestamp timestamp", "timestamp string").replace("fetched_at timestamp", "fetched_at string")
            df = spark.createDataFrame(_rows(name) if variant in ("plain", "odd") else [], loose)
            if variant in ("nulls", "odd"):
                df = df.unionByName(spark.createDataFrame([(None,) * len(df.columns)] * 3, loose))
            if variant == "odd":
                df = df.unionByName(df)
            for c in ("timestamp", "fetched_at"):
                if c in df.columns:
                    df = df.withColumn(c, F.to_timestamp(c))
            if variant == "odd":
                df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING if c not in df.columns])
            df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        out[variant] = str(folder)
    return out


def _found(spark, name, folder):
    if name == "p8_ids" and not os.environ.get("DOCSPARK_RANK_FILE"):
        pytest.importorskip("public_tokenizers")
    return sorted((tuple(r) for r in queries.QUERIES[name](spark, folder).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_and_nulls(spark, folders, name):
    assert _found(spark, name, folders["empty"]) == []
    nothing = _found(spark, name, folders["nulls"])
    assert nothing == ([(None, [])] * 3 if name == "p8_ids" else [])


@pytest.mark.parametrize("name", NAMES)
def test_repeated_rows_and_clashing_names(spark, folders, name):
    plain, odd = (_found(spark, name, folders[v]) for v in ("plain", "odd"))
    if name == "p8_ids":
        assert len(odd) == 2 * len(plain) + 6 and [r for r in odd if r[0] is not None][::2] == plain
    elif name.endswith("_found"):
        assert odd == plain
    else:
        assert set(map(repr, odd)) >= set(map(repr, plain)) or len(odd) >= len(plain)
