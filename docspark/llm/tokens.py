"""Encoding of a corpus with a public byte-level vocabulary (tiktoken with a local rank file).

The rank file is a parameter: base64 token, space, id on each line; it is sent to the executors. Long texts are cut at places
where the pre-splitting pattern cuts in any case (a space or a line end between two visible characters, and where letters,
digits and signs meet), so that a text's ids don't depend on the cutting.

Defined results: an empty text and a null text both get an empty list of ids; no row is dropped or repeated; equal rows
get equal ids. Control strings such as ``<|endoftext|>`` in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.session import ship_file

#: Fixed value: the pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN = 20_000
# Places: before a lone space, behind a lone line end, behind letters before anything else that is visible, behind digits likewise.
# Not behind a sign before a letter, as an apostrophe takes some letters with it.
_SAFE = regex.compile(r"(?<=\S)(?= \S)|(?<=\S\n)(?=\S)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str = PATTERN):
    import tiktoken

    lines = Path(rank_file).read_bytes().split(b"\n")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(Path(rank_file).name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only where the pattern cuts as well."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(text: str | None, rank_file: str, pattern: str = PATTERN, span: int = SPAN) -> list[int]:
    if not text:
        return []
    enc = encoding(rank_file, pattern)
    if len(text) <= span:
        return enc.encode_ordinary(text)
    return [i for piece in spans(text, span) for i in enc.encode_ordinary(piece)]


def decode_bytes(ids: list[int], rank_file: str, pattern: str = PATTERN) -> bytes:
    """The raw bytes of ``ids``: what was encoded, in UTF-8."""
    return encoding(rank_file, pattern).decode_bytes(list(ids))


def encode_corpus(
    docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN, span: int = SPAN
) -> DataFrame:
    """(id_col, ids array<int>), a row for each row of ``docs``; one pass, no shuffle."""
    slim = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    name = ship_file(docs.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_file = SparkFiles.get(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = [np.asarray(encode_text(t, rank_file, pattern, span), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return slim.mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", pattern: str = PATTERN) -> DataFrame:
    """(id_col, text) of the rows of :func:`encode_corpus`; null ids give the empty text."""
    name = ship_file(encoded.sparkSession, rank_file)
    slim = encoded.select(F.col(id_col), F.col("ids"))
    schema = T.StructType([T.StructField(id_col, slim.schema[0].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_file = SparkFiles.get(name)
        for batch in batches:
            texts = [decode_bytes(x or [], rank_file, pattern).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return slim.mapInArrow(run, schema)
