"""Finding the passages of held-out test items in a corpus by an FM-index per shard of documents.

A shard is a bounded run of documents of one partition (``shard_words``), so that no text is shuffled. Its words, folded
in case, become symbols: the words of the test items have one each, all others share the symbol 0, which ends every
match. The index of a shard has the suffix order (prefix doubling), the transformed text as a wavelet matrix with packed
bits and block counts, and a sample of suffix positions. All phrases of ``run`` words of the items are searched backward
at the same time; their occurrences are located by walking to sampled positions; neighbouring ones merge into spans.

The items are the stated query set: they are searched in blocks of ``block`` phrases, so that what is sent to the
executors at once has a fixed bound however many items there are.

Defined results: null and empty texts hold nothing; items with fewer than ``run`` words in question and passage are never
found; equal documents and equal items are each reported; an empty corpus or item table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RUN = 12
WORD = re.compile(r"[^\W_]+")
SAMPLE = 8


def words(text: str | None) -> list[str]:
    return WORD.findall(text.casefold()) if text else []


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` (which ends in 0) in the order of their suffixes. Zeros count as different symbols, the
    earlier the smaller, so that no comparison goes on behind a 0."""
    n = len(s)
    bits = max(int(s.max()).bit_length(), 1)
    m = min(max(62 // bits, 1), n)
    key = np.zeros(n, np.int64)
    ends = np.zeros(n, bool)  # a 0 within the first m symbols
    for k in range(m):
        key <<= bits
        key[: n - k] |= np.where(ends[: n - k], 0, s[k:])
        ends[: n - k] |= s[k:] == 0
    order = np.argsort(key, kind="stable")
    sorted_key, sorted_end = key[order], ends[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | sorted_end[1:]
    del key, sorted_key
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while True:
        tied = ~new | np.append(~new[1:], False)
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        second = rank[who + m]
        sub = np.lexsort((second, rank[who]))
        who = who[sub]
        order[at] = who
        k1, k2 = rank[who], second[sub]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        new[at] = fresh
        rank[who] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        m *= 2


class Bits:
    """A bit vector with constant-time counts of the ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Of a sequence of symbols that ends in 0; patterns hold no 0."""

    def __init__(self, s: np.ndarray, sample: int = SAMPLE):
        order = suffix_order(s)
        bwt = s[order - 1]
        self.counts = np.zeros(int(s.max()) + 2, np.int64)
        np.cumsum(np.bincount(s, minlength=len(self.counts) - 1), out=self.counts[1:])
        self.depth = max(int(s.max()).bit_length(), 1)
        self.levels: list[tuple[Bits, int]] = []
        for d in range(self.depth - 1, -1, -1):
            one = (bwt >> d) & 1 == 1
            self.levels.append((Bits(one), int(len(bwt) - one.sum())))
            bwt = np.concatenate((bwt[~one], bwt[one]))
        follows = np.empty(len(s), bool)  # walks end behind a 0 at the latest
        follows[0], follows[1:] = True, s[:-1] == 0
        kept = (order % sample == 0) | follows[order]
        self.sampled, self.positions = Bits(kept), order[kept]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``i`` places of the transformed text."""
        start, i = np.zeros_like(i), i.copy()
        for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> d) & 1 == 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``patterns`` the first place of the order whose suffix begins with it, and the place behind."""
        n = int(self.counts[-1])
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            absent = c >= len(self.counts) - 1
            base = self.counts[np.where(absent, 0, c)]
            lo[live] = np.where(absent, 0, base + self.rank(c, lo[live]))
            hi[live] = np.where(absent, 0, base + self.rank(c, hi[live]))
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        found = np.zeros(len(patterns), bool)
        found[live] = True
        return np.where(found, lo, 0), np.where(found, hi, 0)

    def locate(self, place: np.ndarray) -> np.ndarray:
        """The positions in the text of places of the suffix order."""
        out, steps = np.full(len(place), -1, np.int64), 0
        who, at = np.arange(len(place)), place.copy()
        while len(who):
            kept = self.sampled.get(at)
            out[who[kept]] = self.positions[self.sampled.rank(at[kept])] + steps
            who, at, steps = who[~kept], at[~kept], steps + 1
            i, symbol = at, np.zeros(len(at), np.int64)
            for bits, zeros in self.levels:
                one, before = bits.get(i), bits.rank(i)
                symbol = symbol * 2 + one
                i = np.where(one, zeros + before, i - before)
            start = np.zeros(len(at), np.int64)
            for d, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
                one = (symbol >> d) & 1 == 1
                before = bits.rank(start)
                start = np.where(one, zeros + before, start - before)
            at = self.counts[symbol] + i - start
        return out


def item_phrases(items: list[tuple[object, list[str | None]]], run: int = RUN) -> dict[tuple[str, ...], set[object]]:
    """Every run of ``run`` words within one of the texts of an item, with the ids of the items that have it."""
    out: dict[tuple[str, ...], set[object]] = {}
    for item, texts in items:
        for text in texts:
            w = words(text)
            for i in range(len(w) - run + 1):
                out.setdefault(tuple(w[i : i + run]), set()).add(item)
    return out


def _merged(at: np.ndarray, run: int) -> Iterator[tuple[int, int]]:
    """Spans of the sorted positions of phrases: those that touch or overlap are one."""
    start, end = int(at[0]), int(at[0]) + run
    for x in map(int, at[1:]):
        if x > end:
            yield start, end
            start = x
        end = x + run
    yield start, end


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_texts: tuple[str, ...] = ("question", "passage"),
    run: int = RUN,
    shard_words: int = 1_000_000,
    block: int = 200_000,
) -> DataFrame:
    """(id_col, item_col, span_start, span_end): for each document and item the maximal spans of the document, in
    characters from 0, end exclusive, that are covered by runs of ``run`` words of the item."""
    slim = docs.select(F.col(id_col), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull())
    asked = items.select(F.col(item_col), *[F.col(c).cast("string") for c in item_texts])
    schema = T.StructType(
        [
            T.StructField(id_col, slim.schema[0].dataType),
            T.StructField(item_col, asked.schema[0].dataType),
            T.StructField("span_start", T.LongType()),
            T.StructField("span_end", T.LongType()),
        ]
    )
    out: DataFrame | None = None
    for phrases in _blocks(asked, run, block):
        part = slim.mapInArrow(_searcher(phrases, run, shard_words, schema), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _blocks(asked: DataFrame, run: int, block: int) -> Iterator[dict[tuple[str, ...], set[object]]]:
    """The phrases of the items, read one partition at a time, in dictionaries of about ``block``."""
    now: dict[tuple[str, ...], set[object]] = {}
    for row in asked.toLocalIterator():
        for phrase, who in item_phrases([(row[0], list(row[1:]))], run).items():
            now.setdefault(phrase, set()).update(who)
        if len(now) >= block:
            yield now
            now = {}
    if now:
        yield now


def _searcher(phrases: dict[tuple[str, ...], set[object]], run: int, shard_words: int, schema: T.StructType):
    symbols = {w: i + 1 for i, w in enumerate(sorted({w for p in phrases for w in p}))}
    patterns = np.array([[symbols[w] for w in p] for p in phrases], np.int64)
    owners = [sorted(who) for who in phrases.values()]

    def shard(ids: list, texts: list[str], parts: list[np.ndarray]) -> pa.RecordBatch | None:
        # Each document's symbols end in a 0; of several in a row, and of runs too short for a match, one 0 is kept.
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=starts[1:])
        s = np.concatenate(parts)
        zero = np.flatnonzero(s == 0)
        before = np.diff(zero, prepend=-1) - 1  # symbols between this 0 and the one before
        keep = np.repeat(before >= run, before + 1)
        if not keep.any():
            return None
        index = FMIndex(s[keep])
        origin = np.flatnonzero(keep)
        lo, hi = index.search(patterns)
        size = hi - lo
        which = np.repeat(np.arange(len(patterns)), size)
        if not len(which):
            return None
        places = np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        at = origin[index.locate(places)]
        doc = np.searchsorted(starts, at, "right") - 1
        hits: dict[tuple[int, object], list[int]] = {}
        for d, p, a in zip(doc.tolist(), which.tolist(), (at - starts[doc]).tolist(), strict=True):
            for item in owners[p]:
                hits.setdefault((d, item), []).append(a)
        rows: list[tuple] = []
        limits: dict[int, list[tuple[int, int]]] = {}
        for (d, item), found in sorted(hits.items(), key=lambda x: x[0][0]):
            if d not in limits:
                limits = {d: word_limits(texts[d])}
            for a, b in _merged(np.unique(found), run):
                rows.append((ids[d], item, limits[d][a][0], limits[d][b - 1][1]))
        columns = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, parts, n = [], [], [], 0
        get = symbols.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    w = words(text)
                    if len(w) < run:
                        continue
                    ids.append(i)
                    texts.append(text)
                    parts.append(np.fromiter([get(x, 0) for x in w] + [0], np.int64, len(w) + 1))
                    n += len(w) + 1
                    if n >= shard_words:
                        if (found := shard(ids, texts, parts)) is not None:
                            yield found
                        ids, texts, parts, n = [], [], [], 0
        if parts and (found := shard(ids, texts, parts)) is not None:
            yield found

    return run_all


def word_limits(text: str) -> list[tuple[int, int]]:
    """Start and end, in characters of ``text``, of each of :func:`words`."""
    folded = text.casefold()
    if len(folded) == len(text):
        return [m.span() for m in WORD.finditer(folded)]
    origin = [i for i, c in enumerate(text) for _ in c.casefold()]
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORD.finditer(folded)]
