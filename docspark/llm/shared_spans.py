"""Long stretches of text that stand verbatim in more than one record: prefix-partitioned suffix trees.

Suffixes are taken at positions that the text itself chooses (the minima of a rolling hash over windows of ``WINDOW``
positions), so that two equal stretches of ``length`` characters hold a chosen position at the same place. Each suffix
carries its left context, back to the first stretch that has its minimum there, and ``length`` characters to the right;
that suffices for every stretch of ``length`` characters, as the minimum in it decides which suffix stands for it.

1. Suffixes are counted by their prefix of ``PREFIX`` characters; a prefix that only one record has roots no shared node.
2. The suffixes of the other prefixes are grouped by prefix, and each group's tree is walked: nodes are intervals of the
   sorted suffixes, and of every node that two records share, the left contexts say how far the repeat goes back.
3. Prefixes with more than ``group_limit`` suffixes are lengthened to the full depth of the tree: each stretch of
   ``length`` characters is a prefix of its own (a 128-bit fingerprint), of which only the first and the last record are
   needed. These are aggregated before the shuffle, so no group is ever held by one task.

Defined results: null, empty and short texts share nothing; a repeat within one record doesn't count; records with equal
text share all of it, if it is long enough; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docspark.session import written

LENGTH = 300
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
BATCH_CHARS = 1_000_000


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of ``base`` and of its inverse, modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) <= n:
        size = 1 << max(n, 1 << 16).bit_length()

        def powers(b: int) -> np.ndarray:
            out = np.ones(size, np.uint64)
            step = 1
            while step < size:
                out[step : 2 * step] = out[:step] * np.uint64(pow(b, step, 1 << 64))
                step *= 2
            return out

        _POWERS[base] = known = powers(base), powers(pow(base, -1, 1 << 64))
    return known


def rolling(codes: np.ndarray, k: int, salt: int = 1, base: int = BASE) -> np.ndarray:
    """Of each position a hash of the ``k`` code points from it on: equal pieces have equal hashes in every text."""
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    power, inverse = _powers(n, base)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_mixed(codes.astype(np.uint64), salt) * power[:n], out=total[1:])
    out = (total[k:] - total[:-k]) * inverse[: n - k + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Of each window of ``w`` values its least one."""
    out, size = h, 1
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < w:
        out = np.minimum(out[: len(out) - (w - size)], out[w - size :])
    return out


def chosen(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of ``h`` that are the first minimum of some window of ``w`` values, rising, and of each the start of
    the first such window. The minimum is that of the upper 36 bits, so that a text may have 2^28 characters."""
    if len(h) < w:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.uint64((1 << 28) - 1)
    least = _minimum((h & ~low) | (np.arange(len(h), dtype=np.uint64) & low), w) & low
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[first].astype(np.int64), first


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def anchors(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen positions of ``text``, the starts of the first stretches that they stand for, and the hashes of their
    prefixes. Prefix and window share ``length``."""
    prefix = length // 3
    h = rolling(_codes(text), prefix)
    at, first = chosen(h, length - prefix + 1)
    return at, first, h[at].view(np.int64)


def _common(a: str, b: str) -> int:
    """The length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low if low < n and a[low] != b[low] else high


def tree_spans(suffixes: list[tuple], length: int = LENGTH) -> Iterator[tuple]:
    """(record, start, end) of the repeats of ``length`` or more through the given suffixes, which have one prefix in
    common. suffixes: (record, position, left context reversed, right context)."""
    order = sorted(suffixes, key=lambda x: x[3])
    n = len(order)
    depth = [_common(order[i - 1][3], order[i][3]) for i in range(1, n)] + [0]
    stack: list[tuple[int, int]] = []  # (depth, first suffix) of the open nodes
    for i, d in enumerate(depth):
        first = i
        while stack and stack[-1][0] > d:
            node, first = stack.pop()
            yield from _node_spans(order[first : i + 1], node, length)
        if d and (not stack or stack[-1][0] < d):
            stack.append((d, first))


def _node_spans(members: list[tuple], depth: int, length: int) -> Iterator[tuple]:
    """The repeats of one node: its suffixes agree on ``depth`` characters; those that agree to the left as well, with a
    suffix of another record, make a repeat."""
    need = max(0, length - depth)
    if len(members) > 2:
        members = sorted(members, key=lambda x: x[2])
    n = len(members)
    back = [_common(members[i - 1][2], members[i][2]) for i in range(1, n)]
    best = [-1] * n
    for step in (range(1, n), range(n - 2, -1, -1)):
        least = -1  # how far the nearest suffix of another record on this side agrees
        for i in step:
            j = i - 1 if step.step > 0 else i + 1
            agree = back[min(i, j)]
            least = agree if members[i][0] != members[j][0] else min(agree, least)
            best[i] = max(best[i], least)
    for (record, at, _, _), left in zip(members, best, strict=True):
        if left >= need:
            yield record, at - left, at + depth


def shared_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group_limit: int = 2_000
) -> DataFrame:
    """(id_col, span_start, span_end): each record's maximal stretches, in characters from 0, end exclusive, all of whose
    characters lie in runs of at least ``length`` characters that another record has as well."""
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.length("__text") >= length)
    id_type = slim.schema[0].dataType
    suffixes = slim.mapInArrow(_anchor_rows(length, id_type), _schema(("h", T.LongType()), ("__id", id_type), ("at", T.IntegerType()), ("before", T.IntegerType())))
    suffixes = written(suffixes, "suffixes")
    roots = (
        suffixes.groupBy("h")
        .agg(F.count("*").alias("n"), F.min("__id").alias("a"), F.max("__id").alias("b"))
        .where("a <> b")
        .select("h", (F.col("n") > group_limit).alias("hot"))
    )
    wanted = (
        suffixes.join(roots, "h")
        .groupBy("__id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "before", "h", "hot"))).alias("places"))
    )
    parts = slim.join(wanted, "__id").mapInArrow(
        _context_rows(length, id_type),
        _schema(
            ("h", T.LongType()), ("f1", T.LongType()), ("f2", T.LongType()), ("__id", id_type), ("at", T.IntegerType()),
            ("left", T.StringType()), ("right", T.StringType()),
        ),
    )
    parts = written(parts, "contexts")
    out = _schema(("__id", id_type), ("s", T.LongType()), ("e", T.LongType()))
    cool = (
        parts.where("h is not null")
        .repartition("h")
        .sortWithinPartitions("h")
        .select("h", "__id", "at", "left", "right")
        .mapInArrow(_tree_rows(length, id_type), out)
    )
    windows = parts.where("h is null")
    full = windows.groupBy("f1", "f2").agg(F.min("__id").alias("a"), F.max("__id").alias("b")).where("a <> b")
    hot = windows.join(full.select("f1", "f2"), ["f1", "f2"]).select("__id", F.col("at").cast("long").alias("s"), (F.col("at") + length).cast("long").alias("e"))
    # Spans that touch or overlap are one: a new one begins beyond all ends before it.
    order = Window.partitionBy("__id").orderBy("s", "e")
    so_far = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = cool.unionByName(hot).withColumn("new", F.when(so_far.isNull() | (F.col("s") > so_far), 1).otherwise(0))
    parted = marked.withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parted.groupBy("__id", "nth").agg(F.min("s").alias("span_start"), F.max("e").alias("span_end"))
    return merged.select(F.col("__id").alias(id_col), "span_start", "span_end")


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


def _anchor_rows(length: int, id_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                at, hashes, before, size = [], [], [], []
                for text in part.column(1).to_pylist():
                    a, first, h = anchors(text, length)
                    at.append(a)
                    hashes.append(h)
                    before.append(a - first)
                    size.append(len(a))
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
                columns = [pa.array(np.concatenate(hashes)), ids, *(pa.array(np.concatenate(x).astype(np.int32)) for x in (at, before))]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "__id", "at", "before"])

    return run


def _context_rows(length: int, id_type: T.DataType):
    names = ["h", "f1", "f2", "__id", "at", "left", "right"]
    types = [pa.int64(), pa.int64(), pa.int64(), to_arrow_type(id_type), pa.int32(), pa.string(), pa.string()]

    def rows(record: object, text: str, places: list[dict]) -> Iterator[tuple]:
        hot: list[np.ndarray] = []
        for p, after in zip(places, [*places[1:], None], strict=True):
            at, first = p["at"], p["at"] - p["before"]
            if p["hot"]:  # all the stretches that this position stands for, and maybe some more
                last = min(at, len(text) - length, after["at"] - after["before"] - 1 if after else at)
                hot.append(np.arange(first, last + 1))
            else:
                yield p["h"], None, None, record, at, text[first:at][::-1], text[at : at + length]
        if hot:
            codes, starts = _codes(text), np.unique(np.concatenate(hot))
            f1, f2 = rolling(codes, length, 2).view(np.int64), rolling(codes, length, 3, 0xA0761D6478BD642F | 1).view(np.int64)
            for s in starts.tolist():
                yield None, int(f1[s]), int(f2[s]), record, s, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                for record, text, places in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    for row in rows(record, text, places):
                        now.append(row)
                        if len(now) >= 5_000:
                            yield _batch(now, names, types)
                            now = []
        if now:
            yield _batch(now, names, types)

    return run


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _tree_rows(length: int, id_type: T.DataType):
    types = [to_arrow_type(id_type), pa.int64(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, group = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for h, *suffix in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    if h != key:
                        if len(group) > 1:
                            yield from tree_spans(group, length)
                        key, group = h, []
                    group.append(suffix)
        if len(group) > 1:
            yield from tree_spans(group, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list[tuple] = []
        for row in rows(batches):
            now.append(row)
            if len(now) >= 20_000:
                yield _batch(now, ["__id", "s", "e"], types)
                now = []
        if now:
            yield _batch(now, ["__id", "s", "e"], types)

    return run
