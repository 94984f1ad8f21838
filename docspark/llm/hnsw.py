"""The most similar vectors of every vector: a hierarchical navigable small-world graph per shard.

Equal vectors are searched once; their rows come back through their smallest ids, so a group of copies of any size costs
one search. Centroids, fitted on a bounded sample of vectors (``sample`` rows), send each vector to its shard; where the
sample shows that a shard would hold several times as many vectors as others, it gets more centroids, so hot regions become
several shards. In each shard a graph is built in growing batches and stored as flat neighbour arrays, one for each layer,
with its vectors; how wide a beam the graph needs is measured on a sample of its members. Each member is searched in its
own graph, from its own node; the similarity of its k-th neighbour then tells which other shards may well hold a better one (a shard lies
behind the plane midway between the two centroids), and the member is searched there as well, in up to ``probes`` shards,
nearest first: those whose plane is nearer than ``reach`` times the k-th neighbour, by 1 - similarity. New nodes and visitors
are compared with all nodes of a graph of up to ``SCANNED``, which costs less there than a walk. Similarities are
computed again in double precision, rounded to 6 decimals, and the results of the shards are merged, ties to the smaller id.

``exact=True`` is the exact way: shards are scanned instead of walked, and every shard is visited that can hold a better
vector, which the plane decides rigorously; it costs what it takes.

Shards have the size ``max(shard_size, sqrt(64 n))`` on average, so that neither the number of centroids that a vector is
compared with nor a shard grows in proportion to the collection.

Defined results: rows whose vector is null, of another width, all zero or not finite take no part; rows with a null id
take no part; a collection of one vector has no pairs; an empty one gives no rows; repeated ids count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docspark.session import written

NONE = np.float32(-4)
#: How many vectors visit a shard in one task.
VISITORS = 1 << 17
#: Up to so many nodes, comparing a new one or a visitor with all costs less than a walk, and misses none.
SCANNED = 16_384


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The best ``ef`` nodes for each row of ``q`` that a walk from its ``entry`` nodes finds: ids (-1: none) and
    similarities, best first. links: the neighbours of each node, -1 where there is none. What is noted for a block of rows
    and all nodes stays within a few megabytes."""
    padded = np.concatenate((links, np.full((1, links.shape[1]), -1, links.dtype)))  # the last row: of no node
    step = max(32, min(1024, (1 << 21) // (len(x) + 1)))
    if len(q) <= step:
        return _beam(x, padded, q, entry, ef, wide)
    parts = [_beam(x, padded, q[a : a + step], entry[a : a + step], ef, wide) for a in range(0, len(q), step)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _beam(x: np.ndarray, padded: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    b, n = len(q), len(x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for -1
    seen[np.arange(b)[:, None], entry] = True
    stamp = np.empty(b * (n + 1), np.int32)
    ids = np.full((b, ef), -1, np.int64)
    sims = np.full((b, ef), NONE, np.float32)
    k = min(entry.shape[1], ef)
    first = np.einsum("bd,bkd->bk", q, x[entry])
    first[entry < 0] = NONE
    top = np.argsort(-first, axis=1)[:, :k]
    ids[:, :k], sims[:, :k] = np.take_along_axis(entry, top, 1), np.take_along_axis(first, top, 1)
    done = ids < 0
    active = np.arange(b)
    wide = min(wide, ef)
    while len(active):
        open_sims = np.where(done[active], NONE, sims[active])
        pick = np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide] if wide < ef else np.tile(np.arange(ef), (len(active), 1))
        live = np.take_along_axis(open_sims, pick, 1) > NONE
        going = live.any(1)
        if not going.all():
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
        nodes = np.where(live, ids[active[:, None], pick], n)
        done[active[:, None], pick] = True
        near = padded[nodes].reshape(len(active), -1)
        row, column = np.nonzero(~seen[active[:, None], near])
        if not len(row):
            continue
        node, who = near[row, column], active[row]
        place = who * (n + 1) + node
        stamp[place] = np.arange(len(place), dtype=np.int32)
        once = stamp[place] == np.arange(len(place), dtype=np.int32)  # of what comes twice the last
        row, node, who = row[once], node[once], who[once]
        seen[who, node] = True
        count = np.bincount(row, minlength=len(active))
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        width = int(count.max())
        new_ids = np.full((len(active), width), -1, np.int64)
        new_ids[row, at] = node
        new_sims = np.matmul(x[new_ids], q[active][:, :, None])[:, :, 0]
        new_sims[new_ids < 0] = NONE
        all_ids = np.concatenate((ids[active], new_ids), 1)
        all_sims = np.concatenate((sims[active], new_sims), 1)
        all_done = np.concatenate((done[active], new_ids < 0), 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
    top = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)


def spread(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of each row's candidates (best first) up to ``m`` neighbours: those nearer to the row's own node than to a
    neighbour chosen before them; what room is left goes to the best of the others."""
    b, c = ids.shape
    v = x[ids]
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros((b, c), bool)
    closest = np.full((b, c), NONE, np.float32)
    count = np.zeros(b, np.int64)
    for k in range(c):
        good = (ids[:, k] >= 0) & (sims[:, k] > closest[:, k]) & (count < m)
        taken[:, k] = good
        count += good
        if len(rows := np.flatnonzero(good)) and k + 1 < c:
            closest[rows, k + 1 :] = np.maximum(closest[rows, k + 1 :], between[rows, k, k + 1 :])
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return out if out.shape[1] == m else np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def scan(x: np.ndarray, q: np.ndarray, most: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``q`` the ``most`` best of all of ``x``, without the row ``own`` of it: ids and similarities, best first."""
    most = min(most, len(x) - (own is not None))
    step = max(1, min(1024, (1 << 21) // len(x)))
    ids, sims = np.empty((len(q), most), np.int64), np.empty((len(q), most), np.float32)
    for at in range(0, len(q) if most else 0, step):
        far = -(q[at : at + step] @ x.T)
        if own is not None:
            far[np.arange(len(far)), own[at : at + step]] = -NONE
        some = np.argpartition(far, most - 1, axis=1)[:, :most]
        far = np.take_along_axis(far, some, 1)
        top = np.argsort(far, axis=1, kind="stable")
        ids[at : at + step], sims[at : at + step] = np.take_along_axis(some, top, 1), -np.take_along_axis(far, top, 1)
    return ids, sims


class Graph:
    """Over unit vectors ``x``; ``m`` links a node in the upper layers, twice as many in the lowest."""

    def __init__(self, x: np.ndarray, m: int = 12, ef: int = 40, seed: int = 1):
        self.x, self.m = np.ascontiguousarray(x, np.float32), m
        n = len(x)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(1 - draw) / math.log(m)).astype(int), 12)
        self.order = np.argsort(-level, kind="stable")  # upper nodes first, so each layer is the front part of the order
        self.x = self.x[self.order]
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.layers: list[np.ndarray] = []  # flat neighbour arrays, lowest layer first
        for k, size in reversed(list(enumerate(sizes))):
            self.layers.insert(0, self._layer(size, 2 * m if k == 0 else m, ef))

    def _entry(self, q: np.ndarray) -> np.ndarray:
        """The nodes from which the layer below those that exist is entered."""
        at = np.zeros((len(q), 1), np.int64)
        for links in reversed(self.layers):
            at = beam(self.x[: len(links)], links, q, at, 8, 2)[0][:, :4]
        return at

    def _layer(self, size: int, width: int, ef: int) -> np.ndarray:
        x, links = self.x[:size], np.full((size, width), -1, np.int64)
        start = min(size, 64)
        s = x[:start] @ x[:start].T
        np.fill_diagonal(s, NONE)
        near = np.argsort(-s, axis=1, kind="stable")[:, : max(start - 1, 0)]
        if start > 1:
            links[:start] = spread(x, near, np.take_along_axis(s, near, 1), width)
        done = start
        while done < size:
            batch = np.arange(done, min(size, done + max(64, min(done // 4, 1024))))
            if done <= SCANNED:
                ids, sims = scan(x[: int(batch[-1]) + 1], x[batch], ef, batch)
            else:
                entry = self._entry(x[batch])
                entry = np.where(entry < done, entry, 0)
                ids, sims = beam(x[:done], links[:done], x[batch], entry, ef)
                s = x[batch] @ x[batch].T  # those that come together see each other as well
                np.fill_diagonal(s, NONE)
                mates = np.argsort(-s, axis=1, kind="stable")[:, :8]
                ids = np.concatenate((ids, batch[mates]), 1)
                sims = np.concatenate((sims, np.take_along_axis(s, mates, 1)), 1)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
                ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            links[batch] = spread(x, ids, sims, width)
            self._back(x, links, batch, width)
            done = int(batch[-1]) + 1
        return links

    @staticmethod
    def _back(x: np.ndarray, links: np.ndarray, batch: np.ndarray, width: int) -> None:
        """Links back from the new nodes' neighbours; where there are too many, the best spread stays."""
        to = links[batch]
        source, target = np.repeat(batch, to.shape[1]), to.ravel()
        real = target >= 0
        source, target = source[real], target[real]
        sims = np.einsum("ij,ij->i", x[source], x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        nth = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        keep = nth < width
        fresh = np.full((len(nodes), width), -1, np.int64)
        fresh[np.searchsorted(nodes, target[keep]), nth[keep]] = source[keep]
        most = np.argsort((fresh < 0).sum(1), kind="stable")  # those with as many new ones together
        nodes, fresh = nodes[most], fresh[most]
        for at in range(0, len(nodes), 512):
            own = nodes[at : at + 512]
            new = fresh[at : at + 512]
            ids = np.concatenate((links[own], new[:, : int((new >= 0).sum(1).max())]), 1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("bd,bkd->bk", x[own], x[ids])
            sims[ids < 0] = NONE
            top = np.argsort(-sims, axis=1, kind="stable")
            links[own] = spread(x, np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1), width)

    def search(self, q: np.ndarray, ef: int = 48, block: int = 1024, members: np.ndarray | None = None) -> np.ndarray:
        """Of each row of ``q`` the indices in the given vectors of about the ``ef`` best ones, -1: none. members: the rows are
        these of the given vectors, so the walks start at themselves."""
        out = []
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        for at in range(0, len(q), block):
            part = np.ascontiguousarray(q[at : at + block], np.float32)
            if members is not None:
                entry = place[members[at : at + block], None]
            else:
                entry = np.zeros((len(part), 1), np.int64)
                for links in reversed(self.layers[1:]):
                    entry = beam(self.x[: len(links)], links, part, entry, 8, 2)[0][:, :4]
            ids = beam(self.x, self.layers[0], part, entry, ef)[0]
            out.append(np.where(ids >= 0, self.order[ids], -1))
        return np.concatenate(out) if out else np.empty((0, ef), np.int64)

    def visited(self, q: np.ndarray, ef: int = 48) -> np.ndarray:
        """As :meth:`search`, for vectors from elsewhere, of whose best ones walks miss more: few nodes are all compared."""
        return self.order[scan(self.x, np.ascontiguousarray(q, np.float32), ef)[0]] if len(self.x) <= SCANNED else self.search(q, ef)


def wide_enough(graph: Graph, x: np.ndarray, k: int, ef: int, target: float, sample: int = 512) -> int:
    """The width of the beam, ``ef`` or half as much again and so on, that finds ``target`` of the ``k`` nearest of ``sample`` vectors of
    the graph's own, which are compared with all. Dense regions need wider beams than others."""
    some = np.unique(np.linspace(0, len(x) - 1, min(len(x), sample)).astype(int))
    s = x[some] @ x.T
    s[np.arange(len(some)), some] = -9
    k = min(k, len(x) - 1)
    if k < 1:
        return ef
    last = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 1e-9
    while ef < len(x):
        ids = graph.search(x[some], ef, members=some)
        found = (np.take_along_axis(s, ids, 1) >= last) & (ids >= 0)
        if np.minimum(found.sum(1), k).mean() >= target * k:
            break
        ef = ef * 3 // 2
    return ef


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """``k`` directions, fitted to the unit vectors of ``sample``; dense regions get more of them."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 0):
        near = _nearest(sample, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1)
        c[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return c.astype(np.float32)


def split_hot(sample: np.ndarray, c: np.ndarray, n: int, size: int, limit: int) -> np.ndarray:
    """``c`` with more centroids where the sample says that more than ``limit`` of ``n`` vectors lie: as many as parts of
    ``size``, fitted to what lies there."""
    if len(c) < 2 and n <= limit or not len(c):
        return c
    near = _nearest(sample.astype(np.float32), c, 1)[:, 0]
    out = []
    for i in range(len(c)):
        mine = sample[near == i]
        share = len(mine) * n / max(1, len(sample))
        out.append(centroids(mine, math.ceil(share / size), seed=i + 2) if share > limit else c[i : i + 1])
    return np.concatenate(out)


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    out = []
    for at in range(0, len(x), 4096):
        s = x[at : at + 4096] @ c.T
        out.append(np.argsort(-s, axis=1, kind="stable")[:, :k] if k > 1 else s.argmax(1)[:, None])
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Stored(Graph):
    """A graph from its flat arrays."""

    def __init__(self, x: np.ndarray, order: np.ndarray, layers: list[np.ndarray]):
        self.x, self.order, self.layers = x, order, layers

    @staticmethod
    def load(vectors: bytes, order: bytes, links: bytes, widths: list[int], sizes: list[int], width: int) -> Stored:
        flat, layers, at = np.frombuffer(links, np.int32), [], 0
        for w, size in zip(widths, sizes, strict=True):
            layers.append(flat[at : at + w * size].reshape(size, w).astype(np.int64))
            at += w * size
        x = unit(np.frombuffer(vectors, np.float32).reshape(-1, width)).astype(np.float32)
        return Stored(x, np.frombuffer(order, np.int32).astype(np.int64), layers)


_OUT = (
    "shard int, sub int, r long, near array<long>, sim array<double>, rid string, many boolean, h1 long, h2 long, v array<float>, "
    "vectors binary, order_ binary, links binary, widths array<int>, sizes array<int>, own array<long>, rids array<string>, ef int, kth double"
)


def neighbours(
    rows: DataFrame, id_col: str = "id", vector_col: str = "embedding", k: int = 5, width: int = 64, probes: int = 8, reach: float = 0.1,
    shard_size: int = 2_048, sample: int = 50_000, ef: int = 12, build_ef: int = 48, m: int = 16, target: float = 0.999, exact: bool = False,
) -> DataFrame:
    """(id, neighbour, similarity): of each usable row the ``k`` rows with the most similar vectors, not itself."""
    v = F.col("v")
    usable = (
        rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        .where(F.col("id").isNotNull() & (F.size(v) == width))
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    )
    some = usable.select("v")
    if (n := usable.count()) > sample:
        some = some.sample(fraction=min(1.0, 1.1 * sample / n), seed=1).limit(sample)
    size = max(shard_size, int(math.sqrt(64 * n)))
    known = unit(np.unique(_matrix(some.toArrow().column(0).combine_chunks(), width), axis=0)) if n else np.empty((0, width))
    limit = 4 * size
    fitted = split_hot(known, centroids(known, max(1, round(n / size))), n, size, limit)
    share = np.bincount(_nearest(known.astype(np.float32), fitted, 1)[:, 0], minlength=1) * (n / max(1, len(known)))
    # Where even more centroids don't part the vectors, a hash of them does.
    subs = [max(1, math.ceil(x / limit)) for x in share.tolist()]
    numbers = F.array(*[F.lit(x) for x in subs])  # for each centroid
    print_ = (F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v")).alias("h2"))
    # Copies are put together within batches first, then where their shard is, so that vectors are shuffled once.
    reps = (
        _assigned(usable.select("id", *print_, "v"), fitted, width)
        .withColumn("sub", F.pmod(F.col("h1"), F.element_at(numbers, F.col("shard") + 1)).cast("int"))
        .repartition("shard", "sub")
        .groupBy("shard", "sub", "h1", "h2")
        .agg(F.min("least").alias("rid"), (F.min("least") < F.max("most")).alias("many"), F.first("v").alias("v"))
    )
    built = (
        reps.sortWithinPartitions("shard", "sub")
        .select("shard", "sub", "rid", "many", "h1", "h2", "v")
        .mapInArrow(_build(k, width, ef, build_ef, m, target, fitted, subs, len(fitted) if exact else probes, reach, exact), _OUT)
    )
    built = written(built, "graphs")
    visits = built.where("v is not null").select("shard", "sub", "r", "v", "kth")
    blobs = built.where("vectors is not null").select("shard", "sub", "vectors", "order_", "links", "widths", "sizes", "own", "rids", "ef")
    # A shard with many visitors is read by several tasks.
    # One row for each shard, of which there are at most about sqrt(n / 64).
    tasks = visits.groupBy("shard", "sub").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("tasks"))
    tasks = F.broadcast(tasks)
    visits = visits.join(tasks, ["shard", "sub"]).withColumn("task", F.pmod(F.xxhash64("r"), F.col("tasks")).cast("int")).drop("tasks")
    blobs = blobs.join(tasks, ["shard", "sub"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    by = ["shard", "sub", "task"]
    blobs = blobs.select(*[F.col(c).alias(f"b_{c}") for c in by], *[c for c in blobs.columns if c not in by])
    visits = visits.select(*[F.col(c).alias(f"v_{c}") for c in by], "r", "v", "kth")
    reps = built.where("near is not null")
    seen = visits.groupBy(*[f"v_{c}" for c in by]).cogroup(blobs.groupBy(*[f"b_{c}" for c in by])).applyInArrow(_visit(k, width, exact), "r long, near array<long>, sim array<double>")
    found = reps.select("r", "near", "sim").unionByName(seen)
    every = F.array_sort(F.flatten(F.collect_list(F.zip_with("near", "sim", lambda a, b: F.struct((-b).alias("far"), a.alias("o"))))))
    merged = found.groupBy("r").agg(every.alias("every"))
    # Neighbours as far as the last one stay until their ids are known.
    last = F.when(F.size("every") > k, F.element_at("every", k)["far"]).otherwise(2.0)
    merged = merged.select("r", F.filter("every", lambda x: x["far"] <= last).alias("best"))
    # From vectors to rows: the smallest ids of each vector stand for it, as no more can be needed.
    many = reps.where("many").select("h1", "h2", "r")
    copies = usable.select("id", *print_).join(many, ["h1", "h2"]).select("r", "id").distinct()
    least = copies.withColumn("nth", F.row_number().over(Window.partitionBy("r").orderBy("id"))).where(F.col("nth") <= k + 1)
    ids = reps.where("not many").select("r", F.col("rid").alias("id")).unionByName(least.select("r", "id"))
    near = merged.select("r", F.explode("best").alias("x")).select("r", F.col("x.o").alias("o"), F.col("x.far").alias("far"))
    near = near.join(ids.select(F.col("r").alias("o"), F.col("id").alias("to")), "o").select("r", "far", "to")
    near = near.unionByName(least.select("r", F.lit(-1.0).alias("far"), F.col("id").alias("to")))
    lists = near.groupBy("r").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "to"))), 1, k + 1).alias("best"))
    everyone = reps.where("not many").select("r", F.col("rid").alias("id")).unionByName(copies)
    return (
        everyone.join(lists, "r")
        .select("id", F.explode(F.slice(F.filter("best", lambda x: x["to"] != F.col("id")), 1, k)).alias("x"))
        .select("id", F.col("x.to").alias("neighbour"), (-F.col("x.far")).alias("similarity"))
    )


def _assigned(rows: DataFrame, fitted: np.ndarray, width: int) -> DataFrame:
    """rows: (id, h1, h2, v). (least, most, h1, h2, v, shard): one row for each vector of a batch, told by its hashes, with the
    least and the greatest of its ids."""
    kinds = {f.name: f.dataType for f in rows.schema}
    names = ["least", "most", "h1", "h2", "v", "shard"]
    types = [kinds["id"], kinds["id"], kinds["h1"], kinds["h2"], kinds["v"], T.IntegerType()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = most = batch.column(0)
            h1, h2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((h2, h1))
            first = np.ones(len(order), bool)
            first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            if not first.all():
                ids, starts = least.to_pylist(), np.flatnonzero(first)
                groups = [[ids[i] for i in g] for g in np.split(order, starts[1:])]
                least, most = pa.array([min(g) for g in groups], least.type), pa.array([max(g) for g in groups], least.type)
                batch = batch.take(pa.array(order[starts]))
            near = _nearest(unit(_matrix(batch.column(3), width)).astype(np.float32), fitted, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([least, most, batch.column(1), batch.column(2), batch.column(3), pa.array(near.astype(np.int32))], names=names)

    return rows.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def _ranked(q: np.ndarray, ids: np.ndarray, exact: np.ndarray, own: np.ndarray, place: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the found indices the ``k`` best by exact similarity, rounded, then by the place of their ids: (r, similarity)."""
    sims = np.round(np.einsum("bd,bkd->bk", q, exact[ids]), 6)
    sims[(ids < 0) | (own[ids] == r[:, None])] = -9
    order = np.lexsort((place[ids], -sims), axis=1)[:, :k]
    return np.take_along_axis(own[ids], order, 1), np.take_along_axis(sims, order, 1)


def _lists(near: np.ndarray, sims: np.ndarray) -> tuple[pa.Array, pa.Array]:
    real = sims > -9
    offsets = pa.array(np.append(0, np.cumsum(real.sum(1))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(near[real])), pa.ListArray.from_arrays(offsets, pa.array(sims[real]))


def _places(rids: list[str]) -> np.ndarray:
    out = np.empty(len(rids), np.int64)
    out[sorted(range(len(rids)), key=rids.__getitem__)] = np.arange(len(rids))
    return out


def _scan(q: np.ndarray, exact: np.ndarray, most: int) -> np.ndarray:
    """Of each row of ``q`` the indices of the ``most`` rows with the highest similarity, and those as good as the last."""
    s = np.round(q @ exact.T, 6)
    if s.shape[1] <= most:
        return np.broadcast_to(np.arange(s.shape[1]), s.shape)
    last = -np.partition(-s, most - 1, axis=1)[:, most - 1 : most]
    fit = s >= last
    wide = int(fit.sum(1).max())
    order = np.argsort(~fit, axis=1, kind="stable")[:, :wide]
    return np.where(np.take_along_axis(fit, order, 1), order, -1)


def _step(n: int) -> int:
    """How many queries are compared with ``n`` vectors at once."""
    return max(1, min(512, (1 << 25) // max(1, n)))


def _build(
    k: int, width: int, ef: int, build_ef: int, m: int, target: float, fitted: np.ndarray, subs: list[int], probes: int, reach: float, exhaustive: bool
):
    schema = to_arrow_schema(T._parse_datatype_string(_OUT))

    def batch(rows: int, **columns: object) -> pa.RecordBatch:
        given = [(columns.get(f.name), f.type) for f in schema]
        return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in given], schema=schema)

    def shard(shard: int, sub: int, first: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rids, v = rows.column(2).to_pylist(), _matrix(rows.column(6), width)
        r = np.arange(first, first + len(v))
        exact, place = unit(v), _places(rids)
        graph = Graph(exact, m, build_ef)
        beam_ = 0 if exhaustive else wide_enough(graph, exact, k, ef, target)
        if exhaustive:
            step = _step(len(r))
            parts = [_ranked(exact[a : a + step], _scan(exact[a : a + step], exact, k + 1), exact, r, place, r[a : a + step], k) for a in range(0, len(r), step)]
            wide = max(p[1].shape[1] for p in parts)
            near, sims = (np.concatenate([np.pad(p[i], ((0, 0), (0, wide - p[i].shape[1])), constant_values=-9) for p in parts]) for i in (0, 1))
        else:
            near, sims = _ranked(exact, graph.search(exact, beam_, members=np.arange(len(exact))), exact, r, place, r, k)
        lists = _lists(near, sims)
        yield batch(len(r), r=r, near=lists[0], sim=lists[1], rid=rows.column(2), many=rows.column(3), h1=rows.column(4), h2=rows.column(5))
        links = np.concatenate([x.ravel() for x in graph.layers]).astype(np.int32)
        yield batch(
            1, shard=[shard], sub=[sub], vectors=[v[graph.order].astype(np.float32).tobytes()], order_=[graph.order.astype(np.int32).tobytes()], links=[links.tobytes()],
            widths=[[x.shape[1] for x in graph.layers]], sizes=[[len(x) for x in graph.layers]], own=[r.tolist()], rids=[rids], ef=[beam_],
        )
        # Where else: the sine of the angle to the plane between the centroids bounds the similarity behind it.
        c = fitted.astype(np.float64)
        apart = np.linalg.norm(c - c[shard], axis=1)
        sine = ((exact @ c[shard])[:, None] - exact @ c.T) / np.maximum(apart, 1e-12)
        bound = np.sqrt(np.maximum(0, 1 - np.maximum(sine, 0) ** 2))
        kth = np.maximum(sims[:, k - 1], -1) if sims.shape[1] >= k else np.full(len(r), -1.0)
        bound[:, shard] = -9
        best = np.argsort(-bound, axis=1, kind="stable")[:, :probes]
        far = np.where(kth > -1, 1 - kth if exhaustive else reach * (1 - kth), 3)[:, None]
        who, nth = np.nonzero(1 - np.take_along_axis(bound, best, 1) <= far + 1e-6)
        to = best[who, nth]
        # (member, shard, part of it) of the visits, a block of members of one target at a time.
        visits = [(who[to == t], t, x) for t in np.unique(to).tolist() if t != shard for x in range(subs[t])]
        visits += [(np.arange(len(r)), shard, x) for x in range(subs[shard]) if x != sub]
        raw = v.astype(np.float32)
        for members, t, x in visits:
            for at in range(0, len(members), 10_000):
                w = members[at : at + 10_000]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * width), pa.array(raw[w].ravel()))
                yield batch(len(w), shard=np.full(len(w), t, np.int32), sub=np.full(len(w), x, np.int32), r=r[w], v=flat, kth=kth[w])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wait, first = None, [], TaskContext.get().partitionId() << 40

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal first, wait
            if wait:
                rows = pa.Table.from_batches(wait).combine_chunks().to_batches()[0]
                yield from shard(*key, first, rows)
                first, wait = first + rows.num_rows, []

        for b in batches:
            names = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), len(names)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if (now := tuple(names[a].tolist())) != key:
                    yield from done()
                    key = now
                wait.append(b.slice(a, z - a))
        yield from done()

    return run


def _visit(k: int, width: int, exhaustive: bool):
    def run(visits: pa.Table, blob: pa.Table) -> pa.Table:
        names = ["r", "near", "sim"]
        if not visits.num_rows or not blob.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))], names=names)
        one = {c: blob.column(c)[0].as_py() for c in blob.column_names}
        graph = Stored.load(one["vectors"], one["order_"], one["links"], one["widths"], one["sizes"], width)
        own, place = np.array(one["own"], np.int64), _places(one["rids"])
        exact = np.empty((len(own), width))
        exact[graph.order] = unit(np.frombuffer(one["vectors"], np.float32).reshape(-1, width))
        r, v = visits.column("r").combine_chunks().to_numpy(), _matrix(visits.column("v").combine_chunks(), width)
        kth = visits.column("kth").combine_chunks().to_numpy()
        parts = []
        block = _step(len(own)) if exhaustive else 4096
        for at in range(0, len(r), block):
            q = unit(v[at : at + block])
            near, sims = _ranked(q, _scan(q, exact, k) if exhaustive else graph.visited(q, one["ef"]), exact, own, place, r[at : at + block], k)
            sims[sims < kth[at : at + block, None]] = -9  # what the member has better ones than
            some = (sims > -9).any(1)
            parts.append(pa.Table.from_arrays([pa.array(r[at : at + block][some]), *_lists(near[some], sims[some])], names=names))
        return pa.concat_tables(parts)

    return run
