"""Splitting oversized texts at natural boundaries, range by range.

A text is taken in ranges of ``range_chars`` characters with halos, so no worker needs a whole text. Each worker finds the
boundaries in its range (runs of white space: with two line ends or more they part paragraphs, behind . ! ? ؟ sentences,
else words). A range ends at the best boundary in the last ``limit`` characters before its nominal end; the worker of the
next range sees the same characters in its halo and starts there. Pieces are cut greedily between these places, each at
the last paragraph, sentence or word boundary that fits, and begin up to ``overlap`` characters before the end of the
piece before, at a sentence or word. Piece numbers are prefix sums over the ranges' counts.

:func:`boundaries` stitches the ranges' tables: of each unit, the longest stretch between two boundaries, across ranges by
the end of the last boundary of the ranges before. :func:`split_files` does the same for files, whose workers read byte
ranges; ranges begin at whole characters, and character offsets are prefix sums of the ranges' lengths.

Defined results: null texts and texts of at most ``limit`` characters are not oversized and give no rows (of files every
one is split); a text without white space is cut at ``limit``, not within a character and its marks; a run of white space
longer than the halo (``limit``) counts by its first ``limit`` characters; the pieces' own parts make up the whole text.
Columns of ``keep`` come along whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LIMIT, OVERLAP, RANGE = 1_600, 200, 65_536
ENDS = ".!?؟"
UNITS = ("paragraph", "sentence", "word")
_SPACE = re.compile(r"\s+")


def breaks(text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
    """(start, end, unit) of the runs of white space of ``text`` that begin in [start, stop); unit 0, 1 or 2 of UNITS."""
    out = []
    at = start
    if 0 < start < len(text) and text[start - 1].isspace():  # belongs to the range before
        at = _SPACE.match(text, start).end() if text[start].isspace() else start
    for m in _SPACE.finditer(text, at):
        a, b = m.span()
        if a >= stop:
            break
        unit = 0 if text.count("\n", a, b) > 1 else 1 if a and text[a - 1] in ENDS else 2
        out.append((a, b, unit))
    return out


def _hard(text: str, at: int, least: int) -> int:
    """A place at or before ``at`` that doesn't part a character from its marks."""
    cut = at
    while cut > least and cut < len(text) and (unicodedata.combining(text[cut]) or text[cut] == "‍" or text[cut - 1] == "‍"):
        cut -= 1
    return cut if cut > least else at


def best_cut(found: list[tuple[int, int, int]], text: str, least: int, most: int) -> tuple[int, int]:
    """The cut in (least, most] at the coarsest boundary, the last of its kind, and its unit (3: none). A cut is behind
    the white space; paragraphs and sentences must fill half of the space, so that pieces don't become tiny."""
    for unit, floor in ((0, (least + most) // 2), (1, (least + most) // 2), (2, least)):
        ends = [b for _, b, u in found if u <= unit and floor < b <= most]
        if ends:
            return ends[-1], unit
    return _hard(text, most, least), 3


def cuts(text: str, start: int, stop: int, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(start of the piece with its overlap, start of its own part, end, unit of the boundary at its end)."""
    found = breaks(text, 0, len(text))
    first = 0
    while start < stop:
        while first < len(found) and found[first][1] <= start - overlap:
            first += 1
        near = []
        for x in found[first:]:
            if x[0] > start + limit:
                break
            near.append(x)
        back = start
        for unit in (1, 2):
            if back == start and start > 0:
                back = min((b for _, b, u in near if u <= unit and start - overlap <= b < start), default=start)
        room = back + limit
        if stop <= room:
            yield back, start, stop, 0
            return
        end, unit = best_cut([x for x in near if x[1] > start], text, start, room)
        yield back, start, end, unit
        start = end


def _range_cut(text: str, nominal: int, limit: int) -> int:
    """Where a range ends whose nominal end is ``nominal``: the same for both workers that see the characters around."""
    least = nominal - limit
    window = text[least - 1 : nominal + 1] if least else text[: nominal + 1]
    shift = least - 1 if least else 0
    found = [(a + shift, b + shift, u) for a, b, u in breaks(window, 1 if least else 0, len(window)) if b + shift <= nominal]
    return best_cut(found, text, least, nominal)[0]


def _ranges(texts: DataFrame, limit: int, range_chars: int) -> DataFrame:
    """(key columns, r, base, size, part): each range with ``limit`` + ``limit`` characters before and ``limit`` after. A text is
    cut into ranges in one pass; the halos come from the ranges beside."""
    others = [c for c in texts.columns if c != "__text"]
    cut = texts.select(*others, F.length("__text").alias("size"), F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{range_chars}}}"), 0).alias("ranges"))
    near = lambda x, i: F.coalesce(F.get(x, i), F.lit(""))
    whole = lambda x, i: F.concat(F.substring(near(x, i - 1), -2 * limit, 2 * limit), F.get(x, i), F.substring(near(x, i + 1), 1, limit))
    parts = F.transform("ranges", lambda _, i: F.struct(i.alias("r"), whole(F.col("ranges"), i).alias("part")))
    each = cut.select(*others, "size", F.explode(parts).alias("x"))
    return each.select(*others, "x.r", F.greatest(F.col("x.r") * range_chars - 2 * limit, F.lit(0)).alias("base"), "size", "x.part")


def _oversized(texts: DataFrame, key: str, text_col: str, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    kept = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    return texts.select(*kept, F.col(key).alias("__key"), F.col(text_col).alias("__text")).where(F.length("__text") > limit)


def boundaries(texts: DataFrame, key: str = "id", text_col: str = "content", limit: int = LIMIT, range_chars: int = RANGE) -> DataFrame:
    """(key, boundary): of each oversized text the coarsest unit of which none exceeds ``limit`` characters."""
    parts = _ranges(_oversized(texts, key, text_col, limit), limit, range_chars)
    key_type = parts.schema["__key"].dataType
    fields = [T.StructField("__key", key_type), *(T.StructField(c, T.LongType()) for c in ("r", "size"))]
    fields += [T.StructField(f"{c}{u}", T.LongType()) for u in range(3) for c in ("first", "last", "inner")]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, r, base, size, part in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                start = r * range_chars - base
                found = breaks(part, start, start + range_chars)
                row = [k, r, size]
                for unit in range(3):
                    own = [(a + base, b + base) for a, b, u in found if u <= unit]
                    inner = max((y[0] - x[1] for x, y in zip(own, own[1:])), default=0)
                    row += [own[0][0], own[-1][1], inner] if own else [None, None, 0]
                rows.append(row)
            columns = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    tables = parts.mapInArrow(run, schema)
    before = Window.partitionBy("__key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    gaps = tables.select(
        "__key",
        "size",
        *[
            F.struct(
                F.greatest(F.col(f"inner{u}"), F.col(f"first{u}") - F.coalesce(F.last(f"last{u}", True).over(before), F.lit(0))).alias("gap"),
                F.col(f"last{u}").alias("last"),
            ).alias(f"u{u}")
            for u in range(3)
        ],
    )
    longest = [F.greatest(F.coalesce(F.max(f"u{u}.gap"), F.lit(0)), F.max("size") - F.coalesce(F.max(f"u{u}.last"), F.lit(0))).alias(f"g{u}") for u in range(3)]
    most = gaps.groupBy("__key").agg(*longest)
    name = F.lit("none")
    for u in (2, 1, 0):
        name = F.when(F.col(f"g{u}") <= limit, UNITS[u]).otherwise(name)
    return most.select(F.col("__key").alias(key), name.alias("boundary"))


def pieces(
    texts: DataFrame, key: str = "id", text_col: str = "content", keep: tuple[str, ...] = ("page_start", "section_title"),
    limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int = RANGE,
) -> DataFrame:
    """(key, *keep, piece_no, piece_start, own_start, piece_end, boundary, piece): the pieces of the oversized texts, from
    1, in characters from 0. ``range_chars`` is at least three times ``limit``."""
    if range_chars < 3 * limit or overlap * 2 >= limit:
        raise ValueError("ranges must hold three pieces, and pieces two overlaps")
    parts = _ranges(_oversized(texts, key, text_col, limit, keep), limit, range_chars)
    along = [f"__keep{i}" for i in range(len(keep))] + ["__key"]  # these go through as they are
    names = [*along, "r", "nth", "piece_start", "own_start", "piece_end", "boundary", "piece"]
    made = [*[T.LongType()] * 5, T.StringType(), T.StringType()]
    schema = T.StructType([*(T.StructField(c, parts.schema[c].dataType) for c in along), *(T.StructField(n, t) for n, t in zip(names[len(along) :], made, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows, part_ = [], batch.slice(at, 256)
                for i, (r, base, size, part) in enumerate(zip(*(part_.column(len(along) + c).to_pylist() for c in range(4)), strict=True)):
                    start = _range_cut(part, r * range_chars - base, limit) if r else 0
                    nominal = (r + 1) * range_chars
                    stop = _range_cut(part, nominal - base, limit) if nominal < size else size - base
                    for n, (back, a, b, unit) in enumerate(cuts(part, start, stop, limit, overlap)):
                        kind = (*UNITS, "none")[unit]
                        rows.append((i, r, n, back + base, a + base, b + base, kind, part[back:b]))
                if rows:
                    who, *columns = zip(*rows, strict=True)
                    who = pa.array(who)
                    yield pa.RecordBatch.from_arrays(
                        [*(part_.column(c).take(who) for c in range(len(along))), *(pa.array(c, to_arrow_type(t)) for c, t in zip(columns, made, strict=True))], names=names
                    )

    cut = parts.mapInArrow(run, schema)
    counts = cut.groupBy("__key", "r").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__key").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__key", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(counts, ["__key", "r"]).withColumn("piece_no", (F.col("base") + F.col("nth") + 1).cast("int"))
    return numbered.select(
        F.col("__key").alias(key), *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], "piece_no", "piece_start", "own_start", "piece_end", "boundary", "piece"
    )


def split_files(spark, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 1 << 20) -> DataFrame:
    """(path, piece_no, own_start, own_end, boundary, piece) of text files in UTF-8, or of those in folders, on any file
    system that pyarrow reads: each worker opens a file at its byte range and reads no more than that and the halos. Files are
    listed and ranges are made by the executors. own_start and own_end are characters from 0."""
    names = ["path", "r", "nth", "own_start", "own_end", "chars", "boundary", "piece"]
    schema = "path string, r long, nth long, own_start long, own_end long, chars long, boundary string, piece string"

    def whole(data: bytes) -> tuple[int, str]:
        """How many bytes of a cut character stand in front, and the text behind them."""
        skip = 0
        while skip < min(4, len(data)) and data[skip] & 0xC0 == 0x80:
            skip += 1
        return skip, data[skip:].decode("utf-8", "ignore")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, r, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                low, high = r * range_bytes, min((r + 1) * range_bytes, size)
                base, end = max(low - 8 * limit, 0), min(high + 4 * limit, size)
                system, at = FileSystem.from_uri(quote(path, safe=":/%"))
                with system.open_input_file(at) as file:
                    data = file.read_at(end - base, base)
                _, text = whole(data)
                # The range's limits in characters of ``text``.
                tail = lambda at: len(whole(data[at - base :])[1])  # noqa: B023, E731
                first, last = len(text) - tail(low), len(text) - tail(high)
                start = _range_cut(text, first, limit) if low else 0
                stop = _range_cut(text, last, limit) if high < size else len(text)
                out = [(path, r, n, a - start, b - start, stop - start, (*UNITS, "none")[u], text[back:b]) for n, (back, a, b, u) in enumerate(cuts(text, start, stop, limit, overlap))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")  # not their content
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes))).alias("r"), "length")
    cut = ranges.repartition("path", "r").mapInArrow(run, schema)
    sums = cut.groupBy("path", "r").agg(F.count("*").alias("n"), F.max("chars").alias("c"))
    before = Window.partitionBy("path").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("path", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c"))
    return cut.join(sums, ["path", "r"]).select(
        "path", (F.col("n") + F.col("nth") + 1).cast("int").alias("piece_no"), (F.col("c") + F.col("own_start")).alias("own_start"), (F.col("c") + F.col("own_end")).alias("own_end"), "boundary", "piece"
    )
