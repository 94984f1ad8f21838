"""Repairing text from scanned pages: lines are labelled by a hidden Markov model and paragraphs are put together again.

Each line gives one symbol (blank, number of a page, likeness to the document's name, section title, length against the
text's other lines, end of a sentence); the states are body, break, header, number and title. The model starts from rough
tables and is fitted by Viterbi training on all texts with line ends: their sequences of symbols are counted, and each round
labels each different sequence once. Headers and page numbers are left out, body lines are joined, words broken by a hyphen
are closed up, unless the corpus writes them with the hyphen, and a break ends a paragraph behind a finished sentence.

Misread words are those that stand in scanned texts far more often than in others, and that confusions of shapes
(:data:`CONFUSIONS`), any number of them, turn into a word that is much more frequent; counts are those of the whole corpus,
in texts. Every word is written out in strokes (:func:`strokes`), in which confused shapes are the same, so that a join on
these finds the words it can have been; an alignment then checks that the confusions go the right way.

Defined results: null and empty texts, and texts of one line, have no line noise; a text's misread words are looked for if
it has more than one line; a snippet is whole if it is the text of some chunk, else its last line and its last word don't
count; equal texts get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.lang_id import fold
from docspark.session import written

# Shapes that are read for others, wrong and right.
CONFUSIONS = (
    ("0", "o"), ("1", "i"), ("1", "l"), ("5", "s"), ("c", "e"), ("b", "h"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("vv", "w"),
)
HYPHENS = "-‐¬\xad"
STATES = ("body", "break", "header", "number", "title")
# The symbols of lines: blank, this page's number, another number, the document's name, the section's title, a short line
# that ends no sentence, a short one that does, a full line, a full one that ends a sentence.
SYMBOLS = 9
START = np.array([0.55, 0.02, 0.13, 0.1, 0.2])
MOVE = np.array(
    [
        [0.86, 0.05, 0.04, 0.04, 0.01],
        [0.40, 0.05, 0.15, 0.35, 0.05],
        [0.78, 0.05, 0.01, 0.15, 0.01],
        [0.60, 0.10, 0.28, 0.01, 0.01],
        [0.90, 0.05, 0.02, 0.02, 0.01],
    ]
)
EMIT = np.array(
    [
        [0.001, 0.001, 0.004, 0.002, 0.005, 0.080, 0.107, 0.55, 0.25],
        [0.992, 0.001, 0.001, 0.001, 0.001, 0.001, 0.001, 0.001, 0.001],
        [0.001, 0.001, 0.001, 0.950, 0.002, 0.040, 0.001, 0.003, 0.001],
        [0.001, 0.700, 0.285, 0.002, 0.002, 0.003, 0.003, 0.003, 0.001],
        [0.001, 0.001, 0.001, 0.005, 0.800, 0.180, 0.004, 0.007, 0.001],
    ]
)
_NUMBER = re.compile(
    r"[\s\-–—\[\](){}|.:*~]*(?:(?:page|seite|página|pagina|صفحة|p|pg|s|pág)\b[\s.:]*)?"
    r"(?P<n>\d{1,6}|[ivxlc]{1,8})(?:\s*(?:/|of|von|de|sur|من)\s*\d{1,6})?[\s\-–—\[\](){}|.:*~]*",
    re.IGNORECASE,
)
_NAME = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_ENDS = (".", "!", "?", "؟", ":", ";", "؛")


def _grams(text: str) -> set[str]:
    t = "".join(_NAME.findall(text.casefold()))
    return {t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set())


def _page(text: str) -> str | None:
    """The number of a line that only numbers the page, in ASCII digits or as it is."""
    m = _NUMBER.fullmatch(text)
    return None if m is None else str(int(m["n"])) if m["n"].isdigit() else m["n"].lower()


def symbols(lines: list[str], name: str, title: str, pages: tuple[int | None, int | None]) -> list[int]:
    known, width = _grams(name), sorted(len(x) for x in lines)[-max(1, len(lines) // 3)]
    out = []
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            out.append(0)
        elif (n := _page(line)) is not None:
            own = n.isdigit() and pages[0] is not None and pages[0] <= int(n) <= (pages[1] or pages[0])
            out.append(1 if own else 2)
        elif known and len(line) <= 2 * len(name) + 16 and len(known & (g := _grams(line))) >= 0.75 * len(known) and len(g - known) <= 0.34 * len(known):
            out.append(3)
        elif title and line.casefold() == title:
            out.append(4)
        else:
            out.append((5 if len(line) < 0.7 * width else 7) + line.endswith(_ENDS))
    return out


def viterbi(seen: list[int], model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[int]:
    start, move, emit = model
    score, back = start + emit[:, seen[0]], []
    for s in seen[1:]:
        paths = score[:, None] + move
        back.append(paths.argmax(0))
        score = paths.max(0) + emit[:, s]
    out = [int(score.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def fit_layout(texts: DataFrame, rounds: int = 3, weight: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model in logarithms, fitted on all texts with line ends; the tables above count as ``weight`` observations of each
    state. What comes to the driver are sums of the size of the tables."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [
                "".join(map(str, symbols(text.split("\n"), name or "", (title or "").strip().casefold(), (first, last))))
                for text, name, title, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["seen"])

    lined = texts.where(F.col("text").contains("\n")).select("text", "name", "title", "first", "last")
    sequences = written(lined.mapInArrow(read, "seen string").groupBy("seen").agg(F.count("*").alias("n")), "sequences")
    model = tuple(np.log(x) for x in (START, MOVE, EMIT))
    sizes = (START.size, MOVE.size, EMIT.size)
    for _ in range(rounds):

        def label(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            tables = [np.zeros_like(x) for x in (START, MOVE, EMIT)]
            for batch in batches:
                for seen, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    seen = [int(c) for c in seen]
                    path = viterbi(seen, model)
                    tables[0][path[0]] += n
                    np.add.at(tables[1], (path[:-1], path[1:]), n)
                    np.add.at(tables[2], (path, seen), n)
            flat = np.concatenate([t.ravel() for t in tables])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["cell", "n"])

        counts = np.zeros(sum(sizes))
        for r in sequences.mapInArrow(label, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            counts[r.cell] = r.n
        parts = np.split(counts, np.cumsum(sizes)[:-1])
        model = tuple(np.log((x * weight + c.reshape(x.shape)) / (x * weight + c.reshape(x.shape)).sum(-1, keepdims=True)) for x, c in zip((START, MOVE, EMIT), parts, strict=True))
    return model


def repair(
    text: str, name: str, title: str, pages: tuple[int | None, int | None], model, hyphens: dict[str, str] | None = None
) -> tuple[list[tuple[str, str, str, bool]], list[str]]:
    """(noise, joined word, its two parts with the hyphen, or empty if the hyphen is no real one, whether it would reach
    beyond a cut at the end of the text) of the line noise, and the paragraphs. hyphens: how the parts of words that real
    hyphens break are written; without an entry they are closed up."""
    lines = text.split("\n")
    labels = viterbi(symbols(lines, name, title, pages), model)
    noise: list[tuple[str, str, str, bool]] = []
    parts: list[list[str]] = [[]]
    ended = True
    for i, (line, label) in enumerate(zip(lines, labels, strict=True)):
        last_line = i == len(lines) - 1
        kind = STATES[label]
        if kind == "number":
            noise.append(("page_number", "", "", last_line))
        elif kind == "header":
            noise.append(("header", "", "", last_line))
        elif kind == "break":
            if parts[-1] and ended:
                parts.append([])
        elif kind == "title":
            parts += [[line.strip()], []]
        elif kind == "body" and (x := line.strip()):
            last = parts[-1][-1] if parts[-1] else ""
            if last and last[-1] in HYPHENS and len(last) > 1 and last[-2].isalpha() and x[0].isalpha():
                head, _, tail = last.rpartition(" ")
                first, space, rest = x.partition(" ")
                left, right = tail[:-1], first
                word, apart = _bare(left + right), _bare(f"{left}-{right}") if tail[-1] == "-" else ""
                if word:
                    noise.append(("hyphen", word, apart, last_line and not space and not first.endswith(_ENDS)))
                kept = "-" if apart and (hyphens or {}).get(apart) == apart else ""
                parts[-1][-1] = (head + " " if head else "") + left + kept + right + space + rest
            else:
                parts[-1].append(x)
            ended = x.endswith(_ENDS)
    return noise, [" ".join(p) for p in parts if p]


def _bare(word: str) -> str:
    return re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()


def strokes(c: Column) -> Column:
    """The word in strokes, in which shapes that are taken for each other are the same: an m is an rn, a d a cl, and so on."""
    c = F.translate(c, "01l5eh", "oiiscb")
    for one, two in (("m", "rn"), ("d", "ci"), ("u", "ii"), ("w", "vv")):
        c = F.replace(c, F.lit(one), F.lit(two))
    return c


def misreads(wrong: str, right: str) -> bool:
    """Can ``wrong`` be ``right`` with confusions of :data:`CONFUSIONS`, at least one?"""
    reached = {(0, 0)}
    for i in range(len(wrong)):
        for a, j in [x for x in reached if x[0] == i]:
            if j < len(right) and wrong[i] == right[j]:
                reached.add((i + 1, j + 1))
            for w, r in CONFUSIONS:
                if wrong.startswith(w, i) and right.startswith(r, j):
                    reached.add((i + len(w), j + len(r)))
    return wrong != right and (len(wrong), len(right)) in reached


def scanned_lines(texts: DataFrame, model, look: dict[int, str]) -> DataFrame:
    """texts: (item_kind, item_key, text, name, title, first, last). (item_kind, item_key, scanned, noise, tokens, last_token,
    mark, paragraphs); tokens: the distinct words of the body in lower case, also those joined by a hyphen, but for a last word
    without a final mark, which is ``last_token``; mark: a hash of the text, to tell whether it is whole."""
    shared = texts.sparkSession.sparkContext.broadcast((model, look))
    kind = (
        "item_kind string, item_key string, scanned boolean, noise array<struct<noise:string,word:string,parts:string,edge:boolean>>, tokens array<string>, "
        "last_token array<string>, paragraphs array<string>, mark bigint"
    )
    noise_type = pa.list_(pa.struct([("noise", pa.string()), ("word", pa.string()), ("parts", pa.string()), ("edge", pa.bool_())]))
    words_type = pa.list_(pa.string())

    def words_of(text: str) -> set[str]:
        found = set(_TOKEN.findall(text))
        for w in [w for w in found if "-" in w]:
            found.update(w.split("-"))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, look = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scanned, noises, tokens, lasts, paragraphs = [], [], [], [], []
                for what, text, name, title, first, last in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                    text = text or ""
                    lined = "\n" in text.strip()
                    if not lined and what != "chunk":  # the words of a snippet that isn't scanned tell nothing
                        noise, body, found, end = [], [text] if text else [], set(), set()
                    else:
                        noise, body = repair(text, name or "", (title or "").strip().casefold(), (first, last), model) if lined else ([], [text] if text else [])
                        words, end = fold("\n".join(body), look), set()
                        if what != "chunk" and not words.rstrip().endswith((".", "!", "?", "؟")):
                            words, _, tail = words.rpartition(" ")
                            end = words_of(tail)
                        found = words_of(words)
                    scanned.append(lined)
                    noises.append([{"noise": a, "word": b, "parts": c, "edge": e} for a, b, c, e in noise])
                    paragraphs.append(body)
                    tokens.append(sorted(found))
                    lasts.append(sorted(end - found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(scanned), pa.array(noises, noise_type), pa.array(tokens, words_type), pa.array(lasts, words_type), pa.array(paragraphs, words_type), part.column(7)],
                    names=["item_kind", "item_key", "scanned", "noise", "tokens", "last_token", "paragraphs", "mark"],
                )

    return texts.select("item_kind", "item_key", "text", "name", "title", "first", "last", F.xxhash64("text").alias("mark")).mapInArrow(run, kind)


def word_counts(lines: DataFrame) -> DataFrame:
    """(word, n, clean): in how many chunks a word stands, and in how many of one line."""
    each = lines.where("item_kind = 'chunk'").select("scanned", F.explode("tokens").alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"), F.sum(F.when(F.col("scanned"), 0).otherwise(1)).alias("clean"))


def corrections(counts: DataFrame, lines: DataFrame, ratio: int = 4, lift: int = 20) -> DataFrame:
    """(word, right): the misread words and what they have been: words at least ``lift`` times as frequent in scanned texts as
    in others, and of the words they can have been that stand in others the most frequent one, if it is ``ratio`` times as
    frequent as the misread one or that has a digit for a letter."""
    wrong = "|".join(sorted({w for w, _ in CONFUSIONS}))
    size = lines.where("item_kind = 'chunk'").agg(F.count_if("scanned").alias("scans"), F.count_if(~F.col("scanned")).alias("others"))
    odd = counts.where(F.col("word").rlike(wrong) & F.col("word").rlike("\\p{L}") & ~F.col("word").contains("-") & (F.col("n") > F.col("clean")))
    odd = odd.crossJoin(F.broadcast(size)).where((F.col("n") - F.col("clean")) * F.col("others") >= lift * F.col("clean") * F.col("scans")).select("word", "n", strokes(F.col("word")).alias("k"))  # one row
    known = counts.where("clean > 0").select(F.col("word").alias("right"), F.col("n").alias("m"), strokes(F.col("word")).alias("k"))
    tried = odd.join(known, "k").where((F.col("word") != F.col("right")) & ((F.col("m") >= ratio * F.col("n")) | F.col("word").rlike("[015]"))).select("word", "m", "right")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([misreads(w, r) for w, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.bool_()))

    return tried.mapInArrow(check, "word string, m long, right string").groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def _found(texts: DataFrame, model, look: dict[int, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(noise of lines with hyphens decided, misread words, corrections), each with its item."""
    lines = written(scanned_lines(texts, model, look).drop("paragraphs"), "lines")
    counts = written(word_counts(lines), "words")
    right = written(corrections(counts, lines), "corrections")
    item = ["item_kind", "item_key"]
    # What lies at the end of a snippet counts if the snippet is the text of some chunk.
    contents = lines.where("item_kind = 'chunk' and scanned").select("mark").distinct()
    at_end = lines.where(F.col("scanned") & (F.col("item_kind") != "chunk") & (F.exists("noise", lambda x: x["edge"]) | (F.size("last_token") > 0)))
    whole = at_end.join(contents, "mark", "left_semi").select(*item, "noise", "last_token")
    inner = lines.select("item_kind", "item_key", F.explode(F.filter("noise", lambda x: (F.col("item_kind") == "chunk") | ~x["edge"])).alias("x"))
    outer = whole.select(*item, F.explode(F.filter("noise", lambda x: x["edge"])).alias("x"))
    marks = inner.unionByName(outer).select(*item, "x.noise", "x.word", "x.parts")
    joined = counts.select("word", F.col("n").alias("one"))
    apart = counts.select(F.col("word").alias("parts"), F.col("n").alias("two"))
    broken = marks.where("noise = 'hyphen'").join(joined, "word", "left").join(apart, "parts", "left").withColumn("closed", F.expr("coalesce(two, 0) <= coalesce(one, 0)")).drop("one", "two")
    marks = marks.where("noise <> 'hyphen'").withColumn("closed", F.lit(True)).unionByName(broken)
    words = lines.where("scanned").select(*item, F.explode("tokens").alias("word")).unionByName(whole.select(*item, F.explode("last_token").alias("word")))
    return marks, words.join(right, "word").select(*item, "word", "right"), right


def scan_noise(texts: DataFrame, model, look: dict[int, str]) -> DataFrame:
    """(item_kind, item_key, noise, word) of all texts."""
    marks, misread, right = _found(texts, model, look)
    plain = marks.where("noise <> 'hyphen'").select("item_kind", "item_key", "noise", "word")
    broken = marks.where("noise = 'hyphen' and closed").join(right, "word", "left").select("item_kind", "item_key", "noise", F.coalesce("right", "word").alias("word"))
    return plain.unionByName(broken).unionByName(misread.select("item_kind", "item_key", F.lit("misread").alias("noise"), F.col("right").alias("word"))).distinct()


def _in_case(right: str, word: str) -> str:
    return right.upper() if len(word) > 1 and word.isupper() else right[:1].upper() + right[1:] if word[:1].isupper() else right


def repaired(texts: DataFrame, model, look: dict[int, str]) -> DataFrame:
    """(item_kind, item_key, no, paragraph): the paragraphs, with misread words put right, in the case they had, and hyphens
    kept in words that the corpus writes with them. Texts of one line are one paragraph. Only scanned texts are shuffled, once,
    to meet their corrections."""
    marks, misread, _ = _found(texts, model, look)
    item = ["item_kind", "item_key"]
    words = misread.groupBy(*item).agg(F.map_from_entries(F.collect_set(F.struct("word", "right"))).alias("words"))
    kept = marks.where("noise = 'hyphen' and not closed").groupBy(*item).agg(F.collect_set("parts").alias("kept"))
    lined = F.coalesce(F.trim("text").contains("\n"), F.lit(False))
    plain = texts.where(~lined & (F.col("text") != "")).select(*item, F.lit(0).alias("no"), F.col("text").alias("paragraph"))
    met = texts.where(lined).join(words, item, "left").join(kept, item, "left").select(*item, "text", "name", "title", "first", "last", F.map_entries("words").alias("words"), "kept")
    shared = texts.sparkSession.sparkContext.broadcast((model, look))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, look = shared.value
        for batch in batches:
            where, no, out = [], [], []
            for i, (text, name, title, first, last, words, kept) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 9)), strict=True)):
                right = {w["key"]: w["value"] for w in words or ()}
                _, body = repair(text, name or "", (title or "").strip().casefold(), (first, last), model, {p: p for p in kept or ()})
                for n, paragraph in enumerate(body):
                    if right:
                        paragraph = _TOKEN.sub(lambda m: "-".join(_in_case(right[w], x) if (w := fold(x, look)) in right else x for x in m.group().split("-")), paragraph)
                    where.append(i)
                    no.append(n)
                    out.append(paragraph)
            take = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(no, pa.int32()), pa.array(out, pa.string())], names=[*item, "no", "paragraph"])

    return plain.unionByName(met.mapInArrow(run, "item_kind string, item_key string, no int, paragraph string"))
