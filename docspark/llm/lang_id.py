"""Languages of texts and of the passages within them, by language-bitmask n-gram filters.

A filter is one array of bytes: bit j of a cell belongs to language j, so looking an n-gram up by its ``HASHES`` cells and
joining them by AND gives all languages that contain it (bit-sliced Bloom filters). Of a passage, the n-grams of its words
are counted for each language, the expected false positives are taken off, and the language with most decides; its
confidence is its share against the next one, times the share of known n-grams.

The filters are fitted on a bounded sample of labelled rows (``sample`` rows, spread by a hash of their text). As labels can
be wrong and texts mixed, an n-gram enters a language only if it is frequent there against its most frequent language, and
a second round fits on the sentences that the first filters agree on.

Passages: sentences end at . ! ? ؟ ; ؛ followed by white space and at blank lines; a line of four words or more (without
numbers) that is clearly in another language than the rest of its sentence is a passage of its own; neighbouring sentences of one language
make one passage. Terms and names within a sentence don't outvote it.

Defined results: null, empty and wordless texts have language null and confidence 0; look-alike characters are read as the
letters they look like; equal texts get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANGUAGES = ("en", "ar", "fr", "de", "es")
# The ways a label names a language.
NAMES = {
    "en": ("en", "eng", "english"),
    "ar": ("ar", "ara", "arabic"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
    "es": ("es", "spa", "spanish"),
}
HASHES, CELLS = 3, 1 << 19
TOKEN = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?؟;؛])\s+|\s*\n\s*\n\s*")
_FIELD = 16  # bits of one language's count in a packed sum


def label_language(label: Column) -> Column:
    """The language that a label names, else null."""
    code = F.lower(F.trim(label))
    out = F.lit(None).cast("string")
    for language, names in NAMES.items():
        out = F.when(code.isin(*names) | code.rlike(f"^({'|'.join(n for n in names if len(n) < 4)})[-_][a-z0-9]{{2,4}}$"), language).otherwise(out)
    return out


def grams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded] if len(word) < 2 else [padded[i : i + 4] for i in range(len(padded) - 3)] + [padded[i : i + 3] for i in range(len(padded) - 2)]


def _cells(gram: str) -> list[int]:
    raw = gram.encode()
    a, b = zlib.crc32(raw), zlib.adler32(raw) * 2654435761 % (1 << 32) | 1
    return [(a + i * b) % CELLS for i in range(HASHES)]


class Filters:
    """One cell array for all languages."""

    def __init__(self, contents: list[set[str]]):
        self.cells = np.zeros(CELLS, np.uint8)
        for j, group in enumerate(contents):
            at = np.array([c for g in group for c in _cells(g)], np.int64)
            self.cells[at] |= np.uint8(1 << j)
        self.false = [float(((self.cells >> j) & 1).mean()) ** HASHES for j in range(len(contents))]
        self.known: dict[str, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return {"cells": self.cells, "false": self.false, "known": {}}

    def mask(self, gram: str) -> int:
        """The languages that contain the n-gram, a bit each."""
        out = 0xFF
        for c in _cells(gram):
            out &= int(self.cells[c])
        return out

    def word(self, word: str) -> tuple[int, int]:
        """The n-grams of a word that each language contains, packed into one number, and how many it has."""
        got = self.known.get(word)
        if got is None:
            packed, all_grams = 0, grams(word)
            for g in all_grams:
                m = self.mask(g)
                for j in range(len(LANGUAGES)):
                    if m >> j & 1:
                        packed += 1 << _FIELD * j
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[word] = packed, len(all_grams)
        return got

    def score(self, words: list[str]) -> tuple[list[float], int]:
        """Of each language the n-grams of the words, without the expected false positives."""
        n, totals, packed, open_ = 0, [0] * len(LANGUAGES), 0, 0
        known = self.known
        for w in words:
            p, k = known.get(w) or self.word(w)
            packed += p
            n += k
            open_ += k
            if open_ > 60_000:  # before a field runs over
                totals = [t + (packed >> _FIELD * j & 0xFFFF) for j, t in enumerate(totals)]
                packed, open_ = 0, 0
        totals = [t + (packed >> _FIELD * j & 0xFFFF) for j, t in enumerate(totals)]
        return [max(0.0, (t - n * f) / (1 - f)) for t, f in zip(totals, self.false, strict=True)], n

    def decide(self, words: list[str]) -> tuple[str | None, float]:
        scores, n = self.score(words)
        if not n or not (best := max(scores)):
            return None, 0.0
        order = sorted(range(len(scores)), key=lambda j: -scores[j])
        share = (scores[order[0]] - scores[order[1]]) / scores[order[0]]
        return LANGUAGES[order[0]], round(share * min(1.0, best / n), 6)


def _words(text: str) -> tuple[list[str], int]:
    """The words without digits, and how many words there are."""
    found = TOKEN.findall(text)
    return [w for w in found if w.isalpha()], len(found)


def fold(text: str, look: dict[int, str]) -> str:
    return unicodedata.normalize("NFC", text.translate(look)).lower() if not text.isascii() else text.lower()


def look_table() -> dict[int, str]:
    """For :func:`fold`: each code point that has another form."""
    from docspark.llm.visual_form import tables

    formed = ((c, unicodedata.normalize("NFC", "".join(x for x, _ in p))) for c, p in tables()[0])
    return {ord(c): form for c, form in formed if form != c}


def fit(rows: list[tuple[str, str]], look: dict[int, str], least: int = 2, share: float = 0.1, first_share: float = 0.6) -> Filters:
    """rows: (language, text), labels partly wrong; as a third of them may be, the first round takes ``first_share``."""
    parts = [(lang, _words(s)[0]) for lang, text in rows for s in SENTENCE.split(fold(text, look))]
    filters = _fitted(parts, least, first_share)
    for _ in range(2):
        clean = []
        for _, words in parts:
            if len(words) > 3 and (found := filters.decide(words))[1] > 0.25:
                clean.append((found[0], words))
        filters = _fitted(clean, least, share)
    return filters


def _fitted(parts: list[tuple[str, list[str]]], least: int, share: float) -> Filters:
    words = {lang: Counter() for lang in LANGUAGES}
    for lang, w in parts:
        words[lang].update(w)
    counts = {lang: Counter() for lang in LANGUAGES}
    for lang in LANGUAGES:
        for w, n in words[lang].items():
            for g in grams(w):
                counts[lang][g] += n
    totals = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
    most: dict[str, float] = {}
    for lang, c in counts.items():
        for g, n in c.items():
            most[g] = max(most.get(g, 0.0), n / totals[lang])
    return Filters([{g for g, n in counts[lang].items() if n >= least and n / totals[lang] >= share * most[g]} for lang in LANGUAGES])


def passages(text: str, filters: Filters, look: dict[int, str]) -> list[tuple[str | None, float, int, list[str]]]:
    """(language, confidence, longest sentence in words, words) of the passages of one text in order."""
    out: list[list] = []
    for sentence in SENTENCE.split(fold(text, look)):
        if "\n" in sentence:
            lines = [_words(line) for line in sentence.split("\n")]
            units = [([w for ws, _ in lines for w in ws], sum(n for _, n in lines), None)]
            if len(lines) > 1:
                whole = filters.decide(units[0][0])
                found = [filters.decide(ws) if len(ws) > 3 else None for ws, _ in lines]
                own = [d is not None and d[0] != whole[0] and d[1] > 0.3 for d in found]
                if any(own):
                    rest = [x for x, o in zip(lines, own, strict=True) if not o]
                    units = [([w for ws, _ in rest for w in ws], sum(n for _, n in rest), None), *((*x, d) for x, d, o in zip(lines, found, own, strict=True) if o)]
                else:
                    units = [(*units[0][:2], whole)]
        else:
            units = [(*_words(sentence), None)]
        for words, size, decision in units:
            if not words:
                continue
            lang, sure = decision or filters.decide(words)
            if out and out[-1][0] == lang:
                out[-1] = [lang, None, max(out[-1][2], size), out[-1][3] + words]
            else:
                out.append([lang, sure, size, words])
    return [(lang, 0.0 if not lang else filters.decide(words)[1] if sure is None else sure, size, words) for lang, sure, size, words in out]


def least_hashes(rows: DataFrame, text_col: str, sample: int) -> DataFrame:
    """At most ``sample`` rows of different texts, those with the least hashes. Only a range of hashes that holds about
    three times as many is looked at, so that what is sorted has a bound as well, however large the table or a group of
    copies. Of copies, the row that comes first by its other columns."""
    n = rows.count()
    share = min(1.0, 3 * sample / max(n, 1))
    marked = rows.withColumn("__h", F.xxhash64(text_col))
    if share < 1:
        marked = marked.where(F.col("__h") < int(-(2**63) + share * 2**64))
    others = [c for c in rows.columns if c != text_col]
    first = marked.groupBy("__h").agg(F.min(F.struct(*others, text_col)).alias("__x")).orderBy("__h").limit(sample)
    return first.select(*[F.col(f"__x.{c}").alias(c) for c in rows.columns])


def fit_filters(labelled: DataFrame, text_col: str, language_col: str, sample: int = 3_000) -> tuple[Filters, dict[int, str]]:
    """On at most ``sample`` rows of ``labelled``, whose language is one of LANGUAGES; the least hashes of the texts."""
    texts = labelled.where(F.col(language_col).isin(*LANGUAGES) & (F.length(text_col) > 0)).select(F.col(language_col).alias("l"), F.col(text_col).alias("t"))
    some = least_hashes(texts, "t", sample)
    look = look_table()
    return fit([(r.l, r.t) for r in some.collect()], look), look


def languages(df: DataFrame, filters: Filters, look: dict[int, str], text_col: str, keys: list[str]) -> DataFrame:
    """(*keys, lang, confidence, passages array<struct<no,lang,confidence,words>>) of each row; ``words`` is the length of
    the passage's longest sentence. One pass, no shuffle."""
    slim = df.select(*[F.col(k) for k in keys], F.col(text_col).alias("__text"))
    kind = "array<struct<no:int,lang:string,confidence:double,words:int>>"
    fields = [T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("passages", T._parse_datatype_string(kind))]
    schema = T.StructType([*slim.schema.fields[:-1], *fields])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    shared = df.sparkSession.sparkContext.broadcast((filters, look))
    part_type = pa.list_(pa.struct([("no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, look = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lang, sure, lists = [], [], []
                for text in part.column(len(keys)).to_pylist():
                    found = passages(text, filters, look) if text else []
                    a, b = filters.decide([w for p in found for w in p[3]]) if len(found) > 1 else (found[0][:2] if found else (None, 0.0))
                    lang.append(a)
                    sure.append(b)
                    lists.append([{"no": i, "lang": p[0], "confidence": p[1], "words": p[2]} for i, p in enumerate(found)])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keys))), pa.array(lang, pa.string()), pa.array(sure, pa.float64()), pa.array(lists, part_type)], names=schema.names
                )

    return slim.mapInArrow(run, schema)
