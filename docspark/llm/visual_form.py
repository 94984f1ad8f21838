"""One form for texts that look the same.

Texts made of characters that are their own form (:data:`PLAIN`, checked by one regular expression) are done. Of the
others the distinct words with other characters are exploded to positioned code points; a broadcast table of code points
gives each one's decomposition, with look-alike letters, wide and positional forms, ligatures and spaces mapped and
invisible characters dropped; marks are ordered by combining class within their cluster; clusters are recomposed by a
second table; words and texts are rebuilt in order. Both tables are derived from the Unicode database, so their sizes are
fixed.

What looks different stays different: case, accents, superscripts, line breaks against spaces, the number of spaces.

Defined results: null stays null, the empty text stays empty; a text of invisible characters only becomes empty; equal
texts have equal forms, and the form of a form is itself.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.session import written

# Letters that look like a Latin letter or an ASCII sign.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ј": "J", "А": "A", "В": "B", "Е": "E", "К": "K",
    "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "І": "I", "Ѕ": "S", "Ԍ": "G",
    "Ԛ": "Q", "Ԝ": "W", "Ӏ": "l", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "օ": "o", "Օ": "O", "հ": "h", "ո": "n", "ս": "u",
    "ɑ": "a", "ɡ": "g", "ꓲ": "I", "ک": "ك", "ی": "ي", "ہ": "ه", "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨",
    "۹": "٩", "‐": "-", "‑": "-", "ʼ": "'",
}
_FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>")
#: A regular expression class of characters that are their own form wherever they stand between each other.
PLAIN = "\\x20-\\x7E\\nء-غف-يÀ-ÖØ-öø-ÿ¡£§«°»¿€–—‘’“”…•،؛؟٠-٩"
# A word, from its beginning on, with a character beyond these.
_SLOW = f"(?<![^ \\n])[{PLAIN}&&[^ \\n]]*+[^{PLAIN}][^ \\n]*+"


def _dropped(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" and not 0x600 <= o <= 0x605 and o not in (0x6DD, 0x70F, 0x8E2) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o == 0x34F


def _pieces(c: str) -> str:
    """The decomposition of one character: canonical, or that of another form of the same letter, down to the end."""
    if _dropped(c):
        return ""
    if unicodedata.category(c) == "Zs" or c == "\t":
        return " "
    if c in LOOK_ALIKES:
        return "".join(map(_pieces, LOOK_ALIKES[c]))
    kind, _, rest = (" " + unicodedata.decomposition(c)).lstrip().partition(" ") if "<" in unicodedata.decomposition(c) else ("", "", unicodedata.decomposition(c))
    ligature = kind == "<compat>" and (0xFB00 <= ord(c) <= 0xFB17 or 0x2160 <= ord(c) <= 0x217F or 0x675 <= ord(c) <= 0x678)
    if rest and (not kind or kind in _FORMS or ligature):
        return "".join(_pieces(chr(int(x, 16))) for x in rest.split())
    nfd = unicodedata.normalize("NFD", c)
    return nfd if nfd == c else "".join(map(_pieces, nfd))


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[str, list[tuple[str, int]]]], list[tuple[str, str]]]:
    """(character, its pieces with their combining classes) where they differ from the character with class 0, and
    (decomposed syllable of jamo, or character and mark, composed character)."""
    pieces, composed = [], {}
    for o in range(1, sys.maxunicode + 1):
        c = chr(o)
        if 0xD800 <= o <= 0xDFFF or unicodedata.category(c) in ("Cn", "Co") and not 0xE0000 <= o <= 0xE0FFF:
            continue
        p = _pieces(c)
        if p != c or unicodedata.combining(c):
            pieces.append((c, [(x, unicodedata.combining(x)) for x in p]))
        if len(nfd := unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFC", nfd) == c and "".join(map(_pieces, nfd)) == nfd:
            composed[nfd if 0xAC00 <= o <= 0xD7A3 else "".join(chr(int(x, 16)) for x in unicodedata.decomposition(c).split())] = c
    return pieces, sorted(composed.items())


def _joining() -> str:
    """The second characters of pairs that have class 0."""
    return "".join(sorted({a[1] for a, b in tables()[1] if not "\uac00" <= b <= "\ud7a3" and not unicodedata.combining(a[1])}))


def _tables(spark: SparkSession) -> tuple[DataFrame, tuple[DataFrame, Column]]:
    pieces, composed = tables()
    jamo = [(a, b) for a, b in composed if "\uac00" <= b <= "\ud7a3"]
    pairs = {a: b for a, b in composed if not "\uac00" <= b <= "\ud7a3"}
    # As Arrow tables, which need no Python on the executors.
    kind = pa.list_(pa.struct([("c", pa.string()), ("ccc", pa.int32())]))
    parts = pa.table({"ch": [c for c, _ in pieces], "pieces": pa.array([[{"c": x, "ccc": n} for x, n in p] for _, p in pieces], kind)})
    syllables = pa.table({"syllable": [a for a, _ in jamo], "composed": [b for _, b in jamo]})
    return (
        F.broadcast(spark.createDataFrame(parts)),
        (F.broadcast(spark.createDataFrame(syllables)), F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")),
    )


def _composed(m: Column, pairs: Column) -> Column:
    """The canonical composition of one cluster, its marks in order: each mark that isn't kept off by one of its own class
    joins the character before it, if there is such a character."""
    start = F.struct(m[0]["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(a: Column, x: Column) -> Column:
        one = F.try_element_at(pairs, F.concat(a["base"], x["c"]))
        free = (a["rest"] == "") | (a["last"] < x["ccc"])
        joined = F.struct(one.alias("base"), a["rest"].alias("rest"), a["last"].alias("last"))
        left = F.struct(a["base"].alias("base"), F.concat(a["rest"], x["c"]).alias("rest"), x["ccc"].alias("last"))
        return F.when(one.isNotNull() & free, joined).otherwise(left)

    return F.aggregate(F.slice(m, 2, 1 << 30), start, step, lambda a: F.concat(a["base"], a["rest"]))


def needs_work(text: Column) -> Column:
    return text.rlike(f"[^{PLAIN}]")


def forms(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, form) of texts that :func:`needs_work`; ``key`` is unique. Partitioned by ``key`` once."""
    pieces, composed = _tables(texts.sparkSession)
    points = texts.select(key, F.posexplode(F.split(text_col, "")).alias("pos", "ch"))
    parts = points.join(pieces, "ch", "left").select(
        key, "pos", F.posexplode(F.coalesce("pieces", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"))))).alias("sub", "x")
    )
    sequence = Window.partitionBy(key).orderBy("pos", "sub")
    # Some characters of class 0, jamo among them, make one cluster with another of class 0 right before them.
    joins = F.col("x.c").rlike(f"[\\u1161-\\u1175\\u11A8-\\u11C2{_joining()}]") & (F.lag("x.ccc").over(sequence) == 0)
    starts = (F.col("x.ccc") == 0) & ~F.coalesce(joins, F.lit(False))
    numbered = parts.select(key, "pos", "sub", "x.c", F.col("x.ccc").alias("ccc"), starts.alias("starts"))
    before = sequence.rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.select(key, "pos", "sub", "c", "ccc", F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(before).alias("cluster"))
    clusters = numbered.groupBy(key, "cluster").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c"))).alias("m"))
    some = lambda keep: F.array_join(F.transform(F.filter("m", keep), lambda x: x["c"]), "")
    syllables, pairs = composed
    # Syllables of jamo are looked up as a whole, other clusters are composed mark by mark.
    joined = clusters.select(key, "cluster", "m", some(lambda x: x["ccc"] == 0).alias("syllable"), some(lambda x: x["ccc"] != 0).alias("marks")).join(syllables, "syllable", "left")
    best = F.coalesce(F.concat("composed", "marks"), F.when(F.size("m") == 1, F.col("m")[0]["c"]).otherwise(_composed(F.col("m"), pairs)))
    rebuilt = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("cluster", best.alias("t")))).alias("a"))
    return rebuilt.select(key, F.array_join(F.transform("a", lambda x: x["t"]), "").alias("form"))


def with_form(df: DataFrame, text_col: str, out: str = "form") -> DataFrame:
    """``df`` with the column ``out``, the form of ``text_col``. Words are what stands between blanks and line ends, which
    no cluster crosses; each distinct word that needs it is worked on once, and put back into the texts by its place."""
    key, word = "__form_key", "__form_word"
    marked = df.withColumn(key, F.when(needs_work(F.col(text_col)), F.md5(text_col)))
    slow, places = marked.where(F.col(key).isNotNull()), F.regexp_extract_all(text_col, F.lit(_SLOW), 0)
    placed = slow.select(key, F.posexplode(places).alias("pos", word)).distinct()
    done = forms(placed.select(word).distinct(), word, word)
    # A word of nothing but invisible characters has no points left.
    placed = placed.join(done, word, "left").select(key, F.struct("pos", F.coalesce("form", F.lit("")).alias("form")).alias("x"))
    lists = placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["form"]).alias("__forms"))
    between = F.split(text_col, _SLOW)
    whole = F.array_join(F.zip_with(between, "__forms", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    worked = slow.join(lists, key).withColumn(out, whole)
    plain = marked.where(F.col(key).isNull()).withColumn(out, F.col(text_col))
    columns = [*[c for c in df.columns if c != out], out]
    return plain.select(columns).unionByName(worked.select(columns))


def look_alike_classes(items: DataFrame) -> DataFrame:
    """items: (item_kind, item_key, text). (item_kind, item_key, f, t): the members of each class ``f`` of a kind whose texts
    look the same but aren't all the same characters; ``t`` tells the spellings apart. Only texts with a letter or digit; null
    texts and keys belong to no class. One row for each item, however large the class."""
    said = items.where(F.col("text").rlike("[\\p{L}\\p{N}]") & F.col("item_key").isNotNull())
    # One look at each text: of those that are their own form only hashes go on.
    seen = said.select("item_kind", "item_key", F.xxhash64("text").alias("t"), F.md5("text").alias("f"), F.when(needs_work(F.col("text")), F.col("text")).alias("odd"))
    seen = written(seen, "texts")
    worked = with_form(seen.where("odd is not null").drop("f"), "odd", "form").select("item_kind", "item_key", "t", F.md5("form").alias("f"))
    sides = seen.where("odd is null").select("item_kind", "item_key", "t", "f").unionByName(written(worked, "forms"))
    mixed = sides.groupBy("item_kind", "f").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("item_kind", "f")
    return sides.join(mixed, ["item_kind", "f"]).select("item_kind", "item_key", "f", "t").distinct()


def look_alike_pairs(items: DataFrame) -> DataFrame:
    """(item_kind, key_a, key_b) of the members of :func:`look_alike_classes`: the pairs whose texts aren't the same
    characters. As many as there are: where pairs aren't needed, take the classes."""
    kept = look_alike_classes(items)
    one, two = kept.alias("one"), kept.alias("two")
    same = (F.col("one.item_kind") == F.col("two.item_kind")) & (F.col("one.f") == F.col("two.f"))
    pair = same & (F.col("one.t") != F.col("two.t")) & (F.col("one.item_key") < F.col("two.item_key"))
    return one.join(two, pair).select("one.item_kind", F.col("one.item_key").alias("key_a"), F.col("two.item_key").alias("key_b")).distinct()
