"""Defects of prompt and response pairs: empty, refusal, copy, other_language, truncated; at most one each, in this order.

Refusals are sentences of small grammars (:data:`REFUSALS`) with nothing beside them but excuses and advice. Copies are found
by greedy string tiling of the reply with the question's words (running hashes). Languages come from the n-gram filters. Truncation: a
pushdown parser reads fences, brackets, quotations, list items and tags; what it leaves open is truncated. A reply without
a final mark is judged by how its last words go on elsewhere: of all replies, it is counted how often the same words end a
sentence and how often they continue; the counts are joined on the words. A short reply as a whole is finished by the share
of other texts that stop with its form among those and the longer ones that begin with it; copies of a text count once.

Defined results: exchanges whose question has no letter or digit give no row; a null reply counts as empty; the rows of an
exchange are put together by the least text of each side; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.lang_id import Filters, fold, passages
from docspark.session import written

# Grammars of sentences that decline or say that nothing was found: who speaks, that it can't or mustn't, and what it would
# have had to do; or a search without a find. The speaker is the assistant, not somebody that a rule forbids something.
_EN_ACT = r"(?:help|assist|answer|reply|respond|provide|offer|comment|discuss|disclose|share|say|give|do|address|speak|talk|advise|guide|tell|confirm)"
_EN_I = r"(?:i|we|this assistant|the assistant)"
REFUSALS = re.compile(
    "|".join(
        (
            rf"\b{_EN_I}(?: am| are| is|'m|'re| was| were)?(?: \w+){{0,3}}? (?:can ?not|can't|could not|couldn't|may not|unable to|not able to|won't be able to|will not be able to|not in a position to) (?:\w+ )?{_EN_ACT}\b",
            rf"\bnot (?:something|a topic|a matter|anything) (?:that )?{_EN_I} (?:am|are|is|can|could|may)\b|\b{_EN_I}(?: am| are|'m|'re)? not (?:allowed|permitted|authori[sz]ed|free) to\b",
            rf"\b{_EN_I} (?:must|have to|need to|will have to)? ?(?:decline|refuse)\b|\b(?:does|do|did|will|would) not (?:let|allow|permit) (?:me|us)\b",
            rf"\bnothing\b.*\b(?:was|were|could be|has been|is)? ?found\b|\bno (?:relevant )?(?:information|answer|result|passage)s?\b.*\b(?:found|available)\b|\b{_EN_I} (?:could not|couldn't|did not|didn't|can ?not|can't) find\b",
            r"\bje ne suis (?:\w+ )?pas (?:en mesure|autorisée?|capable)\b|\bje ne (?:peux|puis|pourrai|saurais)\b|\b(?:il )?ne m'est pas (?:permis|possible)\b|\b(?:ne )?me permet(?:tent)? pas\b|\bje (?:dois|préfère) (?:décliner|refuser|m'abstenir)\b",
            r"\baucune? (?:information|réponse|passage|élément)\b.*\b(?:figure|trouvée?|disponible|n'existe|n'a été)\b|\bje n'ai (?:rien|pas|trouvé aucun)\b|\brien (?:n'a été )?trouvé\b",
            r"\bich (?:\w+ ){0,3}?(?:kann|darf|konnte|bin)\b.*\b(?:nicht|keine?n?|nichts)\b|\b(?:kann|darf|konnte|bin|muss|habe) ich\b.*\b(?:nicht|keine?n?|nichts|ablehnen|verzichten)\b|\bich muss\b.*\b(?:ablehnen|verzichten)\b|\blassen? mich\b.*\bnicht\b|\b(?:ist|wird) mir nicht (?:möglich|gestattet|erlaubt)\b|\bnichts (?:dazu )?gefunden\b",
            r"\bno (?:puedo|podré|podemos)\b|\bno me (?:es posible|está permitido|permiten?)\b|\bno se me permite\b|\bno estoy (?:en condiciones|autorizad[oa]|en posición)\b|\bno (?:he|hemos|se ha) encontrado\b|\bno (?:dispongo|tengo) (?:de )?(?:ninguna )?(?:información|respuesta)\b|\bno (?:hay|existe) (?:ninguna )?(?:información|respuesta)\b|\bdebo (?:declinar|rechazar|abstenerme)\b|\bme veo obligad[oa]\b",
            r"لا (?:يمكنني|أستطيع|يسعني)|ليس مسموحا لي|(?:لست|غير) (?:قادر|قادرا|مسموح لي|مخول|مخولا)|لم (?:أعثر|أجد|يتم العثور|نعثر|نجد)|أعتذر عن (?:الإجابة|عدم)|لا (?:تسمح|تتيح) لي|لا (?:توجد|يوجد|تتوفر) (?:لدي )?(?:معلومات|معلومة|إجابة)",
        )
    )
)
# Sentences that may stand beside a refusal: advice where to turn, and excuses without more.
BESIDE = re.compile(
    r"^\W*(?:please|kindly|you (?:may|can|could|should|might)|try|contact|consult|ask|rephrase|speak|get in touch|reach out|turn to)\b"
    r"|^\W*(?:veuillez|essayez|adressez|contactez|consultez|posez|merci de|vous pouvez|reformulez)\b"
    r"|^\W*(?:bitte|(?:wenden|kontaktieren|versuchen|fragen|sprechen|stellen) sie|sie können)\b"
    r"|^\W*(?:por favor|póngase|contacte|consulte|pruebe|diríjase|intente|hable|puede|reformule)\b"
    r"|^\W*(?:يرجى|جرب|حاول|تواصل|راجع|استشر|من فضلك|يمكنك)"
    r"|^\W*(?:i am |i'm |we are )?(?:very )?(?:sorry|apolog\w+|unfortunately|regrettably|désolée?|malheureusement|entschuldigung|leider|lo siento|perdone|por desgracia|عذرا|نعتذر|أعتذر|للأسف|مع الأسف)(?: (?:for|about) (?:this|that|the \w+))?\W*$"
)
# How a question names the language of the answer.
ASKED = {
    "en": r"\benglish\b|\banglais\b|\benglisch\b|\bingl[ée]s\b|إنجليزي|انجليزي|إنكليزي",
    "ar": r"\barabic\b|\barabe\b|\bárabe\b|\barabisch\b|عربي",
    "fr": r"\bfrench\b|\bfrançais\b|\bfranzösisch\b|\bfrancés\b|فرنسي",
    "de": r"\bgerman\b|\ballemand\b|\bdeutsch\b|\balemán\b|ألماني|الماني",
    "es": r"\bspanish\b|\bespagnol\b|\bspanisch\b|\bespañol\b|إسباني|اسباني",
}
ASKED = {k: re.compile(v) for k, v in ASKED.items()}
WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"(?:\s*\[\d+\])+\s*$")
_SENTENCES = re.compile(r"(?<=[.!?؟])\s+|\n+")
_PAIRS = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "›": "‹"}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]{0,10})(?:\s[^<>]*)?(/?)>")
_FINAL, _CLOSERS = ".!?؟", "\"'»”’)]}›*_`"


_TOKENS = re.compile(r"```|<(?=/?[a-zA-Z])|[(\[{«“‹)\]}»”›\"]")


def left_open(text: str) -> bool:
    """A pushdown parser over fences, brackets, quotations, tags and list items: does the text end inside one of them?"""
    stack: list[str] = []
    skip = 0
    for token in _TOKENS.finditer(text):
        at, c = token.start(), token.group()
        if at < skip:
            continue
        if c == "```":
            if stack and stack[-1] == c:
                stack.pop()
            else:
                stack.append(c)
        elif stack and stack[-1] == "```":
            continue
        elif c == "<":
            if m := _TAG.match(text, at):
                end, name, alone = m.groups()
                if end:
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                elif not alone and name.lower() not in ("br", "hr", "img", "p", "li"):
                    stack.append(name)
                skip = m.end()
        elif c in _PAIRS or c == '"':
            opened = _PAIRS.get(c, c)
            if opened in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opened) :]
            elif c == '"':
                stack.append(c)
        else:
            stack.append(c)
    return bool(stack) or bool(re.search(r"\n\s*(?:[-*•]|\d+[.)])\s*$", text))


def tiles(reply: list[str], question: list[str], least: int = 3) -> list[bool]:
    """Which words of the reply lie in tiles, by greedy string tiling: the longest common runs first, each word once. Runs of
    a length are found by running hashes of the free stretches (Karp and Rabin), lengths from the longest possible one down
    by halves, so that no pair of places is compared word by word unless their hashes agree."""
    a, b = [False] * len(reply), [False] * len(question)
    size = min(len(reply), len(question))
    while size >= least:
        found = _runs(reply, question, a, b, size)
        if not found:  # the longest run that there is
            low, high = least, size - 1
            size = least - 1
            while low <= high:
                middle = (low + high + 1) // 2
                if _runs(reply, question, a, b, middle, True):
                    size, low = middle, middle + 1
                else:
                    high = middle - 1
            continue
        for i, j in found:
            if not any(a[i : i + size]) and not any(b[j : j + size]):
                a[i : i + size] = b[j : j + size] = [True] * size
    return a


_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


def _rolling(words: list[str], taken: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of the runs of ``size`` free words."""
    top, now, length = pow(_BASE, size - 1, _MODULUS), 0, 0
    for i, w in enumerate(words):
        if taken[i]:
            now = length = 0
            continue
        if length == size:
            now = (now - hash(words[i - size]) % _MODULUS * top) % _MODULUS
            length -= 1
        now = (now * _BASE + hash(w)) % _MODULUS
        length += 1
        if length == size:
            yield i - size + 1, now


def _runs(reply: list[str], question: list[str], a: list[bool], b: list[bool], size: int, one: bool = False) -> list[tuple[int, int]]:
    """The places of common runs of ``size`` free words; the first will do if ``one``."""
    places: dict[int, list[int]] = {}
    for j, h in _rolling(question, b, size):
        places.setdefault(h, []).append(j)
    found = []
    for i, h in _rolling(reply, a, size) if places else ():
        for j in places.get(h, ()):
            if reply[i : i + size] == question[j : j + size]:
                found.append((i, j))
                if one:
                    return found
    return found


def is_copy(reply: str, question: str) -> bool:
    """Nearly all of the reply is the question; leading words such as "You asked" don't count, an answer behind it does."""
    r, q = WORD.findall(reply), WORD.findall(question)
    have = Counter(q)
    if len(r) < 2 or len(q) < 2 or sum(w in have for w in r) < 0.7 * len(r):
        return False
    if r == q:
        return True
    least = min(3, len(q))
    half = r[: len(r) // 2] if len(r) % 2 == 0 and r[: len(r) // 2] == r[len(r) // 2 :] else r
    covered = tiles(half, q, least)
    first = covered.index(True) if True in covered else len(half)
    last = len(half) - 1 - covered[::-1].index(True) if True in covered else -1
    inside, behind = sum(not x for x in covered[first : last + 1]), len(half) - 1 - last
    return first <= 4 and behind <= 3 and inside <= 0.25 * len(half) and sum(covered) >= 0.6 * len(q)


def is_refusal(reply: str) -> bool:
    """Sentences that decline, and no other but excuses and advice beside them."""
    found = False
    for s in _SENTENCES.split(reply):
        if not WORD.search(s):
            continue
        if REFUSALS.search(s):
            found = True
        elif not BESIDE.search(s):
            return False
    return found


class Normal:
    """Words with numbers as # and those that aren't in the vocabulary as <r>, of which runs become one."""

    def __init__(self, vocabulary: set[str]):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, words: list[str]) -> list[str]:
        known, out, last = self.known, [], ""
        for w in words:
            x = known.get(w)
            if x is None:
                if len(known) > 200_000:
                    known.clear()
                x = known[w] = "#" if any(c.isdigit() for c in w) else w if w in self.vocabulary else "<r>"
            if x != "<r>" or last != "<r>":
                out.append(x)
            last = x
        return out


#: The words of the longest form that is counted as a whole.
LONGEST = 10


def _form(words: list[str]) -> str:
    return "^ " + " ".join(words)


def _mark(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def open_end(reply: str) -> tuple[str, bool]:
    """The reply without citation marks and blanks at its end; whether it stops without a final mark."""
    text = _MARKS.sub("", reply).rstrip()
    core = text.rstrip(_CLOSERS + " ")
    return text, not core or core[-1] not in _FINAL



def exchanges(messages: DataFrame) -> DataFrame:
    """(message_id, question, reply), the sides that say something, else null."""
    says = lambda c: F.when(F.col(c).rlike("[\\p{L}\\p{N}]"), F.col(c))
    return messages.where("message_id is not null").groupBy("message_id").agg(F.min(says("user_message")).alias("question"), F.min(says("assistant_message")).alias("reply"))


def frequent_words(replies: DataFrame, share: float = 0.002) -> list[str]:
    """The words in at least ``share`` of the replies, which bounds how many there can be."""
    low = F.array_distinct(F.regexp_extract_all(F.lower("reply"), F.lit("([\\p{L}]+)"), 1))
    n = replies.count()
    words = replies.select(F.explode(low).alias("w")).groupBy("w").count().where(F.col("count") >= max(3.0, share * n))
    return sorted(r.w for r in words.collect())


def defects(messages: DataFrame, filters: Filters, look: dict[int, str]) -> DataFrame:
    """(message_id, defect)"""
    pairs = written(exchanges(messages).where("question is not null"), "pairs")
    empty = pairs.where("reply is null").select("message_id", F.lit("empty").alias("defect"))
    full = pairs.where("reply is not null")
    vocabulary = set(frequent_words(full))
    # Beginnings of frequent words that are no words themselves: a reply that stops there is cut within a word.
    prefixes = {w[:i] for w in vocabulary for i in range(1, len(w))} - vocabulary
    shared = messages.sparkSession.sparkContext.broadcast((filters, look, vocabulary, prefixes))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, look, vocabulary, prefixes = shared.value
        normal = Normal(vocabulary)
        for batch in batches:
            ids, kinds, k9, k3, k2 = [], [], [], [], []
            for i, question, reply in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                q, a = fold(question, look), fold(reply, look)
                kind, keys = None, (None, None, None)
                if is_refusal(_MARKS.sub("", a)):
                    kind = "refusal"
                elif is_copy(_MARKS.sub("", a), q):
                    kind = "copy"
                elif _other_language(a, q, filters):
                    kind = "other_language"
                else:
                    text, open_ = open_end(a)
                    if text.endswith(("...", "…")) or left_open(text):
                        kind = "truncated"
                    elif open_:
                        last = WORD.findall(text)[-1:]
                        if text[-1:] in ",:;-–—/" or last and last[0] in prefixes and text.endswith(last[0]):
                            kind = "truncated"
                        else:
                            whole, w = normal(WORD.findall(text)), normal(WORD.findall(_SENTENCES.split(text)[-1]))
                            form = _form(whole) if 0 < len(whole) <= LONGEST else None
                            keys = (form, " ".join(w[-3:]) if len(w) > 2 else None, " ".join(w[-2:]))
                            kind = "?"
                if kind:
                    ids.append(i)
                    kinds.append(kind)
                    for column, key in zip((k9, k3, k2), keys, strict=True):
                        column.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (ids, kinds, k9, k3, k2)], names=["message_id", "defect", "k9", "k3", "k2"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, look, vocabulary, _ = shared.value
        normal = Normal(vocabulary)
        for batch in batches:
            # Runs of words, and forms with the text they stand in: (key, mark of the text): counts.
            ends, goes, stops = Counter(), Counter(), Counter()
            form_goes, form_stops = [], []
            for reply in batch.column(0).to_pylist():
                text, open_ = open_end(fold(reply, look))
                mark = _mark(text)
                sentences = [w for s in _SENTENCES.split(text) if (w := WORD.findall(s))]
                whole = normal([w for s in sentences for w in s])
                if open_ and 0 < len(whole) <= LONGEST:
                    form_stops.append((_form(whole), mark))
                form = "^"
                for w in whole[: min(LONGEST, len(whole) - 1)]:
                    form = f"{form} {w}"
                    form_goes.append((form, mark))
                for j, s in enumerate(sentences):
                    w = normal(s)
                    goes.update(zip(w[:-2], w[1:-1]))
                    goes.update(zip(w[:-3], w[1:-2], w[2:-1]))
                    done = stops if open_ and j == len(sentences) - 1 else ends
                    for size in (2, 3):
                        if len(w) >= size:
                            done[tuple(w[-size:])] += 1
            keys = list(ends.keys() | goes.keys() | stops.keys())
            forms = list(dict.fromkeys(form_goes + form_stops))
            went, stopped = set(form_goes), set(form_stops)
            nothing = [0] * len(forms)
            columns = (
                pa.array([" ".join(k) for k in keys] + [f for f, _ in forms], pa.string()),
                pa.array([None] * len(keys) + [m for _, m in forms], pa.int64()),
                pa.array([ends[k] for k in keys] + nothing, pa.int64()),
                pa.array([goes[k] for k in keys] + [int(f in went) for f in forms], pa.int64()),
                pa.array([stops[k] for k in keys] + [int(f in stopped) for f in forms], pa.int64()),
            )
            yield pa.RecordBatch.from_arrays(list(columns), names=["key", "text", "ends", "goes", "stops"])

    judged = written(full.select("message_id", "question", "reply").mapInArrow(judge, "message_id string, defect string, k9 string, k3 string, k2 string"), "judged")
    counts = full.select("reply").mapInArrow(count, "key string, text long, ends long, goes long, stops long")
    open_ = judged.where("defect = '?'").select("message_id", F.explode(F.array(*[F.struct(F.lit(size).alias("size"), F.col(f"k{size}").alias("key")) for size in (9, 3, 2)])).alias("x"))
    open_ = open_.select("message_id", "x.size", "x.key")
    # A small table of its own, so that the planner sees its size.
    wanted = written(open_.select("key").where("key is not null").distinct(), "wanted")
    sums = lambda one: [F.sum(F.when(F.col("text").isNotNull(), F.least(c, F.lit(1))).otherwise(F.col(c)) if one else F.col(c)).alias(c) for c in ("ends", "goes", "stops")]
    known = counts.join(wanted, "key", "left_semi").groupBy("key", "text").agg(*sums(False)).groupBy("key").agg(*sums(True))
    # Of a form, what other texts show; where a tenth of them is less than one and none stops, its last words decide.
    others = F.col("stops") - 1
    finished = F.when(F.col("size") == 9, others >= 0.1 * (others + F.col("goes"))).otherwise((F.col("ends") > 0) & (F.col("ends") >= 0.05 * (F.col("ends") + F.col("goes"))))
    seen = (F.col("size") == 2) | ((F.col("size") == 9) & ((others > 0) | (0.1 * F.col("goes") >= 1))) | ((F.col("size") == 3) & (F.col("ends") + F.col("goes") + F.col("stops") >= 5))
    votes = open_.join(known, "key").where(seen).groupBy("message_id").agg(F.max_by(finished, "size").alias("finished"))
    cut = judged.where("defect = '?'").select("message_id").join(votes, "message_id", "left").where("not coalesce(finished, false)")
    sure = judged.where("defect <> '?'").select("message_id", "defect")
    return empty.unionByName(sure).unionByName(cut.select("message_id", F.lit("truncated").alias("defect")))


def _other_language(reply: str, question: str, filters: Filters) -> bool:
    found = [(lang, n) for lang, sure, n, _ in passages(reply, filters, {}) if lang and (n >= 4 or sure > 0.5)]
    if not found:
        return False
    allowed = {lang for lang, _, n, _ in passages(question, filters, {}) if lang and n >= 4}
    if not allowed:  # too short for its words to tell: the script does
        arabic = any("\u0600" <= c <= "\u06ff" for c in question if c.isalpha())
        latin = any(c.isalpha() and c < "\u0250" for c in question)
        allowed = ({"ar"} if arabic else set()) | ({"en", "fr", "de", "es"} if latin else set())
    if not allowed or any(lang in allowed for lang, _ in found):
        return False
    asked = {lang for lang, pattern in ASKED.items() if pattern.search(question)}
    return not any(lang in asked for lang, _ in found)
