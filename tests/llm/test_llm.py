"""Each operator against a brute-force version or an exact round trip, and the cases that its docstring defines."""

import datetime as dt
import math
import os
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import conversations, fm_index, hnsw, lang_id, ocr_repair, pair_defects, shared_spans, splitter, tokens, visual_form


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORDS = ["alpha", "beta", "gamma", "delta", "kappa", "omega", "sigma", "theta", "zeta", "rho"]
EN = "the bank shall keep all records of the customer for ten years and must submit the annual report to the board"
FR = "la banque doit conserver le registre des clients pendant dix années et doit transmettre le rapport annuel au conseil"
DE = "die bank muss die unterlagen der kunden zehn jahre lang aufbewahren und den bericht bei der behörde einreichen"
ES = "el banco debe conservar el registro de los clientes durante diez años y tiene que presentar el informe anual al consejo"
AR = "يجب على البنك حفظ سجلات العملاء لمدة عشر سنوات وتقديم التقرير السنوي إلى مجلس الإدارة قبل نهاية السنة"


@pytest.fixture(scope="module")
def language_filters():
    look = lang_id.look_table()
    texts = {"en": EN, "fr": FR, "de": DE, "es": ES, "ar": AR}
    rng = random.Random(1)
    data = []
    for lang, text in texts.items():
        w = text.split()
        for _ in range(60):
            data.append((lang, " ".join(rng.sample(w, 12)) + "."))
    data += [("fr", EN + ".")] * 10  # wrong labels
    return lang_id.fit(data, look), look


# 1


def test_languages(spark, language_filters):
    filters, look = language_filters
    texts = [
        ("a", EN + ". " + AR + "."), ("b", FR.upper() + "."), ("c", "The bank (لجنة الامتثال) shall keep all records of the customer."),
        ("d", ""), ("e", None), ("f", "12 34 ..."), ("g", "Thе bаnk shаll kеер аll rесоrds of the customer."), ("h", (ES + ". ") * 3000),
    ]
    df = spark.createDataFrame([(k, t, "x") for k, t in texts + texts[:1]], "key string, t string, lang string").drop("lang")
    got = {r.key: r for r in lang_id.languages(df, filters, look, "t", ["key"]).collect()}
    main = {k: [p.lang for p in r.passages if p.words >= 4] for k, r in got.items()}
    assert main == {"a": ["en", "ar"], "b": ["fr"], "c": ["en"], "d": [], "e": [], "f": [], "g": ["en"], "h": ["es"]}
    assert got["b"].confidence > 0.3 and got["d"].lang is None and got["d"].confidence == 0
    assert lang_id.languages(df.limit(0), filters, look, "t", ["key"]).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("EN",), ("en-SA",), ("fra",), ("Arabic",), ("und",), ("",), (None,), ("entity",)], "l string")
    assert [r[0] for r in df.select(lang_id.label_language(F.col("l"))).collect()] == ["en", "en", "fr", "ar", None, None, None, None]


def test_masks_have_few_false_positives(language_filters):
    filters, _ = language_filters
    assert all(f < 0.01 for f in filters.false)
    assert sum(bool(filters.mask(f"#{i}#")) for i in range(2000)) < 20


# 2


def _messages(spark, data):
    df = spark.createDataFrame(data, "message_id string, session_id string, user_message string, assistant_message string, t string")
    return df.withColumn("timestamp", F.to_timestamp("t")).withColumn("user_id", F.lit("u")).drop("t")


def test_conversations(spark):
    m = _messages(spark, [
        ("b", " S1", "second question", "second answer", "2025-01-02 00:00:00"), ("a", "s1", "first question", None, "2025-01-01 00:00:00"),
        ("a", "s1", None, "first answer", "2025-01-01 00:01:00"), ("a", "s1", "first question", None, "2025-01-03 00:00:00"),
        ("c", "s2", "question", "...", "2025-01-01 00:00:00"), ("d", "s2", "fine", "answer", "2025-01-01 00:00:00"),
        ("e", None, "lost", "found", "2025-01-01 00:00:00"), ("f", "s3", "q", "a", None), ("g", "s4", "q", None, "2025-01-01 00:05:00"),
        ("g", "s4", None, "a", "2025-01-01 00:04:00"), ("h", None, "nowhere", "a", "2025-01-01 00:00:00"), (None, "s5", "q", "a", "2025-01-01 00:00:00"),
    ])
    f = spark.createDataFrame([("S9 ", "e"), (None, "h"), ("zz", "a")], "session_id string, message_id string")
    got = conversations.conversations(m, f).select("session_id", "turn_no", "message_id", "role")
    assert rows(got) == [
        ("s1", 1, "a", "user"), ("s1", 2, "a", "assistant"), ("s1", 3, "b", "user"), ("s1", 4, "b", "assistant"), ("s9", 1, "e", "user"), ("s9", 2, "e", "assistant"),
    ]
    assert conversations.conversations(m.limit(0), f.limit(0)).count() == 0


def test_links_to_the_likeliest_parent(spark):
    m = _messages(spark, [
        ("a", "s", "about liquidity ratios", None, "2025-01-01 00:00:00"), ("b", "s", None, "liquidity ratios matter", "2025-01-01 00:01:00"),
        ("c", "s", "thanks then", "welcome", "2025-01-01 00:02:00"), ("d", "s", "next day", None, "2025-01-03 00:00:00"), ("e", "s", None, "...", "2025-01-03 00:00:00"),
    ])
    f = spark.createDataFrame([], "session_id string, message_id string")
    got = {(r.message_id, r.role): (r.parent_id, r.parent_role) for r in conversations.links(conversations.units(conversations.exchanges(m, f))).collect()}
    assert got == {("a", "user"): (None, None), ("b", "assistant"): ("a", "user"), ("c", "user"): ("b", "assistant"), ("c", "assistant"): ("c", "user"), ("d", "user"): ("c", "assistant"), ("e", None): (None, None)}


def test_a_mention_can_be_outvoted(spark):
    """A reply that came hours later, in the words of the question just asked, goes to that one, so neither exchange is whole."""
    m = _messages(spark, [
        ("a", "s", "about liquidity ratios", None, "2025-01-01 00:00:00"), ("b", "s", "which capital buffers apply here", None, "2025-01-01 09:00:00"),
        ("a", "s", None, "which capital buffers apply here", "2025-01-01 09:00:05"), ("b", "s", None, "these buffers", "2025-01-01 09:01:00"), ("c", "t", "fine", "good", "2025-01-01 00:00:00"),
    ])
    f = spark.createDataFrame([], "session_id string, message_id string")
    got = {(r.message_id, r.role): r.parent_id for r in conversations.links(conversations.units(conversations.exchanges(m, f))).collect()}
    assert got["a", "assistant"] == "b"
    assert rows(conversations.conversations(m, f).select("session_id").distinct()) == [("t",)]


def test_links_to_any_earlier_unit(spark):
    """Parents far back: behind many questions, on the day before, and by words that many others come before."""
    long = " ".join(f"word{i:03}" for i in range(60))
    between = [(f"m{i:02}", "s", f"note {chr(97 + i) * 6}", None, f"2025-01-02 00:{i + 5:02}:00") for i in range(12)]
    m = _messages(spark, [
        ("a", "s", "about liquidity ratios", None, "2025-01-01 00:00:00"), ("b", "s", "which capital buffers apply here", None, "2025-01-01 23:58:00"), *between,
        ("a", "s", None, "which capital buffers apply here", "2025-01-02 00:20:00"), ("c", "s", None, "capital buffers again", "2025-01-05 00:00:00"),
        ("x", "t", long + " mine", None, "2025-01-01 00:00:00"), ("y", "t", long + " other else", None, "2025-01-01 00:00:00"), ("z", "t", None, "mine " + long, "2025-01-03 00:00:00"),
        ("d", "u", "fine", "good", "2025-01-01 00:00:00"),
    ])
    f = spark.createDataFrame([], "session_id string, message_id string")
    got = {(r.message_id, r.role): r.parent_id for r in conversations.links(conversations.units(conversations.exchanges(m, f))).collect()}
    assert got["a", "assistant"] == "b" and got["c", "assistant"] == "b" and got["z", "assistant"] == "x"
    both = m.union(_messages(spark, [(k, "s", None, "something", "2025-01-02 01:00:00") for k in ["b", *(x[0] for x in between)]] + [("c", "s", "something", None, "2025-01-05 00:00:00")]))
    assert rows(conversations.conversations(both, f).select("session_id").distinct()) == [("u",)]


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    vocabulary, data = [f"w{i:03}x" for i in range(12)], []
    for i in range(240):
        at = rng.integers(0, 400_000) if i % 12 < 8 else rng.integers(75_000, 95_000)  # some of the sessions have many at once
        for side, t in ((0, at), (1, at + rng.integers(0, 15_000))):
            text = " ".join(rng.choice(vocabulary, rng.integers(1, 5)))
            day, rest = divmod(int(t), 86_400)
            data.append((f"{i:03}", f"s{i % 12}", None if side else text, text if side else None, f"2025-01-{1 + day:02} {rest // 3600:02}:{rest // 60 % 60:02}:{rest % 60:02}"))
    m, f = _messages(spark, data), spark.createDataFrame([], "session_id string, message_id string")
    got = {(r.message_id, r.role): (r.parent_id, r.parent_role, r.score) for r in conversations.links(conversations.units(conversations.exchanges(m, f))).collect()}
    units = [(r[1], r[4], r[0], "assistant" if r[2] is None else "user", set((r[2] or r[3]).split())) for r in data]
    lost = set()
    for s, t, i, role, words in units:
        best = (-1.0,)
        for s2, t2, i2, role2, words2 in units:
            own = role == "assistant" and role2 == "user" and i2 == i
            if s2 == s and (own or (t2, i2) < (t, i) and (role == "user" or role2 == "user")):
                seconds = (dt.datetime.fromisoformat(t) - dt.datetime.fromisoformat(t2)).total_seconds()
                score = 1.5 * own + math.exp(-seconds / 3600) + len(words & words2) / min(len(words), len(words2))
                best = max(best, (round(score, 9), t2, role2 == "assistant", i2, role2))
        parent = got[i, role]
        assert (parent[:2] if parent[0] else (None, None)) == (best[3:] if len(best) > 1 else (None, None))
        lost |= {s} if role == "assistant" and parent[0] != i else set()
    assert 0 < len(lost) < 12
    assert {r[0] for r in conversations.conversations(m, f).select("session_id").collect()} == {f"s{i}" for i in range(12)} - lost


def test_interleaved_threads_are_parted_by_links(spark):
    """Two talks in one channel, message by message, with nothing but words and times to tell them apart."""
    one = ["reporting liquidity ratios quarterly", "liquidity ratios quarterly reporting deadline", "deadline for liquidity ratios reporting", "ratios reporting deadline extended"]
    two = ["customer complaint records archive", "archive complaint records securely", "securely archive customer records", "records archive customer access"]
    data = [(f"{t}{i}", "room", text, i, n) for n, t, texts in ((0, "x", one), (1, "y", two)) for i, text in enumerate(texts)]
    m = _messages(spark, [(k, s, text if i % 2 == 0 else None, None if i % 2 == 0 else text, f"2025-01-01 00:{2 * i + n:02}:00") for k, s, text, i, n in data])
    f = spark.createDataFrame([], "session_id string, message_id string")
    parted = conversations.threads(conversations.links(conversations.units(conversations.exchanges(m, f))))
    groups = {}
    for r in parted.collect():
        groups.setdefault(r.thread, set()).add(r.message_id)
    assert sorted(map(sorted, groups.values())) == [["x0", "x1", "x2", "x3"], ["y0", "y1", "y2", "y3"]]


def test_interleaved_exchanges_keep_their_numbers(spark):
    m = _messages(spark, [
        ("a", "s", "first", None, "2025-01-01 23:59:00"), ("b", "s", "second", None, "2025-01-01 23:59:30"), ("a", "s", None, "reply one", "2025-01-02 00:00:10"), ("b", "s", None, "reply two", "2025-01-02 00:00:20"),
        ("b", "s", None, "reply two", None), ("c", "s", "third", "fine", "2025-01-02 00:01:00"), ("d", "u", "q", "a", "2025-01-02 00:01:00"), ("d", "u", "...", "", None),
    ])
    f = spark.createDataFrame([], "session_id string, message_id string")
    got = rows(conversations.conversations(m, f).select("session_id", "turn_no", "message_id", "role"))
    assert got == [("s", 1, "a", "user"), ("s", 2, "a", "assistant"), ("s", 3, "b", "user"), ("s", 4, "b", "assistant"), ("s", 5, "c", "user"), ("s", 6, "c", "assistant")]


# 3


@pytest.mark.parametrize("text,open_", [("a (b", True), ("a (b) [c].", False), ("```x", True), ("```(```", False), ('say "x', True), ("« a »", False), ("a\n- ", True), ("<b>x", True), ("<b>x</b><br>", False), ("", False), ("it's", False)])
def test_pushdown(text, open_):
    assert pair_defects.left_open(text) is open_


def test_tiles_and_copies():
    a, b = "one two three x four five six".split(), "four five six one two three".split()
    assert pair_defects.tiles(a, b) == [True] * 3 + [False] + [True] * 3
    q = "what must the bank do with the annual report of the board"
    assert pair_defects.is_copy("you asked: " + q, q) and pair_defects.is_copy(q + "\n" + q, q) and pair_defects.is_copy(q.replace("the annual", "annual"), q)
    assert not pair_defects.is_copy("you asked: " + q + "? the bank must submit it within nine days.", q) and not pair_defects.is_copy("", q)


def test_tiles_by_hashes():
    rng = random.Random(9)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        covered = pair_defects.tiles(a, b, 3)
        runs = {tuple(b[j : j + 3]) for j in range(len(b) - 2)}
        longest = any(tuple(a[i : i + 3]) in runs for i in range(len(a) - 2))
        assert len(covered) == len(a) and any(covered) == longest
        edges = "".join("x" if c else " " for c in covered).split()
        assert all(len(e) >= 3 for e in edges)
    long = ["w"] * 3000
    assert all(pair_defects.tiles(long, long))


def test_refusals_of_any_length_and_with_numbers():
    for text in ("i cannot discuss article 5.", "i am sorry, but as things stand with the rules, forms, circulars, letters and other papers that the authority has published so far i cannot answer this question.",
                 "i can't help with this. please call 800 123 or write to the authority.", "ich kann zu artikel 12 leider keine auskunft geben.", "no puedo responder a la pregunta 7."):
        assert pair_defects.is_refusal(text)
    for text in ("i cannot help with this. the bank must contact the customer within 5 days.", "the bank cannot refuse to answer.", "nobody may share the report.", "the supervisor does not provide it."):
        assert not pair_defects.is_refusal(text)


def test_refusals():
    for text in ("i am sorry, but i cannot help with this request. please contact the authority.", "nothing on this was found.", "je ne suis pas en mesure de vous aider.", "لا يمكنني المساعدة في هذا الطلب."):
        assert pair_defects.is_refusal(text)
    for text in ("i am sorry for the delay. the bank must keep records for 10 years.", "the bank cannot share the report with article 5.", ""):
        assert not pair_defects.is_refusal(text)


def test_defects(spark, language_filters):
    filters, look = language_filters
    base = [(f"n{i}", "s", f"what must the bank keep for customer {i}?", EN.capitalize() + ".", "2025-01-01 00:00:00") for i in range(30)]
    odd = [
        ("empty", "s", "what must the bank keep?", " ​ ", "2025-01-01 00:00:00"), ("none", "s", "what must the bank keep?", None, "2025-01-01 00:00:00"),
        ("silent", "s", "...", "", "2025-01-01 00:00:00"), ("cut", "s", "what must the bank keep?", "The bank shall keep all records of the", "2025-01-01 00:00:00"),
        ("stop", "s", "what must the bank keep?", EN.capitalize(), "2025-01-01 00:00:00"), ("open", "s", "what must the bank keep?", "The bank shall keep all records (see", "2025-01-01 00:00:00"),
        ("fr", "s", "what must the bank keep for the customer?", FR.capitalize() + ".", "2025-01-01 00:00:00"), ("frok", "s", "what must the bank keep? please reply in french.", FR + ".", "2025-01-01 00:00:00"),
        ("copy", "s", "what must the bank keep for ten years?", "What must the bank keep for ten years?", "2025-01-01 00:00:00"), ("no", "s", "what must the bank keep?", "I cannot help with this request.", "2025-01-01 00:00:00"),
        ("long", "s", "what must the bank keep?", (EN + ". ") * 2000, "2025-01-01 00:00:00"),
    ]
    m = _messages(spark, base + odd + odd[:1])
    got = dict(rows(pair_defects.defects(m, filters, look)))
    assert got == {"empty": "empty", "none": "empty", "cut": "truncated", "open": "truncated", "fr": "other_language", "copy": "copy", "no": "refusal"}
    assert pair_defects.defects(m.limit(0), filters, look).count() == 0


def test_short_replies_are_judged_by_share(spark, language_filters):
    filters, look = language_filters
    ask, at = "what must the bank keep for the customer?", "2025-01-01 00:00:00"
    long = [(f"l{i}", "s", ask, f"In case the customer is {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 3}, the bank shall keep all records {i}.", at) for i in range(100)]
    cut = [(f"c{i}", "s", ask, f"In case the customer is {x}", at) for i, x in enumerate(("uvu", "vwv", "wxw"))]
    copies = [(f"k{i}", "s", ask, "The bank must submit the report to", at) for i in range(3)]
    whole = [(f"w{i}", "s", ask, f"Within {i} years of the report", at) for i in range(9)]
    got = dict(rows(pair_defects.defects(_messages(spark, long + cut + copies + whole), filters, look)))
    assert got == dict.fromkeys(("c0", "c1", "c2", "k0", "k1", "k2"), "truncated")


# 4


def test_repair():
    model = tuple(np.log(x) for x in (ocr_repair.START, ocr_repair.MOVE, ocr_repair.EMIT))
    text = "The bank shall keep the records of all custo-\nmers for ten years and must submit the annual\n\n- 12 -\nRULEBOOK ON LIQUIDITY | 12\nreport to the board. The insurer shall do the same."
    noise, body = ocr_repair.repair(text, "Rulebook on Liquidity", "", (12, 12), model)
    assert sorted(n[0] for n in noise) == ["header", "hyphen", "page_number"] and ("hyphen", "customers", "custo-mers", False) in noise
    assert body == ["The bank shall keep the records of all customers for ten years and must submit the annual report to the board. The insurer shall do the same."]
    assert ocr_repair.repair("", "", "", (None, None), model) == ([], [])
    noise, _ = ocr_repair.repair("The bank shall keep the records of all custo-\nmers", "", "", (None, None), model)
    assert noise == [("hyphen", "customers", "custo-mers", True)]
    _, body = ocr_repair.repair("The plan of the third-\nparty stays.", "", "", (None, None), model, {"third-party": "third-party"})
    assert body == ["The plan of the third-party stays."]


def test_confusions(spark):
    pairs = [("c0ntinuity", "continuity"), ("vvith1n", "within"), ("procluction", "production"), ("accuracy", "accuracy"), ("acc11racy", "accuracy"), ("rnediiim", "medium"), ("1iab1l1ty", "liability"), ("cl0c5", "does"), ("dear", "clear"), ("clear", "dear")]
    assert [ocr_repair.misreads(w, r) for w, r in pairs] == [True, True, True, False, False, True, True, True, True, True]
    assert not ocr_repair.misreads("continuity", "c0ntinuity")
    rng = random.Random(11)
    data = []
    for _ in range(300):
        right = "".join(rng.choice("abcdehilmnorsuvw") for _ in range(rng.randint(3, 9)))
        wrong = right
        for w, r in rng.sample(ocr_repair.CONFUSIONS, 4):
            wrong = wrong.replace(r, w, 1)
        data.append((wrong, right))
    df = spark.createDataFrame(data, "w string, r string")
    assert df.where(ocr_repair.strokes(F.col("w")) != ocr_repair.strokes(F.col("r"))).count() == 0


def test_scan_noise(spark):
    model = tuple(np.log(x) for x in (ocr_repair.START, ocr_repair.MOVE, ocr_repair.EMIT))
    clean = [("chunk", f"c{i}", "the continuity plan of the third-party stays within limits", "N", None, 1, 1) for i in range(20)]
    scan = [("chunk", "x", "the c0nt1nu1ty plan of the third-\nparty stays within the lim-\nits and C0ntinuity", "N", None, 1, 1), ("source", "1", None, None, None, None, None), ("source", "2", "", "", "", None, None)]
    cut = [("source", "3", "the plan of the limits stays vvithin\nthe plan of the lim-\nits", "N", None, 1, 1), ("source", "4", "the plan of the limits stays within\nthe c0ntinuity", "N", None, 1, 1),
           ("chunk", "y", "the plan of the limits stays within\nthe c0ntinuity", "N", None, 1, 1), ("source", "5", "the plan of the limits stays within\nthe c0ntinuit", "N", None, 1, 1),
           ("chunk", "z", "the plan of the limits stays vvithin\nthe plan of the lim-\nits and more", "N", None, 1, 1)]
    kind = "item_kind string, item_key string, text string, name string, title string, first int, last int"
    df = spark.createDataFrame(clean + scan + cut, kind)
    assert rows(ocr_repair.scan_noise(df, model, {})) == [
        ("chunk", "x", "hyphen", "limits"), ("chunk", "x", "misread", "continuity"), ("chunk", "y", "misread", "continuity"), ("chunk", "z", "hyphen", "limits"), ("chunk", "z", "misread", "within"), ("source", "3", "misread", "within"), ("source", "4", "misread", "continuity"),
    ]
    assert ocr_repair.scan_noise(df.limit(0), model, {}).count() == 0
    text = {(r.item_kind, r.item_key): r.paragraph for r in ocr_repair.repaired(df, model, {}).collect()}
    assert text["chunk", "x"] == "the continuity plan of the third-party stays within the limits and Continuity" and text["chunk", "c0"] == clean[0][2]
    assert text["source", "3"].startswith("the plan of the limits stays within the plan") and ("source", "2") not in text
    assert ocr_repair.repaired(df.limit(0), model, {}).count() == 0


def test_layout_is_fitted_on_all_texts(spark):
    kind = "item_kind string, item_key string, text string, name string, title string, first int, last int"
    data = [("chunk", str(i), "The bank shall keep the records of its customers for\nten years and more.\n\n- 7 -", "N", None, 7, 7) for i in range(400)]
    fitted = ocr_repair.fit_layout(spark.createDataFrame(data, kind))
    same = ocr_repair.fit_layout(spark.createDataFrame(data[::-1], kind).repartition(7))
    assert all(np.allclose(a, b) and np.allclose(np.exp(a).sum(-1), 1) for a, b in zip(fitted, same))
    assert fitted[1][1, 3] > np.log(ocr_repair.MOVE[1, 3]) and len(ocr_repair.fit_layout(spark.createDataFrame([], kind))) == 3


# 5


def _text(rng, n):
    out = []
    while sum(map(len, out)) < n:
        out.append(rng.choice(WORDS) * rng.randint(1, 3) + rng.choice([" ", " ", " ", ". ", ".\n\n", "\n", "؟ ", "  "]))
    return "".join(out)


def _coarsest(text, limit):
    import re

    paragraphs = re.split(r"\s*\n\s*\n\s*", text)
    sentences = [s for p in paragraphs for s in re.split(r"(?<=[.!?؟])\s+", p)]
    words = [w for s in sentences for w in re.split(r"\s+", s)]
    for name, parts in (("paragraph", paragraphs), ("sentence", sentences), ("word", words)):
        if max(map(len, parts)) <= limit:
            return name
    return "none"


@pytest.mark.parametrize("range_chars", [120, 65_536])
def test_pieces_and_boundaries(spark, range_chars):
    rng = random.Random(3)
    texts = [(i, _text(rng, rng.randint(20, 900))) for i in range(40)] + [(90, "x" * 333), (91, None), (92, ""), (93, "é́́" * 100), (94, "a" * 39 + " " + "b" * 300)]
    df = spark.createDataFrame([(i, t, 7, "title", "clash") for i, t in texts], "id int, content string, page_start int, section_title string, piece string")
    limit = 40
    got = splitter.pieces(df, limit=limit, overlap=10, range_chars=range_chars).orderBy("id", "piece_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {i for i, t in texts if t and len(t) > limit}
    for i, t in texts:
        if i in by:
            assert "".join(r.piece[r.own_start - r.piece_start :] for r in by[i]) == t
            assert all(len(r.piece) <= limit and 0 <= r.own_start - r.piece_start <= 10 and r.page_start == 7 for r in by[i])
            assert [r.piece_no for r in by[i]] == list(range(1, len(by[i]) + 1))
    units = dict(rows(splitter.boundaries(df, limit=limit, range_chars=range_chars)))
    assert units == {i: _coarsest(t, limit) for i, t in texts if t and len(t) > limit}
    assert splitter.pieces(df.limit(0)).count() == 0


def test_files_are_read_in_ranges(spark, tmp_path):
    rng = random.Random(4)
    text = "".join(_text(rng, 500) + "é漢 " for _ in range(40))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    (tmp_path / "c d.txt").write_text("short", encoding="utf-8")
    got = splitter.split_files(spark, [str(tmp_path)], limit=60, overlap=0, range_bytes=2_000).orderBy("piece_no")
    pieces = [r for r in got.collect() if r.path.endswith("a.txt")]
    assert "".join(r.piece for r in pieces) == text and all(text[r.own_start : r.own_end] == r.piece for r in pieces)
    assert [r.piece for r in got.collect() if "d.txt" in r.path] == ["short"]


# 6


def test_forms(spark):
    table = dict(visual_form.tables()[0])
    marks = [c for c, _ in visual_form.tables()[0]][::37]
    rng = random.Random(5)
    texts = ["".join(rng.choice(marks + list("aeiou é ̧́ ａаο​ ﬁﻻ")) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*texts, None, "", "​", "plain", texts[0]])], "i int, t string, form string, ch string")
    got = {r.i: (r.t, r.form) for r in visual_form.with_form(df, "t").collect()}

    def plain(t):
        return unicodedata.normalize("NFC", "".join("".join(x for x, _ in table[c]) if c in table else c for c in t))

    assert all(f == plain(t) for t, f in got.values() if t is not None)
    many = [("a" + "\u0301" * 6 + "\u0323\u0302",), ("\u1112\u1161\u11ab" * 3,), ("x\u0323\u0307\u0301",), ("e\u0301\u0302",), ("\u0301a",)]
    assert all(r.form == unicodedata.normalize("NFC", r.t) for r in visual_form.with_form(spark.createDataFrame(many, "t string"), "t").collect())
    assert got[300] == (None, None) and got[301][1] == "" and got[302][1] == "" and got[303][1] == "plain"
    again = spark.createDataFrame([(i, f) for i, (_, f) in got.items() if f], "i int, t string")
    assert visual_form.with_form(again, "t").where("form <> t").count() == 0


def test_look_alikes_in_context(spark):
    """Each letter with a look-alike, alone and at the beginning, in the middle and at the end of words."""
    around = [("", ""), ("x", ""), ("", "x"), ("x", "x"), ("ب", "ب"), ("", "\u0654"), ("a ", " b"), ("\n", "\n")]
    data = [(f"{a}{c}{b}", f"{a}{d}{b}") for c, d in visual_form.LOOK_ALIKES.items() for a, b in around]
    df = spark.createDataFrame(data, "t string, u string")
    made = visual_form.with_form(visual_form.with_form(df, "t", "f"), "u", "g").collect()
    assert len(made) == len(data) and all(r.f == r.g for r in made)
    # The Farsi and the Arabic yeh look the same within a word and before hamza; a dotless one looks different.
    yeh = visual_form.with_form(spark.createDataFrame([("عرب\u06cc",), ("عربي",), ("عربى",)], "t string"), "t", "f").collect()
    assert len({r.f for r in yeh}) == 2 and len({r.f for r in yeh if not r.t.endswith("ى")}) == 1


def test_look_alike_pairs(spark):
    data = [("k", "1", "Café"), ("k", "2", "Café"), ("k", "3", "Сafé"), ("k", "4", "CAFÉ"), ("k", "5", "Café"), ("m", "6", "Caf​é"), ("k", "7", None), ("k", "8", "..."), ("k", "9", "…​.."), ("k", "a", "Cafe"), ("k", "2", "Café")]
    got = rows(visual_form.look_alike_pairs(spark.createDataFrame(data, "item_kind string, item_key string, text string")))
    assert got == [("k", "1", "2"), ("k", "1", "3"), ("k", "1", "5"), ("k", "2", "3"), ("k", "3", "5")]
    classes = visual_form.look_alike_classes(spark.createDataFrame(data, "item_kind string, item_key string, text string"))
    assert sorted(r.item_key for r in classes.collect()) == ["1", "2", "3", "5"] and classes.select("f").distinct().count() == 1


# 7


def test_graph_recall():
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16))
    x = hnsw.unit(centers[rng.integers(0, 40, 1500)] + 0.2 * rng.normal(size=(1500, 16)))
    got = hnsw.Graph(x).search(x, 32)[:, :6]
    s = x @ x.T
    want = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(got, want, strict=True)]) > 0.95


def test_visitors_find_all_and_members_start_at_themselves():
    rng = np.random.default_rng(9)
    x, q = hnsw.unit(rng.normal(size=(1500, 24))), hnsw.unit(rng.normal(size=(200, 24)))
    graph = hnsw.Graph(x, 16, 48)
    assert (np.sort(graph.visited(q, 6)) == np.sort(np.argsort(-(q @ x.T), axis=1)[:, :6])).all()
    some = np.arange(0, 1500, 3)
    assert (graph.search(x[some], 12, members=some)[:, 0] == some).all()
    ids, sims = hnsw.scan(x[:5], x[:5], 9, np.arange(5))
    assert ids.shape == (5, 4) and (np.diff(sims) <= 0).all() and not (ids == np.arange(5)[:, None]).any()


def test_hot_regions_get_more_centroids(spark):
    rng = np.random.default_rng(8)
    dense = hnsw.unit(np.array([1.0, *[0.0] * 15]) + 0.05 * rng.normal(size=(3000, 16)))
    x = np.concatenate((dense, hnsw.unit(rng.normal(size=(1000, 16)))))
    first = hnsw.centroids(x, 4)
    first[1:] = hnsw.unit(rng.normal(size=(3, 16)))
    first[0] = dense[0]
    c = hnsw.split_hot(x, first, len(x), 200, 800)
    sizes = np.bincount(hnsw._nearest(x.astype(np.float32), c.astype(np.float32), 1)[:, 0])
    assert len(c) > len(first) and sizes.max() <= 800
    df = spark.createDataFrame([(f"{i:04}", v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id string, embedding array<float>")
    got = hnsw.neighbours(df, width=16, shard_size=100, sample=400).groupBy("id").count().where("count = 5").count()
    assert got == 4000


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    data = [(f"{i:03}", v.tolist(), 1.0) for i, v in enumerate(x)]
    data += [(f"c{i}", x[0].tolist(), 1.0) for i in range(9)] + [("s", (x[1] * 3).tolist(), 1.0)]
    data += [("n", None, 1.0), ("w", [1.0], 1.0), ("z", [0.0] * 8, 1.0), ("q", [float("nan")] * 8, 1.0), ("i", [float("inf")] + [0.0] * 7, 1.0), (None, x[5].tolist(), 1.0), data[3]]
    df = spark.createDataFrame(data, "id string, embedding array<float>, sim double")
    got = {}
    for r in hnsw.neighbours(df, width=8, shard_size=100, sample=200).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    good = {i: np.array(v, np.float32) for i, v, _ in data if i and v and len(v) == 8 and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    u = hnsw.unit(np.array([good[i] for i in ids]))
    s = np.round(u @ u.T, 6)
    hits = total = 0
    for a, i in enumerate(ids):
        want = [ids[b] for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:5]]
        hits, total = hits + len(set(want) & got[i]), total + 5
        assert len(got[i]) == 5
    assert set(got) == set(ids) and hits / total > 0.9
    assert got["c8"] == {"000", "c0", "c1", "c2", "c3"} and got["s"] >= {"001"}
    found = {}
    for r in hnsw.neighbours(df, width=8, shard_size=40, sample=200, exact=True).collect():
        found.setdefault(r.id, set()).add(r.neighbour)
    for a, i in enumerate(ids):
        assert found[i] == {ids[b] for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:5]}
    assert hnsw.neighbours(df.limit(0), width=8).count() == 0
    assert hnsw.neighbours(df.where("id = '001'"), width=8).count() == 0


# 8


def rank_file():
    path = os.environ.get("DOCSPARK_RANK_FILE")
    if not path:
        path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
    return path


def test_tokens(spark):
    texts = ["Hello world", "", None, "é漢\n\n  x ", "<|endoftext|> a", "Hello world", "word " * 9000 + "x" * 30000, "\x00​"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df, rank_file()).collect()}
    enc = tokens.encoding(rank_file())
    assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)} and got[1] == got[2] == []
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df, rank_file()), rank_file()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.limit(0), rank_file()).count() == 0


def test_spans_keep_the_ids():
    rng = random.Random(8)
    enc = tokens.encoding(rank_file())
    for _ in range(400):
        text = "".join(rng.choice(["a", " ", "  ", "1", ".", "'s", "\n", "é", " b", "字", "。", "e\u0301", "'", "ll", "٣", "\t", "\u00a0", "😀", "\u3000"]) for _ in range(200))
        assert "".join(tokens.spans(text, 10)) == text
        assert [i for s in tokens.spans(text, 10) for i in enc.encode_ordinary(s)] == enc.encode_ordinary(text)
    for text in ("字符。" * 500, "ab12" * 500, "x\n" * 500):  # long texts without a blank are cut as well
        assert max(map(len, tokens.spans(text, 100))) < 110 and [i for s in tokens.spans(text, 100) for i in enc.encode_ordinary(s)] == enc.encode_ordinary(text)


# 9


def test_suffix_order():
    rng = np.random.default_rng(9)
    for _ in range(20):
        s = np.append(rng.integers(0, 3, 200), 0)
        zeros = np.cumsum(s == 0) - 1
        key = [(0, int(z)) if x == 0 else (1, int(x)) for x, z in zip(s, zeros, strict=True)]
        assert fm_index.suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: key[i:])


def test_search_and_locate():
    rng = np.random.default_rng(10)
    s = np.append(rng.integers(0, 4, 500), 0)
    index = fm_index.FMIndex(s)
    patterns = rng.integers(1, 5, (60, 3))
    lo, hi = index.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks(spark):
    rng = random.Random(11)
    item = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(6)]
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(40)]
    docs[3] = (3, docs[3][1] + " " + item[0].upper().replace(" ", " -- ") + " x")
    docs[4] = (4, " ".join(item[1].split()[4:16]))
    docs[5] = (5, " ".join(item[1].split()[4:15]))
    docs += [(90, None), (91, ""), (92, docs[3][1] * 50), (93, item[2] + " " + item[3])]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, span_start int")
    items = spark.createDataFrame([(i, t, None if i else "short one") for i, t in enumerate(item)], "item_id bigint, question string, passage string")
    got = fm_index.leaks(df, items, shard_words=500, block=20)

    def runs(t):
        w = fm_index.words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = sorted((i, j) for i, t in docs for j, q in enumerate(item) if runs(t) & runs(q))
    assert rows(got.select("doc_id", "item_id").distinct()) == want and (4, 1) in want and (5, 1) not in want
    span = got.where("doc_id = 3 and item_id = 0").first()
    assert fm_index.words(docs[3][1][span.span_start : span.span_end]) == item[0].split()
    assert fm_index.leaks(df.limit(0), items).count() == 0 and fm_index.leaks(df, items.limit(0)).count() == 0


# 10


def _shared(docs, length):
    windows = {}
    for i, t in docs:
        for k in range(len(t or "") - length + 1):
            windows.setdefault(t[k : k + length], set()).add(i)
    out = []
    for i, t in docs:
        spans = []
        for k in range(len(t or "") - length + 1):
            if len(windows[t[k : k + length]]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        out += [(i, a, b) for a, b in spans]
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 4, 2_000])
def test_shared_spans(spark, limit):
    rng = random.Random(12)
    parts = ["".join(rng.choice("abc é漢") for _ in range(rng.randint(20, 120))) for _ in range(12)]
    docs = [(i, "".join(rng.choice(parts)[rng.randint(0, 15) :] for _ in range(rng.randint(1, 6)))) for i in range(40)]
    docs += [(90, None), (91, ""), (92, "a" * 200), (93, "a" * 90 + "b"), (94, docs[0][1]), (95, "z" * 40)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, h int")
    got = shared_spans.shared_spans(df, length=30, group_limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == _shared(docs, 30)
    assert shared_spans.shared_spans(df.limit(0)).count() == 0
