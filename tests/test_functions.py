"""Text and URL functions, with the traps of the survey."""

import pytest
from pyspark.sql import functions as F

from docspark.config import Settings, from_environment
from docspark.functions import text as T
from docspark.functions import urls as U


def one(spark, column, *values, names="c"):
    schema = ", ".join(f"{n} string" for n in names.split())
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(column).collect()]


c = F.col("c")


def test_strip_and_squeeze(spark):
    assert one(spark, T.strip(c), " \t\nx ", " y ", None) == ["x", "y", None]
    assert one(spark, T.squeeze(c), " a \n b  c ") == ["a b c"]


def test_clean_text(spark):
    assert one(spark, T.clean_text(c), "a\x00b  c\n\n\n\nd\n--\n•\nend ", "", None) == ["ab c\n\nd\nend", "", None]


def test_tokens_and_language(spark):
    assert one(spark, T.approx_tokens(c), "", "abcdefgh", "abc") == [1, 2, 1]
    quarter = "ا" * 25 + "x" * 75
    assert one(spark, T.page_language(c), quarter, quarter + "ا", "") == ["en", "ar", "en"]
    assert one(spark, T.is_arabic(c), "ا" * 30 + "x" * 70, "ا" * 31 + "x" * 69) == [False, True]


def test_section_title(spark):
    text = "some text here.\nArticle 5 Scope\nCAPITAL RULES\nTitle Case Line\n"
    assert one(spark, T.section_title(c), text, "Article 5 Scope\nx", "Title Case Line", "a plain line of words.", "") == ["CAPITAL RULES", "Article 5 Scope", "Title Case Line", None, None]


def test_sentences(spark):
    assert one(spark, T.sentences(c), "First sentence. Second one here! Short.\n\nA third sentence") == [["First sentence.", "Second one here!", "A third sentence"]]


def test_strip_not_found(spark):
    s = Settings(not_found=("no answer", "nothing"))
    long = "x" * 41
    assert one(spark, T.strip_not_found(c, s), f"{long} no answer here", "short no answer", f"{long} nothing") == [long, "short no answer", long]


def test_drift(spark):
    s = Settings(drift=("by the way",))
    assert one(spark, T.truncate_at_drift(c, s), "One. By the way two. Three.", "By the way one. Two.", "A. B. C. D.", "") == ["One.", "By the way one. Two.", "A. B. C.", ""]


def test_clean_output(spark):
    out = one(spark, T.clean_output(c, F.lit("what?")), "Answer 漢字 here. Question: again", "A. B. C. D. E.")
    assert out == ["Answer here.", "A. B. C."]
    assert one(spark, T.clean_output(c, F.lit("ما هي المادة")), "A. B. C. D.") == ["A. B. C. D."]


def test_markers_and_scripts(spark):
    out = one(spark, T.clean_output(c, F.lit("what?")), "It is so.\n\nContext:\nsomething", "System: no", "A\t\tb。한글 ok", "User: x Question: y", None)
    assert out == ["It is so.", "", "A b ok", "", None]
    assert one(spark, T.clean_output(c, F.lit("what?"), Settings(markers=("STOP",), drift=())), "One. Question: two STOP three") == ["One. Question: two"]
    assert one(spark, T.without_east_asian(c), "カタ漢ひ") == ["カタひ"]


def test_generic_labels(spark):
    names = [("Download PDF", "http://a/x-rule.pdf"), ("تحميل الملف", "http://a/y_rule.pdf"), ("Read the report", "http://a/z.pdf"), ("12 kb", "http://a/kk_kk.pdf"), ("--- 12", "http://a/ll.pdf")]
    assert one(spark, U.clean_name(F.col("l"), F.col("u")), *names, names="l u") == ["x rule", "y rule", "Read the report", "kk kk", "ll.pdf"]


def test_questions(spark):
    assert one(spark, T.normalize_question(c), "  What  IS it?! ", None) == ["what is it", ""]
    assert one(spark, T.clean_question(c), " 3) Why  so? ") == ["Why so?"]
    got = one(spark, T.extract_questions(c), '["1. A?", "B?"]', 'Sure: ["C?"] ok', "- D?\n* 2. E?", "", None)
    assert got == [["A?", "B?"], ["C?"], ["D?", "E?"], [], []]


def test_grounding(spark):
    df = spark.createDataFrame([("The bank shall keep records", "x the bank shall keep y")], "a string, s string")
    row = df.select(T.grounding(T.phrases(F.col("a")), F.col("s")).alias("g")).first().g
    assert row.phrases == 3 and row.matched == ["the bank shall", "bank shall keep"]


def test_labels(spark):
    assert one(spark, T.short_preview(c), "a " * 200)[0].endswith("...") and len(one(spark, T.short_preview(c), "a " * 200)[0]) == 220
    assert one(spark, T.conversation_title(c), "", None, "x" * 50) == ["New conversation", "New conversation", "x" * 40]
    assert one(spark, T.date_bucket(F.to_timestamp(c), F.to_date(F.lit("2025-01-10"))), "2025-01-10", "2025-01-09", "2025-01-04", "2025-01-03", None) == ["Today", "Yesterday", "This Week", "Older", "Older"]
    assert one(spark, T.similarity_tier(c.cast("double")), "0.85", "0.7", "0.1") == ["high", "medium", "low"]
    assert one(spark, T.stored_vector(c), "[1.0, 2.0]", None) == [[1.0, 2.0], None]


def test_urls(spark):
    assert one(spark, U.is_pdf(c), "http://a/X.PDF?x=1", "http://a/x.pdf/", "http://a/x") == [True, True, False]
    pairs = [("http://a.org/d/p", "x y.html#f"), ("http://a.org/d/p", "/q/"), ("http://a.org", "https://b.org/z/"), ("http://a.org", "mailto:x@y"), ("http://a.org", None)]
    assert one(spark, U.resolve(F.col("b"), F.col("l")), *pairs, names="b l") == ["http://a.org/d/x%20y.html", "http://a.org/q", "https://b.org/z", None, None]
    names = [("Rule Book (PDF, 12 kb)", "http://a/x.pdf"), ("here", "http://a/the_big-rule.pdf"), (None, "http://a/b%20c.pdf")]
    assert one(spark, U.clean_name(F.col("l"), F.col("u")), *names, names="l u") == ["Rule Book", "the big rule", "b c"]
    assert one(spark, U.local_name(c), "http://a/ü b.pdf?q")[0].endswith("_ü_b.pdf")


def test_settings(monkeypatch):
    monkeypatch.setenv("DOCSPARK_TOP_K", "5 # comment")
    monkeypatch.setenv("DOCSPARK_LOW_CONFIDENCE", "oops")
    monkeypatch.setenv("DOCSPARK_POSTPROCESS", "false")
    s = from_environment()
    assert (s.top_k, s.low_confidence, s.postprocess) == (5, 0.72, False)


@pytest.mark.parametrize("key,text,fires", [("AML", "aml rules", True), ("AML", "xaml rules", False), ("C+", "grade c+ now", False), ("C+", "grade c+x", True), ("البنك", "على البنك نشر", True)])
def test_expansion_boundaries(spark, key, text, fires):
    from docspark.operators.guards import expand

    assert one(spark, expand(c, Settings(rules=((key, "MORE"),))), text) == [text + " MORE" if fires else text]
