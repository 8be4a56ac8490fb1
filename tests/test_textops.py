import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docfacts.functions import textops as X


def values(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r[0] for r in df.orderBy("i").select(expression.alias("v")).collect()]


def test_scan_gives_exact_places_and_honours_lookaround(spark):
    texts = ["a $12 and $3😀 $45", "none", "", None, "$1$2", "x" * 5000 + " $9"]
    for text, found in zip(texts, values(spark, texts, X.regex_scan(F.col("t"), r"\$(\d)(?=\D|$)|\$\d+"))):
        if text is None:
            assert found is None
            continue
        assert [(m["start"], m["end"], m["quote"]) for m in found] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\$(\d)(?=\D|$)|\$\d+", text)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n\r\x0b\x1c\x85 –é2", max_size=25), min_size=1, max_size=40))
def test_collapse_is_idempotent_and_lines_are_those_of_splitlines(spark, texts):
    once = values(spark, texts, X.collapse(F.col("t")))
    assert values(spark, once, X.collapse(F.col("t"))) == once
    assert values(spark, texts, X.lines(F.col("t"))) == [t.splitlines() for t in texts]


def test_locate_prefers_the_window_then_the_document(spark):
    df = spark.createDataFrame([("abc xyz abc", "abc", 4, 11), ("abc xyz", "abc", 4, 7), ("abc", "no", 0, 3), ("abc", "", 0, 3), ("a b", " a\n b ", 0, 3)], "f string, q string, a int, b int")
    got = [r[0] for r in df.select(X.locate(F.col("f"), F.col("q"), F.col("a"), F.col("b"))).collect()]
    assert [None if x is None else (x["start"], x["end"]) for x in got] == [(8, 11), (0, 3), None, None, (0, 3)]


def test_reject_reasons_in_order(spark):
    texts = [None, "", " \n\t", "short", "x" * 50, "\x00" * 30 + "y" * 30, "z" * 2_000_001]
    assert values(spark, texts, X.reject_reason(F.col("t"))) == ["empty", "empty", "empty", "too_short", None, "not_printable", "too_large"]


def test_flat_offsets_agree_with_a_character_map(spark):
    text = "ab  c\n\n d\te  "
    flat = re.sub(r"\s+", " ", text).rstrip()
    df = spark.createDataFrame([(text, i) for i in range(len(text) + 1)], "t string, i int")
    got = [r[0] for r in df.orderBy("i").select(X.flat_offset(F.col("t"), F.col("i"))).collect()]
    assert got == [min(len(re.sub(r"\s+", " ", text[:i])), len(flat)) for i in range(len(text) + 1)]


def test_logical_lines_slug_and_numbers(spark):
    assert values(spark, ["• D1 - new or\nestablished\n\n(again)\nTwo", "", None], X.logical_lines(F.col("t"))) == [["• D1 - new or established (again)", "Two"], [], None]
    assert values(spark, ["Oral exams (2)!", "--", "x" * 60], X.slug(F.col("t"))) == ["oral_exams_2", "item", "x" * 40]
    assert values(spark, ["$1,200.50 and no copay, $3"], X.amounts(F.col("t"))) == [[1200.5, 3.0, 0.0]]
    assert values(spark, ["20 % or 5.5%"], X.percents(F.col("t"))) == [[20.0, 5.5]]


def test_running_sums_and_many_matches(spark):
    for n in (0, 1, 63, 64, 65, 5_000):
        got = spark.range(1).select(X.running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("int")) if n else F.array().cast("array<int>")).alias("s")).first()["s"]
        assert got == [k * (k + 1) // 2 for k in range(n)]
    text = "ab $5 €d. " * 20_000
    found = spark.createDataFrame([(text,), ("",), (None,), ("x",)], "t string").select(X.regex_scan(F.col("t"), r"\$\d").alias("m")).collect()
    assert len(found[0]["m"]) == 20_000 and found[0]["m"][-1]["start"] == len(text) - 7 and [r["m"] for r in found[1:]] == [[], None, []]


def test_squeeze_folding_and_places_against_plain_python(spark):
    texts = ["a b  c", " \t a\t b\n", "\x1c \x1d", "\u2003\u00a0x \u2003", "a\x01b\x02 \u2013 \u00ad", "plain", "", None, "  ", "a \u0085 b"]
    for t, flat, folded in zip(texts, values(spark, texts, X.squeeze(F.col("t"))), values(spark, texts, X.fold(F.col("t"), compose=False))):
        assert flat == (None if t is None else re.sub(r"[\s\x1c-\x1f]+", " ", t)), repr(t)
        assert folded == (None if t is None else re.sub("[\x01\x02\u00ad]", "", t.replace("\u2013", "-"))), repr(t)
    cases = [("ab ab ab", "ab", a, b) for a in range(9) for b in range(a, 9)] + [("éab ab", q, 2, 6) for q in ("ab", "é", "", "zz", "b ab")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, f string, q string, a int, b int")
    got = [r[0] and r[0]["start"] for r in df.orderBy("i").select(X.locate(F.col("f"), F.col("q"), F.col("a"), F.col("b"))).collect()]
    place = lambda f, q, a, b: None if not q or q not in f else f.find(q, a, b) if f.find(q, a, b) >= 0 else f.find(q)
    assert got == [place(*c) for c in cases]
