"""Cleaning rules: the reference's unit cases as equalities, plus hostile Unicode."""

import pytest

from textforge.functions import text as T
from textforge.operators import corpus as C


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    rows = df.select("i", fn("t").alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


@pytest.mark.parametrize("fn,inp,out", [
    (T.strip_urls, "text https://example.com end", "text  end"),
    (T.strip_urls, "visit www.example.com today", "visit  today"),
    (T.strip_html_tags, "<div><span>text</span></div>", "text"),
    (T.fold_alef, "إ", "ا"), (T.fold_alef, "أ", "ا"), (T.fold_alef, "آ", "ا"),
    (T.drop_tatweel, "مـر", "مر"),
    (T.drop_diacritics, "مَرْ", "مر"),
    (T.fold_maqsura, "على", "علي"),
    (T.fold_taa_marbuta, "ة", "ه"),
    (T.collapse_runs, "ل" + "ا" * 5, "لاا"),
    (T.expand_lamalef, "ﻻ", "لا"),
    (T.filter_charset, "café résumé", "café résumé"),
    (T.filter_charset, "text @#$% text", "text  text"),
    (T.squeeze_whitespace, "   ", ""),
    (T.squeeze_whitespace, "", ""),
    (T.squeeze_whitespace, "a \t b\n\nc ", "a b c"),
    (T.clean_text, "<p>إعلان</p>", "اعلان"),
    (T.clean_text, "", ""),
])
def test_rules(spark, fn, inp, out):
    assert run(spark, fn, [inp]) == [out]


HOSTILE = [
    ("a b", "a b"), ("x<b\ry>z", "xz"), ("x<b y>z", "xz"), ("aaa bbb", "aa bb"),
    ("www.x y", "y"), ("a\u001Cb", "a b"), ("\r\r\r\rq", "q"), ("!!!!a", "a"),
    ("\U0001F600\U0001F600\U0001F600k", "k"), ("<a\nb>c", "a bc"), ("  ", ""),
    ("إأآ ﻵ لاااا", "اا لا لاا"),
]


def test_hostile_unicode(spark):
    assert run(spark, T.clean_text, [i for i, _ in HOSTILE]) == [o for _, o in HOSTILE]


def test_null_stays_null(spark):
    assert run(spark, T.clean_text, [None]) == [None]


def test_deterministic(spark):
    vals = ["<b>Hello</b> https://x.y world!!!", "مرحبا   بكم"]
    assert run(spark, T.clean_text, vals) == run(spark, T.clean_text, vals)


def test_min_length(spark):
    df = spark.createDataFrame([("ن" * 10,), ("قصير",), ("     ",), ("",)], "headline string")
    kept = [r.headline for r in C.filter_min_length(df, "headline", 10).collect()]
    assert kept == ["ن" * 10]


def test_dedup_first_wins_across_splits(spark):
    rows = [("train", 0, 5, "a1", "same headline"), ("validation", 1, 1, "a2", "same headline"),
            ("train", 0, 2, "a3", "same headline"), ("test", 2, 0, "a4", "other headline")]
    df = spark.createDataFrame(rows, "split string, split_rank int, pos long, article string, headline string")
    out = {r.headline: (r.split, r.pos) for r in C.dedup_keep_first(df).collect()}
    assert out == {"same headline": ("train", 2), "other headline": ("test", 0)}
