"""Arithmetic goldens: LCS/ROUGE, floor-rank percentiles, median, bands, config flattening."""

import pytest
from pyspark.sql import functions as F

from textforge.functions import lcs as L
from textforge.operators import evaluate as EV
from textforge.operators import judge as J
from textforge.operators import latency as LT
from textforge.operators import runs as RN


def test_lcs_goldens():
    assert L.lcs_length("the cat sat on the mat".split(), "the cat on the mat".split()) == 5
    assert L.lcs_length("a b c d".split(), "d c b a".split()) == 1
    assert L.lcs_length(["x"], []) == 0
    p, r, _ = L.rouge_l("the cat on the mat".split(), "the cat sat on the mat".split())
    assert p == 1.0 and r == pytest.approx(5 / 6)


def test_rouge_lsum_union():
    ref = [["a", "b", "c"], ["d", "e"]]
    cand = [["a", "c"], ["d", "x", "e"]]
    p, r, _ = L.rouge_lsum(cand, ref)
    assert (p, r) == (4 / 5, 4 / 5)


def test_rouge_n_native(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat on the mat"),
                                (2, "", "x"), (3, "a a a", "a b")], "id int, predicted string, reference string")
    r = {x.id: x for x in EV.rouge_n(df, ["id"]).collect()}
    assert r[1].rouge1_r == 1.0 and r[1].rouge1_p == pytest.approx(5 / 6)
    assert r[1].rouge2_p == pytest.approx(3 / 5) and r[1].rouge2_r == pytest.approx(3 / 4)
    assert r[2].rouge1_f == 0.0 and r[2].rouge2_f == 0.0
    assert r[3].rouge1_p == pytest.approx(1 / 3) and r[3].rouge1_r == 0.5


def test_percentile_floor_rank(spark):
    df = spark.range(20).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"), F.col("id").alias("k"))
    r = LT.percentile_rank_floor(df, "v", ["g"], ["k"]).first()
    assert r.p95 == 19.0 and r.p99 == 19.0
    df = spark.range(100).select(F.lit("x").alias("g"), F.col("id").cast("double").alias("v"), F.col("id").alias("k"))
    r = LT.percentile_rank_floor(df, "v", ["g"], ["k"]).first()
    assert (r.p95, r.p99) == (95.0, 99.0)


def test_latency_summary_median(spark):
    rows = [("s", i, float(i), 8.0 * i, float(i % 3), None) for i in range(20)]
    rows.append(("s", 99, None, 1.0, 0.0, "HTTP 500"))
    df = spark.createDataFrame(rows, "label string, request_id long, ttft_ms double, total_time_ms double, "
                                     "tokens_per_sec double, error string")
    r = LT.latency_summary(df).first()
    assert (r.n_requests, r.n_successful, r.n_failed) == (21, 20, 1)
    assert r.ttft_median_ms == 9.5 and r.ttft_p95_ms == 19.0 and r.ttft_mean_ms == 9.5


def test_no_row_without_valid(spark):
    df = spark.createDataFrame([("c", 1, None, 1.0, 0.0, "boom")],
                               "label string, request_id long, ttft_ms double, total_time_ms double, "
                               "tokens_per_sec double, error string")
    assert LT.latency_summary(df).count() == 0


def test_diagnose_bands(spark):
    vals = [99.9, 100.0, 100.1, 200.0, 200.1, 500.1]
    df = spark.createDataFrame([(v,) for v in vals], "m double")
    got = [r.b for r in df.select(LT.diagnose_latency("m").alias("b")).collect()]
    assert got == ["met", "none", "moderate", "moderate", "high", "severe"]


def test_stats_format(spark):
    df = spark.createDataFrame([("sequential", "ttft_mean_ms", 104.305), ("sequential", "n_requests", 100.0)],
                               "label string, metric string, value double")
    lines = sorted(r.line for r in LT.stats_report_lines(df).collect())
    assert lines == ["sequential/n_requests: 100", "sequential/ttft_mean_ms: 104.30"]


def test_flatten_config(spark):
    df = spark.sql("SELECT named_struct('a', named_struct('b', 1, 'c', named_struct('d', 2)), 'e', array(3, 4)) AS cfg")
    got = {(r.key, r.value) for r in RN.flatten_config(df, "cfg").collect()}
    assert got == {("a.b", "1"), ("a.c.d", "2"), ("e", "[3,4]")}


def test_strip_code_fence_and_parse(spark):
    raws = ['```json\n{"a":1}\n```', '  {"faithfulness": 4, "darija_quality": 3, "conciseness": 2, "reasoning": "ok"} ',
            '{"faithfulness": null, "darija_quality": 3, "conciseness": 2, "reasoning": "x"}',
            '{"faithfulness": 3}', "not json"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    out = df.select("i", J.strip_code_fence("raw").alias("t")).withColumn("v", J.parse_verdict("t")).orderBy("i").collect()
    assert out[0].t == '{"a":1}'
    assert out[1].v.faithfulness == 4.0 and out[1].v.reasoning == "ok"
    assert out[2].v is not None and out[2].v.faithfulness is None     # a present null passes
    assert out[3].v is None and out[4].v is None


def test_first_valid_attempt(spark):
    rows = [(1, 1, "bad"), (1, 2, '{"faithfulness": 5, "darija_quality": 4, "conciseness": 3, "reasoning": "r"}'),
            (1, 3, '{"faithfulness": 1, "darija_quality": 1, "conciseness": 1, "reasoning": "late"}'),
            (2, 1, "x"), (2, 2, "y"), (2, 3, "z")]
    df = spark.createDataFrame(rows, "id long, attempt int, raw string")
    r = {x.id: x for x in J.judge_first_valid_attempt(df).collect()}
    assert (r[1].faithfulness, r[1].attempts_used, r[1].valid) == (5.0, 2, True)
    assert (r[2].faithfulness, r[2].reasoning, r[2].attempts_used) == (None, "evaluation failed", 3)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])],
                               "a array<double>, b array<double>")
    got = [r.s for r in df.select(EV.cosine_similarity("a", "b").alias("s")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_masked_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1.0), (1, [3.0, 4.0], 1.0), (1, [100.0, 100.0], 0.0)],
                               "g int, v array<double>, m double")
    got = sorted((r.dim, r.value) for r in EV.masked_mean_pool(df, ["g"], "v", F.col("m")).collect())
    assert got == [(0, 2.0), (1, 3.0)]
