"""Order statistics by counting equal sorted values; no table is written for them."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from textforge.operators import corpus as C
from textforge.operators import latency as LT
from textforge.plans import selection as S
from textforge.plans.ordered import ordered_running


def _groups():
    rng = random.Random(2)
    return {"one": [5.0], "two": [1.0, 2.0], "same": [7.0] * 500, "mixed": [rng.choice([1.0, 2.0, rng.random() * 9]) for _ in range(3000)],
            None: [float(i) for i in range(20)], "wide": [rng.lognormvariate(0, 9) for _ in range(2000)], "odd": [1.0, 2.0, float("inf")],
            "none": [None, None]}


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_ranks_equal_sorted_values(spark, rounds):
    rows = [(g, v) for g, vs in _groups().items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ranks = [*S.middle_ranks("a", "b"), S.floor_rank("p95", 0.95), S.floor_rank("p0", 0.0), S.floor_rank("p999", 0.999)]
    got = {r.g: r for r in S.select_ranks(df, ["g"], F.col("v"), ranks, rounds=rounds).collect()}
    assert set(got) == set(_groups()) - {"none"}
    for g, r in got.items():
        vs = sorted(_groups()[g])
        n = len(vs)
        want = {"a": vs[(n - 1) // 2], "b": vs[n // 2], "p95": vs[int(n * 0.95)], "p0": vs[0], "p999": vs[int(n * 0.999)]}
        assert {k: r[k] for k in want} == want and r.n == n
        assert all(r[f"{k}_before"] == sum(v < want[k] for v in vs) for k in want)


def test_coarse_probes_are_still_exact(spark, monkeypatch):
    """With a sketch of a few samples the probes are wide apart, and the counts between them decide."""
    monkeypatch.setattr(S, "ACCURACY", 20)
    vs = [float((i * 7919) % 5000) for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in vs], "v double").repartition(4)
    for rounds in (0, 1):
        r = S.select_ranks(df, [], F.col("v"), [S.floor_rank("x", 0.37)], rounds=rounds).first()
        assert r.x == sorted(vs)[1850] and r.n == 5000


def _no_checkpoint(monkeypatch):
    from pyspark.sql import classic, DataFrame

    def refuse(*_, **__):
        raise AssertionError("a table was checkpointed")
    monkeypatch.setattr(classic.dataframe.DataFrame, "checkpoint", refuse)
    monkeypatch.setattr(DataFrame, "checkpoint", refuse)


@pytest.mark.parametrize("name", ["latency_summary", "percentile_rank_floor", "split_exact", "token_index", "request_metrics",
                                  "running_mean_every_k", "assign_versions"])
def test_no_table_is_written_for_an_order(spark, name, monkeypatch):
    _no_checkpoint(monkeypatch)
    assert E.queries()[name](spark, SF_SMALL).count() > 0


def _exact_sizes(n, ratios):
    n_train = int(n * ratios[0])
    rest = n - n_train
    n_test = min(rest, math.ceil(rest * ratios[2] / (ratios[1] + ratios[2])))
    return {k: v for k, v in (("train", n_train), ("val", rest - n_test), ("test", n_test)) if v}


@pytest.mark.parametrize("n", [0, 1, 3, 21, 1000])
def test_split_exact_sizes(spark, n):
    df = spark.range(n)
    for ratios in ((0.9, 0.05, 0.05), (0.5, 0.5, 0.0), (0.0, 0.5, 0.5), (1.0, 0.5, 0.5)):
        out = C.split_exact(df, "id", ratios=ratios)
        got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert got == _exact_sizes(n, ratios), ratios
        if n > 20:      # the order is the one by (hash, id)
            rows = out.select("id", "split", C.split_bucket("id").alias("h")).orderBy("h", "id").collect()
            want = [k for k, v in _exact_sizes(n, ratios).items() for _ in range(v)]
            assert [r["split"] for r in rows] == want


def test_split_exact_with_repeated_and_null_ids(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("id"))
    got = {r["split"]: r["count"] for r in C.split_exact(df, "id").groupBy("split").count().collect()}
    assert got == _exact_sizes(300, C.SPLIT_RATIOS)


def test_hot_and_cold_groups(spark):
    """Groups below the bound go through windows, the others through ranges: same positions."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("g"), F.col("id").alias("o"))
    both = ordered_running(df, ["g"], ["o"], index_col="i", sums={"s": F.col("o")}, hot_rows=500)
    cold = ordered_running(df, ["g"], ["o"], index_col="i", sums={"s": F.col("o")})
    key = lambda x: sorted((r.o, r.i, r.s) for r in x.collect())
    assert key(both) == key(cold) and both.dtypes == cold.dtypes


def test_infinite_rates_stay_infinite(spark):
    rows = [("a", 1, 1.0, 2.0, float("inf"), None), ("a", 2, 3.0, 2.0, 1.0, ""), ("b", 3, 1e-12, 1e-12, 3e-12, None), ("c", 4, None, 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "label string, request_id long, ttft_ms double, total_time_ms double, tokens_per_sec double, error string")
    got = {r.label: r for r in LT.latency_summary(df).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].throughput_mean_tps == float("inf") and got["a"].ttft_mean_ms == 2.0 and got["a"].ttft_median_ms == 2.0
    assert got["b"].ttft_mean_ms == 1e-12 and got["b"].throughput_max_tps == 3e-12


def test_headlines_without_a_place(spark):
    """Rows with a null order come last, and a headline that only they have is kept once."""
    rows = [("train", 0, 1, "art one", "a headline long enough"), ("train", 0, None, "art two", "another headline here"),
            ("train", 0, None, "art zwei", "another headline here"), ("val", None, 4, "art three", "a third headline now"),
            ("val", None, None, "art four", "a headline long enough"), ("test", 2, None, "art five", "short")]
    raw = spark.createDataFrame(rows, "split string, split_rank int, pos long, article string, headline string")
    got = sorted((r.headline, r.article, r.split) for r in C.prepare_corpus(raw).collect())
    assert got == [("a headline long enough", "art one", "train"), ("a third headline now", "art three", "val"),
                   ("another headline here", "art two", "train")]
    report = {r["split"]: (r.rows_in, r.short, r.duplicate, r.kept) for r in C.cleaning_report(raw).collect()}
    assert report == {"train": (3, 0, 1, 2), "val": (2, 0, 1, 1), "test": (1, 1, 0, 0)}


def test_report_of_other_labels(spark, tmp_dir):
    lines = spark.createDataFrame([("nightly", 1, "nightly/n_requests: 3"), ("sequential", 1, "x: 1")], "section string, line_no int, line string")
    LT.write_stats_report(lines, f"{tmp_dir}/r")
    assert [r.value for r in spark.read.text(f"{tmp_dir}/r").collect()] == [
        "=== SEQUENTIAL BENCHMARK ===", "x: 1", "=== NIGHTLY BENCHMARK ===", "nightly/n_requests: 3"]
