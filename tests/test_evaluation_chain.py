"""LCS positions, the bootstrap, masks, the generation chain, kept judge replies,
CSV read in blocks and streams that forget keys without letting them pass again."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textforge.functions import lcs as L
from textforge.operators import evaluate as EV
from textforge.operators import judge as J
from textforge.sources import io as IO
from textforge.streaming import sse as SS


def dense_indices(ref, cand):
    """Positions by the full table, ties moving in ``ref``."""
    n, m = len(ref), len(cand)
    t = np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i, j] = t[i - 1, j - 1] + 1 if ref[i - 1] == cand[j - 1] else max(t[i - 1, j], t[i, j - 1])
    out, i, j = [], n, m
    while i and j:
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i, j - 1] > t[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def test_lcs_positions_equal_the_full_table():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(25))] for _ in range(2))
        assert L.lcs_indices(a, b) == dense_indices(a, b)
        assert len(L.lcs_indices(a, b)) == L.lcs_length(a, b)
    long = [str(rng.randrange(50)) for _ in range(6000)]
    got = L.lcs_indices(long, long[500:] + long[:500])
    assert len(got) == L.lcs_length(long, long[500:] + long[:500]) and got == sorted(set(got))


def test_rouge_lsum_of_several_sentences(spark):
    df = spark.createDataFrame([(1, "a c\nd x e", "a b c\nd e"), (2, "", "x\ny"), (3, None, None), (4, "\n\n", "a")],
                               "id int, predicted string, reference string")
    r = {x.id: x for x in EV.rouge_lsum(df, ["id"]).collect()}
    assert (r[1].rougeLsum_p, r[1].rougeLsum_r) == (4 / 5, 4 / 5)
    assert [r[k].rougeLsum_f for k in (2, 3, 4)] == [0.0] * 3


def test_bootstrap_is_deterministic_and_brackets_the_mean(spark):
    rng = random.Random(5)
    rows = [(i, m, rng.random(), rng.random() ** 2) for i in range(800) for m in ("a", "b")]
    df = spark.createDataFrame(rows, "id long, model string, x_f double, y_f double")
    once = EV.rouge_interval(df.repartition(3), variants=("x", "y")).collect()
    again = EV.rouge_interval(df.repartition(7, "id"), variants=("x", "y")).collect()
    key = lambda rs: sorted((r.model, r.variant, round(r.low, 9), round(r.mid, 9), round(r.high, 9)) for r in rs)
    assert key(once) == key(again) and len(once) == 4
    for r in once:
        mean = np.mean([row[2 if r.variant == "x" else 3] for row in rows if row[1] == r.model])
        assert r.low < mean < r.high and r.high - r.low < 0.06 and abs(r.mid - mean) < 0.01
    w = spark.range(3000).select(F.explode(EV.poisson_weights(F.col("id"), 16)).alias("w"))
    m, v, top = w.select(F.avg("w"), F.var_pop("w"), F.max("w")).first()
    assert abs(m - 1) < 0.03 and abs(v - 1) < 0.06 and top >= 5


def test_pool_with_a_mask(spark):
    df = spark.createDataFrame([("g", [1.0, 2.0], 1), ("g", [9.0, 9.0], 0), ("g", [3.0, 4.0], 1), ("none", [5.0, 5.0], 0)],
                               "g string, embedding array<double>, m int")
    got = {(r.g, r.dim): r.value for r in EV.masked_mean_pool(df, ["g"], mask=F.col("m")).collect()}
    assert got == {("g", 0): 2.0, ("g", 1): 3.0, ("none", 0): 0.0, ("none", 1): 0.0}


def test_generation_chain_accounts_for_every_row(spark):
    rows = [(1, "sum", "one two three"), (2, "sum", "w " * 2000), (3, "sum", ""), (4, "sum", "skip me")]
    df = spark.createDataFrame(rows, "id long, instruction string, input string")

    def loader():
        def model(texts):
            assert all(len(t) < 3000 for t in texts)     # long prompts never get here
            return ["" if t.startswith("skip") or not t else t.upper() for t in texts]
        return model
    kept, skipped = EV.generate_chain(df, loader)
    assert {(r.id, r.predicted) for r in kept.collect()} == {(1, "ONE TWO THREE")}
    assert {(r.id, r.reason) for r in skipped.collect()} == {(2, "prompt too long"), (3, "empty prediction"), (4, "empty prediction")}


def test_replies_are_kept(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id long, prompt string")
    store = f"{tmp_dir}/replies"
    first = {(r.id, r.attempt, r.raw) for r in J.judge_with_store(df, store).collect()}
    assert {x[0] for x in first} == {1, 2, 3} and spark.read.parquet(store).count() == 2

    def nobody():
        def client(texts):
            raise AssertionError("asked again")
        return client
    again = {(r.id, r.attempt, r.raw) for r in J.judge_with_store(df, store, load_client=nobody).collect()}
    assert again == first
    more = df.union(spark.createDataFrame([(9, "new")], df.schema))

    def only_new():
        def client(texts):
            assert all(t.startswith("new") for t in texts)
            return ["never valid"] * len(texts)
        return client
    rows = J.judge_with_store(more, store, load_client=only_new).where("id = 9").collect()
    assert sorted(r.attempt for r in rows) == [1, 2, 3]      # invalid replies are asked for again, and all kept


def test_calls_are_paced():
    now, slept, asked = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s
    client = J.paced(lambda texts: asked.append((now[0], *texts)) or ["r"], 4.0, lambda: now[0], sleep)
    assert client(["a", "b"]) == ["r", "r"] and client(["c"]) == ["r"]
    assert asked == [(0.0, "a"), (4.0, "b"), (8.0, "c")] and slept == [4.0, 4.0]


@pytest.mark.parametrize("block", [64, 300, 1 << 20])
def test_csv_blocks_equal_the_whole_file_reader(spark, tmp_dir, block):
    rng = random.Random(block)
    odd = ['plain', 'with, comma', 'a "quoted" word', 'two\nlines', '"', '""', '\n\n', 'x' * 500, '', 'é漢', 'ends with quote"', ',\n",', "tab\t "]
    rows = [(str(i), rng.choice(odd), rng.choice(odd) + rng.choice(odd), rng.choice(odd), "\n".join(rng.choice(odd) for _ in range(3))) for i in range(150)]
    df = spark.createDataFrame(rows, IO.PREDICTION_SCHEMA)
    IO.write_csv(df.repartition(2), f"{tmp_dir}/csv")
    keys = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        parts = spark.read.text(f"{tmp_dir}/csv").rdd.getNumPartitions()
        got = sorted(map(tuple, IO.scan_csv_blocks(spark, f"{tmp_dir}/csv").collect()))
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = sorted(map(tuple, IO.scan_csv(spark, f"{tmp_dir}/csv").collect()))
    assert got == want == sorted(rows)
    assert parts > (20 if block == 64 else 0)


def test_dedup_into_a_table_forgets_without_repeating(spark, tmp_dir):
    """Keys come back long after the state has dropped them, and after a replay."""
    def run(rows):
        spark.createDataFrame(rows, "headline string, pos long, minute long").select(
            "headline", "pos", F.timestamp_seconds(F.col("minute") * 60).alias("ts")).write.mode("append").parquet(f"{tmp_dir}/in")
        src = spark.readStream.schema("headline string, pos long, ts timestamp").parquet(f"{tmp_dir}/in")
        q = SS.dedup_to_table(src, f"{tmp_dir}/out", f"{tmp_dir}/ckpt", "headline", ["pos"], "ts", "10 minutes").start()
        q.awaitTermination()
        return sum(s["numRowsTotal"] for s in q.recentProgress[-1]["stateOperators"])
    run([(f"h{i}", i, i) for i in range(100)])
    held = run([(f"h{i}", 500 + i, 1000 + i) for i in range(0, 100, 2)] + [("new", 999, 1100)])
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert sorted(r.headline for r in out.collect()) == sorted([f"h{i}" for i in range(100)] + ["new"])
    assert out.where("headline = 'h4'").first().pos == 4
    assert held < 20        # of 101 keys only those of the last minutes
