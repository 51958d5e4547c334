from pyspark.sql import functions as F

from tests.llm.helpers import documents, quality
from textforge.llm import quality as Q

LONG = " ".join(f"w{i}x{i % 11}" for i in range(600))
TEXTS = [None, "", "\n\n", "a", "one two\none two\n\none two", "x y z " * 40, LONG, LONG + "\n" + LONG[:200], "#*$%&|<> é 漢 😀 b",
         "THE LOUD ONE!! " * 3 + " ".join(f"W{i}" for i in range(30)), "a\x0bb\x0cc\rd\te", "l\n" * 30, " ".join(f"tok{i}###" for i in range(30)),
         "same same", "q" * 5000]


def test_measures_against_brute_force(spark):
    df = documents(spark, TEXTS + TEXTS[5:7], extra=("_tf_m", "n_words", "fail_bits"))
    rows = {r.doc_id: r for r in Q.ledger(df).collect()}
    for i, t in enumerate(TEXTS + TEXTS[5:7]):
        r = rows[i]
        want = quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert bool(r.fail_bits & Q.BIT["few_words"]) == (want[0] < 20)
        assert bool(r.fail_bits & Q.BIT["repeated_words"]) == (100 * want[4] > 30 * want[0])


def test_policies_and_ablations(spark):
    df = documents(spark, TEXTS)
    led = Q.ledger(df)
    kept = {r.doc_id for r in led.where(Q.passes()).collect()}
    assert {r.doc_id for r in Q.apply_policy(df).collect()} == kept and 6 in kept and 9 not in kept and 12 not in kept
    assert kept <= {r.doc_id for r in led.where(Q.passes("v1")).collect()}
    table = {r.rule: r for r in Q.ablations(led).collect()}
    mask = Q.POLICIES[Q.CURRENT]
    bits = [r.fail_bits & mask for r in led.collect()]
    for name, bit in Q.BIT.items():
        assert table[name].n_failed == sum(b & bit != 0 for b in bits)
        assert table[name].n_failed_only == sum(b == bit for b in bits)
        assert table[name].n_kept_without == sum(b & ~bit == 0 for b in bits)
    empty = df.limit(0)
    assert Q.ledger(empty).count() == 0 and {r.n_failed for r in Q.ablations(Q.ledger(empty)).collect()} == {0}


def test_plan_is_native(spark):
    plan = Q.ledger(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert Q.ledger(documents(spark, TEXTS).withColumn("doc_id", F.lit(None).cast("long"))).count() == len(TEXTS)
