"""Physical-plan guards for the scale-relevant choices."""

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def _plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_is_hash_aggregate(spark):
    p = _plan(spark, "dedup_keep_first")
    assert "partial_min" in p and "SortAggregate" not in p


def test_rouge_n_single_key_exchange(spark):
    p = _plan(spark, "rouge_n")
    hash_exchanges = [l for l in p.splitlines() if "Exchange hashpartitioning" in l]
    assert len(hash_exchanges) == 1 and "id" in hash_exchanges[0] and "model" in hash_exchanges[0]


def test_top_k_partial_limit(spark):
    """Where rows of a run are spread over tasks, each keeps its k before the exchange."""
    from pyspark.sql import functions as F
    from textforge.operators import runs as RN
    log = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("run"), (F.col("id") * 50).alias("step"), F.rand(1).alias("loss"),
        F.rand(2).alias("eval_loss"), F.lit(0.1).alias("learning_rate"), F.current_timestamp().alias("logged_at"))
    p = RN.retain_last_k(log)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "WindowGroupLimit" in _plan(spark, "retain_last_k")


def test_column_pruning(spark):
    p = _plan(spark, "latency_summary")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in p


def test_no_python_in_cleaning(spark):
    p = _plan(spark, "clean_text")
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_per_label_side_is_broadcast(spark):
    p = _plan(spark, "latency_summary")
    assert "BroadcastHashJoin" in p and "SortMergeJoin" not in p
