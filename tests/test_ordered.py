"""The scalable ordered index must equal row_number()/running sums, also for a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from textforge.plans.ordered import ordered_running


def test_matches_window_with_hot_group(spark):
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("g"),  # key 0 holds a third
        ((F.col("id") * 7919) % n).alias("o"), (F.col("id") % 13).cast("double").alias("v"))
    got = ordered_running(df, ["g"], ["o"], index_col="i", sums={"s": F.col("v")}, num_partitions=7)
    w = Window.partitionBy("g").orderBy("o")
    ref = df.select("g", "o", (F.row_number().over(w) - 1).alias("i2"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s2"))
    bad = got.join(ref, ["g", "o"]).where((F.col("i") != F.col("i2")) | (F.col("s") != F.col("s2")))
    assert got.count() == n and bad.count() == 0


def test_no_group(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("o"))
    got = ordered_running(df, [], ["o"], index_col="i", num_partitions=5)
    assert got.where(F.col("i") != F.col("o")).count() == 0


def test_null_group_is_a_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.lit(1)).alias("g"), F.col("id").alias("o"))
    got = ordered_running(df, ["g"], ["o"], index_col="i", num_partitions=4)
    assert got.where(F.col("i") != F.floor(F.col("o") / 2)).count() == 0 and got.count() == 1000


def test_pieces_follow_the_scanned_bytes(spark):
    from tests.conftest import SF_MID, SF_SMALL
    from textforge.plans.ordered import leaf_bytes
    from textforge.sources.tables import read_table

    def both(sf):
        e = read_table(spark, sf, "embeddings")
        return leaf_bytes(e), leaf_bytes(e.join(e.select(F.col("vec_id").alias("v")), F.col("v") == F.col("vec_id") + 1))
    for sf in (SF_SMALL, SF_MID):
        one, joined = both(sf)
        assert joined <= 2 * one
