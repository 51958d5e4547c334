"""Intermediate tables and connected components, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.session import scratch_path


def fresh_path(spark, name: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses (and retries after a lost
    executor) start from the table, not from the plan behind it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node reachable over ``edges`` (a, b);
    only nodes that have an edge. Alternating large-star and small-star steps:
    every step is an aggregate (combined before the shuffle) and a join whose
    hot keys Spark can split; no node's neighbours are ever gathered."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # large star: every larger neighbour of u now hangs on u's least neighbour
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.where("m < u").select("u", F.col("m").alias("v")))).distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours hang on the least of them
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))).distinct()
        small = materialise(small, "small-star")
        tally = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if small.select(tally).first() == e.select(tally).first():
            return small.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        e = small
