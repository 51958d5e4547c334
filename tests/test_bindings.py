"""Bindings B1-B10 reproduce the row counts FIXTURES.md records for sf0.01."""

from pyspark.sql import functions as F

from tests.conftest import SF_MID
from textforge.operators import latency as LT
from textforge.operators import requests as RQ
from textforge.sources import bindings as B


def test_articles_and_instructions(spark):
    b1 = B.articles(spark, SF_MID)
    assert {r.split: r.n for r in b1.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == \
        {"train": 800, "validation": 100, "test": 100}
    assert B.instructions(spark, SF_MID).count() == 1000


def test_predictions_pairs_verdicts(spark):
    assert B.predictions(spark, SF_MID).count() == 2000
    assert B.predictions_with_gaps(spark, SF_MID).count() == 1900
    assert B.embedding_pairs(spark, SF_MID).count() == 1000      # neighbours wrap around
    v = B.raw_verdicts(spark, SF_MID)
    assert v.count() == 1197 and v.select("id").distinct().count() == 399


def test_stream_lines(spark):
    b6 = B.stream_lines(spark, SF_MID)
    c = b6.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("request_id").alias("r"),
               F.count_if(F.col("line") == "").alias("blank"),
               F.count_if(F.col("line") == "data: {bad").alias("bad"),
               F.count_if(F.col("line") == 'data: {"choices":[{"delta":{}}]}').alias("empty"),
               F.count_if(F.col("line") == LT.DONE_LINE).alias("done")).first()
    assert (c.n, c.r, c.blank, c.bad, c.empty, c.done) == (10000, 150, 1986, 1984, 1947, 150)


def test_requests_measurements_log(spark):
    v = RQ.validate_requests(B.requests(spark, SF_MID))
    assert v.count() == 1000
    m = LT.filter_valid_results(B.measurements(spark, SF_MID))
    assert {r.label: r.n for r in m.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == \
        {"sequential": 3939, "concurrent": 4047}
    log = B.training_log(spark, SF_MID)
    assert log.count() == 10000 and log.select("run").distinct().count() == 5
    assert B.responses(spark, SF_MID).count() == 10000
