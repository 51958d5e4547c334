"""Inputs that real data holds and the test tables do not."""

import pytest
from pyspark.sql import functions as F

from textforge.operators import corpus as C
from textforge.operators import judge as J
from textforge.operators import latency as LT
from textforge.operators import requests as RQ
from textforge.streaming import sse as SS


def _raw(spark, rows):
    return spark.createDataFrame(rows, "split string, split_rank int, pos long, article string, headline string")


def test_positions_restart_in_every_split(spark):
    rows = [("train", 0, 0, "first article", "a headline that is long"), ("train", 0, 1, "second article", "another headline, long"),
            ("validation", 1, 0, "third article", "a headline that is long"), ("test", 2, 1, "fourth article", "one more headline here")]
    raw = _raw(spark, rows)
    got = {(r.split, r.pos): (r.article, r.headline) for r in C.prepare_corpus(raw).collect()}
    want = {(r.split, r.pos): (r.article, r.headline) for r in C.dedup_keep_first(
        C.filter_min_length(C.clean_corpus(raw), min_length=C.HEADLINE_MIN_LENGTH)).collect()}
    assert got == want and len(got) == 3
    report = {r.split: (r.rows_in, r.kept, r.duplicate) for r in C.cleaning_report(raw).collect()}
    assert report == {"train": (2, 2, 0), "validation": (1, 0, 1), "test": (1, 1, 0)}


@pytest.mark.parametrize("pos", [2 ** 48 + 7, 2 ** 63 - 1, -5, -(2 ** 63)])
def test_any_position_survives(spark, pos):
    raw = _raw(spark, [("train", 0, pos, "an article", "a headline that is long")])
    assert [(r.split_rank, r.pos) for r in C.prepare_corpus(raw).collect()] == [(0, pos)]


def test_empty_choices_do_not_abort(spark):
    lines = spark.createDataFrame([(1, 0, 'data: {"choices":[]}'), (1, 1, 'data: {"choices":[{"delta":{"content":"x"}}]}')],
                                  "request_id long, seq long, line string")
    assert [r.delta for r in LT.sse_parse(lines).collect()] == ["x"]
    assert lines.where(LT.token_delta("line").isNotNull()).count() == 1
    body = spark.createDataFrame([('{"choices":[],"usage":{"total_tokens":3}}',)], "body string")
    r = RQ.extract_response(body).first()
    assert r.summary is None and r.total_tokens == 3


def test_zero_duration_is_a_failure(spark):
    lines = spark.createDataFrame([(1, 0, 'data: {"choices":[{"delta":{"content":"x"}}]}'), (1, 1, "data: [DONE]")],
                                  "request_id long, seq long, line string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    r = LT.request_metrics(lines).first()
    assert r.error == LT.ZERO_DURATION and r.ttft_ms is None and r.tokens_per_sec is None
    stats = SS.stream_latency_stats(SS.request_progress(lines))
    assert stats.count() == 0


@pytest.mark.parametrize("text, ok", [
    ('{"faithfulness": 1, "darija_quality": 2, "conciseness": 3, "reasoning": "r"}', True),
    ("{'faithfulness': 1, 'darija_quality': 2, 'conciseness': 3, 'reasoning': 'r'}", False),
    ('{"faithfulness": 1, "darija_quality": 2, "conciseness": 3, "reasoning": "r"} Hope this helps', False),
    ('{"faithfulness": 1, "darija_quality": 2, "conciseness": 3, "reasoning": "r"} {', False),
    ('{"faithfulness": 1, "darija_quality": 2, "conciseness": 3, "reasoning": "r"}, {}', False), ("", False)])
def test_verdicts_are_strict_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "raw string")
    assert (J.parsed_attempts(df).first().verdict is not None) == ok == J.is_verdict(text)


def test_judge_stops_at_the_first_valid_reply(spark):
    def client():
        def reply(texts):
            return ['{"faithfulness": 1, "darija_quality": 2, "conciseness": 3, "reasoning": "r"}'
                    if t.split("\0")[0] == "easy" or t.endswith("2") else "no" for t in texts]
        return reply
    df = spark.createDataFrame([("easy",), ("hard",)], "prompt string")
    rows = J.batch_judge(df, load_client=client).collect()
    assert sorted((r.prompt, r.attempt) for r in rows) == [("easy", 1), ("hard", 1), ("hard", 2)]


def test_replayed_batch_replaces_itself(spark, tmp_dir):
    reqs = spark.createDataFrame([(1, "hi", None, None, None, None), (2, " ", None, None, None, None)],
                                 "request_id long, prompt string, max_tokens long, temperature double, "
                                 "repetition_penalty double, system_prompt string")
    reqs.write.parquet(f"{tmp_dir}/in")
    for ckpt in ("a", "b"):             # a second run numbers the same batch again
        src = spark.readStream.schema(reqs.schema).parquet(f"{tmp_dir}/in")
        SS.validate_stream(src, f"{tmp_dir}/ok", f"{tmp_dir}/bad", f"{tmp_dir}/{ckpt}").awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/ok").count() == 1 == spark.read.parquet(f"{tmp_dir}/bad").count()
