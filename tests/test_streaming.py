"""Streams equal their batch twins: parse, relay (index across micro-batches), assemble,
validation sinks, dedup and the event-time timeout."""

import time

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textforge.operators import latency as LT
from textforge.sources import bindings as B
from textforge.sources import io as IO
from textforge.streaming import sse as SS


def _lines(spark, tmp_dir, parts=3, stall_every=0):
    b6 = B.stream_lines(spark, SF_SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    if stall_every:
        # these requests never send [DONE]: they stall and must time out
        b6 = b6.where(~((F.col("request_id") % stall_every == 0) & (F.col("line") == LT.DONE_LINE)))
    cuts = b6.select(F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("c")).first()["c"]
    bounds = [None, *cuts, None]
    path = f"{tmp_dir}/lines"
    for i in range(parts):
        cond = F.lit(True)
        if bounds[i] is not None:
            cond = cond & (F.col("ts") > F.lit(bounds[i]))
        if bounds[i + 1] is not None:
            cond = cond & (F.col("ts") <= F.lit(bounds[i + 1]))
        IO.write_lines(b6.where(cond).coalesce(1), path)
        time.sleep(1.05)
    return b6, path


def _drain(df, tmp_dir, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", f"{tmp_dir}/ck-{name}").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_relay_matches_batch(spark, tmp_dir):
    b6, path = _lines(spark, tmp_dir)
    src = IO.stream_lines_source(spark, path)
    ev = _drain(SS.relay_events(src, timeout=False), tmp_dir, "relay")
    j = F.from_json("event", "token string, index long, elapsed_ms double, total_tokens long")
    tok = {(r.request_id, r.seq): (r.i, r.ms) for r in ev.where("kind = 'token'")
           .select("request_id", "seq", j["index"].alias("i"), j["elapsed_ms"].alias("ms")).collect()}
    batch = {(r.request_id, r.seq): (r.token_index, r.elapsed_ms)
             for r in LT.token_events(b6).select("request_id", "seq", "token_index", "elapsed_ms").collect()}
    assert tok == batch
    done = {r.request_id: r.n for r in ev.where("kind = 'done'").select("request_id", j["total_tokens"].alias("n")).collect()}
    bdone = {r.request_id: r.total_tokens for r in LT.done_events(b6).collect()}
    assert done == bdone
    # indices are 0..n-1 without gaps for every request
    for rid, n in done.items():
        assert sorted(i for (r, _), (i, _) in tok.items() if r == rid) == list(range(n))


def test_parse_and_assemble(spark, tmp_dir):
    b6, path = _lines(spark, tmp_dir)
    src = IO.stream_lines_source(spark, path)
    got = _drain(SS.assemble_stream(src), tmp_dir, "asm", "complete")
    want = {r.request_id: r.text for r in LT.assemble_text(b6).collect()}
    assert {r.request_id: r.text for r in got.collect()} == want


def test_timeout_fires(spark, tmp_dir):
    b6, path = _lines(spark, tmp_dir, stall_every=3)
    src = IO.stream_lines_source(spark, path)
    ev = _drain(SS.relay_events(src, timeout=True), tmp_dir, "relay_to")
    timed_out = {r.request_id for r in ev.where("kind = 'error'").where(
        F.col("event").contains(SS.TIMEOUT_MESSAGE)).collect()}
    stalled = {r.request_id for r in b6.select("request_id").distinct().collect() if r.request_id % 3 == 0}
    assert stalled and stalled <= timed_out


def test_validate_stream(spark, tmp_dir):
    reqs = B.requests(spark, SF_SMALL)
    reqs.write.parquet(f"{tmp_dir}/req")
    src = spark.readStream.schema(reqs.schema).parquet(f"{tmp_dir}/req")
    q = SS.validate_stream(src, f"{tmp_dir}/ok", f"{tmp_dir}/bad", f"{tmp_dir}/ck-val")
    q.awaitTermination()
    ok = spark.read.parquet(f"{tmp_dir}/ok").count()
    bad = spark.read.parquet(f"{tmp_dir}/bad").count()
    assert ok + bad == reqs.count() and ok > 0 and bad > 0


def test_dedup_stream(spark, tmp_dir):
    rows = [("h1", "2024-01-01 00:00:00"), ("h1", "2024-01-01 00:10:00"), ("h2", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "headline string, ts string").withColumn("ts", F.col("ts").cast("timestamp")) \
        .write.parquet(f"{tmp_dir}/heads")
    src = spark.readStream.schema("headline string, ts timestamp").parquet(f"{tmp_dir}/heads")
    got = _drain(SS.dedup_stream(src, delay="1 hour"), tmp_dir, "dd")
    assert sorted(r.headline for r in got.collect()) == ["h1", "h2"]


def test_stream_latency_stats(spark, tmp_dir):
    b6, path = _lines(spark, tmp_dir)
    src = IO.stream_lines_source(spark, path)
    prog = _drain(SS.request_progress(src), tmp_dir, "prog", "complete")
    got = {r.label: r for r in SS.stream_latency_stats(prog).collect()}
    m = LT.request_metrics(b6).withColumn(
        "label", F.when(F.col("request_id") % 2 == 0, "sequential").otherwise("concurrent"))
    want = {r.label: r for r in LT.latency_summary(m).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k].n_successful == want[k].n_successful
        assert abs(got[k].ttft_mean_ms - want[k].ttft_mean_ms) < 1e-6


def test_metrics_listener(spark, tmp_dir):
    from textforge.streaming.listener import MetricsListener
    lst = MetricsListener(spark, f"{tmp_dir}/metrics", "run-1")
    spark.streams.addListener(lst)
    try:
        _, path = _lines(spark, tmp_dir, parts=2)
        src = IO.stream_lines_source(spark, path)
        _drain(SS.parse_stream(src), tmp_dir, "lst")
        time.sleep(2)               # listener events are delivered asynchronously
        lst.flush()
    finally:
        spark.streams.removeListener(lst)
    m = IO.read_metrics(spark, f"{tmp_dir}/metrics")
    assert m.where("key like 'stream/lst/numInputRows'").count() >= 1
