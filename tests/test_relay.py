"""The relay protocol: batch against a plain reading of the log, streams against
batch, timers that fire, state that is dropped, replays that change nothing."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from textforge.operators import latency as LT
from textforge.operators import relay as R
from textforge.streaming import relay as SR

T0 = dt.datetime(2024, 1, 1)


def token(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def make_log():
    """(request_id, seq, ts, kind, status, text) rows with every kind of end."""
    rng = random.Random(3)
    rows = []

    def request(rid, at, kinds):
        for seq, (gap, kind, status, text) in enumerate(kinds):
            at += gap
            rows.append((rid, seq, T0 + dt.timedelta(seconds=at), kind, status, text))
    say = lambda *texts: [(0.25, "line", None, t) for t in texts]
    head, close = (0.0, "status", 200, None), (0.5, "close", None, None)
    request(1, 0, [head, *say(token("a"), "", "data: {bad", token(""), token("b c"), "data: [DONE]", token("after")), close])
    request(2, 1, [(0.0, "status", 503, None), *say(token("body")), close])
    request(3, 2, [head, *say(token("x")), (0.1, "failure", None, "reset"), *say(token("late")), close])
    request(4, 3, [head, *say(token("x")), (61.0, "line", None, token("y")), close])            # silent, then back
    request(5, 4, [head, *say(token("x"), token("y"))])                                         # never heard of again
    request(6, 5, [head, close])
    request(7, 6, [(0.0, "line", None, token("no head")), close])
    request(8, 7, [(0.0, "status", None, None), close])                                         # no reply code
    request(9, 8, [head, *say("data: {'choices':[{'delta':{'content':'q'}}]}", token("t") + " x", token("ü" * 150), token("z")), close])
    request(10, 9, [head, (60.0, "line", None, token("just in time")), close])
    request(11, 9, [head, (0.0, "line", None, token("instant")), (0.0, "close", None, None)])
    request(12, 9, [head, (0.0, "failure", None, None)])
    for rid in range(100, 160):
        request(rid, 10 + 5 * (rid - 100), [head, *say(*(token(f"{rng.random()}") for _ in range(rng.randrange(6)))), close])
    request(900, 400, [head, *say(token("still"), token(" open"))])
    return rows


def read_plainly(rows):
    """The events of every request, by walking its rows in order."""
    now, out = max(r[2] for r in rows), []
    for rid in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == rid), key=lambda r: r[1])
        if mine[0][3] != "status":
            continue
        start = last = mine[0][2]
        ms = lambda t: ((t - start) // dt.timedelta(microseconds=1) + 5) // 10 / 100
        n, limit = 0, dt.timedelta(seconds=60)
        for _, seq, ts, kind, status, text in mine:
            if ts - last > limit:
                out.append((rid, seq, "error", None, ms(last + limit), "generation timed out"))
                break
            last = ts
            if kind == "status" and status != 200:
                out.append((rid, seq, "error", None, ms(ts), None if status is None else f"vLLM error: {status}"))
                break
            if kind == "failure":
                out.append((rid, seq, "error", None, ms(ts), text or ""))
                break
            if kind == "close":
                out.append((rid, seq, "done", n, ms(ts), None))
                break
            try:
                said = json.loads(text[6:])["choices"][0]["delta"].get("content") if (text or "").startswith("data: ") else None
            except ValueError:
                said = None
            if said:
                out.append((rid, seq, "token", n, ms(ts), said))
                n += 1
        else:
            if last + limit < now:
                out.append((rid, mine[-1][1] + 1, "error", None, ms(last + limit), "generation timed out"))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, R.LOG_DDL).repartition(3)


def events_of(df):
    return sorted((tuple(r) for r in df.select("request_id", "seq", "kind", "idx", "ms", "text").collect()), key=str)


def follow(spark, rows, tmp, steps=4, **sinks):
    """Run the stream over the log in ``steps`` of event time; the last progress."""
    ordered = sorted(rows, key=lambda r: r[2])
    query = None
    for k in range(steps):
        part = ordered[len(ordered) * k // steps: len(ordered) * (k + 1) // steps]
        if part:
            frame(spark, part).write.mode("append").parquet(f"{tmp}/log")
        src = spark.readStream.schema(R.LOG_DDL).parquet(f"{tmp}/log")
        query = SR.start_sinks(SR.relay(src), f"{tmp}/ckpt", **{k: f"{tmp}/{v}" for k, v in sinks.items()}).start()
        query.awaitTermination()
    return query.recentProgress[-1]


def nothing_null(rows):
    return [r for r in rows if not (r[2] == "error" and r[0] == 8)]


def test_batch_equals_a_plain_reading(spark):
    rows = make_log()
    got = events_of(R.relay_events(frame(spark, rows)))
    assert nothing_null(got) == nothing_null(read_plainly(rows))
    kinds = {r[0]: r[2] for r in got if r[2] != "token"}
    assert kinds[1] == "done" and {kinds[k] for k in (2, 3, 4, 5, 8, 12)} == {"error"} and kinds[10] == "done"
    assert 7 not in kinds and 900 not in kinds
    assert R.relay_events(frame(spark, rows).limit(0)).count() == 0


def test_payloads(spark):
    rows = {(r.request_id, r.kind): json.loads(r.payload) for r in R.relay_events(frame(spark, make_log())).withColumn(
        "payload", R.sse_payload()).collect()}
    assert rows[1, "done"] == {"done": True, "total_tokens": 3, "total_ms": 2250.0}
    assert rows[2, "error"] == {"error": "vLLM error: 503"} and rows[5, "error"] == {"error": "generation timed out"}
    assert rows[9, "token"] == {"token": "z", "index": 1, "elapsed_ms": 1000.0}


def test_stream_equals_batch_and_drops_state(spark, tmp_dir):
    rows = [r for r in make_log() if r[0] != 8]
    last = follow(spark, rows, tmp_dir, events="events", texts="texts", results="results")
    log = frame(spark, rows)
    assert events_of(SR.read_sink(spark, f"{tmp_dir}/events")) == events_of(R.relay_events(log))
    text = lambda df: sorted(tuple(r) for r in df.collect())
    assert sorted(map(str, text(R.join_parts(SR.read_sink(spark, f"{tmp_dir}/texts"))))) == sorted(map(str, text(R.assemble(R.relay_events(log)))))
    results = SR.read_sink(spark, f"{tmp_dir}/results")
    cols = ["request_id", *R.RESULT_COLUMNS]
    key = lambda df: sorted(str(tuple(r)) for r in df.select(cols).collect())
    assert key(results) == key(R.request_results(log))
    # only the one open request is left in the state, whatever the number of ended ones
    assert sum(s["numRowsTotal"] for s in last["stateOperators"]) == 1
    stats = {r.label: r for r in SR.result_stats(results).collect()}
    failed = results.where("ttft_ms is null or error is not null").count()
    assert sum(r.n_failed for r in stats.values()) == failed > 5 and sum(r.n_requests for r in stats.values()) == results.count()


def test_redelivered_rows_and_replayed_batches_change_nothing(spark, tmp_dir):
    rows = [r for r in make_log() if r[0] in (1, 5, 900)]
    doubled = rows + [r for r in rows if r[1] in (1, 2)]
    follow(spark, doubled, tmp_dir, steps=1, events="events")
    sink = SR.read_sink(spark, f"{tmp_dir}/events")
    assert events_of(sink) == events_of(R.relay_events(frame(spark, rows)))
    parts = R.assembled_parts(R.relay_events(frame(spark, rows)))
    for _ in range(2):
        SR.write_batch(parts, 7, f"{tmp_dir}/parts")
    assert SR.read_sink(spark, f"{tmp_dir}/parts").count() == parts.count() == 3


def test_results_of_failed_and_instant_requests(spark):
    got = {r.request_id: r for r in R.request_results(frame(spark, make_log())).collect()}
    assert (got[2].error, got[3].error, got[4].error, got[12].error) == ("HTTP 503", "reset", "generation timed out", "")
    assert got[2].ttft_ms is None and got[2].token_count is None
    assert got[11].error == LT.ZERO_DURATION and got[11].ttft_ms is None
    assert got[9].response == "ü" * 100 and got[9].token_count == 2 and got[6].tokens_per_sec == 0.0
    assert got[1].ttft_ms == 250.0 and got[1].total_time_ms == 2250.0 and got[1].error is None


def test_strict_lines(spark):
    lines = ["data: {'choices':[{'delta':{'content':'q'}}]}", token("t") + " trailing", token("t") + ",{}", token("ok"),
             'data: {"choices":[]}', "data: [1]", "data: 5", "data: null", "data: ", "data:x", "", "data: [DONE]", None]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string").withColumn("request_id", F.lit(1))
    assert [r.seq for r in LT.sse_parse(df).collect()] == [3]
    assert [r.d for r in df.orderBy("seq").select(LT.token_delta("line").alias("d")).collect()] == [None] * 3 + ["ok"] + [None] * 9
