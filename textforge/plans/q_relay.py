"""Registered queries: the relay protocol over the request log B11, in batch and
as streams whose event-time timers fire (T2-T6, L1 with failures)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textforge.operators import relay as R
from textforge.plans.fixtures_sql import with_bindings
from textforge.plans.q_runs import _scratch, _start
from textforge.plans.q_serving import _summary_sql
from textforge.plans.registry import register
from textforge.sources import bindings as B
from textforge.streaming import relay as SR

_MS = lambda a, b: f"((epoch_us({b}) - epoch_us({a}) + 5) // 10) / 100.0"

# every row with what ends its request there, then each request's first end (or silence by the log's last moment)
_ENDS = f"""SELECT request_id, start, CASE WHEN silent THEN last_seq + 1 ELSE stop.seq END AS stop_seq,
  CASE WHEN silent THEN last_ts + INTERVAL {R.TIMEOUT_SECONDS} SECOND ELSE stop.fin END AS fin,
  CASE WHEN silent THEN 'timeout' ELSE stop.reason END AS reason, stop.detail AS detail
FROM (SELECT *, stop IS NULL AND epoch_us(last_ts) // 1000 + {R.TIMEOUT_SECONDS * 1000} < (SELECT epoch_us(max(ts)) // 1000 FROM b11) AS silent
  FROM (SELECT request_id, min(ts) AS start, max(ts) AS last_ts, max(seq) AS last_seq, arg_min(kind, seq) AS first_kind,
          min(CASE WHEN reason IS NOT NULL THEN {{'seq': seq, 'fin': fin, 'reason': reason, 'detail': detail}} END) AS stop
    FROM (SELECT *, CASE WHEN reason = 'timeout' THEN prev + INTERVAL {R.TIMEOUT_SECONDS} SECOND ELSE ts END AS fin,
            CASE WHEN reason = 'status' THEN CAST(status AS VARCHAR) WHEN reason = 'failure' THEN text END AS detail
      FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(prev) > {R.TIMEOUT_MICROS} THEN 'timeout'
                           WHEN kind = 'status' AND status IS DISTINCT FROM {R.OK_STATUS} THEN 'status'
                           WHEN kind IN ('failure', 'close') THEN kind END AS reason
        FROM (SELECT *, lag(ts) OVER (PARTITION BY request_id ORDER BY seq) AS prev FROM b11) p) q) r GROUP BY request_id) s) t
WHERE first_kind = 'status'"""
_SAID = f"""SELECT l.request_id, l.seq, l.ts, e.start, l.delta, row_number() OVER (PARTITION BY l.request_id ORDER BY l.seq) - 1 AS idx
FROM (SELECT request_id, seq, ts, json_extract_string(substr(text, 7), '$.choices[0].delta.content') AS delta FROM b11
      WHERE kind = 'line' AND starts_with(text, 'data: ') AND json_valid(substr(text, 7))) l
JOIN ({_ENDS}) e ON e.request_id = l.request_id AND (e.stop_seq IS NULL OR l.seq < e.stop_seq) WHERE coalesce(l.delta, '') <> ''"""
_ERROR = (f"CASE reason WHEN 'timeout' THEN '{R.TIMEOUT_MESSAGE}' WHEN 'status' THEN '{{}}' || detail "
          "WHEN 'failure' THEN detail END")
_EVENTS = f"""SELECT request_id, seq, 'token' AS kind, idx, {_MS('start', 'ts')} AS ms, delta AS text FROM ({_SAID}) a UNION ALL
SELECT e.request_id, stop_seq, CASE reason WHEN 'close' THEN 'done' ELSE 'error' END,
  CASE reason WHEN 'close' THEN coalesce(n, 0) END, {_MS('start', 'fin')}, {_ERROR.format(R.BACKEND_ERROR)}
FROM ({_ENDS}) e LEFT JOIN (SELECT request_id, count(*) AS n FROM ({_SAID}) a GROUP BY 1) c ON c.request_id = e.request_id
WHERE reason IS NOT NULL"""
_PAYLOAD = (f"SELECT request_id, seq, kind, idx, ms, text, CAST(CASE kind WHEN 'token' THEN json_object('token', text, 'index', idx, 'elapsed_ms', ms) "
            f"WHEN 'done' THEN json_object('done', true, 'total_tokens', idx, 'total_ms', ms) ELSE json_object('error', text) END AS VARCHAR) "
            f"AS payload FROM ({_EVENTS}) v")
_TEXTS = f"""SELECT e.request_id, coalesce(t.txt, '') AS text, CASE WHEN reason IS NULL THEN 'open' WHEN reason = 'close' THEN 'done'
  ELSE 'error' END AS outcome, {_ERROR.format(R.BACKEND_ERROR)} AS detail
FROM ({_ENDS}) e LEFT JOIN (SELECT request_id, string_agg(delta, '' ORDER BY seq) AS txt FROM ({_SAID}) a GROUP BY 1) t
ON t.request_id = e.request_id WHERE reason IS NOT NULL OR txt IS NOT NULL"""
_RESULTS = f"""SELECT e.request_id, CASE WHEN ok THEN (epoch_us(first_ts) - epoch_us(start)) / 1000.0 END AS ttft_ms,
  CASE WHEN ok THEN (epoch_us(fin) - epoch_us(start)) / 1000.0 END AS total_time_ms,
  CASE WHEN ok THEN CAST(coalesce(n, 0) AS INTEGER) END AS token_count,
  CASE WHEN ok THEN CASE WHEN coalesce(n, 0) > 0 THEN n / ((epoch_us(fin) - epoch_us(start)) / 1e6) ELSE 0e0 END END AS tokens_per_sec,
  CASE WHEN ok THEN coalesce(substring(txt, 1, 100), '') END AS response, {_ERROR.format(R.HTTP_ERROR)} AS error
FROM (SELECT *, reason = 'close' AS ok FROM ({_ENDS}) e0) e LEFT JOIN (SELECT request_id, min(ts) AS first_ts, count(*) AS n,
  string_agg(delta, '' ORDER BY seq) AS txt FROM ({_SAID}) a GROUP BY 1) t ON t.request_id = e.request_id WHERE reason IS NOT NULL"""
_LABELLED = (f"(SELECT CASE WHEN request_id % 2 = 0 THEN 'sequential' ELSE 'concurrent' END AS label, * FROM ({_RESULTS}) m)")

LOG_PARTS = 3


def _log(spark, sf):
    return B.request_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark, sf, name: str, **sinks: str) -> None:
    """Relay B11 as it grows: the log arrives in LOG_PARTS steps of event time,
    and one stream (one checkpoint) takes each as a micro-batch."""
    path, ckpt, whole = (_scratch(spark, f"{name}-{x}") for x in ("log", "ckpt", "whole"))
    _log(spark, sf).write.parquet(whole)            # positions within users are found once, not once a step
    log = spark.read.schema(R.LOG_DDL).parquet(whole)
    cuts = log.select(F.percentile_approx("ts", [i / LOG_PARTS for i in range(1, LOG_PARTS)]).alias("c")).first()["c"] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        step = log if lo is None else log.where(F.col("ts") > F.lit(lo))
        (step if hi is None else step.where(F.col("ts") <= F.lit(hi))).write.mode("append").parquet(path)
        src = spark.readStream.schema(R.LOG_DDL).parquet(path)
        _start(spark, SR.start_sinks(SR.relay(src), ckpt, **sinks))


@register("relay_protocol", with_bindings(_PAYLOAD, "b11"))
def relay_protocol(spark, sf):
    ev = R.relay_events(_log(spark, sf))
    return ev.withColumn("payload", R.sse_payload())


@register("stream_relay_protocol", with_bindings(_PAYLOAD, "b11"))
def stream_relay_protocol(spark, sf):
    out = _scratch(spark, "relayed")
    _stream(spark, sf, "protocol", events=out)
    return SR.read_sink(spark, out).withColumn("payload", R.sse_payload())


@register("relay_timeouts", with_bindings(
    f"SELECT request_id, stop_seq AS timeout_seq FROM ({_ENDS}) e WHERE reason = 'timeout'", "b11"))
def relay_timeouts(spark, sf):
    return R.timeouts(_log(spark, sf))


@register("stream_request_timeout", with_bindings(
    f"SELECT request_id, stop_seq AS timeout_seq FROM ({_ENDS}) e WHERE reason = 'timeout'", "b11"))
def stream_request_timeout(spark, sf):
    out = _scratch(spark, "timed")
    _stream(spark, sf, "timeout", events=out)
    return SR.read_sink(spark, out).where(F.col("text") == R.TIMEOUT_MESSAGE).where("kind = 'error'").select(
        "request_id", F.col("seq").alias("timeout_seq"))


@register("relay_assemble", with_bindings(_TEXTS, "b11"))
def relay_assemble(spark, sf):
    return R.assemble(R.relay_events(_log(spark, sf)))


@register("stream_relay_assemble", with_bindings(_TEXTS, "b11"))
def stream_relay_assemble(spark, sf):
    out = _scratch(spark, "texts")
    _stream(spark, sf, "assemble", texts=out)
    return R.join_parts(SR.read_sink(spark, out))


@register("request_results", with_bindings(_RESULTS, "b11"))
def request_results(spark, sf):
    return R.request_results(_log(spark, sf))


@register("stream_request_results", with_bindings(_RESULTS, "b11"))
def stream_request_results(spark, sf):
    out = _scratch(spark, "results")
    _stream(spark, sf, "results", results=out)
    return SR.read_sink(spark, out)


@register("stream_result_stats", with_bindings(_summary_sql(_LABELLED), "b11"))
def stream_result_stats(spark, sf):
    out = _scratch(spark, "measured")
    _stream(spark, sf, "stats", results=out)
    return SR.result_stats(SR.read_sink(spark, out))
