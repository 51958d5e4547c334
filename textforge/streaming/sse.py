"""Structured Streaming forms of the token relay.

The stateless parse (T1) and request validation (T7) are the batch
expressions applied to ``readStream``. Stateful relay (T2, T3, T5) is one
``applyInPandasWithState`` function over buckets of requests: state is each open
request's count of tokens emitted and start time, so the index continues across
micro-batches, the done event closes and drops the state, and an
event-time timeout ends a request that stalls. Event time must be a
``timestamp`` (``withWatermark`` rejects ``timestamp_ntz``), so streams
cast it first.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textforge.operators import latency as LT
from textforge.operators import requests as RQ
from textforge.streaming.buckets import STATE_DDL, bucket, held_requests, hold_requests, take_due

# --- fixed values: relay protocol ---
TIMEOUT_SECONDS = 60
TIMEOUT_MESSAGE = "generation timed out"
# --- end of fixed values ---

LINE_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("line", T.StringType())])

EVENT_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("event", T.StringType())])

_dumps = json.JSONEncoder(ensure_ascii=False).encode


def timeouts_batch(lines: DataFrame, gap_seconds: int = TIMEOUT_SECONDS) -> DataFrame:
    """T5 batch twin: per request, the first line arriving more than
    ``gap_seconds`` after the previous one. The previous line is found by an
    equi-join on ``(request, seq - 1)``: no window over a whole request."""
    cur = lines.select("request_id", "seq", "ts")
    prev = lines.select("request_id", (F.col("seq") + 1).alias("seq"), F.col("ts").alias("_prev"))
    gaps = cur.join(prev, ["request_id", "seq"])
    late = gaps.where(LT.micros_between("_prev", "ts") > gap_seconds * 1_000_000)
    return late.groupBy("request_id").agg(F.min("seq").alias("timeout_seq"))


def parse_stream(lines: DataFrame) -> DataFrame:
    """T1 on a stream: stateless, the batch expressions unchanged."""
    return LT.sse_parse(lines)


def _relay(timeout: bool):
    def relay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = held_requests(state), []
        rows: dict[int, list] = {}
        for pdf in () if state.hasTimedOut else batches:
            micros = pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for rid, seq, us, line in zip(pdf["request_id"].astype("int64").tolist(), pdf["seq"].tolist(), micros, pdf["line"].tolist()):
                rows.setdefault(rid, []).append((seq, us, line))
        watermark = state.getCurrentWatermarkMs() if timeout else 0
        for rid in take_due(held, watermark, set(rows)) if timeout else ():
            out.append((rid, None, "error", _dumps({"error": TIMEOUT_MESSAGE})))
        for rid, mine in rows.items():
            mine.sort(key=lambda x: x[0])
            n, start, last, _ = held.pop(rid, None) or (0, mine[0][1], None, None)
            ended = False
            for seq, last, line in mine:
                elapsed = ((last - start + 5) // 10) / 100.0
                line = line or ""
                if line == LT.DONE_LINE:
                    out.append((rid, seq, "done", _dumps({"done": True, "total_tokens": n, "total_ms": elapsed})))
                    ended = True
                    break
                if not line.startswith(LT.DATA_PREFIX):
                    continue
                try:
                    chunk = json.loads(line[len(LT.DATA_PREFIX):])
                    delta = chunk["choices"][0]["delta"].get("content", "")
                except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                    continue
                if delta:
                    out.append((rid, seq, "token", _dumps({"token": delta, "index": n, "elapsed_ms": elapsed})))
                    n += 1
            if not ended:
                held[rid] = [n, start, last, max(last // 1000 + TIMEOUT_SECONDS * 1000, watermark + 1)]
        hold_requests(state, held, timeout)
        yield pd.DataFrame(out, columns=["request_id", "seq", "kind", "event"])
    return relay


def relay_events(lines: DataFrame, watermark: str = "0 seconds", timeout: bool = True) -> DataFrame:
    """T2 + T3 + T5: token events ``{token,index,elapsed_ms}`` with the index
    continuing across micro-batches, a done event per finished request and,
    with ``timeout``, an error event for a request idle past the limit in
    event time. Rows of one request must arrive in ``seq`` order."""
    src = lines.withWatermark("ts", watermark) if timeout else lines
    conf = GroupStateTimeout.EventTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return src.withColumn("_bucket", bucket()).groupBy("_bucket").applyInPandasWithState(
        _relay(timeout), EVENT_SCHEMA, STATE_DDL, "append", conf)


def assemble_stream(lines: DataFrame) -> DataFrame:
    """T4: text so far per request (streaming aggregate; update or complete mode)."""
    toks = LT.sse_parse(lines).where(F.col("delta") != "")
    return toks.groupBy("request_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"))


def request_progress(lines: DataFrame) -> DataFrame:
    """T6 state: per request start, end, first-token time and token count, one
    streaming aggregate over all lines (update or complete mode)."""
    tok = LT.token_delta("line").isNotNull()
    return lines.groupBy("request_id").agg(
        F.min("ts").alias("_start"), F.max("ts").alias("_end"),
        F.min(F.when(tok, F.col("ts"))).alias("_first"), F.count_if(tok).alias("token_count"))


def stream_latency_stats(progress: DataFrame, label: Column | None = None) -> DataFrame:
    """L1 measurements from a snapshot of request progress, then L2 per label
    (default label: even request ids 'sequential', odd 'concurrent')."""
    lab = label if label is not None else F.when(
        F.col("request_id") % 2 == 0, "sequential").otherwise("concurrent")
    total_us = LT.micros_between("_start", "_end")
    n = F.coalesce(F.col("token_count"), F.lit(0))
    measured = progress.select(
        "request_id", lab.alias("label"),
        F.when(~((n > 0) & (total_us == 0)), LT.micros_between("_start", "_first") / 1000.0).alias("ttft_ms"),
        (total_us / 1000.0).alias("total_time_ms"),
        F.when(n > 0, F.try_divide(n.cast("double"), total_us / 1e6)).otherwise(F.lit(0.0)).alias("tokens_per_sec"),
        F.when((n > 0) & (total_us == 0), F.lit(LT.ZERO_DURATION)).alias("error"))
    return LT.latency_summary(measured)


def validate_stream(requests: DataFrame, accepted_path: str, rejected_path: str,
                    checkpoint: str, trigger_once: bool = True):
    """Validate a request stream; accepted rows and rejects go to two
    Parquet sinks from one ``foreachBatch`` (batch id makes reruns idempotent)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        v = RQ.validate_requests(batch).withColumn("_batch", F.lit(batch_id)).persist()
        for part, path in ((RQ.accepted_requests(v), accepted_path),
                           (RQ.rejected_requests(v).withColumn("_batch", F.lit(batch_id)), rejected_path)):
            # a batch that is replayed after a failure replaces its own partition
            (part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("_batch").parquet(path))
        v.unpersist()
    w = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if trigger_once else w).start()


def dedup_stream(df: DataFrame, key: str = "headline", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """first arrival per key with state bounded by ``delay`` (the watermark):
    repeats further apart than it pass through again, and rows later than it are
    dropped. Give every row one event time to keep all keys for good."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def dedup_to_table(df: DataFrame, path: str, checkpoint: str, key: str, order: Sequence[str], ts: str = "ts", delay: str = "1 hour"):
    """F3 without forgetting: every key once, its first row by ``order`` within
    the micro-batch that brings it. A key's repeats inside ``delay`` end in the
    stream's state, which forgets it afterwards; later ones end against the keys
    that earlier micro-batches wrote. Each batch writes a partition of its own id
    and reads only those of earlier ids, so a replayed batch changes nothing."""
    schema = df.schema
    table = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy(key).agg(F.min(F.struct(*order, *[c for c in batch.columns if c not in (*order, key)])).alias("_f"))
        rows = first.select(key, "_f.*").select(*batch.columns)
        spark.createDataFrame([], table).write.mode("append").partitionBy("_batch").parquet(path)       # so that it exists
        before = spark.read.schema(f"`{key}` {schema[key].dataType.simpleString()}, _batch long").parquet(path).where(
            F.col("_batch") < batch_id).select(key)
        new = rows.join(before, rows[key].eqNullSafe(before[key]), "left_anti")
        (new.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("_batch").parquet(path))

    return (dedup_stream(df, key, ts, delay).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True))
