"""The relay protocol (:mod:`textforge.operators.relay`) on a stream.

Lines are parsed natively; one ``applyInPandasWithState`` over buckets of requests
(:mod:`textforge.streaming.buckets`) then only finds where requests end and
numbers their tokens. The state of an open request is a few numbers and the first
100 characters of its text (tokens, start, last row, its seq, first token, head,
due time); it is dropped when the request ends, also by the event-time timer, so
state follows the open requests and not the log. A row whose ``seq`` is not beyond the state's, or of a
request that no ``status`` row opened, is ignored: redelivered rows and rows
after the end change nothing.

The sinks write each micro-batch to a partition of its own batch id, which a
replayed batch replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textforge.operators import latency as LT
from textforge.operators import relay as R
from textforge.streaming.buckets import STATE_DDL, bucket, held_requests, hold_requests, take_due

OUTPUT_DDL = ("request_id long, seq long, kind string, idx long, ms double, text string, ttft_ms double, "
              "total_time_ms double, token_count int, tokens_per_sec double, response string, error string")
_COLUMNS = [x.split()[0] for x in OUTPUT_DDL.split(", ")]
BATCH = "_batch"


def _ms(micros: np.ndarray | int):
    """Milliseconds rounded half-up to two decimals."""
    return (micros + 5) // 10 / 100.0


def _end_row(rid: int, seq: int, reason: str, detail, end: int, state: tuple) -> list:
    n, start, _, _, first, head = state
    total = end - start
    if reason == "close":
        instant = n > 0 and total == 0
        return [rid, seq, "done", n, _ms(total), None,
                None if instant or first is None else (first - start) / 1000.0, total / 1000.0, n,
                0.0 if n == 0 else (n / (total / 1e6) if total else None), head, LT.ZERO_DURATION if instant else None]
    said = {"timeout": (R.TIMEOUT_MESSAGE,) * 2, "status": (f"{R.BACKEND_ERROR}{detail}", f"{R.HTTP_ERROR}{detail}"),
            "failure": (detail or "",) * 2}[reason]
    return [rid, seq, "error", None, _ms(total), said[0], None, None, None, None, None, said[1]]


def _frame(tokens: dict[str, list], ends: list[list]) -> pd.DataFrame:
    over = dict(zip(_COLUMNS, zip(*ends))) if ends else {}
    none = [None] * len(tokens["seq"])
    out = pd.DataFrame({c: [*tokens.get(c, none), *over.get(c, ())] for c in _COLUMNS}, dtype=object)
    kinds = {"idx": "Int64", "token_count": "Int32", "ms": float, "ttft_ms": float, "total_time_ms": float, "tokens_per_sec": float}
    return out.astype({"request_id": "int64", "seq": "int64"} | kinds)


def _in_order(rows: pd.DataFrame, held: dict[int, list]) -> pd.DataFrame:
    """Each request's rows in order, from the one that opens it, without those it already had."""
    rows = rows.drop_duplicates(["request_id", "seq"]).sort_values(["request_id", "seq"], ignore_index=True)
    had = rows["request_id"].map({rid: values[3] for rid, values in held.items()}).astype("float64")
    opened = ((rows["kind"] == "status") | had.notna()).groupby(rows["request_id"]).cummax()
    return rows[opened.to_numpy(bool) & ~(rows["seq"] <= had).to_numpy(bool)]


def _relay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, watermark = held_requests(state), state.getCurrentWatermarkMs()
    tokens, ends = {c: [] for c in ("request_id", "seq", "kind", "idx", "ms", "text")}, []
    rows = None if state.hasTimedOut else pd.concat(list(batches), ignore_index=True)
    if rows is not None:
        rows = _in_order(rows.astype({"request_id": "int64"}), held)
    mine = set() if rows is None else set(rows["request_id"].tolist())
    for rid, had in take_due(held, watermark, mine).items():
        ends.append(_end_row(rid, had[3] + 1, "timeout", None, had[2] + R.TIMEOUT_MICROS, had[:-1]))
    if mine:
        _advance(rows, held, watermark, tokens, ends)
    hold_requests(state, held)
    if ends or tokens["seq"]:
        yield _frame(tokens, ends)


def _advance(rows: pd.DataFrame, held: dict[int, list], watermark: int, tokens: dict[str, list], ends: list[list]) -> None:
    """Take the ordered ``rows`` of some requests: adds to ``tokens`` and ``ends``, and
    leaves in ``held`` the requests that are still open."""
    rid, seq, kind = rows["request_id"].to_numpy(np.int64), rows["seq"].to_numpy(np.int64), rows["kind"].to_numpy()
    ts = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rid))))
    was = [held.get(r) or [0, t, t, 0, None, "", 0] for r, t in zip(rid[begins].tolist(), ts[begins].tolist())]
    before = np.concatenate([[0], ts[:-1]])
    before[begins] = [w[2] for w in was]
    late = ts - before > R.TIMEOUT_MICROS
    refused = (kind == "status") & (rows["status"].fillna(-1).to_numpy() != R.OK_STATUS)
    stops = np.flatnonzero(late | refused | (kind == "failure") | (kind == "close"))
    stop = np.full(len(begins), len(rid))
    np.minimum.at(stop, of[stops], stops)
    said = rows["delta"].notna().to_numpy() & (np.arange(len(rid)) < stop[of])
    at = np.flatnonzero(said)
    n_before, start = np.array([w[0] for w in was]), np.array([w[1] for w in was])
    nth = np.cumsum(said)
    nth_begin = nth[begins] - said[begins]
    texts = rows["delta"].iloc[at].tolist()
    for name, values in (("request_id", rid[at].tolist()), ("seq", seq[at].tolist()), ("kind", ["token"] * len(at)),
                         ("idx", (n_before[of[at]] + nth[at] - 1 - nth_begin[of[at]]).tolist()),
                         ("ms", _ms(ts[at] - start[of[at]]).tolist()), ("text", texts)):
        tokens[name] += values
    first, head = [w[4] for w in was], [w[5] for w in was]
    for g, t, piece in zip(of[at].tolist(), ts[at].tolist(), texts):
        if first[g] is None:
            first[g] = t
        if len(head[g]) < LT.RESPONSE_CHARS:
            head[g] = (head[g] + piece)[: LT.RESPONSE_CHARS]
    n = n_before + np.bincount(of[at], minlength=len(begins))
    status, text, lasts = rows["status"].to_numpy(), rows["text"].to_numpy(), np.append(begins[1:], len(rid)) - 1
    for g, (r, end) in enumerate(zip(rid[begins].tolist(), stop.tolist())):
        if end == len(rid):
            last = int(ts[lasts[g]])
            due = last // 1000 + R.TIMEOUT_SECONDS * 1000
            held[r] = [int(n[g]), int(start[g]), last, int(seq[lasts[g]]), first[g], head[g], max(due, watermark + 1)]
            continue
        held.pop(r, None)
        reason = "timeout" if late[end] else "status" if refused[end] else str(kind[end])
        detail = {"status": status[end], "failure": text[end]}.get(reason)
        detail = int(detail) if reason == "status" and pd.notna(detail) else detail
        moment = int(before[end]) + R.TIMEOUT_MICROS if reason == "timeout" else int(ts[end])
        ends.append(_end_row(r, int(seq[end]), reason, detail, moment, (int(n[g]), int(start[g]), 0, 0, first[g], head[g])))


def relay(log: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """T2 + T3 + T5 + L1 on a stream of log rows (``R.LOG_DDL``): tokens, and one
    end per request that carries its measurement. Rows of one request must arrive
    in ``seq`` order, at most ``delay`` behind the latest row of any request."""
    src = R.with_delta(log).select("request_id", "seq", "ts", "kind", "status", "text", "delta")
    return src.withColumn("_bucket", bucket()).withWatermark("ts", delay).groupBy("_bucket").applyInPandasWithState(
        _relay, OUTPUT_DDL, STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write one micro-batch's rows to the partition of its id; a replayed batch replaces it."""
    (rows.withColumn(BATCH, F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BATCH).parquet(path))


def start_sinks(relayed: DataFrame, checkpoint: str, events: str | None = None, texts: str | None = None,
                results: str | None = None):
    """A writer that keeps up to three tables of the relayed rows: the events,
    each batch's parts of the texts (T4), and the measurements of ended requests (T6)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        if events:
            write_batch(batch.select("request_id", "seq", "kind", "idx", "ms", "text"), batch_id, events)
        if texts:
            write_batch(R.assembled_parts(batch), batch_id, texts)
        if results:
            write_batch(batch.where("kind <> 'token'").select("request_id", *R.RESULT_COLUMNS), batch_id, results)
        batch.unpersist()

    return relayed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a sink's table."""
    return spark.read.parquet(path).drop(BATCH)


def result_stats(results: DataFrame, label: Column | None = None) -> DataFrame:
    """L2 and L3 per label over the measurements so far (default label: even
    request ids 'sequential', odd 'concurrent')."""
    lab = label if label is not None else F.when(F.col("request_id") % 2 == 0, "sequential").otherwise("concurrent")
    return LT.latency_summary(results.withColumn("label", lab))
