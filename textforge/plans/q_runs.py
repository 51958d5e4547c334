"""Registered queries: run tracking, sources/sinks round trips, streams
(P19, P20, W4-W8, S2-S7, S9-S11, T1-T3 streaming)."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from textforge.operators import corpus as C
from textforge.operators import runs as RN
from textforge.plans.fixtures_sql import with_bindings
from textforge.plans.q_corpus import _DEDUP, _SHORT, _with_clean
from textforge.plans.q_serving import _DEFAULTED as _SERVING_DEFAULTED
from textforge.plans.q_serving import _PARSED, _START, _TOKENS
from textforge.plans.q_serving import _REASONS as _SERVING_REASONS
from textforge.plans.q_serving import STATS_LINES_SQL as _STATS_LINES_SQL
from textforge.plans.q_serving import STREAM_STATS_SQL
from textforge.plans.registry import register
from textforge.session import scratch_path
from textforge.sources import bindings as B
from textforge.sources import io as IO
from textforge.streaming import sse as SS


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def _dbl_text(c):
    """A double as Python's ``str`` writes it (plain decimal, at least one fraction digit)."""
    s = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


# ---- P19, P20, W4..W8 -----------------------------------------------------------
_CFG_KEYS = [("training.learning_rate", "CAST(max(learning_rate) AS VARCHAR)"),
             ("training.logging_steps", f"'{RN.LOGGING_STEPS}'"),
             ("training.max_steps", "CAST(max(step) AS VARCHAR)"),
             ("evaluation.eval_steps", f"'{RN.EVAL_STEPS}'"),
             ("evaluation.save_steps", f"'{RN.SAVE_STEPS}'"),
             ("evaluation.save_total_limit", f"'{RN.SAVE_TOTAL_LIMIT}'"),
             ("evaluation.metric_for_best_model", f"'{RN.BEST_METRIC}'"),
             ("report", "'[\"loss\",\"eval_loss\"]'")]


@register("flatten_config", with_bindings(" UNION ALL ".join(
    f"SELECT run, '{k}' AS key, {v} AS value FROM b9 GROUP BY run" for k, v in _CFG_KEYS), "b9"))
def flatten_config(spark, sf):
    cfg = RN.run_config(B.training_log(spark, sf))
    cfg = cfg.withColumn("config", F.col("config").withField(
        "training.learning_rate", _dbl_text(F.col("config.training.learning_rate"))))
    return RN.flatten_config(cfg, "config", ["run"])


_P20 = ("SELECT run, step, 'train/loss' AS key, loss AS value FROM b9 WHERE loss IS NOT NULL UNION ALL "
        "SELECT run, step, 'eval/loss', eval_loss FROM b9 WHERE eval_loss IS NOT NULL UNION ALL "
        "SELECT run, step, 'train/learning_rate', learning_rate FROM b9 WHERE learning_rate IS NOT NULL")


@register("select_train_metrics", with_bindings(_P20, "b9"))
def select_train_metrics(spark, sf):
    return RN.select_train_metrics(B.training_log(spark, sf))


@register("log_every_k_steps", with_bindings(f"SELECT run, step FROM b9 WHERE step % {RN.EVAL_STEPS} = 0", "b9"))
def log_every_k_steps(spark, sf):
    return RN.log_every_k_steps(B.training_log(spark, sf)).select("run", "step")


@register("best_step_by_metric", with_bindings(
    "SELECT run, arg_min(step, (eval_loss, step)) AS best_step, min(eval_loss) AS best_eval_loss "
    "FROM b9 WHERE eval_loss IS NOT NULL GROUP BY run", "b9"))
def best_step_by_metric(spark, sf):
    return RN.best_step_by_metric(B.training_log(spark, sf))


_SAVED = f"SELECT * FROM b9 WHERE step % {RN.SAVE_STEPS} = 0"


@register("retain_last_k", with_bindings(
    f"SELECT run, step, string_agg(reason, ',' ORDER BY reason) AS reason FROM ("
    f"SELECT run, step, 'recent' AS reason FROM (SELECT run, step, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn "
    f"FROM ({_SAVED}) s) r WHERE rn <= {RN.SAVE_TOTAL_LIMIT} UNION ALL "
    f"SELECT run, arg_min(step, (eval_loss, step)), 'best' FROM ({_SAVED}) s WHERE eval_loss IS NOT NULL GROUP BY run"
    f") u GROUP BY run, step", "b9"))
def retain_last_k(spark, sf):
    return RN.retain_last_k(B.training_log(spark, sf))


@register("latest_step", with_bindings(f"SELECT run, max(step) AS latest_step FROM ({_SAVED}) s GROUP BY run", "b9"))
def latest_step(spark, sf):
    return RN.latest_step(B.training_log(spark, sf))


@register("assign_versions", with_bindings(
    f"SELECT 'summarizer-' || run AS name, step, CAST(row_number() OVER (PARTITION BY run ORDER BY logged_at, step) AS INTEGER) "
    f"AS version FROM ({_SAVED}) s WHERE eval_loss IS NOT NULL", "b9"))
def assign_versions(spark, sf):
    reg = RN.saved_checkpoints(B.training_log(spark, sf)).where(F.col("eval_loss").isNotNull())
    reg = reg.select(F.concat(F.lit("summarizer-"), F.col("run")).alias("name"), "step", "logged_at")
    return RN.assign_versions(reg, "name", ["logged_at", "step"]).select("name", "step", "version")


# ---- S2..S7, S9, S10 round trips (scratch under the shared checkpoint folder) ---------
@register("append_metrics", with_bindings(_P20, "b9"))
def append_metrics(spark, sf):
    path = _scratch(spark, "metrics")
    m = RN.select_train_metrics(B.training_log(spark, sf))
    IO.append_metrics(m.where(F.col("key") != "eval/loss"), path)
    IO.append_metrics(m.where(F.col("key") == "eval/loss"), path)
    return IO.read_metrics(spark, path).select("run", "step", "key", "value")


@register("write_corpus", _with_clean(f"SELECT split, pos, article, headline FROM ({_DEDUP}) d"))
def write_corpus(spark, sf):
    path = _scratch(spark, "corpus")
    prepared = C.prepare_corpus(B.articles(spark, sf)).select("split", "pos", "article", "headline")
    IO.write_corpus(prepared, path)
    return IO.scan_corpus(spark, path)


@register("ingest_if_absent", with_bindings("SELECT split, pos, article, headline FROM b1", "b1"))
def ingest_if_absent(spark, sf):
    path = _scratch(spark, "raw")
    raw = B.articles(spark, sf).select("split", "pos", "article", "headline")
    IO.ingest_if_absent(raw, path)
    IO.ingest_if_absent(raw, path)      # second run is a no-op
    return IO.scan_corpus(spark, path)


@register("scan_jsonl", with_bindings("SELECT id, instruction, input, output FROM b2", "b2"))
def scan_jsonl(spark, sf):
    path = _scratch(spark, "jsonl")
    IO.write_jsonl(B.instructions(spark, sf), path)
    return IO.scan_jsonl(spark, path)


@register("scan_csv", with_bindings("SELECT id, model, input, reference, predicted FROM b3", "b3"))
def scan_csv(spark, sf):
    path = _scratch(spark, "csv")
    IO.write_csv(B.predictions(spark, sf), path, ["id", "model", "input", "reference", "predicted"])
    return IO.scan_csv(spark, path).withColumn("id", F.col("id").cast("long"))


@register("dataset_manifest_directories")
def dataset_manifest_directories(spark, sf):
    files, dirs = IO.dataset_manifest(spark, sf, "*.parquet")
    return dirs.select(F.regexp_extract("dir", "[^/]*$", 0).alias("dir"), "nfiles", "size", "md5")


@register("dataset_manifest")
def dataset_manifest(spark, sf):
    files, dirs = IO.dataset_manifest(spark, sf, "*.parquet")
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "size", "md5")


# ---- S11 + T1..T3 as real streams over the log B6 -----------------------------------
LOG_PARTS = 4


def _log_parts(spark, sf, path: str, parts: int = LOG_PARTS):
    """Append B6 to ``path`` in ``parts`` steps of event time; yields after each.
    Every step is written by as many tasks as it has."""
    whole = _scratch(spark, "whole-lines")
    B.stream_lines(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(whole)     # once, not once a step
    b6 = spark.read.schema(SS.LINE_SCHEMA).parquet(whole)
    cuts = b6.select(F.percentile_approx("ts", [i / parts for i in range(1, parts)]).alias("c")).first()["c"]
    for lo, hi in zip([None, *(cuts or [])], [*(cuts or []), None]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("ts") > F.lit(lo))
        if hi is not None:
            cond = cond & (F.col("ts") <= F.lit(hi))
        IO.write_lines(b6.where(cond), path)
        yield


def _follow_log(spark, sf, writer) -> None:
    """Run a stream over the growing log: ``writer(source)`` is started once per
    step with the same checkpoint and takes all that the step added as one
    micro-batch, so a request's lines arrive in order on any storage."""
    path = _scratch(spark, "lines")
    for _ in _log_parts(spark, sf, path):
        _start(spark, writer(IO.stream_lines_source(spark, path, None)))


@contextlib.contextmanager
def _state_partitions(spark):
    """State-store partitions are fixed when a stream first starts; size them to
    the cluster's parallelism for the start, then restore the caller's value."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _start(spark, writer):
    with _state_partitions(spark):
        q = writer.start()
    q.awaitTermination()
    return q


def _sink(spark, name: str, mode: str = "append"):
    """(folder, writer) of a Parquet sink whose runs share one checkpoint."""
    out, ckpt = _scratch(spark, f"{name}-out"), _scratch(spark, f"{name}-ckpt")
    return out, lambda df: (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
                            .outputMode(mode).trigger(availableNow=True))


def _run_stream(spark, df, name: str, mode: str = "append"):
    out, writer = _sink(spark, name, mode)
    _start(spark, writer(df))
    return spark.read.parquet(out)


def _run_over_log(spark, sf, transform, name: str):
    out, writer = _sink(spark, name)
    _follow_log(spark, sf, lambda src: writer(transform(src)))
    return spark.read.parquet(out)


@register("stream_sse_parse", with_bindings(f"SELECT request_id, seq, delta FROM ({_PARSED}) p", "b6"))
def stream_sse_parse(spark, sf):
    return _run_over_log(spark, sf, lambda src: SS.parse_stream(src).select("request_id", "seq", "delta"), "parse")


@register("stream_relay_events", with_bindings(
    f"SELECT request_id, seq, 'token' AS kind, token_index AS idx, elapsed_ms AS ms FROM ({_TOKENS}) t UNION ALL "
    f"SELECT s.request_id, b.seq, 'done', coalesce(n, 0), ((epoch_us(t1) - epoch_us(t0) + 5) // 10) / 100.0 "
    f"FROM ({_START}) s JOIN b6 b ON b.request_id = s.request_id AND b.line = 'data: [DONE]' "
    f"LEFT JOIN (SELECT request_id, count(*) FILTER (WHERE delta <> '') AS n FROM ({_PARSED}) p GROUP BY 1) c "
    f"ON c.request_id = s.request_id", "b6"))
def stream_relay_events(spark, sf):
    ev = _run_over_log(spark, sf, lambda src: SS.relay_events(src, timeout=False), "relay")
    schema = "token string, index long, elapsed_ms double, done boolean, total_tokens long, total_ms double"
    j = F.from_json("event", schema)
    return ev.select("request_id", "seq", "kind",
                     F.coalesce(j["index"], j["total_tokens"]).alias("idx"),
                     F.coalesce(j["elapsed_ms"], j["total_ms"]).alias("ms"))


@register("stream_validate_requests", with_bindings(
    "SELECT request_id, accepted, reasons FROM (SELECT request_id, reasons = '' AS accepted, reasons FROM ("
    "SELECT request_id, " + _SERVING_REASONS + " AS reasons FROM (" + _SERVING_DEFAULTED + ") d) v) x", "b7"))
def stream_validate_requests(spark, sf):
    src_path = _scratch(spark, "requests")
    reqs = B.requests(spark, sf)
    reqs.write.parquet(src_path)
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 2).parquet(src_path)
    ok, bad = _scratch(spark, "accepted"), _scratch(spark, "rejected")
    SS.validate_stream(stream, ok, bad, _scratch(spark, "validate-ckpt")).awaitTermination()
    accepted = spark.read.parquet(ok).select("request_id", F.lit(True).alias("accepted"), F.lit("").alias("reasons"))
    rejected = spark.read.parquet(bad).select("request_id", F.lit(False).alias("accepted"), "reasons")
    return accepted.unionByName(rejected)


@register("stream_assemble", with_bindings(
    f"SELECT request_id, string_agg(delta, '' ORDER BY seq) AS text FROM ({_TOKENS}) t GROUP BY 1", "b6"))
def stream_assemble(spark, sf):
    out, ckpt = _scratch(spark, "assembled"), _scratch(spark, "assemble-ckpt")

    def snapshot(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)      # complete mode: the batch is the whole table

    _follow_log(spark, sf, lambda src: SS.assemble_stream(src).writeStream.outputMode("complete").foreachBatch(snapshot)
                .option("checkpointLocation", ckpt).trigger(availableNow=True))
    return spark.read.parquet(out)


@register("write_jsonl", with_bindings(
    "SELECT CAST(json_object('id', id, 'instruction', instruction, 'input', input, 'output', output) AS VARCHAR) "
    "AS line FROM b2", "b2"))
def write_jsonl(spark, sf):
    path = _scratch(spark, "jsonl-lines")
    IO.write_jsonl(B.instructions(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("write_stats_report", with_bindings(
    "SELECT '=== ' || upper(label) || ' BENCHMARK ===' AS line FROM (SELECT DISTINCT label FROM b8) l UNION ALL "
    "SELECT line FROM (" + _STATS_LINES_SQL + ") s", "b8"))
def write_stats_report(spark, sf):
    from textforge.operators import latency as LT
    path = _scratch(spark, "report")
    LT.write_stats_report(LT.stats_report_lines(LT.stats_long(LT.latency_summary(B.measurements(spark, sf)))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("stream_lines_source", with_bindings("SELECT request_id, seq, line FROM b6", "b6"))
def stream_lines_source(spark, sf):
    return _run_over_log(spark, sf, lambda src: src.select("request_id", "seq", "line"), "source")


@register("metrics_callback", with_bindings(
    f"SELECT run, step, key, value FROM ({_P20}) m WHERE step % {RN.LOGGING_STEPS} = 0", "b9"))
def metrics_callback(spark, sf):
    path = _scratch(spark, "callback-metrics")
    log = RN.log_every_k_steps(B.training_log(spark, sf), RN.LOGGING_STEPS)
    IO.append_metrics(RN.select_train_metrics(log), path)
    return IO.read_metrics(spark, path).select("run", "step", "key", "value")


@register("stream_latency_stats", STREAM_STATS_SQL)
def stream_latency_stats(spark, sf):
    out, ckpt = _scratch(spark, "progress"), _scratch(spark, "progress-ckpt")

    def snapshot(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)      # complete mode: the batch is the whole state

    _follow_log(spark, sf, lambda src: SS.request_progress(src).writeStream.outputMode("complete").foreachBatch(snapshot)
                .option("checkpointLocation", ckpt).trigger(availableNow=True))
    return SS.stream_latency_stats(spark.read.parquet(out))


@register("dedup_stream", _with_clean(f"SELECT DISTINCT headline FROM cleaned WHERE NOT ({_SHORT})"))
def dedup_stream(spark, sf):
    """F3 as a stream: cleaned, long-enough headlines arrive with one event time,
    so no row is ever late and every key is emitted exactly once (its first
    arrival), however large the table."""
    from textforge.functions.text import clean_text, trim_ws
    raw = B.articles(spark, sf).select("pos", clean_text("headline").alias("headline"))
    ok = F.length(trim_ws("headline")) >= C.HEADLINE_MIN_LENGTH
    rows = raw.withColumn("_ok", ok).where("_ok").select(
        "headline", F.timestamp_seconds(F.lit(86400)).alias("ts"))
    src_path = _scratch(spark, "headlines")
    rows.write.parquet(src_path)
    src = spark.readStream.schema("headline string, ts timestamp").option("maxFilesPerTrigger", 2).parquet(src_path)
    return _run_stream(spark, SS.dedup_stream(src, "headline", "ts"), "dedup").select("headline")


@register("dedup_stream_table", _with_clean(f"SELECT DISTINCT headline FROM cleaned WHERE NOT ({_SHORT})"))
def dedup_stream_table(spark, sf):
    """F3 with spread event times: the log of headlines arrives in steps, a row's
    time follows its position, and keys leave the state long before the end."""
    from textforge.functions.text import clean_text, trim_ws
    raw = B.articles(spark, sf).select("pos", "split_rank", clean_text("headline").alias("headline"))
    rows = raw.withColumn("_ok", F.length(trim_ws("headline")) >= C.HEADLINE_MIN_LENGTH).where("_ok").select(
        "headline", "split_rank", "pos", F.timestamp_seconds(F.col("pos") * 60).alias("ts"))
    path, out, ckpt = (_scratch(spark, f"dedup-{x}") for x in ("rows", "out", "ckpt"))
    schema = rows.schema
    cuts = rows.select(F.percentile_approx("pos", [1 / 3, 2 / 3]).alias("c")).first()["c"] or []
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        step = rows if lo is None else rows.where(F.col("pos") > lo)
        (step if hi is None else step.where(F.col("pos") <= hi)).write.mode("append").parquet(path)
        src = spark.readStream.schema(schema).parquet(path)
        _start(spark, SS.dedup_to_table(src, out, ckpt, "headline", ["split_rank", "pos"], "ts", "10 minutes"))
    return spark.read.parquet(out).select("headline")


@register("scan_csv_blocks", with_bindings("SELECT id, model, input, reference, predicted FROM b3", "b3"))
def scan_csv_blocks(spark, sf):
    path = _scratch(spark, "csv-blocks")
    IO.write_csv(B.predictions(spark, sf), path, ["id", "model", "input", "reference", "predicted"])
    return IO.scan_csv_blocks(spark, path).withColumn("id", F.col("id").cast("long"))
