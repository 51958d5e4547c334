"""Bindings B1-B10: the test tables shaped to the reference's record types.

Each builder reads the given tables and derives its rows with native
expressions, so the work grows with the tables. The SQL twins used by the
DuckDB oracle live in :mod:`textforge.plans.fixtures_sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.plans.ordered import ordered_index
from textforge.sources.tables import read_table

NL = "\n"


def _lit_rows(*rows: tuple) -> "F.Column":
    """A tiny constant fan-out (2-3 variants per row) as an array to explode."""
    return F.array(*[F.struct(*[F.lit(v).alias(f"col{i + 1}") for i, v in enumerate(r)])
                     for r in rows])


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: raw corpus ``split, split_rank, pos, article, headline``; positions
    restart in every split."""
    d = read_table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 10
    ten = F.floor(F.col("doc_id") / 10)
    return d.select(
        F.when(m == 0, "test").when(m == 1, "validation").otherwise("train").alias("split"),
        F.when(m == 0, 2).when(m == 1, 1).otherwise(0).alias("split_rank"),
        F.when(m < 2, ten).otherwise(ten * 8 + m - 2).alias("pos"),
        F.col("text").alias("article"),
        F.split_part(F.col("text"), F.lit(NL), F.lit(1)).alias("headline"),
    )


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: instruction records ``id, instruction, input, output``."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.lit("Summarize this text:").alias("instruction"),
                    F.col("text").alias("input"),
                    F.split_part(F.col("text"), F.lit(NL), F.lit(1)).alias("output"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions ``id, model, input, reference, predicted``."""
    d = read_table(spark, sf_dir, "documents")
    m = d.select("*", F.explode(_lit_rows(("finetuned", 1), ("base", 81))).alias("m"))
    return m.select(
        F.col("doc_id").alias("id"), F.col("m.col1").alias("model"),
        F.col("text").alias("input"),
        F.split_part(F.col("text"), F.lit(NL), F.lit(1)).alias("reference"),
        F.when(F.col("doc_id") % 20 == 1, F.lit(""))
        .otherwise(F.substring(F.col("text"), F.col("m.col2"), F.lit(80))).alias("predicted"),
    )


def predictions_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 where every twentieth document was never predicted: what
    ``skipped_samples`` is about."""
    return predictions(spark, sf_dir).where(F.col("id") % 20 != 0)


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, model, ref_vec, pred_vec`` (prediction = a neighbouring vector;
    the last ids' neighbours are the first ones)."""
    e = read_table(spark, sf_dir, "embeddings")
    n = e.agg(F.coalesce(F.max("vec_id"), F.lit(0)) + 1).first()[0]
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("ref_vec"),
                 F.explode(_lit_rows(("finetuned", 1), ("base", 2))).alias("k"))
    a = a.select("id", "ref_vec", F.col("k.col1").alias("model"),
                 F.pmod(F.col("id") + F.col("k.col2"), F.lit(n)).alias("pred_id"))
    p = e.select(F.col("vec_id").alias("pred_id"), F.col("embedding").alias("pred_vec"))
    return a.join(p, "pred_id").select("id", "model", "ref_vec", "pred_vec")


def verdict_json(quality: str = "quality", toxic: str = "toxic", doc_id: str = "doc_id"):
    return F.concat(
        F.lit('{"faithfulness": '), (1 + 4 * F.col(quality)).cast("string"),
        F.lit(', "darija_quality": '), (5 - 4 * F.col(toxic)).cast("string"),
        F.lit(', "conciseness": '), (1 + F.col(doc_id) % 5).cast("string"),
        F.lit(', "reasoning": "r'), F.col(doc_id).cast("string"), F.lit('"}'))


def raw_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three judge attempts per id ``id, attempt, raw``."""
    lab = read_table(spark, sf_dir, "labels")
    t = lab.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    v = verdict_json()
    m, first = F.col("doc_id") % 5, F.col("n") == 1
    raw = (F.when(first & (F.col("doc_id") % 7 == 3), F.translate(v, '"', "'"))      # single quotes
           .when(first & (F.col("doc_id") % 7 == 5), F.concat(v, F.lit(" Hope this helps")))
           .when(first & (F.col("doc_id") % 7 == 6), F.concat(v, F.lit(" {")))
           .when(m == 0, v)
           .when(m == 1, F.concat(F.lit("```json" + NL), v, F.lit(NL + "```")))
           .when((m == 2) & (F.col("n") < 3), F.lit("not json"))
           .when(m == 2, v)
           .when(m == 3, F.lit('{"faithfulness": 3}'))
           .otherwise(F.concat(F.lit("  "), v, F.lit(" "))))
    return t.select(F.col("doc_id").alias("id"), F.col("n").alias("attempt"), raw.alias("raw"))


def pairwise_json(doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic"):
    """The pairwise verdict text of the A/B prompt, derived from ``labels``."""
    def axis(name, winner, conf):
        return F.concat(F.lit(f'"{name}": {{"winner": "'), winner, F.lit('", "confidence": "'),
                        conf, F.lit('", "reason": "'), F.lit(name), F.lit('"}'))
    conf_of = lambda k: F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")),
                                     (k % 3 + 1).cast("int"))
    ab = lambda c: F.when(c == 1, F.lit("A")).otherwise(F.lit("B"))
    d = F.col(doc_id)
    return F.concat(
        F.lit("{"), axis("faithfulness", ab(F.col(quality)), conf_of(d)), F.lit(", "),
        axis("darija_quality", ab(F.col(toxic)), conf_of(d + 1)), F.lit(", "),
        axis("conciseness", ab(d % 2), conf_of(d + 2)), F.lit(', "overall_winner": "'),
        ab(F.col(quality)), F.lit('", "overall_confidence": "'), conf_of(d),
        F.lit('", "overall_reason": "o'), d.cast("string"), F.lit('"}'))


def raw_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 pairwise form: ``id, raw`` one verdict per labelled id."""
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("id"), pairwise_json().alias("raw"))


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SSE lines per request ``request_id, seq, ts, line``.

    ``seq`` is the arrival position within the request: an exact per-group
    position that does not put a hot request in one task.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    pos = ordered_index(ev, ["user_id"], ["ts", "event_id"], index_col="seq")
    last = ev.groupBy("user_id").agg((F.count(F.lit(1)) - 1).alias("last_seq"))
    e = pos.join(last, "user_id")
    t = F.col("event_type")
    line = (F.when(F.col("seq") == F.col("last_seq"), F.lit("data: [DONE]"))
            .when(t == "signup", F.lit(""))
            .when(t == "error", F.lit("data: {bad"))
            .when(t == "view", F.lit('data: {"choices":[{"delta":{}}]}'))
            .when(F.col("event_id") % 23 == 5, F.lit('data: {"choices":[]}'))
            .when(F.col("event_id") % 23 == 7, F.lit("data: {'choices':[{'delta':{'content':'q'}}]}"))
            .when(F.col("event_id") % 23 == 9, F.lit('data: {"choices":[{"delta":{"content":"t"}}]} trailing'))
            .otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"c'),
                                F.col("event_id").cast("string"), F.lit(' "}}]}'))))
    return e.select(F.col("user_id").alias("request_id"), F.col("seq").cast("long").alias("seq"),
                    "ts", line.alias("line"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation requests with deliberate rule violations."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    return d.select(
        i.alias("request_id"),
        F.when(i % 50 == 0, F.lit("   ")).when(i % 50 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("text")).alias("prompt"),
        F.when(i % 7 == 0, F.lit(None)).otherwise(i % 600).cast("long").alias("max_tokens"),
        F.when(i % 11 == 0, F.lit(None)).otherwise((i % 25).cast("double") / 10).alias("temperature"),
        F.when(i % 13 == 0, F.lit(None))
        .otherwise(F.lit(0.5) + (i % 20).cast("double") / 10).alias("repetition_penalty"),
        F.when(i % 17 == 3, F.repeat(F.lit("s"), 501)).when(i % 17 == 5, F.lit("Answer in one line."))
        .alias("system_prompt"),
    )


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-request measurements ``label, request_id, ttft_ms, ...``."""
    e = read_table(spark, sf_dir, "events")
    v, i, t = F.col("value"), F.col("event_id"), F.col("event_type")
    return e.select(
        F.when(F.col("user_id") % 2 == 0, "sequential").otherwise("concurrent").alias("label"),
        i.alias("request_id"),
        F.when((t == "error") & (i % 2 == 0), F.lit(None)).otherwise(v).alias("ttft_ms"),
        (v * 8).alias("total_time_ms"),
        (i % 51).alias("token_count"),
        F.when(v > 0, (i % 51).cast("double") / (v * 8 / 1000)).otherwise(F.lit(0.0))
        .alias("tokens_per_sec"),
        F.when(t == "error", F.lit("HTTP 500")).when(t == "view", F.lit("")).alias("error"),
    )


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer log rows ``run, step, loss, eval_loss, learning_rate, logged_at``."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    pos = ordered_index(e, ["event_type"], ["ts", "event_id"], index_col="_i")
    return pos.select(
        F.col("event_type").alias("run"), (50 * (F.col("_i") + 1)).alias("step"),
        F.col("value").alias("loss"),
        F.when(F.col("event_id") % 4 == 0, F.col("value") * 1.1).alias("eval_loss"),
        F.lit(2e-4).alias("learning_rate"), F.col("ts").alias("logged_at"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backend responses ``request_id, model, outcome, status_code, latency_ms, body``."""
    e = read_table(spark, sf_dir, "events")
    i, t = F.col("event_id"), F.col("event_type")
    body = F.concat(
        F.when(i % 17 == 4, F.lit('{"choices":[')).otherwise(F.concat(
            F.lit('{"choices":[{"message":{"content":"  s'), i.cast("string"), F.lit(' "}}'))),
        F.lit('],"usage":{"prompt_tokens":'), (10 + i % 90).cast("string"),
        F.lit(',"completion_tokens":'), (1 + i % 50).cast("string"),
        F.lit(',"total_tokens":'), (11 + i % 90 + i % 50).cast("string"), F.lit("}}"))
    body = F.when(i % 17 == 6, F.concat(body, F.lit(" trailing"))).when(i % 17 == 8, F.translate(body, '"', "'")).otherwise(body)
    return e.select(
        i.alias("request_id"),
        F.when(F.col("user_id") % 2 == 0, "model-a").otherwise("model-b").alias("model"),
        F.when(t == "error", "timeout").when((t == "view") & (i % 3 == 0), "exception")
        .otherwise("response").alias("outcome"),
        F.when(t == "error", F.lit(None)).when((t == "click") & (i % 3 == 0), F.lit(503))
        .otherwise(F.lit(200)).alias("status_code"),
        (F.col("value") * 8).alias("latency_ms"),
        body.alias("body"))


REQUEST_LINES = 12


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log ``request_id, seq, ts, kind, status, text``: every user's
    events in blocks of twelve, each block a request. Some are refused, fail, go
    silent and come back, or are never heard of again."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    pos = ordered_index(ev, ["user_id"], ["ts", "event_id"], index_col="s")
    r = pos.select("event_id", "ts", "event_type", (F.col("s") % REQUEST_LINES).alias("k"),
                   (F.col("user_id") * 100000 + F.floor(F.col("s") / REQUEST_LINES)).alias("request_id"))
    per = r.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"))
    r = r.join(per, "request_id")
    k, rid, i = F.col("k"), F.col("request_id"), F.col("event_id")
    micros = (k * 250000 + (i % 200) * 1000 + i % 7
              + F.when((rid % 7 == 3) & (k >= 4), F.lit(90_000_000)).otherwise(F.lit(0))).cast("long")
    kind = (F.when(k == 0, "status").when(k == F.col("n") - 1, "close")
            .when((rid % 13 == 6) & (k == 3), "failure").otherwise("line"))
    line = (F.when(k == F.col("n") - 3, "data: [DONE]").when(F.col("event_type") == "signup", "")
            .when(F.col("event_type") == "error", "data: {bad")
            .when(i % 10 == 7, "data: {'choices':[{'delta':{'content':'q'}}]}")
            .when(i % 10 == 8, 'data: {"choices":[{"delta":{"content":"t"}}]} trailing')
            .when(F.col("event_type") == "view", 'data: {"choices":[{"delta":{}}]}')
            .otherwise(F.concat(F.lit('data: {"choices":[{"delta":{"content":"c'), i.cast("string"), F.lit(' "}}]}'))))
    return r.where(~((rid % 7 == 5) & (k >= 5))).select(
        rid.cast("long").alias("request_id"), k.cast("long").alias("seq"),
        F.timestamp_add("MICROSECOND", micros, F.col("t0")).alias("ts"), kind.alias("kind"),
        F.when(k == 0, F.when(rid % 11 == 4, 503).when(rid % 11 == 9, 429).otherwise(200)).cast("int").alias("status"),
        F.when(kind == "failure", "connection reset by peer").when(kind == "line", line).alias("text"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of several sentences ``id, model, reference, predicted``: the
    document's first three lines against two leads of its lines, one to a line."""
    from textforge.operators.evaluate import lead_words
    d = read_table(spark, sf_dir, "documents")
    line = lambda i: F.coalesce(F.get(F.split("text", NL), F.lit(i)), F.lit(""))
    both = d.select("doc_id", F.concat_ws(NL, line(0), line(1), line(2)).alias("reference"),
                    F.concat_ws(NL, lead_words(line(1), 12), lead_words(line(0), 9)).alias("a"),
                    F.concat_ws(NL, lead_words(line(2), 8), lead_words(line(1), 10)).alias("b"))
    m = both.select("doc_id", "reference", F.explode(F.array(
        F.struct(F.lit("finetuned").alias("model"), F.col("a").alias("predicted")),
        F.struct(F.lit("base").alias("model"), F.col("b").alias("predicted")))).alias("m"))
    return m.select(F.col("doc_id").alias("id"), "m.model", "reference", "m.predicted")
