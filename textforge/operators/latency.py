"""Token streams and latency analytics (T1 batch form, W2, W3, L1-L5, F8, J5, S8).

Per-request orderings go through :func:`textforge.plans.ordered.ordered_running`,
so a long request does not land in a single task; the exact floor-rank
percentiles and medians are found by counting (:mod:`textforge.plans.selection`),
so no label's measurements are ever sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions.strict_json import strict_json
from textforge.plans.joins import null_safe_join, small_copy
from textforge.plans.ordered import ordered_running
from textforge.plans.selection import floor_rank, middle_ranks, probes, select_ranks, values_at

# --- fixed values: stream protocol and report rules ---
DATA_PREFIX = "data: "
DONE_LINE = "data: [DONE]"
RESPONSE_CHARS = 100
TARGET_TTFT_MS = 100.0
BANDS = ((500.0, "severe"), (200.0, "high"), (100.0, "moderate"))
PERCENTILES = (0.95, 0.99)
INT_METRICS = ("n_requests", "n_successful", "n_failed")
STAT_ORDER = ("n_requests", "n_successful", "n_failed", "ttft_mean_ms", "ttft_median_ms",
              "ttft_p95_ms", "ttft_p99_ms", "ttft_min_ms", "ttft_max_ms", "total_time_mean_ms",
              "throughput_mean_tps", "throughput_max_tps")
# --- end of fixed values ---

CHUNK_SCHEMA = T.StructType([T.StructField("choices", T.ArrayType(T.StructType([
    T.StructField("delta", T.StructType([T.StructField("content", T.StringType())]))])))])


def micros_between(start: Column | str, end: Column | str) -> Column:
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e)


def ms_2dp(micros: Column) -> Column:
    """Milliseconds rounded half-up to 2 decimals, in integer arithmetic so
    no binary tie decides the last digit."""
    return F.floor((micros + 5) / 10) / 100.0


def json_number_2dp(c: Column) -> Column:
    """A 2-decimal double as the shortest JSON number (``12.5``, ``3.0``), never
    in exponent form."""
    s = F.regexp_replace(c.cast("decimal(38,2)").cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def _first_choice(line: Column) -> Column:
    """The first choice of the chunk a ``data:`` line carries; null if it carries none."""
    keep = (line != "") & (line != DONE_LINE) & line.startswith(DATA_PREFIX)
    chunk = strict_json(F.substring(line, len(DATA_PREFIX) + 1, 1 << 30), CHUNK_SCHEMA)
    return F.when(keep, F.get(chunk["choices"], F.lit(0)))          # null for an empty list of choices


def token_delta(line: Column | str) -> Column:
    """The non-empty delta a line carries, else null (T1 as one expression)."""
    d = _first_choice(F.col(line) if isinstance(line, str) else line)["delta"]["content"]
    return F.when(d != "", d)


def sse_parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Keep ``data:`` lines that are not ``[DONE]`` and are a chunk in strict
    JSON; ``delta`` is the content ('' when absent). Blank and bad lines drop out."""
    parsed = lines.withColumn("_first", _first_choice(F.col(line))).where("_first is not null")
    return parsed.withColumn("delta", F.coalesce(F.col("_first")["delta"]["content"], F.lit(""))).drop("_first", line)


def token_events(lines: DataFrame, request: str = "request_id", seq: str = "seq",
                 ts: str = "ts") -> DataFrame:
    """W2 + W3: non-empty deltas with their 0-based ``token_index`` per request
    and ``elapsed_ms`` since the request's first line."""
    start = lines.groupBy(request).agg(F.min(ts).alias("_start"))
    tokens = sse_parse(lines).where(F.col("delta") != "")
    idx = ordered_running(tokens, [request], [seq], index_col="token_index", sizes_of=lines)
    # aggregate side has one row per request; AQE splits a skewed request
    out = idx.join(start, request)
    return out.withColumn("elapsed_ms", ms_2dp(micros_between("_start", ts))).drop("_start")


def emit_tokens(events: DataFrame) -> Column:
    """T2 batch form: the relayed event ``{"token","index","elapsed_ms"}``."""
    head = F.to_json(F.struct(F.col("delta").alias("token"), F.col("token_index").alias("index")))
    return F.concat(F.regexp_replace(head, "}$", ""), F.lit(',"elapsed_ms":'), json_number_2dp(F.col("elapsed_ms")),
                    F.lit("}"))


def done_events(lines: DataFrame, request: str = "request_id", ts: str = "ts") -> DataFrame:
    """T3 batch form: per request ``total_tokens`` and ``total_ms``."""
    parsed = sse_parse(lines)
    n = parsed.groupBy(request).agg(F.count_if(F.col("delta") != "").alias("total_tokens"))
    span = lines.groupBy(request).agg(
        ms_2dp(micros_between(F.min(ts), F.max(ts))).alias("total_ms"))
    return span.join(n, request, "left").select(
        request, F.lit(True).alias("done"),
        F.coalesce(F.col("total_tokens"), F.lit(0)).alias("total_tokens"), "total_ms")


def assemble_text(lines: DataFrame, request: str = "request_id", seq: str = "seq",
                  chunk: int = 512) -> DataFrame:
    """T4 batch form: the full text of each request, tokens in order.

    Two-level concatenation: tokens are joined within bounded chunks of
    ``chunk`` positions (computed in parallel even for one long request),
    then the chunk strings are joined per request.
    """
    ev = token_events(lines, request, seq)
    ev = ev.withColumn("_chunk", (F.col("token_index") / chunk).cast("long"))
    parts = ev.groupBy(request, "_chunk").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("token_index", "delta"))), lambda x: x["delta"]), "").alias("_t"))
    return parts.groupBy(request).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_chunk", "_t"))), lambda x: x["_t"]), "").alias("text"))


def request_metrics(lines: DataFrame, request: str = "request_id", seq: str = "seq",
                    ts: str = "ts") -> DataFrame:
    """L1: ttft (first non-empty delta minus start), total time, token count,
    tokens/s (0 without tokens) and the first 100 characters of the text. A
    request with tokens but no duration has no rate: it counts as failed, with
    an error and no ttft.

    Only tokens starting before character 100 are gathered (a running sum
    of token lengths decides), so the gathered list is bounded.
    """
    parsed = sse_parse(lines)
    times = lines.groupBy(request).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"))
    first = parsed.where(F.col("delta") != "").groupBy(request).agg(
        F.min(ts).alias("_first"), F.count(F.lit(1)).alias("token_count"))
    toks = parsed.where(F.col("delta") != "")
    run = ordered_running(toks, [request], [seq], index_col=None,
                          sums={"_end_char": F.length("delta")}, sizes_of=lines)
    head = run.where(F.col("_end_char") - F.length("delta") < RESPONSE_CHARS).groupBy(request).agg(
        F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, "delta"))),
                                             lambda x: x["delta"]), ""), 1, RESPONSE_CHARS).alias("response"))
    m = times.join(first, request, "left").join(head, request, "left")
    total_us = micros_between("_start", "_end")
    n = F.coalesce(F.col("token_count"), F.lit(0))
    instant = (n > 0) & (total_us == 0)
    return m.select(
        request,
        F.when(~instant, micros_between("_start", "_first") / 1000.0).alias("ttft_ms"),
        (total_us / 1000.0).alias("total_time_ms"),
        n.cast("int").alias("token_count"),
        F.when(n > 0, F.try_divide(n.cast("double"), total_us / 1e6)).otherwise(F.lit(0.0)).alias("tokens_per_sec"),
        F.coalesce(F.col("response"), F.lit("")).alias("response"),
        F.when(instant, F.lit(ZERO_DURATION)).alias("error"))


#: Error text of a request whose lines all share one timestamp.
ZERO_DURATION = "zero duration"


def exact_mean(col: Column | str) -> Column:
    """Mean with an exact (decimal) sum, so the result is the correctly rounded
    mean whatever the partitioning and summation order. Values count to 18
    decimals; where one is infinite or not a number, or the sum has more than 20
    integer digits, it is the plain mean."""
    c = F.col(col) if isinstance(col, str) else col
    odd = F.count_if(c.isNotNull() & c.cast("decimal(38,18)").isNull())
    return F.when(odd > 0, F.avg(c)).otherwise(F.coalesce(F.avg(c.cast("decimal(38,18)")).cast("double"), F.avg(c)))


def _valid() -> Column:
    return F.col("ttft_ms").isNotNull() & (F.coalesce(F.col("error"), F.lit("")) == "")


def filter_valid_results(df: DataFrame) -> DataFrame:
    """F8: a ttft is present and the error is null or empty."""
    return df.where(_valid())


def latency_summary(measured: DataFrame, label: str = "label", key: str = "request_id"
                    ) -> DataFrame:
    """L2 + L3: per label n, ok, failed, ttft mean/median/p95/p99/min/max,
    total mean, throughput mean/max. No row for a label without a valid row.

    Median interpolates the two middle values; p95/p99 are the floor-rank
    order statistics ``sorted[int(n * q)]``, both found by selection: one pass
    for all other statistics and the probes, one for the counts between probes.
    """
    ok = _valid()
    v = F.when(ok, F.col("ttft_ms"))
    ranks = [*middle_ranks("_m0", "_m1"), *(floor_rank(f"ttft_p{int(round(q * 100))}_ms", q) for q in PERCENTILES)]
    stats = small_copy(measured.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_requests"), F.count_if(ok).alias("n_successful"),
        exact_mean(v).alias("ttft_mean_ms"), F.min(v).alias("ttft_min_ms"), F.max(v).alias("ttft_max_ms"),
        exact_mean(F.when(ok, F.col("total_time_ms"))).alias("total_time_mean_ms"),
        exact_mean(F.when(ok, F.col("tokens_per_sec"))).alias("throughput_mean_tps"),
        F.max(F.when(ok, F.col("tokens_per_sec"))).alias("throughput_max_tps"), probes(v, ranks).alias("_probes")))
    found = values_at(measured, [label], v, ranks, stats, n="n_successful", probed="_probes")
    out = null_safe_join(found, stats.drop("_probes"), [label])
    return out.withColumns({
        "ttft_median_ms": (F.col("_m0") + F.col("_m1")) / 2,
        "n_failed": F.col("n_requests") - F.col("n_successful")}).select(label, *STAT_ORDER)


def percentile_rank_floor(df: DataFrame, value: str, by: Sequence[str], tie: Sequence[str] = (),
                          qs: Sequence[float] = PERCENTILES) -> DataFrame:
    """L3 alone: ``sorted(values)[int(n * q)]`` per group, exactly, by selection
    (equal values need no ``tie`` to be ordered by)."""
    ranks = [floor_rank(f"p{int(round(q * 100))}", q) for q in qs]
    return select_ranks(df, list(by), F.col(value), ranks).select(*by, *(r.name for r in ranks))


def latency_target(mean: Column | str, target: float = TARGET_TTFT_MS) -> Column:
    """L4: the mean ttft strictly below the target."""
    c = F.col(mean) if isinstance(mean, str) else mean
    return c < target


def diagnose_latency(mean: Column | str, target: float = TARGET_TTFT_MS) -> Column:
    """``met`` under the target, else the first band exceeded, else ``none``."""
    c = F.col(mean) if isinstance(mean, str) else mean
    out = F.when(c < target, F.lit("met"))
    for bound, name in BANDS:
        out = out.when(c > bound, F.lit(name))
    return out.otherwise(F.lit("none"))


def stats_long(summary: DataFrame, label: str = "label") -> DataFrame:
    """Wide stats -> long ``(label, metric, value)``."""
    cast = summary.select(label, *[F.col(m).cast("double").alias(m) for m in STAT_ORDER])
    return cast.unpivot([label], list(STAT_ORDER), "metric", "value")


def merge_stats(*longs: DataFrame) -> DataFrame:
    """Dict merge of stats sets = union of their long forms."""
    out = longs[0]
    for d in longs[1:]:
        out = out.unionByName(d)
    return out


def format_stat(metric: Column, value: Column) -> Column:
    """``%.2f`` for floats (rounded half-even on the binary value), plain ints."""
    as_int = F.format_string("%d", value.cast("long"))
    as_float = F.format_string("%.2f", F.rint(value * 100) / 100)
    return F.when(metric.isin(*INT_METRICS), as_int).otherwise(as_float)


def stats_report_lines(long: DataFrame, label: str = "label") -> DataFrame:
    """Report lines ``label/metric: value`` with their section and order."""
    order = F.array_position(F.array(*[F.lit(m) for m in STAT_ORDER]), F.col("metric"))
    return long.select(
        F.col(label).alias("section"), order.cast("int").alias("line_no"),
        F.concat(F.col(label), F.lit("/"), F.col("metric"), F.lit(": "),
                 format_stat(F.col("metric"), F.col("value"))).alias("line"))


def write_stats_report(lines: DataFrame, path: str, sections: Sequence[str] = ("sequential", "concurrent"),
                       titles: dict[str, str] | None = None) -> None:
    """S8 sink: one text file, a header line per section; the named ``sections``
    come first, in order, then any others by name. A section without a title of
    its own gets the usual one."""
    order = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    rank = F.when(order > 0, order).otherwise(len(sections) + 1)
    title = F.concat(F.lit("=== "), F.upper("section"), F.lit(" BENCHMARK ==="))
    for name, own in (titles or {}).items():
        title = F.when(F.col("section") == name, F.lit(own)).otherwise(title)
    heads = lines.select("section").distinct().select("section", F.lit(0).alias("line_no"), title.alias("line"))
    body = heads.unionByName(lines.select("section", "line_no", "line"))
    (body.withColumn("_r", rank).orderBy("_r", "section", "line_no").select("line")
     .coalesce(1).write.mode("overwrite").text(path))
