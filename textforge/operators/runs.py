"""Run tracking tables: configs, trainer logs, checkpoints, versions
(P19, P20, W4-W8, U7; S9 lives in :mod:`textforge.sources.io`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.plans.ordered import ordered_running

# --- fixed values: trainer schedule and metric names ---
LOGGING_STEPS = 50
EVAL_STEPS = 200
SAVE_STEPS = 200
SAVE_TOTAL_LIMIT = 2
BEST_METRIC = "eval_loss"
METRIC_NAMES = {"loss": "train/loss", "eval_loss": "eval/loss", "learning_rate": "train/learning_rate"}
# --- end of fixed values ---


def _leaf_paths(dtype: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(dtype, T.StructType):
        out = []
        for f in dtype.fields:
            out += _leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)
        return out
    return [prefix]


def flatten_config(df: DataFrame, config: str, keep: Sequence[str] = ()) -> DataFrame:
    """A nested struct column -> ``(keep..., key, value)`` rows with dotted
    keys; lists and maps stay one (JSON) value. The schema walk is driver-side
    metadata only; the data step is one ``select`` + ``unpivot``."""
    paths = _leaf_paths(df.schema[config].dataType)

    def as_text(p: str) -> Column:
        c = F.col(f"{config}.{p}")
        t = df.select(c).schema[0].dataType
        return F.to_json(c) if isinstance(t, (T.ArrayType, T.MapType)) else c.cast("string")

    wide = df.select(*keep, *[as_text(p).alias(p) for p in paths])
    return wide.unpivot(list(keep), [F.col(f"`{p}`") for p in paths], "key", "value")


def select_train_metrics(log: DataFrame, keep: Sequence[str] = ("run", "step"),
                         names: dict[str, str] = METRIC_NAMES) -> DataFrame:
    """P20: from each log row keep the known metrics that are present, under
    their tracking names, as ``(keep..., key, value)``."""
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in names]),
                          F.array(*[F.col(k).cast("double") for k in names]))
    present = F.map_filter(m, lambda k, v: v.isNotNull())
    rename = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    long = log.select(*keep, F.explode(present).alias("_k", "value"))
    return long.select(*keep, F.element_at(rename, F.col("_k")).alias("key"), "value")


def log_every_k_steps(log: DataFrame, k: int = EVAL_STEPS, step: str = "step") -> DataFrame:
    """Rows at step multiples of ``k``."""
    return log.where(F.col(step) % k == 0)


def best_step_by_metric(log: DataFrame, run: str = "run", metric: str = BEST_METRIC,
                        step: str = "step") -> DataFrame:
    """The step with the lowest metric per run (earliest step on ties);
    a ``min_by`` aggregate with map-side combine."""
    ok = log.where(F.col(metric).isNotNull())
    order = F.struct(F.col(metric), F.col(step))
    return ok.groupBy(run).agg(F.min_by(F.col(step), order).alias("best_step"),
                               F.min(metric).alias(f"best_{metric}"))


def saved_checkpoints(log: DataFrame, save_steps: int = SAVE_STEPS, step: str = "step") -> DataFrame:
    return log.where(F.col(step) % save_steps == 0)


def retain_last_k(log: DataFrame, k: int = SAVE_TOTAL_LIMIT, run: str = "run", step: str = "step",
                  metric: str = BEST_METRIC) -> DataFrame:
    """Of the saved checkpoints, the ``k`` most recent per run plus the best.

    ``row_number() <= k`` is planned with a partial ``WindowGroupLimit`` before
    the shuffle, so each map task sends at most ``k`` rows per run.
    """
    saved = saved_checkpoints(log).select(run, step, metric)
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    recent = saved.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k) \
        .select(run, step, F.lit("recent").alias("reason"))
    best = best_step_by_metric(saved, run, metric, step).select(
        run, F.col("best_step").alias(step), F.lit("best").alias("reason"))
    both = recent.unionByName(best)
    return both.groupBy(run, step).agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reason"))


def latest_step(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """The last saved checkpoint per run (the resume point)."""
    return saved_checkpoints(log).groupBy(run).agg(F.max(step).alias("latest_step"))


def assign_versions(registrations: DataFrame, name: str = "name", created: Sequence[str] = ("created",)
                    ) -> DataFrame:
    """Consecutive version numbers 1, 2, ... per registered name in creation
    order (a scalable ``row_number``)."""
    pos = ordered_running(registrations, [name], list(created), index_col="_v")
    return pos.withColumn("version", (F.col("_v") + 1).cast("int")).drop("_v")


def run_config(log: DataFrame, run: str = "run") -> DataFrame:
    """A nested per-run config derived from the log (the shape P19 flattens)."""
    return log.groupBy(run).agg(F.struct(
        F.struct(F.max("learning_rate").alias("learning_rate"),
                 F.lit(LOGGING_STEPS).alias("logging_steps"),
                 F.max("step").alias("max_steps")).alias("training"),
        F.struct(F.lit(EVAL_STEPS).alias("eval_steps"), F.lit(SAVE_STEPS).alias("save_steps"),
                 F.lit(SAVE_TOTAL_LIMIT).alias("save_total_limit"),
                 F.lit(BEST_METRIC).alias("metric_for_best_model")).alias("evaluation"),
        F.array(F.lit("loss"), F.lit("eval_loss")).alias("report")).alias("config"))
