"""Exact positions and running sums within groups, without one task per hot group.

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task,
so a group holding a third of the table serialises a third of the job. Groups
are counted first; those of at most HOT_ROWS rows go through that plain window,
one exchange. The rows of the others are range-partitioned on ``(g, o)`` instead, so a hot group is cut
into many ordered pieces of bounded size:

1. ``repartitionByRange(P, g, o)`` and tag each row with its range piece
   ``pid`` (an explicit partition count, so AQE never coalesces the pieces
   and ``pid`` is stable);
2. a running count/sum inside each ``(pid, g)`` piece (a window over a
   bounded piece);
3. the tagged rows are checkpointed once, so every consumer sees the
   same pieces;
4. only the first and last group of a piece can continue in another piece,
   so the carried offsets come from at most ``2 * P`` boundary pieces: that
   table has a proven size bound and is broadcast.

The order columns must be a total order within the group (add a unique tie
breaker), which also makes a recomputed task produce the same positions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark import StorageLevel
from pyspark.sql import functions as F

from textforge.plans.joins import null_safe_join
from textforge.session import ensure_checkpoint_dir

PID = "_tf_pid"
#: Rows that one task may order as a group, and hot groups that may be sent to every task.
HOT_ROWS, MAX_HOT = 1 << 18, 1 << 16


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}


def _bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", text or "")
    return int(m.group(1)) * _UNITS.get(m.group(2).lower(), 1) if m else 64 << 20


#: Session setting that bounds the range pieces; larger pieces sort with spilling.
MAX_PIECES_CONF, MAX_PIECES = "spark.textforge.ordered.maxPieces", 20000


def leaf_bytes(df: DataFrame) -> int | None:
    """Bytes of the scans under ``df``: grows with the input, unlike the size
    estimate of a join, which multiplies its sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(s < (1 << 62) for s in sizes) else None


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    """Range pieces: one per advisory partition size of the scanned bytes (AQE
    cannot coalesce an explicit range exchange, so size it up front), at least
    the cluster's parallelism, at most the session's bound; the shuffle width
    when the size is unknown."""
    if num_partitions:
        return int(num_partitions)
    spark = df.sparkSession
    size = leaf_bytes(df)
    if size is None:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB"))
    most = int(spark.conf.get(MAX_PIECES_CONF, str(MAX_PIECES)))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-size // max(target, 1))))


def ordered_running(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str | Column],
    *,
    index_col: str | None = "idx",
    sums: Mapping[str, Column] | None = None,
    num_partitions: int | None = None,
    sizes_of: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add a 0-based position ``index_col`` and inclusive running ``sums``.

    Positions and sums restart for every value of ``group_cols`` and follow
    ``order_cols`` (ascending unless given as sorted Columns). ``sizes_of`` may
    name a cheaper table with at least as many rows of every group, to be counted
    in place of ``df``. ``num_partitions`` sends every group the way of the hot ones.
    """
    sums = dict(sums or {})
    group_cols = list(group_cols)
    if group_cols and num_partitions is None:
        hot = _hot_groups(df if sizes_of is None else sizes_of, group_cols, hot_rows or HOT_ROWS)
        if hot is None:
            return _in_windows(df, group_cols, order_cols, index_col, sums)
        if hot is not df:
            mark = null_safe_join(df, F.broadcast(hot.withColumn("_tf_hot", F.lit(True))), group_cols, "left")
            cold, warm = (mark.where(c).drop("_tf_hot") for c in ("_tf_hot is null", "_tf_hot"))
            return _in_windows(cold, group_cols, order_cols, index_col, sums).unionByName(
                _in_ranges(warm, group_cols, order_cols, index_col, sums, None))
    return _in_ranges(df, group_cols, order_cols, index_col, sums, num_partitions)


def _hot_groups(df: DataFrame, group_cols: list[str], hot_rows: int) -> DataFrame | None:
    """The groups of more than ``hot_rows`` rows; None if there are none, ``df``
    itself if they are too many to be sent to every task."""
    hot = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_tf_n")).where(F.col("_tf_n") > hot_rows).drop("_tf_n")
    rows = hot.limit(MAX_HOT + 1).collect()
    if len(rows) > MAX_HOT:
        return df
    return df.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def _in_windows(df: DataFrame, group_cols: list[str], order_cols: Sequence[str | Column], index_col: str | None,
                sums: Mapping[str, Column]) -> DataFrame:
    of = Window.partitionBy(*group_cols).orderBy(*order_cols)
    running = of.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df
    if index_col:
        out = out.withColumn(index_col, (F.row_number().over(of) - 1).cast("long"))
    return out.withColumns({name: F.sum(expr).over(running) for name, expr in sums.items()}) if sums else out


def _in_ranges(df: DataFrame, group_cols: list[str], order_cols: Sequence[str | Column], index_col: str | None,
               sums: Mapping[str, Column], num_partitions: int | None) -> DataFrame:
    p = _partitions(df, num_partitions)
    keyed = df
    tmp_sums = {}
    for i, (name, expr) in enumerate(sums.items()):
        tmp = f"_tf_v{i}"
        keyed = keyed.withColumn(tmp, expr)
        tmp_sums[name] = tmp
    ranged = keyed.repartitionByRange(p, *group_cols, *order_cols).withColumn(
        PID, F.spark_partition_id())
    piece = Window.partitionBy(PID, *group_cols).orderBy(*order_cols)
    running = piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("_tf_cnt", F.count(F.lit(1)).over(running))
    for name, tmp in tmp_sums.items():
        local = local.withColumn(f"_tf_loc_{tmp}", F.sum(tmp).over(running))
    # The range bounds come from a sample seeded by the RDD id, so two
    # evaluations of the exchange may cut pieces differently. Materialise
    # the pieces once (reliable checkpoint in the shared checkpoint folder)
    # so that the offsets and the rows they are added to agree, also when
    # a lost executor forces a recomputation.
    ensure_checkpoint_dir(df.sparkSession)
    # persisted for the duration of the checkpoint job only, so writing the
    # checkpoint does not recompute the window stage a second time
    cached = local.persist(StorageLevel.MEMORY_AND_DISK)
    local = cached.checkpoint(eager=True)
    cached.unpersist()

    aggs = [F.max("_tf_cnt").alias("_tf_cnt")] + [
        F.sum(tmp).alias(f"_tf_tot_{tmp}") for tmp in tmp_sums.values()]
    pieces = local.groupBy(PID, *group_cols).agg(*aggs)
    gkey = F.struct(*[F.col(c) for c in group_cols]) if group_cols else F.lit(0)
    ends = pieces.groupBy(PID).agg(F.min(gkey).alias("_tf_lo"), F.max(gkey).alias("_tf_hi"))
    boundary = (pieces.join(ends, PID)
                .where(gkey.eqNullSafe(F.col("_tf_lo")) | gkey.eqNullSafe(F.col("_tf_hi"))))
    before = (Window.partitionBy(*group_cols).orderBy(PID)
              .rowsBetween(Window.unboundedPreceding, -1))
    offs = boundary.select(
        PID, *group_cols,
        F.coalesce(F.sum("_tf_cnt").over(before), F.lit(0)).alias("_tf_off_cnt"),
        *[F.coalesce(F.sum(f"_tf_tot_{tmp}").over(before), F.lit(0)).alias(f"_tf_off_{tmp}")
          for tmp in tmp_sums.values()])
    # at most 2 * P rows, and P is bounded by MAX_PIECES_CONF; null groups are groups too
    out = null_safe_join(local, F.broadcast(offs), [PID, *group_cols], "left")
    if index_col:
        out = out.withColumn(index_col,
                             F.coalesce(F.col("_tf_off_cnt"), F.lit(0)) + F.col("_tf_cnt") - 1)
    for name, tmp in tmp_sums.items():
        out = out.withColumn(name, F.coalesce(F.col(f"_tf_off_{tmp}"), F.lit(0))
                             + F.col(f"_tf_loc_{tmp}"))
    drop = [PID, "_tf_cnt", "_tf_off_cnt"] + [
        c for tmp in tmp_sums.values() for c in (tmp, f"_tf_loc_{tmp}", f"_tf_off_{tmp}")]
    return out.drop(*drop)


def ordered_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                  index_col: str = "idx", num_partitions: int | None = None, sizes_of: DataFrame | None = None) -> DataFrame:
    """0-based position within the group: ``row_number() - 1`` that scales."""
    return ordered_running(df, group_cols, order_cols, index_col=index_col,
                           num_partitions=num_partitions, sizes_of=sizes_of)


def group_sizes(df: DataFrame, group_cols: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group, as a partial+final aggregate (map-side combine)."""
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(name))
