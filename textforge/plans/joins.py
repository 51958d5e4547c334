"""Joins that keep null keys.

``df.join(other, "key")`` loses rows whose key is null. A side table with one
row per key (group sizes, statistics) is joined null-safely instead. How a hot
key is split is left to adaptive execution; a small side of a written table can
be broadcast after a check of its bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MAX_BROADCAST_BYTES = 8 << 20


def checked_broadcast(side: DataFrame, row_bytes: int = 64) -> DataFrame:
    """``broadcast(side)`` if its rows, at ``row_bytes`` each, fit the bound, else
    ``side``. The check counts rows of ``side``: use it on cheap sides only."""
    most = MAX_BROADCAST_BYTES // row_bytes
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def small_copy(side: DataFrame, row_bytes: int = 512) -> DataFrame:
    """``side`` computed once and broadcast if its rows, at ``row_bytes`` each, fit
    the bound; otherwise ``side`` itself, left to a shuffled join. For aggregates
    over few groups, whose input would else be read again for every use."""
    most = MAX_BROADCAST_BYTES // row_bytes
    rows = side.limit(most + 1).collect()
    return F.broadcast(side.sparkSession.createDataFrame(rows, side.schema)) if len(rows) <= most else side


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, on)`` where null equals null; key columns are left's."""
    renamed = right.select(*[F.col(c).alias(f"_tf_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(renamed[f"_tf_r_{c}"])
    return left.join(renamed, cond, how).drop(*[f"_tf_r_{c}" for c in on])
