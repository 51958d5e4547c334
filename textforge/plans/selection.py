"""Exact order statistics by counting, without sorting, moving or writing a table.

The value at a rank of each group is found in passes over all partitions:

1. a mergeable sketch per group gives two probes around every wanted rank;
2. (only for inputs so large that what lies between two probes is still much:
   the sketch of the values between them gives closer probes;)
3. one pass counts, exactly, the values below the lower probe and each distinct
   value up to the upper one. These counts, a few hundredths of a percent of the
   group, are all that is shuffled; their running sums say which value has the rank.

Before that, a pass counts what lies below and up to the probes. The sketch's error
is about 1 / ACCURACY of the group's rows and the probes lie twice as far, but the
answer does not rest on it: a probe on the wrong side of its rank is replaced by the
group's least or largest value. Groups are joined null-safely; null values are not ranked.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.plans.joins import small_copy, null_safe_join
from textforge.plans.ordered import leaf_bytes

ACCURACY = 10_000
#: Values between two probes that are counted one by one without another round.
FEW = 1_000_000
#: Probes of a further round.
STEPS = 256


@dataclass(frozen=True)
class Rank:
    """A wanted 0-based rank: about ``fraction`` of a group, exactly ``of(n)`` for n values."""
    name: str
    fraction: float
    of: Callable[[Column], Column]


def floor_rank(name: str, q: float) -> Rank:
    return Rank(name, q, lambda n: F.floor(n * F.lit(float(q))).cast("long"))


def middle_ranks(low: str, high: str) -> tuple[Rank, Rank]:
    """The two middle ranks; their values' mean is the median."""
    return (Rank(low, 0.5, lambda n: F.floor((n - 1) / 2).cast("long")), Rank(high, 0.5, lambda n: F.floor(n / 2).cast("long")))


def probes(value: Column, ranks: Sequence[Rank]) -> Column:
    """The aggregate that gives two probes per rank, nulls ignored."""
    reach = 2 / ACCURACY
    at = [min(1.0, max(0.0, p)) for r in ranks for p in (r.fraction - reach, r.fraction + reach)]
    return F.percentile_approx(value, at, ACCURACY)


def rounds_for(df: DataFrame) -> int:
    """Further rounds of probes that the scanned bytes (about a row each) call for."""
    size = leaf_bytes(df) or 0
    left = size * 4 / ACCURACY
    return 0 if left <= FEW else math.ceil(math.log(left / FEW) / math.log(STEPS / 4))


def values_at(df: DataFrame, by: Sequence[str], value: Column, ranks: Sequence[Rank], stats: DataFrame,
              n: str = "n", probed: str = "probes", rounds: int | None = None) -> DataFrame:
    """(by..., name, name_before for each rank): the value at the rank and how
    many values are smaller. ``stats`` has a row per group with the number ``n``
    of its values and the ``probes`` of all of them; groups without values have no row."""
    by = list(by)
    want = [F.struct(F.lit(k).alias("t"), r.of(F.col(n)).alias("r"), F.get(probed, F.lit(2 * k)).alias("lo"),
                     F.get(probed, F.lit(2 * k + 1)).alias("hi")) for k, r in enumerate(ranks)]
    held = stats.where(F.col(n) > 0).select(*by, F.array(*want).alias("_want"))
    rows = df.select(*by, value.alias("_v")).where("_v is not null")
    for _ in range(rounds_for(df) if rounds is None else rounds):
        held = _closer(rows, by, held)
    joined = null_safe_join(rows, small_copy(_checked(rows, by, held)), by)
    # what lies below a lower probe is one row a task, the rest a row per distinct value
    tagged = joined.select(*by, "_v", F.explode(F.filter("_want", lambda w: F.col("_v") <= w["hi"])).alias("w"))
    counts = tagged.groupBy(*by, F.col("w.t").alias("t"), F.col("w.r").alias("r"),
                            F.when(F.col("_v") >= F.col("w.lo"), F.col("_v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "t").orderBy(F.asc_nulls_first("v")))
    hit = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("c")).where(
        (F.col("_from") <= F.col("r")) & (F.col("r") < F.col("_to")))
    out = []
    for k, r in enumerate(ranks):
        out += [F.max(F.when(F.col("t") == k, F.col("v"))).alias(r.name), F.max(F.when(F.col("t") == k, F.col("_from"))).alias(f"{r.name}_before")]
    return hit.groupBy(*by).agg(*out)


def _per_target(rows: DataFrame, by: list[str], held: DataFrame, *aggs: Column) -> DataFrame:
    joined = null_safe_join(rows, small_copy(held), by)
    each = joined.select(*by, "_v", F.explode("_want").alias("w"))
    return each.groupBy(*by, *[F.col(f"w.{c}").alias(c) for c in ("t", "r", "lo", "hi")]).agg(*aggs)


def _wanted(per: DataFrame, by: list[str], lo: Column, hi: Column) -> DataFrame:
    return per.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("t", "r", lo.alias("lo"), hi.alias("hi")))).alias("_want"))


def _checked(rows: DataFrame, by: list[str], held: DataFrame) -> DataFrame:
    """``held`` with every probe on its side of the rank, by exact counts."""
    v = F.col("_v")
    per = _per_target(rows, by, held, F.count_if(v < F.col("w.lo")).alias("_below"), F.count_if(v <= F.col("w.hi")).alias("_upto"),
                      F.min(v).alias("_min"), F.max(v).alias("_max"))
    return _wanted(per, by, F.when(F.col("_below") > F.col("r"), F.col("_min")).otherwise(F.col("lo")),
                   F.when(F.col("_upto") <= F.col("r"), F.col("_max")).otherwise(F.col("hi")))


def _closer(rows: DataFrame, by: list[str], held: DataFrame) -> DataFrame:
    """``held`` with closer probes: from the sketch of the values between the present ones."""
    v = F.col("_v")
    inside = (v >= F.col("w.lo")) & (v <= F.col("w.hi"))
    per = _per_target(rows, by, held, F.count_if(v < F.col("w.lo")).alias("_below"), F.count_if(inside).alias("_in"),
                      F.percentile_approx(F.when(inside, v), [k / STEPS for k in range(STEPS + 1)], ACCURACY).alias("_at"))
    place = F.floor((F.col("r") - F.col("_below")) * STEPS / F.col("_in")).cast("int")
    pick = lambda k: F.get("_at", F.least(F.greatest(k, F.lit(0)), F.lit(STEPS)))
    return _wanted(per, by, pick(place - 1), pick(place + 2))


def select_ranks(df: DataFrame, by: Sequence[str], value: Column, ranks: Sequence[Rank],
                 rounds: int | None = None) -> DataFrame:
    """(by..., n, name, name_before ...): see ``values_at``."""
    stats = small_copy(df.groupBy(*by).agg(F.count(value).alias("n"), probes(value, ranks).alias("probes")))
    found = values_at(df, by, value, ranks, stats, rounds=rounds)
    return null_safe_join(found, stats.select(*by, "n"), list(by))
