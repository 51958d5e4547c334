"""Corpus preparation: clean, filter, first-wins dedup, format, split.

The whole preparation is one lazy plan
``scan -> clean -> length filter -> dedup -> to_instruction -> split``: an
exchange of headlines for the dedup aggregate and a join that brings back the
surviving articles; the exact split adds one range exchange.
"""

from __future__ import annotations

import math
from decimal import Decimal
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textforge.functions.text import clean_text, trim_ws
from textforge.plans.joins import null_safe_join, small_copy
from textforge.plans.ordered import ordered_index
from textforge.plans.selection import Rank, probes, values_at

# --- fixed values of the reference pipeline ---
INSTRUCTION = "لخص هذا النص بالدارجة المغربية:"
SPLIT_SEED = 42
SPLIT_RATIOS = (0.9, 0.05, 0.05)          # train, val, test
HEADLINE_MIN_LENGTH = 15
DEFAULT_MIN_LENGTH = 10
SPLIT_ORDER = ("train", "validation", "test")   # order the splits are visited in
BENCH_PROMPTS = (
    "أعلنت وزارة التربية الوطنية عن إطلاق برنامج جديد لتحسين جودة التعليم في المدارس العمومية المغربية، يشمل توفير أجهزة لوحية لجميع تلاميذ السنة الأولى إعدادي.",
    "سجل الاقتصاد المغربي نمواً بنسبة 3.2 بالمئة خلال الربع الثالث من السنة الجارية، مدفوعاً بالأداء الجيد لقطاعي الفلاحة والسياحة.",
    "حقق المنتخب المغربي لكرة القدم فوزاً مهماً على نظيره الغاني بهدفين مقابل هدف ضمن مباريات التصفيات الإفريقية المؤهلة لكأس العالم.",
    "أفادت مصادر طبية بأن وزارة الصحة أطلقت حملة تلقيح وطنية شاملة تستهدف الفئات الأكثر هشاشة في جميع أنحاء المملكة.",
    "أعلنت المديرية العامة للأرصاد الجوية عن موجة برد قارس ستضرب عدة مناطق من المغرب خلال الأيام القادمة مع تساقطات ثلجية على المرتفعات.",
)
# --- end of fixed values ---


def clean_corpus(df: DataFrame, cols: Sequence[str] = ("article", "headline")) -> DataFrame:
    """``clean_text`` on each text column, one projection."""
    return df.withColumns({c: clean_text(c) for c in cols})


def filter_min_length(df: DataFrame, col: str = "headline",
                      min_length: int = DEFAULT_MIN_LENGTH) -> DataFrame:
    """keep rows whose stripped text has at least ``min_length`` code points."""
    return df.where(F.length(trim_ws(col)) >= min_length)


def dedup_keep_first(df: DataFrame, key: str = "headline",
                     order: Sequence[str] = ("split_rank", "pos")) -> DataFrame:
    """one row per ``key``: the first in ``order`` (across splits).

    A ``min(struct(order..., rest...))`` aggregate: partial aggregation keeps
    one candidate per key per map task, so a boilerplate headline that
    holds a third of the rows shrinks before the shuffle. Unlike
    ``dropDuplicates`` the survivor is defined.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(key).agg(best).select(
        *[F.col(f"_first.{c}").alias(c) for c in (*order, *rest)], F.col(key))


_WORD, _SHIFT, _LAST_RANK = Decimal(1 << 64), Decimal(1 << 63), Decimal(1 << 32)


def first_positions(df: DataFrame, key: str = "headline", rank: str = "split_rank",
                    pos: str = "pos", keep: Column | None = None) -> DataFrame:
    """``key -> (rank, pos)`` of its first row in that order.

    The pair is carried as one 38-digit decimal, which holds any two longs, so
    ``min`` is a fixed-width HashAggregate (partial aggregation per map task,
    no sort); a key holding a third of all rows leaves one candidate per task.
    A null rank or position comes after every other one (and is returned as null).
    Rows failing ``keep`` never win. The test sits inside the aggregate on
    purpose: as a Filter it would be pushed below the projection that computes
    ``key`` (duplicating that expression) and below any preceding repartition.
    """
    last_rank, last_pos = F.lit(_LAST_RANK), F.lit(_WORD)
    whole = F.coalesce(F.col(pos).cast("decimal(20,0)") + F.lit(_SHIFT), last_pos)
    pair = (F.coalesce(F.col(rank).cast("decimal(18,0)"), last_rank) * F.lit(_WORD * 2) + whole).cast("decimal(38,0)")
    if keep is not None:
        pair = F.when(keep, pair)
    firsts = df.groupBy(key).agg(F.min(pair).alias("_first")).where(F.col("_first").isNotNull())
    low = F.pmod(F.col("_first"), F.lit(_WORD * 2))
    high = ((F.col("_first") - low) / F.lit(_WORD * 2)).cast("long")
    return firsts.select(
        key, F.when(high != int(_LAST_RANK), high).cast(df.schema[rank].dataType).alias(rank),
        F.when(low < last_pos, (low - F.lit(_SHIFT)).cast("long")).alias(pos))


def _unplaced() -> Column:
    """A row whose place in the corpus is unknown: it comes after all others."""
    return F.col("split_rank").isNull() | F.col("pos").isNull()


def prepare_corpus(raw: DataFrame, min_length: int = HEADLINE_MIN_LENGTH) -> DataFrame:
    """C13 -> F1 -> F2, the cleaning stage of the pipeline.

    Equivalent to ``dedup_keep_first(filter_min_length(clean_corpus(raw)))``
    but ordered for cost: headlines are cleaned and deduplicated first on
    small rows, then only the surviving articles are joined back on
    ``(split_rank, pos)`` (positions restart in every split) and cleaned, so duplicates never pay for the article regex chain.
    """
    heads = raw.select("split_rank", "pos", clean_text("headline").alias("headline"))
    ok = F.length(trim_ws("headline")) >= min_length
    winners = first_positions(heads, keep=ok)
    rest = [c for c in raw.columns if c != "headline"]
    kept = winners.where(~_unplaced()).join(raw.select(*rest), ["split_rank", "pos"])
    # headlines that only rows without a place have: found by the headline, the least such row
    loose = raw.where(_unplaced()).withColumn("headline", clean_text("headline"))
    loose = loose.join(winners.where(_unplaced()).select("headline"), "headline").where(ok)
    nth = F.row_number().over(Window.partitionBy("headline").orderBy(*rest))       # cut to one a task before the exchange
    loose = loose.withColumn("_n", nth).where("_n = 1").drop("_n")
    kept = kept.select(*rest, "headline").unionByName(loose.select(*rest, "headline"))
    return kept.withColumn("article", clean_text("article"))


def to_instruction(df: DataFrame, instruction: str = INSTRUCTION, keep: Sequence[str] = ()
                   ) -> DataFrame:
    """``instruction, input, output``; an absent source column becomes ``''``."""
    cols = set(df.columns)
    src = lambda c: F.col(c) if c in cols else F.lit("")
    return df.select(*keep, F.lit(instruction).alias("instruction"),
                     src("article").alias("input"), src("headline").alias("output"))


def split_bucket(id_col: Column | str, seed: int = SPLIT_SEED) -> Column:
    """Uniform [0, 1) from the first 32 bits of ``md5(seed|id)``: row-stable."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(2 ** 32)


def split_hash(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED,
               ratios: Sequence[float] = SPLIT_RATIOS, out: str = "split") -> DataFrame:
    """90/5/5 split by a seeded hash; a map-only projection, no shuffle."""
    tr, va, _ = ratios
    u = split_bucket(id_col, seed)
    return df.withColumn(out, F.when(u < tr, "train").when(u < tr + va, "val").otherwise("test"))


def split_exact(df: DataFrame, id_col: str = "id", seed: int = SPLIT_SEED,
                ratios: Sequence[float] = SPLIT_RATIOS, out: str = "split") -> DataFrame:
    """exact sizes: train = floor(r_train * n), test = ceil(rest * r_test / (r_val + r_test)).

    Rows are ordered by (hash, id), but never sorted or numbered: the two cut
    keys are found by selection (counts between probes), then the split is a
    projection with literals. Where a cut falls among rows of one and the same
    key, those cannot be told apart by it and the rows are numbered instead.
    """
    tr, va, te = ratios
    keyed = df.withColumn("_h", F.coalesce(split_bucket(id_col, seed), F.lit(-1.0)))      # rows without an id come first

    def bounds(n: int) -> tuple[int, int]:
        n_train = int(n * tr)
        rest = n - n_train
        return n_train, n_train + rest - int(min(rest, math.ceil(rest * te / (va + te))))

    head = F.lit(0)
    probe = keyed.groupBy(head.alias("_all")).agg(
        F.count(F.lit(1)).alias("n"), probes(F.col("_h"), [Rank("a", tr, None), Rank("b", tr + va, None)]).alias("probes"))
    stats = small_copy(probe)
    one = stats.first()
    if one is None or one["n"] == 0 or one["probes"] is None:
        return df.withColumn(out, F.lit("train"))
    n = one["n"]
    cuts = [c for c in sorted(set(bounds(n))) if c < n]
    ranks = [Rank(f"c{k}", (tr, tr + va)[bounds(n).index(c)], lambda _, c=c: F.lit(c).cast("long")) for k, c in enumerate(cuts)]
    found = values_at(keyed.withColumn("_all", head), ["_all"], F.col("_h"), ranks, stats.withColumn(
        "probes", F.flatten(F.array(*[F.slice("probes", 1 + 2 * (bounds(n).index(c)), 2) for c in cuts])))).first() if cuts else None
    at = F.lit(0)
    for k, c in enumerate(cuts):
        h, skip = found[f"c{k}"], c - found[f"c{k}_before"]
        tied = keyed.where(F.col("_h") == F.lit(h)).select(id_col).orderBy(id_col).limit(skip + 2).collect()
        ids = [r[0] for r in tied]
        if skip + 1 < len(ids) and ids[skip] == ids[skip + 1] or skip and ids[skip - 1] == ids[skip] or ids[skip] is None:
            return _split_numbered(keyed, id_col, *bounds(n), out)
        at = at + F.when((F.col("_h") > F.lit(h)) | ((F.col("_h") == F.lit(h)) & (F.col(id_col) >= F.lit(ids[skip]))), 1).otherwise(0)
    names = ["train", *(("val", "test")[bounds(n).index(c)] for c in cuts)]
    # two equal cuts leave the part between them empty
    if len(cuts) == 1 and bounds(n)[0] == bounds(n)[1]:
        names[1] = "test"
    return keyed.withColumn(out, F.get(F.array(*[F.lit(x) for x in names]), at)).drop("_h")


def _split_numbered(keyed: DataFrame, id_col: str, first: int, second: int, out: str) -> DataFrame:
    pos = ordered_index(keyed, [], ["_h", id_col], index_col="_pos")
    return pos.withColumn(out, F.when(F.col("_pos") < first, "train").when(F.col("_pos") < second, "val").otherwise("test")
                          ).drop("_h", "_pos")


def split_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """rows per split plus the total, as ``split, n``."""
    per = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.lit("total").alias(split_col), F.count(F.lit(1)).alias("n"))
    return per.unionByName(total)


def take_first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """the first ``min(n, len)`` rows in order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def preview_rows(df: DataFrame, order: Sequence[str], text_cols: Sequence[str], n: int = 3,
                 width: int = 150) -> DataFrame:
    """first ``n`` rows with text columns cut to ``width`` characters."""
    head = take_first_n(df, order, n)
    return head.withColumns({c: F.substring(c, 1, width) for c in text_cols})


def assign_round_robin(df: DataFrame, index_col: str, prompts: Sequence[str] = BENCH_PROMPTS,
                       out: str = "prompt") -> DataFrame:
    """row ``i`` gets prompt ``i mod k``; the k-row prompt table is broadcast."""
    spark = df.sparkSession
    table = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)],
                                  "_slot int, " + out + " string")
    keyed = df.withColumn("_slot", F.pmod(F.col(index_col), F.lit(len(prompts))).cast("int"))
    return keyed.join(F.broadcast(table), "_slot").drop("_slot")


def union_splits(*dfs: DataFrame) -> DataFrame:
    """All splits into one set (by column name)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def cleaning_report(raw: DataFrame, min_length: int = HEADLINE_MIN_LENGTH) -> DataFrame:
    """C14: per split: rows in, too short, duplicate, kept, characters removed.

    One projection cleans each text once. The first-position aggregate
    carries the length test inside (no Filter over cleaned text for
    Catalyst to push below the projection). Survivors are marked with an
    equi-join on the unique ``(split_rank, pos)``.
    """
    cleaned = raw.select(
        "split", "split_rank", "pos", clean_text("headline").alias("headline"),
        (F.coalesce(F.length("article"), F.lit(0)) + F.coalesce(F.length("headline"), F.lit(0))
         - F.coalesce(F.length(clean_text("article")), F.lit(0))).alias("_removed_a"))
    flagged = cleaned.withColumns({
        "_ok": F.coalesce(F.length(trim_ws("headline")) >= min_length, F.lit(False)),
        "_removed": F.col("_removed_a") - F.coalesce(F.length("headline"), F.lit(0))})
    # a row without a place is known by its headline; of such rows with one headline a split keeps one
    key = F.when(_unplaced(), F.col("headline")).alias("_loose")
    first = first_positions(flagged, keep=F.col("_ok")).select("split_rank", "pos", key, F.lit(True).alias("_kept"))
    marked = null_safe_join(flagged.withColumn("_loose", key), first, ["split_rank", "pos", "_loose"], "left")
    kept = F.coalesce(F.col("_kept"), F.lit(False)) & F.col("_ok")
    placed = kept & F.col("_loose").isNull()
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~F.col("_ok")).alias("short"),
        (F.count_if(F.col("_ok") & ~placed) - F.count_distinct(F.when(kept, F.col("_loose")))).alias("duplicate"),
        (F.count_if(placed) + F.count_distinct(F.when(kept, F.col("_loose")))).alias("kept"),
        F.sum("_removed").alias("chars_removed"))
