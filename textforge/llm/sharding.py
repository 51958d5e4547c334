"""Sharding by histogram sort (DataFrame functions only); the ``bytes`` law.

Documents are ordered by (key, id), the key being the leading 60 bits of the
text's MD5, so equal texts are neighbours. Shard borders sit at equal shares of
the total bytes and are found without sorting anything: each round counts the
exact bytes below evenly spaced probes inside every border's key interval, over
all partitions, and keeps the probe cell that holds the border. When a cell is
a single key (a group of equal texts), the group stays whole if it is small
(``group_share`` of a shard), else the search goes on over its ids, so a hot
group is split exactly where the bytes ask for it. Only probe counts, never
rows, reach the driver: shards * probes numbers a round.

The same search also cuts every shard into equal cells, so the one exchange
deals bounded parts of a shard (inside a hot group too): a row's slot is its
rank in its cell plus the rows of the shard's earlier cells.

Null or empty text: 8 bytes, grouped as the empty text. Rows that repeat both id
and text are one unit for the border search and get distinct slots. A null id
sorts first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm.registry import register, table
from textforge.llm.scratch import materialise

SHARDS = 24
ROW_OVERHEAD = 8
KEY_BITS = 60
#: Probes a round, shared by all borders (at least one each).
PROBE_BUDGET = 1024
#: A group of equal texts up to this share of a shard's bytes is never split.
GROUP_SHARE = 0.05
#: Rows that a cell of the final exchange should hold, and cells per shard at most.
CELL_ROWS, CELLS = 1 << 21, 64
_NO_ID = -(1 << 63)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, key): what the search and the exchange need of a row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"))


def _below(rows: DataFrame, column: str, probes: dict[int, list[int]], only: dict[int, int] | None = None) -> dict:
    """Exact bytes of the rows below each probe: {border: [bytes, ...]}. One
    pass; rows fall into the cells between all borders' probes, cells are
    summed before the shuffle, and the running sums are over cells only."""
    if only is None:
        flat = sorted({p for ps in probes.values() for p in ps})
        cell = _cell_of(F.col(column), flat)
        got = dict(rows.groupBy(cell.alias("cell")).agg(F.sum("size").alias("b")).collect())
        total, upto = 0, {}
        for i, p in enumerate(flat):
            total += got.get(i, 0)
            upto[p] = total
        return {j: [upto[p] for p in ps] for j, ps in probes.items()}
    # each border inside its own key
    out = {}
    by_key: dict[int, list[int]] = {}
    for j, k in only.items():
        by_key.setdefault(k, []).append(j)
    branch = F.lit(None).cast("int")
    flats = {}
    for k, js in by_key.items():
        flats[k] = sorted({p for j in js for p in probes[j]})
        branch = F.when(F.col("key") == k, _cell_of(F.col(column), flats[k])).otherwise(branch)
    got: dict[int, dict[int, int]] = {}
    for r in rows.where(F.col("key").isin(list(by_key))).groupBy("key", branch.alias("cell")).agg(
            F.sum("size").alias("b")).collect():
        got.setdefault(r["key"], {})[r["cell"]] = r["b"]
    for k, js in by_key.items():
        total, upto = 0, {}
        for i, p in enumerate(flats[k]):
            total += got.get(k, {}).get(i, 0)
            upto[p] = total
        for j in js:
            out[j] = [upto[p] for p in probes[j]]
    return out


def _cell_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are <= value: a binary search written
    as a fold over the bits of the answer (no join, no row per bound)."""
    if not bounds:
        return F.lit(0)
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << b for b in reversed(range(len(bounds).bit_length()))]
    # get() is null beyond the end, and null is not <=
    step = lambda at, s: F.when(F.coalesce(F.get(array, at + s - 1) <= value, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _search(rows: DataFrame, column: str, lo: dict[int, int], hi: dict[int, int], base: dict[int, int],
            target: dict[int, int], only: dict[int, int] | None = None) -> tuple[dict, dict]:
    """For each border j the greatest value v in [lo, hi) whose rows begin below
    target: bytes(< v) < target <= bytes(<= v); and bytes(< v)."""
    lo, hi, base = dict(lo), dict(hi), dict(base)
    each = max(2, PROBE_BUDGET // max(1, len(lo)))
    while any(hi[j] - lo[j] > 1 for j in lo):
        probes = {}
        for j in lo:
            width = hi[j] - lo[j]
            probes[j] = sorted({lo[j] + width * i // each for i in range(1, each)} - {lo[j]}) if width > 1 else []
        counted = _below(rows, column, {j: p for j, p in probes.items() if p}, only and {j: only[j] for j in lo if probes[j]})
        for j, counts in counted.items():
            for p, b in zip(probes[j], counts):
                if b < target[j]:
                    lo[j], base[j] = p, b
                else:
                    hi[j] = p
                    break
    return lo, base


def borders(rows: DataFrame, parts: int, whole: float) -> list[tuple[int, int]]:
    """The parts - 1 borders as (key, id): a row belongs to the right side of a
    border if its (key, id) is greater. Groups of at most ``whole`` bytes stay
    whole. ``rows`` is a written table."""
    total = rows.agg(F.sum("size")).first()[0]
    if total is None or parts < 2:
        return []
    # border j sits at the first unit that begins at or after target j = ceil(j * total / parts)
    target = {j: -(-j * total // parts) for j in range(1, parts)}
    zero = {j: 0 for j in target}
    key, before = _search(rows, "key", zero, {j: 1 << KEY_BITS for j in target}, zero, target)
    ids = rows.withColumn("oid", F.coalesce("id", F.lit(_NO_ID)))
    groups = {r["key"]: r for r in ids.where(F.col("key").isin(sorted(set(key.values())))).groupBy("key").agg(
        F.sum("size").alias("b"), F.min("oid").alias("lo"), F.max("oid").alias("hi")).collect()}
    big = {j: k for j, k in key.items() if groups[k]["b"] > whole}
    at, _ = _search(ids, "oid", {j: groups[k]["lo"] for j, k in big.items()}, {j: groups[k]["hi"] + 1 for j, k in big.items()},
                    {j: 0 for j in big}, {j: target[j] - before[j] for j in big}, big)
    return [(key[j], at.get(j, (1 << 63) - 1)) for j in sorted(key)]


def _part_of(bounds: list[tuple[int, int]]) -> Column:
    """How many borders lie strictly below (key, id): by key first, then, among
    the borders of that same key, by id."""
    keys = [k for k, _ in bounds]
    strictly = _cell_of(F.col("key") - 1, keys)           # borders whose key is smaller
    same: dict[int, list[int]] = {}
    for k, i in bounds:
        same.setdefault(k, []).append(i)
    inside = F.lit(0)
    oid = F.coalesce(F.col("id"), F.lit(_NO_ID))
    hits = F.lit(None).cast("array<bigint>")
    for k, ids in same.items():
        inner = sorted(i for i in ids if i < (1 << 63) - 1)
        if inner:
            hits = F.when(F.col("key") == k, F.array(*[F.lit(i).cast("long") for i in inner])).otherwise(hits)
    inside = F.coalesce(F.aggregate(hits, F.lit(0), lambda a, b: a + F.when(b < oid, 1).otherwise(0)), F.lit(0))
    return strictly + inside


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
          group_share: float = GROUP_SHARE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard)."""
    rows = materialise(keyed(docs, id_col, text_col), "shard-keys")
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    cells = max(1, min(CELLS, -(-n // (shards * cell_rows))))
    cuts = borders(rows, shards * cells, group_share * (total or 0) / shards)
    placed = rows.withColumn("cell", _part_of(cuts) if cuts else F.lit(0))
    placed = placed.withColumn("shard", F.floor(F.col("cell") / cells).cast("int"))
    counts = placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("cell", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    order = Window.partitionBy("cell").orderBy("key", "id", "crc", "size")
    # at most shards * CELLS rows
    out = placed.withColumn("rank", F.row_number().over(order)).join(F.broadcast(first), "cell")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))


# 3988292384 is the reflected CRC-32 polynomial
OP8_SQL = f"""
WITH RECURSIVE steps(i, x, k) AS (
  SELECT i, i::BIGINT, 0 FROM range(256) s(i)
  UNION ALL SELECT i, xor(x >> 1, (x & 1) * 3988292384), k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(x ORDER BY i) AS tb FROM steps WHERE k = 8),
r AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + {ROW_OVERHEAD})::BIGINT AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
               regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1])), 4294967295)::BIGINT AS crc,
         ('0x' || substr(md5(coalesce(text, '')), 1, {KEY_BITS // 4}))::BIGINT AS key FROM documents, tab),
g AS (SELECT key, sum(size)::BIGINT AS gsize FROM r GROUP BY key),
u AS (
  SELECT r.*, gsize, sum(size) OVER ()::BIGINT AS total,
         (sum(size) OVER (ORDER BY key, doc_id RANGE UNBOUNDED PRECEDING))::BIGINT
           - (sum(size) OVER (PARTITION BY key, doc_id))::BIGINT AS row_begin,
         (sum(size) OVER (ORDER BY key RANGE UNBOUNDED PRECEDING))::BIGINT - gsize AS group_begin
  FROM r JOIN g USING (key)),
p AS (
  SELECT *, least({SHARDS - 1}, ({SHARDS}::HUGEINT * CASE
    WHEN gsize > {GROUP_SHARE} * total / {SHARDS} THEN row_begin ELSE group_begin END) // total)::INTEGER AS shard FROM u)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM p
"""


@register("op8_sharding", OP8_SQL)
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
