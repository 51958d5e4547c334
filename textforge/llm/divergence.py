"""Source divergence audit by one-hot level products.

Each (lang, source) group gives every kept term of its lang a count; the value
a group lends to a term depends on that count alone, its *level*. An indicator
matrix has one row per (group, level) and one column per term: a row is one
where the group's count of the term is that level. The matrix times its
transpose holds the joint table of every two groups, that is, how many terms
have level c in one group and level d in the other. Every cell of a joint table
has one price, |p(c) - p(d)|, so the distance of two groups is their joint
table summed at those prices, in whole numbers.

Products are exact and blocked: terms of like frequency (hence few levels) and
at most about BLOCK of them make a block, groups go in tiles of TILE, and one
task multiplies one block for one pair of tiles. Joint tables of blocks add up,
and so do their prices, so only (group, group, value) leaves a task. No task
gathers a group, a source or a lang.

Null text, lang and source read as ''. A group without terms has level 0
everywhere; a lang without kept terms gives pairs of value 0 and no term rows.
Repeated rows and ids count each time; an empty table gives an empty result.
Words are matched inside a batch by 64-bit hashes and by their text everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm.registry import register, table
from textforge.llm.runs import grouped, run_bounds, strings
from textforge.llm.scratch import materialise
from textforge.llm.tokens import buffer_of, hash_words, mix, slices

MIN_DOCS = 30
PRIOR, UNIT = 5, 1_000_000_000
TOP = 50
#: Rows of a side table (one a group, or one a lang and octave) that may be broadcast.
SMALL = 1 << 16
#: Terms of a block and groups of a tile: what one product holds.
BLOCK, TILE = 256, 32
#: Rows of the left matrix multiplied at once, and bytes of text counted at once.
ROWS, SLICE = 512, 8 << 20

#: Bytes of a term: ASCII letters and every byte of a character beyond ASCII.
_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
_U = np.uint64
_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("docs", pa.int64())])
    for batch in batches:
        lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
        width = max(1, len(source.dictionary))
        code = (lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * width
                + source.indices.to_numpy(zero_copy_only=False))
        data, offsets = buffer_of(batch.column(2))

        def rows(codes: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(codes // width)), source.dictionary.take(pa.array(codes % width)), terms,
                 pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=schema)

        seen = np.unique(code)      # every group that occurs, as a row of the empty term
        none = np.zeros(len(seen), np.int64)
        yield rows(seen, pa.array([""] * len(seen)), none, none)
        for lo, hi in slices(offsets, SLICE):
            a, b = offsets[lo], offsets[hi]
            part = data[a:b]
            starts, ends, doc = run_bounds(_TERM[part], offsets[lo: hi + 1] - a)
            if not len(starts):
                continue
            group = code[lo:hi][doc]
            with np.errstate(over="ignore"):
                key = mix(hash_words(part, starts, ends) + group.astype(_U) * _U(0xD6E8FEB86659FD93))
            order, heads = grouped(key)     # stable: the tokens of a key stay in document order
            d = doc[order]
            new = np.ones(len(d), np.int64)
            new[1:] = d[1:] != d[:-1]
            new[heads] = 1
            first = order[heads]
            yield rows(group[first], strings(part, starts[first], ends[first]),
                       np.diff(np.append(heads, len(order))), np.add.reduceat(new, heads))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in
    every group; each group also has one row of the empty term."""
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return read.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _price(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)), in whole numbers of any size."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + F.lit(PRIOR)).cast("decimal(20,0)")
    return F.call_function("div", above, (total + F.lit(PRIOR) * terms).cast("decimal(20,0)")) + F.lit(1)


def _small(df: DataFrame) -> DataFrame:
    """A written table, sent to every task if it has at most SMALL rows; a larger
    one is left to a shuffled join, whose hot keys Spark splits."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


class Audit:
    """The tables of an audit over ``counts`` (see ``term_counts``), each written once.

    kept: (lang, term, total, block), the terms in at least ``min_docs`` documents of a lang.
    cells: (lang, source, term, n, total, block), what a group has of its lang's kept terms.
    groups: (lang, source, g, last, total, terms, every), every group with its number
    in the lang and the lang's last one, its occurrences of kept terms, and how many
    kept terms and occurrences of them the lang has.
    """

    def __init__(self, counts: DataFrame, min_docs: int = MIN_DOCS, block: int = BLOCK, tile: int = TILE):
        self.tile = tile
        counts = materialise(counts, "term-counts")
        real = counts.where("term <> ''")
        kept = real.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(
            F.col("docs") >= min_docs).select("lang", "term", "total", F.floor(F.log2("total")).cast("int").alias("octave"))
        kept = materialise(kept, "kept-terms")
        parts = kept.groupBy("lang", "octave").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
        self.kept = kept.join(_small(materialise(parts, "term-octaves")), ["lang", "octave"]).select(
            "lang", "term", "total",
            F.struct("octave", F.pmod(F.xxhash64("term"), "parts").alias("part")).alias("block"))
        self.cells = materialise(real.select("lang", "source", "term", "n").join(self.kept, ["lang", "term"]), "term-cells")
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("every"))
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        last = F.count(F.lit(1)).over(Window.partitionBy("lang")).cast("int") - 1
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        self.groups = materialise(
            counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
            .select("lang", "source", number.alias("g"), last.alias("last"), zero("total"), zero("terms"), zero("every")), "term-groups")
        self.priced = self.cells.join(_small(self.groups.withColumnRenamed("total", "of")), ["lang", "source"])

    def pairs(self) -> DataFrame:
        """(lang, a, b, value): the distance of groups number a < b of a lang, the
        price of their joint tables summed over all blocks."""
        blocks = self.kept.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("n_terms"))
        empty = self.groups.where("terms = 0").select(
            "lang", F.struct(F.lit(-1).alias("octave"), F.lit(0).cast("long").alias("part")).alias("block"),
            F.lit(0).cast("long").alias("n_terms")).distinct()
        level0 = F.when(F.col("terms") > 0, _price(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(0))
        # a row without a term says which groups a block has and what their level 0 lends
        heads = self.groups.join(blocks.union(empty), "lang").select(
            "lang", "block", "g", "last", F.lit(None).cast("string").alias("term"), F.col("n_terms").alias("n"),
            level0.cast("long").alias("p"))
        rows = self.priced.select("lang", "block", "g", "last", "term", "n", _price(F.col("n"), F.col("of"), F.col("terms")).alias("p"))
        at = lambda g: F.floor(F.col(g) / self.tile).cast("int")
        own = at("g")
        dealt = heads.union(rows).withColumn("other", F.explode(F.sequence(F.lit(0), at("last")))).select(
            "lang", "block", F.least(own, "other").alias("ti"), F.greatest(own, "other").alias("tj"), "g", "term", "n", "p")
        tile = self.tile
        priced = dealt.groupBy("lang", "block", "ti", "tj").applyInPandas(
            lambda key, rows: _priced(key, rows, tile), "lang string, a int, b int, value long")
        return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def distances(self) -> DataFrame:
        """(lang, source, item, value) for every group and each other source of its lang."""
        found = self.pairs()
        both = found.union(found.select("lang", "b", "a", "value"))
        name = lambda g, c: self.groups.select("lang", F.col("g").alias(g), F.col("source").alias(c))
        return both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select(
            "lang", "source", "item", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): the terms a group has and lends more than its lang does."""
        value = (_price(F.col("n"), F.col("of"), F.col("terms"))
                 - _price(F.col("total"), F.col("every"), F.col("terms")))
        return self.priced.select("lang", "source", F.col("term").alias("item"), value.alias("value")).where("value > 0")


def level_rows(group: np.ndarray, column: np.ndarray, n: np.ndarray, p: np.ndarray, heads: dict[int, int],
               columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, group of each row, price of each row): one row per (group, level)
    that occurs, level 0 included, and one column per term of the block."""
    order = np.lexsort((n, group))
    g, c = group[order], n[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    names = np.array(sorted(heads), np.int64)
    base = len(names)
    matrix = np.zeros((base + int(new.sum()), columns), np.float32)
    matrix[base + np.cumsum(new) - 1, column[order]] = 1
    at = np.searchsorted(names, group)
    matrix[:base] = 1
    matrix[at, column] = 0          # level 0: the terms that the group does not have
    return (matrix, np.concatenate([names, g[new]]),
            np.concatenate([np.array([heads[int(x)] for x in names], np.int64), p[order][new]]))


def joint_tables(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left row, right row, terms) of the cells of left * right' that are not
    zero, some ROWS of ``left`` at a time; whole numbers below 2**24, so exact."""
    for lo in range(0, len(left), ROWS):
        product = left[lo: lo + ROWS] @ right.T
        i, j = np.nonzero(product)
        yield i + lo, j, product[i, j].astype(np.int64)


def _priced(key: tuple, rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    lang, _, ti, tj = key
    is_head = rows["term"].isna().to_numpy()
    heads, body = rows[is_head], rows[~is_head]
    level0 = dict(zip(heads["g"].tolist(), heads["p"].tolist()))
    n_terms = int(heads["n"].iloc[0])
    column, known = pd.factorize(body["term"])
    # the block's terms that none of these groups has are columns of level 0 alone
    m, gs, ps = level_rows(body["g"].to_numpy(np.int64), column, body["n"].to_numpy(np.int64), body["p"].to_numpy(np.int64),
                           level0, n_terms)
    on = gs // tile
    li, ri = np.flatnonzero(on == ti), np.flatnonzero(on == tj)
    names = np.array(sorted(level0), np.int64)
    width = len(names)
    sums = np.zeros(width * width, np.int64)
    for i, j, terms in joint_tables(m[li], m[ri]):
        i, j = li[i], ri[j]
        up = gs[i] < gs[j]
        i, j, terms = i[up], j[up], terms[up]
        at = np.searchsorted(names, gs[i]) * width + np.searchsorted(names, gs[j])
        np.add.at(sums, at, terms * np.abs(ps[i] - ps[j]))
    a, b = np.divmod(np.arange(width * width), width)
    mine = (names[a] < names[b]) & (names[a] // tile == ti) & (names[b] // tile == tj)
    return pd.DataFrame({"lang": lang, "a": names[a[mine]], "b": names[b[mine]], "value": sums[mine]})


def ranked(audit: Audit, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distances in full, terms to rank ``top``."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = audit.distances().withColumn("rank", rank).withColumn("part", F.lit("pair"))
    term = audit.terms().withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(cols).union(term.select(cols))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
cell AS (SELECT tok.lang, source, tok.term, count(*)::HUGEINT AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS nl FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(max(v), 0)::HUGEINT AS v, max(nl) AS nl, coalesce(sum(n), 0)::HUGEINT AS ng
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN cell USING (lang, source) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n,
             1 + ({UNIT}::HUGEINT * (coalesce(n, 0) + {PRIOR})) // (ng + {PRIOR} * v) AS p,
             1 + ({UNIT}::HUGEINT * (kept.total + {PRIOR})) // (nl + {PRIOR} * v) AS q
      FROM g JOIN kept ON kept.lang = g.lang
      LEFT JOIN cell ON cell.lang = g.lang AND cell.source = g.source AND cell.term = kept.term),
dist AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
         FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN dist ON dist.lang = a.lang AND dist.source = a.source AND dist.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
WHERE part = 'pair' OR rank <= {TOP}
"""


@register("op11_source_divergence", OP11_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(Audit(term_counts(table(spark, sf_dir, "documents"))))
