"""Exact n-gram Jaccard join by a token-group matrix.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents
with the same set form a *class*; all work is on classes. Two classes link when
``100 * |intersection| >= 75 * |union|``.

1. One global token order puts tokens that a fixed-size count sketch shows to
   be frequent last. Linked classes share a token among the first quarter of
   both sets (prefix), and the first shared one passes the position test below.
2. Prefix rows are dealt by token; each bucket is streamed in order and every
   member is pointed at its bucket's leader. Verified leader links give
   *groups* of similar classes. No bucket is gathered, no pairs are emitted.
3. Where a token still meets several components, the token-group matrix takes
   over: groups are (component, size band), each stores the union of its token
   sets as a bitmap row. For a query class and a group the overlap with the
   union is bounded from the bitmap; groups whose bound misses the least
   overlap that a link needs are never opened. Members of the others are
   verified exactly.

Components of all verified links are the result: classes are compared until
they are known to be connected, and every link between different components is
found, so no component is lost. Nothing is capped; frequent tokens, big
groups and hot copies only change the order and the split of the work.

Null or empty text, or one without words: empty set, linked with nothing, its
own component. Fewer words than the shingle length: the whole sequence is the
single shingle. Rows are matched by text, so repeated rows and null ids are
harmless (a component of null ids only has a null component_id).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textforge.llm import tokens as W
from textforge.llm.registry import register, table
from textforge.llm.scratch import components, materialise

SHINGLE = 5
PERCENT = 75
#: Count sketch of the token order: text bytes per bin, and its size in bits at
#: least and at most (a task holds 4 bytes a bin). Speed depends on it, results do not.
SKETCH_BYTES, SKETCH_MIN, SKETCH_MAX = 192, 16, 24
_BLOCK_BITS = 16
#: Tokens this many doublings above the mean bin are dealt in 2**excess salted parts.
SALT_LEVEL = 8
#: Bits of the filter that keeps only the sets of classes in question; a fixed
#: bound on what is sent to the tasks. False positives cost time, not results.
FILTER_BITS = 22
#: Members of a component that share a row of the matrix, about.
GROUP = 4
_U = np.uint64


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    data, offsets = W.buffer_of(texts)
    for lo, hi in W.slices(offsets):
        a, b = offsets[lo], offsets[hi]
        h, first = W.words(data[a:b], offsets[lo: hi + 1] - a)
        g = W.grams(h, n)
        for i in range(hi - lo):
            s, e = first[i], first[i + 1]
            if e - s >= n:
                yield np.unique(g[s: e - n + 1])
            elif e > s:
                yield W.grams(h[s:e], int(e - s))
            else:
                yield np.zeros(0, _U)


def _class_of(s: np.ndarray) -> int:
    """A 64-bit hash of a set (as a signed long)."""
    with np.errstate(over="ignore"):
        total = W.mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) + _U(len(s))
    return int(W.mix(np.array([total], _U)).view(np.int64)[0])


def _band(n):
    """Size band: sets in one band are within the factor that a link allows."""
    return np.floor(np.log(n) / np.log(100 / PERCENT)).astype(np.int64)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def sketch_bits(docs: DataFrame, text_col: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return min(SKETCH_MAX, max(SKETCH_MIN, int(size // SKETCH_BYTES).bit_length()))


def classes(docs: DataFrame, bits: int, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, c, block, counts): the class of every row (c is null for
    empty sets; block is null), and after each task's rows its part of the count
    sketch (block is set): one pass over the texts yields both."""
    src = _source(docs, id_col, text_col)
    names = ["id", "n_shingles", "c", "block", "counts"]
    id_field = src.schema["id"]
    blocks = 1 << (bits - _BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, id_type = np.zeros(1 << bits, np.int32), to_arrow_type(id_field.dataType)
        for b in batches:
            size, cls = [], []
            for s in _sets(b.column(1), n):
                size.append(len(s))
                cls.append(_class_of(s) if len(s) else None)
                bins[(s >> _U(64 - bits)).astype(np.int64)] += 1  # tokens of a bin count once a text
            none = [None] * len(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.int64()),
                                              pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        none = [None] * blocks
        packed = [zlib.compress(x.tobytes(), 1) for x in bins.reshape(blocks, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(none, id_type), pa.array(none, pa.int64()), pa.array(none, pa.int64()),
                                          pa.array(range(blocks), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return src.mapInArrow(run, T.StructType([
        id_field, T.StructField("n_shingles", T.LongType()), T.StructField("c", T.LongType()),
        T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType())]))


def token_levels(cls: DataFrame, bits: int) -> np.ndarray:
    """Per sketch bin, how many doublings its count lies above the mean. The
    sketch counts all documents; its size is bounded at any scale."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, block = np.zeros(1 << _BLOCK_BITS, np.int64), 0
        for pdf in batches:
            block = int(pdf["block"].iloc[0])
            for raw in pdf["counts"]:
                total += np.frombuffer(zlib.decompress(raw), np.int32)
        yield pd.DataFrame({"block": np.array([block], np.int32), "counts": [zlib.compress(total.tobytes(), 1)]})

    rows = cls.where("block is not null").select("block", "counts").groupBy("block").applyInPandas(
        add, "block int, counts binary").collect()
    bins = np.zeros((1 << (bits - _BLOCK_BITS), 1 << _BLOCK_BITS), np.int64)
    for r in rows:
        bins[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
    flat = bins.reshape(-1)
    return np.clip(np.floor(np.log2(np.maximum(flat, 1) / (flat.mean() + 4))), 0, 63).astype(np.uint8)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Tokens as keys of the global order: frequency level, then hash."""
    shift = _U(65 - len(levels).bit_length())
    lv = levels[(s >> shift).astype(np.int64)].astype(_U)
    return np.sort((lv << _U(58)) | (s >> _U(6)))


def _prefix_rows(docs: DataFrame, text_col: str, levels: np.ndarray, n: int) -> DataFrame:
    """(tok, salt, band, c, n, pos): the prefix tokens of each class, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv, seen = shared.value, set()
        for b in batches:
            toks, cls, size, pos = [], [], [], []
            held = 0

            def flush() -> pa.RecordBatch:
                lens = [len(t) for t in toks]
                tok = np.concatenate(toks)
                c = np.repeat(np.array(cls, np.int64), lens)
                level = (tok >> _U(58)).astype(np.int64)
                parts = np.left_shift(1, np.maximum(level - SALT_LEVEL, 0))
                return pa.RecordBatch.from_arrays(
                    [pa.array(tok.view(np.int64)), pa.array(((c & 0x7FFFFFFF) % parts).astype(np.int32)),
                     pa.array(np.repeat(_band(np.array(size, float)), lens).astype(np.int32)), pa.array(c),
                     pa.array(np.repeat(np.array(size, np.int32), lens)), pa.array(np.concatenate(pos).astype(np.int32))],
                    names=["tok", "salt", "band", "c", "n", "pos"])

            for s in _sets(b.column(0), n):
                if not len(s) or (c := _class_of(s)) in seen:
                    continue
                seen.add(c)
                keep = len(s) - (-(-PERCENT * len(s) // 100)) + 1
                toks.append(_ordered(s, lv)[:keep])
                cls.append(c)
                size.append(len(s))
                pos.append(np.arange(keep))
                held += keep
                if held >= 1 << 18:
                    yield flush()
                    toks, cls, size, pos, held = [], [], [], [], 0
            if toks:
                yield flush()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(
        run, "tok long, salt int, band int, c long, n int, pos int")


def _shared(rows: DataFrame) -> DataFrame:
    """The prefix rows whose token another class has too, one per class and
    token. The sorted stream is read once; what is held is one batch, however
    long a bucket is. (A salted token is frequent: its rows all stay.)"""
    dealt = rows.repartition("tok", "salt").sortWithinPartitions("tok", "salt", "c")
    names = ["tok", "band", "c", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for its follower; (tok, salt, c) of the row before it, and
        # whether another class stood before that one in its bucket
        held, prev, met = None, None, False

        def judge(x: dict, bucket_goes_on: bool, class_goes_on: bool) -> tuple[pa.RecordBatch, bool]:
            m = len(x["tok"])
            bucket, again = np.empty(m, bool), np.empty(m, bool)
            bucket[1:] = (x["tok"][1:] == x["tok"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            bucket[0] = prev is not None and prev[:2] == (x["tok"][0], x["salt"][0])
            again[1:] = bucket[1:] & (x["c"][1:] == x["c"][:-1])
            again[0] = bucket[0] and prev[2] == x["c"][0]
            begins = lambda same: np.maximum.accumulate(np.where(same, -1, np.arange(m)))
            others = np.where(begins(again) >= 0, begins(again) != begins(bucket), met)
            last = ~np.append(again[1:], class_goes_on)
            follows = np.append(bucket[1:], bucket_goes_on)
            salted = ((x["tok"].view(_U) >> _U(58)).astype(np.int64) > SALT_LEVEL)
            keep = last & (others | follows | salted)
            return pa.RecordBatch.from_arrays([pa.array(x[k][keep]) for k in names], names=names), bool(others[-1])

        for b in batches:
            x = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("tok", "salt", *names[1:])}
            if not len(x["tok"]):
                continue
            if held is not None:
                x = {k: np.concatenate([held[k], x[k]]) for k in x}
            held = {k: v[-1:].copy() for k, v in x.items()}
            x = {k: v[:-1] for k, v in x.items()}
            if len(x["tok"]):
                goes_on = (held["tok"][0], held["salt"][0]) == (x["tok"][-1], x["salt"][-1])
                out, met = judge(x, goes_on, goes_on and held["c"][0] == x["c"][-1])
                prev = (x["tok"][-1], x["salt"][-1], x["c"][-1])
                yield out
        if held is not None:
            yield judge(held, False, False)[0]

    return dealt.mapInArrow(run, "tok long, band int, c long, n int, pos int")


class _Texts:
    """The documents, and which one of them stands for each class."""

    def __init__(self, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int):
        self.src = _source(docs, id_col, text_col).select(F.xxhash64("id").alias("hid"), "text")
        self.reps, self.n = reps, n

    def rows(self, wanted: DataFrame, bitmaps: bool) -> DataFrame:
        """(c, data binary): the token set of each class in ``wanted`` (c), as
        sorted hashes or as its bitmap row. Only documents whose id passes a
        filter of fixed size are tokenised; false positives cost time only."""
        size, n, wanted = 1 << FILTER_BITS, self.n, wanted.select("c").distinct()
        on = wanted.join(self.reps, "c").select(F.pmod("hid", F.lit(size)).cast("int").alias("bit")).distinct()
        bits = np.zeros(size, bool)
        bits[on.toPandas()["bit"].to_numpy(np.int64)] = True  # at most `size` ints, whatever the corpus
        shared = self.src.sparkSession.sparkContext.broadcast(np.packbits(bits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep, seen = np.unpackbits(shared.value).view(bool), set()
            names = ["c", "data"]
            for b in batches:
                hit = np.flatnonzero(keep[b.column(0).to_numpy() % size])
                cls, raw, held = [], [], 0
                for s in _sets(b.column(1).take(pa.array(hit)), n):
                    if not len(s) or (c := _class_of(s)) in seen:
                        continue
                    seen.add(c)
                    cls.append(c)
                    raw.append(_bitmap(s) if bitmaps else s.tobytes())
                    held += len(raw[-1])
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(raw, pa.binary())], names=names)
                        cls, raw, held = [], [], 0
                if cls:
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(raw, pa.binary())], names=names)

        found = self.src.mapInArrow(run, "c long, data binary")
        return found.join(wanted, "c", "left_semi").groupBy("c").agg(F.first("data").alias("data"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of ``pairs`` (a, b)."""
        wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c")))
        return _linked(pairs, self.rows(wanted, False))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets pass the threshold, exactly."""
    side = lambda k, s: sets.select(F.col("c").alias(k), F.col("data").alias(s))
    both = pairs.select("a", "b").join(side("a", "ta"), "a").join(side("b", "tb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            ta, tb = b.column("ta"), b.column("tb")
            for i in range(b.num_rows):
                x, y = (np.frombuffer(v[i].as_buffer(), _U) for v in (ta, tb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(at)), b.column("b").take(pa.array(at))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _need(n1, n2):
    """Least intersection of linked sets of these sizes (columns)."""
    return F.ceil(F.lit(PERCENT) * (n1 + n2) / F.lit(100 + PERCENT))


def _least(n):
    """Least size of a set that links with one of size n (column)."""
    return F.ceil(F.lit(PERCENT) * n / F.lit(100))


def _slack(n1, n2):
    """A least number of shared prefix tokens: tokens beyond the prefixes that
    two sets of these sizes can share at most do not reach a link without them."""
    rest = _least(F.greatest(n1, n2)) - 1
    return _need(n1, n2) - rest - 2


def _bitmap(s: np.ndarray) -> bytes:
    """A matrix row: 8 to 16 bits per token, a power of two in size."""
    m = 64 << max(0, int(len(s) * 8 - 1).bit_length() - 6)
    row = np.zeros(m, bool)
    row[(s & _U(m - 1)).astype(np.int64)] = True
    return np.packbits(row, bitorder="little").tobytes()


def _folded(row: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (bytes) folded to ``size`` bytes: still holds every token."""
    return np.bitwise_or.reduce(row.reshape(-1, size), axis=0) if len(row) > size else row


def _unions(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(g, part, band, bits): the token-group matrix, a bitmap row per group, as wide
    as its narrowest member's; folded per task first, so that a group of any
    size meets as a few bitmaps."""
    def unite(a: np.ndarray | None, raw: bytes) -> np.ndarray:
        b = np.frombuffer(raw, np.uint8)
        if a is None:
            return b
        size = min(len(a), len(b))
        return _folded(a, size) | _folded(b, size)

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for pdf in batches:
            for *key, raw in zip(pdf["g"], pdf["part"], pdf["band"], pdf["data"]):
                held[tuple(key)] = unite(held.get(tuple(key)), raw)
            if sum(map(len, held.values())) >= 64 << 20:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held) -> pd.DataFrame:
        keys = np.array(list(held), np.int64)
        return pd.DataFrame({"g": keys[:, 0], "part": keys[:, 1], "band": keys[:, 2].astype(np.int32),
                             "bits": [v.tobytes() for v in held.values()]})

    def per_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, key = None, ()
        for pdf in batches:
            key = tuple(int(pdf[k].iloc[0]) for k in ("g", "part", "band"))
            for raw in pdf["bits"]:
                total = unite(total, raw)
        yield out({key: total})

    schema = "g long, part long, band int, bits binary"
    return members.join(rows, "c").select("g", "part", "band", "data").mapInPandas(per_task, schema).groupBy(
        "g", "part", "band").applyInPandas(per_group, schema)


def _qualifying(cands: DataFrame, rows: DataFrame, unions: DataFrame) -> DataFrame:
    """Candidates (c, n, g, part, band, bound) whose overlap with the group's union can reach
    ``need``: common bits, plus what collisions inside the query may hide."""
    names = ["c", "n", "g", "part", "band"]
    both = cands.join(rows, "c").join(unions, ["g", "part", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bound = np.zeros(b.num_rows, np.int64)
            mine, union = b.column("data"), b.column("bits")
            n, need = b.column("n").to_numpy(), b.column("need").to_numpy()
            for i in range(b.num_rows):
                x, y = (np.frombuffer(v[i].as_buffer(), np.uint8) for v in (mine, union))
                size = min(len(x), len(y))
                x, y = _folded(x, size), _folded(y, size)
                hidden = n[i] - np.bitwise_count(x).sum(dtype=np.int64)
                bound[i] = np.bitwise_count(x & y).sum(dtype=np.int64) + hidden
            at = np.flatnonzero(bound >= need)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in names), pa.array(bound[at])],
                                             names=[*names, "bound"])

    return both.select(*names, "need", "data", "bits").mapInArrow(
        run, "c long, n int, g long, part long, band int, bound long")


def links(docs: DataFrame, levels: np.ndarray, texts: _Texts, text_col: str) -> DataFrame:
    """Verified links (a, b) between classes: enough of them to connect every
    pair of classes that the threshold connects."""
    rows = materialise(_shared(_prefix_rows(docs, text_col, levels, texts.n)), "prefix-buckets")

    # leaders: of a bucket's classes the one with the least share of tokens of its own (the
    # text that the others were copied from); a class follows the leader of most of its buckets
    own_share = rows.groupBy("c").agg((F.count(F.lit(1)) / F.max("n")).alias("shared"))
    rank = F.struct("shared", F.col("c").alias("leader"), F.col("n").alias("leader_n"))
    ranked = rows.join(own_share, "c").select("tok", "c", "n", rank.alias("r"))
    heads = ranked.groupBy("tok").agg(F.max("r").alias("r")).select("tok", "r.leader", "r.leader_n")
    votes = ranked.select("tok", "c", "n").join(heads, "tok").where("leader <> c").groupBy(
        "c", "leader", "n", "leader_n").agg(F.count(F.lit(1)).alias("k"))
    # only a choice of pairs to try first: half of the class's prefix, and sizes that can link
    likely = (F.col("k") * 8 >= F.col("n")) & (
        F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * PERCENT)
    star = votes.where(likely).groupBy(F.col("c").alias("a")).agg(
        F.max_by("leader", F.struct("k", "leader")).alias("b"))
    first = materialise(texts.verified(materialise(star, "leader-pairs")), "leader-links")
    comp = components(first)

    # tokens that still meet several components
    own = rows.join(comp.select(F.col("node").alias("c"), F.col("label").alias("g")), "c", "left").select(
        "tok", "band", "c", "n", "pos", F.coalesce("g", "c").alias("g"))
    own = materialise(own, "labelled-buckets")
    mixed = own.groupBy("tok").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("tok")
    own = own.join(mixed, "tok", "left_semi")
    # groups: about GROUP members of a component each
    place = own.groupBy("c", "n", "band", "g").agg(F.min("pos").alias("deep"))
    sizes = place.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    weight = F.struct(F.col("k"), F.col("g"))
    place = place.join(sizes, "g").select(
        "c", "n", "band", "g", "deep", weight.alias("w"), F.pmod(F.xxhash64("c"), F.ceil(F.col("k") / GROUP)).alias("part"))
    place = materialise(place, "group-members")
    own = materialise(own.select("tok", "c", "pos").join(place.drop("part"), "c"), "mixed-buckets")
    gid = ["g", "part", "band"]
    whole = own.groupBy("tok", "g", "band", F.col("w").alias("g_w")).agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("pos").alias("g_pos"),
        F.max(F.col("n") - F.col("deep")).alias("g_left")).select(
        "tok", F.col("g").alias("g2"), F.col("band").alias("band2"), "g_w", "n_lo", "n_hi", "g_pos", "g_left")
    # the lighter side asks, of a component's size band first; a link's first
    # shared token leaves enough tokens after it on both sides
    n_q, low = F.col("n"), F.greatest(F.col("n_lo"), _least(F.col("n")))
    need = _need(n_q, low)
    fits = (F.col("n_hi") >= _least(n_q)) & (_least(F.col("n_lo")) <= n_q)
    # neither side may have more tokens of its own before its first shared one than a link leaves room for
    room = (n_q - F.col("deep") >= need) & (F.col("g_left") >= need)
    met = own.join(whole, "tok").where((F.col("g") != F.col("g2")) & (F.col("w") < F.col("g_w")) & fits & room)
    first_shared = (n_q - F.col("pos") >= need) & (F.col("n_hi") - F.col("g_pos") >= need)
    cands = met.groupBy("c", "n", F.col("g2").alias("g"), F.col("band2").alias("band")).agg(
        F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"),
        F.count(F.lit(1)).alias("k"), F.max(first_shared).alias("possible"))
    # the least number of shared prefix tokens, at the ends of the group's sizes (it is concave between)
    high = F.least(F.col("n_hi"), F.floor(F.lit(100) * n_q / F.lit(PERCENT)))
    cands = cands.where(F.col("possible") & (F.col("k") >= F.least(
        _slack(n_q, F.greatest(F.col("n_lo"), _least(n_q))), _slack(n_q, high))))
    # then of its groups, the rows of the matrix
    rows_of = place.groupBy(*gid).agg(F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    cands = cands.select("c", "n", "g", "band").join(rows_of, ["g", "band"]).where(fits)
    cands = materialise(cands.select("c", "n", *gid, need.alias("need")), "group-candidates")

    members = place.select("c", *gid, F.col("n").alias("n_s")).join(cands.select(*gid).distinct(), gid, "left_semi")
    members = materialise(members, "opened-members")
    bitmaps = materialise(texts.rows(cands.select("c").union(members.select("c")), True), "group-rows")
    opened = materialise(_qualifying(cands, bitmaps, _unions(members, bitmaps)), "opened-groups")

    def against(asked: DataFrame) -> DataFrame:
        pairs = asked.join(members.withColumnRenamed("c", "b"), gid).where(
            F.least("n", "n_s") * 100 >= F.greatest("n", "n_s") * PERCENT).select(F.col("c").alias("a"), "b")
        return materialise(texts.verified(materialise(pairs, "opened-pairs")), "group-links")

    # of a component's open groups the one with the highest bound; then all of
    # those whose component the query is still apart from
    best = opened.groupBy("c", "n", "g").agg(F.max_by(F.struct("part", "band"), F.struct("bound", "part", "band")).alias("x"))
    second = first.union(against(best.select("c", "n", "g", "x.part", "x.band")))
    now = components(second)
    label = lambda k, name: now.select(F.col("node").alias(k), F.col("label").alias(name))
    apart = opened.join(label("c", "l_c"), "c", "left").join(label("g", "l_g"), "g", "left").where(
        F.coalesce("l_c", "c") != F.coalesce("l_g", "g")).select("c", "n", *gid)
    return materialise(second.union(against(apart)), "links")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``."""
    bits = sketch_bits(docs, text_col)
    scan = materialise(classes(docs, bits, id_col, text_col, n), "classes")
    cls = scan.where("block is null").select("id", "n_shingles", "c")
    reps = cls.where("c is not null").groupBy("c").agg(F.min("id").alias("rep"), F.min(F.xxhash64("id")).alias("hid"))
    reps = materialise(reps, "class-reps")
    texts = _Texts(docs, reps.select("c", "hid"), id_col, text_col, n)
    label = components(links(docs, token_levels(scan, bits), texts, text_col))
    labelled = reps.join(label, reps["c"] == label["node"], "left").select(
        "c", F.coalesce("label", "c").alias("g"), "rep")
    least = labelled.groupBy("g").agg(F.min("rep").alias("component_id"))
    by_class = labelled.join(least, "g").select("c", "component_id")
    out = cls.join(by_class, "c", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles",
                      F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
      ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: list_slice(ws, i, i + 4)) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents
  UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.a = d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


@register("op6_ngram_jaccard", OP6_SQL)
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, the one of the least id (a row
    without an id only where all are); rows of an empty set stay. Rows are told
    apart by a number of their own, so null and repeated ids get a verdict per row."""
    keyed = materialise(docs.withColumn("_tf_row", F.monotonically_increasing_id()), "numbered-documents")
    found = join_components(keyed, "_tf_row", text_col).select("_tf_row", F.col("component_id").alias("_tf_group"))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("_tf_row").alias("r"))
    least = found.join(keyed.select("_tf_row", F.col(id_col)), "_tf_row").groupBy("_tf_group").agg(F.min(order).alias("x"))
    kept = keyed.join(least.select(F.col("x.r").alias("_tf_row")), "_tf_row", "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
