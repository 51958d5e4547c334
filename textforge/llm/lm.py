"""Scoring texts with a log-bilinear neural language model.

Tokens are words (ASCII capitals lowered) and one end per text. The model
predicts a token's *class* from the CONTEXT classes before it: the most
frequent training tokens and the end are classes of their own, every other token
is in one of the rare classes by its ending. The context vector is the sum of
position-weighted class embeddings, a class's score is its inner product with
the context vector plus a bias. The number of classes grows with the square root
of the counted training vocabulary (``class_counts``; FREQUENT and RARE are its
least values), so what context learns about words follows the corpus. Beyond the
least numbers classes lie in groups (``_groups``): the context predicts the
group, then the class in it, each by a softmax of its own. Inside a rare class tokens follow their smoothed
training counts. So every token, seen or not, has a normalised probability:

    P(token | context) = P(group | context) * P(class | group, context) * P(token | class)

Training is noise-contrastive estimation in numpy: every task trains on its part
of all training texts, in ROUNDS passes over disjoint parts, and the tasks'
parameters are averaged after each. The biases start at the class frequencies.

Counts. Texts are cut into chunks of bounded size, each with its own vocabulary
and the texts as indices into it. A chunk's distinct tokens, not its text, go to
the count by token and come back with the corpus-wide count; what moves grows
with the corpus and no vocabulary is ever broadcast or held whole.

Null or empty text: the end alone. Repeated rows are scored each; a null id's
remainder is that of an empty text. Without training texts every count is zero.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.llm import tokens as W
from textforge.llm.registry import register, table
from textforge.llm.scratch import materialise
from textforge.llm.toxicity import fold

#: Least numbers of frequent and rare classes, and frequent classes per root of the vocabulary.
FREQUENT, RARE, PER_ROOT = 96, 48, 2
CONTEXT, DIM = 3, 16
NOISE, NOISE_IN, BATCH, ROUNDS, RATE = 32, 4, 1024, 3, 0.1
FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
#: Bytes of text per chunk: bounds what a task holds and what a chunk asks for.
CHUNK_BYTES = 12 << 20
#: Tokens whose contexts are held at once (whole texts, at least one).
SLICE_TOKENS = 1 << 18
#: Entries of the table that a draw of noise starts from.
GUIDE = 1 << 14
_U = np.uint64
_END = np.uint64(0x8000000000000001)
#: Bytes of scores held at once.
SCORE_BYTES = 8 << 20


def class_counts(vocabulary: int) -> tuple[int, int]:
    """(frequent, rare) classes for so many distinct training tokens."""
    frequent = max(FREQUENT, PER_ROOT * math.isqrt(vocabulary))
    return frequent, frequent * RARE // FREQUENT


def _groups(n: int) -> np.ndarray:
    """First class of each group of n classes: the FREQUENT first and the end are
    groups of their own, the others are cut into RARE or root-of-n ranges."""
    middle, g = n - 1 - FREQUENT, max(RARE, math.isqrt(n))
    return np.concatenate([np.arange(FREQUENT), FREQUENT + np.arange(g) * middle // g, [n - 1]])


def _sizes(n: int) -> tuple[tuple[int, ...], ...]:
    """Shapes of the parameters of n classes (position weights, embeddings,
    outputs and biases of groups, then of classes); the last class is the end,
    embedding n stands before a text's first token."""
    g = len(_groups(n))
    return (CONTEXT, DIM), (n + 1, DIM), (g, DIM), (g,), (n, DIM), (n,)


def _total(n: int) -> int:
    return sum(math.prod(x) for x in _sizes(n))


N_CLASSES = FREQUENT + RARE + 1      # the least number
_SIZES = _sizes(N_CLASSES)


def _endings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word."""
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint16)
    return data[ends - 1].astype(np.uint16) << np.uint16(8) | before


def _rare(ending: np.ndarray, n_rare: int) -> np.ndarray:
    """The rare class of each ending."""
    return (W.mix(ending.astype(_U) + _U(1)) % _U(n_rare)).astype(np.int64)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, ids, held_out, lengths, seq, vocab, ending, trained): texts as
    indices into their chunk's sorted token hashes, with the ending and the
    training count of each."""
    src = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out"),
                      F.col(text_col).cast("string").alias("text"))
    names = ["chunk", "ids", "held_out", "lengths", "seq", "vocab", "ending", "trained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 24
        for b in batches:
            held = b.column(1).to_numpy(zero_copy_only=False)
            data, offsets = W.buffer_of(b.column(2))
            for lo, hi in W.slices(offsets, CHUNK_BYTES):
                a, n = offsets[lo], hi - lo
                raw, off = data[a: offsets[hi]], offsets[lo: hi + 1] - a
                starts, ends = W.word_bounds(raw, off)
                first = np.searchsorted(starts, off, "left")
                tokens = np.full(len(starts) + n, _END)
                ending = np.zeros(len(starts) + n, np.uint16)
                at = np.arange(len(starts))
                at += np.repeat(np.arange(n), np.diff(first))            # each text's end follows its words
                tokens[at] = W.hash_words(raw, starts, ends)
                ending[at] = _endings(raw, starts, ends)
                del at, starts, ends        # the sort below needs as much again
                vocab, where, seq = np.unique(tokens, return_index=True, return_inverse=True)
                lengths = np.diff(first) + 1
                train = np.repeat(~held[lo:hi], lengths)
                trained = np.bincount(seq[train], minlength=len(vocab))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(0).slice(lo, n)),
                     *(pa.array([_packed(x)], pa.binary()) for x in (
                         held[lo:hi], lengths.astype("<i4"), seq.astype("<i4"))),
                     pa.array([vocab.tobytes()], pa.binary()),
                     *(pa.array([_packed(x)], pa.binary()) for x in (ending[where].astype("<u2"), trained.astype("<i4")))],
                    names=names)
                chunk += 1

    fields = [T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(src.schema["id"].dataType))]
    return src.mapInArrow(run, T.StructType(fields + [T.StructField(k, T.BinaryType()) for k in names[2:]]))


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(raw, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def counted(chunks: DataFrame) -> DataFrame:
    """(chunk, i, c, ending, lead, h): the corpus-wide training count of each
    chunk's i-th token; ``lead`` marks one row per token. A token meets itself
    once per chunk, so no token is hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                vocab = np.frombuffer(b.column(1)[i].as_py(), np.int64)
                ending, trained = _unpack(b.column(2)[i].as_py(), "<u2"), _unpack(b.column(3)[i].as_py(), "<i4")
                for s in range(0, len(vocab), 1 << 16):
                    e = min(len(vocab), s + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(vocab[s:e]), pa.array(np.full(e - s, b.column(0)[i].as_py(), np.int64)),
                         pa.array(np.arange(s, e, dtype=np.int32)), pa.array(ending[s:e].astype(np.int32)),
                         pa.array(trained[s:e])], names=["h", "chunk", "i", "ending", "k"])

    rows = chunks.select("chunk", "vocab", "ending", "trained").mapInArrow(
        run, "h long, chunk long, i int, ending int, k int")
    of = Window.partitionBy("h")
    return rows.select("chunk", "i", "ending", "h", F.sum("k").over(of).alias("c"),
                       (F.min("chunk").over(of) == F.col("chunk")).alias("lead"))


# --- the model ------------------------------------------------------------------

def _split(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in _sizes(bisect.bisect_left(range(len(flat)), len(flat), N_CLASSES, key=_total)):
        n = int(np.prod(shape))
        out.append(flat[at: at + n].reshape(shape))
        at += n
    return out


def initial(frequencies: np.ndarray) -> np.ndarray:
    """Parameters whose softmax is the class frequencies."""
    rng = np.random.default_rng(7)
    sizes = _sizes(len(frequencies))
    starts = _groups(len(frequencies))
    of_group = np.add.reduceat(frequencies, starts)
    inside = frequencies / np.repeat(of_group, np.diff(starts, append=len(frequencies)))
    parts = [np.ones(sizes[0]), *(rng.normal(0, 0.1, sizes[k]) for k in (1, 2)), np.log(of_group),
             rng.normal(0, 0.1, sizes[4]), np.log(inside)]
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def _contexts(classes: np.ndarray, lengths: np.ndarray, n_classes: int) -> np.ndarray:
    """The CONTEXT classes before each token, nearest first; before a text's
    first token stands ``n_classes``."""
    out = np.full((len(classes), CONTEXT), n_classes, np.int32)
    first = np.cumsum(lengths) - lengths
    for j in range(CONTEXT):
        out[j + 1:, j] = classes[: max(0, len(classes) - j - 1)]
        for k in range(j + 1):          # the first words of a text have no word so far before them
            out[first[lengths > k] + k, j] = n_classes
    return out


def _slices(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts of about SLICE_TOKENS tokens, and their token ranges."""
    ends = np.cumsum(lengths)
    lo = at = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, at + SLICE_TOKENS, "right")))
        yield lo, hi, at, int(ends[hi - 1])
        lo, at = hi, int(ends[hi - 1])


def train_pass(flat: np.ndarray, squares: np.ndarray, classes: np.ndarray, contexts: np.ndarray, noise_p: np.ndarray,
               seed: int) -> None:
    """One pass of noise-contrastive estimation with Adagrad, in place. A batch
    touches only the rows of its own classes, so its cost does not depend on
    their number."""
    rng = np.random.default_rng(seed)
    where, emb, out, bias, out_in, bias_in = _split(flat)
    s_where, s_emb, s_out, s_bias, s_out_in, s_bias_in = _split(squares)
    starts = _groups(len(noise_p))
    size = np.diff(starts, append=len(noise_p))
    group_of = np.repeat(np.arange(len(starts)), size)
    group_p = np.add.reduceat(noise_p, starts)
    log_kp = np.log(NOISE * group_p).astype(np.float32)
    log_kp_in = np.log(NOISE_IN * noise_p / group_p[group_of]).astype(np.float32)
    cumulated = np.cumsum(group_p)
    cumulated /= cumulated[-1]
    below = np.concatenate([[0], np.cumsum(noise_p)])
    order = rng.permutation(len(classes))
    # where a search of ``below`` may begin, by leading digits of the number searched
    guide = np.maximum(np.searchsorted(below, np.arange(GUIDE + 1) / GUIDE * below[-1], "right") - 2, 0)
    small = np.uint16 if len(emb) < 1 << 16 else np.uint32      # sixteen bits are sorted by radix
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def draw(u: np.ndarray) -> np.ndarray:
        """The class whose part of ``below`` holds each number."""
        at = guide.take((u * (GUIDE / below[-1])).astype(np.int64))
        while True:
            on = below.take(np.minimum(at + 1, len(below) - 1)) <= u
            on &= at < len(below) - 1
            if not on.any():
                return at
            at += on

    def summed(index: np.ndarray, values: np.ndarray, scalars: np.ndarray | None = None) -> tuple:
        """Rows that occur in ``index``, the sum of each one's ``values`` and of its
        ``scalars``: one sort, then sums of neighbours (two single numbers as one complex)."""
        key = index.astype(small)
        at = np.argsort(key, kind="stable")
        key = key[at]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(values.take(at, 0).view(np.complex64), head, axis=0).view(np.float32)
        return key[head].astype(np.int64), total, None if scalars is None else np.add.reduceat(scalars.take(at), head)

    def step(param, square, grad, rows):
        s = square.take(rows, 0)
        s += grad * grad
        square[rows] = s
        np.sqrt(s, out=s)
        s += np.float32(1e-6)
        grad *= np.float32(-RATE)
        grad /= s
        grad += param.take(rows, 0)
        param[rows] = grad

    for s in range(0, len(order), BATCH):
        at = order[s: s + BATCH]
        w, ctx = classes[at], contexts.take(at, 0).ravel()
        near = emb.take(ctx, 0).reshape(len(at), CONTEXT, DIM)    # batch, position, dim
        v = np.einsum("bjd,jd->bd", near, where)
        share = np.float32(1 / len(at))
        # the group, against noise that the batch shares
        group = group_of[w]
        noise = np.searchsorted(cumulated, rng.random(NOISE), "right")
        out_g, out_n = out.take(group, 0), out.take(noise, 0)
        g_data = (sigmoid(np.einsum("bd,bd->b", v, out_g) + bias[group] - log_kp[group]) - 1) * share
        g_noise = sigmoid(v @ out_n.T + (bias[noise] - log_kp[noise])) * share
        g_v = g_data[:, None] * out_g + g_noise @ out_n
        o_rows, g_out, g_bias = summed(np.concatenate([group, noise]), np.concatenate([g_data[:, None] * v, g_noise.T @ v]),
                                       np.concatenate([g_data, g_noise.sum(0)]))
        # the class inside a group of several, against noise from that group
        many = np.flatnonzero(size[group] > 1)
        if len(many):
            of = group[many]
            first, stop = starts[of], starts[of] + size[of]
            u = below[first, None] + rng.random((len(many), NOISE_IN)) * (below[stop] - below[first])[:, None]
            drawn = np.clip(draw(u), first[:, None], stop[:, None] - 1)
            which = np.concatenate([w[many, None], drawn], 1)     # the token's class, then noise
            flat_in, v_in = which.ravel(), v.take(many, 0)
            rows_in = out_in.take(flat_in, 0).reshape(len(many), 1 + NOISE_IN, DIM)
            g_in = sigmoid(np.einsum("bkd,bd->bk", rows_in, v_in) + bias_in.take(which) - log_kp_in.take(which))
            g_in[:, 0] -= 1
            g_in *= share
            g_v[many] += np.einsum("bk,bkd->bd", g_in, rows_in)
            i_rows, g_out_in, g_bias_in = summed(flat_in, np.einsum("bk,bd->bkd", g_in, v_in).reshape(-1, DIM), g_in.ravel())
            step(out_in, s_out_in, g_out_in, i_rows)
            step(bias_in, s_bias_in, g_bias_in, i_rows)
        g_where = np.einsum("bd,bjd->jd", g_v, near)
        e_rows, g_emb, _ = summed(ctx, np.einsum("bd,jd->bjd", g_v, where).reshape(-1, DIM))
        step(out, s_out, g_out, o_rows)
        step(bias, s_bias, g_bias, o_rows)
        step(emb, s_emb, g_emb, e_rows)
        step(where, s_where, g_where, np.arange(CONTEXT))


#: Scores below this need no shift before their exponential in single precision.
SAFE = 80.0


def _chosen(scores: np.ndarray, column: np.ndarray, safe: bool) -> np.ndarray:
    """Log softmax of one column per row; ``scores`` is overwritten. ``safe``
    says that no score is beyond SAFE, else each row's largest is taken off first."""
    if not safe:
        scores -= scores.max(1)[:, None]
    chosen = scores.ravel().take(np.arange(len(column)) * scores.shape[1] + column)
    np.exp(scores, out=scores)
    return chosen - np.log(scores @ np.ones(scores.shape[1], np.float32))


def log_probabilities(flat: np.ndarray, classes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log of P(class | context), by batched matrix products: the
    group's softmax, times the class's in a group of several."""
    where, emb, out, bias, out_in, bias_in = _split(flat)
    # the bias is the product with a one behind the context vector
    outer, inner = (np.concatenate([m, b[:, None]], 1) for m, b in ((out, bias), (out_in, bias_in)))
    placed = [emb * where[j] for j in range(CONTEXT)]
    largest = max(np.sqrt((m * m).sum(1).max()) for m in (outer, inner))
    starts = _groups(len(bias_in))
    stops = np.append(starts[1:], len(bias_in))
    group_of = np.repeat(np.arange(len(starts), dtype=np.uint16 if len(starts) < 1 << 16 else np.uint32), stops - starts)
    group = group_of.take(classes)
    result = np.empty(len(classes))
    block = max(1, min(1 << 14, SCORE_BYTES // (4 * len(bias))))
    for s in range(0, len(classes), block):
        order = np.argsort(group[s: s + block], kind="stable")       # tokens of a group stand together
        g, w, ctx = (x[s: s + block].take(order, 0) for x in (group, classes, contexts))
        v = np.ones((len(g), DIM + 1), np.float32)
        v[:, :DIM] = sum(placed[j].take(ctx[:, j], 0) for j in range(CONTEXT))
        safe = np.sqrt((v * v).sum(1).max()) * largest < SAFE
        p = _chosen(v @ outer.T, g, safe).astype(np.float64)
        head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        for lo, hi in zip(head.tolist(), np.append(head[1:], len(g)).tolist()):
            a, b = starts[g[lo]], stops[g[lo]]
            if b - a > 1:
                p[lo:hi] += _chosen(v[lo:hi] @ inner[a:b].T, w[lo:hi] - a, safe)
        result[s + order] = p
    return result


def _class_map(vocab: np.ndarray, ending: np.ndarray, top: np.ndarray, place: np.ndarray, n_frequent: int, n_rare: int) -> np.ndarray:
    """Class of each vocabulary entry; ``top`` holds sorted hashes, ``place`` their classes."""
    out = n_frequent + _rare(ending, n_rare)
    if len(top):
        at = np.minimum(np.searchsorted(top, vocab), len(top) - 1)
        out = np.where(top[at] == vocab, place[at], out)
    return np.where(vocab == _END, n_frequent + n_rare, out)


def train(chunks: DataFrame, top: np.ndarray, place: np.ndarray, frequencies: np.ndarray, n_frequent: int) -> np.ndarray:
    """Parameters after ROUNDS rounds of local training and averaging."""
    flat = initial(frequencies)
    noise_p = frequencies / frequencies.sum()
    sc = chunks.sparkSession.sparkContext
    for r in range(ROUNDS):
        shared = sc.broadcast((flat, top, place, noise_p))

        def run(batches: Iterator[pa.RecordBatch], r=r, shared=shared) -> Iterator[pa.RecordBatch]:
            start, top_, place_, noise = shared.value
            mine, squares, seen, key = start.copy(), np.full_like(start, 1e-6), 0, 0
            for b in batches:
                for i in range(b.num_rows):
                    key = b.column(0)[i].as_py()
                    held, lengths, seq = (_unpack(b.column(k)[i].as_py(), t) for k, t in ((1, "?"), (2, "<i4"), (3, "<i4")))
                    vocab, ending = np.frombuffer(b.column(4)[i].as_py(), _U), _unpack(b.column(5)[i].as_py(), "<u2")
                    use = ~held & (np.arange(len(held)) % ROUNDS == r)      # every training text, in one of the rounds
                    classes = _class_map(vocab, ending, top_, place_, n_frequent, len(noise) - 1 - n_frequent).astype(
                        np.int32)[seq[np.repeat(use, lengths)]]
                    for lo, hi, s, e in _slices(lengths[use]):
                        contexts = _contexts(classes[s:e], lengths[use][lo:hi], len(noise))
                        train_pass(mine, squares, classes[s:e], contexts, noise, (key << 3) + r + (lo << 40))
                    seen += len(classes)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(key >> 24) % 16], pa.int64()), pa.array([float(seen)]),
                                                  pa.array([mine.astype("<f4").tobytes()], pa.binary())], names=["part", "n", "flat"])

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n, part = 0.0, 0.0, 0
            for pdf in batches:
                part = int(pdf["part"].iloc[0])
                for k, raw in zip(pdf["n"], pdf["flat"]):
                    total, n = total + k * np.frombuffer(raw, "<f4").astype(np.float64), n + k
            yield pd.DataFrame({"part": [part], "n": [n], "flat": [total.astype("<f8").tobytes()]})

        schema = "part long, n double, flat binary"
        parts = chunks.select("chunk", "held_out", "lengths", "seq", "vocab", "ending").mapInArrow(run, schema).groupBy(
            "part").applyInPandas(add, schema).collect()      # at most 16 rows of one parameter vector
        n = sum(p["n"] for p in parts)
        if n:
            flat = (sum(np.frombuffer(bytes(p["flat"]), "<f8") for p in parts) / n).astype(np.float32)
    return flat


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    chunks = materialise(chunked(docs, id_col, text_col), "lm-chunks")
    counts = materialise(counted(chunks), "lm-counts")
    known = counts.where("lead and c > 0")
    end = int(_END.view(np.int64))
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_frequent, n_rare = class_counts(distinct)
    n_classes = n_frequent + n_rare + 1
    best = known.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(n_frequent).select("h", "c").toPandas()
    ranked = best["h"].to_numpy(np.int64).view(_U)
    order = np.argsort(ranked)
    top, place = ranked[order], order.astype(np.int64)
    frequent = spark.createDataFrame([(int(h), int(k)) for k, h in enumerate(best["h"])], "h long, cls int")
    rest = known.where(F.col("h") != end).join(F.broadcast(frequent), "h", "left_anti")
    # at most one row per pair of last bytes
    rare = rest.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    of = _rare(rare["ending"].to_numpy(np.int64), n_rare)
    c_rare, v_rare = (np.bincount(of, rare[k].to_numpy(float), n_rare) for k in ("n", "v"))
    n_end = known.where(F.col("h") == end).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    frequencies = np.zeros(n_classes)
    frequencies[:len(best)] = best["c"]
    frequencies[n_frequent:-1] = c_rare
    frequencies[-1] = n_end
    frequencies = (frequencies + 0.5) / (frequencies + 0.5).sum()
    model = train(chunks, top, place, frequencies, n_frequent)
    shared = spark.sparkContext.broadcast((model, c_rare, v_rare, total, distinct))

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, c_r, v_r, n_all, v_all = shared.value
        row = {k: left.column(k)[0] for k in left.column_names}      # a chunk is one row
        held, lengths, seq = (_unpack(row[k].as_py(), t) for k, t in (("held_out", "?"), ("lengths", "<i4"), ("seq", "<i4")))
        bucket = _rare(_unpack(row["ending"].as_py(), "<u2"), n_rare)
        at = right.column("i").to_numpy()
        c, cls = np.zeros(len(bucket)), np.zeros(len(bucket), np.int64)
        c[at] = right.column("c").to_numpy()
        cls[at] = right.column("cls").to_numpy()
        cls = np.where(cls < 0, n_frequent + bucket, cls)
        base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
        rare = (cls >= n_frequent) & (cls < n_frequent + n_rare)
        inside = np.where(rare, np.log((c + SMOOTH) / (c_r[bucket] + SMOOTH * (v_r[bucket] + 1))), 0.0)
        n = len(lengths)
        found, base_of, score_of = np.zeros(n), np.zeros(n), np.zeros(n)
        for lo, hi, s, e in _slices(lengths):
            part = seq[s:e]
            doc = np.repeat(np.arange(hi - lo), lengths[lo:hi])
            classes = cls[part]
            logp = log_probabilities(flat, classes, _contexts(classes, lengths[lo:hi], n_classes)) + inside[part]
            found[lo:hi] = np.bincount(doc, c[part] > 0, hi - lo)
            base_of[lo:hi] = np.bincount(doc, base[part], hi - lo)
            score_of[lo:hi] = np.bincount(doc, logp, hi - lo)
        return pa.table({
            id_col: row["ids"].values, "held_out": pa.array(held), "n_tokens": lengths.astype(np.int64),
            "n_known": found.astype(np.int64), "train_tokens": np.full(n, int(n_all)),
            "base_score": base_of, "score": score_of / np.log(10)})

    answers = counts.join(F.broadcast(frequent), "h", "left").select(
        "chunk", "i", "c", F.when(F.col("h") == end, n_classes - 1).otherwise(F.coalesce("cls", F.lit(-1))).alias("cls"))
    return chunks.select("chunk", "ids", "held_out", "lengths", "seq", "ending").groupBy("chunk").cogroup(
        answers.groupBy("chunk")).applyInArrow(run, schema)


@register("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
