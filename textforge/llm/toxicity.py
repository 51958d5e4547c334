"""Toxicity by multiple-instance learning.

Labels are given per document, offence sits in sentences. A sentence's chance of
being offensive is a logistic function of its words and word beginnings; a
document is toxic if any sentence is: ``1 - prod(1 - p)`` (noisy-or). The
sentence weights are trained through that product from document labels alone,
and then also say which sentences offend.

Training reads a bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN,
the rows whose ids hash lowest); feature counts over it are taken on the
executors, the fit itself is numpy on at most MAX_FEATURES features. Every text
is scored whole, row by row, without an exchange.

Null or empty text: no sentence, score 0. Labels that are null are not trained
on; an id that is labelled more than once counts as toxic if any label says so.
Without toxic labels every score is close to 0. Repeated rows and null ids are
scored like any other (a null id's remainder is that of an empty text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.llm import tokens as W
from textforge.llm.registry import register, table
from textforge.llm.scratch import materialise

SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
MAX_FEATURES = 20000
#: Least number of sample documents with a feature.
MIN_DOCS = 8
#: Toxic documents that must share a feature before it gets weight, about.
SUPPORT = 4.0
#: Word beginnings used as features, in bytes.
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
_U = np.uint64
_BREAK = np.zeros(256, np.int64)
_BREAK[[ord(c) for c in ".!?\n"]] = 1


def fold(id_: Column, n: int) -> Column:
    """The remainder of the id's CRC-32 (as text) that deals rows to folds."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: (first text, its text per sentence, sentence and hash
    of every feature, byte range of each sentence)."""
    data, offsets = W.buffer_of(texts)
    for lo, hi in W.slices(offsets):
        a = offsets[lo]
        raw, off = data[a: offsets[hi]], offsets[lo: hi + 1] - a
        starts, ends = W.word_bounds(W._PLAIN[raw], off)
        doc = np.searchsorted(off, starts, "right") - 1
        mark = np.concatenate([[0], np.cumsum(_BREAK[raw])])[starts]      # sentence ends before each word
        new = np.ones(len(starts), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])
        sent = np.cumsum(new) - 1
        stops = [ends, *(np.minimum(starts + k, ends) for k in BEGINNINGS)]
        hashes = W.hash_ranges(raw, starts, ends, stops)
        feats, owner = [hashes[0]], [sent]
        for i, k in enumerate(BEGINNINGS):
            longer = ends - starts > k
            feats.append(hashes[i + 1][longer] ^ _U(0x5851F42D4C957F2D + i))
            owner.append(sent[longer])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        spans = np.stack([starts[first] - off[doc[first]], ends[last] - off[doc[first]]], 1) if len(first) else np.zeros((0, 2), np.int64)
        yield lo, doc[first], np.concatenate(owner), np.concatenate(feats), spans


@dataclass
class Model:
    keys: np.ndarray       # sorted feature hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> _U(48)).astype(np.int64)] = True

    def sentences(self, n: int, owner: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """Log-odds of each of ``n`` sentences (a feature counts once in each)."""
        out = np.full(n, self.bias)
        if len(self.keys):
            hit = np.flatnonzero(self.maybe[(feats >> _U(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, feats[hit]), len(self.keys) - 1)
            ok = self.keys[at] == feats[hit]
            pairs = np.unique(owner[hit][ok] * np.int64(len(self.keys)) + at[ok])
            np.add.at(out, pairs // len(self.keys), self.weights[pairs % len(self.keys)])
        return out


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(n_docs: int, label: np.ndarray, weight: np.ndarray, sent_doc: np.ndarray, owner: np.ndarray, feat: np.ndarray,
        n_features: int, rounds: int = 400, rate: float = 0.05, support: float = SUPPORT) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal Adam on the noisy-or likelihood; the L1
    penalty equals the pull of ``support`` toxic documents, so what fewer of them
    share gets no weight. Sentence ``owner[i]`` holds feature ``feat[i]``."""
    w = np.zeros(n_features + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = weight / weight.sum()
    l1 = support * share[label == 1].mean()
    n_sent = len(sent_doc)
    for t in range(1, rounds + 1):
        s = w[-1] + np.bincount(owner, w[feat], n_sent)
        total = np.bincount(sent_doc, _softplus(s), n_docs)      # -log P(no sentence offends)
        miss = np.exp(-np.maximum(total, 1e-9))
        pull = np.where(label == 1, -miss / -np.expm1(-np.maximum(total, 1e-9)), 1.0) * share
        g_sent = pull[sent_doc] / (1 + np.exp(-s))
        g = np.append(np.bincount(feat, g_sent[owner], n_features), g_sent.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
        w -= step * m / (1 - 0.9 ** t)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - l1 * step[:-1], 0)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Fit on labelled rows outside the held-out fold; where no feature is in
    MIN_DOCS of them, the model is a bias alone."""
    lab = labels.where(F.col(label_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD_OUT)).groupBy(
        F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    totals = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = lambda y, n: lab.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    sample = materialise(take(1, SAMPLE_TOXIC).union(take(0, SAMPLE_CLEAN)), "toxicity-sample")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    rows = materialise(rows.select("y", "text"), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            for lo, sent_doc, owner, feats, _ in _features(b.column(1)):
                keys, at = np.unique(feats, return_inverse=True)
                n = len(y) + 1
                pairs = np.unique(at.astype(np.int64) * n + sent_doc[owner] + 0)
                key, toxic = pairs // n, y[lo + pairs % n] == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(key, minlength=len(keys)).astype(np.int64)),
                     pa.array(np.bincount(key, toxic, len(keys)).astype(np.int64))], names=["f", "n", "k"])

    n_all, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_toxic or n_toxic == n_all:
        return Model(np.zeros(0, _U), np.zeros(0), 20.0 if n_all and n_toxic == n_all else -20.0)
    tally = rows.mapInArrow(count, "f long, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    expected = F.col("n") * F.lit(n_toxic / n_all)
    best = tally.where(F.col("n") >= MIN_DOCS).orderBy(
        F.desc(F.pow(F.col("k") - expected, F.lit(2)) / expected), "f").limit(MAX_FEATURES).toPandas()
    keys = np.sort(best["f"].to_numpy(np.int64).view(_U))
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            y = b.column(0).to_numpy()
            for lo, sent_doc, owner, feats, _ in _features(b.column(1)):
                at = np.minimum(np.searchsorted(known, feats), max(len(known) - 1, 0))
                ok = known[at] == feats if len(known) else np.zeros(len(feats), bool)
                pairs = np.unique(owner[ok].astype(np.int64) * len(known) + at[ok])
                yield pa.RecordBatch.from_arrays([
                    pa.array([y[lo: lo + int(sent_doc.max()) + 1].astype("<i4").tobytes() if len(sent_doc) else b""], pa.binary()),
                    pa.array([sent_doc.astype("<i4").tobytes()], pa.binary()), pa.array([pairs.astype("<i8").tobytes()], pa.binary())],
                    names=["y", "sent", "pairs"])

    label, sent_doc, owner, feat = [], [], [], []
    n_docs = n_sent = 0
    for r in rows.mapInArrow(sparse, "y binary, sent binary, pairs binary").toLocalIterator():
        y, s, pairs = np.frombuffer(r["y"], "<i4"), np.frombuffer(r["sent"], "<i4"), np.frombuffer(r["pairs"], "<i8")
        label.append(y)
        sent_doc.append(s + n_docs)
        owner.append(pairs // max(len(keys), 1) + n_sent)
        feat.append(pairs % max(len(keys), 1))
        n_docs, n_sent = n_docs + len(y), n_sent + len(s)
    label = np.concatenate([np.zeros(0, "<i4"), *label])
    if len(np.unique(label)) < 2:        # without a sentence on one side there is nothing to fit
        return Model(np.zeros(0, _U), np.zeros(0), -20.0)
    share = {y: totals.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)}
    w, bias = fit(n_docs, label, np.where(label == 1, share[1], share[0]), np.concatenate(sent_doc),
                  np.concatenate(owner), np.concatenate(feat), len(keys))
    used = np.flatnonzero(w)
    return Model(keys[used], w[used], bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, n_sentences, offending): offending holds the byte range
    and probability of each sentence at or above THRESHOLD."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("p", T.DoubleType())]))
    schema = T.StructType([T.StructField(id_col, src.schema["id"].dataType), T.StructField("score", T.DoubleType()),
                           T.StructField("n_sentences", T.LongType()), T.StructField("offending", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for b in batches:
            n = b.num_rows
            total, count = np.zeros(n), np.zeros(n, np.int64)
            bad: dict[int, list] = {}
            for lo, sent_doc, owner, feats, spans in _features(b.column(1)):
                s = m.sentences(len(sent_doc), owner, feats)
                total += np.bincount(sent_doc + lo, _softplus(s), n)
                count += np.bincount(sent_doc + lo, minlength=n)
                p = 1 / (1 + np.exp(-s))
                for j in np.flatnonzero(p >= THRESHOLD):
                    bad.setdefault(int(sent_doc[j]) + lo, []).append(
                        {"start": int(spans[j, 0]), "end": int(spans[j, 1]), "p": float(p[j])})
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(-np.expm1(-total)), pa.array(count), pa.array([bad.get(i, []) for i in range(n)], kind)],
                names=[id_col, "score", "n_sentences", "offending"])

    return src.mapInArrow(run, schema)


@register("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences",
                         F.size("offending").alias("n_offending"))
