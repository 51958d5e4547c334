"""The language model and the toxicity model."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, lower, words
from textforge.llm import lm, toxicity


def two_tongues(n, seed=1):
    rng = random.Random(seed)
    tongues = [[a + b for a in "ba de ki lo mu".split() for b in s.split()] for s in ("an en in on un", "as es is os us")]
    return [" ".join(rng.choice(t) for _ in range(rng.randint(5, 60))) for t in (rng.choice(tongues) for _ in range(n))]


def test_base_score_and_counts(spark):
    texts = two_tongues(200) + [None, "", "Only UNSEEN Words"]
    rows = lm.score(documents(spark, texts, extra=("chunk", "score"))).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    toks = [words(lower(t)) + [None] for t in texts]
    c = collections.Counter(w for i, t in enumerate(toks) if fold(i) for w in t)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in t))
        assert r.score < 0
    held = [r for r in rows if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)      # the context tells the tongue
    assert lm.score(documents(spark, texts).limit(0)).count() == 0


def test_class_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    flat = lm.initial(np.full(lm.N_CLASSES, 1 / lm.N_CLASSES)) + rng.normal(0, .3, sum(int(np.prod(s)) for s in lm._SIZES)).astype("f4")
    context = np.repeat(rng.integers(0, lm.N_CLASSES, (1, lm.CONTEXT)), lm.N_CLASSES, 0)
    assert np.exp(lm.log_probabilities(flat, np.arange(lm.N_CLASSES), context)).sum() == pytest.approx(1, abs=1e-4)


def test_toxicity_from_document_labels(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda *more: " ".join([rng.choice(vocab) for _ in range(rng.randint(4, 9))] + list(more)) + "."
    texts, label = {}, {}
    for i in range(900):
        bad = i % 6 == 0
        s = [sentence() for _ in range(rng.randint(2, 8))]
        if bad:
            s[rng.randrange(len(s))] = sentence("zzvile" + rng.choice(["", "ly", "ness", "r"]))
        texts[i], label[i] = " ".join(s), int(bad)
    texts |= {5000: None, 5001: ""}
    docs = documents(spark, texts, extra=("y", "f"))
    labels = spark.createDataFrame([(i, y) for i, y in label.items()] + [(5000, None), (99999, 1), (0, 1), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in label if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [i for i in held if (rows[i].score >= toxicity.THRESHOLD) != label[i]]
    assert len(held) > 150 and len(wrong) <= 0.03 * len(held)
    assert rows[5000].score == rows[5001].score == 0
    hit = next(i for i in held if label[i] and rows[i].offending)            # and the sentence is found
    raw = texts[hit].encode()
    assert any(b"zzvile" in raw[x.start:x.end] for x in rows[hit].offending)
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] < 0.01


def test_classes_grow_with_the_vocabulary():
    counts = [lm.class_counts(v) for v in (0, 1000, 10**5, 10**7)]
    assert counts[0] == (lm.FREQUENT, lm.RARE) and counts == sorted(counts) and counts[3][0] >= 9 * counts[2][0] > 50 * lm.FREQUENT // 10
    for n in (lm.N_CLASSES, 700, 5000):
        flat = lm.initial(np.random.default_rng(1).dirichlet(np.ones(n)) + 1e-6)
        context = np.repeat([[1, n - 1, n]], n, 0)
        assert len(lm._split(flat)[-1]) == n and lm._groups(n)[-1] == n - 1
        assert np.exp(lm.log_probabilities(flat, np.arange(n), context)).sum() == pytest.approx(1, abs=1e-4)


def test_context_tells_words_beyond_the_most_frequent_apart():
    rng = np.random.default_rng(5)
    n, length, texts = 700, 60, 1500
    frequencies = np.full(n, 1e-3 / n)
    frequencies[100:600] += 1 / 500                             # none of them is among the FREQUENT first
    frequencies /= frequencies.sum()
    classes = rng.integers(50, 300, (texts, length)) * 2 + np.arange(texts)[:, None] % 2     # even or odd, text by text
    lengths = np.full(texts, length)
    contexts = lm._contexts(classes.ravel(), lengths, n)
    flat = lm.initial(frequencies)
    before = lm.log_probabilities(flat, classes.ravel(), contexts).mean()
    lm.train_pass(flat, np.full_like(flat, 1e-6), classes.ravel()[:-9000], contexts[:-9000], frequencies, 1)
    after = lm.log_probabilities(flat, classes.ravel()[-9000:], contexts[-9000:]).mean()
    assert after > before + 0.2                                 # of at most log 2


def test_toxicity_of_a_few_labelled_documents(spark):
    texts = {i: f"Some words here {i}. And more of them." for i in range(12)}
    docs = documents(spark, texts)
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2][:5]
    for n in (2, 5):
        labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(train[:n])], "doc_id long, toxic int")
        model = toxicity.train(docs, labels)
        rows = toxicity.score(docs, model).collect()
        assert len(model.keys) == 0 and len(rows) == 12 and all(0 < r.score < 1 for r in rows)


def _nce_loss(flat, w, ctx, noise, drawn, p):
    """The loss of one batch, written out term by term in double precision."""
    where, emb, out, bias, out_in, bias_in = lm._split(flat)
    starts = lm._groups(len(p))
    size = np.diff(starts, append=len(p))
    group_of = np.repeat(np.arange(len(starts)), size)
    group_p = np.add.reduceat(p, starts)
    log_sigmoid = lambda x: -np.log1p(np.exp(-x))
    total = 0.0
    for b in range(len(w)):
        v = sum(emb[ctx[b, j]] * where[j] for j in range(lm.CONTEXT))
        g = group_of[w[b]]
        score = lambda k: v @ out[k] + bias[k] - np.log(lm.NOISE * group_p[k])
        total -= log_sigmoid(score(g)) + sum(log_sigmoid(-score(k)) for k in noise)
        if size[g] > 1:
            inner = lambda k: v @ out_in[k] + bias_in[k] - np.log(lm.NOISE_IN * p[k] / group_p[group_of[k]])
            total -= log_sigmoid(inner(w[b])) + sum(log_sigmoid(-inner(k)) for k in drawn[b])
    return total / len(w)


def test_nce_gradient_is_the_numeric_one():
    """One batch with large squares moves each parameter by rate * gradient / root(squares)."""
    rng = np.random.default_rng(11)
    n = lm.N_CLASSES + 60
    p = rng.random(n) + 0.1
    p /= p.sum()
    w = rng.integers(0, n, 40).astype(np.int32)
    ctx = rng.integers(0, n + 1, (40, lm.CONTEXT)).astype(np.int32)
    start = lm.initial(p) + rng.normal(0, 0.2, lm._total(n)).astype(np.float32)
    moved, root = start.copy(), 30.0
    lm.train_pass(moved, np.full_like(start, root ** 2), w, ctx, p, 5)
    got = (start.astype(float) - moved) * root / lm.RATE
    # the same draws, in the order that the pass makes them
    again = np.random.default_rng(5)
    order = again.permutation(len(w))
    starts = lm._groups(n)
    size = np.diff(starts, append=n)
    group_of = np.repeat(np.arange(len(starts)), size)
    cumulated = np.cumsum(np.add.reduceat(p, starts))
    noise = np.searchsorted(cumulated / cumulated[-1], again.random(lm.NOISE), "right")
    many = np.flatnonzero(size[group_of[w[order]]] > 1)
    below = np.concatenate([[0], np.cumsum(p)])
    first = starts[group_of[w[order]][many]]
    stop = first + size[group_of[w[order]][many]]
    u = below[first, None] + again.random((len(many), lm.NOISE_IN)) * (below[stop] - below[first])[:, None]
    drawn = np.zeros((len(w), lm.NOISE_IN), int)
    drawn[order[many]] = np.clip(np.searchsorted(below, u, "right") - 1, first[:, None], stop[:, None] - 1)
    loss = lambda flat: _nce_loss(flat, w, ctx, noise, drawn, p)
    base = start.astype(float)
    for at in rng.choice(np.flatnonzero(np.abs(got) > 0), 150, replace=False):
        up, down = base.copy(), base.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        want = (loss(up) - loss(down)) / 2e-4
        assert abs(got[at] - want) <= 0.02 * abs(want) + 5e-3, at
    untouched = rng.choice(np.flatnonzero(got == 0), 20, replace=False)
    for at in untouched:
        up = base.copy()
        up[at] += 1e-3
        assert abs(loss(up) - loss(base)) < 1e-9
