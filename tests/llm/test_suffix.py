import collections
import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import documents
from textforge.llm import suffix


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone, end = bytearray(len(r)), 0
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[max(i, end):i + length] = b"\1" * (i + length - max(i, end))
                end = i + length
        kept = bytes(b for b, x in zip(r, gone) if not x)
        spans = sum(x and (not j or not gone[j - 1]) for j, x in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    passages = [prose(rng.randint(20, 120)) for _ in range(8)]
    texts = [None, "", "a" * 150, "a" * 500, "a" * 500, "ab" * 300, "\0" * 300 + "x" + "\0" * 260, "z" * 199]
    for _ in range(120):
        t = prose(rng.randint(5, 120))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(passages), rng.randint(0, 40)
            k = rng.randint(0, len(t))
            t = t[:k] + (p[a:] if rng.random() < .5 else p[:len(p) - a]) + t[k:]
        texts.append(t)
    return texts + [texts[20], texts[20], texts[30]]


@pytest.mark.parametrize("sizes", [{}, {"RANGE": 48, "BLOCK": 8, "RUN": 64}])
def test_against_brute_force(spark, monkeypatch, sizes):
    """Also with ranges so small that hot passages fill several of them."""
    for k, v in sizes.items():
        monkeypatch.setattr(suffix, k, v)
    texts = corpus(5)
    out = suffix.without_repeats(documents(spark, texts, extra=("k1", "cuts")))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()}
    want = brute(texts)
    assert got == dict(enumerate(want)) and sum(w[1] for w in want) > 20000
    row = out.where("n_removed > 0 and n_removed < n_bytes").first()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == row.kept_sha256


def test_empty_and_ids(spark):
    df = documents(spark, ["p" * 250, "q"])
    assert suffix.without_repeats(df.limit(0)).count() == 0
    twice = df.union(df)                                    # repeated rows are copies of each other
    rows = suffix.without_repeats(twice).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 250), (0, 250), (1, 0), (1, 0)]


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choices(b"ab", k=40)) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    tree = suffix.LoserTree([(r, [0] + [lcp(a, b) for a, b in zip(r, r[1:])]) for r in runs])
    out = [(runs[r][i], c) for r, i, c in tree]
    assert [x for x, _ in out] == sorted(x for r in runs for x in r)
    assert all(c == lcp(a, b) for (a, _), (b, c) in zip(out, out[1:]))


@pytest.mark.parametrize("texts", [["x" * 50] + ["é" + "abc" * 1000] * 1500, ["abcdefg" * 600_000]], ids=["many", "one long"])
def test_anchors_take_little_memory(texts):
    """A task's working arrays follow the piece, not the batch; every window is in one piece."""
    array = pa.array(texts)
    suffix.W.powers(1)                                        # made once a worker
    tracemalloc.start()
    windows = 0
    for data, offsets, _, _ in suffix._pieces(array):
        windows += int(np.maximum(np.diff(offsets) - suffix.LENGTH + 1, 0).sum())
        _, first, last, _, _ = suffix._anchors(data, offsets)
        assert (last >= first).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    assert windows == sum(max(0, len(t.encode()) - suffix.LENGTH + 1) for t in texts)
