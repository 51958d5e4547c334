import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from textforge.llm import variants as V

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(docs):
    seen = Counter()
    for i, text in docs:
        for w in RUN.findall(text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_forms(words):
    out, by = {}, {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    best = {w: min(by[w], key=lambda x: (-words[x], x)) if by[w] else None for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(by[w]), words[form[w]] if form[w] else None)
    return out


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeinrstéÉ÷zq") for _ in range(rng.randrange(4, 9))) for _ in range(30)]

    def edit(w):
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("aenzé") + w[i:], w[:i] + rng.choice("aistÉ") + w[i + 1:]])
        return w
    docs = [(i, " ".join(edit(rng.choice(stems)) for _ in range(rng.randrange(120)))) for i in range(n)]
    long = "ab" * 400
    docs += [(900, None), (901, ""), (902, "1 2 ,"), (903, "HELLO hello Hello hella Hella hella hello hello"), (903, "hello hello"),
             (904, f"{long} {long} {long}x {long}x {long}x {long}"), (905, "aaaaa" * 50 + " " + "a" * 251 + ", " + "a" * 250),
             (906, ("a" * 250 + " " + "a" * 251 + " ") * 3), (None, "nullid nullid nullid nullit nullit nullit nullid nullid nullid nullid")]
    return docs


def frame(spark, docs, extra=()):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in extra]
    return spark.createDataFrame([(*d, *("x" for _ in extra)) for d in docs], T.StructType(fields)).repartition(3)


def test_against_brute_force(spark):
    docs = corpus()
    df = frame(spark, docs, ("word", "n", "path"))
    counted = V.word_counts(df)
    words = brute_words(docs)
    assert {r.word: r.n for r in counted.collect()} == words and len(words) > 300
    want = brute_forms(words)
    assert sum(v[0] is not None for v in want.values()) > 50 and any(v[1] != v[0] and v[0] for v in want.values())
    for limit in (None, 20):        # one bin, and many of them
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in V.forms(V.near_words(counted, limit)).collect()}
        assert got == want, limit


def test_words_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = brute_words([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert {r.word: r.n for r in V.word_counts(df).collect()} == words


def test_empty(spark):
    for docs in ([], [(1, "a b c")]):
        assert V.forms(V.near_words(V.word_counts(frame(spark, docs)))).count() == 0


def test_checksums_combine():
    runs = [b"", b"a", b"hello", "été".encode(), b"x" * V.SHORT]
    shift = V._shift_tables(V.SHORT)
    for prefix in (b"", b"0:", b"123456789:"):
        got = V.checksums(np.full(len(runs), zlib.crc32(prefix), np.uint32), np.array([zlib.crc32(r) for r in runs], np.uint32),
                          np.array([len(r) for r in runs]), shift)
        assert [int(x) for x in got] == [zlib.crc32(prefix + r) for r in runs]


def test_one_apart():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(120)] + ["a" * 5000, "a" * 5001, "a" * 4999 + "b"]
    codes, offsets = V.letters_of(pa.array(words))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert V.one_apart(codes, offsets, a, b).tolist() == [near(words[i], words[j]) for i, j in zip(a, b)]
