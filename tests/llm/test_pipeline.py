"""run() against brute force on a fixture with every stage's cases."""

import hashlib
import random

import numpy as np

import corpus_pipeline as P
from tests.llm.helpers import jaccard_components, quality
from tests.llm.test_bpe import _library
from textforge.llm import pii
from textforge.llm.quality import CAPITALS
from textforge.llm.scratch import fresh_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [prose(30) for _ in range(5)]
    texts = {i: " ".join(prose(rng.randint(15, 120))) for i in range(40)}
    for i in range(40, 70):
        w = texts[i % 20].split()
        w[rng.randrange(len(w))] = "edit"
        texts[i] = " ".join(w)
    for i in range(70, 80):
        t = prose(60)
        t[20:20] = items[i % 5]
        texts[i] = " ".join(t)
    for i in range(80, 90):
        texts[i] = " ".join(prose(40)) + f" write j{i} [at] mail [dot] com or b{i}@c.org"
    texts |= {90: None, 91: "", 92: "AB CD!! " * 30, 93: " ".join(f"w{i}###" for i in range(40)), 94: texts[30], 95: texts[30]}
    return texts, [" ".join(w) for w in items]


def brute(texts, items):
    def ok(t):
        n, chars, symbols, dup, repeat = quality(t)
        caps = sum(c in CAPITALS for c in t or "")
        return n >= 20 and 100 * repeat <= 30 * n and 100 * symbols <= 30 * n and 100 * caps <= 50 * chars
    kept = {i: t for i, t in texts.items() if ok(t)}
    kept = {i: t for i, t in kept.items() if jaccard_components(kept)[i][1] == i}
    kept = {i: t for i, t in kept.items() if not any(x in t for x in items)}
    return {i: pii.mask(t, pii.find(t)[1]) for i, t in kept.items()}


def test_run_equals_brute_force(spark):
    texts, items = fixture()
    path = fresh_path(spark, "pipeline-test")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    enc = _library()
    want = {i: enc.encode_ordinary(t) for i, t in brute(texts, items).items()}
    rows = P.run(spark, path).collect()
    assert {r.doc_id: r.ids for r in rows} == want and 30 < len(want) < 70
    for r in rows:
        assert r.n_tokens == len(want[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    texts, items = fixture()
    path = fresh_path(spark, "pipeline-test")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], COLUMNS)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, path).dtypes == docs.dtypes, name
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0


def test_null_and_repeated_ids(spark):
    """A row goes by its own text: copies of an item and near copies without an id, or under another's."""
    rng = random.Random(30)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    item, base = prose(30), prose(60)
    near = " ".join(base[:59] + ["edit"])
    rows = [(None, " ".join(prose(20) + item)), (None, " ".join(base)), (7, near), (7, " ".join(prose(50))), (7, " ".join(prose(20) + item + prose(9))),
            (None, " ".join(prose(40))), (None, "too short"), (8, None)]
    path = fresh_path(spark, "pipeline-test")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    enc = _library()
    want = [(7, near), rows[3], rows[5]]
    got = sorted((r.doc_id or 0, r.ids) for r in P.run(spark, path).collect())
    assert got == sorted((i or 0, enc.encode_ordinary(t)) for i, t in want)
