import random
import time

import numpy as np

from tests.llm.helpers import documents
from textforge.llm import decontaminate as D


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
    return max(map(max, h))


def test_alignment_equals_the_full_table():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 14))], np.uint64) for _ in range(2))
        score, s, e = D.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        if score:
            assert smith_waterman(a.tolist(), b[s:e].tolist()) == score


def test_copies_edits_and_clean_texts(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {k: prose(rng.randint(20, 50)) for k in range(12)}
    texts, planted = {}, {}
    for i in range(150):
        t = prose(rng.randint(20, 200))
        if i % 5 == 0:
            k, w = i % 12, list(items[i % 12])
            for _ in range(i % 4 * len(w) // 10):                       # up to three in ten words change
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if i % 10 == 0:
                w.insert(len(w) // 2, "extra")
            at = rng.randint(0, len(t))
            t[at:at] = [x.upper() + "," for x in w]
            planted[i] = k
        texts[i] = " ".join(t)
    texts |= {900: None, 901: "", 902: " ".join(items[0][:4])}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(70, None), (71, ""), (72, "the")], "item_id long, text string")
    docs = documents(spark, texts, extra=("id", "score"))
    rows = D.contaminated(docs, bench).collect()
    assert {r.doc_id: r.item_id for r in rows} == planted and all(0.35 <= r.similarity <= 1 for r in rows)
    small = D.contaminated(docs, bench, block_bytes=600).collect()       # several blocks of items
    assert sorted(map(tuple, small)) == sorted(map(tuple, rows))
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(texts) - set(planted)
    assert D.contaminated(docs.limit(0), bench).count() == 0 == D.contaminated(docs, bench.limit(0)).count()


def _item(n, tag="w"):
    return [f"{tag}{i}" for i in range(n)]


def _edited(words):
    """Every fifth word replaced: 18 of 28 3-word seeds break."""
    return ["other" if i % 5 == 2 else w for i, w in enumerate(words)]


def test_one_edited_or_partial_copy_is_found(spark):
    bench = spark.createDataFrame([(1, " ".join(_item(30)))], "item_id long, text string")
    for copy, score in ((_edited(_item(30)), 24 * 2 - 6), (_item(30)[8:22], 28)):
        docs = documents(spark, {5: " ".join(_item(40, "x") + copy + _item(40, "y")), 6: " ".join(_item(90, "z"))})
        assert [(r.doc_id, r.item_id, r.score) for r in D.contaminated(docs, bench).collect()] == [(5, 1, score)]


def test_copies_do_not_depend_on_other_documents(spark):
    bench = spark.createDataFrame([(1, " ".join(_item(30)))], "item_id long, text string")
    texts = {i: " ".join(_item(30)) for i in range(40)}
    texts |= {100: " ".join(_edited(_item(30))), 101: " ".join(_item(30)[:14]), 102: " ".join(_item(30)[10:13] + _item(50, "z"))}
    texts |= {200 + i: " ".join(_item(3) + _item(20, f"q{i}v")) for i in range(60)}      # a frequent phrase is no passage
    rows = D.contaminated(documents(spark, texts), bench).collect()
    assert {r.doc_id for r in rows} == {*range(40), 100, 101} and len(rows) == 42


def test_bounds_never_hide_a_passage(monkeypatch):
    rng = random.Random(6)
    for _ in range(300):
        item, doc = (np.array([rng.randint(0, 30) for _ in range(rng.randint(1, 25))], np.uint64) for _ in range(2))
        score = D.align(item, doc)[0]
        assert score <= min(D._bound(np.isin(doc, item)), D._bound(np.isin(item, doc)))
    monkeypatch.setattr(D, "PART", 5)
    doc, many = np.array([0, 0, 1, 1, 1, 2, 4, 4]), np.array([1, 2, 3, 4, 5, 1, 2, 1])
    assert list(D._parts(doc, many)) == [(0, 2), (2, 5), (5, 8)] and list(D._parts(doc[:0], many[:0])) == []


def test_an_edited_copy_beside_exact_ones(spark):
    bench = spark.createDataFrame([(1, " ".join(_item(30)))], "item_id long, text string")
    texts = {i: " ".join(_item(30)) for i in range(40)} | {100: " ".join(_edited(_item(30)))}
    assert {r.doc_id for r in D.contaminated(documents(spark, texts), bench).collect()} == set(texts)


def _exhaustive(texts, items):
    """{(doc, item)} whose best alignment over the whole document reaches the threshold."""
    out = set()
    for k, item in items.items():
        w = D._item_words(item)
        for i, t in texts.items():
            d = D._item_words(t)
            if len(w) >= D.MIN_WORDS:
                if D.align(w, d)[0] >= D._least(len(w), D.THRESHOLD):
                    out.add((i, k))
            elif len(w) > 1 and any((d[x: x + len(w)] == w).all() for x in range(len(d) - len(w) + 1)):
                out.add((i, k))
            elif len(w) == 1 and len(d) == 1 and d[0] == w[0]:
                out.add((i, k))
    return out


def test_search_equals_exhaustive_alignment(spark):
    """Words of very uneven frequency, copies edited in every way: nothing is missed, nothing added."""
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(400)]
    word = lambda: vocab[min(int(rng.paretovariate(0.6)) - 1, 399)]
    prose = lambda n: [word() for _ in range(n)]
    items = {k: " ".join(prose(rng.choice([1, 2, 3, 4, 5, 6, 8, 15, 30, 60]))) for k in range(40)}
    texts = {}
    for i in range(250):
        w = items[rng.randrange(40)].split()
        how = i % 7
        if how == 0:
            w = ["zz" if x % 3 == 2 else v for x, v in enumerate(w)]             # every third word replaced
        elif how == 1:
            w = [v for x in w for v in (x, f"q{rng.randrange(99)}")]              # a word put after every word
        elif how == 2:
            w = [v for x, v in enumerate(w) if x % 3]                             # every third word dropped
        elif how == 3:
            w = w[len(w) // 3: len(w) // 3 + max(5, len(w) // 2)]
        elif how == 4:
            w = [rng.choice([v, v, v, word(), f"q{rng.randrange(99)}"]) for v in w]
        elif how == 5:
            w = w + prose(9) + w
        texts[i] = " ".join([f"p{rng.randrange(99)}" for _ in range(rng.randrange(30))] + w + prose(rng.randrange(30)))
    texts |= {900 + k: items[k].split()[0] for k in range(10)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = D.contaminated(documents(spark, texts), bench).collect()
    want = _exhaustive(texts, items)
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(want) > 200
    for r in rows:      # each reported range aligns as well as it says
        item, doc = D._item_words(items[r.item_id]), D._item_words(texts[r.doc_id])
        assert D.align(item, doc[r.start_word: r.end_word])[0] == r.score


def test_copies_without_three_equal_words_in_a_row(spark):
    bench = spark.createDataFrame([(1, " ".join(_item(30)))], "item_id long, text string")
    copy = ["other" if i % 3 == 2 else w for i, w in enumerate(_item(30))]
    docs = documents(spark, {5: " ".join(_item(40, "x") + copy), 6: " ".join(_item(90, "z"))})
    assert [(r.doc_id, r.score) for r in D.contaminated(docs, bench).collect()] == [(5, 31)]


def test_repeated_passages_take_linear_time():
    item = D._item_words(" ".join(_item(40)))
    for n in (1000, 2000):
        words = np.concatenate([np.concatenate([item, item[:1] + np.uint64(i + 7)]) for i in range(n)])
        began = time.process_time()
        found = list(D._passages(item, words, 0, len(words), D.THRESHOLD))
        assert len(found) == n and {f[0] for f in found} == {80} and time.process_time() - began < n / 1000


def test_short_items_and_scripts_without_blanks(spark):
    items = {1: "alpha beta gamma", 2: "the", 3: "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed", 4: "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35"}
    texts = {1: "xx Alpha, beta gamma yy", 2: "alpha beta", 3: "the", 4: "the end", 5: "\u524d" + items[3] + "\u3002", 6: "\u4eca\u5929",
             7: "\u201cAlpha\u201d beta \u2014 gamma", 8: "see " + items[4] + " ok"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = D.contaminated(documents(spark, texts), bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (3, 2), (5, 3), (7, 1), (8, 4)}


def test_every_row_has_its_own_verdict(spark):
    """Null and repeated ids: a row goes by its own text alone."""
    bench = spark.createDataFrame([(1, " ".join(_item(30))), (2, "alpha beta gamma")], "item_id long, text string")
    bad, good = " ".join(_item(30)), "some other words that nobody copied"
    rows = [(None, bad), (None, good), (7, bad), (7, good), (7, None), (8, "x alpha beta gamma"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for size in (1, D.BLOCK_BYTES):
        kept = D.without_contaminated(docs, bench, block_bytes=size).collect()
        assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, good), (7, ""), (7, good), (9, "")]
    found = D.contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 1), (7, 1), (8, 2)]
