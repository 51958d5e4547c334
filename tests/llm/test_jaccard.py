import random

from pyspark.sql import functions as F

from tests.llm.helpers import documents, jaccard_components
from textforge.llm import jaccard


def corpus(seed=2):
    """Families of near copies around the threshold, hot passages, short texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(4000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts, hot = [None, "", " \n\t", "one two", "One  TWO", "a b c d e", "a b c d e f"], prose(12)
    for _ in range(25):
        base = prose(rng.randint(5, 150))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, .01, .03, .05, .08]))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w[rng.randint(0, len(w) // 12):]))
    texts += [" ".join(hot + prose(rng.randint(10, 40))) for _ in range(60)]      # a passage, not a copy
    texts += [" ".join(hot + prose(2)) for _ in range(40)]                          # mostly the passage
    return texts + [texts[30]] * 5


def test_against_all_pairs(spark):
    texts = dict(enumerate(corpus()))
    out = jaccard.join_components(documents(spark, texts, extra=("c", "g", "tok", "n_shingles")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()}
    want = jaccard_components(texts)
    assert got == want and len({c for _, c in want.values()}) < len(texts) - 50


def test_second_phase_alone_finds_every_component(spark, monkeypatch):
    """Without leader links all links must come from the token-group matrix."""
    real = jaccard._Texts.verified
    calls = []

    def nothing_first(self, pairs):
        calls.append(1)
        return real(self, pairs).where(F.lit(len(calls) > 1))
    monkeypatch.setattr(jaccard._Texts, "verified", nothing_first)
    texts = dict(enumerate(corpus(9)[:110]))
    out = jaccard.join_components(documents(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == jaccard_components(texts)


def test_one_per_group_and_edges(spark):
    texts = {5: "a b c d e f g h", 3: "a b c d e f g h", 9: "x y z", 11: None, 12: ""}
    df = documents(spark, texts, extra=("_x",))
    out = jaccard.one_per_group(df.union(df.where("doc_id = 3")))
    assert sorted(r.doc_id for r in out.collect()) == [3, 9, 11, 12] and out.columns == df.columns
    assert jaccard.join_components(df.limit(0)).count() == 0
    null = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard.one_per_group(null).count() == 4     # rows without an id have a verdict of their own
    assert {r.component_id for r in jaccard.join_components(null).collect()} == {None}


def test_every_row_has_its_own_verdict(spark):
    """Null and repeated ids: one row of each group stays, whatever the ids."""
    a = "one two three four five six seven eight nine ten eleven twelve"
    near = a + " more"
    rows = [(5, a), (5, a), (None, near), (3, "quite another text of seven words here"), (3, a + " x y"), (None, "alone but without any number of its own"),
            (None, "alone but without any number of its own"), (8, None), (8, ""), (None, None), (9, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = jaccard.one_per_group(docs)
    assert kept.columns == docs.columns
    got = sorted(str(tuple(r)) for r in kept.collect())
    want = [(3, a + " x y"), (3, "quite another text of seven words here"), (None, "alone but without any number of its own"),
            (8, None), (8, ""), (None, None)]
    assert got == sorted(map(str, want))
    assert jaccard.one_per_group(docs.limit(0)).count() == 0
