"""ROUGE-N: one exchange of texts, n-grams of one key at a time."""

from textforge.operators import evaluate as EV


def test_rouge_n_shuffles_texts_and_no_grams(spark):
    df = spark.createDataFrame([(1, "a b a", "a b"), (1, "b", "b c"), (None, "x", None), (None, "x y", "x y"), (3, None, "z"), (4, "", ""),
                                (5, "The the cat", "the CAT")], "id long, predicted string, reference string")
    got = EV.rouge_n(df, ["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    rows = {r.id: tuple(round(x, 6) for x in r[1:]) for r in got.collect()}
    assert len(rows) == got.count() == 5
    # of repeated and null keys all rows count together: a a b b against a b b c, and one of two pairs
    assert rows[1] == (0.75, 0.75, 0.75, 0.5, 0.5, 0.5)
    assert rows[None] == (round(2 / 3, 6), 1.0, 0.8, 1.0, 1.0, 1.0)
    assert rows[3] == rows[4] == (0.0,) * 6 and rows[5] == (round(2 / 3, 6), 1.0, 0.8, 1.0, 1.0, 1.0)[:3] + (0.5, 1.0, round(2 / 3, 6))
