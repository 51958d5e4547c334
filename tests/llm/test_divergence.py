import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from textforge.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    """{(lang, source, part): [(item, value)] by rank} of (lang, source, text) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    count, docs, lang_count = {}, Counter(), Counter()
    for lang, source, text in rows:
        words = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        count.setdefault((lang, source), Counter()).update(words)
        docs.update((lang, w) for w in set(words))
        lang_count.update((lang, w) for w in words)
    out = {}
    for lang, source in count:
        kept = [w for (x, w), n in docs.items() if x == lang and n >= min_docs]

        def lends(of):
            n = sum(of[w] for w in kept)
            return {w: 1 + 10**9 * (of[w] + 5) // (n + 5 * len(kept)) for w in kept}
        p, q = lends(count[lang, source]), lends(Counter({w: lang_count[lang, w] for w in kept}))
        pairs = []
        for x, other in count:
            if x == lang and other != source:
                r = lends(count[x, other])
                pairs.append((other, sum(abs(p[w] - r[w]) for w in kept)))
        terms = [(w, p[w] - q[w]) for w in kept if count[lang, source][w] and p[w] > q[w]]
        order = lambda xs: sorted(xs, key=lambda x: (-x[1], x[0].encode()))
        out[lang, source, "pair"], out[lang, source, "term"] = order(pairs), order(terms)[:top]
    return {k: v for k, v in out.items() if v}


def run(spark, rows, min_docs, top=5, block=4, tile=2, extra=()):
    fields = [T.StructField(c, T.StringType()) for c in ("lang", "source", "text", *extra)]
    df = spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], T.StructType(fields)).repartition(3)
    got = {}
    for r in D.ranked(D.Audit(D.term_counts(df), min_docs, block, tile), top).collect():
        got.setdefault((r["lang"], r["source"], r["part"]), {})[r["rank"]] = (r["item"], r["value"])
    return {k: [v[i + 1] for i in range(len(v))] for k, v in got.items()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "漢字", "éa"]
    rows = [("en" if i % 3 else "de", f"s{rng.randrange(5)}",
             " ".join(rng.choice(vocab[: rng.choice([3, 20, 63])]) for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [("en", "s0", "wAA " * 500)] * 30                                  # a hot source, repeated rows
    rows += [(None, None, "a b c"), (None, None, "a b"), ("", "z", "a"), ("fr", "s1", None), ("fr", "s2", "1 2 3"),
             ("fr", "é", ""), ("it", "only", "uno due"), ("en", "none", "!!"), ("en", "long", "waa-wba " * 20_000)]
    want = brute(rows, 2, 5)
    got = run(spark, rows, 2, extra=("term", "n", "block"))
    assert got == want
    assert got["fr", "s1", "pair"] == [("s2", 0), ("é", 0)] and ("fr", "s1", "term") not in got


def test_empty_table(spark):
    assert run(spark, [], 1) == {}


def test_joint_tables_are_exact():
    """The product's cells are the counts of terms by the two groups' levels."""
    rng = np.random.default_rng(3)
    n = rng.integers(0, 4, (3, 50))
    g, t = np.nonzero(n)
    m, gs, ps = D.level_rows(g, t, n[g, t], 10 * n[g, t] + g, {0: 0, 1: 1, 2: 2}, 50)
    seen = 0
    for i, j, terms in D.joint_tables(m, m):
        for a, b, c in zip(i, j, terms):
            assert c == ((n[gs[a]] == ps[a] // 10) & (n[gs[b]] == ps[b] // 10)).sum()
            seen += c
    assert seen == 9 * 50
