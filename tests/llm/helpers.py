"""Small fixtures and brute-force versions shared by the tests of the package."""

import re

from pyspark.sql import types as T

BLANK = "[^\\x20\\x09-\\x0D]+"


def documents(spark, texts, parts=3, extra=()):
    """A documents table; ``extra`` adds string columns whose names may clash."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in extra]
    rows = [(i, t, *("x" for _ in extra)) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(parts)


def words(text):
    return re.findall(BLANK, text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, n=5):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def jaccard_components(texts):
    """{id: (set size, least linked id)} by comparing all pairs."""
    ids = list(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            s, t = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                i, j = sorted((find(a), find(b)))
                up[j] = i
    return {i: (len(sets[i]), find(i)) for i in ids}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
