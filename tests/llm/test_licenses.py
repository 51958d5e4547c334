import re
from re import _parser
from itertools import product

from tests.llm.helpers import documents, lower
from textforge.llm import licenses as L
from textforge.llm.license_rules import CONFIDENCE, GATES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."
TEXTS = [
    None, "", " .,; ", "plain words only", NOTICE, GPL, NOTICE + "\n" + GPL, "the MIT-License", "MIT license MIT license mit/license",
    "CC BY", "cc by-nc-sa 4.0 and CC BY 4.0", "SPDX-License-Identifier: GPL-2.0-or-later", "mit", "cc  \t by cc", "licence of the MİT License é",
    "MIT K license ſ", "gnu general public gnu general public license", "Copyright (c) 2001 2002 2003. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "neither the name of the very long Company Name nor the names of its contributors may be used to endorse or promote products derived from this software",
    "under the terms of the frobnicated thing license", (NOTICE + " x ") * 700, "word " * 30_000 + "apache license", "licensed under the mit license " * 300,
    "q" * 200_000 + " mit license", "copyright c" + " 1999" * 5000, "Creative Commons Attribution-ShareAlike 4.0 International License",
    "licensed under a creative commons attribution share alike 4.0 international license",
]


def brute(text, rules):
    """(n_words, base starts, base labels, [(start, end, class, rule, label)])."""
    words = WORD.findall(lower(text))
    low = " " + "  ".join(words) + " "
    places, base = [], set()
    for phrase, label in L.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(" " + r.pattern + " ", low):
            start = low[: m.start()].count(" ") // 2
            found.append((start, start + m.group().count(" ") // 2, r.cls, n, r.label))
    kept, seen = [], sorted(found)
    for d in seen:
        if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and (e[:2] != d[:2] or e[2] < d[2] or e[3] < d[3])
                   for e in seen if e != d):
            kept.append(d)
    return len(words), sorted(places), base, sorted(kept)


def test_against_brute_force(spark):
    texts = TEXTS + TEXTS[3:6]
    df = documents(spark, texts, extra=("_tf_low", "places", "n_words"))
    rows = {r.doc_id: r for r in L.scan(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, places, base, kept = brute(t, L.RULES)
        r = rows[i]
        assert (r.n_words, [p.start for p in r.places], set(r.base)) == (n, places, base), t
        assert sorted(tuple(d) for d in r.detections) == kept, t


def test_suppression():
    labels = lambda t: [d[4] for d in brute(t, L.RULES)[3]]
    assert labels(NOTICE) == ["apache-2.0"] and labels(GPL) == ["gpl-3.0"]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == ["gpl-2.0-or-later"]
    assert labels("cc by-nc-sa 4.0") == ["cc-by-nc-sa-4.0"] and labels("a mit b") == []
    assert labels(NOTICE + GPL) == ["apache-2.0", "gpl-3.0"]


def _samples(tree, at_most=40):
    """Some strings that a pattern matches, from its own parse."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            got = [chr(arg)]
        elif name in ("IN", "NOT_LITERAL"):
            got = ["x"] if name == "NOT_LITERAL" or str(arg[0][0]) == "NEGATE" else [chr(arg[0][1] if isinstance(arg[0][1], int) else arg[0][1][0])]
        elif name == "SUBPATTERN":
            got = _samples(arg[3], at_most)
        elif name == "BRANCH":
            got = [s for b in arg[1] for s in _samples(b, at_most)]
        else:
            lo, hi, sub = arg
            inner = _samples(sub, at_most)
            got = ["".join(x) for n in {lo, min(int(hi), lo + 1)} for x in product(inner, repeat=n)]
        out = [a + b for a in out for b in got][:at_most]
    return out


def test_every_rule_is_reachable():
    """Each match holds the rule's keyword, each keyword holds a gate."""
    assert len(L.RULES) > 200 and {r.cls for r in L.RULES} == set(range(len(CONFIDENCE)))
    for r in L.RULES:
        assert any(L.spaced(g) in r.keyword for g in GATES), r
        for s in _samples(_parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, s) and r.keyword in f" {s} ", (r, s)


def test_native_and_empty(spark):
    df = documents(spark, TEXTS)
    plan = L.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan
    assert L.scan(df.limit(0)).count() == 0
    assert L.scan(df.selectExpr("cast(null as bigint) doc_id", "text")).count() == len(TEXTS)
