"""Longest-common-subsequence kernels for ROUGE-L / ROUGE-Lsum (pure Python helpers).

``lcs_length`` is the bit-parallel algorithm (Allison-Dix / Hyyro): one
pass over ``a`` with word-parallel operations on a bit set of ``b``, i.e.
O(|a| * |b| / 64) machine work, so whole texts stay cheap.
``lcs_indices`` also finds the matched positions (summary-level union LCS), by
going back over rows of which only some are kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence


def lcs_length(a: Sequence[str], b: Sequence[str]) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        m = masks.get(tok)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def _next_row(v: int, mask: int | None, full: int) -> int:
    """Row i + 1 of the LCS length table from row i: a zero bit is a column where the length grows."""
    if mask is None:
        return v
    u = v & mask
    return ((v + u) | (v - u)) & full


def lcs_indices(ref: Sequence[str], cand: Sequence[str]) -> list[int]:
    """Positions in ``ref`` of one LCS with ``cand`` (ties prefer moving in ``ref``).

    Rows of the length table are bit sets. Every root-of-n-th row is kept; going
    back, the rows between two kept ones are made again, so about 2 * root(n)
    rows of len(cand) bits are held at once and each row is computed twice.
    """
    n, m = len(ref), len(cand)
    if not n or not m:
        return []
    masks: dict[str, int] = {}
    for j, tok in enumerate(cand):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full, step = (1 << m) - 1, math.isqrt(n) + 1
    kept, v = [full], full
    for i, tok in enumerate(ref, 1):
        v = _next_row(v, masks.get(tok), full)
        if i % step == 0:
            kept.append(v)
    out: list[int] = []
    i, j, block, rows = n, m, None, []
    while i > 0 and j > 0:
        if (i - 1) // step != block:
            block = (i - 1) // step
            rows = [kept[block]]
            for tok in ref[block * step: min(n, (block + 1) * step)]:
                rows.append(_next_row(rows[-1], masks.get(tok), full))
        if ref[i - 1] == cand[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
            continue
        here, above = rows[i - block * step], rows[i - 1 - block * step]
        # left beats up only where the length does not grow here, but does from the row above
        low = (1 << j) - 1
        if here >> (j - 1) & 1 and (here & low).bit_count() < (above & low).bit_count():
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def fmeasure(p: float, r: float) -> float:
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def rouge_l(pred: Sequence[str], ref: Sequence[str]) -> tuple[float, float, float]:
    """Sentence-level ROUGE-L (precision, recall, F1) over token lists."""
    if not pred or not ref:
        return 0.0, 0.0, 0.0
    lcs = lcs_length(pred, ref)
    p, r = lcs / len(pred), lcs / len(ref)
    return p, r, fmeasure(p, r)


def rouge_lsum(pred_sents: Sequence[Sequence[str]], ref_sents: Sequence[Sequence[str]]
               ) -> tuple[float, float, float]:
    """Summary-level ROUGE-L: union LCS of each reference sentence with all
    candidate sentences; every token is credited at most as often as it
    occurs on both sides."""
    pred_sents = [s for s in pred_sents if s]
    ref_sents = [s for s in ref_sents if s]
    n = sum(len(s) for s in pred_sents)
    m = sum(len(s) for s in ref_sents)
    if not n or not m:
        return 0.0, 0.0, 0.0
    left_c = Counter(t for s in pred_sents for t in s)
    left_r = Counter(t for s in ref_sents for t in s)
    hits = 0
    for r in ref_sents:
        union: set[int] = set()
        for c in pred_sents:
            union.update(lcs_indices(r, c))
        for i in sorted(union):
            t = r[i]
            if left_c[t] > 0 and left_r[t] > 0:
                hits += 1
                left_c[t] -= 1
                left_r[t] -= 1
    p, rc = hits / n, hits / m
    return p, rc, fmeasure(p, rc)
