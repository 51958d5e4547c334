"""Vectorised words of Arrow text batches, shared by the operators of this package.

A word is a maximal run of bytes other than the six ASCII blanks; ASCII
capitals are lower-cased. Words are hashed to 64 bits from prefix sums of a
polynomial over the bytes, so a batch costs a handful of numpy passes and no
Python object per word. Memory per pass is bounded by SEGMENT bytes of text
(plus one word), however long a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


CODES, CODES_LOWER = _byte_codes(False), _byte_codes(True)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n (grown as needed)."""
    size = max(SEGMENT + 1, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(
                np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]), dtype=_U)
                for b in (_BASE & (2**64 - 1), inv))
    return _powers[size]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(offsets: np.ndarray, max_bytes: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``max_bytes`` of text each, at least one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a word never crosses documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_BLANK[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte ranges, in passes over bounded segments."""
    return hash_ranges(data, starts, ends, [ends], lower)[0]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: list[np.ndarray],
                lower: bool = True) -> list[np.ndarray]:
    """Hashes of data[starts:stop] for several arrays of stops, none beyond ``ends``."""
    out = [np.empty(len(starts), _U) for _ in stops]
    codes, lo = (CODES_LOWER if lower else CODES), 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + SEGMENT, "right")))
        b = int(ends[hi - 1])
        pw, inv = powers(b - a + 1)
        sums = np.zeros(b - a + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(codes[data[a:b]] * pw[: b - a], out=sums[1:])
            s = starts[lo:hi] - a
            for o, stop in zip(out, stops):
                e = stop[lo:hi] - a
                o[lo:hi] = mix((sums[e] - sums[s]) * inv[s] + (e - s).astype(_U))
        lo = hi
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of each document's first word;
    one more entry than documents)."""
    starts, ends = word_bounds(data, offsets)
    return hash_words(data, starts, ends), np.searchsorted(starts, offsets, "left")


#: Bytes that separate letters-and-digits words: all of ASCII but letters and digits.
_PLAIN = np.frombuffer(bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)), np.uint8)


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts with ASCII punctuation as blanks."""
    data, offsets = buffer_of(texts)
    return _PLAIN[data], offsets


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (across documents too;
    callers pick those that lie inside one)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _U(0xD6E8FEB86659FD93) + hashes[j: j + m]
    return mix(out + _U(n))
