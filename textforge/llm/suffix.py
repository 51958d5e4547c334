"""Exact removal of repeated byte strings by a distributed suffix merge sort.

Every byte covered by a LENGTH-byte string that also starts anywhere else goes.

Which suffixes are sorted. Each LENGTH-byte window picks an anchor in itself, the
GRAM-byte substring with the least hash (leftmost among equals). Equal windows
pick the same anchor offset, so a window can only repeat where its anchor's gram
does. A count of gram hashes (combined before the shuffle) drops the anchors
whose gram is unique; all others keep their suffix and the bytes before it.

The sort. Tasks sort their suffixes into runs and write them front-coded (common
prefix with the previous one, then the rest). Splitters are taken from the runs'
block heads; blocks are dealt by range, cut where a splitter falls inside. Each
range merges its runs with a loser tree that remembers, for every run, the
common prefix with the last output: known prefixes are never compared again, and
the merge yields the common prefix of neighbours for free.

What repeats. In a sorted range suffixes with a common prefix are neighbours.
For every offset d of a window before its anchor, windows are equal if the
suffixes share LENGTH - d bytes and the d bytes before are equal; the runs'
prefixes and a hash of the bytes before decide it for a whole range at once.
Classes that reach a range's border (a hot passage may fill many ranges) are
settled by a count of their windows' hashes over all ranges.

Copies cost little: in a run, anchors with the same bytes around them are one
entry. Nothing is capped, and no group is gathered. Hashes have 64 bits.

Null or empty texts, and texts below LENGTH bytes, keep all bytes. Rows that
repeat id and text are documents of their own (and copies of each other).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.llm import tokens as W
from textforge.llm.registry import register, table
from textforge.llm.scratch import materialise

LENGTH = 200
GRAM = 64
#: Bits of the filter of repeated grams: a fixed size; false positives cost time only.
FILTER_BITS = 26
#: Suffixes per run, per block of a run, and per merged range, about.
RUN, BLOCK, RANGE = 1 << 16, 2048, 1 << 15
_SPAN = LENGTH - GRAM           # a window begins at most this far before its anchor
_KEY = LENGTH + _SPAN           # sort key: the suffix, then the bytes before it, backwards
#: Bytes of text taken at a time: the anchors' working arrays are about a hundred times as large.
_PIECE = 1 << 18
_U = np.uint64


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, piece offsets, text index, offset in the text): texts together up
    to _PIECE bytes; a longer one cut to pieces of that size that overlap by
    LENGTH - 1, so that every window is in exactly one piece."""
    data, offsets = W.buffer_of(texts)
    for lo, hi in W.slices(offsets, _PIECE):
        if offsets[hi] - offsets[lo] <= _PIECE:
            a = offsets[lo]
            yield data[a: offsets[hi]], offsets[lo: hi + 1] - a, np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            continue
        at, end = int(offsets[lo]), int(offsets[hi])
        while end - at >= LENGTH:
            stop = min(end, at + _PIECE + LENGTH - 1)
            yield data[at:stop], np.array([0, stop - at]), np.array([lo]), np.array([at - int(offsets[lo])])
            at += _PIECE


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every position (prefix sums)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.empty(n, _U)
    step = W.SEGMENT
    for a in range(0, n, step):
        b = min(n, a + step)
        pw, inv = W.powers(b - a + GRAM + 1)
        sums = np.zeros(b - a + GRAM, _U)
        with np.errstate(over="ignore"):
            np.cumsum(W.CODES[data[a: b + GRAM - 1]] * pw[: b - a + GRAM - 1], out=sums[1:])
            out[a:b] = W.mix((sums[GRAM:] - sums[:-GRAM]) * inv[: b - a])
    return out


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, piece, gram hash) of every run of
    consecutive windows with one anchor; positions in ``data``."""
    w = _SPAN + 1
    g = _gram_hashes(data)
    n_win = len(data) - LENGTH + 1
    if n_win <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U),)
    # least (hash, position): the leftmost of equal hashes
    key = ((g >> _U(30)) << _U(30)) | np.arange(len(g), dtype=_U)
    pad = (-len(key)) % w
    blocks = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:n_win], ahead[w - 1: w - 1 + n_win])
    anchor = (least & _U((1 << 30) - 1)).astype(np.int64)
    piece = np.searchsorted(offsets, np.arange(n_win), "right") - 1
    inside = np.arange(n_win) + LENGTH <= offsets[piece + 1]
    new = np.ones(n_win, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.ones(n_win, bool)
    ends[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(ends & inside)
    a = anchor[first]
    return a, first, last, piece[first], g[a]


def _repeated_grams(src: DataFrame) -> np.ndarray:
    """The filter (packed bits) of grams at two or more anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, offsets, _, _ in _pieces(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_anchors(data, offsets)[4].view(np.int64))], names=["g"])

    size, part = 1 << FILTER_BITS, 1 << 16
    twice = src.select("text").mapInArrow(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = twice.select(F.pmod("g", F.lit(size)).alias("bit")).select(
        F.floor(F.col("bit") / part).cast("int").alias("block"), F.pmod("bit", F.lit(part)).cast("int").alias("at"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, block = np.zeros(part, bool), 0
        for pdf in batches:
            block = int(pdf["block"].iloc[0])
            row[pdf["at"].to_numpy()] = True
        yield pd.DataFrame({"block": np.array([block], np.int32), "bits": [np.packbits(row).tobytes()]})

    out = np.zeros((size // part, part // 8), np.uint8)
    for r in bits.distinct().groupBy("block").applyInPandas(pack, "block int, bits binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)   # size / 8 bytes in all
    return out.ravel()


# --- sorted runs -------------------------------------------------------------

#: What an entry carries beside its key: document key, anchor offset, least and
#: greatest d of its windows, and whether its run held a copy of it.
_META = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("at", "<i8"), ("lo", "u1"), ("hi", "u1"), ("copied", "u1")])


def _keys(data: np.ndarray, offsets: np.ndarray, piece: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Sort keys as rows of bytes; beyond a piece's ends the bytes are zero."""
    def side(at: np.ndarray) -> np.ndarray:
        ok = (at >= offsets[piece][:, None]) & (at < offsets[piece + 1][:, None])
        return np.where(ok, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)
    right = side(anchor[:, None] + np.arange(LENGTH)[None, :])
    left = side(anchor[:, None] - 1 - np.arange(_SPAN)[None, :])
    return np.concatenate([right, left], 1)


def _common(rows: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def encode_block(keys: np.ndarray, meta: np.ndarray) -> bytes:
    """Front-coded keys and their meta data."""
    lcp = _common(keys)
    rest = keys[np.arange(keys.shape[1])[None, :] >= lcp[:, None]]
    return zlib.compress(lcp.astype("<u2").tobytes() + meta.tobytes() + rest.tobytes(), 1)


def decode_block(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, common prefixes, meta)."""
    raw = zlib.decompress(raw)
    lcp = np.frombuffer(raw, "<u2", n).astype(np.int64)
    meta = np.frombuffer(raw, _META, n, 2 * n)
    rest = np.frombuffer(raw, np.uint8, -1, 2 * n + n * _META.itemsize)
    keys = np.zeros((n, _KEY), np.uint8)
    own = np.arange(_KEY)[None, :] >= lcp[:, None]
    keys[own] = rest
    # a byte that is not a row's own is that of the last row before it that owns the column
    source = np.maximum.accumulate(np.where(own, np.arange(n)[:, None], 0), 0)
    return np.take_along_axis(keys, source, 0), lcp, meta


def _runs(src: DataFrame, bits: np.ndarray) -> DataFrame:
    """(kind, run, seq, n, first, blob, k1, k2, lo, hi): blocks of sorted runs;
    and intervals [lo, hi) that a copy inside its run already settles (blob null)."""
    shared = src.sparkSession.sparkContext.broadcast(bits)
    names = ["run", "seq", "n", "first", "blob", "k1", "k2", "lo", "hi"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def emit(run_id: int, keys: list, meta: list) -> Iterator[pa.RecordBatch]:
        k, m = np.concatenate(keys), np.concatenate(meta)
        keys.clear()                                  # else a run is held three times
        order = np.argsort(k.view(f"S{_KEY}").ravel(), kind="stable")
        k, m = k[order], m[order]
        # entries with equal bytes and equal windows are copies of each other
        same = np.zeros(len(k), bool)
        same[1:] = (_common(k)[1:] == _KEY) & (m["lo"][1:] == m["lo"][:-1]) & (m["hi"][1:] == m["hi"][:-1])
        group = np.cumsum(~same) - 1
        many = np.bincount(group)[group] > 1
        lo, hi = m["at"] - m["hi"], m["at"] - m["lo"] + LENGTH
        n = int(many.sum())
        if n:
            none = [None] * n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                [none, none, none, none, none, m["k1"][many], m["k2"][many], lo[many], hi[many]], types)], names=names)
        k, m = k[~same], m[~same].copy()
        m["copied"] = many[~same]
        for s in range(0, len(k), BLOCK):
            kb, mb = k[s: s + BLOCK], m[s: s + BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                [run_id, s // BLOCK, len(kb), kb[0].tobytes(), encode_block(kb, mb), None, None, None, None], types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        repeated, size = shared.value, 1 << FILTER_BITS
        run_id, keys, meta, held = TaskContext.get().partitionId() << 24, [], [], 0
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for data, offsets, text, base in _pieces(b.column(2)):
                a, first, last, piece, g = _anchors(data, offsets)
                bit = g.view(np.int64) % size
                hit = np.flatnonzero((repeated[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1)
                for s in range(0, len(hit), 1 << 12):
                    h = hit[s: s + (1 << 12)]
                    m = np.zeros(len(h), _META)
                    doc = text[piece[h]]
                    m["k1"], m["k2"] = k1[doc], k2[doc]
                    m["at"] = a[h] - offsets[piece[h]] + base[piece[h]]
                    m["lo"], m["hi"] = a[h] - last[h], a[h] - first[h]
                    keys.append(_keys(data, offsets, piece[h], a[h]))
                    meta.append(m)
                    held += len(h)
                    if held >= RUN:
                        yield from emit(run_id, keys, meta)
                        run_id, keys, meta, held = run_id + 1, [], [], 0
        if held:
            yield from emit(run_id, keys, meta)

    schema = "run long, seq int, n int, first binary, blob binary, k1 long, k2 int, lo long, hi long"
    return src.mapInArrow(run, schema)


def _dealt(blocks: DataFrame, splitters: list[bytes]) -> DataFrame:
    """(part, run, seq, n, blob): blocks by range, cut at the splitters."""
    shared = blocks.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(shared.value, f"S{_KEY}")
        names = ["part", "run", "seq", "n", "blob"]
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(2)[i].as_py()
                keys, _, meta = decode_block(b.column(3)[i].as_py(), n)
                part = np.searchsorted(cuts, keys.view(f"S{_KEY}").ravel(), "right")
                edges = np.flatnonzero(np.diff(part)) + 1
                for s, e in zip(np.append(0, edges), np.append(edges, n)):
                    blob = b.column(3)[i].as_py() if e - s == n else encode_block(keys[s:e], meta[s:e])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(part[s])], pa.int32()), b.column(0).slice(i, 1), b.column(1).slice(i, 1),
                         pa.array([int(e - s)], pa.int32()), pa.array([blob], pa.binary())], names=names)

    return blocks.select("run", "seq", "n", "blob").mapInArrow(run, "part int, run long, seq int, n int, blob binary")


class LoserTree:
    """Merges sorted runs of byte strings with their common prefixes.

    Every waiting head knows its common prefix with the last output. The longer
    one is the smaller string; only equal ones are compared, from there on."""

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.width = 1 << max(0, len(runs) - 1).bit_length()
        self.lcp = [0] * self.width              # with the last output
        self.losers = [0] * self.width
        self.winner = self._play(1)

    def _head(self, r: int) -> bytes | None:
        return self.runs[r][0][self.at[r]] if r < len(self.runs) and self.at[r] < len(self.runs[r][0]) else None

    def _beats(self, r: int, s: int) -> bool:
        """Whether run r's head comes out before run s's; updates the loser's prefix."""
        a, b = self._head(r), self._head(s)
        if a is None or b is None:
            return b is None and (a is not None or r < s)
        i, j = self.lcp[r], self.lcp[s]
        if i != j:
            return i > j
        n = len(a)
        while i < n and a[i:i + 32] == b[i:i + 32]:
            i += 32
        if i >= n:
            first = r < s
            self.lcp[s if first else r] = n
            return first
        while a[i] == b[i]:
            i += 1
        first = a[i] < b[i]
        self.lcp[s if first else r] = i
        return first

    def _play(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index in it, common prefix with the output before)."""
        while self._head(self.winner) is not None:
            r = self.winner
            yield r, self.at[r], self.lcp[r]
            self.at[r] += 1
            if self.at[r] < len(self.runs[r][0]):
                self.lcp[r] = self.runs[r][1][self.at[r]]    # with its own predecessor, the last output
            node = (r + self.width) >> 1
            while node:
                if self._beats(self.losers[node], r):
                    self.losers[node], r = r, self.losers[node]
                node >>= 1
            self.winner = r


def merge(blocks: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, common prefixes, meta) of the merged blocks (run, seq, n, blob)."""
    by_run: dict[int, list] = {}
    for run, seq, n, blob in sorted(blocks, key=lambda x: x[:2]):
        by_run.setdefault(run, []).append(decode_block(blob, n))
    keys, metas, runs, base = [], [], [], []
    total = 0
    for parts in by_run.values():
        k = np.concatenate([p[0] for p in parts])
        lcp = np.concatenate([p[1] for p in parts])
        heads = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
        for h in heads[1:]:                                  # a block's first entry was stored whole
            lcp[h] = _common(k[h - 1: h + 1])[1]
        raw = k.tobytes()
        runs.append(([raw[i: i + _KEY] for i in range(0, len(raw), _KEY)], lcp.tolist()))
        keys.append(k)
        metas.append(np.concatenate([p[2] for p in parts]))
        base.append(total)
        total += len(k)
    order, lcp = np.empty(total, np.int64), np.empty(total, np.int64)
    for i, (r, j, c) in enumerate(LoserTree(runs)):
        order[i], lcp[i] = base[r] + j, c
    return np.concatenate(keys)[order], lcp, np.concatenate(metas)[order]


# --- repeated windows ---------------------------------------------------------

def _repeats(keys: np.ndarray, lcp: np.ndarray, meta: np.ndarray, low: bytes | None, high: bytes | None):
    """For a sorted range: (dup, open): bool matrices [entry, d]; and the hash of
    each entry's window at d, as a function."""
    n = len(keys)
    right = np.minimum(lcp, LENGTH)
    dup, open_ = np.zeros((n, _SPAN + 1), bool), np.zeros((n, _SPAN + 1), bool)
    border = np.zeros(n, np.int64)
    for cut in (low, high):
        if cut is not None:
            c = np.frombuffer(cut, np.uint8)[:LENGTH]
            differ = keys[:, :LENGTH] != c[None, :]
            border = np.maximum(border, np.where(differ.any(1), differ.argmax(1), LENGTH))
    before = np.zeros(n, _U)
    hashes = np.empty((n, _SPAN + 1), _U)
    for d in range(_SPAN + 1):
        if d:
            with np.errstate(over="ignore"):
                before = before * _U(0x9E3779B97F4A7C15) + W.CODES[keys[:, LENGTH + d - 1]]
        hashes[:, d] = before
        ok = (meta["lo"] <= d) & (d <= meta["hi"])
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        same_right = np.cumsum(right < LENGTH - d)
        left = W.mix(before + _U(d))
        order = np.lexsort((left[at], same_right[at]))
        r, l_ = same_right[at][order], left[at][order]
        new = np.ones(len(at), bool)
        new[1:] = (r[1:] != r[:-1]) | (l_[1:] != l_[:-1])
        group = np.cumsum(new) - 1
        size = np.bincount(group) + np.bincount(group, meta["copied"][at][order])
        dup[at[order], d] = size[group] > 1
        open_[at, d] = border[at] >= LENGTH - d
    return dup, open_, hashes


def _window_hashes(keys: np.ndarray, before: np.ndarray, entry: np.ndarray, d: np.ndarray) -> np.ndarray:
    """A hash of the window at offset d of each entry: the bytes before, as
    hashed on the way, and the first LENGTH - d bytes of the suffix."""
    out = np.empty(len(entry), _U)
    pw, _ = W.powers(LENGTH + 1)
    for s in range(0, len(entry), 1 << 13):
        e, x = entry[s: s + (1 << 13)], d[s: s + (1 << 13)]
        with np.errstate(over="ignore"):
            sums = np.cumsum(W.CODES[keys[e, :LENGTH]] * pw[None, :LENGTH], 1)
            out[s: s + len(e)] = W.mix(W.mix(sums[np.arange(len(e)), LENGTH - 1 - x]) + before[e, x] * _U(3) + x.astype(_U))
    return out


def _intervals(meta: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k1, k2, lo, hi): the bytes of the marked windows, runs of d united."""
    padded = np.zeros((marks.shape[0], marks.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marks
    step = np.diff(padded, axis=1)
    entry, first = np.nonzero(step == 1)
    _, after = np.nonzero(step == -1)
    at = meta["at"][entry]
    return meta["k1"][entry], meta["k2"][entry], at - (after - 1), at - first + LENGTH


_FOUND = "k1 long, k2 int, lo long, hi long, h long, settled boolean"


def _ranges(dealt: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Per range: settled intervals (h null), and the windows that only a look
    at other ranges can settle: (h, one member's interval, settled here)."""
    shared = dealt.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts, blocks, part = shared.value, [], 0
        for pdf in batches:
            part = int(pdf["part"].iloc[0])
            blocks += list(zip(pdf["run"], pdf["seq"], pdf["n"], pdf["blob"]))
        keys, lcp, meta = merge(blocks)
        full = lambda x: x.ljust(_KEY, b"\0")
        low = full(cuts[part - 1]) if part else None
        high = full(cuts[part]) if part < len(cuts) else None
        dup, open_, before = _repeats(keys, lcp, meta, low, high)
        frame = lambda *c: pd.DataFrame(dict(zip(("k1", "k2", "lo", "hi", "h", "settled"), c)))
        live = meta["copied"] == 0                    # the others' intervals are out already
        k1, k2, lo, hi = _intervals(meta[live], dup[live])
        yield frame(k1, k2, lo, hi, pd.array([None] * len(k1), "Int64"), np.ones(len(k1), bool))
        near = np.flatnonzero(open_.any(1))
        for s in range(0, len(near), 1 << 10):
            e, x = np.nonzero(open_[near[s: s + (1 << 10)]])
            e = near[s: s + (1 << 10)][e]
            h = _window_hashes(keys, before, e, x).view(np.int64)
            settled = dup[e, x]
            keep = np.ones(len(e), bool)              # of a settled class one row is enough
            keep[settled] = False
            keep[np.flatnonzero(settled)[np.unique(h[settled], return_index=True)[1]]] = True
            at = meta["at"][e] - x
            yield frame(meta["k1"][e][keep], meta["k2"][e][keep], at[keep], (at + LENGTH)[keep],
                        pd.array(h[keep], "Int64"), settled[keep])

    return dealt.groupBy("part").applyInPandas(run, _FOUND)


def repeated_intervals(src: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): byte ranges to remove, of documents by their key;
    ``src`` has (k1, k2, text)."""
    blocks = materialise(_runs(src, _repeated_grams(src)), "suffix-runs")
    inside = blocks.where("blob is null").select("k1", "k2", "lo", "hi")
    blocks = blocks.where("blob is not null")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // RANGE))
    # about 16 block heads a range; they are evenly spaced in the runs
    heads = blocks.agg(F.count(F.lit(1))).first()[0] or 0
    every = max(1, heads // (16 * parts))
    sample = [bytes(r["first"]).rstrip(b"\0") for r in blocks.where(F.pmod(F.xxhash64("run", "seq"), F.lit(every)) == 0).select(
        "first").toLocalIterator()]
    sample.sort()
    splitters = sorted({sample[len(sample) * i // parts] for i in range(1, parts)} - {b""}) if sample else []
    found = materialise(_ranges(_dealt(blocks, splitters), splitters), "suffix-repeats")
    known = found.where("h is null").select("k1", "k2", "lo", "hi")
    doubt = found.where("h is not null")
    # a class that is settled in one range, or has members in two, repeats
    twice = doubt.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("settled").alias("s")).where("n > 1 or s").select("h")
    across = doubt.where("not settled").join(twice, "h", "left_semi").select("k1", "k2", "lo", "hi")
    return inside.unionByName(known).unionByName(across)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept binary])."""
    key = [F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"), F.hash(F.col(text_col)).alias("k2")]
    src = docs.select(F.col(id_col).alias("id"), *key, F.col(text_col).cast("string").alias("text"))
    # a document's ranges: as many as its length allows
    cuts = repeated_intervals(src.select("k1", "k2", "text")).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    both = src.join(cuts, ["k1", "k2"], "left").select("id", "text", "cuts")
    fields = [T.StructField(id_col, src.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
              T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    if keep_text:
        fields.append(T.StructField("kept", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, digest, kept = [], [], [], [], []
            for t, c in zip(b.column(1), b.column(2)):
                raw = (t.as_py() or "").encode()
                out, n, at, k = [], 0, 0, 0
                last = -1
                for lo, hi in sorted((x["lo"], x["hi"]) for x in c.as_py() or ()):
                    if lo > last:                       # a span that does not touch the one before
                        k += 1
                        out.append(raw[at:lo])
                    n += hi - max(lo, at) if hi > at else 0
                    at, last = max(at, hi), max(last, hi)
                out.append(raw[at:])
                rest = b"".join(out)
                size.append(len(raw))
                gone.append(n)
                spans.append(k)
                digest.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    kept.append(rest)
            cols = [b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()),
                    pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if keep_text else []),
                                             names=[f.name for f in fields])

    return both.mapInArrow(run, T.StructType(fields))


@register("op7_suffix_dedup")
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), keep_text=False)
