"""Maximal byte runs of Arrow text batches: the runs of a class of bytes, their
grouping by hash and their strings, as a handful of numpy passes a slice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def run_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes and the row of each;
    ``offsets`` are the rows' ends, which no run crosses."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, heads): a stable sort of ``keys`` and where each distinct key begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]]))
    return order, heads


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a string column, with ASCII capitals lower-cased."""
    size = ends - starts
    offs = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    flat = np.repeat(starts - offs[:-1], size) + np.arange(int(offs[-1]))
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs.tobytes()), pa.py_buffer(_LOWER[data[flat]].tobytes()))
