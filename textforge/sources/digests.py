"""MD5 of files of any size, no file read by one task or held in one row.

Spark's ``text`` reader cuts a file into splits and hands on every byte but the
line ends, so each split gives its part of the file. MD5 is a chain: a round
digests the next RANGE bytes of all files, from the states the round before left.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textforge.session import scratch_path

#: Bytes of a file that one round digests (and one more split at most), and bytes of a row.
RANGE, ROW = 1 << 28, 1 << 20
#: What Hadoop's readers unpack by the name's end; such a file is not splittable either.
PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|passthrough)$"
_BOM = b"\xef\xbb\xbf"


def _library() -> ctypes.CDLL | None:
    """OpenSSL's MD5, whose state is plain bytes (``hashlib`` cannot store its own);
    None where Python is built without."""
    try:
        import _hashlib
        lib = ctypes.CDLL(_hashlib.__file__)
        lib.MD5_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        lib.MD5_Init.argtypes = [ctypes.c_void_p]
        lib.MD5_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
        return lib
    except (ImportError, OSError, AttributeError):
        return None


class Md5:
    """An MD5 that can be put down and taken up again."""

    _SIZE = 92                                       # MD5_CTX: 23 words of 32 bits

    def __init__(self, lib: ctypes.CDLL, state: bytes | None = None):
        self._lib, self._ctx = lib, ctypes.create_string_buffer(state or b"", self._SIZE)
        if state is None:
            lib.MD5_Init(self._ctx)

    def update(self, data: bytes) -> None:
        self._lib.MD5_Update(self._ctx, data, len(data))

    def state(self) -> bytes:
        return self._ctx.raw

    def hexdigest(self) -> str:
        last, out = ctypes.create_string_buffer(self._ctx.raw, self._SIZE), ctypes.create_string_buffer(16)
        self._lib.MD5_Final(out, last)
        return out.raw.hex()


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each split, in rows of about ROW bytes. A line end belongs to
    the line after it: whether the file ends with one is not known here."""
    names = ["file", "block", "seq", "data"]
    at, seq = None, 0

    def row(parts: list[bytes]) -> pa.RecordBatch:
        file, block = at
        return pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([seq], pa.int64()), pa.array([b"\n".join(parts)], pa.binary())],
            names=names)

    held, size = [], 0
    for b in batches:
        for file, block, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (file, block) != at:
                if held:
                    yield row(held)
                at, seq, held, size = (file, block), 0, [] if block == 0 else [b""], 0
            elif size > ROW:
                yield row(held)
                seq, held, size = seq + 1, [b""], 0
            held.append(line)
            size += len(line) + 1
    if held:
        yield row(held)


def _digest(batches: Iterator[pa.RecordBatch], stepped: bool) -> Iterator[pa.RecordBatch]:
    """(file, state, md5) from rows (file, block, seq, data) in order; a file's
    row of block -2 is the state to go on from."""
    lib, file, md5 = _library() if stepped else None, None, None
    if stepped and lib is None:
        raise RuntimeError("the driver's Python has OpenSSL's MD5, this worker's has not")

    def out() -> pa.RecordBatch:
        state = md5.state() if lib else None
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([state], pa.binary()), pa.array([md5.hexdigest()])],
                                          names=["file", "state", "md5"])

    for b in batches:
        for name, block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
            if name != file:
                if file is not None:
                    yield out()
                file, md5 = name, Md5(lib) if lib else hashlib.md5(usedforsecurity=False)
            if block == -2:
                md5 = Md5(lib, data.as_py())
            else:
                md5.update(data.as_py())
    if file is not None:
        yield out()


def file_digests(listing: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, md5) of the files (file, size) of ``listing``; ``lines`` are theirs:
    (file, block, line), each split's in order."""
    rows = _stored(lines.mapInArrow(_rows, "file string, block long, seq long, data binary"), "manifest-bytes")
    found = rows.groupBy("file").agg(F.sum(F.length("data")).alias("n"), F.max("block").alias("last"))
    sizes = _stored(listing.join(found, "file", "left").select(
        "file", "size", F.coalesce("last", F.lit(0)).alias("last"), (F.col("size") - F.coalesce("n", F.lit(0))).alias("off")), "manifest-sizes")
    # the readers drop the last line end and a byte order mark at the start, nothing else
    odd = sizes.where(~F.col("off").isin(0, 1, 3, 4)).first()
    if odd:
        raise ValueError(f"{odd['file']}: {odd['off']} of {odd['size']} bytes were not read; did it change?")
    extra = lambda off, block, data: sizes.where(F.col("off").isin(*off)).select(
        "file", block.cast("long").alias("block"), F.lit(1 << 62).alias("seq"), F.lit(data).alias("data"))
    rows = rows.unionByName(extra((3, 4), F.lit(-1), _BOM)).unionByName(extra((1, 4), F.col("last"), b"\n"))
    most, total = sizes.agg(F.max("last"), F.sum("size")).first()
    stepped = _library() is not None                 # else each file is one chain of rows, in a single round
    parts = max(1, (total or 0) // RANGE)
    done = None
    for r in range((most or 0) // RANGE + 1 if stepped else 1):
        now = rows
        if stepped:
            lo = F.col("block") >= r * RANGE if r else F.lit(True)
            now = rows.where(lo & (F.col("block") < (r + 1) * RANGE))
        if done is not None:
            now = now.unionByName(done.select("file", F.lit(-2).cast("long").alias("block"), F.lit(0).cast("long").alias("seq"),
                                              F.col("state").alias("data")))
        done = _stored(now.repartition(parts, "file").sortWithinPartitions("file", "block", "seq").mapInArrow(
            lambda batches: _digest(batches, stepped), "file string, state binary, md5 string"), "manifest-states")
    return listing.select("file").join(done, "file", "left").select(
        "file", F.coalesce("md5", F.lit(hashlib.md5(b"", usedforsecurity=False).hexdigest())).alias("md5"))
