"""Byte-level BPE encoding and decoding.

Two-tier lookup per pre-token: a minimal perfect hash over the vocabulary
resolves pre-tokens that are themselves tokens; the rest go through the merge
procedure, a heap of candidate pairs over doubly linked bytes, so even a
pre-token of a million bytes costs O(n log n). The tables are built once per
Python worker from a rank file (its path is a parameter).

Null or empty text: no tokens, the digest of zero bytes. Documents are encoded
whole and independently, row by row, without an exchange; repeated rows and
null ids keep their own rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.llm.registry import register, table
from textforge.llm.tokens import mix

_MASK = (1 << 64) - 1
#: Entries of a worker's memo of recent pre-tokens (about 200 bytes each).
MEMO_ENTRIES = 1 << 20
#: Longer pre-tokens are not worth a memo entry.
MEMO_BYTES = 64


def _fingerprint(token: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "little")


class PerfectHash:
    """Minimal perfect hash of byte strings by hash-and-displace: each bucket
    stores the displacement that sends its keys to free slots; a slot holds the
    key itself, so a lookup of a foreign string is recognised."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        self.n = n = max(1, len(keys))
        self.n_buckets = max(1, n // per_bucket)
        self.seeds = np.zeros(self.n_buckets, np.int64)
        self.slots: list[bytes | None] = [None] * n
        self.values = np.zeros(n, np.int64)
        prints = [_fingerprint(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.n_buckets)]
        for i, p in enumerate(prints):
            buckets[p % self.n_buckets].append(i)
        taken = np.zeros(n, bool)
        free = iter(())
        for b in sorted(range(self.n_buckets), key=lambda b: -len(buckets[b])):
            members = buckets[b]
            if not members:
                break
            if len(members) == 1:  # the last ones take the free slots directly
                if not isinstance(free, np.ndarray):
                    free, at = np.flatnonzero(~taken), 0
                slots, seed = [int(free[at])], -int(free[at]) - 1
                at += 1
            else:
                seed, slots = self._place([prints[i] for i in members], taken)
            self.seeds[b] = seed
            for i, s in zip(members, slots):
                taken[s], self.slots[s], self.values[s] = True, keys[i], i

    def _place(self, prints: list[int], taken: np.ndarray) -> tuple[int, list[int]]:
        base = np.array(prints, np.uint64)
        seed = 1
        while True:
            tries = np.arange(seed, seed + 64, dtype=np.uint64)
            with np.errstate(over="ignore"):
                cand = mix(base[None, :] + tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)
            cand = cand.astype(np.int64)
            for row, ok in zip(cand, ~taken[cand].any(axis=1)):
                if ok and len(set(row.tolist())) == len(row):
                    return seed, row.tolist()
                seed += 1

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        p = _fingerprint(key)
        seed = int(self.seeds[p % self.n_buckets])
        if seed < 0:
            slot = -seed - 1
        else:
            x = (p + seed * 0x9E3779B97F4A7C15) & _MASK
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
            slot = (x ^ (x >> 31)) % self.n
        return int(self.values[slot]) if self.slots[slot] == key else -1


class Codec:
    """Encoder and decoder over one rank file (token in base64, rank)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        tokens = [base64.b64decode(t) for t, _ in pairs]
        ranks = [int(r) for _, r in pairs]
        self.hash = PerfectHash(tokens)
        self.pair_rank = dict(zip(tokens, ranks)).get      # of merged parts, inside the heap's loop
        self.ranks = np.array(ranks, np.int64)
        size = max(ranks) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, r in zip(tokens, ranks):
            self.bytes_of[r] = t
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def rank(self, token: bytes) -> int:
        """Tier one: the rank of a whole pre-token, or -1."""
        i = self.hash.get(token)
        return int(self.ranks[i]) if i >= 0 else -1

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: lowest-rank-first merges (leftmost among equals). Parts are
        linked by ``after`` and ``before``; part i spans [i, after[i]). A heap
        entry (rank, i, e) is stale unless i and the part after it span [i, e)."""
        n, rank, push = len(piece), self.pair_rank, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after[i]
            if j >= n or after[j] != e:
                continue
            after[i], after[j] = e, n            # part j is gone: nothing follows it
            if e < n:
                before[e] = i
                k = after[e]
                if (r := rank(piece[i:k])) is not None:
                    push(heap, (r, i, k))
            h = before[i]
            if h >= 0 and (r := rank(piece[h:e])) is not None:
                push(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i:after[i]]))
            i = after[i]
        return out

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        r = self.rank(raw)
        found = [r] if r >= 0 else self.merge(raw)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(raw) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        memo, piece = self.memo.get, self.encode_piece
        return b"".join([memo(p) or piece(p) for p in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for this rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: tuple[str, str] | None = None, keep_ids: bool = True) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256[, ids array<int>])."""
    path, pattern = vocabulary or default_vocabulary()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema["id"].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, hashes, backs, ids = [], [], [], []
            for t in b.column(1):
                raw = c.encode(t.as_py() or "")
                n.append(len(raw) // 4)
                hashes.append(hashlib.sha256(raw).hexdigest())
                backs.append(hashlib.sha256(c.decode(raw)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(raw, "<i4"))
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(backs, pa.string())]
            names = [f.name for f in fields]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids",
           vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(id_col, text): the text of an id list; null or empty ids give ''."""
    path, pattern = vocabulary or default_vocabulary()
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            texts = [c.decode(np.array(x.as_py() or [], "<u4").tobytes()).decode("utf-8", "replace")
                     for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, T.StructType([T.StructField(id_col, src.schema["id"].dataType),
                                             T.StructField("text", T.StringType())]))


@register("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)
