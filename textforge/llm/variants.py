"""Spelling variants through a trie of letter-group counts.

A word's letters are counted by group (GROUPS); the words, ordered by these
counts, form a trie whose i-th level is the count of the i-th group. One
inserted letter raises one count by one (a surplus), one deleted letter lowers
one (a deficit), one replaced letter does either nothing or both. So the words
near a word lie where a depth-first search gets that may spend one surplus and
one deficit on its way down; the few words of the leaves it reaches are compared
letter by letter.

Spark's part. The words counted over all texts are a table. The trie's upper
part, the nodes with more than ``limit`` words and their children, is counted
level by level; it holds at most NODES nodes a level and FANOUT children each,
whatever the vocabulary, and goes to every task. Neighbouring children are
packed into bins of about ``limit`` words. A word goes to its own bin and to
those later ones that its search can reach, so each pair of words meets once; a
task builds the trie of one bin and searches it with all words that came. Only
(word, near words, best near word) leaves the task.

Null text: no words. A null id reads as the empty string. Repeated rows and ids
count each time; an empty table, or one without any frequent word, gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textforge.llm.registry import register, table
from textforge.llm.runs import grouped, run_bounds, strings
from textforge.llm.scratch import materialise
from textforge.llm.tokens import buffer_of, hash_words, slices

MIN_LETTERS, MIN_COUNT = 5, 3
#: A run whose checksum this divides loses a letter; a form has at least this many times a word's count.
DROP, RATIO = 97, 2
#: Letter groups, one a trie level: ASCII letters, then the capitals and two halves of the accented letters.
GROUPS = ("e", "n", "t", "i", "r", "a", "s", "o", "h", "d", "l", "u", "c", "m", "g", "b", "f", "p", "wy", "vk", "jqxz",
          "".join(map(chr, range(0xC0, 0xE0))), "".join(map(chr, range(0xE0, 0xF0))), "".join(map(chr, range(0xF0, 0x100))))
#: Counts are cut at FANOUT - 1, which can only let a search pass.
FANOUT = 16
#: Words of a bin at least, nodes above that size a level at most, words of a leaf.
BIN, NODES, LEAF = 4096, 1024, 8
#: Words searched together, search states expanded and letters compared at once, bytes of text counted at once.
QUERIES, STATES, CELLS, SLICE = 4096, 1 << 17, 1 << 22, 8 << 20
#: Runs up to this many bytes have their checksums combined in bulk.
SHORT = 64

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC3] = True
_LEVEL = np.full(256, len(GROUPS), np.uint8)
for _i, _g in enumerate(GROUPS):
    _LEVEL[[ord(c) for c in _g]] = _i


def _shift_tables(longest: int) -> np.ndarray:
    """[length, byte, value]: what a checksum's byte becomes after so many more
    bytes; a checksum is linear, so crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    state = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    out = np.empty((longest + 1, 4, 256), np.uint32)
    for n in range(longest + 1):
        out[n] = state
        state = step[state & 255] ^ (state >> np.uint32(8))
    return out


def checksums(before: np.ndarray, run: np.ndarray, size: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """crc32 of prefix + run from the prefix's crc, the run's crc and the run's bytes."""
    out = run.copy()
    for k in range(4):
        out ^= shift[size, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shift = _shift_tables(SHORT)

    def rows(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    for batch in batches:
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).fill_null("").to_pylist()], np.uint32)
        data, offsets = buffer_of(batch.column(1))
        for lo, hi in slices(offsets, SLICE):
            a = offsets[lo]
            part = data[a: offsets[hi]]
            inside = _LETTER[part]
            inside[1:] |= part[:-1] == 0xC3         # the second byte of a letter beyond ASCII
            starts, ends, doc = run_bounds(inside, offsets[lo: hi + 1] - a)
            if not len(starts):
                continue
            order, heads = grouped(hash_words(part, starts, ends))
            word = np.empty(len(order), np.int64)
            word[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
            first = order[heads]
            texts = strings(part, starts[first], ends[first])
            raw = texts.cast(pa.binary()).to_pylist()
            size = np.array([len(w) for w in raw], np.int64)
            crc = np.array([zlib.crc32(w) for w in raw], np.uint32)
            head = before[lo:hi][doc]
            of = checksums(head, crc[word], np.minimum(size[word], SHORT), shift)
            for i in np.flatnonzero(size[word] > SHORT):
                of[i] = zlib.crc32(raw[word[i]], int(head[i]))
            hit = of % DROP == 0
            accents = np.concatenate([[0], np.cumsum(part == 0xC3)])
            letters = size - (accents[ends[first]] - accents[starts[first]])
            n = np.bincount(word[~hit], minlength=len(first))
            keep = np.flatnonzero((n > 0) & (letters >= MIN_LETTERS))
            yield rows(texts.take(pa.array(keep)), n[keep])
            cut: Counter = Counter()
            for i in np.flatnonzero(hit & (letters[word] > MIN_LETTERS)):
                w = raw[word[i]].decode()
                at = int(of[i]) % len(w)
                cut[w[:at] + w[at + 1:]] += 1
            yield rows(pa.array(list(cut), pa.string()), np.array(list(cut.values()), np.int64))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with at least MIN_LETTERS letters and MIN_COUNT occurrences."""
    read = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return read.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(
        F.col("n") >= MIN_COUNT)


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one byte per letter, offsets) of words whose letters lie below U+0100."""
    data, offsets = buffer_of(words)
    lead = data == 0xC3
    after = np.concatenate([[False], lead[:-1]]) if len(data) else lead
    codes = np.where(after, data + np.uint8(0x40), data)[~lead]
    return codes, offsets - np.concatenate([[0], np.cumsum(lead)])[offsets]


def vectors(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[word, level]: letters of each group, cut at FANOUT - 1."""
    n, width = len(offsets) - 1, len(GROUPS) + 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(row * width + _LEVEL[codes], minlength=n * width).reshape(n, width)
    return np.minimum(counts[:, :-1], FANOUT - 1).astype(np.uint8)


def _with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = vectors(*letters_of(b.column("word"))) + np.uint8(ord("a"))
        path = pa.array([bytes(r).decode() for r in v], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), path], names=["word", "n", "path"])


class Directory:
    """The trie's upper part: children[node, count] is a node or -1, bins[node]
    the bin of a node without children here (else -1)."""

    def __init__(self, words: DataFrame, limit: int):
        """``words`` has a column path, one character a level."""
        cut: dict[str, int] = {"": 0}
        big = [""]
        for level in range(1, len(GROUPS) + 1):
            up = F.substring("path", 1, level - 1)
            rows = words.where(up.isin(big)).groupBy(F.substring("path", 1, level).alias("p")).count().collect()
            for b in big:
                cut.pop(b)
            cut.update((r["p"], r["count"]) for r in rows)
            big = [r["p"] for r in rows if r["count"] > limit]
            if not big:
                break
        self._index(cut, limit)

    def _index(self, cut: dict[str, int], limit: int) -> None:
        nodes = {"": 0}
        for p in cut:
            for k in range(1, len(p) + 1):
                nodes.setdefault(p[:k], len(nodes))
        self.children = np.full((len(nodes), FANOUT), -1, np.int32)
        self.bins = np.full(len(nodes), -1, np.int32)
        for p, i in nodes.items():
            if p:
                self.children[nodes[p[:-1]], ord(p[-1]) - ord("a")] = i
        at = held = 0
        for p in sorted(cut):
            if held and held + cut[p] > limit:
                at, held = at + 1, 0
            held += cut[p]
            self.bins[nodes[p]] = at
        self.count = at + 1


class Trie:
    """Words sorted by vector; a node is a range of them, down to LEAF words."""

    def __init__(self, v: np.ndarray):
        self.order = np.lexsort(v.T[::-1])
        v = v[self.order]
        self.lo, self.hi = [np.array([0])], [np.array([len(v)])]
        children = []
        ids, base = np.array([0]), 1
        for level in range(v.shape[1]):
            lo, hi = self.lo[-1], self.hi[-1]
            table = np.full((len(ids), FANOUT), -1, np.int32)
            inner = np.flatnonzero(hi - lo > LEAF)
            children.append(table)
            if not len(inner):
                break
            size = (hi - lo)[inner]
            owner = np.repeat(inner, size)
            at = np.repeat(lo[inner] - np.cumsum(size) + size, size) + np.arange(size.sum())
            count = v[at, level]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (count[1:] != count[:-1])]))
            table[owner[new], count[new]] = base + np.arange(len(new))
            self.lo.append(at[new])
            self.hi.append(at[np.append(new[1:], len(at)) - 1] + 1)
            ids, base = base + np.arange(len(new)), base + len(new)
        while len(children) < len(self.lo):
            children.append(np.full((len(self.lo[len(children)]), FANOUT), -1, np.int32))
        self.children = np.concatenate(children)
        self.lo, self.hi = np.concatenate(self.lo), np.concatenate(self.hi)
        self.leaf = (self.children < 0).all(1)


def reach(children: np.ndarray, leaf: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, leaf node) pairs that a search spending one surplus and one
    deficit gets to. Depth first over blocks of at most STATES states."""
    n = len(v)
    stack = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int8))]
    while stack:
        level, q, node, more, less = stack.pop()
        at = leaf[node]
        if at.any():
            yield q[at], node[at]
            q, node, more, less = q[~at], node[~at], more[~at], less[~at]
        if not len(q):
            continue
        have, got = v[q, level].astype(np.int64), []
        for step, can in ((0, None), (1, more == 0), (-1, less == 0)):
            to = have + step
            ok = (to >= 0) & (to < FANOUT) if can is None else can & (to >= 0) & (to < FANOUT)
            i = np.flatnonzero(ok)
            child = children[node[i], to[i]]
            i, child = i[child >= 0], child[child >= 0]
            got.append((q[i], child, more[i] + (step == 1), less[i] + (step == -1)))
        q, node, more, less = (np.concatenate(x) for x in zip(*got))
        for lo in range(0, len(q), STATES):
            s = slice(lo, lo + STATES)
            stack.append((level + 1, q[s], node[s].astype(np.int64), more[s].astype(np.int8), less[s].astype(np.int8)))


def one_apart(codes: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a[i] and b[i] differ by one inserted, deleted or replaced letter."""
    size = np.diff(offsets)
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), bool)
    near = np.flatnonzero(size[b] - size[a] <= 1)
    near = near[np.argsort(size[b[near]], kind="stable")]
    codes = np.append(codes, np.uint8(0))
    lo = 0
    while lo < len(near):
        # like lengths together, so a chunk is as wide as its own words
        step = max(1, CELLS // max(1, int(size[b[near[lo]]]) + 1))
        hi = min(len(near), lo + step)
        while hi > lo + 1 and (hi - lo) * (int(size[b[near[hi - 1]]]) + 1) > 2 * CELLS:
            hi = lo + (hi - lo) // 2
        x, y = a[near[lo:hi]], b[near[lo:hi]]
        width = int(size[y[-1]]) + 1
        col = np.arange(width)

        def matrix(w: np.ndarray) -> np.ndarray:
            inside = col < size[w][:, None]
            return np.where(inside, codes[np.where(inside, offsets[w][:, None] + col, 0)], np.uint8(0))
        s, t = matrix(x), matrix(y)
        differ = s != t
        same_size = size[x] == size[y]
        first = differ.argmax(1)[:, None]
        moved = np.ones_like(differ)
        moved[:, :-1] = (s[:, :-1] == t[:, 1:]) | (col[:-1] < first)
        out[near[lo:hi]] = np.where(same_size, differ.sum(1) == 1, moved.all(1) & differ.any(1))
        lo = hi
    return out


def _send(directory: Directory):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = directory.bins >= 0
        for b in batches:
            v = vectors(*letters_of(b.column("word")))
            home = np.empty(len(v), np.int64)
            node = np.zeros(len(v), np.int64)
            for level in range(len(GROUPS)):
                inner = np.flatnonzero(~leaf[node])
                if not len(inner):
                    break
                node[inner] = directory.children[node[inner], v[inner, level]]
            home[:] = directory.bins[node]
            pairs = [np.stack([q, directory.bins[at]]) for q, at in reach(directory.children, leaf, v)]
            q, to = np.unique(np.concatenate(pairs, 1), axis=1) if pairs else np.zeros((2, 0), np.int64)
            later = to >= home[q]
            q, to = q[later], to[later]
            at = pa.array(q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), b.column("word").take(at), b.column("n").take(at), pa.array(to == home[q])],
                names=["bin", "word", "n", "home"])
    return send


def _search(rows: pa.Table) -> pa.Table:
    """One bin: every pair of a home word and a word that came, home pairs once."""
    rows = rows.combine_chunks()
    word = rows.column("word").combine_chunks() if isinstance(rows.column("word"), pa.ChunkedArray) else rows.column("word")
    rank = np.empty(len(word), np.int64)
    rank[pa.compute.sort_indices(word).to_numpy()] = np.arange(len(word))
    n, home = rows.column("n").to_numpy(), np.flatnonzero(rows.column("home").to_numpy())
    codes, offsets = letters_of(word)
    count, best = np.zeros(len(n), np.int64), np.full(len(n), -1, np.int64)
    v = vectors(codes, offsets)
    trie = Trie(v[home])
    place = np.full(len(n), -1, np.int64)       # a home word's place in the trie's order
    place[home[trie.order]] = np.arange(len(home))

    def add(me: np.ndarray, other: np.ndarray) -> None:
        np.add.at(count, me, 1)
        known = np.flatnonzero(best >= 0)       # the best so far stands against the new ones
        known = known[np.isin(known, me)]
        me, other = np.concatenate([me, known]), np.concatenate([other, best[known]])
        order = np.lexsort((rank[other], -n[other], me))
        me, other = me[order], other[order]
        new = np.concatenate([[True], me[1:] != me[:-1]]) if len(me) else np.zeros(0, bool)
        best[me[new]] = other[new]

    for lo in range(0, len(n), QUERIES):
        for q, node in reach(trie.children, trie.leaf, v[lo: lo + QUERIES]):
            size = trie.hi[node] - trie.lo[node]
            q = np.repeat(q + lo, size)
            at = np.repeat(trie.lo[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
            once = at > place[q]
            q, other = q[once], home[trie.order[at[once]]]
            ok = one_apart(codes, offsets, q, other)
            q, other = q[ok], other[ok]
            if len(q):
                add(np.concatenate([q, other]), np.concatenate([other, q]))
    have = np.flatnonzero(count)
    return pa.table({"word": word.take(pa.array(have)), "n_near": count[have],
                     "near": word.take(pa.array(best[have])), "near_n": n[best[have]]})


def near_words(words: DataFrame, limit: int | None = None) -> DataFrame:
    """(word, n, n_near, near, near_n): of each word, how many words are near and the best of them."""
    words = materialise(words.mapInArrow(_with_path, "word string, n long, path string"), "words")
    limit = limit or max(BIN, -(-words.count() // NODES))
    directory = Directory(words, limit)
    sent = words.select("word", "n").mapInArrow(_send(directory), "bin int, word string, n long, home boolean")
    found = sent.groupBy("bin").applyInArrow(_search, "word string, n_near long, near string, near_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("b"))
    return words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.col("b.near").alias("near"), (-F.col("b.col1")).alias("near_n"))


def forms(near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n). Counts at least double on the way
    to a root, so chains are short and never close; roots come by pointer doubling."""
    is_form = F.col("near_n") >= ratio * F.col("n")
    out = materialise(near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near",
                                  F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    links = out.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        links = materialise(links, "roots")
        if links.where("open").limit(1).count() == 0:
            break
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
    return out.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@register("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(near_words(word_counts(table(spark, sf_dir, "documents"))))
