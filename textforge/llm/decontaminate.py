"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The seeds of a test item are its pairs of words one or two places apart. One
   pass over all documents counts the documents that hold each seed (again with
   one or two places between the words).
2. A passage is a local alignment (match +2, mismatch -1, gap -1) that scores
   ``threshold`` of a perfect copy, and at least MIN_WORDS matches. Between two
   of its matched words that are further apart than two places lie errors that
   cost as much as a match gains, so a passage of score T has at least
   P = (T - 2) / 2 neighbouring matches, each a seed that begins at another word
   of the item. Hence the rare seeds suffice: half of P of the item's words, those
   whose seeds are the most common, need not be searched at all, and a document
   must hold the other half of P in one neighbourhood.
3. Around such neighbourhoods, as wide as any passage through them, document and
   item are aligned, unless their words leave no room for a passage in any order.
   One table gives all passages of a range, best first, none overlapping.

So the search finds exactly what aligning every document with every item would
find. Items of fewer than MIN_WORDS words are found where all their words stand
in a row, one of a single word only as a whole document.

Words are lower-cased letters and digits; punctuation does not count. In scripts
without blanks every character is a word. The test items are the stated query
set: they are taken in blocks of bounded size (in words), each block against all
documents, so what a task holds never grows with the benchmark. Texts never move:
there is no shuffle but that of the counts.

Null or empty texts and items: no passage. Repeated documents or items are
reported each; null document ids are kept, and rows that share an id are judged
each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textforge.llm import tokens as W
from textforge.llm.registry import register, table
from textforge.llm.runs import run_bounds

#: Places between the two words of a seed.
REACH = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a perfect copy's score.
THRESHOLD = 0.35
#: Words that a passage matches at least; shorter items are found whole or not at all.
MIN_WORDS = 5
#: Bytes of item text whose seeds a task holds at once.
BLOCK_BYTES = 8 << 20
#: Postings of hits that are gathered at once (whole documents, at least one).
PART = 1 << 20
#: Bits of the filter that most words pass by (it lets some seeds through that are none).
FILTER_BITS = 22
_U = np.uint64
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, index of each document's first word and of the end).
    Letters of scripts without blanks (Thai, Lao, Burmese, Khmer, kana, Han) are words each."""
    inside, cuts = _WORD[data], offsets
    lead = np.flatnonzero(data >= 0xE0)
    if len(lead):
        a, b, c = data[lead], data[lead + 1], data[lead + 2]
        # general punctuation, CJK punctuation, full-width marks
        marks = lead[((a == 0xE2) & (b <= 0x81)) | ((a == 0xE3) & (b == 0x80)) | ((a == 0xEF) & (b == 0xBC) & (c <= 0x8F))]
        for k in range(3):
            inside[marks + k] = False
        solo = (((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b >= 0x9E) & (b <= 0x9F)))
                | ((a == 0xE3) & (b >= 0x81)) | ((a >= 0xE4) & (a <= 0xE9)) | ((a == 0xEF) & (b >= 0xA4) & (b <= 0xAB))
                | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xB3)))
        at = lead[solo]
        cuts = np.unique(np.concatenate([offsets, at, at + np.where(data[at] >= 0xF0, 4, 3)]))
    starts, ends, _ = run_bounds(inside, cuts)
    return W.hash_words(data, starts, ends), np.searchsorted(starts, offsets, "left")


def _item_words(text: str | None) -> np.ndarray:
    return words_of(*W.buffer_of(pa.array([text or ""], pa.string())))[0]


def _least(n: int, threshold: float) -> float:
    """The least score of a passage of an item of ``n`` words."""
    return max(threshold * MATCH * n, MATCH * MIN_WORDS)


def _table(item: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every document word, the best score of a local alignment that ends
    with it, and where that alignment starts. Row by row; the gap along a row
    is a running maximum, so rows are vectors."""
    m = len(doc)
    here = np.arange(m + 1)
    ramp = here * -GAP
    prev, origin = np.zeros(m + 1, np.int64), here     # score, and where the local path began
    best, since = np.zeros(m + 1, np.int64), here.copy()
    for w in item:
        diag = prev[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        take_up = up > diag
        cand = np.where(take_up, up, diag)
        src = np.where(take_up, origin[1:], origin[:-1])
        fresh = cand <= 0
        cand[fresh] = 0
        src = np.where(fresh, here[1:], src)
        # gaps in the item: row[j] = max over k <= j of cand[k] + GAP * (j - k)
        lifted = np.concatenate([[0], cand]) + ramp
        run = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == run, here, 0))
        row = run - ramp
        start = np.concatenate([[0], src])[at]
        start = np.where(row <= 0, here, start)
        row = np.maximum(row, 0)
        better = row > best
        best, since = np.where(better, row, best), np.where(better, start, since)
        prev, origin = row, start
    return best, since


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and its document word range [start, end)."""
    best, since = _table(item, doc)
    j = int(best.argmax())
    return (int(best[j]), int(since[j]), j) if best[j] else (0, 0, 0)


def _pairs(h: np.ndarray, reach: int) -> np.ndarray:
    """Hash of every word with the one ``reach`` places on."""
    with np.errstate(over="ignore"):
        return W.mix(h[:-reach] * _U(0xD6E8FEB86659FD93) + h[reach:] + _U(1))


def _hits(h: np.ndarray, first: np.ndarray, keys: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word position, index in ``keys``) of every seed inside one
    document, by document; ``may`` holds a bit per leading bits of a key."""
    got = []
    for reach in REACH:
        g = _pairs(h, reach)
        pos = np.flatnonzero(may[(g >> _U(64 - FILTER_BITS)).astype(np.int64)])
        at = np.searchsorted(keys, g[pos])
        ok = keys[np.minimum(at, len(keys) - 1)] == g[pos]
        pos, at = pos[ok], at[ok]
        doc = np.searchsorted(first, pos, "right") - 1
        inside = pos + reach < first[doc + 1]
        got.append((doc[inside], pos[inside], at[inside]))
    doc, pos, at = (np.concatenate(x) for x in zip(*got))
    order = np.argsort(doc, kind="stable")
    return doc[order], pos[order], at[order]


def _filter(keys: np.ndarray) -> np.ndarray:
    may = np.zeros(1 << FILTER_BITS, bool)
    may[(keys >> _U(64 - FILTER_BITS)).astype(np.int64)] = True
    return may


def _seed_counts(docs: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """How many documents hold each seed (sorted, distinct)."""
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        total, may = np.zeros(len(table_), np.int64), _filter(table_)
        for b in batches:
            data, offsets = W.buffer_of(b.column(0))
            for lo, hi in W.slices(offsets):
                a = offsets[lo]
                h, first = words_of(data[a: offsets[hi]], offsets[lo: hi + 1] - a)
                doc, _, at = _hits(h, first, table_, may)
                pairs = np.unique(at * np.int64(hi - lo) + doc)
                np.add.at(total, pairs // (hi - lo), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["seed", "k"])

    rows = docs.mapInArrow(run, "seed long, k long").groupBy("seed").agg(F.sum("k").alias("k")).toPandas()
    out = np.zeros(len(seeds), np.int64)
    out[rows["seed"].to_numpy(np.int64)] = rows["k"].to_numpy(np.int64)
    return out


def _windows(doc: np.ndarray, item: np.ndarray, start: np.ndarray, n_item: np.ndarray, n_doc: np.ndarray,
             slack: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(document, item, word range to align) where enough hits say that the item
    may start nearby: as far as a passage may reach, overlapping ranges united."""
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    lo, hi = np.maximum(0, start - slack[item]), np.minimum(n_doc[doc], start + n_item[item] + slack[item])
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])
    at = np.flatnonzero(head)
    stop = np.append(at[1:], len(doc))[: len(at)]
    enough = stop - at >= need[item[at]]
    at, last = at[enough], stop[enough] - 1
    return zip(doc[at].tolist(), item[at].tolist(), lo[at].tolist(), hi[last].tolist())


def _parts(doc: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the hits (sorted by document, each with ``many`` postings) of
    about PART postings, whole documents each."""
    total, lo = np.cumsum(many), 0
    while lo < len(doc):
        at = int(np.searchsorted(total, total[lo] - many[lo] + PART, "right"))
        hi = int(np.searchsorted(doc, doc[min(max(at, lo), len(doc) - 1)], "left"))
        if hi <= lo:                       # one document has more
            hi = int(np.searchsorted(doc, doc[lo], "right"))
        elif at >= len(doc):
            hi = len(doc)
        yield lo, hi
        lo = hi


def _bound(held: np.ndarray) -> int:
    """The most a local alignment can score over words of which ``held`` are on
    the other side: a word of its range matches or costs at least one."""
    total = np.cumsum(np.where(held, MATCH, max(MISMATCH, GAP)))
    return int((total - np.minimum(0, np.minimum.accumulate(total))).max(initial=0))


def _reachable(item: np.ndarray, words: np.ndarray, threshold: float) -> bool:
    """Whether the words alone leave room for a passage at the threshold."""
    least = _least(len(item), threshold)
    return _bound(np.isin(words, item)) >= least and _bound(np.isin(item, words)) >= least


def _passages(item: np.ndarray, words: np.ndarray, s: int, e: int, threshold: float) -> Iterator[tuple]:
    """Alignments in words[s:e] that reach the threshold, none overlapping. One
    table gives them all, the best first; what lies between them is searched
    again only where an end was left over whose alignment reached into another."""
    least, todo = _least(len(item), threshold), [(s, e)]
    while todo:
        s, e = todo.pop()
        if (e - s) * MATCH < least:
            continue
        best, since = _table(item, words[s:e])
        ends = np.flatnonzero(best >= least)
        taken = np.zeros(e - s, bool)
        for j in ends[np.argsort(-best[ends], kind="stable")].tolist():
            a = int(since[j])
            if not taken[a:j].any():
                taken[a:j] = True
                yield int(best[j]), best[j] / (MATCH * len(item)), s + a, s + j
        free = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for a, b in zip(free[::2].tolist(), free[1::2].tolist()) if len(ends) else ():
            if np.searchsorted(ends, b, "right") > np.searchsorted(ends, a, "right"):
                todo.append((s + a, s + b))


class Index:
    """A block of items: the words, the seeds that are searched and the short items."""

    def __init__(self, docs: DataFrame, block: list[tuple], threshold: float):
        self.threshold, self.held, self.short = threshold, [], {}
        for item_id, text in block:
            w = _item_words(text)
            if len(w) >= MIN_WORDS:
                self.held.append((item_id, w))
            elif len(w):
                self.short.setdefault(len(w), {}).setdefault(int(W.grams(w, len(w))[0]), []).append(item_id)
        n = self.n_item = np.array([len(w) for _, w in self.held], np.int64)
        least = np.array([_least(k, threshold) for k in n])
        self.slack = np.ceil(MATCH * n - least).astype(np.int64)
        seen = np.ceil((least - MATCH) / 2).astype(np.int64)        # neighbouring matches of a passage
        self.need = np.maximum(1, seen // 2)
        self.keys = np.zeros(0, _U)
        if self.held:
            self._seeds(docs, seen - self.need)

    def _seeds(self, docs: DataFrame, spare: np.ndarray) -> None:
        """Postings of the seeds that some document holds, without those that
        begin at the item's ``spare`` words of the most common seeds."""
        pairs = [[_pairs(w, r) for r in REACH] for _, w in self.held]
        seeds = np.unique(np.concatenate([p for ps in pairs for p in ps]))
        df = _seed_counts(docs, seeds)
        key, item, off = [], [], []
        for k, ps in enumerate(pairs):
            counts = [df[np.searchsorted(seeds, p)] for p in ps]
            common = counts[0].copy()
            for c in counts[1:]:
                common[: len(c)] = np.maximum(common[: len(c)], c)
            keep = np.ones(len(common), bool)
            keep[np.argsort(-common, kind="stable")[: spare[k]]] = False
            for p, c in zip(ps, counts):
                at = np.flatnonzero((c > 0) & keep[: len(c)])
                key.append(p[at])
                item.append(np.full(len(at), k, np.int64))
                off.append(at)
        key, item, off = (np.concatenate(x) for x in (key, item, off))
        order = np.argsort(key, kind="stable")
        self.post_item, self.post_off = item[order], off[order]
        self.keys, self.first_post = np.unique(key[order], return_index=True)
        self.ends = np.append(self.first_post[1:], len(key))[: len(self.keys)]

    def search(self, texts: pa.Array, may: np.ndarray) -> list[tuple]:
        """(row, item_id, score, similarity, start, end) of the texts' passages."""
        data, offsets = W.buffer_of(texts)
        rows: list[tuple] = []
        for lo, hi in W.slices(offsets):
            a = offsets[lo]
            h, first = words_of(data[a: offsets[hi]], offsets[lo: hi + 1] - a)
            self._short(h, first, lo, rows)
            if not len(self.keys):
                continue
            doc, pos, k = _hits(h, first, self.keys, may)
            for x, y in _parts(doc, self.ends[k] - self.first_post[k]):
                many = self.ends[k[x:y]] - self.first_post[k[x:y]]
                q = np.arange(many.sum()) + np.repeat(self.first_post[k[x:y]] - (np.cumsum(many) - many), many)
                start = np.repeat(pos[x:y] - first[doc[x:y]], many) - self.post_off[q]
                for d, i, s, e in _windows(np.repeat(doc[x:y], many), self.post_item[q], start, self.n_item, np.diff(first),
                                           self.slack, self.need):
                    item_id, item = self.held[i]
                    words = h[first[d]: first[d + 1]]
                    if _reachable(item, words[s:e], self.threshold):
                        rows += [(lo + d, item_id, *z) for z in _passages(item, words, s, e, self.threshold)]
        return rows

    def _short(self, h: np.ndarray, first: np.ndarray, lo: int, rows: list[tuple]) -> None:
        for n, items in self.short.items():
            g = W.grams(h, n)
            pos = np.flatnonzero(np.isin(g, np.fromiter(items, _U, len(items))))
            doc = np.searchsorted(first, pos, "right") - 1
            ok = pos + n <= first[doc + 1]
            if n == 1:
                ok &= np.diff(first)[doc] == 1
            for d, p in zip(doc[ok].tolist(), pos[ok].tolist()):
                rows += [(lo + d, i, MATCH * n, 1.0, p - int(first[d]), p - int(first[d]) + n) for i in items[int(g[p])]]


def _blocks(docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, threshold: float,
            block_bytes: int) -> Iterator[Index]:
    """The items' indexes, one block of items at a time."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    query = items.select(F.col(item_id_col).alias("i"), F.col(item_text_col).cast("string").alias("t"))
    block, held = [], 0
    for r in query.toLocalIterator():
        block.append((r["i"], r["t"]))
        held += len(r["t"] or "") + 64
        if held >= block_bytes:
            yield Index(texts, block, threshold)
            block, held = [], 0
    if block:
        yield Index(texts, block, threshold)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, item_id, score, similarity, start_word, end_word): one row per
    passage of a document that copies an item."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = items.schema[item_id_col].dataType
    names, arrow_id = [id_col, "item_id", "score", "similarity", "start_word", "end_word"], to_arrow_type(item_type)
    schema = T.StructType([T.StructField(k, t) for k, t in zip(
        names, [src.schema["id"].dataType, item_type, T.LongType(), T.DoubleType(), T.LongType(), T.LongType()])])
    out = spark.createDataFrame([], schema)
    for index in _blocks(docs, items, text_col, item_id_col, item_text_col, threshold, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            may = _filter(shared.value.keys)
            for b in batches:
                rows = shared.value.search(b.column(1), may)
                if rows:
                    row, item, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array(item, arrow_id),
                         *(pa.array(x, t) for x, t in zip(rest, (pa.int64(), pa.float64(), pa.int64(), pa.int64())))], names=names)
        out = out.unionByName(src.mapInArrow(run, schema))
    return out


@register("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                         item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose own text has no copied passage, whatever their
    ids; one pass per block of items, without any exchange of rows."""
    schema, at = docs.schema, docs.columns.index(text_col)
    out = docs
    for index in _blocks(docs, items, text_col, item_id_col, item_text_col, threshold, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            may = _filter(shared.value.keys)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[r[0] for r in shared.value.search(b.column(at), may)]] = False
                yield b.filter(pa.array(keep))
        out = out.mapInArrow(run, schema)
    return out
