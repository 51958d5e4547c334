"""WARC archives: writing with revisits, reading by boundary-chain verification.

Writing. Each page is a record; of pages with equal payloads of at least
MIN_REVISIT bytes the one with the smallest id is the ``response`` and the others
are ``revisit`` records that carry its id, the payload's digest and length, and
no payload. Spark's text writer lays records down: a record ends with CRLF CRLF,
which is the writer's line separator.

Reading. The record magic may occur inside a payload, so a match is only a
candidate. Spark's text reader splits files at the magic; every task emits, per
candidate, its start and the start of its successor as its Content-Length claims.
From there only offsets move: a candidate's chain is first followed to the end
of its file block (one block at a time), then block exits are joined by pointer
jumping, doubling the step each round, from the file start. Candidates that the
chain reaches are records; the rest is payload. Payloads that hold the magic are
put together from their pieces.

Null payloads are empty. A null page id is written as such and read back as
null. Rows that repeat a smallest id and its payload are all responses; other
repeats revisit. Empty tables give empty archives and results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm.registry import register, table
from textforge.llm.scratch import fresh_path, materialise

#: Format constants.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date keeps archives reproducible; pages carry none.
DATE = "1970-01-01T00:00:00Z"


def _digest(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, bytes, digest, refers_to): refers_to is the response
    that a record revisits. Only groups of two or more take part in the join."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                       F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    src = src.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", _digest(F.col("payload")))
    # sums and minima are combined before the shuffle, whatever one payload's share
    groups = src.where(F.col("bytes") >= MIN_REVISIT).select("digest", "id").groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # written first, so that the planner knows its size: few revisits leave the payloads where they are
    return src.join(materialise(groups, "warc-groups"), "digest", "left").select(
        "id", "url", "payload", "bytes", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _uri(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def record_text(r: DataFrame) -> DataFrame:
    """One ``value`` per record: header and block, without the closing END."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    # header values hold no line breaks
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _uri(F.col("id")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.lit("\r\nWARC-Target-URI: "), url,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _uri(F.col("refers_to")),
                                 F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    return r.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> str:
    """Write every page as a record below ``path``: one archive per task."""
    record_text(plan_records(pages, **columns)).write.option("lineSep", END).text(path)
    return path


# --- reading ---------------------------------------------------------------

def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between magics in file order: (file, block, ord, len, head
    fields, body piece). One scan; a complete record's payload is digested in
    place and only pieces of incomplete candidates keep their bytes."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"))
    cut = F.instr("value", END)
    c = raw.withColumn("len", F.octet_length("value").cast("long")).withColumn(
        "head", F.when(cut > 0, F.substring("value", F.lit(1), cut - 1)).otherwise(F.lit("")))
    c = c.withColumn("head_len", F.octet_length("head").cast("long") + len(END))
    claimed = _field("Content-Length").try_cast("long")
    c = c.withColumn("claimed", F.when((cut > 0) & (claimed >= 0), claimed))
    whole = F.coalesce(F.col("len") == F.col("head_len") + F.col("claimed") + len(END), F.lit(False))
    c = c.withColumn("whole", whole).withColumn("kind", _field("Content-Type")).withColumn(
        "payload", F.when(F.col("whole"), _payload()))
    return c.select(
        "file", "block", "ord", "len", "head_len", "claimed", "whole", "kind",
        _field("WARC-Type").alias("record_type"), _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Payload-Digest").alias("stated"), _digest(F.col("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("bytes"), F.when(~F.col("whole"), F.col("value").cast("binary")).alias("piece"))


def _payload() -> Column:
    """The payload bytes of a complete record ``value`` (from after its magic):
    the block, without the HTTP header where it has one."""
    head_chars = F.instr("value", END) + len(END) - 1
    second = F.call_function("locate", F.lit(END), F.col("value"), head_chars + 1)
    body_end = F.col("head_len") + F.col("claimed")
    http_end = F.octet_length(F.substring("value", F.lit(1), second + (len(END) - 1))).cast("long")
    http = F.col("kind").startswith("application/http") & (second > head_chars) & (http_end <= body_end)
    begin = F.when(F.coalesce(http, F.lit(False)), http_end).otherwise(F.col("head_len"))
    return F.substring(F.col("value").cast("binary"), (begin + 1).cast("int"), (body_end - begin).cast("int"))


def _with_offsets(chunks: DataFrame) -> DataFrame:
    """Adds ``start``, the byte offset of the magic before each piece (negative
    for what precedes a file's first magic), and the file's block list."""
    sums = chunks.groupBy("file", "block").agg(F.sum(F.col("len") + len(MAGIC)).alias("size"))
    before = sums.select("file", "block", F.coalesce(F.sum("size").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("len") + len(MAGIC)).over(inside), F.lit(0))
    return chunks.withColumn("run", run).join(before, ["file", "block"]).withColumn(
        "start", F.col("base") + F.col("run") - len(MAGIC)).drop("run", "base")


def _local_chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow each candidate's chain inside one block: where it leaves it."""
    pdf = pd.concat(list(batches)).sort_values("start")
    start, succ = pdf["start"].to_numpy(np.int64), pdf["succ"].to_numpy(np.int64)
    leaves = succ.copy()
    at = {int(s): i for i, s in enumerate(start)}
    for i in range(len(start) - 1, -1, -1):      # successors lie ahead, so they are done
        j = at.get(int(succ[i]))
        if j is not None and j > i:
            leaves[i] = leaves[j]
    yield pd.DataFrame({"file": pdf["file"], "block": pdf["block"], "start": start, "succ": succ, "leaves": leaves})


def _mark_local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The candidates of one block on the chain from its entry."""
    pdf = pd.concat(list(batches)).sort_values("start")
    start, succ = pdf["start"].to_numpy(np.int64), pdf["succ"].to_numpy(np.int64)
    at = {int(s): i for i, s in enumerate(start)}
    keep = np.zeros(len(start), bool)
    for e in np.flatnonzero(pdf["entry"].to_numpy(bool)):
        i = int(e)
        while i is not None and not keep[i]:
            keep[i] = True
            i = at.get(int(succ[i]))
    yield pd.DataFrame({"file": pdf["file"].to_numpy()[keep], "start": start[keep]})


def verified_starts(candidates: DataFrame) -> DataFrame:
    """(file, start) of the records reachable from each file's offset 0.

    ``candidates``: (file, block, start, succ). Block-local chains first; then
    pointer jumping over block exits: after round k the marked entries are all
    that 2**k block hops reach, and each hop table joins itself once a round."""
    schema = "file string, block long, start long, succ long, leaves long"
    local = materialise(candidates.groupBy("file", "block").applyInPandas(_local_chains, schema), "warc-chains")
    hop = local.select("file", F.col("start").alias("a"), F.col("leaves").alias("b"))
    marked = local.where("start = 0").select("file", F.col("start").alias("a"))
    blocks = local.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    steps = 1
    while steps < blocks:                       # a chain enters each block at most once
        reached = marked.join(hop, ["file", "a"]).select("file", F.col("b").alias("a"))
        marked = materialise(marked.union(reached).distinct(), "warc-entries")
        steps *= 2
        if steps < blocks:
            further = hop.select("file", F.col("a").alias("b"), F.col("b").alias("c"))
            hop = materialise(hop.join(further, ["file", "b"]).select("file", "a", F.col("c").alias("b")), "warc-hops")
    entries = marked.select("file", F.col("a").alias("start"), F.lit(True).alias("entry"))
    flagged = local.join(entries, ["file", "start"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return flagged.groupBy("file", "block").applyInPandas(_mark_local, "file string, start long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to):
    every record below ``path``; a revisit has its response's payload."""
    chunks = _with_offsets(materialise(_chunks(spark, path), "warc-pieces"))
    succ = F.col("start") + len(MAGIC) + F.col("head_len") + F.col("claimed") + len(END)
    chunks = materialise(chunks.withColumn("succ", succ), "warc-offsets")
    starts = verified_starts(chunks.where("claimed is not null and start >= 0").select("file", "block", "start", "succ"))
    starts = materialise(starts, "warc-starts").withColumn("record", F.lit(True))
    known = chunks.join(starts, ["file", "start"], "left").withColumn("record", F.coalesce("record", F.lit(False)))
    columns = ["file", "start", "record_type", "record_id", "refers_to", "url", "stated"]
    whole = known.where("record and whole").select(*columns, "digest", "bytes")

    # records cut by a magic inside their payload: their piece and the pieces up to their end
    cut = known.where("record and not whole").select(*columns, "succ", "head_len", "claimed", "kind")
    pieces = known.where("not whole or not record").select("file", F.col("start").alias("at"), "piece")
    kept, lost = pieces.where("piece is not null"), pieces.where("piece is null")
    if cut.limit(1).count() and lost.limit(1).count():
        # a piece that looks like a whole record but is none left its bytes in the file
        kept = kept.union(lost.select("file", "at").join(_pieces_again(spark, path), ["file", "at"]))
    # the record that a piece belongs to: the last cut record at or before it (offsets only)
    marks = cut.select("file", F.col("start").alias("at"), F.col("start").alias("owner"), F.col("succ").alias("until"))
    last = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spots = pieces.select("file", "at").join(marks, ["file", "at"], "left").select(
        "file", "at", F.last("owner", True).over(last).alias("owner"),
        F.last("until", True).over(last).alias("until")).where("at < until")
    joined = kept.join(spots, ["file", "at"]).groupBy("file", F.col("owner").alias("start")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("h")))), lambda x: x["h"]),
                     MAGIC.encode().hex().upper()).alias("h"))
    rebuilt = cut.join(joined, ["file", "start"]).withColumn("value", F.unhex("h").cast("string")).withColumn(
        "payload", _payload()).select(*columns, _digest(F.col("payload")).alias("digest"),
                                      F.octet_length("payload").cast("long").alias("bytes"))

    records = whole.unionByName(rebuilt)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = records.select("url", "record_type", page("record_id").alias("page_id"), page("refers_to").alias("refers_to"),
                             "digest", "bytes", F.regexp_replace("stated", "^sha256:", "").alias("stated"))
    responses = records.where("record_type <> 'revisit'").select(
        F.col("page_id").alias("refers_to"), F.col("digest").alias("stated"), F.col("bytes").alias("r_bytes"))
    revisits = records.where("record_type = 'revisit'")
    full = revisits.join(responses.distinct(), ["refers_to", "stated"], "left").select(
        "page_id", "url", "record_type", F.col("r_bytes").alias("payload_bytes"),
        F.when(F.col("r_bytes").isNotNull(), F.col("stated")).alias("payload_digest"), "refers_to")
    return records.where("record_type <> 'revisit'").select(
        "page_id", "url", "record_type", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit(None).cast("long").alias("refers_to")).unionByName(full)


def _pieces_again(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, piece) of every piece, from a second scan."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("piece"), F.octet_length("value").cast("long").alias("len"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("ord"))
    return _with_offsets(raw).select("file", F.col("start").alias("at"), "piece")


OP2_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN g.first IS NOT NULL AND page_id IS DISTINCT FROM g.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM g.first THEN g.first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


@register("op2_warc", OP2_SQL)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_archives(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
