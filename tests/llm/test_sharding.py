import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import documents
from textforge.llm import sharding as S


def brute(texts, shards, share=S.GROUP_SHARE):
    """{id: shard} by a full sort."""
    size = lambda t: len((t or "").encode()) + 8
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    rows = sorted((key(t), i, size(t)) for i, t in texts.items())
    total = sum(r[2] for r in rows)
    group, first, at = {}, {}, 0
    for k, _, s in rows:
        group[k] = group.get(k, 0) + s
    out = {}
    for k, i, s in rows:
        first.setdefault(k, at)
        begin = at if group[k] > share * total / shards else first[k]
        out[i] = min(shards - 1, shards * begin // total)
        at += s
    return out


def check(rows, texts, shards):
    want = brute(texts, shards)
    assert {r.doc_id: r.shard for r in rows} == want
    slots = {}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_balanced_and_whole_groups(spark):
    rng = random.Random(6)
    texts = {i: "x" * rng.randint(0, 400) + str(i) for i in range(600)} | {900: None, 901: "", 902: ""}
    texts |= {1000 + i: "the hot text " * 20 for i in range(300)}       # a third of all rows
    texts |= {2000 + i: f"pair {i // 2}" for i in range(60)}
    df = documents(spark, texts, extra=("size", "cell", "key"))
    rows = S.shard(df, 24).collect()
    check(rows, texts, 24)
    load = {}
    for r in rows:
        load[r.shard] = load.get(r.shard, 0) + r.size
    ideal = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 2 * (400 + 20 + S.GROUP_SHARE * ideal)
    by_id = {r.doc_id: r.shard for r in rows}
    assert all(by_id[2000 + 2 * i] == by_id[2001 + 2 * i] for i in range(30))
    assert len({by_id[1000 + i] for i in range(300)}) > 5                # the hot group is split
    fine = S.shard(df, 24, cell_rows=8).collect()                        # many cells, the same answer
    assert {r.doc_id: r.shard for r in fine} == by_id
    check(fine, texts, 24)


def test_edges(spark):
    df = documents(spark, {1: "a", 2: None})
    check(S.shard(df, 24).collect(), {1: "a", 2: None}, 24)
    assert S.shard(df.limit(0), 24).count() == 0
    odd = df.union(df).withColumn("doc_id", F.when(F.col("doc_id") == 1, F.col("doc_id")))    # repeated rows, null ids
    rows = S.shard(odd, 3).collect()
    assert len(rows) == 4 and sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})


def test_plan_is_native(spark):
    plan = S.shard(documents(spark, {1: "a", 2: "b"}), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
