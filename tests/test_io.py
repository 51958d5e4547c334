"""Sources and sinks round trip with declared schemas."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from textforge.operators import latency as LT
from textforge.sources import digests as D
from textforge.sources import io as IO


def test_jsonl_keeps_unicode_and_order(spark, tmp_dir):
    df = spark.createDataFrame([(1, "لخص:", "نص \"quoted\"\nline", None)], IO.INSTRUCTION_SCHEMA)
    IO.write_jsonl(df, f"{tmp_dir}/j")
    text = spark.read.text(f"{tmp_dir}/j").first()[0]
    assert text.index('"instruction"') < text.index('"input"') < text.index('"output"')
    assert "لخص" in text and '"output":null' in text
    assert IO.scan_jsonl(spark, f"{tmp_dir}/j").collect() == df.collect()


def test_csv_quotes_newlines_empty(spark, tmp_dir):
    rows = [("1", "m", 'a, "b"\nc', "", " padded ")]
    df = spark.createDataFrame(rows, IO.PREDICTION_SCHEMA)
    IO.write_csv(df, f"{tmp_dir}/c")
    assert IO.scan_csv(spark, f"{tmp_dir}/c").collect() == df.collect()


def test_ingest_if_absent_is_idempotent(spark, tmp_dir):
    df = spark.createDataFrame([("train", 1, "a", "h")], IO.CORPUS_SCHEMA)
    IO.ingest_if_absent(df, f"{tmp_dir}/raw")
    IO.ingest_if_absent(df.union(df), f"{tmp_dir}/raw")
    assert IO.scan_corpus(spark, f"{tmp_dir}/raw").count() == 1


def test_append_metrics(spark, tmp_dir):
    m = spark.createDataFrame([("r", "train/loss", 50, 1.5)], IO.METRIC_SCHEMA)
    IO.append_metrics(m, f"{tmp_dir}/m")
    IO.append_metrics(m, f"{tmp_dir}/m")
    assert IO.read_metrics(spark, f"{tmp_dir}/m").count() == 2


def test_manifest(spark):
    files, dirs = IO.dataset_manifest(spark, SF_SMALL, "*.parquet")
    assert files.count() == 14 and files.where(F.col("md5").isNull()).count() == 0
    d = dirs.first()
    assert d.nfiles == 14 and len(d.md5) == 32


def _odd_files(folder):
    rng = random.Random(3)
    noise = rng.randbytes(300_000)
    bom = b"\xef\xbb\xbf"
    for name, raw in {"empty": b"", "line end": b"\n", "two": b"\n\n", "bom": bom, "bom line": bom + b"\n", "bom text": bom + b"a\r\nb",
                      "bom twice": bom + bom + b"x\n", "noise": noise, "noise 1": noise + b"\n", "noise 2": b"\n" + noise + b"\n\n",
                      "zeros": b"\0" * 100_000, "lines": b"ab\r\n\n" * 50_000, "cr": b"a\rb\r", "dir/n\u00e9 %20": noise[:70_000],
                      "p.gz": gzip.compress(noise), "p.gz.txt": gzip.compress(b"abc")}.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(raw)


@pytest.mark.parametrize("whole", [False, True])
def test_manifest_in_rounds(spark, tmp_dir, monkeypatch, whole):
    """Every byte counts, also over many splits and rounds, and without OpenSSL's MD5."""
    _odd_files(tmp_dir)
    monkeypatch.setattr(D, "RANGE", 50_000)
    if whole:
        monkeypatch.setattr(D, "_library", lambda: None)
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, "20000")
    try:
        files, dirs = IO.dataset_manifest(spark, tmp_dir)
        got = {r.path: (r.size, r.md5) for r in files.collect()}
        old = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tmp_dir).select("path", "content").collect()
    finally:
        spark.conf.unset(conf)
    assert got == {r.path: (len(r.content), hashlib.md5(bytes(r.content)).hexdigest()) for r in old} and len(got) == 15   # an empty file has no split, so no row
    assert sum(r.nfiles for r in dirs.collect()) == 15


def test_manifest_reads_a_file_by_many_tasks(spark, tmp_dir):
    """No plan holds a file's content, and a file is read as splits."""
    with open(os.path.join(tmp_dir, "f.parquet"), "wb") as f:
        f.write(random.Random(1).randbytes(400_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        seen = []
        digests, D.file_digests = D.file_digests, lambda listing, lines: seen.append(lines) or digests(listing, lines)
        assert IO.dataset_manifest(spark, tmp_dir)[0].count() == 1
        sizes = [r["n"] for r in seen[0].groupBy("block").agg(F.sum(F.length("line") + 1).alias("n")).collect()]
    finally:
        D.file_digests = digests
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= 10 and max(sizes) < 45_000


def test_md5_state_is_taken_up_again():
    lib = D._library()
    if lib is None:
        pytest.skip("Python without OpenSSL")
    raw, state = random.Random(2).randbytes(1000), None
    for i in range(0, 1000, 37):
        m = D.Md5(lib, state)
        m.update(raw[i:i + 37])
        state = m.state()
        assert m.hexdigest() == hashlib.md5(raw[:i + 37]).hexdigest()


def test_stats_report_file(spark, tmp_dir):
    long = spark.createDataFrame([("sequential", "n_requests", 100.0), ("sequential", "ttft_mean_ms", 104.31),
                                  ("concurrent", "n_requests", 20.0)], "label string, metric string, value double")
    LT.write_stats_report(LT.stats_report_lines(long), f"{tmp_dir}/rep")
    lines = [r.value for r in spark.read.text(f"{tmp_dir}/rep").collect()]
    assert lines == ["=== SEQUENTIAL BENCHMARK ===", "sequential/n_requests: 100", "sequential/ttft_mean_ms: 104.31",
                     "=== CONCURRENT BENCHMARK ===", "concurrent/n_requests: 20"]
