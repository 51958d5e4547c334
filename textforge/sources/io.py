"""Sources and sinks with declared schemas.

Nothing is inferred. Writers overwrite by default: the reference appends on
rerun and duplicates its output; ingest is idempotent through ``ignore``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.plans.joins import small_copy
from textforge.sources import digests as D

CORPUS_SCHEMA = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("article", T.StringType()), T.StructField("headline", T.StringType())])
INSTRUCTION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()), T.StructField("output", T.StringType())])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("input", T.StringType()), T.StructField("reference", T.StringType()),
    T.StructField("predicted", T.StringType())])
METRIC_SCHEMA = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("step", T.LongType()), T.StructField("value", T.DoubleType())])
LINE_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()), T.StructField("line", T.StringType())])

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# microseconds survive a JSON round trip only with an explicit pattern
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of named splits stored partitioned by ``split``."""
    return spark.read.schema(CORPUS_SCHEMA).parquet(path)


def ingest_if_absent(df: DataFrame, path: str) -> None:
    """Write only when nothing is there yet (``mode("ignore")``)."""
    df.write.mode("ignore").partitionBy("split").parquet(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """S3: every split, columnar, one directory per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType = INSTRUCTION_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str,
                columns: Sequence[str] = ("id", "instruction", "input", "output")) -> None:
    """JSON lines; key order as given, nulls written, non-ASCII unescaped."""
    (df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false")
     .option("compression", "none").json(path))


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame:
    """Header CSV, all strings, quotes/commas/newlines inside fields; an
    empty field is the empty string (CSV has no null)."""
    return (spark.read.schema(schema).options(**CSV_OPTIONS).option("nullValue", "\u0000")
            .option("emptyValue", "").csv(path))


def _csv_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each file block, in the order of its lines: the records that lie in it
    whole, and its first and last pieces, which belong to records that began
    before it or go on after it."""
    names = ["file", "block", "n", "whole", "text"]

    def rows(file, block, parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([file] * len(parts)), pa.array([block] * len(parts), pa.int64()), pa.array([x[0] for x in parts], pa.int64()),
             pa.array([x[1] for x in parts]), pa.array([x[2] for x in parts])], names=names)

    at, held, n, open_, out = None, [], 0, False, []
    for b in batches:
        for file, block, inside, line in zip(*(b.column(k).to_pylist() for k in range(4))):
            if (file, block) != at:
                if held:
                    out.append((n, False, "\n".join(held)))
                if out:
                    yield rows(*at, out)
                at, held, n, out = (file, block), [], 0, []
                open_ = first = inside
            held.append(line)
            open_ ^= line.count('"') % 2 == 1
            if not open_:
                out.append((n, not first, "\n".join(held)))
                n, held, first = n + 1, [], False
        if len(out) > 10_000:
            yield rows(*at, out)
            out = []
    if held:
        out.append((n, False, "\n".join(held)))
    if out:
        yield rows(*at, out)


def scan_csv_blocks(spark: SparkSession, path: str, schema: T.StructType = PREDICTION_SCHEMA) -> DataFrame:
    """S6 for files of any size: the rows of ``scan_csv``, each file read by as
    many tasks as it has blocks.

    Lines are read splittably. A line with an odd number of quotes opens or closes
    a field that goes on over lines, so the parity of the quotes of all earlier
    blocks (a running sum over blocks, not rows) says whether a block begins
    inside a field. Every task then cuts its block into records; the pieces at its
    ends, at most two a block, are joined with their neighbours'. The header of
    every file is its first record."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    quotes = F.sum(F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit(""))))
    blocks = lines.groupBy("file", "block").agg(quotes.alias("q"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", (F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    # broadcast whatever its size would be a gather; a row per block is small beside the block itself
    placed = lines.join(small_copy(starts, 256), ["file", "block"]).select("file", "block", "inside", "line")
    cut = placed.mapInArrow(_csv_fragments, "file string, block long, n long, whole boolean, text string")
    # a block's first piece ends a record if the block begins inside one; its last piece begins one
    pieces = cut.where("not whole")
    ends = pieces.join(starts, ["file", "block"])
    begins = ~(F.col("inside") & (F.col("n") == 0))
    nth = F.sum(begins.cast("int")).over(Window.partitionBy("file").orderBy("block", "n"))
    joined = ends.withColumn("_of", nth).groupBy("file", "_of").agg(
        F.min(F.struct("block", "n")).alias("_at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "n", "text"))), lambda x: x["text"]), "\n").alias("text"))
    records = cut.where("whole").select("file", "block", "n", "text").unionByName(
        joined.select("file", F.col("_at.block").alias("block"), F.col("_at.n").alias("n"), "text"))
    head = (F.col("block") == 0) & (F.col("n") == 0)
    fields = F.from_csv("text", schema.simpleString()[len("struct<"):-1].replace(":", " "),
                        {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "",
                         "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"})
    return records.where(~head).select(fields.alias("r")).select("r.*")


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Header CSV of the chosen columns, RFC-4180 quoting."""
    out = df.select(*columns) if columns else df
    out.write.mode("overwrite").options(**CSV_OPTIONS).option("quoteAll", "false").csv(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append ``(run, key, step, value)`` rows to the metrics table."""
    (df.select(*[F.col(f.name).cast(f.dataType) for f in METRIC_SCHEMA.fields])
     .write.mode("append").parquet(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(path)


def dataset_manifest(spark: SparkSession, path: str, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Per file ``path, size, md5`` and per directory ``nfiles, size, md5``.

    A file is read by as many tasks as it has splits, and digested in rounds
    (``digests``); only packed files are a row each (up to 2 GiB).
    The directory digest is the exclusive or of the halves of its files' digests
    (our own definition): it needs no list of files in one task.
    """
    options = {"pathGlobFilter": glob, "recursiveFileLookup": "true"}
    file = F.col("_metadata.file_path")
    packed = file.rlike(D.PACKED)                    # on metadata: Spark leaves out the other files before it reads any
    listing = spark.read.format("binaryFile").options(**options).load(path)
    plain = listing.where(~packed).select("path", F.col("length").alias("size"), file.alias("file"))
    lines = spark.read.options(**options).option("lineSep", "\n").text(path).where(~packed).select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    files = plain.join(D.file_digests(plain.select("file", "size"), lines), "file").select("path", "size", "md5").unionByName(
        listing.where(packed).select("path", F.col("length").alias("size"), F.md5("content").alias("md5")))
    quarter = lambda i: F.conv(F.substring("md5", 1 + 8 * i, 8), 16, 10).cast("long")
    joint = F.concat(*[F.lpad(F.lower(F.hex(F.bit_xor(quarter(i)))), 8, "0") for i in range(4)])
    dirs = files.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).groupBy("dir").agg(
        F.count(F.lit(1)).alias("nfiles"), F.sum("size").alias("size"),
        joint.alias("md5"))
    return files, dirs


def stream_lines_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = 1) -> DataFrame:
    """A stream of SSE log lines from JSON files (Kafka gives the same plan
    downstream); None takes all new files as one micro-batch."""
    r = spark.readStream.schema(LINE_SCHEMA).option("timestampFormat", TS_FORMAT)
    return (r if max_files_per_trigger is None else r.option("maxFilesPerTrigger", max_files_per_trigger)).json(path)


def write_lines(df, path: str) -> None:
    """Append SSE log lines as JSON files readable by :func:`stream_lines_source`."""
    df.write.mode("append").option("timestampFormat", TS_FORMAT).json(path)
