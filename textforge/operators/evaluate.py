"""Evaluation: ROUGE, embedding pooling and similarity, alignment.

ROUGE-N needs one exchange, of the texts themselves: rows are hash-partitioned
and sorted on their key, tokens are produced natively behind it, and Python
counts the n-grams of one key at a time, so no n-gram is ever a row.
ROUGE-L/Lsum run an Arrow pandas UDF over tokens produced natively (Python only
does the LCS).
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.functions import lcs as L
from textforge.functions.text import WS
from textforge.plans.ordered import ordered_running

TOKEN_SPLIT = {
    # Unicode letters and digits (default): works for Arabic and accented text.
    "unicode": "[^\\p{L}\\p{N}]+",
    # ASCII-compatible: only a-z0-9 survive lower-casing, as the common ROUGE tokenizer does.
    "ascii": "[^a-z0-9]+",
}

# --- fixed values: similarity report thresholds ---
SIMILARITY_ABOVE = (0.8, 0.7, 0.6)
SIMILARITY_BELOW = 0.5
POOL_EPS = 1e-9
COSINE_EPS = 1e-8
# --- end of fixed values ---


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rouge_tokens(text: Column | str, tokenizer: str = "unicode") -> Column:
    """Lower-case and split into letter/digit runs; empty pieces dropped."""
    return F.filter(F.split(F.lower(_c(text)), TOKEN_SPLIT[tokenizer]), lambda x: x != "")


def rouge_n(df: DataFrame, keys: Sequence[str], pred: str = "predicted", ref: str = "reference",
            orders: Sequence[int] = (1, 2), tokenizer: str = "unicode") -> DataFrame:
    """A1: per-row ROUGE-N precision/recall/F1 for each n in ``orders``.

    Output columns ``rouge{n}_p``, ``rouge{n}_r``, ``rouge{n}_f``.
    """
    keys = list(keys)
    texts = df.select(*keys, _c(pred).cast("string").alias("_p"), _c(ref).cast("string").alias("_r"))
    words = lambda c: F.array_join(rouge_tokens(c, tokenizer), " ").alias(c)  # noqa: E731  (tokens hold no spaces)
    rows = texts.repartition(*keys).sortWithinPartitions(*keys).select(*keys, words("_p"), words("_r"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in texts.select(*keys).schema]
                          + [T.StructField(f"rouge{n}_{m}", T.DoubleType()) for n in orders for m in ("p", "r", "f")])
    return rows.mapInArrow(_count_grams(keys, tuple(orders)), schema)


#: Rows whose words a task holds as Python texts at once.
_GRAM_ROWS = 512


def _count_grams(keys: list[str], orders: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ROUGE-N of rows that come sorted by their key: the n-grams of all rows of one
    key are counted together, and only those of one key are held."""
    def grams(words: list[str], n: int) -> Iterator:
        return iter(words) if n == 1 else zip(*(words[i:] for i in range(n)))

    def scores(counts: list[tuple[Counter, Counter]]) -> list[float]:
        out = []
        for said, wanted in counts:
            hit = sum(min(c, wanted[g]) for g, c in said.items() if g in wanted)
            p, r = hit / max(said.total(), 1), hit / max(wanted.total(), 1)
            out += [p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key, counts, types, done = None, None, [], None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(c, pa.float64()) for c in columns[len(keys):]]
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, *(f"rouge{n}_{m}" for n in orders for m in ("p", "r", "f"))])
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(keys))]
            for lo in range(0, batch.num_rows, _GRAM_ROWS):
                columns = [c.to_pylist() for c in batch.slice(lo, _GRAM_ROWS).columns]
                for *k, said, wanted in zip(*columns):
                    same = tuple("NaN" if x != x else x for x in k)         # as Spark groups
                    if at is None or same != at:
                        if at is not None:
                            done.append([*key, *scores(counts)])
                        at, key, counts = same, k, [(Counter(), Counter()) for _ in orders]
                    for side, text in ((0, said), (1, wanted)):
                        words = text.split(" ") if text else []
                        for n, both in zip(orders, counts):
                            both[side].update(grams(words, n))
                if len(done) >= 4 * _GRAM_ROWS:
                    yield made()
                    done.clear()
        if at is not None:
            done.append([*key, *scores(counts)])
        if done:
            yield made()
    return run


_PRF = T.StructType([T.StructField(x, T.DoubleType()) for x in ("p", "r", "f")])


@F.pandas_udf(_PRF)
def _rouge_l_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    out = [L.rouge_l(list(a) if a is not None else [], list(b) if b is not None else [])
           for a, b in zip(pred, ref)]
    return pd.DataFrame(out, columns=["p", "r", "f"])


@F.pandas_udf(_PRF)
def _rouge_lsum_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    conv = lambda s: [list(x) for x in s] if s is not None else []
    out = [L.rouge_lsum(conv(a), conv(b)) for a, b in zip(pred, ref)]
    return pd.DataFrame(out, columns=["p", "r", "f"])


def rouge_l(df: DataFrame, keys: Sequence[str], pred: str = "predicted", ref: str = "reference",
            tokenizer: str = "unicode") -> DataFrame:
    """A2: sentence-level ROUGE-L (LCS) per row; tokens native, LCS in an Arrow UDF."""
    s = _rouge_l_udf(rouge_tokens(pred, tokenizer), rouge_tokens(ref, tokenizer))
    return df.select(*keys, s.alias("_s")).select(
        *keys, F.col("_s.p").alias("rougeL_p"), F.col("_s.r").alias("rougeL_r"),
        F.col("_s.f").alias("rougeL_f"))


def _sentences(text: Column | str, tokenizer: str) -> Column:
    return F.transform(F.split(_c(text), "\n"), lambda line: rouge_tokens(line, tokenizer))


def rouge_lsum(df: DataFrame, keys: Sequence[str], pred: str = "predicted",
               ref: str = "reference", tokenizer: str = "unicode") -> DataFrame:
    """A3: summary-level ROUGE-L over newline-separated sentences."""
    s = _rouge_lsum_udf(_sentences(pred, tokenizer), _sentences(ref, tokenizer))
    return df.select(*keys, s.alias("_s")).select(
        *keys, F.col("_s.p").alias("rougeLsum_p"), F.col("_s.r").alias("rougeLsum_r"),
        F.col("_s.f").alias("rougeLsum_f"))


def rouge_scores(df: DataFrame, keys: Sequence[str], pred: str = "predicted",
                 ref: str = "reference", tokenizer: str = "unicode") -> DataFrame:
    """A1-A3 per row, joined on the row key (both sides partitioned on it)."""
    n = rouge_n(df, keys, pred, ref, (1, 2), tokenizer)
    lsum = df.select(*keys, _rouge_l_udf(rouge_tokens(pred, tokenizer),
                                         rouge_tokens(ref, tokenizer)).alias("_l"),
                     _rouge_lsum_udf(_sentences(pred, tokenizer),
                                     _sentences(ref, tokenizer)).alias("_s"))
    lsum = lsum.select(*keys, F.col("_l.f").alias("rougeL_f"), F.col("_s.f").alias("rougeLsum_f"))
    return n.join(lsum, list(keys))


def rouge_corpus(scores: DataFrame, by: Sequence[str] = ("model",),
                 variants: Sequence[str] = ("rouge1", "rouge2", "rougeL", "rougeLsum")) -> DataFrame:
    """A4: mean F1 per variant (partial + final aggregate)."""
    return scores.groupBy(*by).agg(*[F.avg(f"{v}_f").alias(v) for v in variants],
                                   F.count(F.lit(1)).alias("n"))


#: Fixed resolution of the bootstrap's weights: 16 bits of a hash each.
_POISSON_STEPS = 8


def poisson_thresholds() -> list[int]:
    """Where a uniform 16-bit number passes from k to k + 1: the distribution of
    a Poisson variable of mean one, in steps of 1 / 65536."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(_POISSON_STEPS):
        total += term
        out.append(int(total * 65536))
        term /= k + 1
    return out


def poisson_weights(key: Column, replicates: int, seed: int = 0) -> Column:
    """array<int>: how often a row counts in each replicate; from its key alone,
    so any partitioning, and any retry, draws the same samples."""
    number = lambda h, i: F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int")
    hashes = [F.md5(F.concat(F.lit(f"{seed}|{c}|"), key.cast("string"))) for c in range(-(-replicates // 8))]
    draws = F.array(*[number(hashes[r // 8], r % 8) for r in range(replicates)])
    return F.transform(draws, lambda u: sum((F.when(u >= t, 1).otherwise(0) for t in poisson_thresholds()), F.lit(0)))


def rouge_interval(scores: DataFrame, key: str = "id", by: Sequence[str] = ("model",),
                   variants: Sequence[str] = ("rouge1", "rouge2", "rougeL"), replicates: int = 96,
                   tail: float = 0.025) -> DataFrame:
    """A4: (by..., variant, low, mid, high): the midpoint and bounds of the mean F1
    over ``replicates`` resamples, by a Poisson bootstrap in one pass: each row is
    weighted per replicate, and only weighted sums are shuffled. The bounds are
    floor-rank order statistics of the replicates' means."""
    long = scores.select(*by, F.posexplode(poisson_weights(F.col(key), replicates)).alias("_r", "_w"),
                         *[F.col(f"{v}_f") for v in variants]).where("_w > 0")
    sums = long.groupBy(*by, "_r").agg(F.sum("_w").alias("_n"), *[F.sum(F.col("_w") * F.col(f"{v}_f")).alias(v) for v in variants])
    means = sums.select(*by, *[(F.col(v) / F.col("_n")).alias(v) for v in variants]).unpivot(list(by), list(variants), "variant", "_v")
    at = lambda q: F.get("_s", F.floor(F.size("_s") * q).cast("int"))
    return means.groupBy(*by, "variant").agg(F.sort_array(F.collect_list("_v")).alias("_s")).select(
        *by, "variant", at(tail).alias("low"), at(0.5).alias("mid"), at(1 - tail).alias("high"))


def masked_mean_pool(df: DataFrame, group: Sequence[str], vec: str = "embedding",
                     mask: Column | None = None) -> DataFrame:
    """A5: ``sum(vec * mask) / max(sum(mask), eps)`` per group and dimension.

    Long form ``(group..., dim, value)``: token vectors are exploded and
    summed per (group, dim) with map-side combine, so even a group holding
    a third of all tokens is reduced before the shuffle.
    """
    m = mask if mask is not None else F.lit(1.0)
    long = df.select(*group, m.cast("double").alias("_m"), F.posexplode(vec).alias("dim", "_v"))
    agg = long.groupBy(*group, "dim").agg(
        F.sum(F.col("_v").cast("double") * F.col("_m")).alias("_s"), F.sum("_m").alias("_n"))
    return agg.select(*group, "dim", (F.col("_s") / F.greatest(F.col("_n"), F.lit(POOL_EPS))).alias("value"))


def pooled_vectors(long: DataFrame, group: Sequence[str]) -> DataFrame:
    """Long pooled form -> one ``array<double>`` per group, ordered by dim
    (bounded by the embedding width)."""
    return long.groupBy(*group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"])
        .alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column | str, b: Column | str, eps: float = COSINE_EPS) -> Column:
    """Cosine in double precision, each norm clamped at ``eps``."""
    a, b = _c(a), _c(b)
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return dot(a, b) / (F.greatest(na, F.lit(eps)) * F.greatest(nb, F.lit(eps)))


def batch_similarity(pairs: DataFrame, keys: Sequence[str] = ("id", "model"),
                     ref: str = "ref_vec", pred: str = "pred_vec") -> DataFrame:
    """A6 over aligned pairs."""
    return pairs.select(*keys, cosine_similarity(ref, pred).alias("similarity"))


def threshold_name(side: str, t: float) -> str:
    return f"pct_{side}_{str(t).replace('.', '_')}"


def similarity_summary(scores: DataFrame, by: Sequence[str] = ("model",), col: str = "similarity"
                       ) -> DataFrame:
    """Mean, population std, min, max, n and threshold shares."""
    s = F.col(col)
    aggs = [F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"),
            F.max(s).alias("max"), F.count(s).alias("n")]
    aggs += [F.avg((s > t).cast("double")).alias(threshold_name("above", t)) for t in SIMILARITY_ABOVE]
    aggs.append(F.avg((s < SIMILARITY_BELOW).cast("double"))
                .alias(threshold_name("below", SIMILARITY_BELOW)))
    return scores.groupBy(*by).agg(*aggs)


def align_predictions(tests: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Pair each prediction with its test row by key, never by position."""
    return tests.join(preds, key, "inner")


def skipped_samples(tests: DataFrame, preds: DataFrame, key: str = "id") -> DataFrame:
    """Test rows without a prediction."""
    return tests.join(preds.select(key), key, "left_anti")


def compare_models(scores: DataFrame, a: str = "finetuned", b: str = "base", key: str = "id",
                   model: str = "model", value: str = "similarity") -> DataFrame:
    """J2 per sample: both models' values side by side and their difference."""
    wide = scores.groupBy(key).agg(
        F.max(F.when(F.col(model) == a, F.col(value))).alias(a),
        F.max(F.when(F.col(model) == b, F.col(value))).alias(b))
    return wide.withColumn("delta", F.col(a) - F.col(b))


def compare_summaries(summary: DataFrame, metrics: Sequence[str], a: str = "finetuned",
                      b: str = "base", model: str = "model") -> DataFrame:
    """J2 per metric: unpivot the summary, pivot the models, add the delta."""
    long = summary.unpivot([model], list(metrics), "metric", "value")
    wide = long.groupBy("metric").pivot(model, [a, b]).agg(F.first("value"))
    return wide.withColumn("delta", F.col(a) - F.col(b))


def running_mean_every_k(scores: DataFrame, by: str = "model", order: str = "id",
                         col: str = "similarity", k: int = 10) -> DataFrame:
    """The mean so far, reported at every k-th row of each group.

    Positions and running sums come from :func:`ordered_running`, so a
    model holding most rows is still spread over many tasks.
    """
    run = ordered_running(scores, [by], [order], index_col="_i", sums={"_s": F.col(col)})
    n = F.col("_i") + 1
    return run.where(n % k == 0).select(by, order, n.alias("n"), (F.col("_s") / n).alias("running_mean"))


def lead_words(text: Column | str, k: int = 20) -> Column:
    """U4 default model: the first ``k`` whitespace words (deterministic, native)."""
    words = F.filter(F.split(_c(text), f"[{WS}]+"), lambda x: x != "")
    return F.array_join(F.slice(words, 1, k), " ")


def batch_generate(df: DataFrame, text: str = "input", out: str = "predicted",
                   load_model: Callable[[], Callable[[list[str]], list[str]]] | None = None,
                   k: int = 20) -> DataFrame:
    """U4: text -> summary. Without ``load_model`` the native lead-k baseline;
    with it an iterator pandas UDF that loads the model once per task and
    calls it on Arrow batches."""
    if load_model is None:
        return df.withColumn(out, lead_words(text, k))

    @F.pandas_udf(T.StringType())
    def gen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for s in batches:
            yield pd.Series(model(s.tolist()), index=s.index, dtype=object)
    # not deterministic for the optimizer: a later filter must not move the model below an earlier one
    return df.withColumn(out, gen.asNondeterministic()(F.col(text)))


def generate_chain(df: DataFrame, load_model: Callable[[], Callable[[list[str]], list[str]]], key: str = "id",
                   prompt_tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """F6 -> U4 -> F7: (predictions, skipped). Rows with too long a prompt never
    reach the model; empty predictions are dropped; ``skipped`` are the keys of
    all rows without a prediction and why."""
    from textforge.operators import chat as CH
    lengths = prompt_tokens if prompt_tokens is not None else CH.prompt_lengths(df, keep=(key,))
    fit, long = CH.skip_long_prompts(lengths)
    made = batch_generate(df.join(fit.select(key), key, "left_semi"), load_model=load_model)
    kept = CH.skip_empty_predictions(made)
    empty = fit.select(key).join(kept.select(key), key, "left_anti").select(key, F.lit("empty prediction").alias("reason"))
    return kept, long.select(key, F.lit("prompt too long").alias("reason")).unionByName(empty)


def hash_buckets(text: Column | str, dim: int = 64, tokenizer: str = "unicode") -> Column:
    """Bucket of every token (JVM-side tokenising; the first 32 bits of its MD5,
    which every engine computes alike)."""
    toks = rouge_tokens(text, tokenizer)
    return F.transform(toks, lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int"))


@functools.lru_cache(maxsize=None)
def _bincount_l2(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def bincount(buckets: pd.Series) -> pd.Series:
        out = []
        for b in buckets:
            if b is None:
                out.append(None)
                continue
            v = np.bincount(np.asarray(b, dtype=np.int64), minlength=dim).astype(np.float64)
            norm = float(np.sqrt(np.dot(v, v)))
            out.append(v / norm if norm > 0 else v)
        return pd.Series(out, index=buckets.index)
    return bincount


def hashed_embedding(text: Column | str, dim: int = 64, tokenizer: str = "unicode") -> Column:
    """U5 default: L2-normalised hashed bag of words. Tokens and hashes are
    computed in the JVM; only the int bucket arrays cross to Python, where
    ``np.bincount`` counts them in linear time."""
    return _bincount_l2(dim)(hash_buckets(text, dim, tokenizer))


def batch_embed(df: DataFrame, text: str, out: str = "embedding",
                load_model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
                dim: int = 64) -> DataFrame:
    """Text -> vector; default hashed bag of words, else an iterator pandas
    UDF that loads the encoder once per task."""
    if load_model is None:
        return df.withColumn(out, hashed_embedding(text, dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def emb(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for s in batches:
            vecs = model(s.tolist())
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vecs], index=s.index)
    return df.withColumn(out, emb(F.col(text)))
