"""Registered queries: chat records, training input, evaluation, judge
(P2-P12, F4-F7, U1-U6, A1-A12, J1-J3, W1)."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import functions as F

from textforge.functions.prompts import PAIRWISE_PROMPT, SCALAR_PROMPT
from textforge.operators import chat as CH
from textforge.operators import evaluate as EV
from textforge.operators import judge as J
from textforge.plans import sql_text as S
from textforge.plans.fixtures_sql import with_bindings
from textforge.plans.joins import null_safe_join
from textforge.plans.registry import register
from textforge.sources import bindings as B
from textforge.sources.tables import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_template(template: str, **cols: str) -> str:
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(_q(literal))
        if field is not None:
            parts.append(f"coalesce({cols[field]}, '')")
    return "concat(" + ", ".join(parts) + ")"


# ---- P2, P3, P4, F4, F5, P5 -------------------------------------------------
_T = CH.DEFAULT_TEMPLATE
_H, _R = _T["message"].split("{role}")
_M, _E = _R.split("{content}")


def _msg_sql(role: str, content: str) -> str:
    return f"{_q(_H)}, '{role}', {_q(_M)}, coalesce({content}, ''), {_q(_E)}"


_TRAIN_TEXT = (f"concat({_q(_T['begin'])}, {_msg_sql('system', 'instruction')}, "
               f"{_msg_sql('user', 'input')}, {_msg_sql('assistant', 'output')})")
_PROMPT_TEXT = (f"concat({_q(_T['begin'])}, {_msg_sql('system', 'instruction')}, "
                f"{_msg_sql('user', 'input')}, {_q(_T['generation'])})")


def _ntok_sql(e: str) -> str:
    return f"CAST(len(list_filter(regexp_split_to_array({e}, '[{S.WS}]+'), lambda x: x <> '')) AS INTEGER)"


@register("build_messages", with_bindings(
    "SELECT id, 0 AS msg_index, 'system' AS role, instruction AS content FROM b2 UNION ALL "
    "SELECT id, 1, 'user', input FROM b2 UNION ALL SELECT id, 2, 'assistant', output FROM b2", "b2"))
def build_messages(spark, sf):
    d = B.instructions(spark, sf).select(
        "id", CH.build_messages("instruction", "input", "output").alias("m"))
    return d.select("id", F.posexplode("m").alias("msg_index", "msg")).select(
        "id", "msg_index", "msg.role", "msg.content")


@register("render_chat", with_bindings(f"SELECT id, {_TRAIN_TEXT} AS text FROM b2", "b2"))
def render_chat(spark, sf):
    return CH.training_text(B.instructions(spark, sf)).select("id", "text")


@register("token_count", f"SELECT doc_id, {_ntok_sql('text')} AS n_tokens FROM documents")
def token_count(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", CH.token_count("text").alias("n_tokens"))


_TRAIN = f"SELECT id, {_TRAIN_TEXT} AS text, {_ntok_sql(_TRAIN_TEXT)} AS length FROM b2"


@register("filter_max_tokens", with_bindings(
    f"SELECT id, length FROM ({_TRAIN}) t WHERE length <= {CH.MAX_SEQ_TOKENS}", "b2"))
def filter_max_tokens(spark, sf):
    return CH.filter_max_tokens(CH.training_text(B.instructions(spark, sf))).select("id", "length")


@register("filter_not_null", with_bindings(
    f"SELECT id, length FROM (SELECT id, CASE WHEN length <= {CH.MAX_SEQ_TOKENS} THEN text END AS text, "
    f"length FROM ({_TRAIN}) t) u WHERE text IS NOT NULL", "b2"))
def filter_not_null(spark, sf):
    t = CH.training_text(B.instructions(spark, sf))
    t = t.withColumn("text", F.when(F.col("length") <= CH.MAX_SEQ_TOKENS, F.col("text")))
    return CH.filter_not_null(t).select("id", "length")


@register("drop_columns", with_bindings(
    f"SELECT id, text FROM ({_TRAIN}) t WHERE length <= {CH.MAX_SEQ_TOKENS}", "b2"))
def drop_columns(spark, sf):
    t = CH.filter_not_null(CH.filter_max_tokens(CH.training_text(B.instructions(spark, sf))))
    return CH.drop_columns(t, "length")


@register("skip_long_prompts", with_bindings(
    f"SELECT id, {_ntok_sql(_PROMPT_TEXT)} AS prompt_tokens, "
    f"{_ntok_sql(_PROMPT_TEXT)} > {CH.MAX_PROMPT_TOKENS} AS skipped FROM b2", "b2"))
def skip_long_prompts(spark, sf):
    p = CH.prompt_lengths(B.instructions(spark, sf))
    return p.withColumn("skipped", F.col("prompt_tokens") > CH.MAX_PROMPT_TOKENS)


@register("skip_empty_predictions", with_bindings(
    "SELECT id, model FROM b3 WHERE length(predicted) > 0", "b3"))
def skip_empty_predictions(spark, sf):
    return CH.skip_empty_predictions(B.predictions(spark, sf)).select("id", "model")


@register("truncate_text", with_bindings(
    "SELECT id, model, substring(input, 1, 100) AS input FROM b3", "b3"))
def truncate_text(spark, sf):
    return B.predictions(spark, sf).select("id", "model", CH.truncate_text("input").alias("input"))


# ---- U1..U3 -----------------------------------------------------------------
def _count_batch(pdf: pd.DataFrame) -> pd.DataFrame:
    text = pdf["text"]
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": text.str.len().astype("Int64"),
                         "n_words": text.str.split().str.len().astype("Int64")})


@register("map_batches", f"SELECT doc_id, length(text) AS n_chars, CAST({_ntok_sql('text')} AS BIGINT) AS n_words "
          f"FROM documents")
def map_batches(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return CH.map_batches(d, _count_batch, "doc_id long, n_chars long, n_words long")


@register("map_rows", with_bindings(
    "SELECT id, instruction, output, CAST(length(input) AS INTEGER) AS input_chars FROM b2", "b2"))
def map_rows(spark, sf):
    return CH.map_rows(B.instructions(spark, sf), {"input_chars": F.length("input")}, ["input"])


@register("filter_rows", with_bindings(
    "SELECT id, output FROM b2 WHERE length(output) BETWEEN 20 AND 200", "b2"))
def filter_rows(spark, sf):
    b2 = B.instructions(spark, sf).select("id", "output")
    return CH.filter_rows(b2, F.length("output").between(20, 200))


# ---- A1..A4 -------------------------------------------------------------------
def _tok_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '[^\\pL\\pN]+'), lambda t: t <> '')"


_ROUGE_N = f"""
WITH toks AS (SELECT id, model, {_tok_sql('predicted')} AS pt, {_tok_sql('reference')} AS rt
              FROM b3 WHERE length(predicted) > 0),
big AS (SELECT id, model, pt, rt,
               list_transform(range(1, len(pt)), lambda i: pt[i] || ' ' || pt[i + 1]) AS pb,
               list_transform(range(1, len(rt)), lambda i: rt[i] || ' ' || rt[i + 1]) AS rb FROM toks),
grams AS (SELECT id, model, 1 AS n, unnest(pt) AS g, 1 AS cp, 0 AS cr FROM big
          UNION ALL SELECT id, model, 1, unnest(rt), 0, 1 FROM big
          UNION ALL SELECT id, model, 2, unnest(pb), 1, 0 FROM big
          UNION ALL SELECT id, model, 2, unnest(rb), 0, 1 FROM big),
pg AS (SELECT id, model, n, g, sum(cp) AS cp, sum(cr) AS cr FROM grams GROUP BY id, model, n, g),
pn AS (SELECT id, model, n, sum(least(cp, cr)) AS hit, sum(cp) AS np, sum(cr) AS nr FROM pg GROUP BY id, model, n),
base AS (SELECT id, model, n FROM toks JOIN (SELECT 1 AS n UNION ALL SELECT 2) k ON TRUE),
sc AS (SELECT b.id, b.model, b.n,
              coalesce(hit, 0) / greatest(coalesce(np, 0), 1) AS p,
              coalesce(hit, 0) / greatest(coalesce(nr, 0), 1) AS r
       FROM base b LEFT JOIN pn USING (id, model, n)),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END AS f FROM sc)
SELECT id, model,
       max(p) FILTER (WHERE n = 1) AS rouge1_p, max(r) FILTER (WHERE n = 1) AS rouge1_r,
       max(f) FILTER (WHERE n = 1) AS rouge1_f, max(p) FILTER (WHERE n = 2) AS rouge2_p,
       max(r) FILTER (WHERE n = 2) AS rouge2_r, max(f) FILTER (WHERE n = 2) AS rouge2_f
FROM f GROUP BY id, model"""


def _scored_preds(spark, sf):
    return CH.skip_empty_predictions(B.predictions(spark, sf))


@register("rouge_n", with_bindings(_ROUGE_N, "b3"))
def rouge_n(spark, sf):
    return EV.rouge_n(_scored_preds(spark, sf), ["id", "model"])


@register("rouge_n_corpus", with_bindings(
    f"SELECT model, avg(rouge1_f) AS rouge1, avg(rouge2_f) AS rouge2, count(*) AS n "
    f"FROM ({_ROUGE_N}) r GROUP BY model", "b3"))
def rouge_n_corpus(spark, sf):
    return EV.rouge_corpus(EV.rouge_n(_scored_preds(spark, sf), ["id", "model"]),
                           variants=("rouge1", "rouge2"))


# a row of LCS lengths over the prediction's words, folded over the reference's
_LCS = """coalesce(list_last(list_reduce(rt, lambda prev, t: list_reduce(list_zip(pt, generate_series(1, len(pt))), lambda acc, u:
  list_append(acc, greatest(coalesce(acc[u[2] - 1], 0), prev[u[2]], CASE WHEN u[1] = t THEN coalesce(prev[u[2] - 1], 0) + 1 ELSE 0 END)),
  []::BIGINT[]), list_transform(pt, lambda z: 0::BIGINT))), 0)"""
_PRF = ("CASE WHEN n > 0 THEN hit / n ELSE 0e0 END AS {0}_p, CASE WHEN m > 0 THEN hit / m ELSE 0e0 END AS {0}_r, "
        "CASE WHEN hit > 0 THEN 2e0 * (hit / n) * (hit / m) / (hit / n + hit / m) ELSE 0e0 END AS {0}_f")
_ROUGE_L = (f"SELECT id, model, {_PRF.format('rougeL')} FROM (SELECT id, model, len(pt) AS n, len(rt) AS m, {_LCS} AS hit "
            f"FROM (SELECT id, model, {_tok_sql('predicted')} AS pt, {_tok_sql('reference')} AS rt FROM b3 WHERE length(predicted) > 0) t) h")
# the same fold with the matched positions in place of their number: (reference line, predicted line) -> positions
_PATH = """list_last(list_reduce(list_zip(rt, generate_series(1, len(rt))), lambda prev, t: list_reduce(list_zip(pt, generate_series(1, len(pt))),
  lambda acc, u: list_append(acc, CASE WHEN u[1] = t[1] THEN list_append(CASE WHEN u[2] = 1 THEN [] ELSE prev[u[2] - 1] END, t[2])
    WHEN u[2] > 1 AND len(acc[u[2] - 1]) > len(prev[u[2]]) THEN acc[u[2] - 1] ELSE prev[u[2]] END), []::BIGINT[][]),
  list_transform(pt, lambda z: []::BIGINT[])))"""
_ROUGE_LSUM = f"""SELECT id, model, {_PRF.format('rougeLsum')} FROM (
  SELECT s.id, s.model, max(s.n) AS n, max(s.m) AS m, coalesce(sum(least(u.c, w.cp, w.cr)), 0) AS hit
  FROM (SELECT id, model, coalesce(len({_tok_sql("replace(predicted, chr(10), ' ')")}), 0) AS n,
               coalesce(len({_tok_sql("replace(reference, chr(10), ' ')")}), 0) AS m FROM b12) s
  LEFT JOIN (SELECT id, model, tok, count(*) AS c FROM (
      SELECT DISTINCT id, model, ri, pos, rt[pos] AS tok FROM (SELECT id, model, ri, rt, unnest({_PATH}) AS pos FROM (
        SELECT id, model, ri, {_tok_sql('rl')} AS rt, {_tok_sql('pl')} AS pt FROM (
          SELECT id, model, ri, rl, unnest(string_split(predicted, chr(10))) AS pl FROM (
            SELECT id, model, predicted, unnest(string_split(reference, chr(10))) AS rl,
                   unnest(generate_series(1, len(string_split(reference, chr(10))))) AS ri FROM b12) a) b) c
        WHERE len(rt) > 0 AND len(pt) > 0) d) e GROUP BY id, model, tok) u ON u.id = s.id AND u.model = s.model
  LEFT JOIN (SELECT id, model, tok, sum(cp) AS cp, sum(cr) AS cr FROM (
      SELECT id, model, unnest({_tok_sql("replace(predicted, chr(10), ' ')")}) AS tok, 1 AS cp, 0 AS cr FROM b12 UNION ALL
      SELECT id, model, unnest({_tok_sql("replace(reference, chr(10), ' ')")}), 0, 1 FROM b12) k GROUP BY id, model, tok) w
    ON w.id = u.id AND w.model = u.model AND w.tok = u.tok
  GROUP BY s.id, s.model) h"""


@register("rouge_lsum_sentences", with_bindings(_ROUGE_LSUM, "b12"))
def rouge_lsum_sentences(spark, sf):
    return EV.rouge_lsum(B.summaries(spark, sf), ["id", "model"])


_REPLICATES = 96
_POISSON = " + ".join(f"CASE WHEN u >= {t} THEN 1 ELSE 0 END" for t in EV.poisson_thresholds())
_ALL_F = (f"SELECT a.id, a.model, rouge1_f AS rouge1, rouge2_f AS rouge2, rougeL_f AS \"rougeL\" FROM ({_ROUGE_N}) a "
          f"JOIN ({_ROUGE_L}) b ON a.id = b.id AND a.model = b.model")
_INTERVAL = f"""SELECT model, variant, s[1 + CAST(floor(len(s) * 0.025e0) AS INTEGER)] AS low, s[1 + CAST(floor(len(s) * 0.5e0) AS INTEGER)] AS mid,
  s[1 + CAST(floor(len(s) * 0.975e0) AS INTEGER)] AS high FROM (
  SELECT model, variant, list(v ORDER BY v) AS s FROM (
    SELECT model, r, unnest(['rouge1', 'rouge2', 'rougeL']) AS variant,
           unnest([sum(w * rouge1) / sum(w), sum(w * rouge2) / sum(w), sum(w * "rougeL") / sum(w)]) AS v FROM (
      SELECT *, {_POISSON} AS w FROM (
        SELECT f.*, r, CAST('0x' || substr(md5('0|' || (r // 8) || '|' || id), 4 * (r % 8) + 1, 4) AS INTEGER) AS u
        FROM ({_ALL_F}) f, (SELECT unnest(generate_series(0, {_REPLICATES - 1})) AS r) k) d) e WHERE w > 0 GROUP BY model, r) g
  GROUP BY model, variant) h"""


@register("rouge_interval", with_bindings(_INTERVAL, "b3"))
def rouge_interval(spark, sf):
    preds = _scored_preds(spark, sf)
    n = EV.rouge_n(preds, ["id", "model"])
    scores = n.join(EV.rouge_l(preds, ["id", "model"]), ["id", "model"])
    return EV.rouge_interval(scores, replicates=_REPLICATES)


@register("rouge_l", with_bindings(_ROUGE_L, "b3"))
def rouge_l(spark, sf):
    return EV.rouge_l(_scored_preds(spark, sf), ["id", "model"])


_LSUM_B3 = _ROUGE_LSUM.replace("FROM b12", "FROM (SELECT * FROM b3 WHERE length(predicted) > 0) z")


@register("rouge_lsum", with_bindings(_LSUM_B3, "b3"))
def rouge_lsum(spark, sf):
    return EV.rouge_lsum(_scored_preds(spark, sf), ["id", "model"])


@register("rouge_corpus", with_bindings(
    f"SELECT n.model, avg(rouge1_f) AS rouge1, avg(rouge2_f) AS rouge2, avg(\"rougeL_f\") AS \"rougeL\", "
    f"avg(\"rougeLsum_f\") AS \"rougeLsum\", count(*) AS n FROM ({_ROUGE_N}) n JOIN ({_ROUGE_L}) l ON l.id = n.id AND l.model = n.model "
    f"JOIN ({_LSUM_B3}) s ON s.id = n.id AND s.model = n.model GROUP BY n.model", "b3"))
def rouge_corpus(spark, sf):
    return EV.rouge_corpus(EV.rouge_scores(_scored_preds(spark, sf), ["id", "model"]))


# ---- A5..A8, P7, J1..J3, W1 ---------------------------------------------------
_POOL = """SELECT label, CAST(i - 1 AS INTEGER) AS dim, sum(CAST(v AS DOUBLE)) / greatest(count(*), 1e-9) AS value
FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) x
GROUP BY label, i"""


# token vectors with a real mask: some positions are padding, and every fifth label has nothing else
_MASK_SQL = "CASE WHEN label % 5 = 4 OR vec_id % 4 = 0 THEN 0 ELSE 1 END"
_MASKED = f"""SELECT label, CAST(i - 1 AS INTEGER) AS dim, sum(CAST(v AS DOUBLE) * k) / greatest(sum(k), 1e-9) AS value
FROM (SELECT label, {_MASK_SQL} AS k, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) x
GROUP BY label, i"""


@register("masked_mean_pool", _MASKED)
def masked_mean_pool(spark, sf):
    mask = F.when((F.col("label") % 5 == 4) | (F.col("vec_id") % 4 == 0), 0).otherwise(1)
    return EV.masked_mean_pool(read_table(spark, sf, "embeddings"), ["label"], mask=mask)


_COS = ("list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-8) * "
        "greatest(sqrt(list_inner_product({b}, {b})), 1e-8))")


def _cos_sql(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


@register("cosine_similarity", f"""
WITH pooled AS (SELECT label, list(value ORDER BY dim) AS centroid FROM ({_POOL}) p GROUP BY label)
SELECT e.vec_id, e.label, {_cos_sql('CAST(e.embedding AS DOUBLE[])', 'p.centroid')} AS similarity
FROM embeddings e JOIN pooled p USING (label)""")
def cosine_similarity(spark, sf):
    e = read_table(spark, sf, "embeddings")
    cent = EV.pooled_vectors(EV.masked_mean_pool(e, ["label"]), ["label"])
    return null_safe_join(e, cent, ["label"]).select(
        "vec_id", "label", EV.cosine_similarity("embedding", "vector").alias("similarity"))


_SIM = f"SELECT id, model, {_cos_sql('CAST(ref_vec AS DOUBLE[])', 'CAST(pred_vec AS DOUBLE[])')} AS similarity FROM b4"


def _sims(spark, sf):
    return EV.batch_similarity(B.embedding_pairs(spark, sf))


@register("batch_similarity", with_bindings(_SIM, "b4"))
def batch_similarity(spark, sf):
    return _sims(spark, sf)


@register("round_score", with_bindings(
    f"SELECT id, model, round_even(similarity, 4) + 0.0 AS similarity FROM ({_SIM}) s", "b4"))
def round_score(spark, sf):
    return _sims(spark, sf).withColumn("similarity", CH.round_score("similarity", 4))


_SUMMARY = f"""SELECT model, avg(similarity) AS mean, stddev_pop(similarity) AS std, min(similarity) AS min,
       max(similarity) AS max, count(similarity) AS n,
       avg(CASE WHEN similarity > 0.8e0 THEN 1e0 ELSE 0e0 END) AS pct_above_0_8,
       avg(CASE WHEN similarity > 0.7e0 THEN 1e0 ELSE 0e0 END) AS pct_above_0_7,
       avg(CASE WHEN similarity > 0.6e0 THEN 1e0 ELSE 0e0 END) AS pct_above_0_6,
       avg(CASE WHEN similarity < 0.5e0 THEN 1e0 ELSE 0e0 END) AS pct_below_0_5
FROM ({_SIM}) s GROUP BY model"""


@register("similarity_summary", with_bindings(_SUMMARY, "b4"))
def similarity_summary(spark, sf):
    return EV.similarity_summary(_sims(spark, sf))


@register("align_predictions", with_bindings(
    "SELECT t.id, p.model, t.output AS reference, p.predicted FROM b2 t JOIN b3 p ON p.id = t.id "
    "WHERE length(p.predicted) > 0", "b2", "b3"))
def align_predictions(spark, sf):
    tests = B.instructions(spark, sf).select("id", F.col("output").alias("reference"))
    preds = CH.skip_empty_predictions(B.predictions(spark, sf)).select("id", "model", "predicted")
    return EV.align_predictions(tests, preds)


@register("skipped_samples", with_bindings(
    "SELECT id FROM b2 WHERE id NOT IN (SELECT id FROM b3_gaps WHERE model = 'finetuned' "
    "AND length(predicted) > 0)", "b2", "b3_gaps"))
def skipped_samples(spark, sf):
    preds = CH.skip_empty_predictions(B.predictions_with_gaps(spark, sf)).where(F.col("model") == "finetuned")
    return EV.skipped_samples(B.instructions(spark, sf).select("id"), preds)


@register("compare_models", with_bindings(
    f"SELECT id, max(similarity) FILTER (WHERE model = 'finetuned') AS finetuned, "
    f"max(similarity) FILTER (WHERE model = 'base') AS base, "
    f"max(similarity) FILTER (WHERE model = 'finetuned') - max(similarity) FILTER (WHERE model = 'base') AS delta "
    f"FROM ({_SIM}) s GROUP BY id", "b4"))
def compare_models(spark, sf):
    return EV.compare_models(_sims(spark, sf))


_METRICS = ("mean", "std", "min", "max", "pct_above_0_8", "pct_above_0_7", "pct_above_0_6",
            "pct_below_0_5")
_CMP_SUM = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, max({m}) FILTER (WHERE model = 'finetuned') AS finetuned, "
    f"max({m}) FILTER (WHERE model = 'base') AS base, max({m}) FILTER (WHERE model = 'finetuned') - "
    f"max({m}) FILTER (WHERE model = 'base') AS delta FROM summ" for m in _METRICS)


@register("compare_summaries", with_bindings(
    f"SELECT * FROM (WITH summ AS ({_SUMMARY}) {_CMP_SUM}) x", "b4"))
def compare_summaries(spark, sf):
    return EV.compare_summaries(EV.similarity_summary(_sims(spark, sf)), _METRICS)


@register("running_mean_every_k", with_bindings(
    f"SELECT model, id, n, running_mean FROM (SELECT model, id, "
    f"row_number() OVER (PARTITION BY model ORDER BY id) AS n, avg(similarity) OVER (PARTITION BY model "
    f"ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_mean FROM ({_SIM}) s) r "
    f"WHERE n % 10 = 0", "b4"))
def running_mean_every_k(spark, sf):
    return EV.running_mean_every_k(_sims(spark, sf))


@register("batch_generate", with_bindings(
    f"SELECT id, array_to_string(list_filter(regexp_split_to_array(input, '[{S.WS}]+'), "
    f"lambda x: x <> '')[1:20], ' ') AS predicted FROM b2", "b2"))
def batch_generate(spark, sf):
    return EV.batch_generate(B.instructions(spark, sf).select("id", "input")).select("id", "predicted")


_DIM = 64
_EMBED = f"""SELECT d.doc_id, CAST(k.dim AS INTEGER) AS dim, coalesce(c.n / sqrt(sum(c.n * c.n) OVER (PARTITION BY d.doc_id)), 0e0) AS value
FROM documents d JOIN (SELECT unnest(generate_series(0, {_DIM - 1})) AS dim) k ON TRUE
LEFT JOIN (SELECT doc_id, dim, CAST(count(*) AS DOUBLE) AS n FROM (
  SELECT doc_id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {_DIM} AS dim FROM (
    SELECT doc_id, unnest({_tok_sql('text')}) AS t FROM documents) a) b GROUP BY doc_id, dim) c
ON c.doc_id = d.doc_id AND c.dim = k.dim"""


@register("batch_embed", _EMBED)
def batch_embed(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    return EV.batch_embed(d, "text", dim=_DIM).select("doc_id", F.posexplode("embedding").alias("dim", "value"))


def last_words_model():
    """A stand-in for a summariser: a text's last eight words, nothing for a text of an even number of words."""
    def model(texts: list[str]) -> list[str]:
        words = [(t or "").split(" ") for t in texts]
        return ["" if len(w) % 2 == 0 else " ".join(w[-8:]) for w in words]
    return model


_CHAIN = (f"SELECT id, CASE WHEN len(w) % 2 = 0 THEN '' ELSE array_to_string(w[-8:], ' ') END AS predicted, "
          f"{_ntok_sql(_PROMPT_TEXT)} > {CH.MAX_PROMPT_TOKENS} AS long FROM (SELECT *, string_split(input, ' ') AS w FROM b2) b")


@register("generate_chain", with_bindings(f"SELECT id, predicted FROM ({_CHAIN}) c WHERE NOT long AND predicted <> ''", "b2"))
def generate_chain(spark, sf):
    return EV.generate_chain(B.instructions(spark, sf), last_words_model)[0].select("id", "predicted")


@register("generate_chain_skipped", with_bindings(
    f"SELECT id, CASE WHEN long THEN 'prompt too long' ELSE 'empty prediction' END AS reason FROM ({_CHAIN}) c "
    f"WHERE long OR predicted = ''", "b2"))
def generate_chain_skipped(spark, sf):
    return EV.generate_chain(B.instructions(spark, sf), last_words_model)[1]


# ---- P8..P12, A9..A12, U6 ------------------------------------------------------
@register("judge_prompt_scalar", with_bindings(
    f"SELECT id, model, {_sql_template(SCALAR_PROMPT, input='input', reference='reference', prediction='predicted')} "
    f"AS prompt FROM b3", "b3"))
def judge_prompt_scalar(spark, sf):
    p = B.predictions(spark, sf)
    return p.select("id", "model", J.judge_prompt_scalar("input", "reference", "predicted").alias("prompt"))


@register("judge_prompt_pairwise", with_bindings(
    f"SELECT a.id, {_sql_template(PAIRWISE_PROMPT, input='a.input', reference='a.reference', prediction_a='a.predicted', prediction_b='b.predicted')} "
    f"AS prompt FROM b3 a JOIN b3 b ON a.id = b.id AND a.model = 'base' AND b.model = 'finetuned'", "b3"))
def judge_prompt_pairwise(spark, sf):
    p = B.predictions(spark, sf)
    a = p.where(F.col("model") == "base").select("id", "input", "reference", F.col("predicted").alias("pa"))
    b = p.where(F.col("model") == "finetuned").select("id", F.col("predicted").alias("pb"))
    return a.join(b, "id").select("id", J.judge_prompt_pairwise("input", "reference", "pa", "pb").alias("prompt"))


_WS_TRIM = S.trim_ws


def _fence_sql(raw: str) -> str:
    t = _WS_TRIM(raw)
    inner = f"string_split({t}, '```')[2]"
    inner = f"CASE WHEN starts_with({inner}, 'json') THEN substring({inner}, 5) ELSE {inner} END"
    return _WS_TRIM(f"CASE WHEN starts_with({t}, '```') THEN {inner} ELSE {t} END")


_FENCED = f"SELECT id, attempt, {_fence_sql('raw')} AS text FROM b5"


@register("strip_code_fence", with_bindings(_FENCED, "b5"))
def strip_code_fence(spark, sf):
    return B.raw_verdicts(spark, sf).select("id", "attempt", J.strip_code_fence("raw").alias("text"))


def _valid_sql(t: str, keys=J.REQUIRED_KEYS) -> str:
    conds = " AND ".join(f"json_exists({t}, '$.{k}')" for k in keys)
    return f"coalesce(try(json_valid({t}) AND json_type({t}) = 'OBJECT' AND {conds}), false)"


_PARSED = f"""SELECT id, attempt, {_valid_sql('text')} AS valid,
  CASE WHEN {_valid_sql('text')} THEN CAST(json_extract_string(text, '$.faithfulness') AS DOUBLE) END AS faithfulness,
  CASE WHEN {_valid_sql('text')} THEN CAST(json_extract_string(text, '$.darija_quality') AS DOUBLE) END AS darija_quality,
  CASE WHEN {_valid_sql('text')} THEN CAST(json_extract_string(text, '$.conciseness') AS DOUBLE) END AS conciseness,
  CASE WHEN {_valid_sql('text')} THEN json_extract_string(text, '$.reasoning') END AS reasoning
FROM ({_FENCED}) f"""


@register("parse_verdict", with_bindings(_PARSED, "b5"))
def parse_verdict(spark, sf):
    p = J.parsed_attempts(B.raw_verdicts(spark, sf))
    return p.select("id", "attempt", F.col("verdict").isNotNull().alias("valid"),
                    *[F.col(f"verdict.{f}").alias(f) for f in J.SCALAR_VERDICT.fieldNames()])


_FIRST = f"""SELECT id, faithfulness, darija_quality, conciseness,
       coalesce(reasoning, '{J.FAILED_REASON}') AS reasoning, valid, attempts_used FROM (
  SELECT i.id, v.faithfulness, v.darija_quality, v.conciseness,
         CASE WHEN v.id IS NULL THEN NULL ELSE v.reasoning END AS reasoning,
         v.id IS NOT NULL AS valid, CAST(coalesce(v.attempt, i.last) AS INTEGER) AS attempts_used
  FROM (SELECT id, max(attempt) AS last FROM b5 GROUP BY id) i
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt) AS rn
             FROM ({_PARSED}) p WHERE valid) v ON v.id = i.id AND v.rn = 1) x"""


@register("judge_first_valid_attempt", with_bindings(_FIRST, "b5"))
def judge_first_valid_attempt(spark, sf):
    return J.judge_first_valid_attempt(B.raw_verdicts(spark, sf))


@register("verdict_fallback", with_bindings(
    f"SELECT id, faithfulness, reasoning FROM ({_FIRST}) f WHERE NOT valid", "b5"))
def verdict_fallback(spark, sf):
    v = J.judge_first_valid_attempt(B.raw_verdicts(spark, sf))
    return v.where(~F.col("valid")).select("id", "faithfulness", "reasoning")


@register("judge_mean_scores", with_bindings(
    f"SELECT avg(faithfulness) AS faithfulness, avg(darija_quality) AS darija_quality, "
    f"avg(conciseness) AS conciseness, (sum(faithfulness) + sum(darija_quality) + sum(conciseness)) / "
    f"(3 * count(faithfulness)) AS overall, count(faithfulness) AS n_valid FROM ({_FIRST}) f", "b5"))
def judge_mean_scores(spark, sf):
    return J.judge_mean_scores(J.judge_first_valid_attempt(B.raw_verdicts(spark, sf)))


@register("judge_failure_rate", with_bindings(
    f"SELECT count(*) AS n, count(*) FILTER (WHERE NOT valid) AS n_failed, "
    f"count(*) FILTER (WHERE NOT valid) / count(*) AS failure_rate, avg(attempts_used) AS mean_attempts "
    f"FROM ({_FIRST}) f", "b5"))
def judge_failure_rate(spark, sf):
    return J.judge_failure_rate(J.judge_first_valid_attempt(B.raw_verdicts(spark, sf)))


_AXES_SQL = " UNION ALL ".join(
    [f"SELECT '{a}' AS axis, json_extract_string(raw, '$.{a}.winner') AS winner, "
     f"json_extract_string(raw, '$.{a}.confidence') AS confidence FROM b5p" for a in J.AXES]
    + ["SELECT 'overall', json_extract_string(raw, '$.overall_winner'), "
       "json_extract_string(raw, '$.overall_confidence') FROM b5p"])


@register("judge_win_rate", with_bindings(
    f"SELECT axis, winner, confidence, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY axis) AS share "
    f"FROM ({_AXES_SQL}) l GROUP BY axis, winner, confidence", "b5p"))
def judge_win_rate(spark, sf):
    return J.judge_win_rate(B.raw_pairwise(spark, sf))


_PROMPTS = (f"SELECT id, model, {_sql_template(SCALAR_PROMPT, input='input', reference='reference', prediction='predicted')} "
            f"AS prompt FROM b3")
_STUB = ("concat('{\"faithfulness\": ', 1 + length(prompt) % 5, ', \"darija_quality\": ', 5 - length(prompt) % 5, "
         "', \"conciseness\": ', 1 + length(prompt) // 7 % 5, ', \"reasoning\": \"stub 1\"}')")
_JUDGED = with_bindings(f"SELECT id, model, CAST(1 AS INTEGER) AS attempt, {_STUB} AS raw FROM ({_PROMPTS}) p", "b3")


def _prompts(spark, sf):
    return B.predictions(spark, sf).select(
        "id", "model", J.judge_prompt_scalar("input", "reference", "predicted").alias("prompt"))


@register("batch_judge", _JUDGED)
def batch_judge(spark, sf):
    return J.batch_judge(_prompts(spark, sf)).select("id", "model", "attempt", "raw")


def no_client():
    def client(texts: list[str]) -> list[str]:
        raise AssertionError(f"{len(texts)} prompts were asked again")
    return client


@register("judge_with_store", _JUDGED)
def judge_with_store(spark, sf):
    from textforge.plans.q_runs import _scratch
    store = _scratch(spark, "replies")
    J.judge_with_store(_prompts(spark, sf), store)
    return J.judge_with_store(_prompts(spark, sf), store, load_client=no_client).select("id", "model", "attempt", "raw")


@register("render_conversations", f"SELECT conv_id, concat({_q(_T['begin'])}, string_agg(concat({_q(_H)}, role, "
          f"{_q(_M)}, coalesce(text, ''), {_q(_E)}), '' ORDER BY turn)) AS text FROM conversations GROUP BY conv_id")
def render_conversations(spark, sf):
    return CH.render_conversations(read_table(spark, sf, "conversations"))
