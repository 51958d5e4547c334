"""Registered queries: sources, cleaning, filters, dedup, splits (S, C, F, P1, J4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textforge.functions import text as T
from textforge.operators import corpus as C
from textforge.plans import sql_text as S
from textforge.plans.fixtures_sql import with_bindings
from textforge.plans.registry import register
from textforge.sources import bindings as B
from textforge.sources.tables import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- S1 ------------------------------------------------------------------
@register("scan_corpus", with_bindings("SELECT split, pos, article, headline FROM b1", "b1"))
def scan_corpus(spark, sf):
    return B.articles(spark, sf).select("split", "pos", "article", "headline")


# ---- C1..C12: one query per rule over the table whose text exercises it ----
# --- fixed values: probe texts added to the document-based rule queries ---
# The test documents hold no Arabic and no exotic whitespace, so the golden
# vectors of the reference's tests and the hostile Unicode cases travel with
# the table (negative ids) and reach the oracle comparison too.
PROBES = (
    "<p>إعلان</p>", "مـر", "مَرْ", "على", "ة", "ل" + "ا" * 5, "ﻻ", "إأآ ﻵ لاااا",
    "café résumé", "text @#$% text", "a\u00A0b", "x<b\ry>z", "x<b\u2028y>z", "aaa\u2003bbb",
    "www.x\u00A0y", "a\u001Cb", "\r\r\r\rq", "!!!!a", "\U0001F600\U0001F600\U0001F600k", "<a\nb>c", "  ",
)
# --- end of fixed values ---
_PROBE_SQL = " UNION ALL ".join(f"SELECT {-(i + 1)} AS doc_id, {_q(t)} AS text" for i, t in enumerate(PROBES))
DOCS_SQL = f"(SELECT doc_id, text FROM documents UNION ALL {_PROBE_SQL}) docs"


def documents_with_probes(spark, sf):
    probes = spark.createDataFrame([(-(i + 1), t) for i, t in enumerate(PROBES)], "doc_id long, text string")
    return read_table(spark, sf, "documents").select("doc_id", "text").unionByName(probes)


def _rule_query(name, table, key, col, spark_fn, sql_expr):
    src = DOCS_SQL if table == "documents" else table

    @register(name, f"SELECT {key}, {sql_expr(col)} AS cleaned FROM {src}")
    def q(spark, sf):
        d = documents_with_probes(spark, sf) if table == "documents" else read_table(spark, sf, table)
        return d.select(key, spark_fn(col).alias("cleaned"))
    return q


for _name, _table, _key, _col in [
    ("strip_urls", "pages", "page_id", "html"),
    ("strip_html_tags", "pages", "page_id", "html"),
    ("drop_tatweel", "documents", "doc_id", "text"),
    ("drop_diacritics", "documents", "doc_id", "text"),
    ("fold_alef", "documents", "doc_id", "text"),
    ("fold_maqsura", "documents", "doc_id", "text"),
    ("fold_taa_marbuta", "documents", "doc_id", "text"),
    ("expand_lamalef", "documents", "doc_id", "text"),
    ("filter_charset", "documents", "doc_id", "text"),
    ("squeeze_whitespace", "documents", "doc_id", "text"),
]:
    _rule_query(_name, _table, _key, _col, T.CLEANERS[_name], getattr(S, _name))


@register("collapse_runs", S.collapse_runs_select("doc_id", "text", DOCS_SQL, "cleaned"))
def collapse_runs(spark, sf):
    return documents_with_probes(spark, sf).select("doc_id", T.collapse_runs("text").alias("cleaned"))


@register("clean_text", S.clean_text_select("doc_id", "text", DOCS_SQL))
def clean_text(spark, sf):
    return documents_with_probes(spark, sf).select("doc_id", T.clean_text("text").alias("cleaned"))


@register("clean_text_pages", S.clean_text_select("page_id", "html", "pages"))
def clean_text_pages(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.clean_text("html").alias("cleaned"))


@register("clean_text_conversations", S.clean_text_select("conv_id, turn", "text", "conversations"))
def clean_text_conversations(spark, sf):
    return read_table(spark, sf, "conversations").select(
        "conv_id", "turn", T.clean_text("text").alias("cleaned"))


# ---- C13 / C14 -------------------------------------------------------------
_CLEAN_B1 = (
    "SELECT b.split, b.split_rank, b.pos, a.cleaned AS article, h.cleaned AS headline FROM b1 b "
    f"JOIN ({S.clean_text_select('split_rank, pos', 'article', 'b1')}) a ON a.split_rank = b.split_rank AND a.pos = b.pos "
    f"JOIN ({S.clean_text_select('split_rank, pos', 'headline', 'b1')}) h ON h.split_rank = b.split_rank AND h.pos = b.pos"
)


def _with_clean(sql: str) -> str:
    return with_bindings(sql.replace("FROM cleaned", f"FROM ({_CLEAN_B1}) cleaned"), "b1")


@register("clean_corpus", _with_clean("SELECT split, pos, article, headline FROM cleaned"))
def clean_corpus(spark, sf):
    return C.clean_corpus(B.articles(spark, sf)).select("split", "pos", "article", "headline")


_SHORT = f"length({S.trim_ws('headline')}) < {C.HEADLINE_MIN_LENGTH}"
_REPORT_SQL = f"""
SELECT r.split, count(*) AS rows_in,
       count(*) FILTER (WHERE {_SHORT.replace('headline', 'c.headline')}) AS short,
       count(*) FILTER (WHERE NOT ({_SHORT.replace('headline', 'c.headline')}) AND rn > 1) AS duplicate,
       count(*) FILTER (WHERE NOT ({_SHORT.replace('headline', 'c.headline')}) AND rn = 1) AS kept,
       CAST(sum(coalesce(length(r.article), 0) + coalesce(length(r.headline), 0)
           - coalesce(length(c.article), 0) - coalesce(length(c.headline), 0)) AS BIGINT) AS chars_removed
FROM b1 r JOIN (SELECT *, CASE WHEN {_SHORT} THEN NULL ELSE row_number() OVER
      (PARTITION BY headline, {_SHORT} ORDER BY split_rank, pos) END AS rn FROM cleaned) c ON c.split_rank = r.split_rank AND c.pos = r.pos
GROUP BY r.split"""


@register("cleaning_report", _with_clean(_REPORT_SQL))
def cleaning_report(spark, sf):
    return C.cleaning_report(B.articles(spark, sf))


# ---- F1, F2, P1 ------------------------------------------------------------
@register("filter_min_length", _with_clean(
    f"SELECT split, pos, headline FROM cleaned WHERE NOT ({_SHORT})"))
def filter_min_length(spark, sf):
    c = C.clean_corpus(B.articles(spark, sf), ["headline"])
    return C.filter_min_length(c, "headline", C.HEADLINE_MIN_LENGTH).select("split", "pos", "headline")


_DEDUP = (f"SELECT split, split_rank, pos, article, headline FROM (SELECT *, row_number() OVER "
          f"(PARTITION BY headline ORDER BY split_rank, pos) AS rn FROM cleaned "
          f"WHERE NOT ({_SHORT})) d WHERE rn = 1")


@register("dedup_keep_first", _with_clean(_DEDUP))
def dedup_keep_first(spark, sf):
    return C.prepare_corpus(B.articles(spark, sf)).select(
        "split", "split_rank", "pos", "article", "headline")


@register("to_instruction", _with_clean(
    f"SELECT pos, {_q(C.INSTRUCTION)} AS instruction, article AS input, headline AS output "
    f"FROM ({_DEDUP}) f"))
def to_instruction(spark, sf):
    return C.to_instruction(C.prepare_corpus(B.articles(spark, sf)), keep=["pos"])


# ---- F9..F14 ---------------------------------------------------------------
def _bucket_sql(idc: str, seed: int = C.SPLIT_SEED) -> str:
    return (f"CAST(CAST(('0x' || substr(md5('{seed}|' || CAST({idc} AS VARCHAR)), 1, 8)) AS BIGINT) "
            f"AS DOUBLE) / 4294967296.0")


def _split_sql(u: str) -> str:
    tr, va, _ = C.SPLIT_RATIOS
    return f"CASE WHEN {u} < {tr} THEN 'train' WHEN {u} < {tr + va} THEN 'val' ELSE 'test' END"


@register("split_hash", with_bindings(f"SELECT id, {_split_sql(_bucket_sql('id'))} AS split FROM b2", "b2"))
def split_hash(spark, sf):
    return C.split_hash(B.instructions(spark, sf).select("id"), "id")


_EXACT = f"""
SELECT id, CASE WHEN pos < n_train THEN 'train' WHEN pos < n_train + (rest - n_test) THEN 'val'
                ELSE 'test' END AS split
FROM (SELECT id, row_number() OVER (ORDER BY {_bucket_sql('id')}, id) - 1 AS pos,
             floor(count(*) OVER () * 0.9e0) AS n_train,
             count(*) OVER () - floor(count(*) OVER () * 0.9e0) AS rest,
             ceil((count(*) OVER () - floor(count(*) OVER () * 0.9e0)) * 0.5e0) AS n_test FROM b2) s"""


@register("split_exact", with_bindings(_EXACT, "b2"))
def split_exact(spark, sf):
    return C.split_exact(B.instructions(spark, sf).select("id"), "id")


@register("split_report", with_bindings(
    f"SELECT split, count(*) AS n FROM (SELECT {_split_sql(_bucket_sql('id'))} AS split FROM b2) s "
    f"GROUP BY split UNION ALL SELECT 'total', count(*) FROM b2", "b2"))
def split_report(spark, sf):
    return C.split_report(C.split_hash(B.instructions(spark, sf).select("id"), "id"))


@register("take_first_n", with_bindings("SELECT id, output FROM b2 ORDER BY id LIMIT 200", "b2"))
def take_first_n(spark, sf):
    return C.take_first_n(B.instructions(spark, sf).select("id", "output"), ["id"], 200)


@register("preview_rows", with_bindings(
    "SELECT id, model, substring(input, 1, 150) AS input, substring(reference, 1, 150) AS reference, "
    "substring(predicted, 1, 150) AS predicted FROM b3 ORDER BY model, id LIMIT 3", "b3"))
def preview_rows(spark, sf):
    return C.preview_rows(B.predictions(spark, sf), ["model", "id"],
                          ["input", "reference", "predicted"], n=3, width=150)


_PROMPTS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS slot, {_q(p)} AS prompt" for i, p in enumerate(C.BENCH_PROMPTS))


@register("assign_round_robin", with_bindings(
    f"SELECT m.label, m.request_id, p.prompt FROM b8 m JOIN ({_PROMPTS_SQL}) p "
    f"ON p.slot = m.request_id % {len(C.BENCH_PROMPTS)}", "b8"))
def assign_round_robin(spark, sf):
    m = B.measurements(spark, sf).select("label", "request_id")
    return C.assign_round_robin(m, "request_id")


@register("union_splits", _with_clean(
    f"SELECT pos, split, {_split_sql(_bucket_sql('pos'))} AS new_split FROM ({_DEDUP}) f"))
def union_splits(spark, sf):
    raw = B.articles(spark, sf)
    parts = [raw.where(F.col("split") == s) for s in C.SPLIT_ORDER]
    parts.append(raw.where(F.coalesce(~F.col("split").isin(*C.SPLIT_ORDER), F.lit(True))))       # whatever else there is
    prepared = C.prepare_corpus(C.union_splits(*parts)).select("pos", "split")
    return C.split_hash(prepared, "pos", out="new_split")


# ---- the whole preparation pipeline (entry) --------------------------------
_PIPE = (f"SELECT {_split_sql(_bucket_sql('pos'))} AS split, count(*) AS n_rows, "
         f"count(DISTINCT output) AS n_headlines, CAST(sum(length(input)) AS BIGINT) AS input_chars "
         f"FROM (SELECT pos, article AS input, headline AS output FROM ({_DEDUP}) f) g GROUP BY 1")


@register("prepare_corpus", _with_clean(_PIPE))
def prepare_corpus(spark, sf):
    rows = C.to_instruction(C.prepare_corpus(B.articles(spark, sf)), keep=["pos"])
    split = C.split_hash(rows, "pos")
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("output").alias("n_headlines"),
        F.sum(F.length("input")).alias("input_chars"))
