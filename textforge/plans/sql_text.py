"""DuckDB (RE2) spellings of the cleaning rules, for the oracle SQL only.

RE2 has no backreferences, so ``collapse_runs`` becomes a list filter over
the characters: a character is dropped when it equals the two before it
and is not a newline.
"""

from __future__ import annotations

# --- fixed values: the same classes as textforge.functions.text, RE2 syntax ---
WS = ("\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
URL = f"https?://[^{WS}]+|www\\.[^{WS}]+"
TAG = "<[^\\n]*?>"
TATWEEL = "\\x{0640}"
DIACRITICS = "[\\x{064B}-\\x{065F}\\x{0670}]"
LAM_ALEF_LIGATURES = "[ﻻﻷﻹﻵ]"
KEEP = f"[^0-9a-zA-Z\\x{{0600}}-\\x{{06FF}}\\x{{00C0}}-\\x{{00FF}}{WS}]"
# --- end of fixed values ---


def _re(e: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({e}, '{pat}', '{rep}', 'g')"


def strip_urls(e: str) -> str:
    return _re(e, URL)


def strip_html_tags(e: str) -> str:
    return _re(e, TAG)


def drop_tatweel(e: str) -> str:
    return _re(e, TATWEEL)


def drop_diacritics(e: str) -> str:
    return _re(e, DIACRITICS)


def fold_alef(e: str) -> str:
    return f"translate({e}, 'إأآ', 'ااا')"


def fold_maqsura(e: str) -> str:
    return f"translate({e}, 'ى', 'ي')"


def fold_taa_marbuta(e: str) -> str:
    return f"translate({e}, 'ة', 'ه')"


def expand_lamalef(e: str) -> str:
    return _re(e, LAM_ALEF_LIGATURES, "لا")


def filter_charset(e: str) -> str:
    return _re(e, KEEP)


def squeeze_whitespace(e: str) -> str:
    return _re(_re(e, f"[{WS}]+", " "), "^ | $")


def trim_ws(e: str) -> str:
    return _re(e, f"^[{WS}]+|[{WS}]+$")


def before_runs(e: str) -> str:
    """C1..C8 of ``clean_text`` (everything before ``collapse_runs``)."""
    e = strip_html_tags(strip_urls(e))
    e = drop_diacritics(drop_tatweel(e))
    e = fold_taa_marbuta(fold_maqsura(fold_alef(e)))
    return expand_lamalef(e)


def after_runs(e: str) -> str:
    """C10, C11."""
    return squeeze_whitespace(filter_charset(e))


def collapse_runs_select(key: str, text_expr: str, source: str, out: str = "t") -> str:
    """``SELECT key, <collapse_runs(text_expr)> AS out FROM source`` for DuckDB."""
    return (
        f"SELECT {key}, CASE WHEN cs IS NULL THEN NULL ELSE array_to_string(list_filter(cs, "
        f"lambda ch, i: NOT (i > 2 AND ch = cs[i - 1] AND ch = cs[i - 2] AND ch <> chr(10))), '') "
        f"END AS {out} FROM (SELECT {key}, regexp_extract_all({text_expr}, '(?s).') AS cs "
        f"FROM {source}) _runs")


def clean_text_select(key: str, text_col: str, source: str, out: str = "cleaned") -> str:
    """``SELECT key, clean_text(text_col) AS out FROM source`` for DuckDB."""
    inner = collapse_runs_select(key, before_runs(text_col), source, "t")
    return f"SELECT {key}, {after_runs('t')} AS {out} FROM ({inner}) _c"
