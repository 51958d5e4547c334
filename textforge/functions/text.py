"""Text cleaning as native Column expressions.

Java regexes differ from Python's: ``\\s``/``\\S`` are ASCII-only and ``.``
also stops at ``\\r``, U+0085, U+2028 and U+2029. The cleaning rules are
specified with Python semantics, so every class is spelled out: ``WS`` is
exactly the set of characters Python's ``str.isspace`` accepts, and "any
character but newline" is written ``[^\\n]``.

All functions map Column -> Column, stay inside whole-stage codegen and
return null for a null input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes and letters the rules are defined on ---
# Python whitespace (str.isspace / re \s on str), as a Java class body.
WS = "\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
URL_PATTERN = f"https?://[^{WS}]+|www\\.[^{WS}]+"
TAG_PATTERN = "<[^\\n]*?>"
TATWEEL = "\\u0640"
DIACRITICS = "[\\u064B-\\u065F\\u0670]"
ALEF_VARIANTS = "إأآ"      # alef with hamza below, hamza above, madda
BARE_ALEF = "ا"
ALEF_MAQSURA, YA = "ى", "ي"
TAA_MARBUTA, HA = "ة", "ه"
LAM_ALEF_LIGATURES = "[ﻻﻷﻹﻵ]"
LAM_ALEF = "لا"
RUN_PATTERN = "([^\\n])\\1{2,}"
KEEP_CHARSET = f"[^0-9a-zA-Z\\u0600-\\u06FF\\u00C0-\\u00FF{WS}]+"
# --- end of fixed values ---


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_urls(col: Column | str) -> Column:
    """Delete http(s) URLs and www. hosts up to the next whitespace."""
    return F.regexp_replace(_c(col), URL_PATTERN, "")


def strip_html_tags(col: Column | str) -> Column:
    """Delete ``<...>`` (shortest match, never across a newline)."""
    return F.regexp_replace(_c(col), TAG_PATTERN, "")


def drop_tatweel(col: Column | str) -> Column:
    """Delete the tatweel (U+0640)."""
    return F.regexp_replace(_c(col), TATWEEL, "")


def drop_diacritics(col: Column | str) -> Column:
    """C4: delete harakat U+064B-065F and the superscript alef U+0670."""
    return F.regexp_replace(_c(col), DIACRITICS, "")


def fold_alef(col: Column | str) -> Column:
    """hamza/madda alef forms -> bare alef."""
    return F.translate(_c(col), ALEF_VARIANTS, BARE_ALEF * len(ALEF_VARIANTS))


def fold_maqsura(col: Column | str) -> Column:
    """Alef maqsura -> ya."""
    return F.translate(_c(col), ALEF_MAQSURA, YA)


def fold_taa_marbuta(col: Column | str) -> Column:
    """Taa marbuta -> ha."""
    return F.translate(_c(col), TAA_MARBUTA, HA)


def expand_lamalef(col: Column | str) -> Column:
    """The four lam-alef ligatures -> lam + alef."""
    return F.regexp_replace(_c(col), LAM_ALEF_LIGATURES, LAM_ALEF)


def collapse_runs(col: Column | str) -> Column:
    """A run of three or more equal characters (not newline) -> two."""
    return F.regexp_replace(_c(col), RUN_PATTERN, "$1$1")


def filter_charset(col: Column | str) -> Column:
    """Keep digits, ASCII letters, Arabic block, Latin-1 letters, whitespace."""
    return F.regexp_replace(_c(col), KEEP_CHARSET, "")


def squeeze_whitespace(col: Column | str) -> Column:
    """C11: split on Unicode whitespace and join with one space (trimmed).

    Only runs that are not already a single space are rewritten, and after
    that the ends can only hold one U+0020, which ``trim`` removes."""
    return F.trim(F.regexp_replace(_c(col), f"[{WS}]{{2,}}|[{WS}&&[^ ]]", " "))


def trim_ws(col: Column | str) -> Column:
    """Python ``str.strip()``: trim Unicode whitespace at both ends."""
    return F.regexp_replace(_c(col), f"^[{WS}]+|[{WS}]+$", "")


# U+064B-U+065F and U+0670 as characters (the C4 class, built from its ranges)
_DIACRITIC_CHARS = "".join(chr(c) for c in range(0x064B, 0x0660)) + chr(0x0670)


def normalize_arabic(col: Column | str) -> Column:
    """C3-C9 in their fixed order.

    C3/C4 delete single characters and C5-C7 map single characters; no map
    produces a deleted character and no deleted character is mapped, so all
    five are one ``translate`` (source characters without a replacement are
    deleted): one pass instead of a regex plus a translate.
    """
    src = ALEF_VARIANTS + ALEF_MAQSURA + TAA_MARBUTA
    dst = BARE_ALEF * len(ALEF_VARIANTS) + YA + HA
    c = F.translate(_c(col), src + chr(0x0640) + _DIACRITIC_CHARS, dst)
    c = expand_lamalef(c)
    return collapse_runs(c)


# the characters of WS other than the space, from its ranges
_OTHER_WS = "".join(map(chr, [9, 10, 11, 12, 13, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def clean_text(col: Column | str) -> Column:
    """C1, C2, C3-C9, C10, C11 composed; one native expression chain.

    After C9 nothing depends on which whitespace character it is, so all become
    spaces in one ``translate``, and C10 and C11 work with short classes."""
    c = strip_html_tags(strip_urls(col))
    c = normalize_arabic(c)
    c = F.translate(c, _OTHER_WS, " " * len(_OTHER_WS))
    c = F.regexp_replace(c, "[^0-9a-zA-Z\\u0600-\\u06FF\\u00C0-\\u00FF ]+", "")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


CLEANERS = {
    "strip_urls": strip_urls,
    "strip_html_tags": strip_html_tags,
    "drop_tatweel": drop_tatweel,
    "drop_diacritics": drop_diacritics,
    "fold_alef": fold_alef,
    "fold_maqsura": fold_maqsura,
    "fold_taa_marbuta": fold_taa_marbuta,
    "expand_lamalef": expand_lamalef,
    "collapse_runs": collapse_runs,
    "filter_charset": filter_charset,
    "squeeze_whitespace": squeeze_whitespace,
    "clean_text": clean_text,
}
