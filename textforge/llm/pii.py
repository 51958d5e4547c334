"""Personal data with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it stands.
Then transducers rewrite disguises while every output character keeps the
range of source characters it came from:

1. characters: invisible ones vanish, full-width and mathematical forms and
   Cyrillic/Greek look-alikes inside a token that mixes scripts become ASCII;
2. spelled digits: runs of three or more number words become digits;
3. at/dot disguises: ``[at]``, ``(dot)``, `` at ``/`` dot `` between name parts,
   HTML and percent codes, and blanks around ``@`` and the dots after it.

The same detectors run on the rewritten text; a span there is mapped back to
source code points and added unless it touches a base span of its kind. Where
no transducer changes anything, there is nothing to add. Base spans always stay.
All of it is linear in the text: runs are scanned once, from their start, and a
run that comes to nothing is not entered again.

Null or empty text: no spans. Rows are independent (no exchange); repeated rows
and null ids keep their own rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textforge.llm.registry import register, table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a digit run that fails from its start fails from inside too: one try per run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@`` outwards: linear in
    the text where the plain pattern retries every start of a long run."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            yield start, last
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def detect(text: str) -> list[Span]:
    """The base spans of a text, by start, then kind."""
    out: list[Span] = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# --- transducers -----------------------------------------------------------

#: Look-alikes of ASCII letters (Cyrillic, Greek, Latin small capitals): fixed values.
LOOKALIKES = dict(zip(
    "аеорсухіјѕһԁԛԝѵмтвнкгАЕОРСУХІЈЅВНКМТοαερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
    "aeopcyxijshdqwvmtbhkrAEOPCYXIJSBHKMToaepviktuxABEZHIKMNOPTYXig"))
_INVISIBLE = "­​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_BLANK_FORMS = "       　"
_DASHES = "‐‑‒–—−"
_SEPARATORS = {"。": ".", "．": ".", "․": ".", "‧": ".", "·": ".", "•": ".", "﹫": "@", "＠": "@", "＋": "+"}
_ALIKE = "".join(LOOKALIKES)
# everything the character transducer may rewrite; most texts hold none of it
_ODD_CHAR = re.compile(f"[{_ALIKE}{_INVISIBLE}{_BLANK_FORMS}{_DASHES}{''.join(_SEPARATORS)}"
                       "！-～\U0001d400-\U0001d7ff①-⑳Ⓐ-⓪⁰-₉٠-٩۰-۹०-९]")
_MIXABLE = re.compile(f"[A-Za-z0-9@._%+\\-{_ALIKE}]+")

#: Spelled digits: fixed values.
NUMBER_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
                "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NUM = "(?:" + "|".join(NUMBER_WORDS) + ")"
_GAP = r"(?:[ \t\n]+|[ ]*[-,.()/][ ]*|[ ]*\b(?:dot|point|dash|hyphen|space)\b[ ]*)"
_MULT = r"(?:double|triple)"
_ITEM = rf"(?:(?:{_MULT}[ -]?)?(?:{_NUM})|[0-9]+)"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:(?:\+|plus)[ ]?)?{_ITEM}(?:{_GAP}{_ITEM}){{2,}}+", re.I)
_NUMBER_WORD = re.compile(_NUM, re.I)
_ALNUM = re.compile(r"[A-Za-z0-9]")
#: What a run may end in once its last item is taken off.
_DANGLING = re.compile(r"(?<![ \t\n,.()/-])(?:[ \t\n,.()/-]++(?:(?:dot|point|dash|hyphen|space|double|triple)(?![A-Za-z0-9]))?+)++\Z", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>\bplus\b[ ]?)|(?P<dot>[ ]*\b(?:dot|point)\b[ ]*)|(?P<dash>[ ]*\b(?:dash|hyphen|space)\b[ ]*)"
                           rf"|(?:(?P<mult>{_MULT})[ -]?)?\b(?P<num>{_NUM})\b|(?P<gap>[ \t\n,]+)|(?P<other>.)", re.I | re.S)
#: Letters that match ASCII ones without regard to case.
_FOLDED = str.maketrans("ſİı", "sii")

#: Top-level names that always make "x at y dot z" an address: fixed values, all
#: country codes and the common generic names (and any ``xn--`` name). Any other
#: name of three or more letters does so too unless a word of the host is one of PROSE.
TOP_LEVEL = frozenset((
    "com org net edu gov mil int info biz name pro aero asia cat coop jobs mobi museum post tel travel arpa app dev page "
    "cloud tech live blog shop store online site website space world life news media email mail wiki xyz top club agency "
    "academy company digital group network solutions systems software studio services center care health bank finance law "
    "art design photo music games zone team work works today global city earth green one example test invalid local "
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf "
    "cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gd ge gf gg "
    "gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn "
    "kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na "
    "nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh "
    "si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve "
    "vg vi vn vu wf ws ye yt za zm zw").split())

_OPEN, _CLOSE = r"[\[({<{]", r"[\])}>}]"
_AT_CODE = re.compile(rf"[ ]?{_OPEN}[ ]?(?:at|@|arroba|ät)[ ]?{_CLOSE}[ ]?|&#0*64;|&#x0*40;|&commat;|%40|[ ]?(?<![_*-])[_*-]++at[_*-]++[ ]?", re.I)
_DOT_CODE = re.compile(rf"[ ]?{_OPEN}[ ]?(?:dot|\.|punkt|punto|point|d0t)[ ]?{_CLOSE}[ ]?|&#0*46;|&#x0*2e;|&period;|%2e|[ ]?(?<![_*-])[_*-]++dot[_*-]++[ ]?", re.I)
#: Words that make "x at y dot z" prose when they stand in its host: fixed values.
PROSE = frozenset((
    "the a an this that these those his her its our your their my one each every any some no and or but if of on in at to by "
    "for from with as is are was were be been it he she we they you i not so then than there here when where which who what "
    "polka red green blue yellow black white orange pink purple grey gray brown laser quantum micro big small little tiny "
    "matrix product products pattern patterns plot").split())
# runs are found from their start only and never entered again, so each scan is linear
_AT = re.compile(r"(?<! )(?:[ ]++at[ ]++|[ ]*+@[ ]*+)", re.I)
_NAMES = re.compile(r"[A-Za-z0-9._%+-]++(?:[ ]++dot[ ]++[A-Za-z0-9._%+-]++)*+", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|[ ]+dot[ ]+|[ ]+\.[ ]*|[ ]*\.[ ]+)[A-Za-z0-9-]++)*+", re.I)
_DOT_WORD = re.compile(r"[ ]+dot[ ]+|[ ]+\.[ ]*|[ ]*\.[ ]+", re.I)
_SAID_DOT = re.compile(r" dot ", re.I)
_SENTENCE = re.compile(r"[^ ]\. ")
_PLAIN_HINT = re.compile(r" dot |[ ]@|@[ ]|@[A-Za-z0-9-]+(?: \.|\. )", re.I)
_IP_DOTS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[ ]*(?:\.|\bdot\b)[ ]*[0-9]{1,3}){3}(?![0-9])", re.I)
_IP_DOT = re.compile(r"[ ]*(?:\.|dot)[ ]*", re.I)
_IP_HINT = re.compile(r"[0-9](?: *dot *| +\. *| *\. +)[0-9]", re.I)
_CODE_HINT = re.compile(rf"{_OPEN}[ ]?(?:at|@|dot|\.|arroba|ät|punkt|punto|point|d0t)[ ]?{_CLOSE}|&#|&commat;|&period;|%40|%2e|[_*-](?:at|dot)[_*-]", re.I)


class Aligned:
    """A text whose every character remembers its source range [lo, hi)."""

    def __init__(self, text: str):
        self.text = text
        self.lo = np.arange(len(text), dtype=np.int32)
        self.hi = self.lo + np.int32(1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the disjoint, ordered, not empty ranges; each output character
        of an edit keeps the whole source range that the edit replaced."""
        if not edits:
            return
        s, e = (np.fromiter((x[k] for x in edits), np.int64, len(edits)) for k in (0, 1))
        new = np.fromiter((len(x[2]) for x in edits), np.int64, len(edits))
        # pieces: what stays before an edit, then what the edit puts there
        first = np.empty(2 * len(edits) + 1, np.int64)
        size, last, stays = first.copy(), first.copy(), np.zeros(len(first), bool)
        first[0], first[2::2], first[1::2] = 0, e, s
        size[:-1:2], size[-1], size[1::2] = s - first[:-1:2], len(self.text) - e[-1], new
        last[::2], last[1::2], stays[::2] = first[::2], e - 1, True
        step = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) * np.repeat(stays, size)
        self.lo, self.hi = self.lo[np.repeat(first, size) + step], self.hi[np.repeat(last, size) + step]
        parts, at = [], 0
        for a, b, text in edits:
            parts += (self.text[at:a], text)
            at = b
        parts.append(self.text[at:])
        self.text = "".join(parts)


def _characters(a: Aligned) -> None:
    edits = []
    for m in _ODD_CHAR.finditer(a.text):
        c = m.group()
        if c in _INVISIBLE:
            new = ""
        elif c in _BLANK_FORMS:
            new = " "
        elif c in _DASHES:
            new = "-"
        elif c in _SEPARATORS:
            new = _SEPARATORS[c]
        elif c in LOOKALIKES:
            continue  # judged below, by the token around it
        else:
            new = unicodedata.normalize("NFKC", c)
            if not new.isascii():
                d = unicodedata.decimal(c, None)
                new = str(d) if d is not None else c
        if new != c:
            edits.append((m.start(), m.end(), new))
    a.rewrite(edits)
    edits = []
    for m in _MIXABLE.finditer(a.text):
        token = m.group()
        if token.isascii() or not ("@" in token or any(c.isascii() and c.isalnum() for c in token)):
            continue  # plain ASCII, or a word wholly of another script
        edits += [(m.start() + i, m.start() + i + 1, LOOKALIKES[c]) for i, c in enumerate(token) if c in LOOKALIKES]
    a.rewrite(edits)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits of the runs of three or more number words and digits, each run
    scanned once; an item that is the start of a longer word is not part of its run."""
    edits = []
    for m in _SPELLED.finditer(text):
        run, at = m.group(), m.start()
        if _ALNUM.match(text, m.end()):
            cut = len(run)
            while cut and _ALNUM.match(run, cut - 1):   # the last item, and the gap before it
                cut -= 1
            run = _DANGLING.sub("", run[:cut])
            if not _SPELLED.fullmatch(run):
                continue
        if not _NUMBER_WORD.search(run):
            continue
        for p in _SPELLED_PART.finditer(run):
            s, e = at + p.start(), at + p.end()
            if p["plus"]:
                edits.append((s, e, "+"))
            elif p["dot"]:
                edits.append((s, e, "."))
            elif p["dash"]:
                edits.append((s, e, "-"))
            elif p["num"]:
                mult, num = ((p[k] or "").translate(_FOLDED).lower() for k in ("mult", "num"))
                edits.append((s, e, NUMBER_WORDS[num] * {"double": 2, "triple": 3}.get(mult, 1)))
            elif p["gap"]:
                edits.append((s, e, ""))
    return edits


def _is_host(tail: str) -> bool:
    """Whether the spelled host ``y dot z`` is one rather than prose."""
    labels = [x for x in re.split(r"[ .]+", _DOT_WORD.sub(".", tail).lower()) if x]
    end = labels[-1]
    if end in TOP_LEVEL or end.startswith("xn--"):
        return labels[0] not in ("the", "this", "that")     # "at the dot com boom"
    return len(end) >= 3 and end.isalpha() and not PROSE.intersection(labels)


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits of the addresses whose @ or dots are words or stand between blanks.
    Names and hosts are runs found in one pass each; every @ looks up its own."""
    names = [m.end() for m in _NAMES.finditer(text)]
    starts = [m.start() for m in _NAMES.finditer(text)]
    hosts = [m.span() for m in _HOST.finditer(text)]
    edits: list[tuple[int, int, str]] = []
    done = 0
    for at in _AT.finditer(text):
        s, e = at.span()
        k, h = bisect.bisect_right(names, s) - 1, bisect.bisect_right(hosts, (e, len(text) + 1)) - 1
        if s < done or k < 0 or names[k] != s or h < 0 or hosts[h][1] <= e or not _ALNUM.match(text, s - 1):
            continue
        done = hosts[h][1]      # accepted or not, its host is not searched again
        tail = text[e:done]
        spelled = "at" in at.group().lower()
        end = _SENTENCE.search(tail)
        if end and (spelled or not _SAID_DOT.search(tail)):
            tail = tail[: end.start() + 1]      # a sentence ends here
        if spelled and not (_SAID_DOT.search(tail) and _is_host(tail)):
            continue                            # "meet at example.com", "look at the dot on"
        if not spelled and at.group() == "@" and not _DOT_WORD.search(text, e, done):
            continue
        if "." not in tail and not _SAID_DOT.search(tail):
            continue
        left = max(starts[k], edits[-1][1] if edits else 0)
        edits += [(left + d.start(), left + d.end(), ".") for d in _DOT_WORD.finditer(text[left:s])]
        if e - s > 1:
            edits.append((s, e, "@"))
        edits += [(e + d.start(), e + d.end(), ".") for d in _DOT_WORD.finditer(tail)]
    return edits


def _at_dot(a: Aligned) -> None:
    if _CODE_HINT.search(a.text):
        marks = [(m.start(), m.end(), "@") for m in _AT_CODE.finditer(a.text)]
        marks += [(m.start(), m.end(), ".") for m in _DOT_CODE.finditer(a.text)]
        marks.sort()
        kept, end = [], 0
        for x in marks:
            if x[0] >= end:
                kept.append(x)
                end = x[1]
        a.rewrite(kept)
    if _PLAIN_HINT.search(a.text):
        a.rewrite(_addresses(a.text))
    if _IP_HINT.search(a.text):
        a.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in _IP_DOTS.finditer(a.text)
                   for d in _IP_DOT.finditer(m.group()) if d.group() != "."])


def deobfuscate(text: str) -> Aligned | None:
    """The rewritten text with its source offsets; None where nothing changes."""
    odd = _ODD_CHAR.search(text)
    spelled = None if odd else _spelled(text)
    if not (odd or spelled or _CODE_HINT.search(text) or _PLAIN_HINT.search(text) or _IP_HINT.search(text)):
        return None
    a = Aligned(text)
    if odd:
        _characters(a)
    a.rewrite(_spelled(a.text) if odd else spelled)
    _at_dot(a)
    return a if a.text != text else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) in code points of ``text``."""
    base = detect(text)
    a = deobfuscate(text)
    if a is None:
        return base, base
    spans = list(base)
    # base spans of a kind are disjoint and in order, and so are the added ones
    taken = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]
    end = [0] * len(KINDS)
    for s, k, e in detect(a.text):
        lo, hi = int(a.lo[s]), int(a.hi[e - 1])
        while hi > lo and text[lo].isspace():  # an edit may have swallowed blanks
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        at = bisect.bisect_left(taken[k], (hi, 0)) - 1
        if lo >= end[k] and (at < 0 or taken[k][at][1] <= lo):
            spans.append((lo, k, hi))
            end[k] = hi
    spans.sort()
    return base, spans


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (overlaps united, first kind named) replaced by ``<KIND>``."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added):
    counts and digest of the base spans, all spans, and how many were added."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    long, text = T.LongType(), T.StringType()
    kinds = [src.schema["id"].dataType, long, long, long, long, text, text, long]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, added = [], [], []
            for t in b.column(1):
                base, every = find(t.as_py() or "")
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(render(base).encode()).hexdigest())
                spans.append(render(every))
                added.append(len(every) - len(base))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=names)

    return src.mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, kinds)]))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` masked; null texts stay null,
    other columns and the row count are untouched."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(at):
                x = t.as_py()
                spans = find(x)[1] if x else []
                out.append(mask(x, spans) if spans else x)
            cols = list(b.columns)
            cols[at] = pa.array(out, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(run, schema)


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
