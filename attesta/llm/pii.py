"""Personal data in texts: exact patterns, and disguised ones by offset-preserving normalisation."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the start of a run of digits and takes whole runs, so possessive runs find
# the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and dotted domain. Each @ looks back over its own run only."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()


def detect(text: str) -> list[Span]:
    """All spans of the four kinds, by kind as listed, then start; ends are exclusive."""
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


# -- transducers: each gives the new text and, for each new character, its source start and end ----

#: Letters of other scripts that look like ASCII ones (fixed values).
HOMOGLYPHS = str.maketrans(
    "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν",
    "ABESIJKMHOPCTXYaesijopcyxdqwABEZHIKMNOPTYXoav",
)
HOMOGLYPHS |= {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3002: 0x2E, 0x2024: 0x2E, 0x2010: 0x2D, 0x2011: 0x2D, 0x00A0: 0x20}
INVISIBLE = "​‌‍⁠﻿­"
_LOOKALIKE = re.compile("[" + re.escape("".join(map(chr, HOMOGLYPHS)) + INVISIBLE) + "]")

#: Spelled digits in four languages (fixed values).
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DIGIT_WORD = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_JOIN = r"[\x20.()-]{1,2}"
_PART = rf"(?:{_DIGIT_WORD}|[0-9]+)"
#: Four or more numbers in a row, with an optional plus; those with a spelled one among them are rewritten.
_SPELLED = re.compile(rf"(?<!\w)(?:plus\x20|\+\x20?)?{_PART}(?:{_JOIN}{_PART}){{3,}}(?!\w)", re.I)
_TOKEN = re.compile(rf"plus\x20(?=\w)|{_DIGIT_WORD}(?!\w)", re.I)

_OPEN, _CLOSE = r"\s?[\(\[\{<]\s?", r"\s?[\)\]\}>]\s?"
_AT = re.compile(rf"{_OPEN}(?:at|arroba|ät|chez|@){_CLOSE}", re.I)
_DOT = re.compile(rf"{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}", re.I)
#: The plain form: words or brackets on any side, or a real @ or . where another sign is disguised.
_ANY_DOT = rf"(?:\.|\x20(?:dot|punkt|point|punto)\x20|{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE})"
_ANY_AT = re.compile(rf"@|\x20(?:at|arroba|ät|chez)\x20|{_OPEN}(?:at|arroba|ät|chez|@){_CLOSE}", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]++(?:{_ANY_DOT}[A-Za-z0-9-]++)+", re.I)
_EACH_DOT = re.compile(_ANY_DOT, re.I)
_DOT_BEHIND = re.compile(rf"{_ANY_DOT}\Z", re.I)
_DOT_REACH = 12  # the longest form of a dot is "point" between brackets and blanks
_LOCAL_WORD = _LOCAL - {"."}
#: Words of prose, which are no labels of a domain beside the plain words at and chez (fixed values).
_PROSE = frozenset(
    "a an the this that these those one some any each every which what my your his her its our their no and or of on to for with from as if by so "
    "polka le la les un une ce cet cette lui moi toi nous vous eux elle mon ma son sa du des et est el los las una este ese y que der die das dem den".split()
)
#: Labels at the top that are hardly words of prose (an excerpt), asked for where the signs alone say little.
_TOP = frozenset(
    "com org net edu gov mil int info biz io ai app dev eu us uk de fr es it nl ch at pl ru cz sk hu ro bg gr dk fi no pt ie lu lt lv ee si hr rs ua "
    "tr il ae jp cn kr tw hk sg au nz ca mx br ar cl pe za eg ke ng pk th vn online site shop cloud museum".split()
)
_TOP_WORDS = frozenset("it us no at de es in is to be me so int app site shop".split())


class Mapped:
    """A text with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ascending spans; all characters of a replacement stand for its whole span."""
        if not edits:
            return
        texts, starts, ends, last = [], [], [], 0
        for low, high, new in edits:
            texts += [self.text[last:low], new]
            starts += [self.starts[last:low], np.full(len(new), self.starts[low])]
            ends += [self.ends[last:low], np.full(len(new), self.ends[high - 1])]
            last = high
        texts.append(self.text[last:])
        self.text = "".join(texts)
        self.starts = np.concatenate([*starts, self.starts[last:]])
        self.ends = np.concatenate([*ends, self.ends[last:]])


_BETWEEN = str.maketrans(dict.fromkeys(".()-+,;:!?\"'", " "))
_MIXED = re.compile(rb"[\1\2]{3,}")


def _has_run(text: str) -> bool:
    """Whether numbers follow each other, spelled or not, with a spelled one among them."""
    flat = text.lower().translate(_BETWEEN).split()
    flags = bytes(1 if t in DIGITS else 2 if t.isdigit() else 0 for t in flat)
    return any(b"\1" in run for run in _MIXED.findall(flags)) if b"\1" in flags else False


def _lookalikes(m: Mapped) -> None:
    if m.text.isascii():
        return
    found = _LOOKALIKE.finditer(m.text)
    m.rewrite([(x.start(), x.end(), "" if x[0] in INVISIBLE else x[0].translate(HOMOGLYPHS)) for x in found])


def _spelled(m: Mapped) -> None:
    edits = []
    for run in _SPELLED.finditer(m.text) if _has_run(m.text) else ():
        if _has_run(run[0]):
            tokens = _TOKEN.finditer(m.text, run.start(), run.end())
            edits += [(t.start(), t.end(), "+" if t[0][0] in "pP" else str(DIGITS[t[0].lower()])) for t in tokens]
    m.rewrite(edits)


def _local_start(text: str, at: int, least: int) -> int:
    """Where the local part before `at` begins: words joined by dots in any form. `at` itself if there is none."""
    start = low = at
    while True:
        while low > least and text[low - 1] in _LOCAL_WORD:
            low -= 1
        if low == start:
            return start if start == at else min(at, start + len(_dot_after(text, start)))
        start = low
        found = _DOT_BEHIND.search(text, max(least, low - _DOT_REACH), low)
        if not found:
            return start
        low = start = found.start()


def _dot_after(text: str, at: int) -> str:
    found = _EACH_DOT.match(text, at)
    return found[0] if found else ""


def _address(local: str, at: str, domain: str) -> bool:
    """Whether a disguised address is meant; the plain words at and chez need more than those that are rare in prose."""
    dots = [d.lower().strip() for d in _EACH_DOT.findall(domain)]
    labels = [x.lower() for x in _EACH_DOT.split(domain)]
    hidden = [d for d in dots if d != "."]
    top = labels[-1]
    local_hidden = any(d != "." for d in _EACH_DOT.findall(local))
    if not (top.isalpha() and len(top) > 1):
        return False
    if at == "@":
        if dots[0] == "." and hidden:
            return top in _TOP
        return bool(hidden or local_hidden) and top not in _PROSE
    if at.lower().strip() not in ("at", "chez"):
        return True
    if not hidden:
        return top in _TOP and (local_hidden or any(c in "._%+0123456789" for c in local))
    if _PROSE.intersection(labels):
        return False
    return top in _TOP and top not in _TOP_WORDS if all(d in ("point", "punto") for d in hidden) else True


def _plain(text: str) -> list[tuple[int, int, str]]:
    """Edits for addresses with a disguised sign. Each at looks back over its own local part only."""
    edits, end = [], 0
    for at in _ANY_AT.finditer(text):
        found = _LABELS.match(text, at.end()) if at.start() >= end else None
        start = _local_start(text, at.start(), end) if found else at.start()
        if start < at.start() and _address(text[start : at.start()], at[0], found[0]):
            dots = [d.span() for low, high in ((start, at.start()), found.span()) for d in _EACH_DOT.finditer(text, low, high)]
            edits += [(low, high, ".") for low, high in dots if text[low:high] != "."]
            edits += [(*at.span(), "@")] if at[0] != "@" else []
            end = found.end()
    return edits


def _separators(m: Mapped) -> None:
    edits = []
    if any(sign in m.text for sign in "([{<"):
        edits += [(x.start(), x.end(), "@") for x in _AT.finditer(m.text)] + [(x.start(), x.end(), ".") for x in _DOT.finditer(m.text)]
    edits += _plain(m.text)
    done, end = [], 0
    for e in sorted(set(edits)):
        if e[0] >= end:
            done.append(e)
            end = e[1]
    m.rewrite(done)


def normalise(text: str) -> Mapped:
    """Look-alike letters to ASCII, spelled digits to digits, at and dot disguises to signs."""
    m = Mapped(text)
    for step in (_lookalikes, _spelled, _separators):
        step(m)
    return m


def _added(base: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The new spans that overlap no span of the base or before them, or hold those they meet as a part.

    Base spans are ascending and apart, so only the first and the last that a new span meets can cross its ends.
    """
    starts, ends = [s for s, _ in base], [e for _, e in base]
    out: list[tuple[int, int]] = []
    for low, high in sorted(set(new)):
        first, last = bisect_right(ends, low), bisect_left(starts, high) - 1
        apart = first > last or (low <= starts[first] and ends[last] <= high and (low, high) != base[first])
        before = len(out) - 1
        while apart and before >= 0 and out[before][1] > low:
            apart = low <= out[before][0] and out[before][1] <= high
            before -= 1
        if apart:
            out.append((low, high))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans) of a text, in source characters.

    The plain spans are those of the exact patterns. Disguised ones are detected in the normalised text,
    mapped back and added where they overlap no other span of their kind, or hold it as a part.
    """
    if not text:
        return [], []
    base = detect(text)
    changed = normalise(text)
    if changed.text == text:
        return base, base
    spans = list(base)
    found = detect(changed.text)
    for kind in KINDS:
        new = [(int(changed.starts[s]), int(changed.ends[e - 1])) for k, s, e in found if k == kind]
        spans += [(kind, low, high) for low, high in _added([(s, e) for k, s, e in base if k == kind], new)]
    return base, sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


_SPANS = ArrayType(StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()))


@pandas_udf(StructType().add("base", _SPANS).add("spans", _SPANS))
def _find(text: pd.Series) -> pd.DataFrame:
    rows = []
    for base, spans in map(find, text):
        rows.append([[{"kind": k, "start": s, "end": e} for k, s, e in part] for part in (base, spans)])
    return pd.DataFrame(rows, columns=["base", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: spans (kind, start, end) in code points, ends exclusive.

    Null and empty texts have none. Repeated rows each come back; other columns are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), _find(docs[text]).alias("found")).select("doc_id", "found.*")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; spans that overlap become one."""
    out, last = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= last:
            out += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])
