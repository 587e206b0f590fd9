"""Title and body text: normal forms, token sets, similarity, headings, blank runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.urls import strip
from attesta.functions.vocabulary import (
    CJK,
    TITLE_LEAD_INS,
    TITLE_PUNCTUATION,
)

_LEAD_IN_FRONT = "^(?:" + "|".join(TITLE_LEAD_INS) + ")"


def normalise_title(title: Column) -> Column:
    """Lower case, no punctuation or spaces, each known lead-in removed once from the front."""
    bare = F.regexp_replace(F.lower(strip(title)), "(?U)" + TITLE_PUNCTUATION, "")
    peeled = reduce(lambda text, word: F.regexp_replace(text, "^" + word, ""), TITLE_LEAD_INS, bare)
    return F.when(bare.rlike(_LEAD_IN_FRONT), peeled).otherwise(bare)


def tokens(text: Column) -> Column:
    """Distinct latin words of two letters or more, CJK bigrams, and lone CJK characters."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit("[a-z0-9]{2,}"), F.lit(0))
    has_cjk = lowered.rlike(f"[{CJK}]")
    bigrams = F.regexp_extract_all(lowered, F.lit(f"(?=([{CJK}]{{2}}))"), F.lit(1))
    lone = F.regexp_extract_all(lowered, F.lit(f"(?<![{CJK}])[{CJK}](?![{CJK}])"), F.lit(0))
    return F.array_distinct(F.when(has_cjk, F.concat(words, bigrams, lone)).otherwise(words))


def jaccard(left: Column, right: Column) -> Column:
    """|A∩B| / |A∪B| of two token sets; 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(left) + F.size(right) - shared)
    )


def title_band(overlap: Column) -> Column:
    """Score of a pair of different titles from their token overlap (fixed bands)."""
    return (
        F.when(overlap >= 0.8, F.lit(0.85))
        .when(overlap >= 0.65, F.lit(0.72))
        .when(overlap >= 0.5, F.lit(0.62))
        .when(overlap >= 0.35, F.lit(0.5))
        .otherwise(F.lit(0.2) * overlap)
    )


def slugify(text: Column, max_len: int = 60) -> Column:
    dashed = F.regexp_replace(strip(text), rf"(?U)[^\w{CJK}-]+", "-")
    dashed = F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", "")
    return F.substring(F.when(dashed == "", F.lit("entry")).otherwise(dashed), 1, max_len)


def lines(text: Column) -> Column:
    """Lines without a phantom last line when the text ends in a line break."""
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def first_heading(body: Column) -> Column:
    return strip(F.regexp_extract(body, r"(?m)^#+(.*)$", 1))


def excerpt(body: Column, length: int = 200) -> Column:
    collapsed = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)\s+", " "))
    return F.substring(collapsed, 1, length)


def max_blank_run(text: Column) -> Column:
    """Longest run of consecutive whitespace-only lines.

    Lines are folded one by one with the run so far and the longest yet: linear, whatever the run.
    """
    unix = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    blank = F.transform(F.split(F.regexp_replace(unix, r"\n\z", ""), "\n"), lambda line: ~line.rlike(r"(?U)\S"))
    longest = F.aggregate(
        blank,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda s, empty: F.struct(
            F.when(empty, s["run"] + 1).otherwise(F.lit(0)).alias("run"),
            F.greatest(s["most"], F.when(empty, s["run"] + 1).otherwise(F.lit(0))).alias("most"),
        ),
        lambda s: s["most"],
    )
    return F.when(unix == "", F.lit(0)).otherwise(longest)


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def holds_any(lower: Column, words: Sequence[str]) -> Column:
    """Does a lowered() text contain one of the words? As a column of its own it is lowered once for all words."""
    return reduce(lambda a, b: a | b, (lower.contains(word.lower()) for word in words), F.lit(False))


def held(lower: Column, words: Sequence[str]) -> Column:
    """The given words that a lowered() text contains, in their order."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(lower.contains(word.lower()), F.lit(word)) for word in words]))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return holds_any(lowered(text), words)


def contained(text: Column, words: Sequence[str]) -> Column:
    """The given words that a text contains, in their order."""
    return held(lowered(text), words)
