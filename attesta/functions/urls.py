"""URL canonicalisation, drift and attack builders, all as regex Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.vocabulary import DRIFT_PARAMETER, TRACKING_PARAMS, WHITESPACE

_TRACKED = "(?i)&(?:" + "|".join(TRACKING_PARAMS) + ")[^&]*"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only U+0020. Only the ends are looked at: a pattern would try every character."""
    return F.trim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def _drop_prefix(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, "^" + pattern, "")


def path_only(url: Column) -> Column:
    """Everything before the first question mark."""
    return F.substring_index(url, "?", 1)


def legacy_normalise(url: Column) -> Column:
    """The older, looser normal form: schemes and www removed one after another, then lower case."""
    text = F.regexp_replace(strip(url), "/+$", "")
    for prefix in ("https://", "http://", r"www\."):
        text = _drop_prefix(text, prefix)
    return F.lower(text)


def canonical_url(url: Column) -> Column:
    """Remove only the enumerated drifts: fragment, tracking parameters, scheme, www, end slash.

    The query is handled as one string ('&a&b'), so the whole expression stays inside
    whole-stage codegen instead of exploding parameters into arrays.
    """
    text = F.substring_index(strip(url), "#", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_replace(text, r"^[^?]*\??", "")), _TRACKED, "")
    query = F.regexp_replace(F.regexp_replace(query, "&{2,}", "&"), "^&|&$", "")
    text = F.regexp_replace(F.concat(path_only(text), F.lit("?"), query), r"^([^?]*)\?$", "$1")
    text = _drop_prefix(_drop_prefix(text, "(?:https://|http://)"), r"www\.")
    return F.lower(F.regexp_replace(text, "/+$", ""))


def strip_arxiv_version(canonical: Column) -> Column:
    """Two versions of one paper are the same source."""
    return F.regexp_replace(canonical, r"^(.*?arxiv\.org/abs/[^v]*)v\d+$", "$1")


# -- drift builders: textually different, canonically equal ------------------------------------


def drift_scheme(url: Column) -> Column:
    return (
        F.when(url.startswith("https://"), F.regexp_replace(url, "^https://", "http://"))
        .when(url.startswith("http://"), F.regexp_replace(url, "^http://", "https://"))
        .otherwise(url)
    )


def drift_trailing_slash(url: Column) -> Column:
    """NULL when a query is present: a slash before '?' would change the address."""
    return F.when(
        F.instr(url, "?") == 0, F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/"))
    )


def drift_tracking(url: Column) -> Column:
    glue = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, glue, F.lit(DRIFT_PARAMETER))


def drift_www(url: Column) -> Column:
    return F.when(
        url.rlike(r"^https?://www\."), F.regexp_replace(url, r"^(https?://)www\.", "$1")
    ).otherwise(F.regexp_replace(url, "^(https?://)", "$1www."))


DRIFTS = (
    ("scheme", drift_scheme),
    ("trailing_slash", drift_trailing_slash),
    ("tracking_params", drift_tracking),
    ("www", drift_www),
)


def rotated_drift(url: Column, index: Column) -> Column:
    """struct<label, url>: start at builder index % 4, fall through where one does not apply."""
    usable = F.array(
        *[
            F.when(built != url, F.struct(F.lit(label).alias("label"), built.alias("url")))
            for label, built in ((label, builder(url)) for label, builder in DRIFTS)
        ]
    )
    start = F.pmod(index, F.lit(len(DRIFTS))).cast("int")
    turned = F.concat(F.slice(usable, start + 1, F.lit(len(DRIFTS))), F.slice(usable, F.lit(1), start))
    return F.try_element_at(F.array_compact(turned), F.lit(1))


# -- attack builders: a genuine prefix with an invented remainder ------------------------------


def attack_extension(canonical: Column) -> Column:
    return F.concat(F.lit("https://"), canonical, F.lit("/this-page-never-existed"))


def attack_suffix(canonical: Column) -> Column:
    return F.concat(F.lit("https://"), canonical, F.lit("-v99-fake"))


def attack_unrelated(day: Column, index: Column) -> Column:
    return F.concat(
        F.lit("https://example.invalid/"), day.cast("string"), F.lit("/invented-"), index.cast("string")
    )
