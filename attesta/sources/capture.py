"""Capture documents: addresses at any depth, and typed rows of the known buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.vocabulary import CAPTURE_SIGNALS, URL_KEYS


#: Stand-ins for escaped quotes and backslashes while a text is searched; JSON texts hold no raw control characters.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def harvest_urls(content: Column) -> Column:
    """Every string under a URL key of a JSON text, at any depth, in document order: array<string>.

    Escaped backslashes and quotes are swapped for control characters, which well-formed JSON never
    holds; then every quotation mark delimits a string, and a member name is a quoted word behind
    '{' or ',' and before ':'. One pattern of plain character classes walks the text as it stands: no
    recursion on long values. NULL for malformed input. Keys written with escapes are not recognised.
    """
    marked = F.replace(F.replace(content, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    pattern = r'(?<=[{,\s])"(?:' + "|".join(URL_KEYS) + r')"\s*+:\s*+"([^"]*+)"'
    raw = F.regexp_extract_all(marked, F.lit(pattern), F.lit(1))
    plain = lambda text: F.replace(F.replace(text, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
    found = F.transform(
        raw,
        lambda text: F.when(~text.rlike(r"[\x01\x02\\]"), text).otherwise(
            F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), plain(text), F.lit('"'))), "$", "string")
        ),
    )
    return F.when(F.try_parse_json(content).isNotNull(), found)


def capture_urls(captures: DataFrame, http_only: bool = False) -> DataFrame:
    """captures(day, content) -> (day, position, url) in document order."""
    found = captures.select("day", F.posexplode(harvest_urls(F.col("content"))).alias("position", "url"))
    return found.filter(F.col("url").rlike("^https?://")) if http_only else found


def _bucket(captures: DataFrame, bucket: str) -> DataFrame:
    """Object entries of one bucket with their place among the objects."""
    entries = F.filter(
        F.coalesce(F.try_variant_get("doc", f"$.{bucket}", "array<variant>"), F.array().cast("array<variant>")),
        lambda e: F.schema_of_variant(e).startswith("OBJECT"),
    )
    return captures.select("day", F.posexplode(entries).alias("position", "e"))


def _number(name: str) -> Column:
    node = F.try_variant_get("e", f"$.{name}", "variant")
    kind = F.schema_of_variant(node)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get("e", f"$.{name}", "double"))


def _text(name: str) -> Column:
    return F.try_variant_get("e", f"$.{name}", "string")


def signal_rows(captures: DataFrame) -> DataFrame:
    """Typed rows of the ranked buckets, ready for coverage.ranked_pool()."""
    parsed = captures.select("day", F.try_parse_json("content").alias("doc"))
    out = None
    shape = {**CAPTURE_SIGNALS, "tweets_recent": ("text", "url", "likes", "X"), "tweets_evergreen": ("text", "url", "likes", "X")}
    for bucket, (title, url, signal, label) in shape.items():
        numeric = signal in ("points", "stars_per_day", "likes")
        rows = _bucket(parsed, bucket).select(
            "day", F.lit(bucket).alias("bucket"), F.lit(label).alias("source"), "position",
            F.coalesce(_text(title), _text(url)).alias("title"), F.coalesce(_text(url), F.lit("")).alias("url"),
            _text("text").alias("text"), _text("date").alias("date"),
            (_number(signal) if numeric else F.lit(None).cast("double")).alias("signal_number"),
            (F.lit(None).cast("string") if numeric else _text(signal)).alias("signal_text"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def feed_rows(captures: DataFrame, k: int = 10) -> DataFrame:
    """The first k object entries of every named feed: (day, feed, position, title, url, dated, summary)."""
    parsed = captures.select("day", F.try_parse_json("content").alias("doc"))
    feeds = F.map_entries(F.try_variant_get("doc", "$.feeds", "map<string,variant>"))
    spread = parsed.select("day", F.explode(feeds).alias("f")).select(
        "day", F.col("f.key").alias("feed"),
        F.posexplode(F.slice(F.try_variant_get("f.value", "$", "array<variant>"), 1, k)).alias("position", "e"),
    )
    return spread.filter(F.schema_of_variant("e").startswith("OBJECT")).select(
        "day", "feed", "position", _text("title").alias("title"), _text("url").alias("url"),
        F.coalesce(_text("date"), _text("published")).alias("dated"), _text("summary").alias("summary"),
    )


def bucket_counts(captures: DataFrame) -> DataFrame:
    """Entries per list bucket of each capture."""
    parsed = captures.select("day", F.try_parse_json("content").alias("doc"))
    members = F.map_entries(F.try_variant_get("doc", "$", "map<string,variant>"))
    return parsed.select("day", F.explode(members).alias("m")).select(
        "day", F.col("m.key").alias("bucket"),
        F.size(F.try_variant_get("m.value", "$", "array<variant>")).alias("entries"),
    ).filter("entries is not null and entries >= 0")


# How many rows of each bucket the evidence text keeps, and how it orders them.
EVIDENCE_LIMITS = {
    "hn": 25, "github": 30, "arxiv": 20, "techmeme": 12, "tweets_recent": 20, "tweets_evergreen": 15,
}
EVIDENCE_UNRANKED = ("techmeme", "tweets_recent")


def prefilter(rows: DataFrame) -> DataFrame:
    """The evidence rows of a day: each bucket's own limit, by its signal or in capture order.

    A bucket without a limit keeps all its rows.
    """
    from attesta.operators.ranking import top_k

    limited = F.col("bucket").isin(*EVIDENCE_LIMITS)
    limit = F.lit(0)
    for bucket, count in EVIDENCE_LIMITS.items():
        limit = F.when(F.col("bucket") == bucket, F.lit(count)).otherwise(limit)
    unranked = F.col("bucket").isin(*EVIDENCE_UNRANKED)
    order = [
        F.desc(F.when(unranked, F.lit(0.0)).otherwise(F.coalesce("signal_number", F.lit(0.0)))),
        F.desc(F.when(unranked, F.lit("")).otherwise(F.coalesce("signal_text", F.lit("")))),
        F.asc("position"),
    ]
    most = max(EVIDENCE_LIMITS.values())
    cut = top_k(rows.filter(limited), most, ["day", "bucket"], order, "n").filter(F.col("n") <= limit).drop("n")
    return cut.unionByName(rows.filter(~F.coalesce(limited, F.lit(False))))
