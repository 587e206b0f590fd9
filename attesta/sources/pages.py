"""Generated pages: sitemaps, index pages and links in HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import max_blank_run
from attesta.functions.urls import strip

INDEX_DATE = r"/trends/(\d{4}-\d{2}-\d{2})/"  # fixed link pattern of the index page
MAX_SITEMAP_BYTES = 200_000
MAX_BLANK_RUN = 8


def hrefs(html: Column) -> Column:
    """Distinct link targets in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))


def index_dates(html: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(INDEX_DATE), F.lit(1))))


def index_gate(pages: DataFrame, earliest: str) -> DataFrame:
    """pages(page_id, html, expected): expected date listed, none invalid or before `earliest`."""
    dates = pages.select("page_id", "expected", F.col("html").isNull().alias("missing"), index_dates(F.col("html")).alias("dates"))
    early = F.size(F.filter("dates", lambda d: d < earliest))
    invalid = F.size(F.filter("dates", lambda d: F.try_to_date(d).isNull()))
    absent = ~F.array_contains("dates", F.col("expected"))
    problems = F.coalesce(early + invalid, F.lit(0)) + F.coalesce(absent.cast("int"), F.lit(0))
    return dates.select(
        "page_id",
        F.coalesce(F.when(~F.col("missing"), F.size("dates")), F.lit(0)).alias("dates"),
        F.element_at(F.when(F.size("dates") > 0, F.col("dates")), -1).alias("latest"),
        problems.alias("problems"),
        F.when(F.col("missing"), F.lit("cannot_verify")).when(problems > 0, F.lit("fail")).otherwise(F.lit("pass")).alias("decision"),
    )


def _wrapped(xml: Column) -> Column:
    """The text without prolog and comments, as the content of one outer element."""
    bare = F.regexp_replace(xml, r"(?s)\A\uFEFF?\s*<\?xml.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*+(?:\[[^\]]*+\])?\s*+>", "")
    return F.concat(F.lit("<sheet>"), bare, F.lit("</sheet>"))


def _parses(wrapped: Column) -> Column:
    """Whether a per-row parser reads the text; mis-nesting is a NULL there and no error of the job."""
    parsed = F.from_xml(wrapped, F.lit("_corrupt_record string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    plain = F.regexp_replace(wrapped, r"(?s)<!\[CDATA\[.*?\]\]>", "")
    tags = F.array_join(F.regexp_extract_all(plain, F.lit("<[^<>]*+>"), F.lit(0)), " ")
    used = F.concat(
        F.regexp_extract_all(tags, F.lit(r"</?([A-Za-z_][\w.-]*+):"), F.lit(1)),
        F.regexp_extract_all(tags, F.lit(r"\s([A-Za-z_][\w.-]*+):[\w.-]++\s*+="), F.lit(1)),
    )
    declared = F.concat(F.regexp_extract_all(tags, F.lit(r"\sxmlns:([\w.-]++)\s*+="), F.lit(1)), F.array(F.lit("xml"), F.lit("xmlns")))
    return F.coalesce(parsed.isNotNull() & parsed["_corrupt_record"].isNull() & (F.size(F.array_except(used, declared)) == 0), F.lit(False))


def sitemap_locs(xml: Column) -> Column:
    """Texts of all <loc> elements in any namespace; NULL for a text that is not one well-formed document."""
    wrapped = _wrapped(xml)
    sound = F.when(_parses(wrapped), wrapped)
    single = (F.xpath_int(sound, F.lit("count(/sheet/*)")) == 1) & ~F.array_join(F.xpath(sound, F.lit("/sheet/text()")), "").rlike(r"\S")
    locs = F.xpath(sound, F.lit('//*[local-name()="loc"]/text()'))
    return F.when(single, F.transform(locs, lambda loc: strip(loc)))


def sitemap_gate(sitemaps: DataFrame, max_bytes: int = MAX_SITEMAP_BYTES, max_blank: int = MAX_BLANK_RUN) -> DataFrame:
    """sitemaps(path, folder_exists, content): duplicates, blank runs, size and form.

    A missing folder means the check does not apply (abstain); a missing file is a failure.
    """
    shaped = sitemaps.withColumn("found", sitemap_locs(F.col("content")))
    named = shaped.withColumn("well_formed", F.col("found").isNotNull()).withColumn("locs", F.coalesce("found", F.array().cast("array<string>")))
    filled = F.filter("locs", lambda loc: loc != "")
    measured = named.select(
        "path", "folder_exists", "well_formed", F.col("content").isNull().alias("missing"),
        F.size("locs").alias("urls"),
        (F.size(filled) - F.size(F.array_distinct(filled))).alias("duplicates"),
        max_blank_run(F.col("content")).alias("blank_run"),
        F.octet_length(F.coalesce("content", F.lit(""))).alias("bytes"),
    )
    bad = (F.col("duplicates") > 0) | (F.col("blank_run") > max_blank) | (F.col("bytes") > max_bytes)
    return measured.withColumn(
        "decision",
        F.when(F.col("missing") & ~F.col("folder_exists"), F.lit("abstain"))
        .when(F.col("missing") | ~F.col("well_formed") | bad, F.lit("fail"))
        .otherwise(F.lit("pass")),
    )
