"""Queries: URL forms and provenance of citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import urls
from attesta.operators import provenance
from attesta.plans import inputs, sql
from attesta.plans.registry import query
from attesta.session import table


@query("url_canonical", f"SELECT page_id, {sql.canonical('url')} AS canonical FROM pages")
def url_canonical(spark, root):
    return table(spark, root, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("url_legacy_normalise", f"SELECT page_id, {sql.legacy('url')} AS normalised FROM pages")
def url_legacy_normalise(spark, root):
    return table(spark, root, "pages").select("page_id", urls.legacy_normalise(F.col("url")).alias("normalised"))


@query("url_path_only", f"SELECT page_id, split_part({sql.canonical('url')}, '?', 1) AS path FROM pages")
def url_path_only(spark, root):
    return table(spark, root, "pages").select(
        "page_id", urls.path_only(urls.canonical_url(F.col("url"))).alias("path")
    )


@query(
    "url_arxiv_version",
    """SELECT page_id, 'arxiv.org/abs/' || length(html)::VARCHAR || '.' || page_id::VARCHAR AS paper FROM pages""",
)
def url_arxiv_version(spark, root):
    """Each page as the page_id-th version of a paper: the version must come off."""
    paper = F.concat(F.lit("https://arxiv.org/abs/"), F.length("html").cast("string"), F.lit("."), F.col("page_id").cast("string"))
    versioned = F.concat(paper, F.lit("v"), (F.col("page_id") + 1).cast("string"), F.lit("#sec"))
    return table(spark, root, "pages").select(
        "page_id", urls.strip_arxiv_version(urls.canonical_url(versioned)).alias("paper")
    )


@query(
    "url_drift_variants",
    "WITH d AS ("
    + " UNION ALL ".join(f"SELECT page_id, url, '{label}' AS drift, {built} AS drifted FROM pages" for label, built in sql.drifts("url"))
    + f") SELECT page_id, drift, drifted, {sql.canonical('drifted')} = {sql.canonical('url')} AS same FROM d",
)
def url_drift_variants(spark, root):
    """Every builder on every page; `same` holds when the canonical form is unchanged."""
    built = F.explode(
        F.array(*[F.struct(F.lit(n).alias("drift"), b(F.col("url")).alias("drifted")) for n, b in urls.DRIFTS])
    ).alias("d")
    spread = table(spark, root, "pages").select("page_id", "url", built).select("page_id", "url", "d.*")
    same = F.when(
        F.col("drifted").isNotNull(), urls.canonical_url(F.col("drifted")) == urls.canonical_url(F.col("url"))
    )
    return spread.select("page_id", "drift", "drifted", same.alias("same"))


@query(
    "url_attack_variants",
    f"""WITH {sql.CAPTURED} SELECT page_id, 'https://' || canonical || '/this-page-never-existed' AS extension,
    'https://' || canonical || '-v99-fake' AS suffix,
    'https://example.invalid/' || day::VARCHAR || '/invented-' || page_id::VARCHAR AS unrelated FROM captured""",
)
def url_attack_variants(spark, root):
    pages = inputs.captured(spark, root).withColumn("canonical", urls.canonical_url(F.col("url")))
    return pages.select(
        "page_id",
        urls.attack_extension(F.col("canonical")).alias("extension"),
        urls.attack_suffix(F.col("canonical")).alias("suffix"),
        urls.attack_unrelated(F.col("day"), F.col("page_id")).alias("unrelated"),
    )


@query(
    "provenance_exact",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}
SELECT form, count(*)::BIGINT AS exact FROM citations c WHERE EXISTS (
  SELECT 1 FROM known k WHERE k.day = c.day AND k.canonical = {sql.canonical('c.url')}) GROUP BY form""",
)
def provenance_exact(spark, root):
    """Citations whose canonical URL was captured that day, by form (semi join)."""
    cited = inputs.citations(spark, root).withColumn("canonical", urls.canonical_url(F.col("url")))
    hits = cited.join(inputs.known(spark, root), ["day", "canonical"], "left_semi")
    return hits.groupBy("form").agg(F.count(F.lit(1)).alias("exact"))


def typed(spark, root):
    return provenance.classify_citations(inputs.citations(spark, root), inputs.known(spark, root))


@query(
    "provenance_typed",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}, {sql.typed('citations', 'cite_id, form')}
SELECT cite_id, form, day, target, decision, failure_class, drift, matched FROM typed""",
)
def provenance_typed(spark, root):
    return typed(spark, root).select(
        "cite_id", "form", "day", "target", "decision", "failure_class", "drift", "matched"
    )


@query(
    "provenance_verdict_counts",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}, {sql.typed('citations', 'cite_id, form')}
SELECT form, decision, count(*)::BIGINT AS citations FROM typed GROUP BY form, decision""",
)
def provenance_verdict_counts(spark, root):
    """The flagship: does every cited address trace back to what was captured?"""
    return typed(spark, root).groupBy("form", "decision").agg(F.count(F.lit(1)).alias("citations"))


@query(
    "provenance_legacy",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}, {sql.legacy_verdicts('citations', 'cite_id, form')}
SELECT cite_id, form, decision FROM old""",
)
def provenance_legacy(spark, root):
    judged = provenance.legacy_citations(inputs.citations(spark, root), inputs.known(spark, root))
    return judged.select("cite_id", "form", "decision")


@query(
    "provenance_ratio_by_day",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}, {sql.typed('citations', 'cite_id, form')}
SELECT day, count(*)::BIGINT AS cited, count(*) FILTER (decision = 'pass')::BIGINT AS traced,
  count(*) FILTER (decision = 'cannot_verify')::BIGINT AS cannot_verify, count(*) FILTER (decision = 'fail')::BIGINT AS failed,
  round_even(count(*) FILTER (decision = 'pass') / count(*)::DOUBLE, 4) AS verifiable_ratio,
  CASE WHEN count(*) FILTER (decision = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (decision = 'cannot_verify') > 0
    THEN 'cannot_verify' ELSE 'pass' END AS decision,
  CASE WHEN count(*) FILTER (decision = 'fail') > 0 THEN 'fabricated_source' WHEN count(*) FILTER (decision = 'cannot_verify') > 0
    THEN 'unknown_variant' END AS failure_class
FROM typed GROUP BY day""",
)
def provenance_ratio_by_day(spark, root):
    return provenance.verify_days(typed(spark, root))


@query(
    "stale_attribution",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}, {sql.typed('citations', 'cite_id, form')},
failed AS (SELECT DISTINCT day, target FROM typed WHERE decision = 'fail' AND target <> ''),
other AS (
  SELECT f.day, f.target, d.day AS other_day, row_number() OVER (PARTITION BY f.day, f.target ORDER BY d.day DESC) AS n
  FROM failed f JOIN (SELECT DISTINCT day FROM captured) d ON d.day <> f.day)
SELECT o.day, o.target, string_agg(o.other_day::VARCHAR, ',' ORDER BY o.other_day) AS other_days
FROM other o JOIN known k ON k.day = o.other_day AND k.canonical = o.target WHERE o.n <= 30 GROUP BY o.day, o.target""",
)
def stale_attribution(spark, root):
    """Failed citations that another day's capture holds: stale material, not an invention."""
    failed = typed(spark, root).filter("decision = 'fail' and target <> ''")
    found = provenance.stale_days(failed, inputs.known(spark, root))
    return found.select("day", "target", F.array_join(F.col("other_days").cast("array<string>"), ",").alias("other_days"))


@query(
    "refs_dangling",
    """SELECT o_orderpriority AS priority, count(*)::BIGINT AS dangling FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY 1""",
)
def refs_dangling(spark, root):
    """Orders whose key no line item resolves (anti join)."""
    lines = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = table(spark, root, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(lines, "o_orderkey", "left_anti").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("dangling")
    )


@query(
    "refs_orphan",
    """SELECT lang, count(*)::BIGINT AS orphans FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang""",
)
def refs_orphan(spark, root):
    """Documents that no label cites."""
    docs = table(spark, root, "documents").select("doc_id", "lang")
    return docs.join(table(spark, root, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(
        F.count(F.lit(1)).alias("orphans")
    )


@query(
    "provenance_papers",
    """SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'fail' ELSE 'pass' END AS decision, CASE page_id % 3 WHEN 0 THEN 'arxiv_version' END AS drift FROM pages""",
)
def provenance_papers(spark, root):
    """Each page as a captured paper, cited as a later version, as it is, or under a number that nothing captured has."""
    pages = table(spark, root, "pages").select("page_id", F.expr("page_id div 100").alias("day"))
    number = F.lpad(F.col("page_id").cast("string"), 12, "0")
    paper = F.concat(F.lit("https://arxiv.org/abs/2601."), number)
    cited = F.when(F.col("page_id") % 3 == 0, F.concat(paper, F.lit("v3"))).when(F.col("page_id") % 3 == 1, paper).otherwise(
        F.concat(F.lit("https://arxiv.org/abs/2602."), number))
    known = provenance.known_urls(pages.withColumn("url", paper))
    return provenance.classify_citations(pages.withColumn("url", cited), known).select("page_id", "decision", "drift")
