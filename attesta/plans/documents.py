"""Queries: article contracts, JSON, generated pages, captures, memory files.

The given tables hold no article JSON, so each document is turned into one inside its row: every
non-blank line becomes an item whose shape follows from the length of the line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.operators import contract, coverage, gates, provenance, selection
from attesta.plans import inputs, sql
from attesta.plans.registry import query
from attesta.session import materialise, table
from attesta.sources import capture, memory, pages

# -- articles ------------------------------------------------------------------------------------


def _unwrapped(text: Column) -> Column:
    """A JSON text without its first and last character."""
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return _unwrapped(F.to_json(F.array(text)))


def _pair(zh: Column, en: Column | None = None) -> Column:
    """An object of two JSON texts by language."""
    if en is None:
        return F.concat(F.lit('{"zh":'), zh, F.lit("}"))
    return F.concat(F.lit('{"zh":'), zh, F.lit(',"en":'), en, F.lit("}"))


def _parts(lines: Column) -> Column:
    """Each line's length, and the line and its first 8 characters as JSON; in two steps, so each is written once."""
    wrapped = F.transform(
        lines,
        lambda x: F.struct(
            F.length(x).alias("size"), F.to_json(F.array(x)).alias("line"), F.to_json(F.array(F.substring(x, 1, 8))).alias("head")
        ),
    )
    return F.transform(
        wrapped, lambda p: F.struct(p["size"].alias("size"), _unwrapped(p["line"]).alias("line"), _unwrapped(p["head"]).alias("head"))
    )


def _item(part: Column, i: Column) -> Column:
    size, line, head = part["size"], part["line"], part["head"]
    body = (
        F.when(size < 5, F.lit('"remark":1'))
        .when(size % 4 == 0, F.concat(F.lit('"prose":'), _pair(line, line)))
        .when(size % 8 == 1, F.concat(F.lit('"fields":[{"label":{"zh":"L","en":"L"},"value":'), _pair(line), F.lit("}]")))
        .when(size % 4 == 1, F.concat(F.lit('"fields":[{"label":{"zh":"L","en":"L"},"value":'), _pair(line, line), F.lit("}]")))
        .when(size % 4 == 2, F.concat(F.lit('"summary":'), _pair(line, line), F.lit(',"comment":'), _pair(line)))
        .otherwise(F.concat(F.lit('"body":'), line))
    )
    number = i.cast("string")
    sources = F.concat(
        F.lit("["), number, F.when(size % 7 == 0, ',"x"').otherwise(""),
        F.when(size % 11 == 0, F.concat(F.lit(",1000"), number)).otherwise(""), F.lit("]"),
    )
    return F.concat(F.lit('{"title":'), _pair(head, head), F.lit(","), body, F.lit(',"sources":'), sources, F.lit("}"))


def _reference(part: Column, i: Column) -> Column:
    size, number = part["size"], i.cast("string")
    scheme = F.when(size % 13 == 0, "ftp").otherwise("https")
    title = F.when(size % 17 == 0, F.lit('"  "')).otherwise(part["head"])
    return F.concat(F.lit('{"id":'), number, F.lit(',"url":"'), scheme, F.lit("://docs.example/"), number, F.lit('","title":'), title, F.lit("}"))


def articles(spark, root):
    """(day, content): one article per document, its id as the day. Written once, like files."""
    docs = table(spark, root, "documents")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    marked = docs.select("doc_id", "lang", "source", lines.alias("l"))
    marked = marked.withColumn("parts", _parts(F.col("l")))
    marked = marked.select("*", F.transform("parts", _item).alias("items"), F.transform("parts", _reference).alias("refs"))
    orphan = F.when(
        F.size("l") % 2 == 0,
        F.array(F.concat(F.lit('{"id":'), F.size("l").cast("string"), F.lit(',"url":"https://docs.example/orphan","title":"orphan"}'))),
    ).otherwise(F.array().cast("array<string>"))

    def half(parity: int) -> Column:
        return F.array_join(F.filter("items", lambda x, i: i % 2 == parity), ",")

    head = _pair(_quoted(F.col("lang")), _quoted(F.col("source")))
    content = F.concat(
        F.lit('{"date":"2026-01-01","title":'), head, F.lit(',"summary":'), head, F.lit(',"notes":'), head,
        F.lit(',"sections":[{"id":"insights","groups":[{"id":'), _quoted(F.col("source")), F.lit(',"title":'), head,
        F.lit(',"items":['), half(0), F.lit(']}]},{"id":"github","items":['), half(1),
        F.lit(']}],"references":['), F.array_join(F.concat("refs", orphan), ","), F.lit("]}"),
    )
    return materialise(marked.select(F.col("doc_id").alias("day"), content.alias("content")), "articles")


_LINES = """lines AS (SELECT doc_id, source, lang, i - 1 AS i, line, length(line) AS n FROM (
  SELECT doc_id, source, lang, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
    SELECT doc_id, source, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))),
items AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'insights' ELSE 'github' END AS section,
  CASE WHEN i % 2 = 0 THEN 'insights/' || source ELSE 'github' END || '[' || (i // 2 + 1)::VARCHAR || ']' AS location,
  CASE WHEN n < 5 THEN 'unknown' WHEN n % 4 IN (0, 3) THEN 'prose' WHEN n % 4 = 1 THEN 'fields' ELSE 'summary_comment' END AS variant,
  CASE WHEN n < 5 THEN 1 WHEN n % 4 = 0 THEN 0 WHEN n % 8 = 1 THEN 2 WHEN n % 4 = 1 THEN 0 ELSE 1 END AS issues,
  CASE WHEN n < 5 THEN '' WHEN n % 4 = 2 THEN trim(line) || ' ' || trim(line) ELSE trim(line) END AS body
  FROM lines)"""


@query(
    "article_items",
    f"""WITH {_LINES} SELECT doc_id AS day, section, location, variant, issues::INTEGER AS issues, md5(body) AS body,
i::VARCHAR || CASE WHEN n % 11 = 0 THEN ',1000' || i::VARCHAR ELSE '' END AS sources FROM items""",
)
def article_items(spark, root):
    """Items of every article with their ordinal location, variant, issues and sources."""
    flat = contract.flatten_items(articles(spark, root))
    return flat.select(
        "day", "section", "location", "variant", F.size("issues").alias("issues"), F.md5("body_zh").alias("body"),
        F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"),
    )


_STRUCTURE = f"""{_LINES}, a AS (SELECT doc_id, count(*) AS n_items, sum(issues) AS item_issues, count(*) FILTER (variant = 'unknown') AS unknown_items,
  count(*) FILTER (section = 'insights') AS n_insights, count(*) FILTER (section = 'github') AS n_github FROM items GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(n_items, 0) AS n_items, coalesce(item_issues, 0) AS item_issues, coalesce(unknown_items, 0) AS unknown_items,
  coalesce(n_insights, 0) AS n_insights, coalesce(n_github, 0) AS n_github FROM documents d LEFT JOIN a USING (doc_id)),
structure AS (SELECT *, item_issues + (n_insights > 20)::INT + (n_github > 10)::INT AS failures,
  CASE WHEN unknown_items > 0 THEN 'cannot_verify' WHEN item_issues + (n_insights > 20)::INT + (n_github > 10)::INT > 0 THEN 'fail' ELSE 'pass' END AS decision FROM s)"""


@query(
    "article_structure_gate",
    f"""WITH {_STRUCTURE} SELECT doc_id AS day, failures::INTEGER AS failures, decision, n_items::INTEGER AS n_items, unknown_items::INTEGER AS unknown_items,
item_issues::INTEGER AS item_issues, n_insights::INTEGER AS n_insights, n_github::INTEGER AS n_github FROM structure""",
)
def article_structure_gate(spark, root):
    gate = contract.structure_gate(articles(spark, root))
    return gate.select("day", "failures", "decision", "n_items", "unknown_items", "item_issues", "n_insights", "n_github")


_REFERENCES = f"""{_LINES}, r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (n % 13 = 0) AS bad_urls, count(*) FILTER (n % 17 = 0) AS untitled,
  count(*) FILTER (n % 7 = 0) AS bad_sources, count(*) FILTER (n % 11 = 0) AS dangling FROM lines GROUP BY 1),
refs AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(bad_urls, 0) AS bad_urls, coalesce(untitled, 0) AS untitled, coalesce(bad_sources, 0) AS bad_sources, coalesce(dangling, 0) AS dangling
  FROM documents d LEFT JOIN r USING (doc_id))"""


@query(
    "article_references_gate",
    f"""WITH {_REFERENCES} SELECT doc_id AS day, (n + (n % 2 = 0)::INT)::INTEGER AS "references", (n + dangling)::INTEGER AS cited, 0 AS duplicate_ids, bad_urls::INTEGER AS bad_urls,
untitled::INTEGER AS untitled, bad_sources::INTEGER AS bad_sources, dangling::INTEGER AS dangling, (n % 2 = 0)::INTEGER AS orphans, (bad_urls + untitled + bad_sources + dangling)::INTEGER AS problems,
CASE WHEN bad_urls + untitled + bad_sources + dangling > 0 THEN 'fail' ELSE 'pass' END AS decision FROM refs""",
)
def article_references_gate(spark, root):
    return contract.references_gate(articles(spark, root))


_DEPTH = f"""{_LINES}, depth AS (SELECT doc_id, count(*) AS items, count(*) FILTER (regexp_matches(lower(body), '限制|不足|仅在|但|however|only|limit')) AS with_limit,
  count(*) FILTER (NOT regexp_matches(lower(body), '通过|采用|实现|机制|because|by |using')) AS without_substance FROM items GROUP BY 1)"""


@query(
    "article_depth_gate",
    f"""WITH {_DEPTH} SELECT d.doc_id AS day, coalesce(items, 0)::BIGINT AS items, coalesce(with_limit, 0)::BIGINT AS with_limit, coalesce(without_substance, 0)::BIGINT AS without_substance,
coalesce(round_even(with_limit / items::DOUBLE, 3), 1) AS limit_ratio, coalesce(round_even(with_limit / items::DOUBLE, 3), 1) < 0.6 AS below_target, 'pass' AS decision,
NULL::VARCHAR AS failure_class FROM documents d LEFT JOIN depth USING (doc_id)""",
)
def article_depth_gate(spark, root):
    return contract.depth_gate(articles(spark, root), profile=inputs.PROFILE)


_HITS = " + ".join(f"(contains(lower(line), '{word}'))::INT" for word in inputs.PROFILE["interest"])
_OUT = " OR ".join(f"contains(line, '{word}')" for word in inputs.PROFILE["exclude"])
_BRIEF = f"""{_LINES}, h AS (SELECT *, {_HITS} AS hits, {_OUT} AS excluded FROM items),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i % 2, i) AS place FROM h WHERE hits > 0 AND NOT excluded),
e AS (SELECT doc_id, count(*) AS candidates, count(*) FILTER (excluded) AS excluded FROM h GROUP BY 1),
b AS (SELECT doc_id, count(*) AS entries, count(*) FILTER (variant = 'unknown') AS without_body,
  count(*) FILTER (NOT regexp_matches(lower(body), '限制|不足|仅在|但|however|only|limit')) AS without_limit FROM o WHERE place <= 5 GROUP BY 1),
brief AS (SELECT d.doc_id, coalesce(entries, 0) AS entries, coalesce(candidates, 0) AS candidates, coalesce(excluded, 0) AS excluded, coalesce(without_body, 0) AS without_body,
  coalesce(without_limit, 0) AS without_limit FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN b USING (doc_id))"""


@query(
    "article_brief_gate",
    f"""WITH {_BRIEF} SELECT doc_id AS day, entries::INTEGER AS entries, candidates::INTEGER AS candidates, excluded::INTEGER AS excluded, without_body::INTEGER AS without_body,
0 AS without_reason, without_limit::INTEGER AS without_limit, CASE WHEN entries = 0 OR without_body > 0 THEN 'fail' ELSE 'pass' END AS decision, NULL::VARCHAR AS failure_class FROM brief""",
)
def article_brief_gate(spark, root):
    return contract.brief_gate(articles(spark, root), profile=inputs.PROFILE)


@query(
    "article_gate_run",
    f"""WITH {_STRUCTURE}, {_REFERENCES[len(_LINES) + 2:]}
, g AS (SELECT 'structure' AS gate, decision FROM structure UNION ALL
  SELECT 'references', CASE WHEN bad_urls + untitled + bad_sources + dangling > 0 THEN 'fail' ELSE 'pass' END FROM refs)
SELECT gate, decision, CASE WHEN decision = 'pass' THEN NULL WHEN decision = 'cannot_verify' THEN 'unknown_variant' ELSE 'policy_violation' END AS failure_class,
 CASE decision WHEN 'pass' THEN 'allow' WHEN 'cannot_verify' THEN 'warn' ELSE 'block' END AS policy_action, decision <> 'fail' AS ok, count(*)::BIGINT AS articles FROM g GROUP BY ALL""",
)
def article_gate_run(spark, root):
    """Two registered gates over all articles under a policy that only warns on uncertainty."""
    results = gates.run_gates(spark, ["structure", "references"], {"articles": articles(spark, root)}, {"on_cannot_verify": "warn"})
    return results.groupBy("gate", "decision", "failure_class", "policy_action", "ok").agg(F.count(F.lit(1)).alias("articles"))


@query(
    "article_cited_references",
    f"""WITH {_LINES} SELECT doc_id AS day, i::BIGINT AS ref_id, CASE WHEN n % 13 = 0 THEN 'ftp' ELSE 'https' END || '://docs.example/' || i::VARCHAR AS url FROM lines""",
)
def article_cited_references(spark, root):
    return contract.cited_references(articles(spark, root))


# -- JSON and conversations ----------------------------------------------------------------------


@query(
    "json_gate",
    """SELECT event_id AS path, CASE WHEN value > 100 THEN 'fail' ELSE 'pass' END AS decision, CASE WHEN value > 100 THEN 0 ELSE 1 END::INTEGER AS top_level_keys FROM events""",
)
def json_gate(spark, root):
    """Event properties as files; those of expensive events are cut short and must fail."""
    whole = F.col("props")
    cut = F.expr("substring(props, 1, length(props) - 1)")
    files = table(spark, root, "events").select(
        F.col("event_id").alias("path"), F.when(F.col("value") > 100, cut).otherwise(whole).alias("content")
    )
    return contract.json_gate(files)


@query(
    "json_props",
    """SELECT event_type, count(*)::BIGINT AS events, sum((props->>'$.k')::BIGINT) FILTER ((props->>'$.k')::BIGINT % 17 <> 0)::BIGINT AS k_sum,
count(*) FILTER ((props->>'$.k')::BIGINT % 17 = 0)::BIGINT AS malformed FROM events GROUP BY 1""",
)
def json_props(spark, root):
    """Properties of each event; where k is a multiple of 17 the text arrives cut short and is counted as malformed."""
    cut = F.when(F.get_json_object("props", "$.k").cast("long") % 17 == 0, F.regexp_replace("props", r"\}$", "")).otherwise(F.col("props"))
    parsed = table(spark, root, "events").select("event_type", F.try_parse_json(cut).alias("v"))
    return parsed.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.try_variant_get("v", "$.k", "long")).alias("k_sum"),
        F.count_if(F.col("v").isNull()).alias("malformed"),
    )


@query(
    "files_missing",
    "SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def files_missing(spark, root):
    expected = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("path"))
    present = table(spark, root, "labels").select(F.col("doc_id").cast("string").alias("path"))
    return contract.files_gate(expected, present)


@query(
    "doc_contract",
    """SELECT conv_id, count(*)::BIGINT AS turns, 2 - count(DISTINCT role) FILTER (role IN ('user', 'assistant'))::BIGINT AS missing_roles,
CASE WHEN count(*) FILTER (role NOT IN ('user', 'assistant', 'system')) > 0 THEN 'cannot_verify' WHEN count(*) > 6 OR count(DISTINCT role) FILTER (role IN ('user', 'assistant')) < 2 THEN 'fail' ELSE 'pass' END AS decision
FROM conversations GROUP BY conv_id""",
)
def doc_contract(spark, root):
    """Both speakers present, at most six turns, no undeclared speaker."""
    role = F.col("role")
    tally = table(spark, root, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.max((role == "user").cast("long")).alias("u"), F.max((role == "assistant").cast("long")).alias("a"),
        F.count_if(~role.isin("user", "assistant", "system")).alias("unknown"),
    )
    missing = F.lit(2) - F.col("u") - F.col("a")
    return tally.select(
        "conv_id", "turns", missing.cast("long").alias("missing_roles"),
        F.when(F.col("unknown") > 0, "cannot_verify").when((F.col("turns") > 6) | (missing > 0), "fail").otherwise("pass").alias("decision"),
    )


@query("section_caps", "SELECT conv_id, count(*)::BIGINT AS turns FROM conversations GROUP BY conv_id HAVING count(*) > 5")
def section_caps(spark, root):
    return table(spark, root, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")).filter("turns > 5")


# -- generated pages -----------------------------------------------------------------------------


@query(
    "html_link_harvest",
    """WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)
SELECT page_id, len(l)::INTEGER AS links, len(list_distinct(l))::INTEGER AS distinct_links, array_to_string(list_sort(list_distinct(l)), ' ') AS targets FROM h""",
)
def html_link_harvest(spark, root):
    html = table(spark, root, "pages").select("page_id", F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)).alias("l"), pages.hrefs(F.col("html")).alias("d"))
    return html.select("page_id", F.size("l").alias("links"), F.size("d").alias("distinct_links"), F.array_join(F.array_sort("d"), " ").alias("targets"))


@query(
    "index_gate",
    """WITH d AS (SELECT DISTINCT user_id AS page_id, ts::DATE::VARCHAR AS d FROM events),
g AS (SELECT page_id, count(*) AS n, max(d) AS latest, count(*) FILTER (d < '2024-01-02') AS early, count(*) FILTER (d = '2024-01-15') AS hit FROM d GROUP BY 1)
SELECT page_id, n::INTEGER AS dates, latest, (early + CASE WHEN hit = 0 THEN 1 ELSE 0 END)::INTEGER AS problems,
CASE WHEN early + CASE WHEN hit = 0 THEN 1 ELSE 0 END > 0 THEN 'fail' ELSE 'pass' END AS decision FROM g""",
)
def index_gate(spark, root):
    """An index page per user linking the days the user was seen; the distinct days bound the page."""
    link = F.concat(F.lit('<a href="/trends/'), F.to_date("ts").cast("string"), F.lit('/">'))
    built = table(spark, root, "events").groupBy(F.col("user_id").alias("page_id")).agg(
        F.array_join(F.collect_set(link), "").alias("html")
    )
    return pages.index_gate(built.withColumn("expected", F.lit("2024-01-15")), "2024-01-02")


@query(
    "sitemap_gate",
    """WITH h AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l, length(html) AS n FROM pages),
c AS (SELECT page_id, n, n % 9 <> 0 AS well_formed, n % 10 = 0 AS missing, n % 20 <> 0 AS folder_exists, len(l) AS urls, len(l) - len(list_distinct(l)) AS duplicates,
  n % 12 AS blank_run FROM h)
SELECT page_id AS path, CASE WHEN missing OR NOT well_formed THEN 0 ELSE urls END::INTEGER AS urls, CASE WHEN missing OR NOT well_formed THEN 0 ELSE duplicates END::INTEGER AS duplicates,
CASE WHEN missing THEN 0 ELSE blank_run END::INTEGER AS blank_run,
CASE WHEN missing AND NOT folder_exists THEN 'abstain' WHEN missing OR NOT well_formed OR duplicates > 0 OR blank_run > 8 THEN 'fail' ELSE 'pass' END AS decision FROM c""",
)
def sitemap_gate(spark, root):
    """A sitemap per page from its links; the length of the page plants each kind of damage."""
    size = F.length("html")
    locs = F.transform(
        F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)),
        lambda h: F.concat(F.lit("<url><loc> https://site.example"), h, F.lit(" </loc></url>")),
    )
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'),
        F.array_join(locs, "\n"), F.lit("\n"), F.repeat(F.lit(" \n"), (size % 12).cast("int")),
        F.when(size % 9 == 0, F.lit("")).otherwise(F.lit("</urlset>")),
    )
    made = table(spark, root, "pages").select(
        F.col("page_id").alias("path"), (size % 20 != 0).alias("folder_exists"), F.when(size % 10 != 0, xml).alias("content")
    )
    return pages.sitemap_gate(made).select("path", "urls", "duplicates", "blank_run", "decision")


# -- captures ------------------------------------------------------------------------------------


def _captures(spark, root):
    """A capture document per page: its links as ranked entries, its address nested and escaped."""
    def entry(h, i):
        return F.struct(
            h.alias("title"), F.concat(F.lit("https://site.example"), h).alias("url"), F.length(h).alias("points"),
            F.struct(F.concat(F.lit('say "url":"no" '), h).alias("note"), F.concat(F.lit("http://deep.example/"), i.cast("string")).alias("link")).alias("more"),
        )

    links = F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), entry)
    doc = F.to_json(F.struct(
        links.alias("hn"), F.struct(F.array(F.struct(F.col("url").alias("url"), F.lit("2024-01-01").alias("date"))).alias("site")).alias("feeds"),
        F.lit(5).alias("url"), F.array(F.lit("url"), F.col("url")).alias("words"),
    ))
    return table(spark, root, "pages").select(F.col("page_id").alias("day"), doc.alias("content"))


_CAP = "h AS (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)"


@query(
    "capture_url_walk",
    f"""WITH {_CAP}, u AS (SELECT page_id AS day, 'https://site.example' || unnest(l) AS url, 2 * unnest(range(len(l))) AS pos FROM h
UNION ALL SELECT page_id, 'http://deep.example/' || unnest(range(len(l)))::VARCHAR, 2 * unnest(range(len(l))) + 1 FROM h UNION ALL SELECT page_id, url, 2 * len(l) FROM h)
SELECT day, url, count(*)::BIGINT AS n, min(pos)::INTEGER AS first_at FROM u GROUP BY 1, 2""",
)
def capture_url_walk(spark, root):
    """Addresses at any depth; look-alikes inside strings and non-string values are not taken."""
    found = capture.capture_urls(_captures(spark, root), http_only=True)
    return found.groupBy("day", "url").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first_at"))


@query(
    "capture_bucket_counts",
    f"WITH {_CAP} SELECT page_id AS day, 'hn' AS bucket, len(l)::INTEGER AS entries FROM h UNION ALL SELECT page_id, 'words', 2 FROM h",
)
def capture_bucket_counts(spark, root):
    return capture.bucket_counts(_captures(spark, root))


@query(
    "capture_ranked",
    f"""WITH {_CAP}, r AS (SELECT page_id AS day, unnest(l) AS title, generate_subscripts(l, 1) - 1 AS position FROM h)
SELECT day, title, row_number() OVER (PARTITION BY day ORDER BY length(title) DESC, position)::INTEGER AS rank_in_source FROM r QUALIFY rank_in_source <= 3""",
)
def capture_ranked(spark, root):
    """The three strongest entries of each capture by its own signal."""
    pool = coverage.ranked_pool(capture.signal_rows(_captures(spark, root)), 3)
    return pool.select("day", "title", "rank_in_source")


@query(
    "capture_evidence",
    f"""WITH {_CAP}, r AS (SELECT page_id AS day, unnest(l) AS title, generate_subscripts(l, 1) - 1 AS position FROM h)
SELECT day, title, position::INTEGER AS position FROM r QUALIFY row_number() OVER (PARTITION BY day ORDER BY length(title) DESC, position) <= 25""",
)
def capture_evidence(spark, root):
    return capture.prefilter(capture.signal_rows(_captures(spark, root))).select("day", "title", "position")


@query("capture_feeds", "SELECT page_id AS day, 'site' AS feed, '2024-01-01' AS dated FROM pages")
def capture_feeds(spark, root):
    return capture.feed_rows(_captures(spark, root)).select("day", "feed", "dated")


@query(
    "capture_unselected",
    f"""WITH {_CAP}, r AS (SELECT page_id, 'https://site.example' || unnest(l) AS url, unnest(l) AS title, unnest(range(len(l))) AS position, len(l) AS n FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(title) DESC, position) AS rank FROM r QUALIFY rank <= 4)
SELECT page_id AS day, 'hn' AS bucket, regexp_replace(url, '/+$', '') AS url, rank::INTEGER AS rank_in_source FROM k WHERE position % 2 = 1
UNION ALL SELECT page_id, 'feed:site', regexp_replace(url, '/+$', ''), 1 FROM h WHERE page_id % 3 <> 0""",
)
def capture_unselected(spark, root):
    """The strongest capture rows and feed entries that an article left out: it cites every other link, and every third feed."""
    captures = _captures(spark, root)
    rows = capture.signal_rows(captures).filter("bucket = 'hn'")
    cited = rows.filter("position % 2 = 0").select("day", F.regexp_replace("url", "/+$", "").alias("url"), F.col("position").alias("at"))
    # A link may stand at several places: those at odd ones count as left out, as their places are cited by none.
    own = rows.withColumn("url", F.concat("url", F.lit("#"), F.col("position").cast("string")))
    feeds = capture.feed_rows(captures)
    used = cited.select("day", F.concat("url", F.lit("#"), F.col("at").cast("string")).alias("url")).unionByName(
        feeds.filter("day % 3 = 0").select("day", F.regexp_replace("url", "/+$", "").alias("url")))
    found = selection.unselected_candidates(own, used, 4, feeds)
    return found.select("day", "bucket", F.regexp_replace(F.regexp_replace("url", "#[0-9]+$", ""), "/+$", "").alias("url"), "rank_in_source")


@query(
    "item_unknown_keys",
    f"""WITH {_LINES} SELECT doc_id AS day, count(*) FILTER (n < 5)::BIGINT AS with_unknown_keys, count(*)::BIGINT AS items FROM items GROUP BY 1""",
)
def item_unknown_keys(spark, root):
    """Items that carry a key the contract does not name."""
    items = contract.flatten_items(articles(spark, root))
    return items.groupBy("day").agg(F.count_if(F.size("extra_keys") > 0).alias("with_unknown_keys"), F.count(F.lit(1)).alias("items"))


@query(
    "items_after_drop",
    f"""WITH {_LINES} SELECT doc_id AS day, count(*)::BIGINT AS items FROM items WHERE n % 4 <> 1 OR n < 5 GROUP BY 1""",
)
def items_after_drop(spark, root):
    """Items that stay when the locations of all items written as fields are dropped."""
    items = materialise(contract.flatten_items(articles(spark, root)).select("day", "location", "variant"), "items")
    return contract.drop_items(items, items.filter("variant = 'fields'")).groupBy("day").agg(F.count(F.lit(1)).alias("items"))


# -- memory files --------------------------------------------------------------------------------


@query(
    "memory_front_matter",
    """SELECT '/memory/notes/' || doc_id::VARCHAR || '.md' AS path, 'notes' AS kind, trim(split_part(text, chr(10), 1)) AS title, lang || ',' || source AS tags, '2024-05-01' AS date, md5(ltrim(text, chr(10))) AS body FROM documents""",
)
def memory_front_matter(spark, root):
    """Documents written as notes with front matter, and read back."""
    head = F.substring_index("text", "\n", 1)
    content = F.concat(
        F.lit("---\ntitle: "), head, F.lit("\ntags: "), "lang", F.lit(", "), "source", F.lit("\ndate: 2024-05-01\n---\n"), "text"
    )
    files = table(spark, root, "documents").select(
        F.concat(F.lit("/memory/notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("doc_id").cast("string").alias("stem"), content.alias("content"),
    )
    return memory.parse_entries(files).select("path", "kind", "title", F.array_join("tags", ",").alias("tags"), "date", F.md5("body").alias("body"))


@query(
    "memory_run_rows",
    f"""WITH {sql.RUNS} SELECT 'runs/' || run_id::VARCHAR || '.md' AS path, task::VARCHAR || ' · ' || target_date::VARCHAR || ' · ' || status AS title, target_date::VARCHAR AS date FROM runs""",
)
def memory_run_rows(spark, root):
    runs = inputs.runs(spark, root).select(
        F.col("run_id").cast("string").alias("run_id"), F.col("task").cast("string").alias("task"),
        F.col("target_date").cast("string").alias("target_date"), "status", F.lit("ok").alias("summary"),
    )
    return memory.run_rows(runs).select("path", "title", "date")


# -- release -------------------------------------------------------------------------------------


@query(
    "release_gate",
    f"""WITH {sql.CAPTURED}, {sql.KNOWN}, {sql.CITATIONS}, {sql.typed('citations', 'cite_id, form')},
d AS (SELECT day, count(*) FILTER (decision = 'fail') AS failed, count(*) FILTER (decision = 'fail' AND EXISTS (
    SELECT 1 FROM known k WHERE k.canonical = target AND k.day <> typed.day)) AS stale, count(*) FILTER (decision <> 'pass') AS bad FROM typed GROUP BY 1),
n AS (SELECT *, day NOT IN (SELECT day FROM known) AS raw_missing FROM d ORDER BY day DESC LIMIT 2)
SELECT day, CASE WHEN bad > 0 AND (raw_missing OR failed > stale) THEN 'verifiable' ELSE '' END AS hard_blockers, bad > 0 AND NOT (raw_missing OR failed > stale) AS warned,
CASE WHEN bad > 0 AND (raw_missing OR failed > stale) THEN 'block' ELSE 'publish' END AS release FROM n""",
)
def release_gate(spark, root):
    """May the two newest days be published?"""
    known = inputs.known(spark, root)
    judged = provenance.classify_citations(inputs.citations(spark, root), known)
    stale = provenance.stale_days(judged.filter("decision = 'fail' and target <> ''"), known).select("day", "target", F.lit(1).alias("stale"))
    facts = judged.join(stale, ["day", "target"], "left").groupBy("day").agg(
        F.count_if(F.col("decision") == "fail").alias("failed"), F.coalesce(F.sum("stale"), F.lit(0)).alias("stale_citations"),
        F.count_if(F.col("decision") != "pass").alias("bad"),
    )
    facts = facts.join(known.select("day").distinct().withColumn("captured", F.lit(True)), "day", "left").select(
        F.col("day").alias("entity"), "bad", F.col("captured").isNull().alias("raw_missing"),
        (F.col("failed") - F.col("stale_citations")).alias("unknown_citations"), "stale_citations",
    )
    debt = facts.select(F.col("entity").alias("day"), F.when(F.col("bad") > 0, "verifiable").otherwise("").alias("blockers"))
    return gates.release_gate(debt, facts, 2)
