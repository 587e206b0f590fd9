"""SQL fragments shared by the checks (DuckDB dialect). Written apart from the Column code."""

from __future__ import annotations

from attesta.functions.vocabulary import DRIFT_PARAMETER


def canonical(x: str) -> str:
    text = f"split_part(trim({x}), '#', 1)"
    kept = (
        f"array_to_string(list_filter(string_split(substr({text}, instr({text}, '?') + 1), '&'), "
        "lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|gclid|fbclid|ref=|source=|mc_cid|mc_eid)')), '&')"
    )
    query = f"CASE WHEN instr({text}, '?') = 0 OR {kept} = '' THEN '' ELSE '?' || {kept} END"
    full = f"(split_part({text}, '?', 1) || {query})"
    bare = f"regexp_replace(regexp_replace({full}, '^(https://|http://)', ''), '^www\\.', '')"
    return f"lower(rtrim({bare}, '/'))"


def legacy(x: str) -> str:
    text = f"rtrim(trim({x}), '/')"
    for prefix in ("https://", "http://", "www\\."):
        text = f"regexp_replace({text}, '^{prefix}', '')"
    return f"lower({text})"


def drifts(url: str) -> list[tuple[str, str]]:
    scheme = (
        f"CASE WHEN {url} LIKE 'https://%' THEN 'http://' || substr({url}, 9) "
        f"WHEN {url} LIKE 'http://%' THEN 'https://' || substr({url}, 8) ELSE {url} END"
    )
    slash = f"CASE WHEN instr({url}, '?') = 0 THEN rtrim({url}, '/') || '/' END"
    tracking = f"{url} || CASE WHEN instr({url}, '?') > 0 THEN '&' ELSE '?' END || '{DRIFT_PARAMETER}'"
    www = (
        f"CASE WHEN regexp_matches({url}, '^https?://www\\.') THEN replace({url}, '://www.', '://') "
        f"ELSE regexp_replace({url}, '^(https?://)', '\\1www.') END"
    )
    return [("scheme", scheme), ("trailing_slash", slash), ("tracking_params", tracking), ("www", www)]


def rotated(url: str, index: str) -> str:
    built = [f"nullif({sql}, {url})" for _, sql in drifts(url)]
    arms = " ".join(
        f"WHEN {i} THEN coalesce({', '.join(built[i:] + built[:i])})" for i in range(4)
    )
    return f"CASE ({index}) % 4 {arms} END"


CAPTURED = f"captured AS (SELECT page_id, page_id // 100 AS day, url, html, {canonical('url')} AS canonical FROM pages)"
KNOWN = "known AS (SELECT DISTINCT day, canonical FROM captured)"

CITATIONS = f"""citations AS (
  SELECT page_id * 6 + 0 AS cite_id, 'drift' AS form, day, {rotated('url', 'page_id')} AS url FROM captured
  UNION ALL SELECT page_id * 6 + 1, 'late', day + 1, url FROM captured
  UNION ALL SELECT page_id * 6 + 2, 'extension', day, 'https://' || canonical || '/this-page-never-existed' FROM captured
  UNION ALL SELECT page_id * 6 + 3, 'suffix', day, 'https://' || canonical || '-v99-fake' FROM captured
  UNION ALL SELECT page_id * 6 + 4, 'bare', day, split_part(url, '?', 1) FROM captured
  UNION ALL SELECT page_id * 6 + 5, 'cut', day, 'https://' || regexp_replace(canonical, '/[^/]*$', '') FROM captured)"""


def typed(source: str, extra: str) -> str:
    """CTEs judging `source`(day, url, extra columns) by brute force: every pair is compared."""
    return f"""aimed AS (SELECT {extra}, day, {canonical('url')} AS target FROM {source}),
targets AS (SELECT DISTINCT day, target FROM aimed),
pairs AS (
  SELECT t.day, t.target, k.canonical,
    CASE WHEN k.canonical = t.target THEN 1
         WHEN regexp_replace(t.target, '(arxiv\\.org/abs/[^v]*)v[0-9]+$', '\\1') <> t.target
              AND regexp_replace(t.target, '(arxiv\\.org/abs/[^v]*)v[0-9]+$', '\\1') = k.canonical THEN 2
         WHEN instr(t.target, '?') = 0 AND starts_with(k.canonical, t.target || '?') THEN 3
         WHEN length(k.canonical) >= 20 AND (starts_with(t.target, k.canonical) OR starts_with(k.canonical, t.target)) THEN 4
    END AS rung
  FROM targets t JOIN known k ON t.day = k.day),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY day, target ORDER BY rung, length(canonical) DESC, canonical) AS rn
  FROM pairs WHERE rung IS NOT NULL AND target <> ''),
verdicts AS (
  SELECT t.day, t.target, r.canonical AS matched, coalesce(r.rung, CASE WHEN t.target = '' THEN 0 ELSE 5 END) AS rung
  FROM targets t LEFT JOIN ranked r ON t.day = r.day AND t.target = r.target AND r.rn = 1),
typed AS (
  SELECT a.*, v.matched,
    CASE WHEN v.rung IN (1, 2, 3) THEN 'pass' WHEN v.rung = 4 THEN 'cannot_verify' ELSE 'fail' END AS decision,
    CASE v.rung WHEN 0 THEN 'malformed' WHEN 4 THEN 'unknown_variant' WHEN 5 THEN 'fabricated_source' END AS failure_class,
    CASE v.rung WHEN 2 THEN 'arxiv_version' WHEN 3 THEN 'query_suffix' END AS drift
  FROM aimed a JOIN verdicts v ON a.day = v.day AND a.target = v.target)"""


def legacy_verdicts(source: str, extra: str) -> str:
    return f"""old_aimed AS (SELECT {extra}, day, {legacy('url')} AS target FROM {source}),
old AS (
  SELECT a.*, CASE WHEN EXISTS (
      SELECT 1 FROM known k WHERE k.day = a.day AND (
        k.canonical = a.target OR k.canonical = split_part(a.target, '?', 1)
        OR (length(split_part(a.target, '?', 1)) > 20 AND (
             starts_with(k.canonical, split_part(a.target, '?', 1)) OR starts_with(split_part(a.target, '?', 1), k.canonical))))
    ) THEN 'pass' ELSE 'fail' END AS decision
  FROM old_aimed a)"""


JUDGED = """judged AS (
  SELECT l.doc_id AS sample_id, d.lang AS kind,
    CASE WHEN l.quality = 1 THEN 'pass' ELSE 'not_pass' END AS expect,
    CASE WHEN l.toxic = 0 THEN round_even(len(list_distinct(ws)) / len(ws)::DOUBLE, 4) END AS probability,
    CASE WHEN d.n_chars >= 1000 THEN 1.0 WHEN d.n_chars < 300 THEN 0.0 END::DOUBLE AS rule_probability
  FROM labels l JOIN (
    SELECT doc_id, lang, n_chars, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS ws FROM documents) d
  ON l.doc_id = d.doc_id)"""

RUNS = """runs AS (
  SELECT event_id AS run_id, user_id AS task, ts::DATE AS target_date, ts AS started_at,
    ts + to_seconds((props->>'$.k')::BIGINT) AS finished_at,
    CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'degraded' WHEN 'signup' THEN 'running'
      WHEN 'purchase' THEN 'failed' ELSE 'crashed' END AS status,
    (props->>'$.k')::BIGINT < 10 AS dry_run, (props->>'$.k')::BIGINT AS tokens_in,
    (props->>'$.k')::BIGINT * 2 AS tokens_out, (props->>'$.k')::BIGINT * 1000 AS duration_ms,
    event_type = 'error' AS human_intervention,
    CASE WHEN event_type <> 'error' THEN value END AS cost_usd, 'exp-' || event_type AS experiment, user_id AS pid
  FROM events)"""


def rates(alias: str = "") -> str:
    """Confusion columns over rows (expect, verdict)."""
    return """count(*)::BIGINT AS samples,
  count(*) FILTER (expect = 'not_pass')::BIGINT AS attacks,
  count(*) FILTER (expect = 'pass')::BIGINT AS legit,
  count(*) FILTER (expect = 'not_pass' AND verdict = 'pass')::BIGINT AS false_pass_count,
  count(*) FILTER (expect = 'pass' AND verdict = 'fail')::BIGINT AS false_fail_count,
  count(*) FILTER (verdict = 'cannot_verify')::BIGINT AS cannot_verify_count,
  round_even(count(*) FILTER (expect = 'not_pass' AND verdict = 'pass') / nullif(count(*) FILTER (expect = 'not_pass'), 0)::DOUBLE, 4) AS false_pass_rate,
  round_even(count(*) FILTER (expect = 'pass' AND verdict = 'fail') / nullif(count(*) FILTER (expect = 'pass'), 0)::DOUBLE, 4) AS false_fail_rate,
  round_even(count(*) FILTER (verdict = 'cannot_verify') / count(*)::DOUBLE, 4) AS cannot_verify_rate"""
