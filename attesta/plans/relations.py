"""Queries: ranking and coverage, decisions, refunds, merges, ledger, experiments, search, compose."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import parsing
from attesta.functions.decisions import allowed, policy_action
from attesta.operators import (
    compose,
    coverage,
    experiment,
    gates,
    ledger,
    merge_review,
    ranking,
    refund,
    search,
)
from attesta.plans import inputs, sql
from attesta.plans.registry import query
from attesta.session import fresh_path, materialise, table
from attesta.sources import store

# -- ranking and coverage ------------------------------------------------------------------------


@query(
    "topk_per_source",
    """SELECT ts::DATE::VARCHAR AS day, event_type, event_id, value, row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY value DESC, event_id)::INTEGER AS rank
FROM events QUALIFY rank <= 10""",
)
def topk_per_source(spark, root):
    events = table(spark, root, "events").withColumn("day", F.to_date("ts").cast("string"))
    top = ranking.top_k(events, 10, ["day", "event_type"], [F.desc("value"), F.asc("event_id")])
    return top.select("day", "event_type", "event_id", "value", "rank")


@query(
    "newest_per_source",
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id)::INTEGER AS rank FROM events QUALIFY rank <= 20""",
)
def newest_per_source(spark, root):
    events = table(spark, root, "events").select("event_type", "event_id", "ts")
    return ranking.top_k(events, 20, ["event_type"], [F.desc("ts"), F.asc("event_id")]).select("event_type", "event_id", "rank")


# Events as capture rows: the type is the bucket, the value the signal, and the address carries a
# query that an article may leave out. Purchases are what the articles cite, by their bare address.
_POOL = """rows AS (SELECT ts::DATE::VARCHAR AS day, event_type AS bucket, event_id AS position, value AS signal,
  'https://events.example/' || event_type || '/' || (event_id // 3)::VARCHAR || CASE WHEN length(props) > 8 THEN '?view=' || user_id::VARCHAR ELSE '' END AS url FROM events),
pool AS (SELECT *, row_number() OVER (PARTITION BY day, bucket ORDER BY signal DESC, position)::INTEGER AS rank_in_source FROM rows QUALIFY rank_in_source <= 10),
cited AS (SELECT DISTINCT ts::DATE::VARCHAR AS day, 'events.example/' || event_type || '/' || (event_id // 3)::VARCHAR AS canonical FROM events WHERE value < 40),
marked AS (SELECT p.*, p.bucket IN ('purchase', 'signup') AS on_topic, EXISTS (SELECT 1 FROM cited c WHERE c.day = p.day AND c.canonical = substr(split_part(p.url, '?', 1), 9)) AS covered FROM pool p)"""


def _marked(spark, root):
    events = table(spark, root, "events")
    kind, group = F.col("event_type"), F.expr("event_id div 3").cast("string")
    base = F.concat(F.lit("https://events.example/"), kind, F.lit("/"), group)
    view = F.when(F.length("props") > 8, F.concat(F.lit("?view="), F.col("user_id").cast("string"))).otherwise(F.lit(""))
    day = F.to_date("ts").cast("string").alias("day")
    none = F.lit(None).cast("string")
    rows = events.select(
        day, kind.alias("bucket"), kind.alias("source"), F.col("event_id").alias("position"), kind.alias("title"),
        F.concat(base, view).alias("url"), none.alias("text"), none.alias("date"),
        F.col("value").alias("signal_number"), none.alias("signal_text"),
    )
    cited = events.filter("value < 40").select(day, F.concat(F.lit("events.example/"), kind, F.lit("/"), group).alias("canonical")).distinct()
    pool = coverage.ranked_pool(rows, 10).withColumn("on_topic", coverage.on_topic(F.col("title"), ["purchase", "signup"]))
    return coverage.mark_covered(pool, cited)


@query(
    "coverage_misses",
    f"""WITH {_POOL} SELECT day, bucket, url, rank_in_source, row_number() OVER (PARTITION BY day ORDER BY NOT on_topic, rank_in_source, bucket)::INTEGER AS miss_no
FROM marked WHERE NOT covered""",
)
def coverage_misses(spark, root):
    """High-signal rows the day's article left out, on-topic ones first."""
    return coverage.misses(_marked(spark, root)).select("day", "bucket", "url", "rank_in_source", "miss_no")


@query(
    "coverage_gate",
    f"""WITH {_POOL} SELECT day, count(*)::BIGINT AS pool, count(*) FILTER (NOT covered)::BIGINT AS missed,
count(*) FILTER (NOT covered AND rank_in_source <= 3)::BIGINT AS top3_missed_all, count(*) FILTER (NOT covered AND on_topic AND rank_in_source <= 3)::BIGINT AS top3_missed,
count(*) FILTER (NOT covered AND on_topic)::BIGINT AS missed_on_topic, 0::BIGINT AS off_window_dropped,
round_even(count(*) FILTER (covered) / count(*)::DOUBLE, 3) AS pool_coverage_ratio, 'pass' AS decision FROM marked GROUP BY day""",
)
def coverage_gate(spark, root):
    return coverage.coverage_gate(_marked(spark, root))


# -- decisions -----------------------------------------------------------------------------------

_DECIDED = """decided AS (SELECT *, CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'pass' WHEN 'signup' THEN 'abstain'
  WHEN 'purchase' THEN 'cannot_verify' ELSE 'fail' END AS decision,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS sev FROM events)"""


def _results(spark, root, policy=None):
    """Events as gate results: the hour of the user's day is the run, the type decides."""
    kind = F.col("event_type")
    decision = F.when(kind.isin("view", "click"), "pass").when(kind == "signup", "abstain").when(kind == "purchase", "cannot_verify").otherwise("fail")
    rows = table(spark, root, "events").select(
        "event_id", F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("entity"), kind.alias("gate"), decision.alias("decision")
    )
    action = policy_action(F.col("decision"), policy)
    return rows.withColumns({"policy_action": action, "ok": allowed(F.col("decision"), action)})


@query(
    "decision_fold",
    f"""WITH {_DECIDED}, g AS (SELECT user_id::VARCHAR || '-' || ts::DATE::VARCHAR AS entity, max(sev) AS s, count(*) FILTER (sev = 0)::BIGINT AS n_pass,
count(*) FILTER (sev = 1)::BIGINT AS n_abstain, count(*) FILTER (sev = 2)::BIGINT AS n_cannot_verify, count(*) FILTER (sev = 3)::BIGINT AS n_fail,
coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (sev > 0), '') AS blocking,
coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (sev = 2), '') AS uncertain FROM decided GROUP BY 1)
SELECT entity, ['pass', 'abstain', 'cannot_verify', 'fail'][s + 1] AS decision, n_pass, n_abstain, n_cannot_verify, n_fail, blocking, uncertain FROM g""",
)
def decision_fold(spark, root):
    """Run-level verdict: the worst decision wins, nothing is averaged away."""
    return gates.combine(_results(spark, root), ["entity"])


@query(
    "policy_apply",
    f"""WITH {_DECIDED}, p AS (SELECT unnest(['strict', 'lenient']) AS policy),
a AS (SELECT policy, decision, CASE WHEN decision = 'pass' THEN 'allow' WHEN policy = 'lenient' AND decision IN ('cannot_verify', 'abstain') THEN 'warn' ELSE 'block' END AS policy_action FROM decided, p)
SELECT policy, decision, policy_action, decision = 'pass' OR policy_action = 'warn' AS ok, count(*)::BIGINT AS results FROM a GROUP BY ALL""",
)
def policy_apply(spark, root):
    """Each decision under a blocking and a warning policy, in one scan."""
    kinds = _results(spark, root).select("decision")
    lenient = {"on_cannot_verify": "warn", "on_abstain": "warn"}
    options = F.explode(F.array(*[
        F.struct(F.lit(name).alias("policy"), policy_action(F.col("decision"), rules).alias("policy_action"))
        for name, rules in (("strict", None), ("lenient", lenient))
    ])).alias("p")
    spread = kinds.select("decision", options).select("decision", "p.*")
    return spread.groupBy("policy", "decision", "policy_action", allowed(F.col("decision"), F.col("policy_action")).alias("ok")).agg(
        F.count(F.lit(1)).alias("results")
    )


@query(
    "repair_brief",
    """SELECT event_type AS gate, CASE WHEN event_type = 'error' OR event_type = 'purchase' THEN 'entry' ELSE 'warning' END AS role, count(*)::BIGINT AS results
FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2""",
)
def repair_brief(spark, root):
    """Blocked results by gate; gates the declaration calls optional only warn."""
    results = _results(spark, root)
    declared = results.select("gate").distinct().withColumn("required", F.col("gate").isin("error", "purchase", "view"))
    brief = gates.repair_brief(results, declared)
    return brief.groupBy("gate", "role").agg(F.count(F.lit(1)).alias("results"))


@query(
    "content_debt",
    """WITH d AS (SELECT user_id::VARCHAR || '-' || ts::DATE::VARCHAR AS day, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
  count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS bought FROM events GROUP BY 1),
b AS (SELECT day, concat_ws(',', CASE WHEN clicks = 0 THEN 'click' END, CASE WHEN errors > 0 OR views = 0 THEN 'view' END) AS blockers, bought > 0 AS gate_stale FROM d)
SELECT day, blockers, gate_stale, blockers = '' AS clean FROM b""",
)
def content_debt(spark, root):
    """Which required gates block each user's day: clicks must be there, views must be there and without an error."""
    name = F.when(F.col("gate") == "error", "view").when(F.col("gate") == "purchase", "structure").otherwise(F.col("gate"))
    return gates.content_debt(_results(spark, root).withColumn("gate", name), ["click", "view"])


# -- refunds -------------------------------------------------------------------------------------

# The delivery of an order is its last shipment; the newest shipment of all is 'today'.
_REFUND = """ships AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1),
book AS (SELECT o_orderkey AS order_id, nullif(o_orderstatus, '') AS status, o_orderpriority, o_totalprice,
  date_diff('day', shipped, (SELECT max(l_shipdate) FROM lineitem)) AS days, shipped IS NOT NULL AS paid,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'EUR' ELSE 'USD' END AS currency FROM orders LEFT JOIN ships ON o_orderkey = l_orderkey),
checks AS (SELECT *, CASE WHEN status IS NULL THEN 2 WHEN status IN ('F', 'P') THEN 0 ELSE 3 END AS c1, CASE WHEN days IS NULL THEN 2 WHEN days <= 1000 THEN 0 ELSE 3 END AS c2,
  CASE WHEN paid THEN 0 ELSE 2 END AS c3, CASE WHEN currency = 'USD' THEN 0 ELSE 2 END AS c4 FROM book),
truth AS (SELECT *, greatest(c1, c2, c3, c4) AS sev FROM checks),
decided AS (SELECT *, CASE sev WHEN 0 THEN 'pass' WHEN 2 THEN 'cannot_verify' ELSE 'fail' END AS decision, CASE sev WHEN 0 THEN 'approve' ELSE 'deny' END AS action FROM truth)"""


def _book(spark, root):
    lines = table(spark, root, "lineitem")
    ships = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    today = lines.agg(F.max("l_shipdate").alias("today"))
    orders = table(spark, root, "orders")
    return (
        orders.join(ships, orders.o_orderkey == ships.l_orderkey, "left")
        .crossJoin(F.broadcast(today))
        .select(
            F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), "o_orderpriority", "o_totalprice",
            F.date_diff("today", "shipped").alias("days_since_delivery"), F.col("o_orderkey").alias("payment_ref"),
            F.when(F.col("o_orderpriority") == "3-MEDIUM", "EUR").otherwise("USD").alias("currency"),
        )
    )


def _decided(spark, root):
    paid = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("payment_ref"))
    return refund.decide(_book(spark, root), paid, ["F", "P"], 1000, "USD")


@query(
    "refund_decide",
    f"""WITH {_REFUND} SELECT order_id, decision, action, CASE decision WHEN 'fail' THEN 'policy_violation' WHEN 'cannot_verify' THEN 'precondition_unknown' END AS failure_class,
array_to_string(list_filter([CASE WHEN c1 = 3 THEN 'order_status' END, CASE WHEN c2 = 3 THEN 'refund_window' END], lambda x: x IS NOT NULL), ',') AS failed_checks,
array_to_string(list_filter([CASE WHEN c1 = 2 THEN 'order_status' END, CASE WHEN c2 = 2 THEN 'refund_window' END, CASE WHEN c3 = 2 THEN 'payment_reference' END, CASE WHEN c4 = 2 THEN 'currency' END], lambda x: x IS NOT NULL), ',') AS unverified_checks
FROM decided""",
)
def refund_decide(spark, root):
    return _decided(spark, root).select(
        "order_id", "decision", "action", "failure_class",
        F.array_join("failed_checks", ",").alias("failed_checks"), F.array_join("unverified_checks", ",").alias("unverified_checks"),
    )


# Proposals come from an agent that approves everything but large orders, and also proposes for
# customers as if they were orders beyond the book.
_PROPOSALS = """proposals AS (SELECT o_orderkey AS order_id, CASE WHEN o_totalprice > 400000 THEN 'deny' ELSE 'approve' END AS proposed_action FROM orders
  UNION ALL SELECT -1 - c_custkey, 'approve' FROM customer)"""


def _proposals(spark, root):
    orders = table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.when(F.col("o_totalprice") > 400000, "deny").otherwise("approve").alias("proposed_action"),
    )
    strangers = table(spark, root, "customer").select((-1 - F.col("c_custkey")).alias("order_id"), F.lit("approve").alias("proposed_action"))
    return orders.unionByName(strangers).withColumn("proposed_reason", F.lit("agent"))


@query(
    "refund_overrides",
    f"""WITH {_REFUND}, {_PROPOSALS} SELECT d.decision, p.proposed_action, d.action, p.proposed_action <> d.action AS overridden, count(*)::BIGINT AS orders
FROM decided d JOIN proposals p USING (order_id) GROUP BY ALL""",
)
def refund_overrides(spark, root):
    both = refund.overrides(_decided(spark, root), _proposals(spark, root))
    return both.groupBy("decision", "proposed_action", "action", "overridden").agg(F.count(F.lit(1)).alias("orders"))


@query("refund_orphans", f"WITH {_REFUND}, {_PROPOSALS} SELECT order_id FROM proposals WHERE order_id NOT IN (SELECT order_id FROM decided)")
def refund_orphans(spark, root):
    return refund.orphan_proposals(_decided(spark, root), _proposals(spark, root)).select("order_id")


# The claimed artifact approves whatever was proposed, and forgets orders that never shipped.
_ARTIFACT = """artifact AS (SELECT d.order_id, CASE WHEN d.o_totalprice > 300000 THEN 'pass' ELSE d.decision END AS decision,
  CASE WHEN d.o_totalprice > 300000 THEN 'approve' ELSE d.action END AS action FROM decided d WHERE d.paid
  UNION ALL SELECT -1 - c_custkey, 'pass', 'approve' FROM customer WHERE c_acctbal < 0)"""


def _artifact(spark, root, decided):
    large = F.col("o_totalprice") > 300000
    claimed = decided.filter("days_since_delivery is not null").select(
        "order_id", F.when(large, "pass").otherwise(F.col("decision")).alias("decision"),
        F.when(large, "approve").otherwise(F.col("action")).alias("action"),
        F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("decision")) for c in refund.REFUND_CHECKS]).alias("checks"),
        "failed_checks", "unverified_checks",
    )
    return claimed


@query(
    "refund_reconcile",
    f"""WITH {_REFUND}, {_ARTIFACT}, j AS (SELECT coalesce(a.order_id, d.order_id) AS order_id, a.order_id AS ak, d.order_id AS dk, a.decision AS ad, d.decision AS dd, a.action AS aa, d.action AS da
  FROM artifact a FULL OUTER JOIN decided d ON a.order_id = d.order_id)
SELECT violation, count(*)::BIGINT AS orders FROM (
  SELECT 'unknown_order' AS violation FROM j WHERE dk IS NULL UNION ALL SELECT 'missing_decision' FROM j WHERE ak IS NULL
  UNION ALL SELECT 'decision_mismatch' FROM j WHERE ad <> dd UNION ALL SELECT 'action_mismatch' FROM j WHERE aa <> da) GROUP BY violation""",
)
def refund_reconcile(spark, root):
    """Claimed decisions against recomputed ones, both directions."""
    decided = _decided(spark, root)
    strangers = table(spark, root, "customer").filter("c_acctbal < 0").select(
        (-1 - F.col("c_custkey")).alias("order_id"), F.lit("pass").alias("decision"), F.lit("approve").alias("action")
    )
    claimed = _artifact(spark, root, decided).select("order_id", "decision", "action").unionByName(strangers)
    return refund.reconcile(claimed, decided).groupBy("violation").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "refund_violations",
    f"""WITH {_REFUND}, r AS (SELECT order_id % 23 AS m, decision AS truth, CASE WHEN o_totalprice > 300000 THEN 'pass' ELSE decision END AS claimed,
  c1 = 3 OR c2 = 3 AS any_fail, c1 = 2 OR c2 = 2 OR c3 = 2 OR c4 = 2 AS any_open FROM decided WHERE paid),
v AS (SELECT 'unknown_decision' AS violation FROM r WHERE m = 0
  UNION ALL SELECT 'unknown_action' FROM r WHERE m = 7
  UNION ALL SELECT 'missing_checks' FROM r WHERE m IN (1, 9)
  UNION ALL SELECT 'unknown_check_decision' FROM r WHERE m = 9
  UNION ALL SELECT 'unknown_check' FROM r WHERE m = 8
  UNION ALL SELECT 'duplicate_checks' FROM r WHERE m = 3
  UNION ALL SELECT 'contradicts_checks' FROM r WHERE m NOT IN (0, 1, 7, 9) AND claimed <> truth
  UNION ALL SELECT 'failed_checks_mismatch' FROM r WHERE m = 4 AND any_fail
  UNION ALL SELECT 'unverified_checks_mismatch' FROM r WHERE m = 10 AND any_open
  UNION ALL SELECT 'pass_not_approved' FROM r WHERE m = 6 AND claimed = 'pass'
  UNION ALL SELECT 'fail_not_denied' FROM r WHERE m = 5 AND claimed = 'fail'
  UNION ALL SELECT 'fail_closed_violated' FROM r WHERE m = 5 AND claimed = 'cannot_verify')
SELECT violation, count(*)::BIGINT AS orders FROM v GROUP BY 1""",
)
def refund_violations(spark, root):
    """Claims at odds with themselves; one order in 23 breaks each rule on purpose."""
    case = F.pmod(F.col("order_id"), F.lit(23))
    check = lambda name, decision: F.struct(F.lit(name).alias("check"), F.lit(decision).alias("decision"))
    none = F.array().cast("array<string>")
    last = refund.REFUND_CHECKS[-1]
    doubtful = F.transform("checks", lambda c: F.when(c["check"] == last, check(last, "perhaps")).otherwise(c))
    broken = _artifact(spark, root, _decided(spark, root)).withColumns({
        "decision": F.when(case == 0, "maybe").otherwise(F.col("decision")),
        "action": F.when(case == 5, "approve").when(case == 6, "deny").when(case == 7, "shrug").otherwise(F.col("action")),
        "checks": F.when(case == 1, F.slice("checks", 1, 0)).when(case == 3, F.concat("checks", F.slice("checks", 1, 1)))
        .when(case == 8, F.concat("checks", F.array(check("mood", "pass")))).when(case == 9, doubtful).otherwise(F.col("checks")),
        "failed_checks": F.when(case == 4, none).otherwise(F.col("failed_checks")),
        "unverified_checks": F.when(case == 10, none).otherwise(F.col("unverified_checks")),
    })
    return refund.artifact_violations(broken).groupBy("violation").agg(F.count(F.lit(1)).alias("orders"))


# -- merge review --------------------------------------------------------------------------------

# An order is a commit; each line touches a file named after its part inside the part's brand.
_COMMITS = "commits AS (SELECT l_orderkey AS commit_no, p_brand AS area, p_brand || '/' || l_partkey::VARCHAR || '.py' AS path FROM lineitem JOIN part ON l_partkey = p_partkey)"


OTHER_AREAS = ("vendor", "generated")


def _commits(spark, root):
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, root, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("commit_no"), F.col("l_orderkey").cast("string").alias("sha"),
        F.concat("p_brand", F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"),
    )


@query(
    "scope_labels",
    f"""WITH {_COMMITS}, c AS (SELECT commit_no, min(area) AS a, max(area) AS b FROM commits GROUP BY 1),
s AS (SELECT commit_no, 'legit' AS kind, 'pass' AS expect FROM c UNION ALL SELECT commit_no, 'scope_extension', 'not_pass' FROM c WHERE a <> b UNION ALL SELECT commit_no, 'foreign_file', 'not_pass' FROM c)
SELECT 'scope-' || kind || '-' || row_number() OVER (PARTITION BY kind ORDER BY commit_no, commit_no::VARCHAR)::VARCHAR || '-' || substr(commit_no::VARCHAR, 1, 8) AS sample_id, kind, expect
FROM s QUALIFY row_number() OVER (PARTITION BY kind ORDER BY commit_no, commit_no::VARCHAR) <= 8""",
)
def scope_labels(spark, root):
    """Scope samples from the change history, eight of each kind."""
    return merge_review.scope_samples(_commits(spark, root), OTHER_AREAS).select("sample_id", "kind", "expect")


@query(
    "scope_rule",
    f"""WITH {_COMMITS}, c AS (SELECT commit_no, min(area) AS a, max(area) AS b FROM commits GROUP BY 1),
s AS (SELECT commit_no, 'legit' AS kind, a <> b AS several FROM c UNION ALL SELECT commit_no, 'scope_extension', true FROM c WHERE a <> b UNION ALL SELECT commit_no, 'foreign_file', true FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY commit_no) AS i FROM s QUALIFY i <= 8)
SELECT kind, CASE WHEN kind = 'legit' THEN 1.0 ELSE 0.0 END::DOUBLE AS rule_probability, count(*)::BIGINT AS samples FROM n GROUP BY ALL""",
)
def scope_rule(spark, root):
    """The free baseline: is every changed file inside the declared areas?"""
    commits = _commits(spark, root)
    samples = merge_review.scope_samples(commits, OTHER_AREAS)
    ruled = merge_review.scope_rule_probability(merge_review.scope_files(samples, commits))
    return samples.join(ruled, "sample_id").groupBy("kind", "rule_probability").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "scope_check",
    f"""WITH {_COMMITS}, t AS (SELECT commit_no AS change_id, count(*) AS changed,
count(*) FILTER (NOT (path LIKE 'Brand#1/%' OR path = 'Brand#2' OR path LIKE 'Brand#2/%' OR regexp_matches(path, '^Brand#1./.*5\\.py$')))::BIGINT AS outside FROM commits GROUP BY 1)
SELECT change_id, changed::BIGINT AS changed, outside, 'NO_UNINTENDED_SCOPE' AS check, CASE WHEN outside > 0 THEN 'fail' ELSE 'pass' END AS decision FROM t""",
)
def scope_check(spark, root):
    changed = _commits(spark, root).select(F.col("commit_no").alias("change_id"), "path")
    return merge_review.check_scope(changed, ["Brand#1/", "Brand#2", "Brand#1?/*5.py"])


_MERGE = """c AS (SELECT o_orderkey AS change_id, o_orderpriority, o_orderstatus, o_totalprice FROM orders),
k AS (SELECT change_id, 'TESTS_PASS' AS chk, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'cannot_verify' ELSE 'fail' END AS decision FROM c
  UNION ALL SELECT change_id, 'ARCHITECTURE_OK', 'pass' FROM c WHERE o_orderpriority <> '1-URGENT'
  UNION ALL SELECT change_id, 'NO_UNINTENDED_SCOPE', 'pass' FROM c UNION ALL SELECT change_id, 'NO_UNINTENDED_SCOPE', 'pass' FROM c WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT change_id, 'LOOKS_FINE', 'pass' FROM c WHERE o_orderpriority = '5-LOW')"""


@query(
    "merge_gate",
    f"""WITH {_MERGE}, n AS (SELECT change_id, chk, count(*) AS n FROM k GROUP BY 1, 2),
t AS (SELECT change_id, count(*)::BIGINT AS checks, count(*) FILTER (chk = 'LOOKS_FINE')::BIGINT AS unknown, count(*) FILTER (chk <> 'LOOKS_FINE' AND decision <> 'pass')::BIGINT AS not_passed,
 (3 - count(DISTINCT chk) FILTER (chk <> 'LOOKS_FINE'))::INTEGER AS missing FROM k GROUP BY 1),
d AS (SELECT change_id, count(*) FILTER (n > 1 AND chk <> 'LOOKS_FINE')::INTEGER AS duplicated FROM n GROUP BY 1)
SELECT change_id, checks, missing, duplicated, unknown, not_passed, CASE WHEN missing + duplicated + unknown + not_passed > 0 OR o_totalprice > 450000 THEN 'fail' ELSE 'pass' END AS decision
FROM t JOIN d USING (change_id) JOIN c USING (change_id)""",
)
def merge_gate(spark, root):
    """Orders as changes: one to five judgements each, merged only if all three required ones pass."""
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("change_id"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    tests = F.when(s == "F", "pass").when(s == "O", "cannot_verify").otherwise("fail")

    def one(name, decision):
        return F.struct(F.lit(name).alias("check"), decision.alias("decision"))

    ok = F.lit("pass")
    judged = F.array_compact(F.array(
        one("TESTS_PASS", tests), F.when(p != "1-URGENT", one("ARCHITECTURE_OK", ok)), one("NO_UNINTENDED_SCOPE", ok),
        F.when(p == "2-HIGH", one("NO_UNINTENDED_SCOPE", ok)), F.when(p == "5-LOW", one("LOOKS_FINE", ok)),
    ))
    checks = orders.select("change_id", F.explode(judged).alias("c")).select("change_id", "c.*")
    reviews = orders.select("change_id", F.when(F.col("o_totalprice") > 450000, "block").otherwise("allow").alias("merge"))
    return merge_review.merge_gate(checks, reviews)


@query(
    "architecture_check",
    """SELECT doc_id AS change_id, 1::BIGINT AS inspected, (regexp_matches(text, '(?m)^The\\b'))::BIGINT AS violations, 'ARCHITECTURE_OK' AS check,
CASE WHEN regexp_matches(text, '(?m)^The\\b') THEN 'fail' ELSE 'pass' END AS decision FROM documents""",
)
def architecture_check(spark, root):
    """Documents as source files: a line starting with a forbidden word breaks the layering rule."""
    files = table(spark, root, "documents").select(
        F.col("doc_id").alias("change_id"), F.concat_ws("/", F.lit("lib"), "source", F.concat("lang", F.lit(".py"))).alias("path"), "text"
    )
    return merge_review.check_architecture(files, [("no The at line start", "lib/*.py", r"^The\b"), ("unused", "other/*.py", "x")])


# -- ledger --------------------------------------------------------------------------------------


@query(
    "ledger_totals",
    f"""WITH {sql.RUNS} SELECT task, count(*)::BIGINT AS runs, count(*) FILTER (status IN ('success', 'degraded'))::BIGINT AS ok, count(*) FILTER (status IN ('failed', 'crashed'))::BIGINT AS failed,
sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(duration_ms)::BIGINT AS duration_ms, sum(human_intervention::BIGINT)::BIGINT AS interventions FROM runs GROUP BY task""",
)
def ledger_totals(spark, root):
    return ledger.totals(inputs.runs(spark, root), ["task"])


@query(
    "ledger_monthly_cost",
    f"""WITH {sql.RUNS} SELECT date_trunc('month', started_at)::DATE::VARCHAR AS month, round(coalesce(sum(cost_usd), 0), 4) AS spent, count(*) FILTER (cost_usd IS NULL)::BIGINT AS unknown_cost_runs
FROM runs WHERE NOT dry_run GROUP BY 1""",
)
def ledger_monthly_cost(spark, root):
    months = ledger.monthly_cost(inputs.runs(spark, root))
    return months.select(F.to_date("month").cast("string").alias("month"), F.round("spent", 4).alias("spent"), "unknown_cost_runs")


@query(
    "ledger_budget",
    f"""WITH {sql.RUNS} SELECT round(coalesce(sum(cost_usd), 0), 4) AS spent, coalesce(sum(cost_usd), 0) >= 20.0 AS blocked FROM runs
WHERE NOT dry_run AND cost_usd IS NOT NULL AND started_at >= TIMESTAMP '2024-01-01'""",
)
def ledger_budget(spark, root):
    left = ledger.budget_left(inputs.runs(spark, root), F.lit("2024-01-20").cast("timestamp"), 20.0)
    return left.select(F.round("spent", 4).alias("spent"), "blocked")


@query(
    "ledger_latest",
    "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
)
def ledger_latest(spark, root):
    """Current row per key of an append-only table."""
    events = table(spark, root, "events").select("user_id", "event_type", "ts", "event_id")
    return ledger.fold_events(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(
    "ledger_snapshot",
    "SELECT user_id, ts::DATE::VARCHAR AS target_date, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1, 2",
)
def ledger_snapshot(spark, root):
    """The latest event of each user and day, from a snapshot by day: views first, then all others folded in."""
    events = table(spark, root, "events").select("user_id", F.to_date("ts").alias("target_date"), "ts", "event_id", "event_type")
    path = fresh_path(spark, "ledger")
    for part in (F.col("event_type") == "view", F.col("event_type") != "view"):
        store.update(path, events.filter(part), ["user_id"], ["ts", "event_id"])
    held = spark.read.schema(events.schema).parquet(path)
    return held.select("user_id", F.col("target_date").cast("string").alias("target_date"), "event_id", "event_type")


@query(
    "ledger_tail",
    "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
)
def ledger_tail(spark, root):
    """As ledger_latest, with the newest day's events not yet folded into the snapshot."""
    events = table(spark, root, "events").select("user_id", "event_type", "ts", "event_id")
    newest = events.agg(F.max(F.to_date("ts"))).scalar()
    order, keys = ["ts", "event_id"], ["user_id", "event_type"]
    snapshot = materialise(ledger.fold_events(events.filter(F.to_date("ts") < newest), keys, order), "snapshot")
    held = store.current(snapshot, events.filter(F.to_date("ts") >= newest), keys, order)
    return held.select("user_id", "event_type", "event_id")


@query(
    "ledger_run_fields",
    """SELECT event_id AS run_id, ts::DATE::VARCHAR AS target_date, json_extract(props, '$.k')::BIGINT AS k, json_type(props, '$.k') = 'UBIGINT' AS whole FROM events
WHERE event_type = 'purchase' AND ts::DATE >= (SELECT max(ts::DATE) - 6 FROM events)""",
)
def ledger_run_fields(spark, root):
    """Failed runs of the newest week with their decoded fields, looked up in a ledger stored by day."""
    events = table(spark, root, "events")
    runs = events.select(F.col("event_id").alias("run_id"), F.to_date("ts").alias("target_date"), F.col("props").alias("inputs_json"))
    stored = materialise(store.decoded(runs, {"inputs_json": "inputs"}), "ledger", partition_by="target_date")
    first = events.agg(F.date_sub(F.max(F.to_date("ts")), 6)).scalar()
    failed = events.filter((F.col("event_type") == "purchase") & (F.to_date("ts") >= first))
    found = store.get_runs(stored, failed.select(F.col("event_id").alias("run_id"), F.to_date("ts").alias("target_date")))
    k = F.try_variant_get("inputs", "$.k", "long")
    return found.select("run_id", F.col("target_date").cast("string").alias("target_date"), k.alias("k"), (F.schema_of_variant(F.try_variant_get("inputs", "$.k", "variant")) == "BIGINT").alias("whole"))


@query(
    "ledger_find_done",
    f"""WITH {sql.RUNS} SELECT task, target_date::VARCHAR AS target_date, arg_max(run_id, (finished_at, run_id)) AS run_id FROM runs
WHERE status IN ('success', 'degraded') AND NOT dry_run GROUP BY 1, 2""",
)
def ledger_find_done(spark, root):
    done = ledger.find_done(inputs.runs(spark, root))
    return done.select("task", F.col("target_date").cast("string").alias("target_date"), "run_id")


@query(
    "ledger_runs_page",
    f"WITH {sql.RUNS} SELECT run_id, task, status FROM runs WHERE starts_with(experiment, 'exp-p') ORDER BY started_at DESC, run_id DESC LIMIT 20",
)
def ledger_runs_page(spark, root):
    return ledger.list_runs(inputs.runs(spark, root), 20, experiment_prefix="exp-p").select("run_id", "task", "status")


@query(
    "ledger_idempotent",
    f"""WITH {sql.RUNS} SELECT task, target_date::VARCHAR AS target_date, arg_min(run_id, (started_at, run_id)) AS run_id, count(*)::BIGINT - 1 AS rejected FROM runs
WHERE status IN ('success', 'degraded') AND NOT dry_run GROUP BY 1, 2""",
)
def ledger_idempotent(spark, root):
    """The one run per task and date that may be written, and how many later ones may not."""
    runs = inputs.runs(spark, root)
    accepted = ledger.accept_once(runs)
    repeated = ledger.duplicate_done(runs).withColumnRenamed("runs", "n")
    return accepted.join(repeated, ["task", "target_date"], "left").select(
        "task", F.col("target_date").cast("string").alias("target_date"), "run_id", (F.coalesce("n", F.lit(1)) - 1).alias("rejected")
    )


@query(
    "ledger_mark_stale",
    f"""WITH {sql.RUNS} SELECT run_id, 'crashed' AS status, 'stale_process' AS failure_class FROM runs WHERE status = 'running'
AND pid NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def ledger_mark_stale(spark, root):
    """Running runs whose process is not alive; customers in credit stand for live processes."""
    live = table(spark, root, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("pid"))
    return ledger.mark_stale(inputs.runs(spark, root), live).select("run_id", "status", "failure_class")


@query(
    "ledger_superseded",
    f"""WITH {sql.RUNS}, d AS (SELECT task, target_date, arg_max(run_id, (finished_at, run_id)) AS keep FROM runs WHERE status IN ('success', 'degraded') AND NOT dry_run GROUP BY 1, 2)
SELECT r.run_id, 'superseded' AS status, 'superseded: by ' || keep::VARCHAR AS notes FROM runs r JOIN d ON r.task = d.task AND r.target_date = d.target_date
WHERE r.status IN ('success', 'degraded') AND NOT dry_run AND r.run_id <> keep""",
)
def ledger_superseded(spark, root):
    """Earlier finished runs retired by the one that stands for their task and date."""
    runs = inputs.runs(spark, root).withColumn("notes", F.lit(None).cast("string"))
    keep = ledger.find_done(runs).select("task", "target_date", F.col("run_id").alias("keep"))
    old = runs.filter(F.col("status").isin(*ledger.DONE) & ~F.col("dry_run")).join(keep, ["task", "target_date"]).filter("run_id <> keep")
    retired = old.select("run_id", F.concat(F.lit("by "), F.col("keep").cast("string")).alias("reason"))
    return ledger.supersede(runs, retired).select("run_id", "status", "notes")


@query("ledger_tool_calls", "SELECT l_orderkey AS run_id, count(*)::BIGINT AS tool_calls FROM lineitem GROUP BY 1")
def ledger_tool_calls(spark, root):
    return ledger.tool_call_counts(table(spark, root, "lineitem").select(F.col("l_orderkey").alias("run_id")))


@query(
    "ledger_metric_merge",
    """WITH m AS (SELECT user_id AS run_id, event_id AS seq, 'tokens_in' AS name, (props->>'$.k')::DOUBLE AS value FROM events
UNION ALL SELECT user_id, event_id, 'items', (props->>'$.k')::DOUBLE FROM events)
SELECT run_id, name, CASE WHEN name = 'tokens_in' THEN sum(value) ELSE arg_max(value, seq) END AS value FROM m GROUP BY 1, 2""",
)
def ledger_metric_merge(spark, root):
    """Tokens add up over the steps of a run; any other metric keeps its last value."""
    k = F.get_json_object("props", "$.k").cast("double")
    names = F.explode(F.array(F.lit("tokens_in"), F.lit("items"))).alias("name")
    rows = table(spark, root, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), k.alias("value"), names)
    return ledger.merge_metrics(rows)


@query(
    "ledger_usage",
    f"""WITH {sql.RUNS} SELECT status, count(*)::BIGINT AS calls, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 4) AS cost_usd,
count(*) FILTER (cost_usd IS NULL)::BIGINT AS abstentions FROM runs GROUP BY status""",
)
def ledger_usage(spark, root):
    """Judge usage by status; a group without any known cost keeps an unknown one."""
    calls = inputs.runs(spark, root).withColumn("probability", F.col("cost_usd"))
    return ledger.usage(calls, ["status"]).withColumn("cost_usd", F.round("cost_usd", 4))


@query(
    "ledger_integrity",
    """SELECT 'events' AS "table", count(*)::BIGINT AS rows, 0::BIGINT AS duplicate_keys FROM events
UNION ALL SELECT 'lines', count(*)::BIGINT, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) FROM lineitem""",
)
def ledger_integrity(spark, root):
    return ledger.integrity({
        "events": (table(spark, root, "events"), ["event_id"]),
        "lines": (table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"]),
    })


@query(
    "ledger_run_status",
    """WITH s AS (SELECT user_id AS run_id, max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS a FROM events GROUP BY 1),
g AS (SELECT user_id AS run_id, max(CASE WHEN event_type = 'purchase' AND value >= 300 THEN 2 ELSE 0 END) AS b FROM events GROUP BY 1)
SELECT coalesce(s.run_id, g.run_id) AS run_id, ['success', 'degraded', 'failed'][greatest(coalesce(a, 0), coalesce(b, 0)) + 1] AS status FROM s FULL OUTER JOIN g ON s.run_id = g.run_id""",
)
def ledger_run_status(spark, root):
    """failed > degraded > success over steps and required validations."""
    events = table(spark, root, "events")
    kind = F.col("event_type")
    steps = events.select(
        F.col("user_id").alias("run_id"), F.when(kind == "error", "failed").otherwise("ok").alias("status"), (kind == "click").alias("degraded")
    )
    validations = events.select(F.col("user_id").alias("run_id"), (kind == "purchase").alias("required"), (F.col("value") < 300).alias("ok"))
    return ledger.run_status(steps, validations)


# -- experiments ---------------------------------------------------------------------------------

_ARMS = """points AS (SELECT l_suppkey AS arm, count(*)::BIGINT AS runs, round_even(avg(l_tax * 100), 6) AS cost, round_even(avg(l_discount * 10), 6) AS score FROM lineitem GROUP BY 1)"""


def _arms(spark, root):
    lines = table(spark, root, "lineitem")
    none = F.lit(None)
    runs = lines.select(
        F.col("l_suppkey").alias("arm"), (F.col("l_tax") * 100).alias("cost_usd"), (F.col("l_discount") * 10).alias("verifiable_ratio"),
        none.cast("boolean").alias("validators_ok"), none.cast("long").alias("tokens_in"), none.cast("long").alias("tokens_out"),
        F.col("l_returnflag").alias("status"), F.col("l_linestatus").alias("compose_mode"), F.col("l_shipdate").alias("started_at"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("run_id"),
    )
    return experiment.arm_points(runs)


@query("experiment_points", f"WITH {_ARMS} SELECT * FROM points")
def experiment_points(spark, root):
    """One averaged cost and score per arm; suppliers are the arms and their lines the runs."""
    return _arms(spark, root).select("arm", "runs", "cost", "score")


@query(
    "experiment_pareto",
    f"""WITH {_ARMS} SELECT arm, cost, score, NOT EXISTS (SELECT 1 FROM points o WHERE o.cost <= p.cost AND o.score >= p.score AND (o.cost < p.cost OR o.score > p.score)) AS pareto_optimal FROM points p""",
)
def experiment_pareto(spark, root):
    return experiment.pareto(_arms(spark, root)).select("arm", "cost", "score", "pareto_optimal")


@query(
    "experiment_arm_runs",
    f"""WITH {sql.RUNS} SELECT run_id, task, tokens_in > 20 AS validators_ok, 1.0::DOUBLE AS verifiable_ratio FROM runs WHERE starts_with(experiment, 'exp-s')""",
)
def experiment_arm_runs(spark, root):
    """All runs of an experiment with the outcome of their required gates."""
    runs = inputs.runs(spark, root)
    gates_of = runs.select("run_id", F.lit("verifiable").alias("name"), (F.col("tokens_in") > 20).alias("ok"), F.lit(True).alias("required"), F.lit(1.0).alias("verifiable_ratio"))
    return experiment.arm_runs(runs, gates_of, "exp-s").select("run_id", "task", "validators_ok", "verifiable_ratio")


@query(
    "token_costs",
    f"""WITH {sql.RUNS} SELECT run_id, round_even(tokens_in / 1e6 * 0.30 + tokens_out / 1e6 * 1.20, 6) AS cost,
round_even(tokens_in / 1e6 * 0.30 + tokens_out / 1e6 * 1.20, 6) > 0.0001 AS over FROM runs""",
)
def token_costs(spark, root):
    """Model cost per run at fixed prices, and whether one run passes its own ceiling."""
    cost = parsing.token_cost(F.col("tokens_in"), F.col("tokens_out"), 0.30, 1.20)
    return inputs.runs(spark, root).select("run_id", cost.alias("cost")).withColumn("over", parsing.over_budget(F.col("cost"), 0.0001))


# -- memory search -------------------------------------------------------------------------------


def _entries(spark, root):
    docs = table(spark, root, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("kind"), F.col("source").alias("task"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("date"), F.substring_index("text", "\n", 1).alias("title"),
        F.lit("").alias("tags"), F.col("text").alias("body"),
    )


@query(
    "memory_like",
    "SELECT doc_id::VARCHAR AS path FROM documents WHERE text ILIKE '%the thou%'",
)
def memory_like(spark, root):
    return search.like(_entries(spark, root), "The Thou", "path", ["title", "body"]).select("path")


_BM25 = """b AS (SELECT doc_id::VARCHAR AS path, lang, regexp_extract_all(lower(split_part(text, chr(10), 1) || ' ' || text), '[\\p{L}\\p{N}]+') AS w FROM documents),
c AS (SELECT path, lang, len(w) AS dl, len(list_filter(w, lambda x: x = 'thou')) AS t0, len(list_filter(w, lambda x: x = 'ereaen')) AS t1 FROM b),
s AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
r AS (SELECT path, lang, round_even(greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, s WHERE t0 + t1 > 0)"""


_SNIPPET = r"""top AS (SELECT path, score FROM r ORDER BY score DESC, path LIMIT 20),
p AS (SELECT path, score, regexp_extract_all(text, '\S+') AS parts FROM top JOIN documents ON doc_id::VARCHAR = path),
h AS (SELECT path, i, list_position(['thou', 'ereaen'], regexp_replace(lower(parts[i]), '^[^\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+$', '', 'g')) AS term
  FROM (SELECT path, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
last AS (SELECT e.path, e.i AS ends, x.term, max(x.i) AS place FROM h e JOIN h x ON x.path = e.path AND x.term IS NOT NULL AND x.i <= e.i AND x.i > e.i - 12 WHERE e.term IS NOT NULL GROUP BY ALL),
w AS (SELECT path, arg_max(start, (n, -ends)) AS start FROM (SELECT path, ends, count(*) AS n, min(place) AS start FROM last GROUP BY path, ends) GROUP BY path)"""


@query(
    "memory_bm25",
    rf"""WITH {_BM25}, {_SNIPPET} SELECT path, score, array_to_string(list_transform(range(coalesce(start, 1), least(coalesce(start, 1) + 12, len(parts) + 1)), lambda i:
  CASE WHEN list_contains(['thou', 'ereaen'], regexp_replace(lower(parts[i]), '^[^\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_]+$', '', 'g')) THEN '[' || parts[i] || ']' ELSE parts[i] END), ' ') AS excerpt
FROM p LEFT JOIN w USING (path)""",
)
def memory_bm25(spark, root):
    """The twenty best entries with the twelve words that hold most terms."""
    return search.search(_entries(spark, root), "thou ereaen", 20).select("path", "score", "excerpt")


@query("memory_scores", f"WITH {_BM25} SELECT path, score FROM r")
def memory_scores(spark, root):
    """Scores of every entry that holds a term."""
    return search.ranked(_entries(spark, root), ["thou", "ereaen"], "path", F.concat_ws(" ", "title", "body"))


@query("memory_kinds", "SELECT lang AS kind, count(*)::BIGINT AS entries FROM documents GROUP BY lang")
def memory_kinds(spark, root):
    return search.kinds(_entries(spark, root))


@query(
    "memory_recent",
    "SELECT doc_id::VARCHAR AS path FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 5",
)
def memory_recent(spark, root):
    return search.recent(_entries(spark, root), "en", 5).select("path")


@query(
    "memory_fallback",
    "SELECT doc_id::VARCHAR AS path, substr(text, 1, 400) AS excerpt FROM documents WHERE text ILIKE '%ereae%' AND NOT EXISTS (SELECT 1 FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'ereae')) ORDER BY doc_id DESC LIMIT 10",
)
def memory_fallback(spark, root):
    """No entry holds the word itself, so entries that hold it as part of a word are found."""
    return search.search(_entries(spark, root), "ereae", 10).select("path", "excerpt")


# -- composition ---------------------------------------------------------------------------------


@query(
    "compose_roundrobin",
    """WITH t AS (SELECT p_brand AS brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part)
SELECT brand, p_partkey, turn::INTEGER AS turn FROM t ORDER BY turn, brand LIMIT 20""",
)
def compose_roundrobin(spark, root):
    parts = table(spark, root, "part").select(F.col("p_brand").alias("brand"), "p_partkey")
    return ranking.round_robin(parts, 20, "brand", [F.col("p_partkey")])


@query(
    "compose_renumber",
    """WITH f AS (SELECT l_returnflag AS article, l_suppkey AS supplier, min(l_orderkey * 8 + l_linenumber) AS first_place FROM lineitem GROUP BY 1, 2)
SELECT article, supplier, row_number() OVER (PARTITION BY article ORDER BY first_place, supplier)::BIGINT AS global_id FROM f""",
)
def compose_renumber(spark, root):
    """First-seen ids of suppliers per return flag: each flag is a third of the table."""
    lines = table(spark, root, "lineitem")
    first = lines.groupBy(F.col("l_returnflag").alias("article"), F.col("l_suppkey").alias("supplier")).agg(
        F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first_place")
    )
    numbered = ranking.row_numbers(first, ["article"], "first_place", "global_id", ties=("supplier",))
    return numbered.select("article", "supplier", "global_id")


# An order is an article, a return flag a group, a line an item; its supplier is what it cites,
# and suppliers in debt were not captured.
_MERGE_CHUNKS = """l AS (SELECT l_orderkey AS article, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS g, min(l_linenumber) AS item_no, l_partkey, l_suppkey,
  row_number() OVER (PARTITION BY l_orderkey, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END ORDER BY l_partkey, l_suppkey) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag, l_partkey, l_suppkey),
c AS (SELECT l.*, s_suppkey FROM l LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal >= 0),
first AS (SELECT article, s_suppkey, min(g * 1000000 + n) AS place FROM c WHERE s_suppkey IS NOT NULL GROUP BY 1, 2),
ids AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY place) AS global_id FROM first),
turns AS (SELECT *, row_number() OVER (PARTITION BY article, g ORDER BY n) AS turn FROM c WHERE s_suppkey IS NOT NULL),
kept AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY turn, g) AS pick FROM turns QUALIFY pick <= 4),
final AS (SELECT article, s_suppkey, row_number() OVER (PARTITION BY article ORDER BY global_id) AS final_id FROM ids i WHERE EXISTS (SELECT 1 FROM kept k WHERE k.article = i.article AND k.s_suppkey = i.s_suppkey))"""


@query(
    "compose_merge",
    f"""WITH {_MERGE_CHUNKS} SELECT k.article, k.g::INTEGER AS group_no, k.n::INTEGER AS item_no, 'https://supplier.example/' || k.s_suppkey::VARCHAR AS url, f.final_id::BIGINT AS final_id
FROM kept k JOIN final f ON k.article = f.article AND k.s_suppkey = f.s_suppkey""",
)
def compose_merge(spark, root):
    """Items with a verifiable source, capped in turns, with densely renumbered citations."""
    group = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    lines = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("article"), group.alias("group_no"), "l_partkey", "l_suppkey")
    items = materialise(ranking.row_numbers(lines, ["article", "group_no"], "l_partkey", "item_no", ties=("l_suppkey",), distinct=True), "items")
    links = items.select(
        "article", "group_no", "item_no", F.lit(0).alias("link_no"), F.lit(1).alias("local_id"),
        F.concat(F.lit("http://www.supplier.example/"), F.col("l_suppkey").cast("string"), F.lit("/")).alias("url"),
    )
    solvent = table(spark, root, "supplier").filter("s_acctbal >= 0").select(
        F.concat(F.lit("https://supplier.example/"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_suppkey").alias("l_suppkey")
    )
    captured = items.select("article", "item_no", "l_suppkey").join(solvent, "l_suppkey").select("article", F.col("item_no").alias("position"), "url")
    _, cited = compose.merge(items, links, compose.capture_index(captured), cap=4)
    return cited.select("article", "group_no", "item_no", "url", "final_id")
