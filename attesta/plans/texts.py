"""Queries: titles, tokens, duplicates, blank runs, parsed replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import parsing, text
from attesta.operators import dedup, digests
from attesta.plans import inputs
from attesta.plans.registry import query
from attesta.session import materialise, table

# The punctuation of TITLE_PUNCTUATION in RE2 form.
_PUNCT = r"[\s\x{3000}·—–\-:：,，.。;；!！?？''\"“”‘’()（）\[\]【】《》<>/\\|*#`~+=]+"
_FIRST = "split_part(text, chr(10), 1)"
_NORM = f"regexp_replace(lower(trim({_FIRST})), '{_PUNCT}', '', 'g')"
_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'))"


@query(
    "blank_run_max",
    r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE coalesce(list_max(list_transform(
  regexp_extract_all(chr(10) || regexp_replace(text, '\n\z', '') || chr(10), '\n([^\S\n]*\n)+'),
  lambda r: length(regexp_replace(r, '[^\n]', '', 'g')) - 1)), 0) END::INTEGER AS blank_run FROM documents""",
)
def blank_run_max(spark, root):
    """Longest run of blank lines in each whole text."""
    return table(spark, root, "documents").select("doc_id", text.max_blank_run(F.col("text")).alias("blank_run"))


@query(
    "duplicate_values",
    """SELECT md5(text) AS digest, count(*)::BIGINT AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1""",
)
def duplicate_values(spark, root):
    """Texts that occur more than once. Digests travel in the shuffle, not texts."""
    docs = table(spark, root, "documents").select("doc_id", F.md5("text").alias("digest"))
    return docs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query("title_normalise", f"SELECT doc_id, {_NORM} AS title FROM documents")
def title_normalise(spark, root):
    docs = table(spark, root, "documents")
    return docs.select("doc_id", text.normalise_title(text.first_line(F.col("text"))).alias("title"))


@query("title_tokens", f"SELECT doc_id, unnest({_TOKENS.format(_FIRST)}) AS token FROM documents")
def title_tokens(spark, root):
    docs = table(spark, root, "documents")
    return docs.select("doc_id", F.explode(text.tokens(text.first_line(F.col("text")))).alias("token"))


@query("body_token_counts", f"SELECT doc_id, len({_TOKENS.format('text')})::INTEGER AS tokens FROM documents")
def body_token_counts(spark, root):
    return table(spark, root, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("tokens"))


@query(
    "slugs",
    rf"""SELECT doc_id, substr(CASE WHEN s = '' THEN 'entry' ELSE s END, 1, 60) AS slug FROM (
SELECT doc_id, trim(regexp_replace(regexp_replace(trim({_FIRST}), '[^\p{{L}}\p{{M}}\p{{N}}_-]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-') AS s FROM documents)""",
)
def slugs(spark, root):
    docs = table(spark, root, "documents")
    return docs.select("doc_id", text.slugify(text.first_line(F.col("text"))).alias("slug"))


@query(
    "excerpts",
    r"""SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) AS excerpt FROM documents""",
)
def excerpts(spark, root):
    return table(spark, root, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query(
    "depth_signals",
    """SELECT lang, count(*)::BIGINT AS documents,
count(*) FILTER (regexp_matches(lower(text), '通过|采用|实现|机制|because|by |using'))::BIGINT AS with_mechanism,
count(*) FILTER (regexp_matches(lower(text), '限制|不足|仅在|但|however|only|limit'))::BIGINT AS with_limit
FROM documents GROUP BY lang""",
)
def depth_signals(spark, root):
    docs = table(spark, root, "documents").select("lang", "text")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(text.contains_any(F.col("text"), inputs.PROFILE["mechanism"])).alias("with_mechanism"),
        F.count_if(text.contains_any(F.col("text"), inputs.PROFILE["limit"])).alias("with_limit"),
    )


# -- duplicates ----------------------------------------------------------------------------------

_CLASSES = f"""docs AS (
  SELECT source AS article, lang AS section, doc_id, text, {_NORM} AS norm, {_TOKENS.format(_FIRST)} AS tt,
    {_TOKENS.format('text')} AS bt, md5(list_last(string_split(text, chr(10)))) AS link
  FROM documents),
classes AS (
  SELECT article, section, text, norm, tt, bt, link, min(doc_id) AS doc_id, count(*) AS copies
  FROM docs GROUP BY article, section, text, norm, tt, bt, link)"""

_JAC = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))) END)"
_PAIRS = f"""{_CLASSES},
measured AS (
  SELECT a.article, a.doc_id AS rank_a, b.doc_id AS rank_b, a.copies AS copies_a, b.copies AS copies_b,
    a.norm = '' OR b.norm = '' AS untitled, a.norm = b.norm AS same, {_JAC.format('a.tt', 'b.tt')} AS tj,
    {_JAC.format('a.bt', 'b.bt')} AS bj, a.link = b.link AS shared, a.section = b.section AS together
  FROM classes a JOIN classes b ON a.article = b.article AND a.doc_id < b.doc_id),
titled AS (
  SELECT *, CASE WHEN untitled THEN 0.0 WHEN same THEN 0.95 WHEN tj >= 0.8 THEN 0.85 WHEN tj >= 0.65 THEN 0.72
      WHEN tj >= 0.5 THEN 0.62 WHEN tj >= 0.35 THEN 0.5 ELSE 0.2 * tj END::DOUBLE AS t,
    CASE WHEN untitled THEN 0.0 WHEN same THEN 1.0 ELSE tj END::DOUBLE AS overlap FROM measured),
linked AS (
  SELECT *, CASE WHEN shared AND ((together AND overlap >= 0.4) OR (NOT together AND overlap >= 0.75)) THEN greatest(t, 0.9)
      WHEN shared AND t < 0.6 AND overlap >= 0.3 THEN 0.66 ELSE t END::DOUBLE AS s FROM titled),
scored AS (
  SELECT *, CASE WHEN s >= 0.6 THEN s WHEN bj >= 0.6 THEN 0.62 ELSE s END::DOUBLE AS score FROM linked),
pairs AS (
  SELECT article, rank_a, rank_b, copies_a, copies_b, score, CASE WHEN score >= 0.86 THEN 'duplicate' ELSE 'borderline' END AS verdict,
    copies_a * copies_b AS pairs
  FROM scored WHERE score >= 0.6 AND score < 0.95)"""

_DROPPED = """dropped AS (
  SELECT b.article, b.doc_id AS rank, arg_min(a.doc_id, (-p.score, a.doc_id)) AS kept, max(p.score) AS score
  FROM docs b JOIN (
    SELECT x.article, x.doc_id AS a_id, y.doc_id AS b_id, 0.95::DOUBLE AS score FROM docs x JOIN docs y
      ON x.article = y.article AND x.doc_id < y.doc_id AND x.norm = y.norm AND x.norm <> ''
    UNION ALL SELECT article, rank_a, rank_b, score FROM pairs WHERE verdict = 'duplicate') p ON p.article = b.article AND p.b_id = b.doc_id
  JOIN docs a ON a.article = b.article AND a.doc_id = p.a_id
  GROUP BY b.article, b.doc_id)"""


def _dedup(spark, root):
    candidates = inputs.dedup_candidates(spark, root)
    return candidates, *dedup.plan(candidates)


@query(
    "dedup_title_groups",
    f"""WITH {_CLASSES} SELECT article, norm, count(*)::BIGINT AS members, min(doc_id) AS first_rank,
(count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM docs WHERE norm <> '' GROUP BY article, norm HAVING count(*) > 1""",
)
def dedup_title_groups(spark, root):
    """Entries of one article with the same normalised title, as groups and never as pairs."""
    classes = dedup.entry_classes(inputs.dedup_candidates(spark, root))
    return dedup.title_groups(classes).select("article", "norm", "members", "first_rank", "pairs")


@query(
    "dedup_pairs",
    f"""WITH {_PAIRS} SELECT article, rank_a, rank_b, copies_a::BIGINT AS copies_a, copies_b::BIGINT AS copies_b, score, verdict, pairs::BIGINT AS pairs FROM pairs""",
)
def dedup_pairs(spark, root):
    """Pairs of distinct entries at or above the grey line; one row stands for all their copies."""
    _, _, pairs = _dedup(spark, root)
    return pairs.select("article", "rank_a", "rank_b", "copies_a", "copies_b", "score", "verdict", "pairs")


@query("dedup_resolve", f"WITH {_PAIRS}, {_DROPPED} SELECT article, rank, kept, score FROM dropped")
def dedup_resolve(spark, root):
    """Every entry dropped as a duplicate, with the entry kept for it."""
    dropped = dedup.resolve(*_dedup(spark, root))
    return dropped.select("article", "rank", F.col("kept").cast("long").alias("kept"), "score")


@query(
    "dedup_unjudged",
    f"""WITH {_PAIRS}, {_DROPPED} SELECT article, rank_a, rank_b, score FROM pairs p WHERE verdict = 'borderline'
AND NOT EXISTS (SELECT 1 FROM dropped d WHERE d.article = p.article AND d.rank = p.rank_b)""",
)
def dedup_unjudged(spark, root):
    """Grey pairs left to a judge: their later entry was not dropped."""
    candidates, classes, pairs = _dedup(spark, root)
    dropped = dedup.resolve(candidates, classes, pairs)
    return dedup.unjudged(pairs, dropped).select("article", "rank_a", "rank_b", "score")


@query(
    "dedup_judged",
    """WITH RECURSIVE p AS (
  SELECT article, rank_a, rank_b, score, same, row_number() OVER (PARTITION BY article ORDER BY score DESC, rank_a, rank_b) AS pos FROM (
    SELECT l_suppkey AS article, l_linenumber AS rank_a, l_linenumber + 1 + l_partkey % 7 AS rank_b, max(60 + l_quantity::BIGINT % 25)::BIGINT AS score,
      CASE max(l_returnflag) WHEN 'R' THEN true WHEN 'N' THEN false END AS same FROM lineitem GROUP BY ALL)),
f AS (
  SELECT DISTINCT article, 0::BIGINT AS pos, 0 AS calls, []::BIGINT[] AS gone, 0::BIGINT AS rank_a, 0::BIGINT AS rank_b, 0::BIGINT AS score, 0 AS call, '' AS outcome FROM p
  UNION ALL
  SELECT article, pos, calls + asked, CASE WHEN asked = 1 AND same THEN list_append(gone, rank_b) ELSE gone END, rank_a, rank_b, score,
    CASE WHEN asked = 1 THEN calls + 1 END,
    CASE WHEN skipped THEN 'skipped' WHEN asked = 0 OR same IS NULL THEN 'unjudged' WHEN same THEN 'dropped' ELSE 'distinct' END FROM (
    SELECT p.article, p.pos, f.calls, f.gone, p.rank_a::BIGINT AS rank_a, p.rank_b::BIGINT AS rank_b, p.score, p.same, list_contains(f.gone, p.rank_b::BIGINT) AS skipped,
      (NOT list_contains(f.gone, p.rank_b::BIGINT) AND f.calls < 8)::INT AS asked FROM f JOIN p ON p.article = f.article AND p.pos = f.pos + 1))
SELECT article, rank_a, rank_b, score, call::INTEGER AS call, outcome FROM f WHERE pos > 0""",
)
def dedup_judged(spark, root):
    """Order lines of a supplier as grey pairs, their return flags as a judge's answers: what eight calls settle."""
    lines = table(spark, root, "lineitem")
    key = [F.col("l_suppkey").alias("article"), F.col("l_linenumber").cast("long").alias("rank_a"), (F.col("l_linenumber") + 1 + F.col("l_partkey") % 7).cast("long").alias("rank_b")]
    pairs = lines.groupBy(*key).agg(F.max(60 + F.col("l_quantity").cast("long") % 25).alias("score"), F.max("l_returnflag").alias("flag"))
    answers = pairs.select("article", "rank_a", "rank_b", F.when(F.col("flag") == "R", True).when(F.col("flag") == "N", False).alias("same"))
    judged = dedup.judged_pairs(pairs, answers)
    return judged.select("article", "rank_a", "rank_b", "score", "call", "outcome")


@query(
    "dedup_gate",
    f"""WITH {_PAIRS}, {_DROPPED},
same AS (SELECT article, sum(n * (n - 1) // 2) AS pairs FROM (SELECT article, norm, count(*) AS n FROM docs WHERE norm <> '' GROUP BY ALL) GROUP BY article),
untitled AS (SELECT article, sum(copies * (copies - 1) // 2) AS pairs FROM classes WHERE norm = '' AND len(bt) > 0 GROUP BY article),
agg AS (SELECT article, sum(pairs) FILTER (verdict = 'duplicate') AS dup, sum(pairs) FILTER (verdict = 'borderline') AS grey, max(score) AS top FROM pairs GROUP BY article),
gone AS (SELECT article, count(*) AS n FROM dropped GROUP BY article),
joined AS (SELECT i.article, i.items, coalesce(s.pairs, 0) AS same_pairs, coalesce(a.dup, 0) AS dup, coalesce(a.grey, 0) + coalesce(u.pairs, 0) AS grey,
  coalesce(u.pairs, 0) AS alone, coalesce(a.top, 0) AS top, coalesce(g.n, 0) AS dropped
  FROM (SELECT article, count(*) AS items FROM docs GROUP BY article) i LEFT JOIN same s USING (article) LEFT JOIN untitled u USING (article)
  LEFT JOIN agg a USING (article) LEFT JOIN gone g USING (article))
SELECT article, items::BIGINT AS items, (same_pairs + dup)::BIGINT AS duplicate_pairs, grey::BIGINT AS borderline_pairs,
  CASE WHEN same_pairs > 0 THEN 0.95 ELSE greatest(top, CASE WHEN alone > 0 THEN 0.62 ELSE 0 END) END::DOUBLE AS max_pair_score,
  dropped::BIGINT AS dropped, CASE WHEN dropped > 0 THEN 'fail' ELSE 'pass' END AS decision FROM joined""",
)
def dedup_gate(spark, root):
    candidates, classes, pairs = _dedup(spark, root)
    dropped = dedup.resolve(candidates, classes, pairs)
    return dedup.duplicate_gate(candidates, classes, pairs, dropped)


# -- digests -------------------------------------------------------------------------------------


def _tree_sql(name: str, source: str) -> str:
    return f"""{name}_h AS (SELECT sha256(lang || '|' || text) AS h, count(*) AS n FROM {source} GROUP BY 1),
{name}2 AS (SELECT h[1:2] AS node, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS digest, sum(n)::BIGINT AS lines FROM {name}_h GROUP BY 1),
{name}1 AS (SELECT node[1:1] AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest, sum(lines)::BIGINT AS lines FROM {name}2 GROUP BY 1),
{name}0 AS (SELECT '' AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest, sum(lines)::BIGINT AS lines FROM {name}1 GROUP BY 1)"""


def _line() -> Column:
    return F.concat("lang", F.lit("|"), "text")


@query(
    "corpus_digest_tree",
    f"WITH {_tree_sql('t', 'documents')} " + " UNION ALL ".join(f"SELECT {k} AS level, node, digest, lines FROM t{k}" for k in range(3)),
)
def corpus_digest_tree(spark, root):
    """Digests of all documents, in leaves by key range and up to the root."""
    return digests.digest_tree(table(spark, root, "documents"), _line())


@query(
    "corpus_changed_leaves",
    f"""WITH changed AS (SELECT lang, CASE WHEN n_chars > 20000 THEN text || '.' ELSE text END AS text FROM documents WHERE n_chars >= 30),
{_tree_sql('a', 'documents')}, {_tree_sql('b', 'changed')}
SELECT node, coalesce(a.lines, 0)::BIGINT AS lines_before, coalesce(b.lines, 0)::BIGINT AS lines_now FROM a2 a FULL JOIN b2 b USING (node) WHERE a.digest IS DISTINCT FROM b.digest""",
)
def corpus_changed_leaves(spark, root):
    """Where the documents differ from an edition in which very long ones are changed and very short ones are gone."""
    docs = table(spark, root, "documents")
    text = F.when(F.col("n_chars") > 20_000, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    edition = docs.filter("n_chars >= 30").withColumn("text", text)
    trees = [materialise(digests.digest_tree(part, _line()), "tree") for part in (docs, edition)]
    return digests.changed_leaves(*trees)


# -- replies -------------------------------------------------------------------------------------


@query(
    "prob_parse",
    r"""WITH t AS (SELECT doc_id, regexp_extract(text, '(?:^|[^0-9])([0-9]{1,3}(?:\.[0-9]+)?)(?:[^0-9]|$)', 1) AS tok FROM (
  SELECT doc_id, 'p = ' || n_chars::VARCHAR || ' of ' || (n_chars % 101)::VARCHAR || '.' AS text FROM documents
  UNION ALL SELECT doc_id + 1000000000, '0.' || n_chars::VARCHAR FROM documents UNION ALL SELECT doc_id + 2000000000, text FROM documents))
SELECT doc_id, CASE WHEN tok = '' THEN NULL WHEN instr(tok, '.') > 0 THEN CASE WHEN tok::DOUBLE BETWEEN 0 AND 1 THEN round_even(tok::DOUBLE, 4) END
  WHEN tok::DOUBLE BETWEEN 0 AND 100 THEN round_even(tok::DOUBLE / 100, 4) END AS probability FROM t""",
)
def prob_parse(spark, root):
    """Three replies of each document: its length in words, as a fraction, and its whole text."""
    docs = table(spark, root, "documents").select("doc_id", "text", F.col("n_chars").alias("n"))
    wordy = F.concat(F.lit("p = "), F.col("n").cast("string"), F.lit(" of "), (F.col("n") % 101).cast("string"), F.lit("."))
    fraction = F.concat(F.lit("0."), F.col("n").cast("string"))
    replies = docs.select(F.explode(F.array(
        F.struct(F.col("doc_id").alias("doc_id"), wordy.alias("reply")),
        F.struct((F.col("doc_id") + 1_000_000_000).alias("doc_id"), fraction.alias("reply")),
        F.struct((F.col("doc_id") + 2_000_000_000).alias("doc_id"), F.col("text").alias("reply")),
    )).alias("r")).select("r.*")
    return replies.select("doc_id", parsing.parse_probability(F.col("reply")).alias("probability"))


@query(
    "verdict_parse",
    """SELECT event_type, CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'cannot_verify' WHEN 'error' THEN 'fail'
ELSE 'cannot_verify' END AS decision, count(*)::BIGINT AS replies FROM events GROUP BY event_type""",
)
def verdict_parse(spark, root):
    """A free-text reply per event; 'pass' and 'cannot verify' together mean the cautious one."""
    kind = F.col("event_type")
    reply = (
        F.when(kind == "view", "Verdict: pass.").when(kind == "click", "pass? no, CANNOT_VERIFY")
        .when(kind == "error", "I would fail it").otherwise("no answer")
    )
    judged = table(spark, root, "events").select("event_type", parsing.parse_verdict(reply).alias("decision"))
    return judged.groupBy("event_type", "decision").agg(F.count(F.lit(1)).alias("replies"))


@query(
    "json_replies",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""",
)
def json_replies(spark, root):
    """The JSON object inside a fenced, chatty reply around each event's properties."""
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))
    parsed = parsing.extract_json(reply)
    return table(spark, root, "events").select("event_id", F.try_variant_get(parsed, "$.k", "long").alias("k"))


@query(
    "marker_rewrite",
    """SELECT conv_id, turn, 'see [[' || (turn + 10)::VARCHAR || ']] and ' || text AS text FROM conversations""",
)
def marker_rewrite(spark, root):
    """Citation markers around each whole turn: known ones renumbered, unknown ones removed."""
    turn = F.col("turn").cast("string")
    marked = F.concat(F.lit("see [["), turn, F.lit("]] and "), "text", F.lit("[[9999]]"))
    mapping = F.map_from_arrays(F.array(turn), F.array((F.col("turn") + 10).cast("string")))
    return table(spark, root, "conversations").select("conv_id", "turn", parsing.rewrite_markers(marked, mapping).alias("text"))


@query(
    "secret_arguments",
    """SELECT event_type, count(*)::BIGINT AS calls, sum(CASE WHEN (props->>'$.k')::BIGINT < 10 THEN 1 ELSE 2 END)::BIGINT AS kept_arguments FROM events GROUP BY event_type""",
)
def secret_arguments(spark, root):
    """Arguments of each event as a tool call: its properties, and its user under a name that looks like a secret where k < 10."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    name = F.when(k < 10, F.concat(F.col("event_type"), F.lit("_Token"))).otherwise(F.col("event_type"))
    arguments = F.create_map(
        F.lit("path"), "props", name, F.col("user_id").cast("string"), F.lit("AUTHORIZATION"), F.col("event_type"),
    )
    kept = F.size(parsing.drop_secrets(arguments)).cast("long")
    calls = table(spark, root, "events").select("event_type", kept.alias("n"))
    return calls.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("n").alias("kept_arguments"))
