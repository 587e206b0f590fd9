"""The registered queries of this subpackage, each with its checking SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import chat, decontamination, dualtree, fingerprint, language, lines, mixing, pii, preference, reputation, simhash, toxicity, whitening
from attesta.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def held(id_col: str, parts: int, remainder: int) -> Column:
    """Whether a row is held out: CRC-32 of its id as text. A null id is not, and is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == remainder, F.lit(False))


# -- 1: mixing -----------------------------------------------------------------------------------

LEVELS = ["domain", "lang", "source"]
#: Weights of domains, and of languages in every domain; sources share alike.
WEIGHTS = {
    ("web",): 5, ("books",): 3, ("forums",): 2,
    ("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 1, ("web", "es"): 3,
    ("books", "en"): 1, ("books", "de"): 1, ("books", "fr"): 2, ("books", "es"): 4,
}
SHARE, MAX_EPOCHS, MIX_SEED = 0.5, 2, 7


def domain(source: Column) -> Column:
    """A domain for each source, by the number at the end of its name."""
    number = F.coalesce(F.expr("try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as int)"), F.lit(0)) % 3
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forums")), (number + 1).cast("int"))


_TREE = """WITH docs AS (
  SELECT doc_id, (['web', 'books', 'forums'])[coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INTEGER), 0) % 3 + 1] AS domain, lang, source,
    len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tokens FROM documents),
used AS (SELECT * FROM docs WHERE tokens > 0),
d0 AS (SELECT domain, sum(tokens)::HUGEINT * 2 AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS w,
  (SELECT floor(sum(tokens) * 0.5)::HUGEINT FROM docs) AS b FROM used GROUP BY domain),
""" + "".join(
    f"""f{k} AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY {up} ORDER BY cap / w::DOUBLE, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY {up}) - coalesce(sum(w) OVER (PARTITION BY {up} ORDER BY cap / w::DOUBLE, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wleft FROM d{k}),
g{k} AS (SELECT *, cap * wleft <= (b - before) * w AS is_full FROM f{k}),
h{k} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (b - coalesce(sum(cap) FILTER (is_full) OVER (PARTITION BY {up}), 0)) * w // (sum(w) FILTER (NOT is_full) OVER (PARTITION BY {up})) END AS given FROM g{k}),
{then}"""
    for k, up, own, then in (
        (0, "1", "domain", """d1 AS (SELECT domain, lang, sum(tokens)::HUGEINT * 2 AS cap,
  CASE domain || '/' || lang WHEN 'web/en' THEN 6 WHEN 'web/de' THEN 2 WHEN 'web/fr' THEN 1 WHEN 'web/es' THEN 3
    WHEN 'books/en' THEN 1 WHEN 'books/de' THEN 1 WHEN 'books/fr' THEN 2 WHEN 'books/es' THEN 4 ELSE 1 END AS w,
  any_value(h0.given) AS b FROM used JOIN h0 USING (domain) GROUP BY domain, lang),
"""),
        (1, "domain", "domain, lang", """d2 AS (SELECT domain, lang, source, sum(tokens)::HUGEINT * 2 AS cap, 1 AS w, any_value(h1.given) AS b
  FROM used JOIN h1 USING (domain, lang) GROUP BY domain, lang, source),
"""),
        (2, "domain, lang", "domain, lang, source", ""),
    )
)


@query(
    "op1_mixing",
    _TREE + """leaf AS (SELECT domain, lang, source, given // (cap // 2) AS full_epochs, given % (cap // 2) AS rest FROM h2),
placed AS (SELECT u.*, full_epochs, rest, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source
  ORDER BY md5('7:' || full_epochs || ':' || doc_id), doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM used u JOIN leaf USING (domain, lang, source)),
each AS (SELECT *, unnest(range(0, (full_epochs + CASE WHEN so_far < rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM placed)
SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, tokens,
  CASE WHEN epoch = full_epochs THEN least(tokens, rest - so_far) ELSE tokens END::BIGINT AS take FROM each""",
)
def op1_mixing(spark, root):
    """Which documents are read in which epoch, and how many of their tokens."""
    docs = table(spark, root, "documents")
    rows = docs.select("doc_id", domain(F.col("source")).alias("domain"), "lang", "source", mixing.tokens(F.col("text")).alias("tokens"))
    return mixing.select(materialise(rows, "tokens"), LEVELS, WEIGHTS, SHARE, MAX_EPOCHS, MIX_SEED)


# -- 2: fingerprints -----------------------------------------------------------------------------


@query("op2_fingerprints")
def op2_fingerprints(spark, root):
    """Fingerprints of each text, its edited form and their likeness."""
    rows = fingerprint.edited(table(spark, root, "documents"))
    return rows.select(
        "doc_id", "n_chars", sha256(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        "common_start", "common_end",
    )


# -- 3: lines ------------------------------------------------------------------------------------


@query("op3_line_dedup")
def op3_line_dedup(spark, root):
    """Every line, of any length, with its class, links, copies and whether it is the first of them."""
    return lines.line_classes(table(spark, root, "documents"), min_chars=0).drop("digest")


# -- 4: toxicity ---------------------------------------------------------------------------------


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.filter(~held("doc_id", 5, 0)))


@query("op4_toxicity")
def op4_toxicity(spark, root):
    """Toxicity of every whole text, learned from the labels that are not held out."""
    docs = table(spark, root, "documents")
    model = toxicity_model(docs, table(spark, root, "labels"))
    scored = docs.select("doc_id", held("doc_id", 5, 0).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


# -- 5: urls -------------------------------------------------------------------------------------

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query(
    "op5_url_filter",
    r"""WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
outcome AS (SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels),
hosts AS (SELECT host, list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.') AS domain, list_last(string_split(host, '.')) AS suffix,
  count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN outcome USING (page_id) GROUP BY host),
overall AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS m, (coalesce(sum(n), 0) + 2)::DOUBLE AS k FROM hosts),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS prior, any_value(k) AS known FROM hosts, overall GROUP BY suffix),
sw AS (SELECT 1 / least(greatest((sum(n * pow(bad / n::DOUBLE - prior, 2) / (prior * (1 - prior))) - count(*)) / sum(n - 1), 0.001), 0.2) - 1 AS w FROM s WHERE n > 0),
sp AS (SELECT suffix, (e * prior + bad) / (e + n) AS prior, e + n AS known FROM (SELECT *, 1 / (1 / (w + 1) + 1 / (known + 1)) - 1 AS e FROM s, sw)),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(prior) AS prior, any_value(known) AS known FROM hosts JOIN sp USING (suffix) GROUP BY suffix, domain),
dw AS (SELECT 1 / least(greatest((sum(n * pow(bad / n::DOUBLE - prior, 2) / (prior * (1 - prior))) - count(*)) / sum(n - 1), 0.001), 0.2) - 1 AS w FROM d WHERE n > 0),
dp AS (SELECT domain, (e * prior + bad) / (e + n) AS prior, e + n AS known FROM (SELECT *, 1 / (1 / (w + 1) + 1 / (known + 1)) - 1 AS e FROM d, dw)),
h AS (SELECT host, n, bad, prior, known FROM hosts JOIN dp USING (domain)),
hw AS (SELECT 1 / least(greatest((sum(n * pow(bad / n::DOUBLE - prior, 2) / (prior * (1 - prior))) - count(*)) / sum(n - 1), 0.001), 0.2) - 1 AS w FROM h WHERE n > 0),
hp AS (SELECT host, (e * prior + bad) / (e + n) AS rate, e + n AS weight FROM (SELECT *, 1 / (1 / (w + 1) + 1 / (known + 1)) - 1 AS e FROM h, hw)),
b AS (SELECT host, rate, greatest(0, rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1))) AS bound FROM hp),
m AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound > 0.3 THEN 'block' ELSE 'allow' END AS verdict, round(rate, 6) AS rate, round(bound, 6) AS bound FROM m JOIN b USING (host)""",
)
def op5_url_filter(spark, root):
    """A verdict for every page; outcomes are the labels of the same id, bad if of low quality or toxic."""
    labels = table(spark, root, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    judged = reputation.judge(table(spark, root, "pages"), outcomes, RULES)
    return judged.withColumns({c: F.round(c, 6) for c in ("rate", "bound")})


# -- 6: personal data ----------------------------------------------------------------------------


@query("op6_pii")
def op6_pii(spark, root):
    """Personal data of every whole text: counts of plain spans, and all spans."""
    found = pii.personal_data(table(spark, root, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, sha256(joined("base")).alias("base_sha256"), joined("spans").alias("spans"))


# -- 7: decontamination --------------------------------------------------------------------------


@query("op7_decontamination")
def op7_decontamination(spark, root):
    """Words of every document inside benchmark windows, and the items they belong to."""
    found = decontamination.contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))
    hit = decontamination.hits(F.col("starts"), F.col("ends"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


# -- 8: near-duplicates --------------------------------------------------------------------------


@query("op8_simhash")
def op8_simhash(spark, root):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, root, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


# -- 9: chats ------------------------------------------------------------------------------------

_SAYS = "</s>[INST] ok [/INST]"


@query(
    "op9_chat_format",
    r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  3 + sum(length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
    ELSE 16 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) END)::BIGINT AS formatted_chars
    , list_reduce(list_prepend('start', list(role ORDER BY turn, role, text)), lambda s, x: CASE
      WHEN s = 'start' AND x = 'system' THEN 'told' WHEN s IN ('start', 'told', 'answered') AND x = 'user' THEN 'asked'
      WHEN s = 'asked' AND x = 'assistant' THEN 'answered' ELSE 'out of order' END) AS state
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, state, state IN ('asked', 'answered') AS in_order FROM c""",
)
def op9_chat_format(spark, root):
    """Every conversation formatted, what is read back from the output, and where the machine of roles ends."""
    rows = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_SAYS).alias("text"),
    )
    made = chat.format_chats(rows.unionByName(own)).select("conv_id", "state", "in_order", "formatted", chat.parse(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.trained_turns(F.col("turns"))
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(told).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        sha256(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "state", "in_order",
    )


# -- 10: language --------------------------------------------------------------------------------


@query("op10_language")
def op10_language(spark, root):
    """Language of every whole text, learned from documents that are not held out."""
    docs = table(spark, root, "documents")
    learned = language.dictionaries(docs.filter(F.col("doc_id").isNotNull() & ~held("doc_id", 4, 2)))
    found = language.predict(docs, learned)
    return found.select("doc_id", held("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "sure")


# -- 11: quality ---------------------------------------------------------------------------------


@query("op11_quality")
def op11_quality(spark, root):
    """Quality of every whole text, learned from pairs of the labels that are not held out."""
    docs = table(spark, root, "documents")
    ranking = preference.fit(docs, table(spark, root, "labels").filter(~held("doc_id", 5, 0)))
    scored = docs.select("doc_id", held("doc_id", 5, 0).alias("held_out"), preference.score(docs, ranking).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= preference.CUT_SCORE).cast("int"))


# -- 12: ranked search ---------------------------------------------------------------------------


@query(
    "op12_ranked_search",
    r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN len USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored
WHERE score > 0 QUALIFY rank <= 50""",
)
def op12_ranked_search(spark, root):
    """The fifty documents of each benchmark item that score highest."""
    return dualtree.ranked_search(table(spark, root, "documents"), table(spark, root, "benchmark"))


# -- 13: embeddings ------------------------------------------------------------------------------


@query("op13_whitening")
def op13_whitening(spark, root):
    """The four leading components of every usable vector, whitened."""
    return whitening.whiten(table(spark, root, "embeddings"))
