"""Full-text search over memory entries: ranked terms, then substring search if nothing ranks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import materialise

# Fixed ranking constants.
K1 = 1.2
B = 0.75
WORD = r"[\p{L}\p{N}]+"
SNIPPET_WORDS = 12


def query_terms(query: str) -> list[str]:
    """Distinct words of a query in order, lower case."""
    words = []
    for part in query.lower().split():
        for word in re.findall(r"[^\W_]+", part):
            if word not in words:
                words.append(word)
    return words


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _frequency(term: str) -> Column:
    return F.size("w") - F.size(F.array_remove("w", term))


def ranked(entries: DataFrame, terms: list[str], key: str, text: Column) -> DataFrame:
    """(key, score) of entries holding any term; larger is better.

    Term frequencies are counted inside the row for the query's terms only, so no posting list
    is exploded. The counts are a narrow table written once, so texts are split once for both
    the statistics (one row, broadcast) and the hits.
    """
    bag = entries.select(key, words(text).alias("w"))
    counted = materialise(
        bag.select(
            key, F.size("w").alias("dl"), *[_frequency(term).alias(f"tf{i}") for i, term in enumerate(terms)]
        ),
        "terms",
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("docs"),
        F.avg("dl").alias("avgdl"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    )
    any_hit = sum((F.col(f"tf{i}") for i in range(len(terms))), F.lit(0)) > 0
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln((F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.greatest(idf, F.lit(1e-6))
        norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm)
    return counted.filter(any_hit).crossJoin(F.broadcast(stats)).select(key, F.bround(score, 6).alias("score"))


def snippet(text: Column, terms: list[str], width: int = SNIPPET_WORDS) -> Column:
    """The `width` words that hold most distinct terms, the first of equally good ones, with hits in brackets.

    One pass over the hits in order keeps the last place of each term: a window that ends with a hit holds
    the terms whose last place is inside it, and the best window begins at the first of these places.
    """
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))
    bare = F.transform(parts, lambda p: F.regexp_replace(F.lower(p), r"(?U)^\W+|\W+$", ""))
    known = F.array(*[F.lit(t) for t in terms])
    which = F.transform(bare, lambda p: F.array_position(known, p).cast("int"))
    hits = F.filter(F.transform(which, lambda t, i: F.struct(t.alias("term"), (i + 1).alias("place"))), lambda h: h["term"] > 0)

    def step(at: Column, hit: Column) -> Column:
        last = F.transform(at["last"], lambda place, i: F.when(i + 1 == hit["term"], hit["place"]).otherwise(place))
        inside = F.filter(last, lambda place: place > hit["place"] - width)
        better = F.size(inside) > at["found"]
        return F.struct(
            last.alias("last"), F.when(better, F.size(inside)).otherwise(at["found"]).alias("found"),
            F.when(better, F.array_min(inside)).otherwise(at["start"]).alias("start"),
        )

    nowhere = F.array_repeat(F.lit(-width), len(terms))
    start = F.aggregate(hits, F.struct(nowhere.alias("last"), F.lit(0).alias("found"), F.lit(1).alias("start")), step, lambda at: at["start"])
    marked = F.zip_with(parts, which, lambda p, t: F.when(t > 0, F.concat(F.lit("["), p, F.lit("]"))).otherwise(p))
    return F.array_join(F.slice(marked, start, F.lit(width)), " ")


def like(entries: DataFrame, query: str, key: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring search: how unsegmented scripts are found."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.lower(F.coalesce(column, F.lit(""))).contains(query.lower())
    return entries.filter(hit)


def search(entries: DataFrame, query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
    """entries(path, kind, task, date, title, tags, body): the best hits with an excerpt.

    Substring hits are used only when no entry ranks; that test is one broadcast row.
    """
    terms = query_terms(query)
    chosen = entries.filter(F.col("kind") == kind) if kind else entries
    head = ["path", "kind", "task", "date", "title", "tags"]
    fallback = like(chosen, query, "path", ["title", "body"]).select(
        *head, F.substring("body", 1, 400).alias("excerpt"), F.lit(None).cast("double").alias("score")
    )
    if not terms:
        return fallback.orderBy(F.desc("date"), "path").limit(limit)
    # Statistics come from all entries, hits only from the chosen kind.
    scores = ranked(entries, terms, "path", F.concat_ws(" ", "title", "body"))
    if kind:
        scores = scores.join(chosen.select("path"), "path", "left_semi")
    # The best are picked on the narrow scores; bodies are fetched for `limit` rows only.
    top = scores.orderBy(F.desc("score"), "path").limit(limit)
    best = chosen.join(F.broadcast(top), "path").select(*head, snippet(F.col("body"), terms).alias("excerpt"), "score")
    best = best.orderBy(F.desc("score"), "path").limit(limit)
    found = best.agg((F.count(F.lit(1)) > 0).alias("ranked"))
    rest = fallback.orderBy(F.desc("date"), "path").limit(limit).crossJoin(F.broadcast(found)).filter("not ranked").drop("ranked")
    return best.unionByName(rest)


def recent(entries: DataFrame, kind: str, limit: int) -> DataFrame:
    return entries.filter(F.col("kind") == kind).orderBy(F.desc("date"), F.desc("path")).limit(limit)


def kinds(entries: DataFrame) -> DataFrame:
    return entries.groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))
