"""Near-duplicate documents by exact Jaccard similarity of word shingles.

Texts meet in MinHash bands. Members of a bucket meet its smallest members first; what that leaves open in
large buckets is settled by an exact prefix join, so every link between texts that share a band is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from attesta.llm.components import components
from attesta.operators import skew
from attesta.session import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 40 bands of 5 values: a pair at similarity 0.8 shares no band once in eight million, a pair at 0.9 never in practice.
BANDS, BAND_ROWS = 40, 5
#: Every member of a bucket meets this many of its smallest members first: all pairs of small buckets, stars of large
#: ones, whose other pairs `rest_pairs` finds.
REPRESENTATIVES = 8
_BLOCK = 256
_MIX = np.random.Generator(np.random.PCG64(42))
_XOR = _MIX.integers(0, 1 << 32, BANDS * BAND_ROWS, dtype=np.uint32)[:, None]
_TIMES = _MIX.integers(0, 1 << 31, BANDS * BAND_ROWS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_FOLD = _MIX.integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct shingles; a shorter text is one shingle, no words are none.

    Words are runs of non-blank characters after A-Z are lower-cased.
    """
    import xxhash

    parts = (raw or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(parts)}
    own = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(own) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(own))):
        out = _mixed(out + own[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash values."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    for low in range(0, len(short), _BLOCK):
        np.minimum(least, ((short[low : low + _BLOCK] ^ _XOR) * _TIMES).min(axis=1), out=least)
    return _mixed((least.astype(np.uint64).reshape(BANDS, BAND_ROWS) * _FOLD).sum(axis=1, dtype=np.uint64))


@pandas_udf(ArrayType(LongType()))
def _bands(raw: pd.Series) -> pd.Series:
    return pd.Series([bands(shingles(x)).view(np.int64) for x in raw])


@pandas_udf(ArrayType(LongType()))
def _shingles(raw: pd.Series) -> pd.Series:
    return pd.Series([shingles(x).view(np.int64) for x in raw])


def buckets(sketches: DataFrame) -> DataFrame:
    """(key, digest) of the bands that at least two digests share; `sketches` has (digest, bands), one row for each text."""
    rows = sketches.select("digest", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low < high").select("key")
    return rows.join(shared, "key")


def candidates(met: DataFrame) -> DataFrame:
    """Pairs (a < b) of each member of a bucket with its `REPRESENTATIVES` smallest digests."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("digest"))
    heads = met.withColumn("place", place).filter(F.col("place") <= REPRESENTATIVES).select("key", F.col("digest").alias("a"))
    return met.withColumnRenamed("digest", "b").join(heads, "key").filter("a < b").select("a", "b").distinct()


def shingle_sets(digests: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(digest, set) of each of these texts. Copies of a text give one set."""
    texts = docs.select(F.xxhash64(text).alias("digest"), F.col(text).cast("binary").alias("raw")).join(digests, "digest").dropDuplicates(["digest"])
    return texts.select("digest", _shingles("raw").alias("set"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose shingle sets have at least this Jaccard similarity, by the whole sets. Two empty sets are alike."""
    both = pairs.join(sets.select("digest", "set").toDF("a", "set_a"), "a").join(sets.select("digest", "set").toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.withColumn("common", common).filter(F.col("common") + 1e-9 >= similarity * either).select("a", "b")


def unsettled(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(digest, root) of the members of buckets that were not paired as a whole and hold more than one group.

    In a bucket with one member more than the representatives all pairs have met, and between members of one
    group a further link changes nothing.
    """
    rooted = materialise(met.join(roots.toDF("digest", "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest")), "rooted")
    size = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    open_keys = size.filter((F.col("n") > REPRESENTATIVES + 1) & (F.col("low") < F.col("high"))).select("key")
    return rooted.join(open_keys, "key", "left_semi").select("digest", "root").distinct()


def _prefix(n: Column, share: float) -> Column:
    """How many of the rarest of `n` shingles hold one of any `share * n` of them."""
    return n - F.ceil(n * F.lit(share) - 1e-9).cast("int") + 1


def rest_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a < b) of different groups that may reach the similarity: none that does is missing. `sets` has (digest, root, set).

    Shingles are ordered by rarity. Two sets of this similarity share one among the first of both, and in
    the smaller set among fewer still, as its overlap with a larger one must be greater; the places of the shared
    shingle bound the overlap. Of the carriers of a shingle those of its largest group meet only those of others,
    so a large group of copies costs as many pairs as strangers stand beside it. Frequent shingles are cut into blocks.
    """
    own = sets.select("digest", "root", F.size("set").alias("n"), F.explode("set").alias("token"))
    counts = materialise(own.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "shingle_counts")
    ranked = skew.attach(own, ["token"], counts, "df").groupBy("digest", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("own"))
    first = F.slice("own", F.lit(1), _prefix(F.col("n"), similarity))
    places = ranked.select("digest", "root", "n", F.posexplode(first).alias("place", "at")).filter("at.df > 1")
    short = F.col("place") < _prefix(F.col("n"), 2 * similarity / (1 + similarity))
    prefixes = materialise(places.select("digest", "root", "n", "place", "at.token", short.alias("short")), "prefixes")

    groups = prefixes.groupBy("token", "root").agg(F.count(F.lit(1)).alias("long"), F.count_if("short").alias("short"))
    tokens = groups.groupBy("token").agg(
        F.sum("long").alias("all_long"), F.sum("short").alias("all_short"), F.max(F.struct("long", "root", "short")).alias("main")
    )
    left = F.col("all_long") - F.col("main.long")
    tokens = materialise(tokens.filter((left > 0) & (F.col("all_short") > 0)), "shingle_groups")
    carriers = materialise(skew.attach(prefixes, ["token"], tokens, "all_long"), "carriers")
    main = F.col("root") == F.col("main.root")
    short_main, short_other = F.col("main.short"), F.col("all_short") - F.col("main.short")

    def meet(shorter: Column, n_shorter: Column, longer: Column, n_longer: Column) -> DataFrame:
        s = skew.blocked(carriers.filter(shorter & F.col("short")), F.col("digest"), n_shorter, n_longer, "s_block", "l_block")
        o = skew.blocked(carriers.filter(longer), F.col("digest"), n_longer, n_shorter, "l_block", "s_block")
        s = s.select("token", "s_block", "l_block", F.col("digest").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"), F.col("place").alias("at_a"))
        o = o.select("token", "s_block", "l_block", F.col("digest").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("place").alias("at_b"))
        overlap = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        needed = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b"))
        fits = (F.col("n_a") <= F.col("n_b")) & (F.col("root_a") != F.col("root_b")) & (overlap + 1e-6 >= needed)
        return s.join(o, ["token", "s_block", "l_block"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    every = F.lit(True)
    found = meet(~main, short_other, every, F.col("all_long")).unionByName(meet(main, short_main, ~main, left))
    return found.distinct()


def linked(classes: DataFrame, docs: DataFrame, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(digest, root) of the texts with a similar one among those that share a band; `classes` has (digest, bands)."""
    met = materialise(buckets(classes), "buckets")
    sets = materialise(shingle_sets(met.select("digest").distinct(), docs, text), "sets")
    roots = materialise(components(verified(candidates(met), sets, similarity)), "roots")
    still = materialise(sets.join(unsettled(met, roots), "digest"), "unsettled")
    if still.isEmpty():
        return roots.toDF("digest", "root")
    more = verified(materialise(rest_pairs(still, similarity), "rest"), still, similarity)
    known = still.select("digest", "root")
    more = more.join(known.toDF("a", "root_a"), "a").join(known.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    # Groups that a further link joins: root of the old group to the new one.
    moved = materialise(components(more), "moved").toDF("old", "new")
    nodes = roots.unionByName(moved.select(F.col("old").alias("node"), F.col("old").alias("root"))).distinct()
    sizes = materialise(nodes.groupBy(F.col("root").alias("old")).agg(F.count(F.lit(1)).alias("n")).join(moved, "old", "left"), "sizes")
    nodes = materialise(nodes.withColumnRenamed("root", "old"), "nodes")
    return skew.attach(nodes, ["old"], sizes, "n").select(F.col("node").alias("digest"), F.coalesce("new", "old").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows with the smallest id of each group of texts linked by similar shingle sets, all columns.

    Equal texts are one class from the start. Null and blank texts are alike. Rows with a null id stay;
    rows that repeat one id and one text stay or go together. Links are those of texts that share a band.
    """
    columns = [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), _bands(docs[text].cast("binary")).alias("bands")]
    sketches = materialise(docs.select(*columns), "sketches")
    per_text = [F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")]
    classes = materialise(sketches.groupBy("digest").agg(*per_text), "classes")
    rooted = materialise(classes.select("digest", "first", "copies").join(linked(classes.select("digest", "bands"), docs, text, similarity), "digest"), "linked")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    moved = skew.attach(rooted, ["root"], least, "n").select("digest", "least")
    firsts = materialise(classes.select("digest", "first", "copies").join(moved, "digest", "left").select("digest", "copies", F.coalesce("least", "first").alias("least")), "firsts")
    found = skew.attach(sketches.select("doc_id", "digest"), ["digest"], firsts, "copies").filter("doc_id <> least")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = (docs[id_col] == gone["gone_id"]) & (F.xxhash64(docs[text]) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti")
