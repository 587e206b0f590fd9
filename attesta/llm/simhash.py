"""Near-duplicate documents by SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from attesta.llm.components import components
from attesta.operators import skew
from attesta.session import materialise

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
_BLOCK = 1 << 15


def simhash(raw: bytes | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint of one text, as an unsigned 64-bit number. No words: zero."""
    import xxhash

    parts = (raw or b"").lower().split()
    if not parts:
        return 0
    total = max(1, len(parts) - words + 1)
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, _BLOCK):
        high = min(total, low + _BLOCK)
        hashes = np.fromiter(
            (digest(b" ".join(parts[i : i + words]), seed) for i in range(low, high)), np.uint64, high - low
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


@pandas_udf(LongType())
def _simhashes(raw: pd.Series) -> pd.Series:
    return pd.Series(np.array([simhash(x) for x in raw], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """SimHash of each whole text as a signed long.

    Words are runs of non-blank characters after A-Z are lower-cased; three-word shingles, repeats
    included (a shorter text is one shingle), hashed with XXH64, seed 42. A bit is set if more than
    half the hashes have it. Null and blank texts: zero.
    """
    return _simhashes(docs[text].cast("binary"))


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bits miss one mask entirely.

    Bit i has a vector m(i) of radius+1 binary digits, and mask v holds the bits with odd <m(i), v>.
    The vectors of any `radius` bits span less than the whole space, so some v is orthogonal to all of
    them: two fingerprints that differ only there agree under that mask.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all pairs of distinct fingerprints at up to 2 differing bits.

    Fingerprints that share a covering key form a bucket. A bucket is never expanded into pairs: each
    member stands under itself and under each change of one bit outside the mask. Two members within
    two bits meet under one of these, and all that meet are within two bits of each other; at most
    one member for each free bit and one more can meet, whatever the size of the bucket. Those that
    meet are linked to the smallest of them. No pair within the radius is lost, no other one is linked.
    """
    if radius not in (1, 2):
        raise ValueError("one-bit neighbours settle a radius of 1 or 2")
    masks = covering_masks(radius)
    full = (1 << BITS) - 1
    tables = F.array(*[
        F.struct(F.lit(t).cast("int").alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)
    ])
    rows = prints.select("fp").distinct().select("fp", F.explode(tables).alias("k")).select("fp", "k.table", "k.key")
    shared = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    free = F.array(*[
        F.array(*[F.lit(_signed(1 << i)).cast("long") for i in range(BITS) if (full ^ m) >> i & 1]) for m in masks
    ])
    changes = F.concat(F.array(F.lit(0).cast("long")), F.element_at(free, F.col("table") + 1))
    near = rows.join(shared, ["table", "key"]).select("table", "fp", F.explode(changes).alias("bit"))
    # Changed bits lie outside the mask, so the changed fingerprint still tells the bucket.
    met = near.groupBy("table", F.col("fp").bitwiseXOR(F.col("bit")).alias("near")).agg(F.collect_set("fp").alias("fps"))
    linked = met.filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return linked.filter("a <> b").distinct()


def group(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fp, first): each distinct fingerprint with the smallest id in its component.

    `prints` has (id, fp) for every document. Equal fingerprints are one class from the start, so copies
    are counted, never paired. A null id is smaller than no other: a component of null ids has null.
    """
    own = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "classes")
    roots = materialise(components(near_links(own)), "roots")
    rooted = materialise(own.join(roots.withColumnRenamed("node", "fp"), "fp"), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "least")
    moved = skew.attach(rooted, ["root"], least, "n").select("fp", "least")
    return own.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, fp, component_id) for every row: texts linked through fingerprints 2 bits apart or less.

    Null and blank texts share fingerprint zero and are linked like any other. Repeated rows each come
    back. Only the two columns named are read, so further columns cannot clash. `digest` tells rows
    with one id and different texts apart.
    """
    columns = [F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), fingerprints(docs, text).alias("fp")]
    prints = materialise(docs.select(*columns), "prints")
    return prints.join(group(prints), "fp").select("doc_id", "digest", "fp", F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the smallest id of each component, all columns. Rows with a null id stay.

    Rows that repeat one id and one text stay or go together.
    """
    found = near_duplicates(docs, id_col, text).filter("doc_id <> component_id")
    gone = found.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    same = (docs[id_col] == gone["gone_id"]) & (F.xxhash64(docs[text]) == gone["gone_digest"])
    return docs.join(gone, same, "left_anti")
