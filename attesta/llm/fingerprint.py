"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

#: Two primes below 2^31: products of two residues fit 64 bits.
PRIMES = (2147483647, 2147483629)
#: Odd numbers from the digits of pi and e, reduced below the primes.
BASES = (314159265, 271828183)
WINDOW = 24
BINS = 128
_EMPTY = 0xFFFF
_powers: dict[int, list[np.ndarray]] = {0: [], 1: []}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse; kept for the next text."""
    if not _powers[which] or len(_powers[which][0]) <= n:
        p = PRIMES[which]
        tables = []
        for b in (BASES[which], pow(BASES[which], -1, p)):
            table = np.ones(1, np.uint64)
            while len(table) <= n:
                table = np.concatenate([table, table * np.uint64(pow(b, len(table), p)) % np.uint64(p)])
            tables.append(table)
        _powers[which] = tables
    forward, back = _powers[which]
    return forward[: n + 1], back[: n + 1]


class PrefixHashes:
    """Prefix arrays of one text under both primes: H[i] = sum of (c_j + 1) * B^j over j < i."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        self.sums = []
        for which, p in enumerate(PRIMES):
            forward, _ = _power(which, self.n)
            terms = points * forward[: self.n] % np.uint64(p)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])  # below 2^63 up to 2^32 code points
            self.sums.append(sums % np.uint64(p))

    def spans(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the spans of one length at the given starts; they do not depend on the start."""
        parts = []
        for which, p in enumerate(PRIMES):
            prime, sums = np.uint64(p), self.sums[which]
            _, back = _power(which, self.n)
            difference = (sums[starts + length] + prime - sums[starts]) % prime
            parts.append(difference * back[starts] % prime)
        return parts[0] << np.uint64(31) | parts[1]

    def span(self, start: int, length: int) -> int:
        return int(self.spans(np.array([start]), length)[0])

    def windows(self, length: int) -> np.ndarray:
        return self.spans(np.arange(max(0, self.n - length + 1)), length)


def same_span(a: PrefixHashes, i: int, b: PrefixHashes, j: int, length: int) -> bool:
    return a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHashes, i: int, b: PrefixHashes, j: int) -> int:
    """Length of the longest common extension of a[i:] and b[j:], by binary search over span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_ending(a: PrefixHashes, b: PrefixHashes, most: int) -> int:
    """Length of the longest common suffix, `most` at most."""
    low, high = 0, min(a.n, b.n, most)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, a.n - middle, b, b.n - middle, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ values >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(32)


def sketch(hashes: PrefixHashes, window: int = WINDOW, bins: int = BINS) -> np.ndarray:
    """The smallest 16-bit value in each bin over the hashes of all windows; 0xffff marks an empty bin.

    A text shorter than a window counts as one window of its own length.
    """
    least = np.full(bins, _EMPTY, np.uint16)
    if not hashes.n:
        return least
    mixed = _mix(hashes.windows(min(window, hashes.n)))
    values = np.minimum(mixed >> np.uint64(32) & np.uint64(0xFFFF), np.uint64(_EMPTY - 1)).astype(np.uint16)
    np.minimum.at(least, (mixed % np.uint64(bins)).astype(np.intp), values)
    return least


def compose(hashes: PrefixHashes) -> str:
    """16 hex digits for the length and whole text, then four for each bin of the sketch."""
    whole = int(_mix(np.array([hashes.span(0, hashes.n) ^ hashes.n], np.uint64))[0]) if hashes.n else 0
    return f"{whole:016x}" + sketch(hashes).astype(">u2").tobytes().hex()


def likeness(a: str | None, b: str | None) -> float | None:
    """Share of text two fingerprints have in common: 1 for equal ones, 0 for an empty text against another.

    With the share J of bins that agree, of those that are not empty in both, 2J / (1 + J) is the share of
    windows in common of two texts of equal length.
    """
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(v[16:]), ">u2") for v in (a, b))
    used = (x != _EMPTY) | (y != _EMPTY)
    if not used.any():
        return 0.0
    j = float(((x == y) & used).sum() / used.sum())
    return 2 * j / (1 + j)


def fingerprint(text: str | None) -> str:
    return compose(PrefixHashes(text or ""))


@pandas_udf(StringType())
def fingerprints(text: pd.Series) -> pd.Series:
    """Fingerprint of each whole text; a null text has that of the empty one."""
    return text.map(fingerprint, na_action=None)


@pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")


_EDITS = StructType()
for _name, _type in (("fingerprint", StringType()), ("edited_fingerprint", StringType()), ("near_edited", DoubleType()),
                     ("near_next", DoubleType()), ("common_start", LongType()), ("common_end", LongType())):
    _EDITS.add(_name, _type)


@pandas_udf(_EDITS)
def _edits(text: pd.Series, after: pd.Series) -> pd.DataFrame:
    """What the edited form has for a fingerprint; the form itself is not sent back."""
    rows = []
    for own, follower in zip(text.fillna(""), after.fillna("")):
        cut = len(own) // 4
        edited = own[: len(own) - cut] + follower[:cut]
        a, b = PrefixHashes(own), PrefixHashes(edited)
        print_a, print_b = compose(a), compose(b)
        start = common_extension(a, 0, b, 0)
        rows.append((
            print_a, print_b, likeness(print_a, print_b), likeness(print_a, fingerprint(follower)), start,
            common_ending(a, b, min(a.n, b.n) - start),
        ))
    return pd.DataFrame(rows, columns=_EDITS.names)


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, text, after): each row with the text of the next one by ascending id; after the last: the first.

    Ids are cut into ranges by an approximate percentile, and each range has the first row of the next
    range as a guest, so the text is shuffled once and no window spans the table. Nulls come first,
    rows that repeat an id stand in the order of their texts, and a single row follows itself.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = [i / parts for i in range(1, parts)] or [0.5]
    bounds = sorted(set(narrow.agg(F.percentile_approx("doc_id", marks, 10_000)).first()[0] or []))
    place = F.when(F.col("doc_id").isNull(), -1).otherwise(
        F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    ).cast("int")
    placed = narrow.withColumn("part", place)
    firsts = {r["part"]: r["first"] for r in placed.groupBy("part").agg(F.min("doc_id").alias("first")).collect()}  # a row for each range
    if not firsts:
        return narrow.withColumn("after", F.col("text")).limit(0)
    order = sorted(firsts)
    guests = F.array(*[
        F.struct(F.lit(firsts[p]).cast("long").alias("first"), F.lit(order[i - 1]).cast("int").alias("part")) for i, p in enumerate(order)
    ])
    homes = F.concat(
        F.array(F.struct(F.col("part"), F.lit(0).alias("guest"))),
        F.transform(
            F.filter(guests, lambda g: g["first"].eqNullSafe(F.col("doc_id"))), lambda g: F.struct(g["part"].alias("part"), F.lit(1).alias("guest"))
        ),
    )
    rows = placed.select("doc_id", "text", F.explode(homes).alias("home"))
    window = Window.partitionBy("home.part").orderBy("home.guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return rows.withColumn("after", F.lead("text").over(window)).filter("home.guest = 0").select("doc_id", "text", "after")


def edited(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next text, with their likeness.

    The edit replaces the last quarter by the beginning of the next text. `common_start` and
    `common_end` are the longest common extensions of a text and its edited form from both ends.
    """
    rows = with_next(docs, id_col, text)
    text, after = F.coalesce("text", F.lit("")), F.coalesce("after", F.lit(""))
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    form = F.concat(text.substr(F.lit(1), n - cut), after.substr(F.lit(1), cut))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), form.alias("edited"), _edits("text", "after").alias("e")).select(
        "doc_id", "n_chars", "edited", "e.*"
    )


def similarity(a: Column, b: Column) -> Column:
    return alike(a, b)
