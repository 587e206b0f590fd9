"""Benchmark phrases in training texts, by a positional inverted index kept in document shards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import materialise

WINDOW_WORDS = 10
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 500_000

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if (b | 0x20 if 0x41 <= b <= 0x5A else b) in _WORD_BYTES else 0x20 for b in range(256))

INDEX_SCHEMA = "part int, number int, ids array<long>, lengths array<int>, terms array<int>, counts array<int>, positions array<int>"
FOUND_SCHEMA = "part int, number int, place int, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words(raw: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of a-z, 0-9 and anything beyond ASCII."""
    return (raw or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Phrases:
    """A block of benchmark windows as term numbers, with the items each window belongs to."""

    vocabulary: dict[bytes, int]
    windows: list[np.ndarray]
    items: list[list[str]]


def phrases(rows: Iterable[tuple[object, bytes | None]], window: int = WINDOW_WORDS) -> Phrases:
    """Windows of consecutive words of each (item id, text); an item of fewer words is one window."""
    vocabulary: dict[bytes, int] = {}
    known: dict[tuple[int, ...], set[str]] = {}
    for item, raw in rows:
        terms = [vocabulary.setdefault(w, len(vocabulary)) for w in words(raw)]
        for i in range(max(1, len(terms) - window + 1) if terms else 0):
            known.setdefault(tuple(terms[i : i + window]), set()).add(str(item))
    return Phrases(vocabulary, [np.array(w, np.int64) for w in known], [sorted(v) for v in known.values()])


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Postings of the given terms, as one row for each shard of whole documents.

    A shard numbers the words of its documents one after the other, with a gap behind each document, and
    lists the ascending places of each term. It holds about `shard_words` words; a longer document is a
    shard of its own. Other terms take up places and need no postings. Null texts have no words.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, terms, places, base, part, number = [], [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            term = np.concatenate(terms) if terms else np.zeros(0, np.int32)
            place = np.concatenate(places) if places else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable")
            distinct, counts = np.unique(term, return_counts=True)
            values = (ids, lengths, distinct.astype(np.int32), counts.astype(np.int32), place[order].astype(np.int32))
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            names = ["part", "number", "ids", "lengths", "terms", "counts", "positions"]
            where = [pa.array([part], pa.int32()), pa.array([number], pa.int32())]
            return pa.RecordBatch.from_arrays(where + [pa.array([v], pa.list_(t)) for v, t in zip(values, types)], names)

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = words(raw.as_py())
                if ids and base + len(parts) > shard_words:
                    yield shard()
                    ids, lengths, terms, places, base, number = [], [], [], [], 0, number + 1
                found = np.fromiter(map(vocabulary.get, parts, repeat(-1)), np.int32, len(parts))
                at = np.flatnonzero(found >= 0)
                ids.append(doc_id)
                lengths.append(len(parts))
                terms.append(found[at])
                places.append(at + base)
                base += len(parts) + 1
        if ids:
            yield shard()

    narrow = docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary"), F.spark_partition_id())
    return narrow.mapInArrow(shards, INDEX_SCHEMA)


class Shard:
    """One row of the index, in the memory of a task."""

    def __init__(self, row: dict, n_terms: int):
        self.ids = row["ids"]
        self.lengths = row["lengths"].to_numpy().astype(np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.positions = row["positions"].to_numpy().astype(np.int64)
        counts = row["counts"].to_numpy().astype(np.int64)
        self.count = np.zeros(n_terms, np.int64)
        self.start = np.zeros(n_terms, np.int64)
        terms = row["terms"].to_numpy().astype(np.int64)
        self.count[terms] = counts
        self.start[terms] = np.cumsum(counts) - counts

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.start[term] : self.start[term] + self.count[term]]

    def exact(self, window: np.ndarray) -> np.ndarray:
        """Places where the window begins: lists moved by their offset, met from the rarest term on."""
        counts = self.count[window]
        if not counts.all():
            return np.zeros(0, np.int64)
        order = np.argsort(counts, kind="stable")
        found = self.postings(window[order[0]]) - order[0]
        for k in order[1:]:
            other = self.postings(window[k]) - k
            at = np.searchsorted(other, found)
            found = found[other[np.minimum(at, len(other) - 1)] == found]
            if not len(found):
                break
        return found

    def near(self, window: np.ndarray, slack: int) -> np.ndarray:
        """Places of the window's rarest term that have every other term within `slack` words, in any order."""
        terms = np.unique(window)
        counts = self.count[terms]
        if not counts.all():
            return np.zeros(0, np.int64)
        order = np.argsort(counts, kind="stable")
        found = self.postings(terms[order[0]])
        doc = np.searchsorted(self.bases, found, side="right") - 1
        low = np.maximum(found - slack, self.bases[doc])
        high = np.minimum(found + slack, self.bases[doc + 1] - 2)
        for k in order[1:]:
            other = self.postings(terms[k])
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, side="right")
            found, low, high = found[keep], low[keep], high[keep]
            if not len(found):
                break
        return found


def search(index: DataFrame, block: Phrases, slack: int | None = None) -> DataFrame:
    """Every document of the index with the word spans that windows of the block cover, and their items.

    With `slack`, proximity matches instead: the place of a window's rarest word, where all its words
    stand within that many words. Spans of a document are merged and ascending. Windows that lack a
    term in a shard are left out for all of them at once.
    """
    n_terms = len(block.vocabulary)
    lengths = np.array([len(w) for w in block.windows], np.int64)
    flat = np.concatenate(block.windows) if block.windows else np.zeros(0, np.int64)
    heads = np.cumsum(lengths) - lengths

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i].values for k in ("ids", "lengths", "terms", "counts", "positions")}
                shard = Shard(row, n_terms)
                starts, sizes, names = [], [], [set() for _ in shard.ids]
                live = np.flatnonzero(np.minimum.reduceat(shard.count[flat], heads)) if len(flat) else []
                for w in live:
                    window = block.windows[w]
                    hits = shard.exact(window) if slack is None else shard.near(window, slack)
                    if len(hits):
                        starts.append(hits)
                        sizes.append(np.full(len(hits), len(window) if slack is None else 1))
                        for d in np.unique(np.searchsorted(shard.bases, hits, side="right") - 1):
                            names[d].update(block.items[w])
                spans: list[list[list[int]]] = [[[], []] for _ in shard.ids]
                if starts:
                    change = np.zeros(shard.bases[-1] + 1, np.int32)
                    all_starts = np.concatenate(starts)
                    np.add.at(change, all_starts, 1)
                    np.add.at(change, all_starts + np.concatenate(sizes), -1)
                    edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
                    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    for s, e in zip(first, last):  # the gap behind a document ends every span
                        d = int(np.searchsorted(shard.bases, s, side="right")) - 1
                        spans[d][0].append(int(s - shard.bases[d]))
                        spans[d][1].append(int(e - shard.bases[d]))
                n = len(shard.ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)),
                        pa.array(np.full(n, batch.column("number")[i].as_py(), np.int32)),
                        pa.array(np.arange(n, dtype=np.int32)), shard.ids, pa.array(shard.lengths), pa.array([s[0] for s in spans], pa.list_(pa.int32())),
                        pa.array([s[1] for s in spans], pa.list_(pa.int32())),
                        pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                    ],
                    ["part", "number", "place", "doc_id", "n_words", "starts", "ends", "items"],
                )

    return index.mapInArrow(found, FOUND_SCHEMA)


def blocks(benchmark: DataFrame, id_col: str, text: str, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about `block_words` words; each is small enough to send to every task."""
    narrow = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text).cast("binary").alias("raw"))
    total = narrow.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = 1 + total // (6 * block_words)
    return [narrow.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b) for b in range(n)] if n > 1 else [narrow]


def collected(block: DataFrame, window: int) -> Phrases:
    return phrases([(r["item"], bytes(r["raw"]) if r["raw"] is not None else None) for r in block.collect()], window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS, slack: int | None = None,
) -> DataFrame:
    """(doc_id, n_words, starts, ends, items) for every row of `docs`: merged word spans inside benchmark windows.

    The index is a written table. The benchmark is the stated query set: it goes to the tasks in blocks
    of a fixed size, and a second block only adds a merge of spans. Documents without words, empty
    tables and repeated rows come back with what they have; null texts have no words.
    """
    parts = []
    cut = blocks(benchmark, item_id, item_text, block_words)
    if len(cut) > 1:  # a written copy is read in the same order for every block, so places stay the same
        docs = materialise(docs.select(id_col, text), "texts")
    for part in cut:
        block = collected(part, window)
        index = materialise(build_index(docs, block.vocabulary, id_col, text), "index")
        parts.append(search(index, block, slack))
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "starts", "ends", "items")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # A document has one row for each block; its place in the shard names the row whatever its id.
    whole = every.groupBy("part", "number", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = F.aggregate(
        "spans", F.expr("cast(array() as array<struct<starts: int, ends: int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["ends"] >= s["starts"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(
                    F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], s["ends"]).alias("ends")
                )),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return whole.withColumn("spans", merged).select("doc_id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")


def hits(starts, ends):
    """Number of words in merged spans."""
    widths = F.zip_with(starts, ends, lambda s, e: (e - s).cast("long"))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda total, w: total + w)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark window, all columns. Rows with a null id stay."""
    found = contamination(docs, benchmark, id_col, text, **options).filter(F.size("starts") > 0)
    return docs.join(found.select(F.col("doc_id").alias(id_col)).distinct(), id_col, "left_anti")
