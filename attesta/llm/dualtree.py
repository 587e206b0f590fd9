"""Ranked lexical search for many items at once: two hierarchies of coordinate maxima, pruned pair by pair."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.decontamination import words
from attesta.session import materialise

TOP = 50
#: Words of the items whose vocabulary goes to the tasks at once, and bounds of the items searched together in a task.
VOCABULARY_WORDS = 500_000
BATCH_WORDS, BATCH_ITEMS = 8_000, 256
#: Cells of the coordinates of documents searched together in a task; leaves, and children of a node.
CELLS = 4_000_000
DOC_LEAF, ITEM_LEAF, FAN = 16, 8, 4
#: Bounds are doubles, made a little larger than any error of their sums.
ROUNDING = 1 + 1e-9
#: One document in so many gives the first thresholds.
SEED = 16
#: Groups in which the best of an item are found before they meet.
GROUPS = 64

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def levels(rows: np.ndarray, leaf: int, extreme: np.ufunc = np.maximum) -> list[np.ndarray]:
    """Coordinate maxima (or minima) of the nodes of each level, from leaves of `leaf` rows to the one root."""
    out = [extreme.reduceat(rows, np.arange(0, len(rows), leaf))]
    while len(out[-1]) > 1:
        out.append(extreme.reduceat(out[-1], np.arange(0, len(out[-1]), FAN)))
    return out


def arrange(member: np.ndarray, weight: np.ndarray, leaf: int = ITEM_LEAF) -> np.ndarray:
    """Items so ordered that those with terms of weight in common stand together: split again and again by the term that parts them best."""
    order, open_ = [], [np.arange(len(member))]
    while open_:
        at = open_.pop()
        n = member[at].sum(axis=0)
        gain = weight * np.minimum(n, len(at) - n)
        if len(at) <= leaf or not gain.max(initial=0):
            order.append(at)
            continue
        has = member[at, int(np.argmax(gain))]
        open_ += [at[~has], at[has]]
    return np.concatenate(order) if order else np.zeros(0, np.int64)


@dataclass
class Batch:
    """Items searched together, as a hierarchy; columns are the terms they have, in the order of the items."""

    items: np.ndarray
    columns: np.ndarray
    member: np.ndarray
    weight: np.ndarray
    tree: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        exact = float((self.member * self.weight.astype(np.float64)).sum(axis=1).max(initial=0)) * 1e6 < 2**53
        kind = np.float64 if exact else np.int64  # whole numbers below 2^53 are exact in doubles, which multiply faster
        self.weight = self.weight.astype(kind)
        self.rows = self.member * self.weight
        self.tree = levels(self.rows.astype(np.float64), ITEM_LEAF)


def batches_of(terms: list[np.ndarray], weight: np.ndarray, batch_words: int = BATCH_WORDS, batch_items: int = BATCH_ITEMS) -> list[Batch]:
    """Items with terms in batches of a bounded size; an item beyond it is a batch of its own."""
    groups, size = [[]], 0
    for i, own in enumerate(terms):
        if not len(own):
            continue
        if groups[-1] and (size + len(own) > batch_words or len(groups[-1]) >= batch_items):
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(own)
    out = []
    for group in filter(None, groups):
        columns = np.unique(np.concatenate([terms[i] for i in group]))
        member = np.zeros((len(group), len(columns)), bool)
        for row, i in enumerate(group):
            member[row, np.searchsorted(columns, terms[i])] = True
        order = arrange(member, weight[columns])
        member = member[order]
        first = np.argsort(member.argmax(axis=0), kind="stable")  # columns by the first item that has them
        out.append(Batch(np.array(group)[order], columns[first], member[:, first], weight[columns[first]]))
    return out


class Best:
    """The k best documents of every item so far, and the score below which no document can enter."""

    def __init__(self, n_items: int, k: int, least: np.ndarray):
        self.k, self.least = k, np.maximum(least, 1)
        self.scores = [np.zeros(0, np.int64)] * n_items
        self.ids = [np.zeros(0, np.int64)] * n_items
        self.absent = [np.zeros(0, bool)] * n_items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        s, i, a = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids]), np.concatenate([self.absent[item], absent])
        order = np.lexsort((i, a, -s))[: self.k]
        self.scores[item], self.ids[item], self.absent[item] = s[order], i[order], a[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], s[order[-1]])


@dataclass
class Work:
    """How many scores were possible, and how many were computed."""

    possible: int = 0
    scored: int = 0


def search(batch: Batch, coordinates: np.ndarray, ids: np.ndarray, absent: np.ndarray, best: Best, work: Work) -> None:
    """Enter the documents of `coordinates` (rows over the batch's columns) that belong to the best of its items.

    Documents are ordered by their two strongest terms and put into a hierarchy. Both hierarchies are walked
    down together; a pair of nodes whose maxima cannot reach the weakest kth score among the node's items
    goes with all below it. Leaves that remain are scored from the highest bound on, until it is too low.
    A bound that equals a kth score stays, as a tie may be won by the smaller id.
    """
    strength = coordinates * batch.weight
    first = strength.argmax(axis=1)
    strength[np.arange(len(first)), first] = -1
    order = np.lexsort((strength.argmax(axis=1), first))
    del strength
    coordinates, ids, absent = coordinates[order], ids[order], absent[order]
    tree = levels(coordinates.astype(np.float64), DOC_LEAF)
    weakest = levels(best.least[batch.items], ITEM_LEAF, np.minimum)
    work.possible += len(ids) * len(batch.items)
    d, i = len(tree) - 1, len(batch.tree) - 1
    live = np.ones((1, 1), bool)
    bounds = np.zeros((1, 1))
    while True:
        rows, columns = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
        bounds = np.zeros(live.shape)
        bounds[np.ix_(rows, columns)] = (tree[d][rows] @ batch.tree[i][columns].T) * ROUNDING
        live &= bounds >= weakest[i]
        if not live.any():
            return
        if d == 0 and i == 0:
            break
        if d:
            d -= 1
            live = np.repeat(live, FAN, axis=0)[: len(tree[d])]
        if i:
            i -= 1
            live = np.repeat(live, FAN, axis=1)[:, : len(batch.tree[i])]
    for leaf in range(live.shape[1]):
        at = np.flatnonzero(live[:, leaf])
        at = at[np.argsort(-bounds[at, leaf], kind="stable")]
        own = np.arange(leaf * ITEM_LEAF, min((leaf + 1) * ITEM_LEAF, len(batch.items)))
        columns = np.flatnonzero(batch.tree[0][leaf])
        weights = batch.rows[np.ix_(own, columns)].T
        done, step = 0, 1
        while done < len(at):
            now = at[done : done + step]
            now = now[bounds[now, leaf] >= best.least[batch.items[own]].min()]
            if not len(now):
                break
            docs = (now[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
            docs = docs[docs < len(ids)]
            scores = (coordinates[np.ix_(docs, columns)] @ weights).astype(np.int64)
            work.scored += scores.size
            for k, item in enumerate(batch.items[own]):
                enters = np.flatnonzero(scores[:, k] >= best.least[item])
                if len(enters):
                    best.add(item, scores[enters, k], ids[docs[enters]], absent[docs[enters]])
            done, step = done + step, min(step * 2, 64)


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of every row: all its terms with repeats, and how often it has those of the vocabulary. Null has none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, terms, counts = [], [], []
            for raw in batch.column(1):
                parts = words(raw.as_py())
                sizes.append(len(parts))
                found = np.fromiter(map(vocabulary.get, parts, repeat(-1)), np.int32, len(parts))
                own, n = np.unique(found[found >= 0], return_counts=True)
                terms.append(own)
                counts.append(n.astype(np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary")).mapInArrow(counted, VECTORS)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each term."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def strongest(rows: DataFrame, batches: list[Batch], n_items: int, n_terms: int, n_docs: int, total: int, k: int, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score) of documents that may belong to the k best of an item: at most k from each task."""
    look = []
    for batch in batches:
        column = np.full(n_terms, -1, np.int32)
        column[batch.columns] = np.arange(len(batch.columns))
        look.append(column)

    def found(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, work = Best(n_items, k, least.copy()), Work()
        for part in incoming:
            if not len(part):
                continue
            absent = part.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = part.column(0).fill_null(0).to_numpy()
            n = part.column(1).to_numpy()
            lists, tf = part.column(2), part.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
            m = 50 + (50 * n * n_docs) // total
            value = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
            terms = lists.flatten().to_numpy()
            for batch, column in zip(batches, look):
                at = column[terms]
                own = np.flatnonzero(at >= 0)
                docs, place = np.unique(row[own], return_inverse=True)
                chunk = max(DOC_LEAF, CELLS // len(batch.columns))
                for start in range(0, len(docs), chunk):
                    here = docs[start : start + chunk]
                    of = own[(place >= start) & (place < start + chunk)]
                    dense = np.zeros((len(here), len(batch.columns)), batch.weight.dtype)
                    dense[np.searchsorted(here, row[of]), at[of]] = value[of]
                    search(batch, dense, ids[here], absent[here], best, work)
        items = [i for i in range(n_items) if len(best.scores[i])]
        if items:
            sizes = [len(best.scores[i]) for i in items]
            gone = np.concatenate([best.absent[i] for i in items])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(items, np.int32), sizes)),
                    pa.array(np.concatenate([best.ids[i] for i in items]), mask=gone), pa.array(np.concatenate([best.scores[i] for i in items])),
                ],
                ["item", "doc_id", "score"],
            )

    return rows.mapInArrow(found, FOUND)


def ranks(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; hashed groups of an item are cut first, so no item is one task's work."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    grouped = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    cut = grouped.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*by))).filter(F.col("rank") <= k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k).drop("salt")


def _items(queries: DataFrame, item_id: str, text: str, vocabulary_words: int) -> Iterator[list]:
    """(id, terms) of the items, in parts of bounded vocabulary. Rows of one id are one item."""
    narrow = queries.select(F.col(item_id).alias("item"), F.col(text).cast("binary").alias("raw"))
    size = narrow.agg(F.sum(F.length("raw"))).first()[0] or 0
    parts = 1 + size // (6 * vocabulary_words)
    for b in range(parts):
        own = narrow if parts == 1 else narrow.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == b)
        known: dict[object, set[bytes]] = {}
        for r in own.collect():  # bounded by the part
            known.setdefault(r["item"], set()).update(words(bytes(r["raw"]) if r["raw"] is not None else None))
        yield sorted(known.items(), key=lambda x: (x[0] is not None, x[0] or 0 if not isinstance(x[0], str) else x[0]))


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", vocabulary_words: int = VOCABULARY_WORDS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` highest-scoring documents of each item with a score above 0.

    Scores are the fixed-point sums over an item's distinct terms of weight times saturated frequency; equal
    scores rank by id, null ids last, and rows of one id stand each for itself. Rows of one item id are one
    item. Statistics cover all documents. Term counts are a written table; a sixteenth of it gives lower
    bounds of the kth scores, with which the search over all of it begins. The items are the stated query
    set: they go to the tasks in parts of bounded vocabulary, each with a pass over the texts.
    """
    spark = docs.sparkSession
    kind = queries.schema[item_id].dataType.simpleString()
    every = None
    for items in _items(queries, item_id, item_text, vocabulary_words):
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*(terms for _, terms in items))))}
        terms = [np.array(sorted(vocabulary[w] for w in own), np.int64) for _, own in items]
        rows = materialise(vectors(docs, vocabulary, id_col, text), "vectors")
        total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # bounded by the vocabulary
            df[r["term"]] = r["count"]
        batches = batches_of(terms, weights(total["docs"], df))
        fixed = (batches, len(items), len(vocabulary), total["docs"], max(1, total["terms"]), k)
        least = np.zeros(len(items), np.int64)
        seed = ranks(strongest(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SEED)) == 0), *fixed, least), k)
        for r in seed.filter(F.col("rank") == k).select("item", "score").collect():  # one row for each item
            least[r["item"]] = r["score"]
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"item int, item_id {kind}")
        found = ranks(strongest(rows, *fixed, least), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        every = found if every is None else every.unionByName(found)
    return every
