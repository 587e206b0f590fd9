"""Sets of which a given part overlaps, found in a task that holds some and lets others pass by.

Nothing but numpy and Arrow is imported, so tasks start fast. A set is a row of 4-byte keys in any order, one for
each token. Tokens with one key count as shared, so at most too much is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Share of a set's tokens that is looked up beyond the least: a pair then has to share more than one of them.
SPARE = 0.05
#: Keys of passing sets, meetings on a token, and pairs that are looked at in one step.
KEYS, MEETINGS, PAIRS = 500_000, 2_000_000, 4_000_000


def required(a, b, needed: float):
    """Tokens that sets of `a` and `b` tokens share at least if their Jaccard similarity is `needed` or more."""
    return np.ceil((a + b) * needed / (1 + needed) - 1e-9).astype(np.int64)


def _order(*columns: np.ndarray) -> np.ndarray:
    """The order of rows by columns of numbers from 0 on, the last one capped to what fits: all in one number, which sorts fast."""
    bits = [len(columns[0]).bit_length()]
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        bits.append(min(int(column.max(initial=0)).bit_length(), 63 - sum(bits)))
        code = (code << bits[-1]) | np.minimum(column, (1 << bits[-1]) - 1)
    code = (code << bits[0]) | np.arange(len(code))
    code.sort()
    return code & ((1 << bits[0]) - 1)


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each `first` on, `count` of them, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


class Sets:
    """Sets in ascending size: their sizes, nodes (only sets of one node are compared), digests and keys."""

    def __init__(self, sizes: np.ndarray, nodes: np.ndarray, digests: np.ndarray, keys: np.ndarray | None):
        self.sizes, self.nodes, self.digests, self.keys = sizes, nodes, digests, keys
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def __len__(self) -> int:
        return len(self.sizes)


def parts(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours that weigh at most `most` together, or are one heavier each."""
    ends, start = np.cumsum(weights), 0
    while start < len(weights):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, end
        start = end


class Index:
    """Sets that are held, with the sets of each key. A key is known by its rank among the keys held."""

    def __init__(self, held: Sets, needed: float):
        self.held, self.needed = Sets(held.sizes, held.nodes, held.digests, None), needed
        bits = len(held.keys).bit_length()
        code = held.keys.astype(np.int64)
        code += 1 << 31
        code <<= bits
        code |= np.arange(len(code))
        code.sort()
        place = (code & ((1 << bits) - 1)).astype(np.int32)
        code >>= bits
        new = np.append(True, code[1:] != code[:-1])
        self.first = np.flatnonzero(new)
        self.known = (code[self.first] - (1 << 31)).astype(np.int32)
        self.carriers = np.diff(self.first, append=len(code))
        del code
        self.ranks = np.empty(len(place), dtype=np.int32)
        self.ranks[place] = np.cumsum(new, dtype=np.int32) - 1
        self.owners = np.repeat(np.arange(len(held), dtype=np.int32), held.sizes)[place]
        self.seen = np.zeros(len(self.known), dtype=bool)

    def pairs(self, passing: Sets | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of passing sets and of held ones that are no smaller and overlap enough.

        Without `passing` the held sets pass by themselves, and each pair of them is found once.
        """
        sets = self.held if passing is None else passing
        for start, end in parts(sets.sizes, KEYS):
            first, last = sets.starts[start], sets.ends[end - 1]
            if passing is not None:
                keys = passing.keys[first:last]
                ranks = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
                ranks[self.known[ranks] != keys] = -1
            else:
                ranks = self.ranks[first:last]
            for small, large in self._meet(sets.sizes[start:end], sets.nodes[start:end], ranks, start if passing is None else None):
                yield small + start, large

    def _meet(self, sizes: np.ndarray, nodes: np.ndarray, ranks: np.ndarray, own: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of a passing set's tokens those with most carriers are skipped: as many as a partner can do without, so a
        pair that shares enough shares some of the others. `own` is the number of the first set if they are held ones."""
        starts = np.cumsum(sizes) - sizes
        least = required(sizes, np.maximum(sizes, self.held.sizes[0]), self.needed)
        skipped = np.maximum(least - 1 - (sizes * SPARE).astype(np.int64), 0)
        here = np.flatnonzero(ranks >= 0 if own is None else self.carriers[ranks] > 1)
        owner, rank = np.repeat(np.arange(len(sizes)), sizes)[here], ranks[here]
        carriers = self.carriers[rank]
        shareable = np.bincount(owner, minlength=len(sizes))
        order = _order(owner, carriers)
        owner, rank = owner[order], rank[order]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(shareable) - shareable, shareable)
        taken = (place < (shareable - skipped)[owner]) & (shareable >= least)[owner]
        owner, rank = owner[taken], rank[taken]
        able, owner = np.unique(owner, return_inverse=True)
        least, skipped = least[able], skipped[able]
        meetings = np.bincount(owner, weights=self.carriers[rank], minlength=len(able)).astype(np.int64)
        ends = np.searchsorted(owner, np.arange(len(able) + 1))
        for start, end in parts(np.maximum(meetings, len(self.held) * MEETINGS // PAIRS), MEETINGS):
            of, at = owner[ends[start]:ends[end]] - start, rank[ends[start]:ends[end]]
            code = np.repeat(of * len(self.held), self.carriers[at]) + self.owners[spans(self.first[at], self.carriers[at])]
            if len(code) * 16 < (end - start) * len(self.held):
                found, shared = np.unique(code, return_counts=True)
            else:
                counts = np.bincount(code, minlength=(end - start) * len(self.held))
                fewest = (least - skipped)[start:end]
                found = np.flatnonzero(counts >= fewest.min())
                shared = counts[found]
            small, large = found // len(self.held) + start, found % len(self.held)
            room, small = skipped[small], able[small]
            a, b = sizes[small], self.held.sizes[large]
            keep = (b >= a) & (shared + room >= required(a, b, self.needed)) & (nodes[small] == self.held.nodes[large])
            if own is not None:
                keep &= large > small + own
            if keep.any():
                yield from self._verified(sizes, starts, ranks, small[keep], large[keep])

    def _verified(self, sizes: np.ndarray, starts: np.ndarray, ranks: np.ndarray, small: np.ndarray, large: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs that share enough of all their tokens; `small` ascends."""
        at = np.append(np.flatnonzero(np.diff(small, prepend=-1)), len(small))
        for start, end in zip(at[:-1], at[1:]):
            one = small[start]
            own = ranks[starts[one]:starts[one] + sizes[one]]
            own = own[own >= 0]
            self.seen[own] = True
            for first, last in parts(self.held.sizes[large[start:end]], PAIRS):
                others = large[start + first:start + last]
                b = self.held.sizes[others]
                shared = np.add.reduceat(self.seen[self.ranks[spans(self.held.starts[others], b)]], np.cumsum(b) - b, dtype=np.int64)
                others = others[shared >= required(sizes[one], b, self.needed)]
                if len(others):
                    yield np.full(len(others), one), others
            self.seen[own] = False


def _sets(rows: pa.Table) -> Sets:
    sizes, nodes, digests = (rows[c].to_numpy() for c in ("size", "node", "digest"))
    return Sets(sizes.astype(np.int64), nodes, digests, pc.list_flatten(rows["keys"]).to_numpy())


def _listed(index: Index, passing: Sets | None = None) -> Iterator[pa.RecordBatch]:
    own = index.held if passing is None else passing
    for small, large in index.pairs(passing):
        digests = [pa.array(list(x), pa.binary()) for x in (own.digests[small], index.held.digests[large])]
        yield pa.RecordBatch.from_arrays([pa.array(index.held.nodes[large]), *digests], ["node", "small", "large"])


def overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, small, large) of (needed, unit, part, passes, size, node, digest, keys) in this order.

    A task is what has the first three columns in common: the sets it holds, then those that pass by, both by size.
    The same set may come several times in a row.
    """
    now, waiting, index, last = None, [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("needed", "unit", "part", "passes", "node", "digest")]
        again = np.ones(batch.num_rows, dtype=bool)  # like the row before, in the first four columns and then in all
        again[0] = last is not None and all(c[0] == x for c, x in zip(columns[:4], last))
        for c in columns[:4]:
            again[1:] &= c[1:] == c[:-1]
        borders = np.append(np.flatnonzero(~again | (np.arange(len(again)) == 0)), len(again))
        again[0] &= last is not None and all(c[0] == x for c, x in zip(columns, last))
        for c in columns[4:]:
            again[1:] &= c[1:] == c[:-1]
        last = [c[-1] for c in columns]
        rows = pa.Table.from_batches([batch])
        for start, end in zip(borders[:-1], borders[1:]):
            task, passes = tuple(c[start] for c in columns[:3]), columns[3][start]
            some = rows.slice(start, end - start).filter(pa.array(~again[start:end]))
            if waiting and (passes or task != now):
                held, waiting = _sets(pa.concat_tables(waiting)), []
                index = Index(held, float(now[0]))
                del held
                yield from _listed(index)
            if task != now:
                now, waiting, index = task, [], None
            if not passes:
                waiting.append(some)
            elif some.num_rows:
                yield from _listed(index, _sets(some))
    if waiting:
        yield from _listed(Index(_sets(pa.concat_tables(waiting)), float(now[0])))
