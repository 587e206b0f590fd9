"""Duplicate search: what is shuffled, sets that pass by others, copies of entries."""

import random
import time

import numpy as np
import pytest

from attesta import session
from attesta.operators import dedup, overlap, skew

COLUMNS = "article string, rank long, location string, section string, title_zh string, title_en string, body_zh string, body_en string, urls array<string>"


def test_pairs_that_only_share_rare_tokens_are_not_shuffled(spark):
    """Bodies share some of the rarest of their tokens with very many others, and are similar to two of them."""

    def shuffled(n):
        draw = random.Random(n)
        near = [[draw.randrange(60) for _ in range(14)] + [1000 + i] for i in range(n)]
        bodies = [" ".join(f"t{t}" for t in tokens) for tokens in near] + [" ".join(f"t{t}" for t in near[i][:-1]) for i in (3, 7)]
        entries = [("a", i, f"e{i}", "s", "", f"title{i}", "", body, []) for i, body in enumerate(bodies)]
        classes = session.materialise(dedup.entry_classes(spark.createDataFrame(entries, COLUMNS)))
        written = lambda: spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
        before = written()
        found = dedup.class_pairs(classes).count()
        time.sleep(1)
        return found, written() - before

    (few, small), (many, large) = shuffled(400), shuffled(3200)
    assert few >= 2 and many >= 2
    assert large < 12 * small  # eight times the sets, 64 times the pairs


@pytest.mark.parametrize("needed", [0.3, 0.5, 0.6])
def test_passing_sets_meet_all_similar_held_ones(needed, monkeypatch):
    draw = random.Random(11)
    base = [draw.sample(range(-90, 90), draw.randint(1, 40)) for _ in range(60)]
    every = base + [[k for k in s if draw.random() < 0.8] + draw.sample(range(90, 96), draw.randint(0, 2)) for s in base]
    lists = sorted({tuple(sorted(s)) for s in every if s}, key=lambda s: (len(s), s))
    digests = np.array([str(i).encode() for i in range(len(lists))], dtype=object)

    def sets(some):
        nodes = np.array([i % 2 for i in some])
        return overlap.Sets(np.array([len(lists[i]) for i in some]), nodes, digests[some], np.array([k for i in some for k in lists[i]], dtype=np.int32))

    def similar(i, j):
        shared = len({*lists[i]} & {*lists[j]})
        return i % 2 == j % 2 and shared >= overlap.required(len(lists[i]), len(lists[j]), needed)

    for keys, meetings, pairs in ((500_000, 2_000_000, 4_000_000), (30, 20, 50)):
        monkeypatch.setattr(overlap, "KEYS", keys), monkeypatch.setattr(overlap, "MEETINGS", meetings), monkeypatch.setattr(overlap, "PAIRS", pairs)
        every, met = np.arange(len(lists)), 0
        index = overlap.Index(sets(every), needed)
        own = [(int(a), int(b)) for x, y in index.pairs() for a, b in zip(x, y)]
        assert sorted(own) == [(i, j) for i in every for j in every if i < j and similar(i, j)] != []
        for cut in range(1, len(lists), 6):
            index = overlap.Index(sets(every[cut:]), needed)
            passed = [(int(a), int(b) + cut) for x, y in index.pairs(sets(every[:cut])) for a, b in zip(x, y)]
            assert sorted(passed) == [(i, j) for i, j in sorted(own) if i < cut <= j]
            met += len(passed)
        assert met


@pytest.mark.parametrize("most", [0, 1000])
def test_entry_classes_count_copies_whatever_the_ranks(spark, most, monkeypatch):
    """Ranks that repeat or are missing, and copies that go by shuffle or by broadcast, give what a plain join gives."""
    monkeypatch.setattr(dedup, "few", lambda rows: skew.few(rows, most))
    text = ["x one", "x one", "y two", "z three", "x one", "z three", "w", "w", None]
    rank = [1, 2, 2, 2, 7, 3, None, None, 9]
    entries = [("a" if i != 7 else None, r, f"e{i}", "s", "", t, "", t, ["u"]) for i, (t, r) in enumerate(zip(text, rank))]
    df = spark.createDataFrame(entries, COLUMNS)
    firsts = {}
    for article, r, _, _, _, t, *_ in entries:
        firsts.setdefault((article, t or ""), []).append(r)
    first = [(article, min((r for r in ranks if r is not None), default=None), len(ranks)) for (article, _), ranks in firsts.items()]
    want = sorted((e[1], e[2], copies) for e in entries for article, r, copies in first if r is not None and (e[0], e[1]) == (article, r))
    assert sorted((r["rank"], r.location, r.copies) for r in dedup.entry_classes(df).collect()) == want
