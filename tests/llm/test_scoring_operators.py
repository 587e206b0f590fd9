"""Pairwise quality, dual-tree search and whitened components against plain computations."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from attesta.llm import dualtree, feast, preference, queries, whitening

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


# -- quality


def test_features_of_any_text():
    assert not preference.features(None).any() and not preference.features(" \n\t").any()
    for text in ("a", "\ud800", "É😀 ñ", "word " * 100_000, "x" * 1_000_000, "!!!\n???\n", "0" * 50):
        row = preference.features(text)
        assert np.isfinite(row).all() and abs(row[preference.STATISTICS :].sum() - 1) < 1e-9
    assert preference.shape("Aaaaa,") == "Aa,"
    assert (preference.features("one two") == preference.features("one  two ").copy()).sum() > preference.SHAPES


def test_each_row_stands_in_different_pairs():
    for good, bad in ((5, 3), (3, 5), (1, 1), (100, 7), (8, 2)):
        i, j = preference.pairs_of(good, bad, 4)
        assert len(set(zip(i, j))) == len(i) == max(good, bad) * min(4, good, bad)
        assert set(i) == set(range(good)) and set(j) == set(range(bad))


def test_weights_are_where_the_loss_is_flat():
    rng = np.random.default_rng(3)
    d = rng.normal(0.3, 1, (200, 4))
    w = preference.descend(d, 0.05)
    loss = lambda v: sum(math.log1p(math.exp(-float(row @ v))) for row in d) / 200 + 0.025 * float(v @ v)
    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert abs(loss(w + step) - loss(w - step)) < 2e-8


def test_cut_leaves_the_least_weight_on_the_wrong_side():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randrange(2, 30)
        s = np.array([rng.randrange(8) / 2 for _ in range(n)])
        good = np.array([rng.random() < 0.6 for _ in range(n)])
        weight = np.array([rng.choice([1.0, 2.5]) for _ in range(n)])
        cut, quantile = preference.cut_at(s, good, weight)
        wrong = lambda c: sum(w for x, g, w in zip(s, good, weight) if (x >= c) != g)  # noqa: E731, B023
        assert wrong(cut) <= min(map(wrong, [*s, s.max() + 1])) + 1e-9
        assert abs(quantile - weight[s < cut].sum() / weight.sum()) < 1e-9


@pytest.mark.parametrize("root", [SMALL, MIDDLE])
def test_quality_of_held_out_documents(spark, root):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op11_quality"](spark, root).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    assert set(rows) == set(docs)
    # The same score row by row, from the fitted ranking and nothing else.
    labels = spark.read.parquet(f"{root}/labels.parquet").filter(~queries.held("doc_id", 5, 0))
    ranking = preference.fit(spark.read.parquet(f"{root}/documents.parquet"), labels)
    for i, r in rows.items():
        z = sum(w * min(8, max(-8, (x - m) / s)) for w, x, m, s in zip(ranking.weights, preference.features(docs[i]), ranking.mean, ranking.scale))
        want = 1 / (1 + math.exp(-(z - ranking.cut + math.log(0.3 / 0.7))))
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [i for i in truth if rows[i]["held_out"]]
    good, bad = ([rows[i] for i in held if truth[i] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in good) >= 0.95 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.15 * len(bad) + 1


def test_quality_of_awkward_rows_and_labels(spark):
    rows = [(i, f"This is a proper text with the number {i}.", "x", "y") for i in range(20)] + [(100 + i, f"!!! ### {i} $$$ !!!", "x", "y") for i in range(20)]
    rows += [(None, "no id", "x", "y"), (7, None, "x", "y"), (7, "", "x", "y"), (300, "long " * 50_000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, key string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (7, None, 0), (8, 5, 0), (999, 1, 1)], "doc_id long, quality int, y int")
    ranking = preference.fit(docs, labels, per_class=10)
    got = docs.select("doc_id", preference.score(docs, ranking).alias("out")).collect()
    assert len(got) == len(rows) and all(0 <= r["out"] <= 1 for r in got)
    assert all(r["out"] > 0.3 for r in got if r["doc_id"] in (11, 15)) and all(r["out"] < 0.3 for r in got if r["doc_id"] in (111, 115))
    kept = preference.keep_best(docs, ranking)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint(range(100, 120))
    for chosen, want in (("quality = 1", 1.0), ("quality = 0", 0.0), ("quality = 9", 0.5), ("doc_id = 999", 1.0)):
        only = preference.fit(docs, labels.filter(chosen))
        assert {r["out"] for r in docs.select(preference.score(docs, only).alias("out")).collect()} == {want}
    none = docs.filter("doc_id < 0")
    assert none.select(preference.score(none, preference.fit(none, labels))).count() == 0


# -- ranked search


def _terms(text):
    return TERM.findall((text or "").translate(FOLD))


def _search(docs, items, k=50):
    """Every score by the formula, in whole numbers."""
    counted = [(i, _terms(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = {}
    for _, t in counted:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, t in counted:
            score = 0
            for term in terms & set(t):
                tf, w = t.count(term), math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * len(t) * n_docs // total)))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def _got(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def test_dual_tree_equals_all_scores(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "ñ", "x1", "😀", "a b"]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([8, 65])]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 40))) for i in range(700)] + [(1000 + i, "w1 w2 w3 Été") for i in range(300)]
    docs += [(None, "w1 w2 w3 Été"), (None, None), (5, "w1-w2, W3"), (5, "w1-w2, W3"), (9, ""), (2000, "w3 " * 20_000 + "w50")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(40)] + [(3, "w1"), (None, "w2 w60"), (50, None), (51, "---"), (52, "absent"), (53, "w1 w2 w3 ÉTÉ été")]
    frame = spark.createDataFrame([(*d, "c", 0) for d in docs], "doc_id long, text string, score string, item int").repartition(5)
    asked = spark.createDataFrame([(*q, 0) for q in items], "item_id long, text string, rank int")
    want = _search(docs, items)
    assert _got(dualtree.ranked_search(frame, asked)) == want
    assert _got(dualtree.ranked_search(frame, asked, k=3, vocabulary_words=20)) == _search(docs, items, 3)
    monkeypatch.setattr(dualtree, "BATCH_ITEMS", 5)
    names = spark.createDataFrame([(f"q{i}", t) for i, t in items[:20]], "name string, said string")
    renamed = frame.withColumnsRenamed({"doc_id": "id", "text": "body"})
    other = dualtree.ranked_search(renamed, names, id_col="id", text="body", item_id="name", item_text="said")
    assert _got(other) == _search(docs, [(f"q{i}", t) for i, t in items[:20]])
    assert dualtree.ranked_search(frame.limit(0), asked).count() == 0


def test_search_query_equals_all_scores_on_given_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert _got(queries.QUERIES["op12_ranked_search"](spark, SMALL)) == _search(docs, items)


@pytest.mark.parametrize("heavy", [1, 10**10])  # the second leaves the range of exact doubles
def test_pairs_of_nodes_are_pruned_and_none_is_lost(heavy):
    rng = np.random.default_rng(1)
    n_terms, n_docs = 400, 3000
    weight = rng.integers(1, 9, n_terms) * heavy
    topics = rng.integers(0, 20, n_docs)
    rows = np.zeros((n_docs, n_terms), np.int64)
    for d, topic in enumerate(topics):
        at = rng.choice(np.arange(topic * 20, topic * 20 + 20), 6, replace=False)
        rows[d, at] = rng.integers(1, 1_000_000, 6)
    terms = [np.sort(rng.choice(np.arange(t * 20, t * 20 + 20), 5, replace=False)) for t in rng.integers(0, 20, 100)]
    batches = dualtree.batches_of(terms, weight, batch_items=64)
    assert len(batches) == 2 and sorted(np.concatenate([b.items for b in batches])) == list(range(100))
    best, work = dualtree.Best(100, 10, np.zeros(100, np.int64)), dualtree.Work()
    for batch in batches:
        assert batch.weight.dtype == (np.float64 if heavy == 1 else np.int64)
        for start in range(0, n_docs, 1000):
            part = rows[start : start + 1000][:, batch.columns].astype(batch.weight.dtype)
            dualtree.search(batch, part, np.arange(start, start + len(part)), np.zeros(len(part), bool), best, work)
    for i, own in enumerate(terms):
        scores = rows[:, own] @ weight[own]
        want = sorted((-int(s), d) for d, s in enumerate(scores) if s)[:10]
        assert [(-int(s), int(d)) for s, d in zip(best.scores[i], best.ids[i])] == want
    assert work.possible == 100 * n_docs and work.scored < work.possible / 3


# -- whitening


def test_inertia_and_leading_pairs_of_hard_matrices():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 9, 24):
        turn, _ = np.linalg.qr(rng.standard_normal((n, n)))
        close = np.sort(np.r_[np.full(n // 2, 3.0), 3 + 1e-9, rng.random(n)][:n])
        for values in (rng.standard_normal(n), np.ones(n), np.r_[np.zeros(n - 1), 2.0], 10.0 ** -np.arange(n), close, np.zeros(n)):
            matrix = turn * values @ turn.T
            matrix = (matrix + matrix.T) / 2
            real = np.linalg.eigvalsh(matrix)
            for shift in rng.uniform(real[0] - 1, real[-1] + 1, 5):
                assert feast.below(matrix, shift) == (real < shift).sum()
            got, vectors = feast.leading(matrix, 4)
            k, size = min(4, n), max(1, abs(real).max())
            assert got == pytest.approx(real[::-1][:k], abs=1e-12 * size)
            assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11 * size and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert feast.leading(np.zeros((0, 0)), 4)[0].shape == (0,)


def test_projection_keeps_only_the_interval():
    matrix = np.diag([9.0, 5.0, 1.0])
    got = feast.projected(matrix, 4.0, 6.0, np.eye(3), points=16)
    assert np.abs(got - np.diag([0.0, 1.0, 0.0])).max() < 1e-4
    with pytest.raises(ArithmeticError):
        feast.eigenpairs(matrix, 4.0, 6.0, 2)


def _whitened(vectors):
    """(n, deviation by row, components by row, explained) by plain means."""
    x = np.array([[math.floor(256 * float(c)) for c in v] for v in vectors])
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    centred = distinct - s / n
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    deviations = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviations, (x - s / n) @ turned[:, ::-1][:, :4] / np.sqrt(values[::-1][:4]), values[::-1][:4] / values.sum()


def test_whitened_components_equal_a_plain_eigensolver(spark):
    rows = queries.QUERIES["op13_whitening"](spark, SMALL).collect()
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    n, deviations, parts, explained = _whitened(list(table.values()))
    place = {i: k for k, i in enumerate(table)}
    assert len(rows) == 4 * len(table)
    sign = {}
    for r in rows:
        k, c = place[r["vec_id"]], r["component"] - 1
        want = parts[k, c]
        assert (r["n"], r["deviation"]) == (n, deviations[k]) and r["explained"] == pytest.approx(explained[c], rel=1e-9)
        if abs(want) > 1e-6:
            assert sign.setdefault(c, np.sign(r["whitened"] * want)) == np.sign(r["whitened"] * want)
        assert abs(abs(r["whitened"]) - abs(want)) < 1e-8
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_awkward_vectors(spark):
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0, 2.0], [1.0, 2.0, 3.0, 4.0]]
    good = [[0.5, -0.0, 1e-3], [0.5, 0.0, 1e-3], [0.25, 2.0, -1.0], [0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [-7.0, 0.0, 0.5]]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(1, good[0], "x", 1), (None, good[2], "x", 1)] + [(50 + i, v, "x", 1) for i, v in enumerate(bad)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, n int").repartition(3)
    got = whitening.whiten(frame).collect()
    n, deviations, parts, _ = _whitened(good)
    assert n == 4 and len(got) == 3 * 8 and {r["n"] for r in got} == {4}
    assert {r["deviation"] for r in got if r["vec_id"] == 5} == {deviations[5]}
    assert sorted({r["component"] for r in got}) == [1, 2, 3]
    assert all(abs(abs(r["whitened"]) - abs(parts[r["vec_id"], r["component"] - 1])) < 1e-8 for r in got if r["vec_id"] is not None)
    for part in (frame.filter("vec_id >= 50 and vec_id < 55"), frame.limit(0), frame.filter("vec_id in (0, 1)")):
        assert whitening.whiten(part).count() == 0
    flat = spark.createDataFrame([(1, [1e15, 5.0]), (2, [-1e15, 5.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(flat, components=9).collect()
    assert {r["component"] for r in out} == {1} and {r["deviation"] for r in out} == {None, 0}
