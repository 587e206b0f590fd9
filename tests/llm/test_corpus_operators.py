"""Mixing, lines, benchmark phrases, near-duplicates and the pipeline against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import components, decontamination, lines, mixing, queries, shingles, simhash

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# -- components


def _roots(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(500, i) for i in range(501, 560)] + [(499, 500)]
    loose = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    edges = [(a, b) for a, b in chain + star + loose if a != b] + [(7, 8), (8, 7), (7, 8)]
    frame = spark.createDataFrame(edges + [(5, 5), (None, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert got == _roots(edges)
    assert components.components(frame.filter("a < 0")).count() == 0


# -- near-duplicates


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_of_fingerprints_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.choice((1, 1, 2, 3, 4))):
                x ^= 1 << bit
            prints.add(x)
    values = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.near_links(frame)).collect()}
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(zip(signed, values), 2) if (x ^ y).bit_count() <= 2]
    assert got == _roots(edges)
    for r in simhash.near_links(frame).collect():
        assert (r["a"] ^ r["b"]).__and__((1 << 64) - 1).bit_count() <= 2


def _simhash(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_op8_against_brute_force(spark, docs):
    prints = {i: _simhash(t) for i, t in docs.items()}
    edges = [(i, i) for i in prints] + [(i, j) for i, j in itertools.combinations(prints, 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = {i: (f"{prints[i]:016x}", root) for i, root in _roots(edges).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op8_simhash"](spark, SMALL).collect()} == want


def test_near_duplicates_of_awkward_rows(spark):
    text = "one two three four five six seven " * 3
    rows = [(4, text, "a"), (2, text, "b"), (4, text, "a"), (9, None, "c"), (8, " \n", "d"), (None, text, "e"), (3, "word " * 50_000, "f"), (2, "other words here now", "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("gone_id", F.lit(4))
    got = [(r["doc_id"], r["fp"] == 0, r["component_id"]) for r in simhash.near_duplicates(frame).collect()]
    assert sorted(got, key=str) == sorted([(4, False, 2), (2, False, 2), (4, False, 2), (9, True, 8), (8, True, 8), (None, False, 2), (3, False, 3), (2, False, 2)], key=str)
    kept = [(r["doc_id"], r["fp"]) for r in simhash.keep_one(frame).collect()]
    assert sorted(kept, key=str) == sorted([(2, "b"), (2, "g"), (3, "f"), (8, "d"), (None, "e")], key=str)
    assert simhash.near_duplicates(frame.filter("doc_id > 99")).count() == 0


def _shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _similar_groups(texts):
    sets = {i: _shingle_set(t) for i, t in texts.items()}
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    return _roots([(i, i) for i in sets] + [(i, j) for i, j in itertools.combinations(sets, 2) if alike(sets[i], sets[j])])


def test_near_copy_stage_equals_brute_force_jaccard(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(8):
        own = [rng.choice(words) for _ in range(150)]
        for copy in range(12):  # up to 6 words changed: similarities on both sides of 0.8
            text = list(own)
            for at in rng.sample(range(150), rng.randrange(7)):
                text[at] = rng.choice(words)
            texts[100 * base + copy] = " ".join(text)
    passage = " ".join(words[:60])
    texts |= {2000 + i: passage + " " + " ".join(rng.choice(words) for _ in range(90)) for i in range(30)}
    texts |= {3000: "a b c", 3001: "A  b c", 3002: "a b", 3003: "", 3004: " \n", 3005: None}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("digest", F.lit("x"))
    roots = _similar_groups(texts)
    got = shingles.keep_one(frame)
    assert {r["doc_id"] for r in got.collect()} == set(roots.values()) and got.columns == frame.columns
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, frame, SMALL).collect()}
    assert left <= set(texts) and not any(i != r for i, r in _similar_groups({i: texts[i] for i in left}).items())
    assert len(roots) - len(set(roots.values())) > 40
    again = spark.createDataFrame([(None, texts[0], "b"), (5, texts[0], "c"), (5, "other words", "d")], "doc_id long, text string, digest string")
    kept = sorted(((r["doc_id"], r["digest"]) for r in shingles.keep_one(again.union(again)).collect()), key=str)
    assert kept == sorted([(None, "b"), (5, "c"), (5, "d")] * 2, key=str)


def test_no_link_is_lost_among_pages_of_one_template(spark):
    """Every page lies just below 0.8 of every other; planted pairs, chains and a large group of copies lie above."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(280)]
    page = lambda i: [f"p{i}x{k}" for k in range(36)]
    own = {i: page(i) for i in range(240)}
    for i in range(40):  # pairs: a third of the page's own words is shared
        own[1000 + i] = own[i][:12] + page(1000 + i)[12:]
    for i in range(15):  # chains: each link takes another third of the one before
        own[2000 + i] = own[1000 + i][12:24] + page(2000 + i)[12:]
    group = page("g")
    for i in range(60):  # copies that differ in a few words, between which strangers stand
        own[3000 + i] = group[:30] + page(f"c{i}")[30:]
    ids = list(own)
    rng.shuffle(ids)
    texts = {n: " ".join(template + own[i]) for n, i in enumerate(ids)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    roots = _similar_groups(texts)
    assert 100 < len(roots) - len(set(roots.values())) < 130
    assert {r["doc_id"] for r in shingles.keep_one(frame).collect()} == set(roots.values())


def test_rest_pairs_miss_none_and_pass_over_own_groups(spark):
    rng = random.Random(11)
    sets = {i: (i % 7 if i < 60 else i, sorted({rng.randrange(26) for _ in range(rng.randrange(1, 40))})) for i in range(150)}
    frame = spark.createDataFrame([(i, root, tokens) for i, (root, tokens) in sets.items()], "digest long, root long, set array<long>")
    for similarity in (0.5, 0.8, 1.0):
        met = {(r["a"], r["b"]) for r in shingles.rest_pairs(frame, similarity).collect()}
        assert all(a < b and sets[a][0] != sets[b][0] for a, b in met)
        for (a, (x, s)), (b, (y, o)) in itertools.combinations(sets.items(), 2):
            alike = len(set(s) & set(o)) >= similarity * len(set(s) | set(o))
            assert not alike or x == y or (a, b) in met
    assert shingles.rest_pairs(frame.filter("digest < 0")).count() == 0


# -- lines


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_banded_distance_equals_the_table(spark, limit):
    rng = random.Random(limit)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 14)))
        b = list(a)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", lines.edit_distance_within(F.col("a"), F.col("b"), limit).alias("d")).collect():
        assert r["d"] == min(_distance(r["a"], r["b"]), limit + 1), r


def _line_classes(texts, least):
    rows = [(i, k, l) for i, t in sorted(texts.items()) for k, l in enumerate(t.split("\n")) if len(l) >= least]
    first = {}
    for i, k, l in rows:
        first.setdefault(l, (i, k))
    near = {l: [] for l in first}
    for a, b in itertools.combinations(first, 2):
        if abs(len(a) - len(b)) <= 1 and _distance(a, b) == 1:
            near[a].append(b)
            near[b].append(a)
    return {(i, k): (*min(first[x] for x in [l, *near[l]]), len(near[l]), first[l] == (i, k) == min(first[x] for x in [l, *near[l]])) for i, k, l in rows}


def test_line_classes_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["the quick brown fox jumps", "aaaaaaaaaaaaaaaaaaaaaaaa", "order number 12345 shipped", "été à la plage 😀 avec toi"]
    texts = {}
    for d in range(40):
        own = []
        for _ in range(5):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 1, 1, 2))):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "a", "7", "é"])
            own.append("".join(line))
        texts[d - 7] = "\n".join([*own, "short"])
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, line string, place int")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in lines.line_classes(frame).collect()}
    assert got == _line_classes(texts, lines.MIN_CHARS) and sum(v[2] for v in got.values()) > 50


def test_lines_of_any_length_equal_brute_force(spark):
    rng = random.Random(6)
    texts = {d: "\n".join("".join(rng.choice("ab é") for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 9)))) for _ in range(8)) for d in range(25)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in lines.line_classes(frame, min_chars=0).collect()}
    assert len(got) == 200 and got == _line_classes(texts, 0)


def test_op3_has_a_row_for_every_line(spark, docs):
    got = {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"], r["n_links"], r["kept"]) for r in queries.QUERIES["op3_line_dedup"](spark, SMALL).collect()}
    assert set(got) == {(i, k) for i, t in docs.items() for k in range(len(t.split("\n")))}
    short = {i: "\n".join(l for l in t.split("\n") if len(l) < 20) for i, t in docs.items()}
    repeats = sum(sum(len(l) < 20 for l in t.split("\n")) for t in docs.values()) - len({l for t in short.values() for l in t.split("\n")} )
    assert sum(not v[3] for v in got.values()) >= repeats > 0


def test_minimum_length_is_of_the_line_without_outer_blanks(spark):
    padded, near = " " * 20 + "Share", "exactly twenty chars"
    frame = spark.createDataFrame([(1, f"{padded}\n{near[:-1]}"), (2, f"{padded}\n{near}\nrest")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.drop_repeats(frame).collect()} == {1: f"{padded}\n{near[:-1]}", 2: f"{padded}\nrest"}


def test_lines_of_awkward_rows(spark):
    line, near = "this line is repeated here", "this line is repeated hera"
    rows = [(1, f"{line}\nunique words of the first", 0), (2, line, 0), (3, None, 5), (4, "", 0), (None, f"{near}\nx", 9), (6, f"{near}\nshort", 0), (6, f"{near}\nshort", 0), (7, "y" * 100_000, 0)]
    frame = spark.createDataFrame([(i, t, n, "c") for i, t, n in rows], "doc_id long, text string, n_chars long, _gone string")
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in lines.drop_repeats(frame).collect()), key=str)
    assert got == sorted([(1, rows[0][1], 0), (3, None, 5), (4, "", 0), (None, rows[4][1], 9), (6, "short", 5), (6, "short", 5), (7, rows[7][1], 0)], key=str)
    assert lines.line_classes(frame.filter("doc_id > 99")).count() == 0 and lines.drop_repeats(frame.filter("doc_id > 99")).count() == 0


def test_op3_plan_has_no_python(spark):
    plan = queries.QUERIES["op3_line_dedup"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# -- benchmark phrases


def _contamination(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if own := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def _found(frame):
    rows = frame.select("doc_id", "n_words", decontamination.hits(F.col("starts"), F.col("ends")).alias("n"), "items").collect()
    return sorted(((r["doc_id"], r["n_words"], r["n"], r["items"]) for r in rows), key=str)


@pytest.mark.parametrize("block_words, shard_words", [(10**6, 10**6), (40, 50)])
def test_phrases_equal_brute_force(spark, docs, block_words, shard_words, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard_words)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    items += [(900, "Same Same same"), (901, "same same"), (902, None), (903, "..."), (904, "same same")]
    texts = [*list(docs.items())[:120], (1000, "x same same same same y"), (1001, None), (1002, ""), (None, "SAME-same"), (1000, "x same same same same y")]
    frame = spark.createDataFrame([(i, t, "q", 3) for i, t in texts], "doc_id long, text string, items string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert _found(decontamination.contamination(frame, bench, block_words=block_words)) == _contamination(texts, items)


def test_phrases_of_empty_tables_and_proximity(spark):
    frame = spark.createDataFrame([(1, "gamma x alpha y beta"), (2, "alpha beta " + "z " * 40 + "gamma"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "alpha beta gamma")], "item_id long, text string")
    assert _found(decontamination.contamination(frame, bench.filter("item_id < 0"))) == [(1, 5, 0, []), (2, 43, 0, []), (3, 0, 0, [])]
    assert decontamination.contamination(frame.filter("doc_id < 0"), bench).count() == 0
    assert [r[3] for r in _found(decontamination.contamination(frame, bench, slack=5))] == [["5"], [], []]
    assert sorted(r["doc_id"] for r in decontamination.clean(frame, bench, slack=5).collect()) == [2, 3]


# -- mixing


def _fill(budget, nodes):
    """Shares of (capacity, weight) nodes: full ones first, by capacity for their weight."""
    out, left, weight = {}, budget, sum(w for _, w in nodes.values())
    for name, (cap, w) in sorted(nodes.items(), key=lambda x: (x[1][0] / x[1][1], x[0])):
        if cap * weight > left * w:
            break
        out[name], left, weight = cap, left - cap, weight - w
    return out | {name: left * w // weight for name, (_, w) in nodes.items() if name not in out}


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("a", "x", 10, 100), ("a", "y", 10, 1000), ("b", "x", 10, 5000), ("b", None, 10, 30)]
    frame = spark.createDataFrame(leaves, "top string, low string, docs long, tokens long")
    got = {(r["top"], r["low"]): r["given"] for r in mixing.budgets(frame, ["top", "low"], {("a",): 3}, 1200, 1).collect()}
    # a gets 900 of 1200: x takes its 100, its sibling y the missing 350; b gets 300, and its x what null lacks.
    assert got == {("a", "x"): 100, ("a", "y"): 800, ("b", "x"): 270, ("b", None): 30}
    over = {(r["top"], r["low"]): r["given"] for r in mixing.budgets(frame, ["top", "low"], {("a",): 3}, 4000, 1).collect()}
    assert over == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 2870, ("b", None): 30}


def test_selection_equals_a_plain_walk(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.choice(["p", "q", None]), rng.randrange(0, 9)) for i in range(500)] + [(600 + i, "a", "p", 5) for i in range(900)]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, top string, low string, tokens long, rest string")
    weights = {("a",): 1, ("b",): 2, ("c",): 8, ("c", "q"): 3}
    got = sorted((r["doc_id"], r["epoch"], r["take"]) for r in mixing.select(frame, ["top", "low"], weights, 0.4, 3, 11).collect())
    total = sum(r[3] for r in rows)
    tops = {t: (3 * sum(r[3] for r in rows if r[1] == t), weights[(t,)]) for t in "abc"}
    want = []
    for t, budget in _fill(int(total * 0.4), tops).items():
        low = {l or "~": (3 * sum(r[3] for r in rows if r[1:3] == (t, l)), weights.get((t, l), 1)) for l in ("p", "q", None)}
        for l, given in _fill(budget, low).items():
            own = [r for r in rows if r[1] == t and (r[2] or "~") == l and r[3]]
            full, rest = divmod(given, sum(r[3] for r in own))
            want += [(r[0], e, r[3]) for r in own for e in range(full)]
            for r in sorted(own, key=lambda r: (hashlib.md5(f"11:{full}:{r[0]}".encode()).hexdigest(), r[0])):
                if rest > 0:
                    want.append((r[0], full, min(rest, r[3])))
                    rest -= r[3]
    assert got == sorted(want)


def test_mixing_of_awkward_rows(spark):
    rows = [(1, None, 4), (1, None, 4), (None, "a", 3), (2, "a", 0), (3, "b", 10**9)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    got = mixing.select(frame, ["source"], {}, 0.5, 2).collect()
    assert sorted((r["doc_id"] or 0, r["take"]) for r in got if r["source"] != "b") == [(0, 3), (0, 3), (1, 4), (1, 4), (1, 4), (1, 4)]
    assert mixing.select(frame.filter("tokens < 0"), ["source"], {}, 0.5, 2).count() == 0
    assert {r["source"] for r in mixing.select(frame, ["source"], {("b",): 0}, 0.5, 2).collect()} == {None, "a"}


def test_native_plans_have_no_python(spark):
    for name in ("op1_mixing", "op9_chat_format"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- pipeline


def test_stages_on_their_own_input(spark, docs):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = frame.columns
    out = corpus_pipeline.drop_repeated_lines(spark, frame, SMALL)
    classes = _line_classes(docs, lines.MIN_CHARS)
    want = {}
    for i, t in docs.items():
        kept = [l for k, l in enumerate(t.split("\n")) if classes.get((i, k), (0, 0, 0, True))[3]]
        if len(kept) == len(t.split("\n")) or "\n".join(kept).strip():
            want[i] = "\n".join(kept)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == want and out.columns == columns
    near = corpus_pipeline.drop_near_copies(spark, frame, SMALL)
    groups = {r["component_id"] for r in queries.QUERIES["op8_simhash"](spark, SMALL).collect()}
    assert {r["doc_id"] for r in near.collect()} == groups and near.columns == columns
    clean = corpus_pipeline.drop_leaks(spark, frame, SMALL)
    dirty = {r["doc_id"] for r in queries.QUERIES["op7_decontamination"](spark, SMALL).filter("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(docs) - dirty and clean.columns == columns
    calm = corpus_pipeline.drop_toxic(spark, frame, SMALL)
    assert calm.columns == columns and 0 < calm.count() <= len(docs)


def test_mixing_stage_cuts_the_text_at_the_budget(spark, docs):
    long = " \t".join(f"t{i}" for i in range(5000))
    rows = [(i, f" {long} \n", "s1", "en", len(long) + 3) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    for source in (frame, spark.read.parquet(f"{SMALL}/documents.parquet")):
        whole = {r["doc_id"]: r["text"] for r in source.collect()}
        out = corpus_pipeline.mix(spark, source, SMALL).collect()
        for r in out:
            assert len(re.findall(mixing.TOKEN, r["text"])) == r["take"] and r["n_chars"] == len(r["text"]) and whole[r["doc_id"]].startswith(r["text"])
            assert r["take"] < r["tokens"] or r["text"] == whole[r["doc_id"]]
        assert any(r["take"] < r["tokens"] for r in out)


def test_pipeline_runs_whole_and_empty(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {"doc_id", "text", "epoch", "take"} <= set(rows[0].asDict()) and all(r["take"] <= r["tokens"] for r in rows)
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
