"""Operators on small literal tables, and against brute force."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from attesta import session
from attesta.operators import compose, corpus, coverage, dedup, digests, experiment, ledger, merge_review, prefix, provenance, ranking, refund, scoring, search, selection, skew
from attesta.session import materialise


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- ranking -------------------------------------------------------------------------------------


def test_row_numbers_equal_a_plain_numbering_with_hot_groups(spark):
    random.seed(1)
    data = [("hot" if random.random() < 0.6 else f"k{i % 5}", i * 7 % 1009) for i in range(1000)]
    data = list({(k, p): 1 for k, p in data})
    df = spark.createDataFrame(data, "k string, p long")
    got = rows(ranking.row_numbers(df.repartition(4), ["k"], "p", "n"), "k", "p", "n")
    want = []
    for key in {k for k, _ in data}:
        want += [(key, p, i + 1) for i, p in enumerate(sorted(p for k, p in data if k == key))]
    assert got == sorted(want)
    everywhere = spark.createDataFrame([(p,) for p in range(500)], "p long")
    numbered = ranking.row_numbers(everywhere.repartition(5), [], "p", "n")
    assert numbered.filter("n <> p + 1").count() == 0


def test_round_robin_and_interleave(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)] + [("c", i) for i in range(3)], "g string, i int")
    got = [(r.g, r.i) for r in ranking.round_robin(df, 6, "g", [F.col("i")]).collect()]
    assert got == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2)]
    left = spark.createDataFrame([(1, "l1"), (2, "l2"), (3, "l3")], "n int, v string")
    right = spark.createDataFrame([(1, "r1")], "n int, v string")
    assert [r.v for r in ranking.interleave(left, right, "n").collect()] == ["l1", "r1", "l2", "l3"]


# -- provenance ----------------------------------------------------------------------------------

LADDER = [
    ("https://blog.example.org/2026/sep/22/llm/", "pass", None),
    ("http://blog.example.org/2026/Sep/22/llm", "pass", None),
    ("https://www.blog.example.org/2026/sep/22/llm/?utm_source=n", "pass", None),
    ("https://blog.example.org/2026/sep/22/llm-v99-fake/", "cannot_verify", "unknown_variant"),
    ("https://blog.example.org/2026/sep/22/llm/never-existed", "cannot_verify", "unknown_variant"),
    ("https://blog.example.org/2026/sep", "cannot_verify", "unknown_variant"),
    ("https://example.com/made-up", "fail", "fabricated_source"),
    ("https://arxiv.org/abs/2609.24974v1", "pass", None),
    ("https://news.example.com/business/x-c5ebcddc3", "pass", None),
    ("https://news.example.com/business/x-c5ebcddc3?other=1", "fail", "fabricated_source"),
    ("https://x.com/a/b/c", "fail", "fabricated_source"),
    ("", "fail", "malformed"),
]


def test_url_ladder(spark):
    raw = [
        "https://blog.example.org/2026/sep/22/llm", "https://arxiv.org/abs/2609.24974",
        "https://news.example.com/business/x-c5ebcddc3?st=qk6&reflink=web", "https://x.com/a",
    ]
    known = provenance.known_urls(spark.createDataFrame([(1, u) for u in raw], "day int, url string"))
    cited = spark.createDataFrame([(1, u) for u, _, _ in LADDER], "day int, url string")
    got = {r.url: (r.decision, r.failure_class, r.drift) for r in provenance.classify_citations(cited, known).collect()}
    assert {u: got[u][:2] for u, _, _ in LADDER} == {u: (d, c) for u, d, c in LADDER}
    assert got["https://arxiv.org/abs/2609.24974v1"][2] == "arxiv_version"
    assert got["https://news.example.com/business/x-c5ebcddc3"][2] == "query_suffix"


def brute_ladder(target, known):
    if not target:
        return "fail"
    if target in known:
        return "pass"
    if "?" not in target and any(k.startswith(target + "?") for k in known):
        return "pass"
    if any(len(k) >= 20 and (target.startswith(k) or k.startswith(target)) for k in known):
        return "cannot_verify"
    return "fail"


def brute_legacy(target, known):
    base = target.split("?")[0]
    if target in known or base in known:
        return "pass"
    return "pass" if len(base) > 20 and any(k.startswith(base) or base.startswith(k) for k in known) else "fail"


def test_ladder_matches_brute_force(spark):
    random.seed(3)

    def url():
        return "abc.org/" + "/".join(random.choice(["longsegment", "x", "yy"]) for _ in range(random.randint(1, 4))) + random.choice(["", "", "?q=1", "?q=2&r=3"])

    known = [(d, url()) for d in range(3) for _ in range(12)]
    cited = [(d, url()) for d in range(3) for _ in range(60)]
    known_df = provenance.known_urls(spark.createDataFrame(known, "day int, url string"))
    cited_df = spark.createDataFrame(cited, "day int, url string").distinct()
    per_day = {d: {u for e, u in known if e == d} for d in range(3)}
    typed = {(r.day, r.url): r.decision for r in provenance.classify_citations(cited_df, known_df).collect()}
    legacy = {(r.day, r.url): r.decision for r in provenance.legacy_citations(cited_df, known_df).collect()}
    assert typed == {(d, u): brute_ladder(u, per_day[d]) for d, u in set(cited)}
    assert legacy == {(d, u): brute_legacy(u, per_day[d]) for d, u in set(cited)}


def test_prefix_matches_equal_brute_force(spark):
    rng = random.Random(4)
    known = sorted({(d, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for d in (1, 2) for _ in range(60)})
    asked = sorted({(d, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for d in (1, 2) for _ in range(60)})
    k = spark.createDataFrame(known, "day int, canonical string")
    t = spark.createDataFrame(asked, "day int, target string")
    longer = {(d, x): [c for e, c in known if e == d and c != x and c.startswith(x)] for d, x in asked if len(x) >= 2}
    shorter = {(d, x): [c for e, c in known if e == d and c != x and x.startswith(c) and len(c) >= 3] for d, x in asked}
    got = {(r.day, r.target): r.real for r in prefix.nearest_continuing(t, "target", k, 2).collect()}
    assert got == {key: min(v, key=lambda c: (-len(c), c)) for key, v in longer.items() if v}
    got = {(r.day, r.target): r.real for r in prefix.nearest_extended(t, "target", k, 3).collect()}
    assert got == {key: max(v, key=len) for key, v in shorter.items() if v}


def test_prefix_join_across_ranges(spark):
    """Open strings travel over many ranges, over days, and through equal strings of both sides."""
    rng = random.Random(8)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        for alphabet, n in (("a", 40), ("ab", 150), ("a/é", 150)):
            draw = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 12)))  # noqa: E731, B023
            known = sorted({(d, draw()) for d in (1, 2, 3) for _ in range(n)})
            asked = sorted({(d, draw()) for d in (1, 2, 4) for _ in range(n)})
            k = spark.createDataFrame([*known, (None, "a"), (1, None)], "day int, canonical string")
            t = spark.createDataFrame([*asked, (None, "ab"), (2, None)], "day int, target string")
            got = {(r.day, r.target): (r.extends, r.truncates) for r in prefix.nearest(t, "target", k).collect()}
            want = {}
            for d, x in asked:
                near = [c for e, c in known if e == d and c != x]
                below, above = [c for c in near if x.startswith(c)], [c for c in near if c.startswith(x)]
                if below or above:
                    want[d, x] = (max(below, key=len, default=None), min(above, key=lambda c: (-len(c), c), default=None))
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)
    assert prefix.nearest(t.limit(0), "target", k).count() == 0 and prefix.nearest(t, "target", k.limit(0)).count() == 0


def _shuffled(df):
    """Bytes of shuffle that running a plan writes, by its exchanges."""
    df.collect()
    sizes, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        metrics = node.metrics()
        if "Exchange" in node.nodeName() and metrics.contains("dataSize"):
            sizes += metrics.apply("dataSize").value()
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return sizes


def test_prefix_join_shuffles_strings_once_and_not_once_for_each_length(spark, monkeypatch):
    urls = spark.range(2_000).select(F.lit(1).alias("day"), F.concat(F.lit("g.org/"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 31), F.col("id")).alias("canonical"))
    asked = urls.select("day", F.expr("substring(canonical, 1, 1500 + crc32(canonical) % 400)").alias("target"))
    tail = []
    monkeypatch.setattr(prefix, "materialise", lambda df, name: tail.append(df) or materialise(df, name))
    found = prefix.nearest(asked, "target", urls)
    written = urls.unionByName(asked.withColumnRenamed("target", "canonical")).agg(F.sum(F.octet_length("canonical"))).first()[0]
    assert found.filter("truncates is not null").count() == 2_000
    assert _shuffled(found.groupBy().count()) + _shuffled(tail[0]) < 3 * written
    hot = spark.range(20_000).select(F.lit(1).alias("day"), F.format_string("g.org/watch/%05d", F.col("id")).alias("canonical"))
    short = spark.createDataFrame([(1, "g"), (1, "g.org/watch")], "day int, target string")
    got = {r.target: r.real for r in prefix.nearest_continuing(short, "target", hot, 1).collect()}
    assert got == {"g": "g.org/watch/00000", "g.org/watch": "g.org/watch/00000"}


def test_stale_days_look_back(spark):
    known = spark.createDataFrame([(d, "u.org/a") for d in range(1, 8)], "day int, canonical string")
    failed = spark.createDataFrame([(9, "u.org/a"), (6, "u.org/a")], "day int, target string")
    got = {r.day: r.other_days for r in provenance.stale_days(failed, known, 3).collect()}
    assert got == {9: [5, 6, 7], 6: [4, 5, 7]}
    assert {r.day: r.other_days for r in provenance.stale_days(failed, known, None).collect()} == {9: [1, 2, 3, 4, 5, 6, 7], 6: [1, 2, 3, 4, 5, 7]}
    assert {r.day: r.other_days for r in provenance.stale_days(failed, known, 30).collect()} == {9: [1, 2, 3, 4, 5, 6, 7], 6: [1, 2, 3, 4, 5, 7]}
    assert provenance.stale_days(failed, known.limit(0), 3).count() == 0


def test_stale_days_read_only_the_newest_partitions(spark, tmp_path):
    spark.range(40).selectExpr("cast(id as int) day", "'u.org/a' canonical").write.partitionBy("day").parquet(str(tmp_path / "known"))
    failed = spark.createDataFrame([(39, "u.org/a")], "day int, target string")
    found = provenance.stale_days(failed, spark.read.parquet(str(tmp_path / "known")), 3)
    assert found.first().other_days == [36, 37, 38]
    filters = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "36" in filters and "39" in filters and "35" not in filters


def test_empty_day_fails(spark):
    none = spark.createDataFrame([], "day int, decision string")
    days = spark.createDataFrame([(1,)], "day int")
    row = provenance.verify_days(none, days).first()
    assert (row.decision, row.failure_class, row.verifiable_ratio) == ("fail", "malformed", 1.0)


# -- duplicates ----------------------------------------------------------------------------------

COLUMNS = "article string, rank long, location string, section string, title_zh string, title_en string, body_zh string, body_en string, urls array<string>"


def brute_score(a, b):
    import re

    def toks(t):
        t = t.lower()
        out = set(re.findall(r"[a-z0-9]{2,}", t))
        for run in re.findall("[一-鿿]+", t):
            out |= {run} if len(run) == 1 else {run[i:i + 2] for i in range(len(run) - 1)}
        return out

    def jac(x, y):
        return len(x & y) / len(x | y) if x and y else 0.0

    norm = lambda t: re.sub(r"[\W_]+", "", t.lower())

    def title(x, y):
        if not norm(x) or not norm(y):
            return 0.0, 0.0
        if norm(x) == norm(y):
            return 0.95, 1.0
        j = jac(toks(x), toks(y))
        return (0.85 if j >= 0.8 else 0.72 if j >= 0.65 else 0.62 if j >= 0.5 else 0.5 if j >= 0.35 else 0.2 * j), j

    scores = [title(a[i], b[i]) for i in (4, 5)]
    score, overlap = max(s for s, _ in scores), max(o for _, o in scores)
    if set(a[8]) & set(b[8]):
        if overlap >= (0.4 if a[3] == b[3] else 0.75):
            score = max(score, 0.9)
        elif score < 0.6 and overlap >= 0.3:
            score = 0.66
    if score < 0.6 and max(jac(toks(a[6]), toks(b[6])), jac(toks(a[7]), toks(b[7]))) >= 0.6:
        score = 0.62
    return score


def make_entries(seed, n):
    random.seed(seed)
    word = [f"w{i}" for i in range(9)] + ["中文标题", "新闻快报"]
    out = []
    for i in range(n):
        if out and random.random() < 0.3:
            copy = list(random.choice(out))
            copy[1], copy[2] = i, f"e{i}"
            out.append(tuple(copy))
            continue
        title = lambda: " ".join(random.sample(word, random.randint(0, 4)))
        out.append((f"a{i % 2}", i, f"e{i}", random.choice("st"), title(), title(), " ".join(random.sample(word, 6)),
                    " ".join(random.sample(word, 5)), random.sample(["u1", "u2", "u3"], random.randint(0, 2))))
    return out


@pytest.mark.parametrize("seed, limits", [(1, {}), (2, {}), (3, {"hot": 1, "block": 3})])
def test_dedup_matches_brute_force(spark, seed, limits):
    entries = make_entries(seed, 60)
    df = spark.createDataFrame(entries, COLUMNS)
    classes = dedup.entry_classes(df)
    pairs = dedup.class_pairs(classes, **limits).persist()
    dropped = dedup.resolve(df, classes, pairs)
    every = [(a, b, brute_score(a, b)) for a, b in itertools.combinations(sorted(entries, key=lambda e: e[1]), 2) if a[0] == b[0]]
    hard = sorted([p for p in every if p[2] >= 0.86], key=lambda p: -p[2])
    want = {}
    for a, b, score in hard:
        want.setdefault((b[0], b[1]), (a[2], round(score, 3)))
    got = {(r.article, r["rank"]): (r.kept, round(r.score, 3)) for r in dropped.collect()}
    assert got == want
    gate = {r.article: r for r in dedup.duplicate_gate(df, classes, pairs, dropped).collect()}
    for article in ("a0", "a1"):
        mine = [p for p in every if p[0][0] == article]
        assert gate[article].duplicate_pairs == sum(p[2] >= 0.86 for p in mine)
        assert gate[article].borderline_pairs == sum(0.6 <= p[2] < 0.86 for p in mine)
        assert round(gate[article].max_pair_score, 3) == round(max([p[2] for p in mine if p[2] >= 0.6] or [0.0]), 3)


def test_dedup_output_stays_linear_for_copies(spark):
    entries = [("a", i, f"e{i}", "s", "", "same title here", "", "same body text", ["u"]) for i in range(300)]
    df = spark.createDataFrame(entries, COLUMNS)
    classes = dedup.entry_classes(df)
    assert classes.count() == 1
    pairs = dedup.class_pairs(classes)
    assert pairs.count() == 0
    assert dedup.title_groups(classes).first().pairs == 300 * 299 // 2
    assert dedup.resolve(df, classes, pairs).count() == 299


def test_digest_tree_names_changed_leaves_whatever_the_partitions(spark):
    import hashlib

    rows = [f"line {i % 300}" for i in range(400)] + [None, ""]
    frame = spark.createDataFrame([(r,) for r in rows], "line string")
    tree = {(r.level, r.node): (r.digest, r.lines) for r in digests.digest_tree(frame, F.col("line"), 1).collect()}
    again = {(r.level, r.node): (r.digest, r.lines) for r in digests.digest_tree(frame.repartition(7), F.col("line"), 1).collect()}
    assert tree == again and tree[0, ""][1] == 402
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    counted = {}
    for r in rows:
        counted[sha(r or "")] = counted.get(sha(r or ""), 0) + 1
    leaves = {}
    for h in sorted(counted):
        leaves.setdefault(h[0], []).append(f"{h}:{counted[h]}")
    assert {n: d for (k, n), (d, _) in tree.items() if k == 1} == {n: sha("\n".join(v)) for n, v in leaves.items()}
    assert tree[0, ""][0] == sha("\n".join(f"{n}:{sha(chr(10).join(leaves[n]))}" for n in sorted(leaves)))
    other = spark.createDataFrame([(r,) for r in rows[:-3]] + [("line 299x",)], "line string")
    a, b = digests.digest_tree(frame, F.col("line"), 2), digests.digest_tree(other, F.col("line"), 2)
    gone = {sha("line 99")[:2], sha("")[:2]}
    assert {r.node for r in digests.changed_leaves(a, b).collect()} == gone | {sha("line 299x")[:2]}
    assert digests.changed_leaves(a, a).count() == 0 and digests.changed_leaves(a.limit(0), a.limit(0)).count() == 0
    assert digests.changed_leaves(a.limit(0), b).count() == b.filter("level = 2").count()


def test_snippet_holds_most_distinct_terms(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["aa", "BB,", "(cc)", "dd", "x", "y", "z", "aa-bb"]) for _ in range(rng.randrange(0, 40))) for _ in range(200)] + [None, "", "aa"]
    terms = ["aa", "bb", "cc", "dd"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in frame.select("i", search.snippet(F.col("t"), terms, 5).alias("s")).collect()}
    for i, t in enumerate(texts):
        parts = (t or "").split()
        bare = [p.lower().strip("(),-") for p in parts]
        best, start = 0, 0
        for end, word in enumerate(bare):
            inside = {w: k for k, w in enumerate(bare[: end + 1]) if w in terms and k > end - 5}
            if word in terms and len(inside) > best:
                best, start = len(inside), min(inside.values())
        assert got[i] == " ".join(f"[{p}]" if b in terms else p for p, b in list(zip(parts, bare))[start : start + 5])


@pytest.mark.parametrize("calls", [0, 1, 3, 8])
def test_judged_pairs_equal_an_ordered_walk(spark, calls):
    rng = random.Random(calls)
    pairs = {(f"a{rng.randrange(4)}", x, x + 1 + rng.randrange(4)): rng.choice([0.62, 0.66, 0.7]) for x in range(14) for _ in range(6)}
    answers = {key: rng.choice([True, False, None]) for key in pairs if rng.random() < 0.9}
    want = {}
    for article in {a for a, _, _ in pairs}:
        used, gone = 0, set()
        for key in sorted((k for k in pairs if k[0] == article), key=lambda k: (-pairs[k], k[1], k[2])):
            if key[2] in gone:
                want[key] = (None, "skipped")
            elif used >= calls:
                want[key] = (None, "unjudged")
            else:
                used += 1
                same = answers.get(key)
                want[key] = (used, "dropped" if same else "unjudged" if same is None else "distinct")
                gone |= {key[2]} if same else set()
    p = spark.createDataFrame([(*k, f"e{k[1]}", f"e{k[2]}", s, "borderline") for k, s in pairs.items()], "article string, rank_a long, rank_b long, location_a string, location_b string, score double, verdict string")
    a = spark.createDataFrame([(*k, s) for k, s in answers.items()], "article string, rank_a long, rank_b long, same boolean")
    judged = dedup.judged_pairs(p, a, calls)
    rows = judged.collect()
    assert {(r.article, r.rank_a, r.rank_b): (r.call, r.outcome) for r in rows} == want and len(rows) == len(pairs)
    hard = spark.createDataFrame([("a0", 99, "e99", "e1", 0.95)], "article string, rank long, location string, kept string, score double")
    gone = dedup.all_dropped(hard, judged).collect()
    assert sum(r.source == "model" for r in gone) == sum(o == "dropped" for _, o in want.values()) == len({(r.article, r.location) for r in gone}) - 1
    told = {r.article: r for r in dedup.judged_metrics(p, hard, judged).collect()}
    assert sum(r.judged for r in told.values()) == sum(c is not None for c, _ in want.values()) and told["a0"].clear == 0
    asked = dedup.judged_pairs(p, None, calls).filter("call is not null").collect()
    assert len(asked) == sum(min(calls, sum(k[0] == f"a{i}" for k in pairs)) for i in range(4)) and all(r.outcome == "unjudged" for r in asked)


def test_frequent_tokens_meet_in_cells(spark):
    """Hundred thousand titles share a word, in nine lengths; only those that can be similar are met, and every similar one is."""
    rest = F.transform(F.sequence(F.lit(1), (F.col("id") % 9 + 1).cast("int")), lambda k: F.concat(F.lit("x"), F.col("id"), F.lit("y"), k))
    titles = spark.range(100_000).select((F.col("id") + 10).alias("rank"), F.concat_ws(" ", F.lit("hot"), rest).alias("title_en"))
    planted = [(0, "hot x7y1 x7y2"), (1, "hot"), (2, "hot x18y1 other"), (3, "hot new words here"), (4, "hot new words there")]
    every = spark.createDataFrame(planted, "rank long, title_en string").unionByName(titles)
    entries = every.select(
        F.lit("a").alias("article"), "rank", F.col("rank").cast("string").alias("location"), F.lit("s").alias("section"), F.lit("").alias("title_zh"), "title_en",
        F.lit("").alias("body_zh"), F.lit("").alias("body_en"), F.array().cast("array<string>").alias("urls"),
    )
    pairs = dedup.class_pairs(dedup.entry_classes(entries)).select("rank_a", "rank_b", "score")
    near = {(r.rank_a, r.rank_b): r.score for r in pairs.filter("rank_b < 10 or rank_a <> 1").collect()}
    # 0 shares two of its three words with entry 17's eight more: 3/9; 2 shares two of its three with 28's two: 2/3.
    assert near == {(2, 28): 0.72, (3, 4): 0.62}
    single = pairs.filter("rank_a = 1 and rank_b >= 10").agg(F.count("*"), F.min("score"), F.max("score")).first()
    assert tuple(single) == (11_112, 0.62, 0.62)  # {hot} against {hot, one word}


def test_blocks_meet_every_pair_once_and_stay_small(spark):
    a, b = (spark.range(n).selectExpr("if(id < 0, 'z', 'k') key", f"id {name}") for n, name in ((730, "a"), (95, "b")))
    counts = spark.createDataFrame([("k", 730, 95), ("z", 1, 1)], "key string, n_a long, n_b long")
    left = skew.blocked(skew.attach(a, ["key"], counts, "n_a"), F.col("a"), F.col("n_a"), F.col("n_b"), "i", "j", 50).select("key", "a", "i", "j")
    right = skew.blocked(skew.attach(b, ["key"], counts, "n_b"), F.col("b"), F.col("n_b"), F.col("n_a"), "j", "i", 50).select("key", "b", "i", "j")
    met = left.join(right, ["key", "i", "j"])
    assert met.count() == met.select("a", "b").distinct().count() == 730 * 95
    assert max(r["count"] for r in left.groupBy("i", "j").count().collect()) < 100
    assert skew.attach(a, ["key"], counts, "n_a", share=1)._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") >= 2
    assert skew.attach(a, ["key"], counts.filter("key = 'none'"), "n_a").count() == 0


# -- measures ------------------------------------------------------------------------------------


def samples(spark, values):
    return spark.createDataFrame(values, "sample_id string, kind string, expect string, probability double, rule_probability double")


def test_sweep_golden_points(spark):
    corpus_df = samples(spark, [("a", "k", "pass", 0.9, 1.0), ("b", "k", "pass", 0.8, 1.0), ("c", "k", "not_pass", 0.4, 0.0), ("d", "k", "not_pass", 0.3, None)])
    counts = scoring.probability_counts(corpus_df)
    curve = {r.threshold: r for r in scoring.sweep(counts, [0.1, 0.2, 0.35, 0.5, 0.7, 0.85]).collect()}
    assert curve[0.2].false_pass_count == 2 and curve[0.85].false_fail_count == 1
    assert scoring.operating_point(scoring.sweep(counts, [0.1, 0.35, 0.5, 0.7])).first().threshold == 0.5
    assert scoring.best_point(scoring.sweep(counts, [0.1, 0.5, 0.85])).first().threshold == 0.5
    assert scoring.auc(counts).first().auc == 1.0
    tied = scoring.probability_counts(samples(spark, [("a", "k", "pass", 0.5, None), ("b", "k", "not_pass", 0.5, None)]))
    assert scoring.auc(tied).first().auc == 0.5
    one_sided = scoring.probability_counts(samples(spark, [("a", "k", "pass", 0.5, None)]))
    assert scoring.auc(one_sided).first().auc is None
    extremes = scoring.probability_counts(samples(spark, [(str(i), "k", "pass", p, None) for i, p in enumerate([1.0, 0.0, 0.4, None])]))
    assert scoring.degeneracy(extremes).first().extreme_share == 0.6667


def test_auc_matches_pair_counting(spark):
    random.seed(5)
    data = [(str(i), "k", random.choice(["pass", "not_pass"]), random.choice([None, round(random.random(), 4), 0.5]), None) for i in range(300)]
    pos = [p for _, _, e, p, _ in data if e == "pass" and p is not None]
    neg = [p for _, _, e, p, _ in data if e != "pass" and p is not None]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(scoring.auc(scoring.probability_counts(samples(spark, data))).first().auc - want) <= 5e-5


def test_agreement_names_the_side(spark):
    data = [("a", "k", "pass", 0.9, 1.0), ("b", "k", "pass", 0.9, None), ("c", "k", "pass", None, 1.0), ("d", "k", "pass", 0.9, 0.0)]
    row = scoring.rule_agreement(samples(spark, data)).first()
    assert (row.agree, row.judge_only_decided, row.rule_only_decided, row.agreement) == (1, 1, 2, 0.25)


def test_recommendation_cases(spark):
    good = [(f"p{i}", "k", "pass", 0.9, None) for i in range(20)] + [(f"n{i}", "k", "not_pass", 0.1, 0.0) for i in range(20)]
    row = scoring.recommendation(samples(spark, good), [0.0, 0.5, 1.0]).first()
    assert (row.verdict, row.holdout, row.judge_threshold) == ("judge_wins", True, 0.5)
    same = [(s, k, e, p, 1.0 if e == "pass" else 0.0) for s, k, e, p, _ in good]
    assert scoring.recommendation(samples(spark, same), [0.5]).first().verdict == "rule_wins"
    noise = [(s, k, e, 0.5, r) for s, k, e, _, r in good]
    assert scoring.recommendation(samples(spark, noise), [0.5]).first().verdict == "unusable"
    lonely = [("a", "k", "pass", 0.9, 1.0)]
    row = scoring.recommendation(samples(spark, lonely), [0.5]).first()
    assert (row.verdict, row.holdout) == ("no_point", False)


def test_fingerprints(spark):
    import hashlib

    data = [("s2", "legit", 1), ("s1", "drift", 1), ("s3", "legit", 2)]
    df = spark.createDataFrame(data, "sample_id string, kind string, day int")
    day1 = hashlib.sha256("\n".join(sorted(["s2|legit|1", "s1|drift|1"])).encode()).hexdigest()[:16]
    assert {r.day: r.fingerprint for r in scoring.day_fingerprints(df).collect()}[1] == day1
    whole = scoring.corpus_fingerprint(df).first().fingerprint
    assert scoring.corpus_fingerprint(df.orderBy(F.desc("sample_id")).repartition(3)).first().fingerprint == whole
    assert scoring.corpus_fingerprint(df.filter("day = 1")).first().fingerprint != whole


def test_baseline(spark):
    shape = "matcher string, fingerprint string, false_pass_rate double, false_fail_rate double"
    now = spark.createDataFrame([("m", "f", 0.2, None), ("x", "g", 0.9, 0.9)], shape)
    frozen = spark.createDataFrame([("m", "f", 0.1, 0.1), ("x", "f", 0.1, 0.1)], shape)
    got = {(r.matcher, r.metric): (r.corpus_changed, r.regression) for r in scoring.check_baseline(now, frozen).collect()}
    assert got[("m", "false_pass_rate")] == (False, True)
    assert got[("m", "false_fail_rate")] == (False, None)
    assert got[("x", "false_pass_rate")] == (True, False)


def brute_stale(cited, known, day, cap):
    from urllib.parse import urlsplit  # noqa: F401

    canon = lambda u: u.removeprefix("https://")
    mine = {k for d, k in known if d == day}
    paths = {k.split("?")[0] for k in mine}
    seen, out = set(), []
    for other, _, url in sorted(cited, key=lambda c: c[1]):
        c = canon(url)
        if other == day or c.split("?")[0] in paths or c in seen:
            continue
        seen.add(c)
        out.append(url)
    return out[:cap]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_corpus_stale_pool_matches_brute_force(spark, seed):
    random.seed(seed)
    cited = [(p // 8, p, "https://h.org/" + random.choice("abcdefghij") + random.choice(["", "?x=1"])) for p in range(40)]
    known = sorted({(d, "h.org/" + random.choice("abcdefghij") + random.choice(["", "?x=1"])) for d in range(5) for _ in range(4)})
    got = corpus.build_corpus(
        spark.createDataFrame(cited, "day int, position long, url string"), spark.createDataFrame(known, "day int, canonical string"), 3
    )
    stale = {}
    for r in got.filter("kind = 'stale_evidence'").orderBy("sample_id").collect():
        stale.setdefault(r.day, []).append(r.url)
    days = {d for d, _ in known}
    assert stale == {d: s for d in days if (s := brute_stale(cited, known, d, 3))}
    assert got.groupBy("sample_id").count().filter("count > 1").count() == 0


def test_selection_golden(spark):
    gold = [("selected", "select")] * 4 + [("unselected", "select")] * 2 + [("unselected", "reject")] * 4 + [("selected", "either"), ("selected", "")]
    df = spark.createDataFrame([("d", b, g) for b, g in gold], "day string, bucket string, gold string")
    total = selection.score_sheet(df).filter("is_total = 1").first()
    assert (total.tp, total.fp, total.fn, total.tn, total.precision, total.recall) == (4, 0, 2, 4, 1.0, 0.666667)
    blank = selection.score_sheet(df.withColumn("gold", F.lit(""))).filter("is_total = 1").first()
    assert (blank.labelled, blank.precision, blank.accuracy) == (0, None, None)


# -- refunds and merges --------------------------------------------------------------------------


def test_refund_book(spark):
    orders = spark.createDataFrame([
        ("o1", "delivered", 5, "USD", "p1"), ("o2", "delivered", 41, "USD", "p1"), ("o3", "delivered", 5, "USD", "p9"),
        ("o4", "in_transit", 5, "USD", "p1"), ("o5", "delivered", 5, "EUR", "p9"), ("o6", None, None, "USD", None)],
        "order_id string, status string, days_since_delivery int, currency string, payment_ref string")
    ledger_df = spark.createDataFrame([("p1",), ("p1",)], "payment_ref string")
    decided = refund.decide(orders, ledger_df, ["delivered"], 30, "USD")
    assert rows(decided, "order_id", "decision", "action") == [
        ("o1", "pass", "approve"), ("o2", "fail", "deny"), ("o3", "cannot_verify", "deny"), ("o4", "fail", "deny"),
        ("o5", "cannot_verify", "deny"), ("o6", "cannot_verify", "deny")]
    proposals = spark.createDataFrame([(f"o{i}", "approve", "r") for i in (1, 2, 3, 4, 5, 99)], "order_id string, proposed_action string, proposed_reason string")
    assert refund.overrides(decided, proposals).filter("overridden").count() == 4
    assert rows(refund.orphan_proposals(decided, proposals), "order_id") == [("o99",)]


CHECKS = "order_id string, decision string, action string, checks array<struct<check:string,decision:string>>, failed_checks array<string>, unverified_checks array<string>"


def claim(decision, action, verdicts, failed=(), unverified=()):
    names = ("order_status", "refund_window", "payment_reference", "currency")
    return (decision, action, [(n, v) for n, v in zip(names, verdicts)], list(failed), list(unverified))


@pytest.mark.parametrize("row, expected", [
    (claim("pass", "approve", ["pass"] * 4), []),
    (claim("maybe", "approve", ["pass"] * 4), ["unknown_decision"]),
    (claim("pass", "pay", ["pass"] * 4), ["unknown_action"]),
    (claim("pass", "approve", []), ["missing_checks"]),
    (claim("pass", "approve", ["pass"] * 3), ["missing_checks"]),
    (claim("pass", "approve", ["pass", "fail", "pass", "pass"], ["refund_window"]), ["contradicts_checks"]),
    (claim("pass", "deny", ["pass"] * 4), ["pass_not_approved"]),
    (claim("fail", "escalate", ["fail", "pass", "pass", "pass"], ["order_status"]), ["fail_not_denied"]),
    (claim("cannot_verify", "approve", ["cannot_verify", "pass", "pass", "pass"], [], ["order_status"]), ["fail_closed_violated"]),
    (claim("cannot_verify", "escalate", ["cannot_verify", "pass", "pass", "pass"], [], ["order_status"]), []),
    (claim("fail", "deny", ["fail", "pass", "pass", "pass"], [], []), ["failed_checks_mismatch"]),
    (claim("pass", "approve", ["pass", "pass", "pass", "sure"]), ["missing_checks", "unknown_check_decision"]),
])
def test_refund_artifact_probes(spark, row, expected):
    df = spark.createDataFrame([("o", *row)], CHECKS)
    assert sorted(r.violation for r in refund.artifact_violations(df).collect()) == expected


def test_refund_duplicate_and_unknown_checks(spark):
    good = [(n, "pass") for n in ("order_status", "refund_window", "payment_reference", "currency")]
    df = spark.createDataFrame([("o", "pass", "approve", good + [("currency", "pass")], [], []), ("q", "pass", "approve", good + [("vibes", "pass")], [], [])], CHECKS)
    assert rows(refund.artifact_violations(df), "order_id", "violation") == [("o", "duplicate_checks"), ("q", "unknown_check")]


@pytest.mark.parametrize("checks, merge, expected", [
    ({"TESTS_PASS": "pass", "ARCHITECTURE_OK": "pass", "NO_UNINTENDED_SCOPE": "pass"}, "allow", "pass"),
    ({"TESTS_PASS": "pass", "ARCHITECTURE_OK": "pass"}, "allow", "fail"),
    ({"TESTS_PASS": "pass", "ARCHITECTURE_OK": "cannot_verify", "NO_UNINTENDED_SCOPE": "pass"}, "allow", "fail"),
    ({"TESTS_PASS": "abstain", "ARCHITECTURE_OK": "pass", "NO_UNINTENDED_SCOPE": "pass"}, "allow", "fail"),
    ({"TESTS_PASS": None, "ARCHITECTURE_OK": "pass", "NO_UNINTENDED_SCOPE": "pass"}, "allow", "fail"),
    ({"TESTS_PASS": "pass", "ARCHITECTURE_OK": "pass", "NO_UNINTENDED_SCOPE": "pass", "EXTRA": "pass"}, "allow", "fail"),
    ({"TESTS_PASS": "pass", "ARCHITECTURE_OK": "pass", "NO_UNINTENDED_SCOPE": "pass"}, "block", "fail"),
    ({}, "allow", "fail"),
])
def test_merge_gate(spark, checks, merge, expected):
    df = spark.createDataFrame([(1, c, d) for c, d in checks.items()], "change_id int, check string, decision string")
    reviews = spark.createDataFrame([(1, merge)], "change_id int, merge string")
    assert merge_review.merge_gate(df, reviews).first().decision == expected


def test_log_and_scope_samples(spark):
    log = "@@abc123\tfirst\twith tab\n1\t2\tsrc/a.py\n3\t4\tdocs/b.md\n\n@@def456\tempty\n@@0123456789\tone\n5\t6\tarea/c.py\n"
    commits = merge_review.parse_log(spark.createDataFrame([(log,)], "text string"))
    assert rows(commits.filter("path is not null"), "sha", "path") == [("0123456789", "area/c.py"), ("abc123", "docs/b.md"), ("abc123", "src/a.py")]
    made = merge_review.scope_samples(commits, ("area", "tools"))
    got = {r.sample_id: (r.expect, r.foreign_area) for r in made.collect()}
    assert got["scope-legit-1-abc123"] == ("pass", None)
    assert got["scope-scope_extension-1-abc123"] == ("not_pass", None)
    assert got["scope-foreign_file-2-01234567"] == ("not_pass", "tools")
    ruled = {r.sample_id: r.rule_probability for r in merge_review.scope_rule_probability(merge_review.scope_files(made, commits)).collect()}
    assert ruled["scope-legit-2-01234567"] == 1.0 and ruled["scope-foreign_file-1-abc123"] == 0.0 and ruled["scope-scope_extension-1-abc123"] == 0.0


def test_test_runner_output(spark):
    df = spark.createDataFrame([("Ran 5 tests", 0), ("Ran 5 tests", 1), ("Ran 0 tests", 0), ("crash", 1), (None, 0)], "o string, c int")
    assert [r[0] for r in df.select(merge_review.check_tests(F.col("o"), F.col("c"))).collect()] == ["pass", "fail", "cannot_verify", "cannot_verify", "cannot_verify"]


# -- coverage, ledger, experiments, search, compose ----------------------------------------------


def test_pool_keeps_rank_gaps_and_ties(spark):
    shape = "day string, bucket string, source string, position int, title string, url string, text string, date string, signal_number double, signal_text string"
    data = [
        ("d1", "hn", "HN", 0, "a", "https://a.org/1", None, None, 5.0, None), ("d1", "hn", "HN", 1, "b", "", None, None, 9.0, None),
        ("d1", "hn", "HN", 2, "c", "https://a.org/2", None, None, 5.0, None), ("d1", "arxiv", "arXiv", 0, "p", "https://p.org/1", None, None, None, "2026-01-01"),
        ("d1", "arxiv", "arXiv", 1, "q", "https://p.org/2", None, None, None, "2026-01-02"),
        ("d1", "tweets_recent", "X", 0, "t", "https://x.org/1", "x" * 50, "d0", 3.0, None), ("d1", "tweets_recent", "X", 1, "t", "https://x.org/2", "short", "d1", 2.0, None),
    ]
    pool = coverage.ranked_pool(spark.createDataFrame(data, shape), 10)
    assert rows(pool.filter("not off_window"), "url", "rank_in_source") == [
        ("https://a.org/1", 2), ("https://a.org/2", 3), ("https://p.org/1", 2), ("https://p.org/2", 1)]
    cited = spark.createDataFrame([("d1", "a.org/1"), ("d1", "p.org/2?x=1")], "day string, canonical string")
    marked = coverage.mark_covered(pool.withColumn("on_topic", F.lit(None).cast("boolean")), cited)
    assert rows(marked.filter("covered"), "url") == [("https://a.org/1",), ("https://p.org/2",)]
    gate = coverage.coverage_gate(marked).first()
    assert (gate["pool"], gate.missed, gate.top3_missed, gate.top3_missed_all, gate.off_window_dropped) == (4, 2, 0, 2, 1)
    assert [r[0] for r in spark.range(1).select(coverage.on_topic(F.lit("x"), None)).collect()] == [None]


def test_ledger_rules(spark):
    shape = "run_id string, task string, target_date string, status string, dry_run boolean, started_at timestamp, finished_at timestamp, tokens_in long, tokens_out long, duration_ms long, human_intervention boolean, cost_usd double"
    from datetime import datetime as dt

    data = [("r1", "t", "d", "success", False, dt(2026, 1, 1), dt(2026, 1, 2), None, 1, 1, False, None),
            ("r2", "t", "d", "degraded", False, dt(2026, 1, 3), dt(2026, 1, 4), None, 1, 1, True, 2.0),
            ("r3", "t", "d", "success", True, dt(2026, 1, 5), dt(2026, 1, 6), None, 1, 1, False, 3.0),
            ("r4", "t", "e", "failed", False, dt(2026, 2, 1), None, None, 1, 1, False, None)]
    runs = spark.createDataFrame(data, shape)
    total = ledger.totals(runs).first()
    assert (total.runs, total.ok, total.failed, total.tokens_in, total.interventions) == (4, 3, 1, None, 1)
    assert ledger.totals(runs.filter("false")).first().tokens_out is None
    assert rows(ledger.monthly_cost(runs), "spent", "unknown_cost_runs") == [(0.0, 1), (2.0, 1)]
    assert ledger.find_done(runs).first().run_id == "r2"
    assert ledger.accept_once(runs).first().run_id == "r1"
    assert ledger.accept_once(runs, runs.filter("run_id = 'r1'")).count() == 0
    assert ledger.duplicate_done(runs).first().runs == 2
    notes = spark.createDataFrame([("r", 2, "b", None), ("r", 1, "a", True), ("r", 3, None, False)], "run_id string, seq int, note string, intervened boolean")
    row = ledger.annotations(notes).first()
    assert (row.notes, row.intervened) == ("a\nb", False)


def test_pareto_matches_pairwise_dominance(spark):
    random.seed(9)
    points = [(f"a{i}", float(random.randint(0, 20)), random.randint(0, 20) / 20) for i in range(200)]
    df = spark.createDataFrame(points, "arm string, cost double, score double")
    got = {r.arm: r.pareto_optimal for r in experiment.pareto(df).collect()}
    want = {a: not any(d <= c and t >= s and (d < c or t > s) for _, d, t in points) for a, c, s in points}
    assert got == want


def test_search_ranks_then_falls_back(spark):
    shape = "path string, kind string, task string, date string, title string, tags string, body string"
    data = [("n1", "notes", "t", "2026-01-01", "spark joins", "", "how joins shuffle data in spark"),
            ("n2", "notes", "t", "2026-01-02", "other", "", "nothing here"), ("r1", "runs", "t", "2026-01-03", "run", "", "全文检索的中文内容")]
    entries = spark.createDataFrame(data, shape)
    hit = search.search(entries, "Joins", 5).collect()
    assert [r.path for r in hit] == ["n1"] and "[joins]" in hit[0].excerpt
    assert [r.path for r in search.search(entries, "文检索", 5).collect()] == ["r1"]
    assert search.search(entries, "文检索", 5, kind="notes").count() == 0
    assert [r.path for r in search.recent(entries, "notes", 1).collect()] == ["n2"]


def test_compose_merge(spark):
    items = spark.createDataFrame([("a", g, i) for g in (0, 1) for i in (0, 1, 2)], "article string, group_no int, item_no int")
    links = spark.createDataFrame([
        ("a", 0, 0, 0, 1, "http://www.x.org/1/"), ("a", 0, 1, 0, 1, "https://x.org/2"), ("a", 0, 2, 0, 9, "https://lies.org"),
        ("a", 1, 0, 0, 1, "https://x.org/3"), ("a", 1, 1, 0, 1, "https://x.org/1"), ("a", 1, 2, 0, 1, "https://x.org/4")],
        "article string, group_no int, item_no int, link_no int, local_id int, url string")
    index = compose.capture_index(spark.createDataFrame([("a", i, f"https://x.org/{i}") for i in (1, 2, 3, 4)], "article string, position int, url string"))
    kept, cited = compose.merge(items, links, index, cap=3)
    assert rows(kept, "group_no", "item_no") == [(0, 0), (0, 1), (1, 0)]
    assert rows(cited, "group_no", "item_no", "url", "final_id") == [(0, 0, "https://x.org/1", 1), (0, 1, "https://x.org/2", 2), (1, 0, "https://x.org/3", 3)]
    dropped = compose.dropped_citations(compose.resolve_links(links, index)).first()
    assert dropped.dropped_citations == 1


def test_more_links_than_small_numbers_hold(spark):
    links = spark.createDataFrame(
        [("a", 0, 1, 65536, None, "u.org/1"), ("a", 0, 2, 0, None, "u.org/2"), ("a", 2048, 0, 0, None, "u.org/3"), ("a", 1, 0, 70000, None, "u.org/4")],
        "article string, group_no int, item_no int, link_no int, local_id int, url string")
    ids = {r.url: r.global_id for r in compose.first_seen_ids(links).collect()}
    assert ids == {"u.org/1": 1, "u.org/2": 2, "u.org/4": 3, "u.org/3": 4}


def test_architecture_without_text_is_not_a_pass(spark):
    files = spark.createDataFrame([(1, "a.py", None), (2, "a.py", "ok"), (3, "a.py", "import os"), (3, "b.py", None)], "change_id int, path string, text string")
    got = {r.change_id: (r.decision, r.violations) for r in merge_review.check_architecture(files, [("no os", "*.py", "^import os")]).collect()}
    assert got == {1: ("cannot_verify", 0), 2: ("pass", 0), 3: ("fail", 1)}


@pytest.mark.parametrize("rule, probability, want", [
    ("none", 0.9, "no_rule_baseline"), ("same", 0.9, "rule_wins"), ("bad", 0.9, "judge_wins"), ("same", None, "rule_wins"), ("bad", 0.1, "unusable"), ("same", 0.9, "no_point"),
])
def test_recommendation_verdicts(spark, rule, probability, want):
    rows = []
    for i in range(60):
        good = i % 2 == 0 or want == "no_point"  # one class only has no point to choose
        p = None if probability is None else probability if good else round(1 - probability, 4)
        r = {"none": None, "same": 1.0 if good else 0.0, "bad": 1.0}[rule]
        rows.append((f"s{i}", "k", "pass" if good else "not_pass", p, r))
    samples = spark.createDataFrame(rows, "sample_id string, kind string, expect string, probability double, rule_probability double")
    assert scoring.recommendation(samples, [0.2, 0.5, 0.8]).first().verdict == want


def _sets(spark, token_sets, needed, key):
    """Sets as the duplicate search folds them, token i of a set under key(i)."""
    rows = [("a", "body-en", needed, i, bytearray([i // 256, i % 256]), [str(t) for t in sorted(ts)], [key(t) for t in sorted(ts)]) for i, ts in enumerate(token_sets)]
    return spark.createDataFrame(rows, "article string, scope string, needed double, id long, digest binary, tokens array<string>, keys array<int>")


def test_sets_that_share_few_rare_tokens_are_not_fetched(spark):
    draw = random.Random(3)
    hub = [[1000 + i, 1001 + i, *draw.sample(range(400), 98)] for i in range(10)]
    near = [list(range(50_000, 50_100)), list(range(50_010, 50_110))]
    met = dedup._meeting_sets(_sets(spark, hub + near, 0.6, int))
    assert met.count() == 1


def test_similar_sets_hold_with_equal_hashes_of_unlike_tokens(spark):
    draw = random.Random(5)
    base = [draw.sample(range(200), draw.randint(1, 30)) for _ in range(40)]
    token_sets = base + [[t for t in s if draw.random() < 0.8] + draw.sample(range(200, 220), draw.randint(0, 4)) for s in base]
    token_sets = list({tuple(sorted(s)): s for s in token_sets if s}.values())
    for needed in (0.3, 0.5, 0.6):
        for keys in (500, 61):
            found = dedup._similar_sets(_sets(spark, token_sets, needed, lambda t: t % keys), hot=6, block=4).collect()
            got = {frozenset(int.from_bytes(x, "big") for x in (r.small, r.large)) for r in found}
            want = {frozenset((i, j)) for i, a in enumerate(token_sets) for j, b in enumerate(token_sets[:i])
                    if len(set(a) & set(b)) >= (needed - 1e-9) * len(set(a) | set(b))}
            assert want and want <= got and (keys < 500 or want == got)


def test_duplicate_plan_leaves_only_its_two_tables(spark, tmp_path):
    docs = spark.createDataFrame([("a", i, f"{i}", "s", "", f"one two three four {i} x", "", "alpha beta gamma delta " * 3, []) for i in range(6)],
        "article string, rank long, location string, section string, title_zh string, title_en string, body_zh string, body_en string, urls array<string>")
    with session.intermediates(spark):
        dedup.plan(docs)
        left = [p for p in session._written[spark.sparkContext.applicationId] if os.path.exists(p.removeprefix("file:"))]
        assert len(left) == 2


def test_row_numbers_shift_only_groups_that_ranges_begin_with(spark):
    data = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i % 50}", i % 400, i % 2) for i in range(1200)]
    df = spark.createDataFrame(data + data[:300], "k string, p long, t int").repartition(6)
    got = rows(ranking.row_numbers(df, ["k"], "p", "n", ties=("t",), distinct=True).fillna("", ["k"]), "k", "p", "t", "n")
    want = []
    for _, group in itertools.groupby(sorted({(k or "", p, t) for k, p, t in data}), key=lambda r: r[0]):
        want += [(*r, i + 1) for i, r in enumerate(group)]
    assert got == sorted(want)


def test_merge_writes_its_links_only(spark):
    items = spark.createDataFrame([("a", 0, i) for i in range(9)], "article string, group_no int, item_no int")
    links = spark.createDataFrame([("a", 0, i, n, n, f"https://x.example/{(i * 2 + n) % 7}") for i in range(9) for n in (1, 2)],
        "article string, group_no int, item_no int, link_no int, local_id int, url string")
    index = compose.capture_index(links.select("article", F.col("link_no").alias("position"), "url"))
    with session.intermediates(spark):
        _, cited = compose.merge(items, links, index, cap=3)
        assert [r.final_id for r in cited.orderBy("item_no", "local_id").collect()] == [1, 2, 3, 4, 5, 6]
        assert len(session._written[spark.sparkContext.applicationId]) == 1
