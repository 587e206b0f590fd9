"""Column functions on literal values."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attesta.functions import decisions, parsing, text, urls


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


@pytest.mark.parametrize("given_url, expected", [
    ("https://a.org/x/", "a.org/x"),
    ("http://www.a.org/X//", "a.org/x"),
    ("  https://a.org/x#part  ", "a.org/x"),
    ("https://a.org/x?utm_source=n&b=2&gclid=3", "a.org/x?b=2"),
    ("https://a.org/x?UTM_medium=n", "a.org/x"),
    ("https://a.org/x?reflink=1&ref=2", "a.org/x?reflink=1"),
    ("https://a.org/x?gclidfoo=1&&c=3", "a.org/x?c=3"),
    ("https://a.org/x/?q=1/", "a.org/x/?q=1"),
    ("https://a.org/x?a=b?", "a.org/x?a=b?"),
    ("https://a.org/x?", "a.org/x"),
    ("HTTPS://a.org/x", "https://a.org/x"),
    ("https://http://a.org", "http://a.org"),
    ("", ""),
    (None, ""),
])
def test_canonical_url(spark, given_url, expected):
    assert column(spark, [given_url], urls.canonical_url) == [expected]


def test_legacy_form_peels_prefixes_one_after_another(spark):
    got = column(spark, ["https://http://www.A.org/", "www.a.org/x?y=1/"], urls.legacy_normalise)
    assert got == ["a.org", "a.org/x?y=1"]


def test_arxiv_version(spark):
    got = column(spark, ["arxiv.org/abs/2609.1v2", "arxiv.org/abs/2609.1", "arxiv.org/abs/2609.1vx", "x.org/abs/1v2"], urls.strip_arxiv_version)
    assert got == ["arxiv.org/abs/2609.1", "arxiv.org/abs/2609.1", "arxiv.org/abs/2609.1vx", "x.org/abs/1v2"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(
    st.sampled_from(["https://", "http://"]), st.sampled_from(["", "www."]),
    st.from_regex(r"[a-z]{3,8}\.org/[a-z]{1,6}", fullmatch=True), st.sampled_from(["", "?a=1"])), min_size=20, max_size=20))
def test_drift_never_changes_the_canonical_form(spark, parts):
    plain = ["".join(p) for p in parts]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(plain)], "i long, u string")
    for label, builder in urls.DRIFTS:
        bad = df.select("u", builder(F.col("u")).alias("d")).filter("d is not null").filter(
            urls.canonical_url(F.col("u")) != urls.canonical_url(F.col("d"))
        )
        assert bad.count() == 0, label
    chosen = df.select("u", urls.rotated_drift(F.col("u"), F.col("i")).alias("d"))
    assert chosen.filter("d is null or d.url = u").count() == 0


def test_titles_and_tokens(spark):
    assert column(spark, ["据报道：Open AI 发布！", " A-B c", "官方：解读：x"], text.normalise_title) == ["openai发布", "abc", "x"]
    got = column(spark, ["GPT-4 是 新模型", "a bb 中", ""], text.tokens)
    assert set(got[0]) == {"gpt", "新模", "模型", "是"}
    assert set(got[1]) == {"bb", "中"}
    assert got[2] == []


def brute_blank_run(value):
    longest = current = 0
    for line in value.splitlines():
        current = current + 1 if line.strip() == "" else 0
        longest = max(longest, current)
    return longest


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a \n\t", max_size=12), min_size=30, max_size=30))
def test_blank_runs_match_a_line_loop(spark, values):
    assert column(spark, values, text.max_blank_run) == [brute_blank_run(v) for v in values]


def test_slug_heading_excerpt(spark):
    assert column(spark, ["  Hello, World -- 你好  ", "***"], text.slugify) == ["Hello-World-你好", "entry"]
    assert column(spark, ["x\n## Head \ny"], text.first_heading) == ["Head"]
    assert column(spark, [" a\n\n b "], text.excerpt) == ["a b"]


def test_parse_probability(spark):
    replies = ["0.95", "95", "1000", "about 30%", "1.5", "none", "1234.5", "12.5", "0", "100", "101"]
    assert column(spark, replies, parsing.parse_probability) == [0.95, 0.95, None, 0.3, None, None, 0.05, None, 0.0, 1.0, None]


def test_parse_verdict_prefers_the_cautious_word(spark):
    got = column(spark, ["PASS", "cannot_verify, maybe PASS", "fail", "", None], parsing.parse_verdict)
    assert got == ["pass", "cannot_verify", "fail", "cannot_verify", "cannot_verify"]


def test_extract_json(spark):
    replies = ['ok ```json\n{"a": 1}\n``` done', 'x {"a": 2} y', "no", "{broken", "[1]"]
    got = column(spark, replies, lambda c: F.try_variant_get(parsing.extract_json(c), "$.a", "int"))
    assert got == [1, 2, None, None, None]


def test_markers(spark):
    df = spark.sql("select 'a [[1]] b [[2]][[1]] c [[007]]' t, map('1', '5', '7', '9') m")
    row = df.select(parsing.rewrite_markers(F.col("t"), F.col("m")), parsing.marker_ids(F.col("t"), F.col("m"))).first()
    assert row[0] == "a [[5]] b [[5]] c [[9]]"
    assert row[1] == [5, 9]


@pytest.mark.parametrize("given_text, expected", [
    ("0.5,0.1,0.5", [0.1, 0.5]), ("0:1:0.25", [0.0, 0.25, 0.5, 0.75, 1.0]), ("0:0.3:0.1", [0.0, 0.1, 0.2, 0.3]), ("", []),
])
def test_thresholds(given_text, expected):
    assert parsing.parse_thresholds(given_text) == expected


@pytest.mark.parametrize("bad", ["0:1:0", "0:1:-1", "a,b"])
def test_bad_thresholds(bad):
    with pytest.raises(ValueError):
        parsing.parse_thresholds(bad)


def test_scope_matching(spark):
    paths = ["src/a.py", "src", "srcx/a.py", "docs/x/y.md", "top.txt"]
    assert column(spark, paths, lambda c: parsing.in_declared_scope(c, ["src/", "docs/*.md"])) == [True, False, False, True, False]
    assert column(spark, paths, lambda c: parsing.in_declared_scope(c, ["."])) == [True] * 5
    assert column(spark, ["a1", "ab"], lambda c: parsing.in_declared_scope(c, ["a[!0-9]"])) == [False, True]


def test_secrets_cost_budget(spark):
    kept = spark.sql("select map('api_key', '1', 'Path', '2', 'sessionToken', '3') m").select(parsing.drop_secrets(F.col("m"))).first()[0]
    assert kept == {"Path": "2"}
    assert spark.range(1).select(parsing.token_cost(F.lit(1e6), F.lit(0), 0.3, 1.2)).first()[0] == 0.3
    assert spark.range(1).select(parsing.token_cost(F.lit(1), F.lit(1), None, 1.2)).first()[0] is None
    assert column(spark, [0.5, 2.0, None], lambda c: parsing.over_budget(c, 1.0), "double") == [False, True, False]


def test_no_null_ever_passes(spark):
    words = ["pass", "fail", "abstain", "cannot_verify", "rubbish", None]
    assert column(spark, words, lambda c: decisions.decision_of(decisions.severity(c))) == [
        "pass", "fail", "abstain", "cannot_verify", "cannot_verify", "cannot_verify"]
    action = lambda c: decisions.policy_action(c, {"on_cannot_verify": "warn"})
    assert column(spark, words, action) == ["allow", "block", "block", "warn", "warn", "warn"]
    assert column(spark, [None, 0.5, 0.49, 0.61], lambda c: decisions.verdict_for(c, F.lit(0.5)), "double") == [
        "cannot_verify", "pass", "fail", "pass"]
    assert column(spark, [0.45, 0.375, 0.625], lambda c: decisions.verdict_for(c, F.lit(0.5), 0.2), "double") == [
        "cannot_verify", "fail", "pass"]
    with pytest.raises(ValueError):
        decisions.check_policy({"on_fail": "ignore"})


def test_split_half_is_the_parity_of_the_first_sha1_byte(spark):
    ids = [f"s{i}" for i in range(50)]
    from attesta.operators.scoring import split_half

    want = ["left" if hashlib.sha1(i.encode()).digest()[0] % 2 == 0 else "right" for i in ids]
    assert column(spark, ids, split_half) == want


def test_strip_takes_all_unicode_whitespace_from_the_ends_only(spark):
    codes = spark.range(1, 0x10000).filter("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    text = F.concat("c", "c", F.lit("a"), "c", F.lit("b\u00e4"), "c", F.lit("\n"))
    both = codes.select("c", urls.strip(text).alias("got"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("want"))
    assert both.filter("got <> want").collect() == []
    assert "regexp" not in both.select("got")._jdf.queryExecution().optimizedPlan().toString()
