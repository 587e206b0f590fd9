"""Gates on small documents, the runner, sources, sinks and the stream."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as text_functions
from attesta.operators import contract, gates
from attesta.plans.inputs import PROFILE as WORDS
from attesta.sources import capture, files, memory, pages, sheets, store
from attesta.streaming import ledger as stream


def bi(text):
    return {"zh": text, "en": text}


def article(**changes):
    doc = {
        "date": "2026-01-01", "title": bi("t"), "summary": bi("s"), "notes": bi("n"),
        "sections": [
            {"id": "insights", "groups": [{"id": "g", "title": bi("g"), "items": [{"title": bi("alpha one"), "prose": bi("by using x however"), "sources": [1]}]}]},
            {"id": "github", "items": [{"title": bi("beta two"), "fields": [{"label": bi("l"), "value": bi("v")}], "sources": [2]}]},
        ],
        "references": [{"id": 1, "url": "https://a.org/story/one/long", "title": "a"}, {"id": 2, "url": "https://b.org/story/two/long", "title": "b"}],
    }
    doc.update(changes)
    return doc


def load(spark, *docs):
    data = [(f"2026-01-{i + 1:02d}", d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return spark.createDataFrame(data, "day string, content string")


def with_item(item):
    doc = article()
    doc["sections"][1]["items"] = [item]
    return doc


ITEM = {"title": bi("beta"), "sources": [2]}


@pytest.mark.parametrize("doc, expected", [
    (article(), "pass"),
    ("{broken", "fail"),
    ("[]", "fail"),
    (article(sections=article()["sections"] + [{"id": "surprise", "items": []}]), "cannot_verify"),
    (with_item({**ITEM, "blob": bi("x")}), "cannot_verify"),
    (with_item({**ITEM, "prose": {"zh": "x"}}), "fail"),
    (with_item({**ITEM, "summary": bi("x"), "comment": bi("y")}), "pass"),
    (with_item({**ITEM, "summary": bi("x"), "comment": "y"}), "fail"),
    (with_item({**ITEM, "body": bi("x")}), "pass"),
    (with_item({**ITEM, "body": "x"}), "fail"),
    (with_item({"title": bi("b"), "prose": bi("x"), "sources": []}), "fail"),
    (with_item({"title": "b", "prose": bi("x"), "sources": [2]}), "fail"),
    (with_item({**ITEM, "fields": [{"label": bi("l"), "value": {"zh": "v"}}]}), "fail"),
    (with_item({**ITEM, "fields": ["x"]}), "fail"),
    (article(notes={"zh": "x", "en": ""}), "fail"),
    (article(date=""), "fail"),
    (article(references=[]), "fail"),
    (article(sections=[{"id": "insights"}, {"id": "github"}]), "fail"),
    (article(sections=[{"id": "insights", "groups": [{"title": bi("g")}]}, {"id": "github"}]), "fail"),
    (article(sections=[{"id": "github", "items": [{"title": bi(f"x{i}"), "prose": bi("p"), "sources": [1]} for i in range(11)]}, {"id": "papers"}]), "fail"),
])
def test_structure(spark, doc, expected):
    assert contract.structure_gate(load(spark, doc)).first().decision == expected


def test_items_are_numbered_across_groups_and_flat_items(spark):
    doc = article(sections=[{"id": "insights", "groups": [
        {"id": "a", "items": [{"title": "x"}, "not an item", {"title": bi("y"), "zzz": 1}]}, {"items": [{"title": "z"}]}],
        "items": [{"title": "w", "sources": [1, True, "2", 3.5, 4]}]}])
    got = contract.flatten_items(load(spark, doc)).orderBy("item_pos").collect()
    assert [r.location for r in got] == ["insights/a[1]", "insights/a[2]", "insights[3]", "insights[4]"]
    assert got[3].sources == [1, 4] and got[3].bad_sources == 3
    assert got[1].extra_keys == ["zzz"] and got[0].title_zh == "x" and got[0].title_en == ""
    kept = contract.drop_items(contract.flatten_items(load(spark, doc)), spark.createDataFrame([("2026-01-01", "insights[3]")], "day string, location string"))
    assert kept.count() == 3


@pytest.mark.parametrize("changes, problems, orphans", [
    ({}, 0, 0),
    ({"references": article()["references"] + [{"id": 3, "url": "https://c.org", "title": "c"}]}, 0, 1),
    ({"references": article()["references"][:1]}, 1, 0),
    ({"references": article()["references"] + [{"id": 2, "url": "https://c.org", "title": "c"}]}, 1, 0),
    ({"references": [{"id": 1, "url": "ftp://a", "title": "a"}, {"id": 2, "url": "https://b", "title": "  "}]}, 2, 0),
])
def test_references(spark, changes, problems, orphans):
    row = contract.references_gate(load(spark, article(**changes))).first()
    assert (row.problems, row.orphans) == (problems, orphans)
    assert row.decision == ("fail" if problems else "pass")


ODD = [
    {"id": "insights", "groups": [7, None, {"id": "g", "title": "g", "items": [{**ITEM, "prose": bi("p")}, "x", None, 3]}, {"id": 4}]},
    "no section", None, {"groups": "none", "items": {"a": 1}}, {"id": "github", "items": [None, {**ITEM, "fields": [3, {"value": "v"}]}]},
]


def test_sections_of_odd_shapes_are_read_piece_by_piece(spark):
    got = contract.flatten_items(load(spark, article(sections=ODD))).orderBy("section_pos", "item_pos").collect()
    assert [(r.section_pos, r.location, r.group_id, r.variant, r.title_zh) for r in got] == [
        (0, "insights/g[1]", "g", "prose", "beta"), (2, "github[1]", None, "fields", "beta"),
    ]
    assert got[1].issues == ["fields entry is not an object", "field value not bilingual", "fields are not bilingual"]
    gate = contract.structure_gate(load(spark, article(sections=ODD))).first()
    # One group without a title and one section without an id, which is no declared one.
    assert (gate.n_items, gate.n_insights, gate.n_github, gate.unknown_sections, gate.item_issues, gate.failures) == (2, 1, 1, 1, 3, 4)


def test_nulls_in_lists_of_whole_sections_count_as_nothing(spark):
    sections = [None, {"id": "insights", "groups": [None, {"id": "g", "title": bi("g"), "items": [None, {**ITEM, "prose": bi("p")}]}, {"id": "h", "title": bi("h")}]}, {"id": "github"}]
    got = contract.flatten_items(load(spark, article(sections=sections))).collect()
    assert [(r.section_pos, r.location) for r in got] == [(0, "insights/g[1]")]
    gate = contract.structure_gate(load(spark, article(sections=sections, references=[None, {"id": [1]}]))).first()
    assert (gate.n_items, gate.n_refs, gate.unknown_sections, gate.failures, gate.decision) == (1, 1, 0, 0, "pass")


def test_an_article_without_items_has_a_decision(spark):
    rows = load(spark, article(sections=[]), article(sections=[{"id": "insights"}, {"id": "github"}]), "{broken", article())
    got = {r.day[-1]: (r.decision, r.failures, r.n_items, r.unknown_items) for r in contract.structure_gate(rows).collect()}
    assert got == {"1": ("fail", 1, 0, 0), "2": ("fail", 1, 0, 0), "3": ("fail", None, 0, 0), "4": ("pass", 0, 2, 0)}
    told = {r.day[-1]: (r.candidates, r.entries, r.decision) for r in contract.brief_gate(rows, profile={"interest": ("alpha",)}).collect()}
    assert told == {"1": (0, 0, "fail"), "2": (0, 0, "fail"), "3": (0, 0, "fail"), "4": (2, 1, "pass")}


def test_structure_parses_once_and_no_section_travels_with_its_items(spark):
    plan = contract.structure_gate(load(spark, article()))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1
    beside_items = re.findall(r"\[([^\[\]]*)\], (?:true|false), \[item_pos", plan)
    assert [{c.strip().split("#")[0] for c in columns.split(",")} & {"s", "sections", "doc", "content"} for columns in beside_items] == [set()]


def test_brief_writes_marks_and_no_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(contract, "materialise", lambda df, name: written.append(df) or df)
    contract.brief_gate(load(spark, article()), profile=PROFILE)
    assert [set(df.columns) for df in written] == [{"day", "broken", "section_pos", "item_pos", "bare", "out", "states_limit", "why", "interest"}]
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1


def test_duplicates_brief_depth(spark):
    doc = with_item({"title": bi("Alpha: one!"), "prose": bi("z"), "sources": [2]})
    inputs = {"articles": load(spark, doc, article())}
    got = {r.entity: r.decision for r in gates.get("duplicates")(inputs).collect()}
    assert got == {"2026-01-01": "fail", "2026-01-02": "pass"}
    depth = gates.get("depth")(inputs, profile=WORDS).filter("entity = '2026-01-02'").first()
    assert (depth["items"], depth.with_limit, depth.without_substance) == (2, 1, 1)


PROFILE = {"interest": ("alpha", "beta"), "exclude": ("spam",), "mechanism": ("because",), "limit": ("only", "but")}


def test_brief_is_chosen_by_the_profile(spark):
    def item(title, prose):
        return {"title": bi(title), "prose": bi(prose) if prose else {"en": "no zh"}, "sources": [1]}

    many = article(sections=[{"id": "s", "items": [item("one alpha", "x"), item("alpha", "beta only"), item("spam alpha", "y"), item("none", "z"), item("Beta", "")]}])
    rows = load(spark, many)
    chosen = [(r.place, r.location, r.why, r.states_limit) for r in contract.select_brief(contract.brief_items(rows), PROFILE, 2).orderBy("place").collect()]
    assert chosen == [(1, "s[2]", "alpha, beta", True), (2, "s[1]", "alpha", False)]
    gate = contract.brief_gate(rows, 2, PROFILE).first()
    assert (gate.entries, gate.candidates, gate.excluded, gate.without_limit, gate.decision, gate.failure_class) == (2, 5, 1, 1, "pass", None)
    assert contract.brief_gate(rows, 5, PROFILE).first().without_body == 1
    nothing = contract.brief_gate(rows, 5, {"interest": ("absent",)}).first()
    assert (nothing.entries, nothing.decision) == (0, "fail")
    unexplained = contract.brief_gate(rows, 1, {"exclude": ("spam",)}).first()
    assert (unexplained.entries, unexplained.without_reason, unexplained.decision) == (1, 1, "fail")


@pytest.mark.parametrize("name", ["brief", "depth"])
def test_without_a_profile_nothing_is_verified(spark, name):
    inputs = {"articles": load(spark, article(), "{broken")}
    got = {r.entity: (r.decision, r.failure_class) for r in gates.run_gates(spark, [name], inputs).collect()}
    assert got == {"2026-01-01": ("cannot_verify", "precondition_unknown"), "2026-01-02": ("fail", "policy_violation")}
    told = gates.run_gates(spark, [name], inputs, arguments={name: {"profile": PROFILE}})
    assert {r.decision for r in told.filter("entity = '2026-01-01'").collect()} <= {"pass", "fail"}


RAW = {"hn": [{"title": "x", "url": "http://www.a.org/story/one/long/?utm_source=q", "points": 3}], "deep": {"er": [{"link": "https://b.org/story/two/long"}]}}


def day_inputs(spark):
    late = article(references=[{"id": 1, "url": "https://old.org/story", "title": "a"}, {"id": 2, "url": "https://b.org/story/two/long", "title": "b"}])
    captures = spark.createDataFrame([
        ("2026-01-01", json.dumps(RAW)), ("2026-01-02", json.dumps(RAW)), ("2025-12-31", json.dumps({"feeds": {"f": [{"url": "https://old.org/story"}]}}))],
        "day string, content string")
    return {"articles": load(spark, article(), late, article()), "captures": captures}


def test_verifiable_and_release(spark):
    inputs = day_inputs(spark)
    rows = {r.entity: r for r in gates.get("verifiable")(inputs).collect()}
    assert rows["2026-01-01"].decision == "pass"
    assert (rows["2026-01-02"].decision, rows["2026-01-02"].stale_citations, rows["2026-01-02"].unknown_citations) == ("fail", 1, 0)
    assert rows["2026-01-03"].raw_missing and rows["2026-01-03"].decision == "fail"
    names = ["structure", "references", "verifiable"]
    debt = gates.content_debt(gates.run_gates(spark, names, inputs), names)
    assert {r.day: r.blockers for r in debt.collect()} == {"2026-01-01": "", "2026-01-02": "verifiable", "2026-01-03": "verifiable"}
    out = {r.day: (r.release, r.warned) for r in gates.release_gate(debt, gates.get("verifiable")(inputs), 2).collect()}
    assert out == {"2026-01-03": ("block", False), "2026-01-02": ("publish", True)}
    with pytest.raises(ValueError):
        gates.release_gate(debt, gates.get("verifiable")(inputs), 0)


def test_coverage_gate_needs_a_capture(spark):
    got = {r.entity: (r.decision, r.missed) for r in gates.get("coverage")(day_inputs(spark)).collect()}
    assert got["2026-01-01"] == ("pass", 0) and got["2026-01-02"] == ("pass", 1) and got["2026-01-03"][0] == "cannot_verify"


def test_runner_policy_and_broken_gate(spark):
    inputs = {"articles": load(spark, with_item({**ITEM, "blob": 1}))}
    strict = gates.run_gates(spark, ["structure"], inputs).first()
    assert (strict.decision, strict.policy_action, strict.ok, strict.failure_class) == ("cannot_verify", "block", False, "unknown_variant")
    lenient = gates.run_gates(spark, ["structure"], inputs, {"on_cannot_verify": "warn"}).first()
    assert lenient.ok and lenient.decision == "cannot_verify"
    broken = gates.run_gates(spark, ["verifiable"], inputs).first()
    assert (broken.decision, broken.failure_class) == ("fail", "internal_error")
    with pytest.raises(KeyError):
        gates.get("nope")


def test_a_gate_whose_task_raises_leaves_the_other_results(spark, monkeypatch):
    bomb = F.udf(lambda x: 1 // 0, "int")
    monkeypatch.setitem(gates.GATES, "bomb", lambda inputs: inputs["articles"].select(F.col("day").alias("entity"), F.when(bomb("day") > 0, "pass").otherwise("fail").alias("decision")))
    monkeypatch.setitem(gates.GATES, "overflow", lambda inputs: inputs["articles"].select(F.col("day").alias("entity"), F.raise_error(F.lit("no")).cast("string").alias("decision")))
    inputs = {"articles": load(spark, article(), article())}
    expected = spark.createDataFrame([("2026-01-01",), ("2026-01-02",), ("2026-01-03",)], "entity string")
    names = ["bomb", "structure", "overflow", "references"]
    got = {(r.gate, r.entity): (r.decision, r.failure_class, r.ok) for r in gates.run_gates(spark, names, inputs, expected=expected).collect()}
    assert len(got) == 12
    assert {got[n, f"2026-01-0{d}"] for n in ("bomb", "overflow") for d in (1, 2, 3)} == {("fail", "internal_error", False)}
    assert {got[n, f"2026-01-0{d}"] for n in ("structure", "references") for d in (1, 2)} == {("pass", None, True)}
    loose = gates.run_gates(spark, names, inputs)
    assert sorted((r.gate, r.entity or "") for r in loose.filter("not ok").collect()) == [("bomb", ""), ("overflow", "")]


def test_suite_rejects_gates_that_always_agree(spark):
    """A probe set must tell an always-pass and an always-fail gate from a real one."""
    probes = [(article(), True), (article(date=""), False), (article(notes=""), False)]
    df = load(spark, *[d for d, _ in probes])
    want = [ok for _, ok in probes]
    real = [r.decision == "pass" for r in contract.structure_gate(df).orderBy("day").collect()]
    assert real == want and [True] * 3 != want and [False] * 3 != want


def test_combine_and_brief(spark):
    data = [("r", "a", "pass"), ("r", "b", "cannot_verify"), ("s", "a", "fail"), ("s", "c", "abstain"), ("t", "a", "pass")]
    results = spark.createDataFrame(data, "entity string, gate string, decision string")
    rows = None
    for name in ("a", "b", "c"):
        part = gates.result_rows(name, results.filter(F.col("gate") == name).drop("gate"), {"on_abstain": "warn"})
        rows = part if rows is None else rows.unionByName(part)
    got = {r.entity: (r.decision, r.blocking, r.uncertain) for r in gates.combine(rows, ["entity"]).collect()}
    assert got == {"r": ("cannot_verify", "b", "b"), "s": ("fail", "a", ""), "t": ("pass", "", "")}
    declared = spark.createDataFrame([("a", True), ("b", False)], "gate string, required boolean")
    assert sorted((r.gate, r.role) for r in gates.repair_brief(rows, declared).collect()) == [("a", "entry"), ("b", "warning")]


# -- sources -------------------------------------------------------------------------------------


def test_harvest_ignores_look_alikes(spark):
    doc = {"a": 'x,"url":"https://no"', "url": {"url": "https://yes/1"}, "list": ["url", "https://no2"], "link": 5, "more": [{"html_url": 'https://q/"quoted"\\x'}], "k,": {"source_url": "ftp://f"}}
    df = spark.createDataFrame([("d", json.dumps(doc, indent=1)), ("e", "{bad")], "day string, content string")
    assert sorted(r.url for r in capture.capture_urls(df).collect()) == sorted(["https://yes/1", 'https://q/"quoted"\\x', "ftp://f"])
    assert capture.capture_urls(df, http_only=True).count() == 2


def test_day_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "2026-01-01.json").write_text(json.dumps(article()))
    (tmp_path / "2026-01-02.json").write_text("{bad")
    (tmp_path / "raw" / "2026-01-01.json").write_text(json.dumps(RAW))
    got, raw = files.articles(spark, str(tmp_path)), files.captures(spark, str(tmp_path))
    assert {r.day: r.raw_missing for r in files.content_days(got, raw).collect()} == {"2026-01-01": False, "2026-01-02": True}
    assert [r.day for r in files.complete_days(got, raw).collect()] == ["2026-01-01"]
    assert {r.entity: r.decision for r in gates.get("verifiable")({"articles": got, "captures": raw}).collect()} == {"2026-01-01": "pass", "2026-01-02": "fail"}
    paths = files.whole_texts(spark, str(tmp_path), "*.json").select("path", "content")
    assert sorted(r.decision for r in contract.json_gate(paths).collect()) == ["fail", "pass", "pass"]


def test_memory_files(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n.md").write_text("---\ntitle: T: x\ntags: a, b\ndate: 2026-01-01\n---\n\n# H\nbody\n")
    (tmp_path / "notes" / "m.md").write_text("plain\n## Second\n")
    (tmp_path / "notes" / "z.md").write_text("nothing")
    got = {r.title: r for r in memory.read_entries(spark, str(tmp_path)).collect()}
    assert set(got) == {"T: x", "Second", "z"}
    assert got["T: x"].tags == ["a", "b"] and got["T: x"].body == "# H\nbody\n" and got["T: x"].kind == "notes"
    notes = spark.createDataFrame([("My Title", "b ", ["x"], "", "2026-01-01", "t")], "title string, body string, tags array<string>, source string, date string, task string")
    row = memory.note_rows(notes).first()
    assert row.path == "notes/2026-01-01-My-Title.md" and row.body == "# My Title\n\nb\n"


LOCS = '<?xml version="1.0"?>\n<urlset xmlns="http://x"><url><loc> https://a </loc></url>{}</urlset>\n'


@pytest.mark.parametrize("content, folder, expected", [
    (LOCS.format(""), True, "pass"),
    (LOCS.format("<url><loc>https://a</loc></url>"), True, "fail"),
    (LOCS.format("\n" * 13), True, "fail"),
    (LOCS.format("\n" * 5), True, "pass"),
    (LOCS.format("<url>"), True, "fail"),
    (LOCS.format("a & b"), True, "fail"),
    (LOCS.format("x" * 200_001), True, "fail"),
    (None, True, "fail"),
    (None, False, "abstain"),
])
def test_sitemap(spark, content, folder, expected):
    df = spark.createDataFrame([("p", folder, content)], "path string, folder_exists boolean, content string")
    assert pages.sitemap_gate(df).first().decision == expected


@pytest.mark.parametrize("html, expected", [
    ('<a href="/trends/2026-10-05/">', "pass"), ('<a href="/trends/2026-10-04/">', "fail"), (None, "cannot_verify"),
    ('/trends/2026-10-05/ /trends/2026-02-30/', "fail"), ('/trends/2026-10-05/ /trends/2026-13-01/', "fail"),
])
def test_index(spark, html, expected):
    df = spark.createDataFrame([(1, html, "2026-10-05")], "page_id int, html string, expected string")
    assert pages.index_gate(df, "2026-09-01").first().decision == expected


def test_sinks_round_trip(spark, tmp_path):
    sheet = spark.createDataFrame([("c1", "d", "selected", 'a "quoted", title', "u")], "case_id string, day string, bucket string, title string, url string")
    sheets.write_sheet(sheet, str(tmp_path / "s"))
    for fmt, sub in (("csv", "csv"), ("json", "jsonl")):
        assert sheets.load_sheet(spark, str(tmp_path / "s" / sub), fmt).first().title == 'a "quoted", title'
    corpus = spark.createDataFrame([("i", "k", "u", "d", "pass", "n")], "sample_id string, kind string, url string, day string, expect string, note string")
    sheets.save_corpus(corpus, str(tmp_path / "c"))
    assert sheets.load_corpus(spark, str(tmp_path / "c")).first().sample_id == "i"
    assert sheets.markdown(corpus.select("kind", "expect")) == "| kind | expect |\n| --- | --- |\n| k | pass |"


def test_usage_lines(spark):
    log = '{"usage":{"input_tokens":5,"output_tokens":1}}\nnoise\n{"usage":{"input_tokens":9,"output_tokens":3}}'
    row = files.usage_lines(spark.createDataFrame([("r", log)], "run_id string, text string")).first()
    assert (row.tokens_in, row.tokens_out) == (9, 3)


def test_stream_accepts_each_task_and_date_once(spark, tmp_path):
    shape = "run_id string, task string, target_date string, status string, dry_run boolean, started_at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def put(name, rows):
        spark.sql("select 1")
        spark.createDataFrame(rows, "run_id string, task string, target_date string, status string, dry_run boolean, started_at string").selectExpr(
            "run_id", "task", "target_date", "status", "dry_run", "to_timestamp(started_at) started_at").write.mode("append").parquet(source)

    def run():
        stream.accept_stream(spark.readStream.schema(shape).parquet(source), out, str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r.run_id for r in spark.read.parquet(out).collect())

    put("a", [("r1", "t", "d", "success", False, "2026-01-01 00:00:00"), ("r0", "t", "e", "failed", False, "2026-01-01 00:00:00")])
    assert run() == ["r1"]
    put("b", [("r2", "t", "d", "success", False, "2026-01-02 00:00:00"), ("r3", "t", "e", "degraded", False, "2026-01-02 00:00:00")])
    assert run() == ["r1", "r3"]
    assert run() == ["r1", "r3"]


def test_every_expected_entity_has_a_result_and_a_broken_gate_blocks(spark):
    inputs = {"articles": load(spark, article(), article())}
    expected = spark.createDataFrame([("2026-01-01",), ("2026-01-02",), ("2026-01-09",)], "entity string")
    names = ["structure", "verifiable"]
    results = gates.run_gates(spark, names, inputs, expected=expected)
    got = {(r.gate, r.entity): (r.decision, r.ok) for r in results.collect()}
    assert len(got) == 6 and got["structure", "2026-01-01"] == ("pass", True)
    assert got["verifiable", "2026-01-01"] == ("fail", False) and got["structure", "2026-01-09"] == ("fail", False)
    debt = {r.day: (r.blockers, r.clean) for r in gates.content_debt(results, names).collect()}
    assert debt == {"2026-01-01": ("verifiable", False), "2026-01-02": ("verifiable", False), "2026-01-09": ("structure,verifiable", False)}
    loose = gates.content_debt(gates.run_gates(spark, names, inputs), names)
    assert {r.day: r.blockers for r in loose.collect()} == {"2026-01-01": "verifiable", "2026-01-02": "verifiable"}
    facts = spark.createDataFrame([], "entity string, raw_missing boolean, unknown_citations int, stale_citations int")
    assert {r.release for r in gates.release_gate(loose, facts, 2).collect()} == {"block"}


def test_depth_of_empty_and_unreadable_articles(spark):
    rows = spark.createDataFrame([("d1", json.dumps({"sections": []})), ("d2", "{broken"), ("d3", None)], "day string, content string")
    got = {r.day: (r.decision, r.limit_ratio, r["items"]) for r in contract.depth_gate(rows, profile=PROFILE).collect()}
    assert got == {"d1": ("pass", 1.0, 0), "d2": ("fail", 1.0, 0), "d3": ("fail", 1.0, 0)}


@pytest.mark.parametrize("xml, urls", [
    ("<urlset><url><loc>a</url></loc></urlset>", None), ("<urlset><url><loc>a</loc></url></urlset>", ["a"]), ("<x:urlset><x:loc>a</x:loc></x:urlset>", None),
    ("<urlset><loc><![CDATA[a&b]]></loc></urlset>", ["a&b"]), ("<a/><b/>", None), ("<a/> tail", None), ("", None), (None, None), ("<a>&nope;</a>", None),
])
def test_bad_xml_is_a_result_and_no_error(spark, xml, urls):
    row = spark.createDataFrame([(xml,)], "x string").select(pages.sitemap_locs(F.col("x")).alias("l")).first()
    assert row.l == urls


def test_long_values_and_runs_do_not_end_the_job(spark):
    long = "http://a.org/" + "x" * 100_000
    text = json.dumps({"url": 'http://first.org/"q\\', "link": long, "note": 'no "url":"http://no.org" here', "deep": [{"html_url": "http://z.org/é"}]})
    found = spark.createDataFrame([(text,), ("{broken",), (None,)], "c string").select(capture.harvest_urls(F.col("c")).alias("u")).collect()
    assert [r.u for r in found] == [['http://first.org/"q\\', long, "http://z.org/é"], None, None]
    blank = spark.createDataFrame([("a" + "\n" * 100_001 + "b",), ("",), ("x\n \n\t\ny\n\n",)], "t string").select(text_functions.max_blank_run(F.col("t")).alias("n"))
    assert [r.n for r in blank.collect()] == [100_000, 0, 2]


def test_buckets_without_a_limit_are_kept(spark):
    rows = spark.createDataFrame([("d", "other", "o", i, "t", "u", None, None, None, None) for i in range(40)],
                                 "day string, bucket string, source string, position int, title string, url string, text string, date string, signal_number double, signal_text string")
    assert capture.prefilter(rows).count() == 40


def test_reports_are_refused_and_not_cut(spark):
    with pytest.raises(ValueError):
        sheets.markdown(spark.range(12), most=10)
    assert sheets.markdown(spark.range(300)).count("\n") == 301


def test_a_damaged_ledger_is_an_error(spark, tmp_path):
    shape = "run_id string, task string, target_date date, status string, dry_run boolean, started_at timestamp"
    batch = spark.createDataFrame([("r", "t", datetime.date(2026, 1, 1), "success", False, None)], shape)
    (tmp_path / "bad" / "target_date=2026-01-01" / "batch_id=1").mkdir(parents=True)
    (tmp_path / "bad" / "target_date=2026-01-01" / "batch_id=1" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        stream.accept_batch(str(tmp_path / "bad"))(batch, 2)
    stream.accept_batch(str(tmp_path / "good"))(batch, 2)
    stream.accept_batch(str(tmp_path / "good"))(batch, 2)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1


def _events(spark, rows):
    return spark.createDataFrame(rows, "run_id string, target_date string, seq int, status string, inputs_json string")


def test_an_update_of_a_day_touches_one_partition(spark, tmp_path):
    path = str(tmp_path / "ledger")
    store.update(path, _events(spark, [("a", "2026-01-01", 1, "running", "{}"), ("b", "2026-01-02", 1, "running", "{}"), ("b", "2026-01-02", 2, "failed", "{}"), ("n", None, 1, "x", None)]), ["run_id"], ["seq"])
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "ledger").rglob("*.parquet")}
    newer = _events(spark, [("a", "2026-01-01", 3, "success", "{}"), ("c", "2026-01-01", 1, "running", "{}")])
    for _ in range(2):  # the same update again changes nothing
        store.update(path, newer, ["run_id"], ["seq"])
        held = {(r.run_id, str(r.target_date), r.seq, r.status) for r in spark.read.parquet(path).collect()}
        assert held == {("a", "2026-01-01", 3, "success"), ("c", "2026-01-01", 1, "running"), ("b", "2026-01-02", 2, "failed"), ("n", "None", 1, "x")}
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "ledger").rglob("*.parquet")}
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "2026-01-01" not in str(f)}
    read = store.of_days(spark.read.parquet(path), newer)
    assert {f.rsplit("target_date=", 1)[1][:10] for f in (r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect())} == {"2026-01-01"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "target_date" in filters and "2026-01-01" in filters


def test_tail_over_a_snapshot_and_decoded_fields(spark):
    old = _events(spark, [("a", "d1", 1, "running", '{"k": 1}'), ("b", "d1", 4, "failed", "{broken")])
    tail = _events(spark, [("a", "d1", 2, "success", '{"k": 2}'), ("a", "d1", 1, "running", '{"k": 1}'), ("b", "d1", 3, "running", None), ("c", "d2", 1, "running", "[1]")])
    now = store.current(old, tail, ["run_id"], ["seq"])
    assert {(r.run_id, r.seq) for r in now.collect()} == {("a", 2), ("b", 4), ("c", 1)}
    rich = store.decoded(now, {"inputs_json": "inputs"})
    assert "inputs_json" not in rich.columns
    got = {r.run_id: (r.kind, r.k) for r in rich.select("run_id", F.schema_of_variant("inputs").alias("kind"), F.try_variant_get("inputs", "$.k", "int").alias("k")).collect()}
    assert got == {"a": ("OBJECT<k: BIGINT>", 2), "b": (None, None), "c": ("ARRAY<BIGINT>", None)}
    wanted = spark.createDataFrame([("a", "d1"), ("c", "d1"), ("c", "d1")], "run_id string, target_date string")
    assert [r.run_id for r in store.get_runs(now, wanted).collect()] == ["a"]
