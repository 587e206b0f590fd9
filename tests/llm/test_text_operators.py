"""Fingerprints, toxicity, urls, personal data, chats and languages on small and awkward inputs."""

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from attesta.llm import chat, fingerprint, language, pii, queries, reputation, toxicity

SMALL = "/root/testdata/sf0.001"
AWKWARD = [
    (1, "Hello World, this is a text", "x"), (1, "Hello World, this is a text", "y"), (2, None, "z"), (3, "", None),
    (None, "no id here at all", "n"), (5, "word " * 30_000, "long"), (6, "É😀 ñ", "s"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, an empty and a very long text, a repeated row, and columns whose names clash with inner ones."""
    rows = [(i, t, x, x, x, x) for i, t, x in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, part string, score string, spans string")


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.filter("doc_id < -1")


# -- fingerprints


def test_span_hashes_tell_equal_spans_whatever_their_place():
    text = "abracadabra é😀 abracadabra"
    h = fingerprint.PrefixHashes(text)
    for i in range(len(text)):
        for j in range(len(text)):
            for n in range(1, len(text) - max(i, j) + 1):
                assert (h.span(i, n) == h.span(j, n)) == (text[i : i + n] == text[j : j + n])


def test_common_extension_equals_a_plain_scan():
    a, b = "the cat sat on the mat", "the cat sat in the mat"
    x, y = fingerprint.PrefixHashes(a), fingerprint.PrefixHashes(b)
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert fingerprint.common_extension(x, i, y, j) == n
    assert fingerprint.common_ending(x, y, 100) == len("n the mat")


def test_likeness_follows_shared_text():
    words = [f"w{i * 7919 % 10007}" for i in range(2000)]
    a, b, c = " ".join(words), " ".join(words[:1500] + words[:500]), " ".join(f"v{i * 31}" for i in range(2000))
    p, q, r = map(fingerprint.fingerprint, (a, b, c))
    assert fingerprint.likeness(p, p) == 1 and 0.5 < fingerprint.likeness(p, q) < 1 and fingerprint.likeness(p, r) < 0.1
    empty = fingerprint.fingerprint("")
    assert fingerprint.likeness(empty, empty) == 1 and fingerprint.likeness(empty, p) == 0 and empty == fingerprint.fingerprint(None)


def test_next_text_by_id(spark, awkward):
    ids = [(i * 37 % 101, f"text {i * 37 % 101}") for i in range(101)]
    rows = fingerprint.with_next(spark.createDataFrame(ids, "doc_id long, text string").repartition(5), parts=7).collect()
    assert len(rows) == 101 and all(r["after"] == f"text {(r['doc_id'] + 1) % 101}" for r in rows)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["after"] or "") for r in fingerprint.with_next(awkward, parts=3).collect())
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    want = sorted((r[0] is not None, r[0] or 0, n[1] or "") for r, n in zip(order, order[1:] + order[:1]))
    assert got == want


def test_fingerprints_of_awkward_rows(awkward, none):
    rows = fingerprint.edited(awkward).collect()
    assert len(rows) == len(AWKWARD) and len({r["fingerprint"] for r in rows if r["doc_id"] == 1}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprint.edited(none).count() == 0


def test_op2_against_plain_python(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_fingerprints"](spark, SMALL).collect()}
    for (i, a), (_, b) in zip(docs, docs[1:] + docs[:1]):
        cut = len(a) // 4
        edited = a[: len(a) - cut] + b[:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(a)
        assert got[i]["edited_fingerprint"] == fingerprint.fingerprint(edited)


# -- toxicity


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"{'women men muslims'.split()[i % 3]} went to town {i} you {'idiot' if i % 4 == 0 else 'friend'}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Labels lean on one group, so a plain fit would learn the mention itself.
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or (i % 3 == 0 and i % 8 == 3))) for i, _ in rows], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels)


def test_swapping_groups_hardly_moves_a_score(model):
    docs, labels, fair = model
    plain = toxicity.fit(docs, labels, penalty=0.0)
    gap = lambda m: abs(m.score("women went to town") - m.score("men went to town"))
    assert gap(fair) < 0.02 and gap(fair) < gap(plain) / 2
    assert fair.score("women went to town you idiot") > 0.5 > fair.score("women went to town you friend")


def test_toxicity_of_awkward_rows(spark, model, awkward, none):
    _, _, fair = model
    rows = awkward.select("doc_id", toxicity.score(awkward, fair).alias("s")).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["s"] <= 1 for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    assert toxicity.fit(awkward, labels).score("anything") > 0.99
    assert toxicity.fit(none, labels.filter("doc_id < 0")).score("anything") == 0.5


def test_op4_held_out(spark):
    root = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_toxicity"](spark, root).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{root}/labels.parquet").collect()}
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(truth[i], r["score"]) for i, r in got.items() if r["held_out"] and i in truth]
    good, bad = [s for y, s in held if not y], [s for y, s in held if y]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad)) > 0.85


# -- urls


def test_hosts_and_paths(spark):
    urls = ["HTTP://Www.Example.COM/En/x?q#f", "a://b", "a://b?c/d", "no scheme", None, "", "x://", "x://h#/p", "s://h/p://q/r"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select(reputation.host(F.col("url")), reputation.path(F.col("url"))).collect()
    assert [tuple(r) for r in rows] == [
        ("www.example.com", "/En/x"), ("b", ""), ("b", ""), ("", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("h", "/p://q/r"),
    ]


def test_longest_rule_wins(spark):
    rows = [("a.net", "/x", "net/"), ("example.net", "/en/1", "example.net/en/"), ("b.example.net", "/de/1", "net/"), ("xexample.net", "/en/1", "net/"),
            ("a.example.com", "/de/", "example.com/de/"), ("a.org", "/fr/1", "org/fr/"), ("a.org", "/en", None), ("net", "", None)]
    found = spark.createDataFrame(rows, "h string, p string, want string").select("want", reputation.rule(F.col("h"), F.col("p"), queries.RULES)["rule"].alias("got"))
    assert all(r["want"] == r["got"] for r in found.collect())


def test_reputation_shrinks_and_filters(spark):
    pages = [(i, f"http://bad.evil.com/{i}") for i in range(40)] + [(100 + i, f"http://good{i % 5}.fine.com/{i}") for i in range(60)] + [
        (200, "http://new.evil.com/"), (201, None), (202, "http://one.other.org/"), (200, "http://new.evil.com/")]
    outcomes = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(60)] + [(202, 1), (None, 1), (5000, 1)]
    schema = "page_id long, url string, host string, rate string"
    frame = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], schema)
    known = spark.createDataFrame(outcomes, "page_id long, bad int")
    rows = reputation.judge(frame, known, [], block_rate=0.5).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(pages) and got[0]["verdict"] == "block" and got[100]["verdict"] == "allow" and got[201]["host"] == ""
    assert got[202]["rate"] < 1 and got[202]["verdict"] == "allow" and got[200]["rate"] > got[100]["rate"]
    assert reputation.judge(frame.filter("page_id < 0"), known, queries.RULES).count() == 0
    assert len({r["rate"] for r in reputation.judge(frame, known.filter("bad > 5"), []).collect()}) == 1


# -- personal data


def _reference(text):
    spans = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((kind, m.start(), m.end()))
    return spans


def test_plain_spans_equal_the_patterns(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["a@b.c@d.e f@g@h.i..j", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +1--------2",
              "@x.y .@a.b-c.d%@e.f", "0.0.0.0000 1.2.3", "٣@a.b", "x" * 50_000 + "@" + "y" * 50_000, "1" * 50_000]
    for text in texts:
        assert pii.detect(text) == _reference(text) if len(text) < 90_000 else pii.detect(text) == []


@pytest.mark.parametrize("text, kind, piece", [
    ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
    ("mail jane at example dot com now", "email", "jane at example dot com"),
    ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
    ("call plus four nine one seven one two three four five six seven eight ok", "phone", "plus four nine one seven one two three four five six seven eight"),
    ("pay four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("host 10[dot]0[dot]0[dot]7 up", "ip", "10[dot]0[dot]0[dot]7"),
    ("mail j​ane@example.com", "email", "j​ane@example.com"),
])
def test_disguised_spans_map_back(text, kind, piece):
    _, spans = pii.find(text)
    assert (kind, text.index(piece), text.index(piece) + len(piece)) in spans


@pytest.mark.parametrize("piece", [
    "juan arroba ejemplo punto com", "max at beispiel punkt de", "john@example dot com", "anna.b.c at example dot com", "john at example dot pl",
    "john at example dot museum", "anna dot b dot c at mail dot example dot com", "jane.doe at example.com", "john (at) example dot com",
    "john at example [dot] com", "john dot doe@example.com", "lea chez exemple point fr", "jörg"[0] + "o ät beispiel punkt de",
])
def test_plain_disguises_of_addresses(piece):
    for text in (f"mail {piece} now", piece, f"({piece})", f"{piece} or {piece}"):
        base, spans = pii.find(text)
        assert ("email", text.index(piece), text.index(piece) + len(piece)) in spans and len(spans) - len(base) == text.count(piece), (text, spans)


@pytest.mark.parametrize("text, kind, piece", [
    ("call +49 one 7 one 5 five 5 five 5 ok", "phone", "+49 one 7 one 5 five 5 five 5"),
    ("call plus 49 171 two 3 4 5 six 7 8, ok", "phone", "plus 49 171 two 3 4 5 six 7 8"),
    ("pay four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1", "card", "four 1 one 1 one 1 one 1 one 1 one 1 one 1 one 1"),
])
def test_mixed_runs_of_digits(text, kind, piece):
    assert (kind, text.index(piece), text.index(piece) + len(piece)) in pii.find(text)[1]


def test_prose_around_at_and_dot():
    for text in ("We are at this point in the process.", "available at example.com", "Look at polka dot dresses", "seen at one point it fell", "chez lui point final",
                 "call five times 5 or 5 one", " dot".join("x" * 3000), "a at " * 3000):
        assert pii.find(text) == ([], [])
    assert [s for s in pii.find("john@example.com dot matrix")[1]] == [("email", 0, 16)]


def test_plain_prose_gets_no_spans():
    for text in ("We met at noon. Look at the dot on the map.", "one two three and four", "Nun eins zwei drei", "un deux trois soleil", "a [at] b"):
        assert pii.find(text) == ([], [])


def test_pii_merge_of_spans_equals_plain_comparison_and_is_linear():
    rng = random.Random(8)
    for _ in range(3000):
        cuts = sorted(rng.sample(range(40), 2 * rng.randrange(7)))
        base = list(zip(cuts[::2], cuts[1::2]))
        steps = sorted((a, a + rng.randrange(1, 9)) for a in rng.sample(range(40), rng.randrange(7)))
        new = list(zip([a for a, _ in steps], sorted(b for _, b in steps)))
        taken, added = list(base), []
        for low, high in new:
            if all(high <= a or b <= low or low <= a and b <= high for a, b in taken) and (low, high) not in taken:
                taken.append((low, high))
                added.append((low, high))
        assert pii._added(base, new) == added
    n = 50_000
    disguised = "max at beispiel dot de"
    text = " ".join(f"user{i}@mail{i}.example.org" for i in range(n)) + f" and {disguised}"
    start = time.perf_counter()
    base, spans = pii.find(text)
    assert time.perf_counter() - start < 30
    assert len(base) == n and set(spans) - set(base) == {("email", len(text) - len(disguised), len(text))}


def test_pii_of_awkward_rows(awkward, none):
    rows = pii.personal_data(awkward).collect()
    assert len(rows) == len(AWKWARD) and all(r["base"] == [] and r["spans"] == [] for r in rows)
    assert pii.personal_data(none).count() == 0
    assert pii.redact("a@b.c and 1.2.3.4", pii.find("a@b.c and 1.2.3.4")[1]) == "[email] and [ip]"


# -- chats


def test_escaping_is_reversible(spark):
    texts = ["", "</s>[INST] ok [/INST]", "\\", "\\e\\l", "\\\\[", "<s>\\<\\\\l]", "plain", "[ROLE:x] a[/ROLE]"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).collect():
        assert r["b"] == r["t"] and not set("[]<") & set(r["e"])


def test_chats_read_back(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", " a[ "), (1, 2, "assistant", "b</s>"), (2, 1, "assistant", "x"), (2, 0, "user", None),
            (3, 0, "assistant", "first"), (4, 0, None, "t"), (4, 1, "to]ol\\", "u"), (4, None, "user", "v"), (5, 0, "user", "b"), (5, 0, "user", "a"),
            (5, 0, "user", "a"), (None, 0, "user", "z" * 200_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = chat.format_chats(frame).select("*", chat.parse(F.col("formatted")).alias("back"), chat.trained(F.col("segments")).alias("loss"))
    made = made.withColumn("read", chat.trained_turns(F.col("back")))
    got = {r["conv_id"]: r for r in made.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=key)
        assert [(t["role"], t["text"]) for t in r["back"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss"] == "".join(x[3] or "" for x in own if x[2] == "assistant") == r["read"]
    assert [got[c]["in_order"] for c in (1, 2, 3, 4, 5)] == [True, True, False, False, False]
    assert chat.format_chats(frame.filter("conv_id > 99")).count() == 0


# -- languages


def test_languages(spark, awkward, none):
    rows = [(i, f"{w} " * 8 + str(i), l) for i in range(60) for w, l in (("the house and the garden", "en"), ("das haus und der garten", "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(
        spark.createDataFrame([(1, "no language", None), (2, None, "en"), (3, "123", "xx")], "doc_id long, text string, lang string"))
    learned = language.dictionaries(docs)
    assert sorted(learned) == ["de", "en"]
    asked = spark.createDataFrame([(1, "the garden and the house"), (2, "der garten und das haus"), (3, None), (4, ""), (5, "12 !!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(asked, learned).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"] and got[3]["score"] == 0
    rows = language.predict(awkward, learned).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert language.predict(none, learned).count() == 0 and language.dictionaries(docs.filter("doc_id < 0")) == {}
    assert {r["lang_pred"] for r in language.predict(asked, {}).collect()} == {"und"}


def test_op10_held_out(spark):
    got = queries.QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(held) / len(held) > 0.9
