"""Article contract: nested JSON flattened and checked.

Input: articles(day, content) with `content` a JSON text and one row per day. The text is parsed
to VARIANT, which never fails on an unexpected shape. Items are exploded and read with plain
column expressions; what a gate needs per article comes back through an aggregate whose map side
already folds each article to one row, because an article is exploded inside one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import contains_any, held, holds_any, lowered
from attesta.functions.urls import strip
from attesta.functions.vocabulary import ARTICLE_KEYS, ITEM_KEYS, SECTION_CAPS
from attesta.session import materialise

_VARIANTS = "array<variant>"
#: Words by use: interest, exclude, mechanism, limit.
Profile = Mapping[str, Sequence[str]]
_BLOCK = "struct<zh:string,en:string>"
_BILINGUAL = ("title", "prose", "summary", "comment", "body")


def _get(node: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(node, f"$.{key}", kind)


def _is_object(node: Column) -> Column:
    """Only a JSON object casts to a struct; this reads no further than the top of the node."""
    return node.try_cast("struct<id:variant>").isNotNull()


def _is_whole_number(node: Column) -> Column:
    return F.schema_of_variant(node) == "BIGINT"


def _list(node: Column, key: str) -> Column:
    """A list member, empty when it is missing or not a list."""
    return F.coalesce(_get(node, key, _VARIANTS), F.array().cast(_VARIANTS))


def _objects(node: Column, key: str) -> Column:
    return F.filter(_list(node, key), _is_object)


def _spoken(node: Column, block: Column | None = None) -> Column:
    """struct<zh,en>: a plain string is Chinese only, an object is read by language. `block` is the node cast to _BLOCK, if at hand."""
    block = node.try_cast(_BLOCK) if block is None else block
    plain = F.when(F.schema_of_variant(node) == "STRING", node.try_cast("string"))
    zh = F.when(block.isNotNull(), block["zh"]).otherwise(plain)
    return F.struct(strip(zh).alias("zh"), strip(block["en"]).alias("en"))


def bilingual(node: Column, key: str) -> Column:
    """A member as struct<zh,en>, see _spoken."""
    return _spoken(_get(node, key))


def _members(node: Column) -> Column:
    """An object as map<string,variant>: taken apart once, where each look-up by path reads all its names again."""
    return node.try_cast("map<string,variant>")


def parse_articles(articles: DataFrame) -> DataFrame:
    """(day, doc): the parsed document, or NULL when it is missing, malformed or not an object."""
    parsed = articles.select("day", F.try_parse_json("content").alias("doc"))
    return parsed.select("day", F.when(_is_object(F.col("doc")), F.col("doc")).alias("doc"))


def json_gate(files: DataFrame) -> DataFrame:
    """files(path, content): malformed or missing text fails; a scalar passes with no keys."""
    parsed = F.try_parse_json("content")
    size = F.coalesce(
        F.size(F.map_keys(parsed.try_cast("map<string,variant>"))), F.size(parsed.try_cast(_VARIANTS)), F.lit(0)
    )
    ok = F.col("content").isNotNull() & parsed.isNotNull()
    return files.select(
        "path",
        F.when(ok, F.lit("pass")).otherwise(F.lit("fail")).alias("decision"),
        F.when(ok, size).otherwise(F.lit(0)).alias("top_level_keys"),
    )


def files_gate(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected paths that are not present."""
    return expected.select("path").distinct().join(present.select("path").distinct(), "path", "left_anti")


#: Sections as they should be. A cast to VARIANT encodes anew all that is below it, so the tree is cast once, down to the members of items.
_SECTIONS = (
    "array<struct<id:string,groups:array<struct<id:string,title:variant,items:array<map<string,variant>>>>,items:array<map<string,variant>>>>"
)


def _sections(doc: Column) -> Column:
    """Sections with their groups and items, as _SECTIONS; only objects count. One of another shape is read piece by piece."""
    def items(node: Column) -> Column:
        return F.transform(_objects(node, "items"), _members)

    def group(g: Column) -> Column:
        return F.struct(_get(g, "id", "string").alias("id"), _get(g, "title").alias("title"), items(g).alias("items"))

    piecewise = F.transform(
        _objects(doc, "sections"),
        lambda s: F.struct(
            _get(s, "id", "string").alias("id"), F.transform(_objects(s, "groups"), group).alias("groups"), items(s).alias("items")
        ),
    )
    return F.array_compact(F.coalesce(_get(doc, "sections", _SECTIONS), piecewise))


def _groups(section: Column) -> Column:
    """Groups of one of _sections(), empty when there are none."""
    return F.coalesce(F.array_compact(section["groups"]), F.array())


def _section_entries(section: Column) -> Column:
    """Items of one of _sections() in order: those of its groups, then its own; only objects count."""
    grouped = F.flatten(
        F.transform(
            _groups(section),
            lambda g: F.coalesce(F.transform(g["items"], lambda i: F.struct(g["id"].alias("group_id"), i.alias("members"))), F.array()),
        )
    )
    own = F.transform(section["items"], lambda i: F.struct(F.lit(None).cast("string").alias("group_id"), i.alias("members")))
    return F.filter(F.concat(grouped, F.coalesce(own, F.array())), lambda e: e["members"].isNotNull())


def _entries(parsed: DataFrame, every: bool = False) -> DataFrame:
    """Items of (day, ..., sections), which keep the other columns; with `every` an article or section without items has a row of NULLs."""
    kept = [c for c in parsed.columns if c != "sections"]
    spread = F.posexplode_outer if every else F.posexplode
    sections = parsed.select(*kept, spread("sections").alias("section_pos", "s"))
    # Only the section's name goes on: the section itself beside each of its items would be its square.
    named = sections.select(*kept, "section_pos", F.coalesce("s.id", F.lit("")).alias("section"), _section_entries(F.col("s")).alias("entries"))
    entries = named.select(*kept, "section_pos", "section", spread("entries").alias("item_pos", "e"))
    group = F.coalesce("e.group_id", F.lit(""))
    where = F.concat(
        "section", F.when(group != "", F.concat(F.lit("/"), group)).otherwise(F.lit("")),
        F.lit("["), (F.col("item_pos") + 1).cast("string"), F.lit("]"),
    )
    return entries.select(*kept, "section_pos", "section", "item_pos", where.alias("location"), "e.group_id", "e.members")


def raw_items(articles: DataFrame) -> DataFrame:
    """(day, section_pos, section, item_pos, location, group_id, members): items as maps of VARIANT."""
    return _entries(parse_articles(articles).select("day", _sections(F.col("doc")).alias("sections")))


def _listed(members: Column, key: str) -> Column:
    """A list member of an item, empty when it is missing or not a list."""
    return F.coalesce(members[key].try_cast(_VARIANTS), F.array().cast(_VARIANTS))


def _present(block: str) -> Column:
    return (F.col(f"{block}.zh") != "") | (F.col(f"{block}.en") != "")


def _lacks(block: str) -> Column:
    return (F.col(f"{block}.zh") == "") | (F.col(f"{block}.en") == "")


def _half(block: Column) -> Column:
    return (block["zh"] != "") & (block["en"] == "")


def _field_columns(items: DataFrame) -> DataFrame:
    """Body text and issues of the labelled-fields variant; NULL for an item without fields."""
    def given(column: Column) -> Column:
        return F.when(F.size("fields") > 0, column)

    # In a lambda nothing is shared, so each entry is cast in steps of its own and only then read by language.
    named = F.transform("fields", lambda e: e.try_cast("struct<label:variant,value:variant>"))
    cast = F.transform(
        F.array_compact("named"),
        lambda e: F.struct(
            e["label"].alias("label"), e["label"].try_cast(_BLOCK).alias("label_block"),
            e["value"].alias("value"), e["value"].try_cast(_BLOCK).alias("value_block"),
        ),
    )
    pairs = F.transform(
        cast, lambda e: F.struct(_spoken(e["label"], e["label_block"]).alias("label"), _spoken(e["value"], e["value_block"]).alias("value"))
    )
    staged = items.withColumn("named", given(named)).withColumn("pairs", given(pairs))

    def joined(lang: str) -> Column:
        return F.array_join(F.filter(F.col(f"pairs.value.{lang}"), lambda x: x != ""), " ")

    staged = staged.withColumns({"fields_zh": joined("zh"), "fields_en": joined("en")})
    issues = F.concat(
        F.transform(F.filter("named", lambda e: e.isNull()), lambda _: F.lit("fields entry is not an object")),
        F.transform(F.filter("pairs", lambda p: _half(p["label"])), lambda _: F.lit("field label not bilingual")),
        F.transform(F.filter("pairs", lambda p: _half(p["value"])), lambda _: F.lit("field value not bilingual")),
        F.array_compact(F.array(F.when((F.col("fields_zh") == "") | (F.col("fields_en") == ""), F.lit("fields are not bilingual")))),
    )
    return staged.withColumn("field_issues", given(issues))


def flatten_items(articles: DataFrame) -> DataFrame:
    """One row per item with its ordinal location, body variant, issues and sources.

    Body variants are tried in a fixed order: prose, fields, summary with comment, body.
    """
    return _read_items(raw_items(articles))


def _read_items(rows: DataFrame) -> DataFrame:
    member = F.col("members")
    own = [c for c in rows.columns if c != "members"]
    read = rows.select(
        *own,
        *[_spoken(member[key]).alias(key) for key in _BILINGUAL],
        _listed(member, "fields").alias("fields"),
        _listed(member, "sources").alias("all_sources"),
        F.map_keys(member).alias("keys"),
    )
    whole = F.transform(F.filter("all_sources", _is_whole_number), lambda s: s.try_cast("long"))
    staged = _field_columns(read).withColumns(
        {
            "sources": whole,
            "kind": F.when(_present("prose"), "prose")
            .when(F.size("fields") > 0, "fields")
            .when(_present("summary"), "summary")
            .when(_present("body"), "body")
            .otherwise("unknown"),
        }
    )
    kind = F.col("kind")

    def text(lang: str) -> Column:
        both = F.trim(F.concat_ws(" ", f"summary.{lang}", f"comment.{lang}"))
        return (
            F.when(kind == "prose", F.col(f"prose.{lang}"))
            .when(kind == "fields", F.col(f"fields_{lang}"))
            .when(kind == "summary", F.when(_present("comment"), both).otherwise(F.col(f"summary.{lang}")))
            .when(kind == "body", F.col(f"body.{lang}"))
            .otherwise(F.lit(""))
        )

    def issue(condition: Column, words: str) -> Column:
        return F.when(condition, F.lit(words))

    issues = F.concat(
        F.when(kind == "fields", F.col("field_issues")).otherwise(F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                issue((kind == "prose") & _lacks("prose"), "prose is not bilingual"),
                issue((kind == "summary") & _lacks("summary"), "summary is not bilingual"),
                issue((kind == "summary") & _present("comment") & _lacks("comment"), "comment is not bilingual"),
                issue((kind == "body") & _lacks("body"), "body is not bilingual"),
                issue(kind == "unknown", "no recognised body variant"),
                issue(_half(F.col("title")), "title is not bilingual"),
                issue(F.size("sources") == 0, "no sources"),
            )
        ),
    )
    variant = F.when(kind == "summary", "summary_comment").when(kind == "body", "prose").otherwise(kind)
    return staged.select(
        *own,
        variant.alias("variant"),
        F.col("title.zh").alias("title_zh"), F.col("title.en").alias("title_en"),
        text("zh").alias("body_zh"), text("en").alias("body_en"),
        "sources",
        F.array_sort(F.array_except("keys", F.array(*[F.lit(k) for k in ITEM_KEYS]))).alias("extra_keys"),
        issues.alias("issues"),
        (F.size("all_sources") - F.size("sources")).alias("bad_sources"),
    )


def drop_items(items: DataFrame, dropped: DataFrame) -> DataFrame:
    """Items without the given (day, location) pairs."""
    return items.join(dropped.select("day", "location"), ["day", "location"], "left_anti")


def references(articles: DataFrame) -> DataFrame:
    """One row per reference, in order; `id` only when it is a whole number."""
    spread = parse_articles(articles).select("day", F.posexplode(_objects(F.col("doc"), "references")).alias("ref_pos", "r"))
    node = F.col("r")
    return spread.select(
        "day", "ref_pos",
        F.when(_is_whole_number(_get(node, "id")), _get(node, "id", "long")).alias("id"),
        F.coalesce(_get(node, "id", "string"), F.lit("")).alias("id_text"),
        F.coalesce(_get(node, "url", "string"), F.lit("")).alias("url"),
        F.coalesce(_get(node, "title", "string"), F.lit("")).alias("title"),
    )


def item_sources(articles: DataFrame) -> DataFrame:
    """(day, source) for every entry of every item's sources; NULL where it is not a whole number."""
    node = F.col("source")
    spread = raw_items(articles).select("day", F.explode(_listed(F.col("members"), "sources")).alias("source"))
    return spread.select("day", F.when(_is_whole_number(node), node.try_cast("long")).alias("source"))


def cited_references(articles: DataFrame) -> DataFrame:
    """References some item cites, by whole-number id: the input of provenance checks."""
    used = item_sources(articles).filter("source is not null").distinct().withColumnRenamed("source", "id")
    named = references(articles).filter("id is not null")
    return named.join(used, ["day", "id"], "left_semi").select("day", F.col("id").alias("ref_id"), "url")


def _id(node: Column) -> Column:
    return F.struct(_get(node, "id", "string").alias("id"))


def structure_gate(articles: DataFrame) -> DataFrame:
    """Contract decision per article. An undeclared shape is cannot_verify, never a pass.

    An article is parsed once: what its head says is a few numbers that travel with its items.
    """
    doc = F.col("doc")
    names = F.transform("sections", lambda s: F.coalesce(s["id"], F.lit("")))
    groups = F.transform(
        F.flatten(F.transform("sections", _groups)),
        lambda g: F.struct(F.coalesce(g["id"], F.lit("")).alias("id"), _spoken(g["title"])["zh"].alias("zh")),
    )
    ungrouped = F.filter("sections", lambda s: (s["id"] == "insights") & (F.size(_groups(s)) == 0))
    blocks = [bilingual(doc, key).alias(key) for key in ("title", "summary", "notes")]
    heads = parse_articles(articles).withColumn("sections", _sections(doc)).select(
        "day", "sections",
        doc.isNull().alias("broken"),
        (F.coalesce(_get(doc, "date", "string"), F.lit("")) == "").cast("int").alias("no_date"),
        *blocks,
        names.alias("names"),
        groups.alias("groups"),
        F.size(ungrouped).alias("ungrouped"),
        F.size(
            F.coalesce(F.array_compact(_get(doc, "references", "array<struct<id:string>>")), F.transform(_objects(doc, "references"), _id))
        ).alias("n_refs"),
        F.size(
            F.array_except(F.map_keys(doc.try_cast("map<string,variant>")), F.array(*[F.lit(k) for k in ARTICLE_KEYS]))
        ).alias("unknown_top_level_keys"),
    )
    empty_text = sum(
        ((F.col(f"{block}.{lang}") == "").cast("int") for block in ("title", "summary", "notes") for lang in ("zh", "en")),
        F.lit(0),
    )
    heads = heads.select(
        "day", "sections", "broken", "n_refs", "unknown_top_level_keys",
        F.size(F.filter("names", lambda n: ~n.isin(*SECTION_CAPS))).alias("unknown_sections"),
        (
            F.col("no_date") + empty_text + (F.size("names") < 2).cast("int") + F.col("ungrouped")
            + F.size(F.filter("groups", lambda g: g["id"] == "")) + F.size(F.filter("groups", lambda g: g["zh"] == ""))
            + (F.col("n_refs") == 0).cast("int")
        ).alias("head_failures"),
    )
    known = ["day", "broken", "n_refs", "unknown_sections", "head_failures"]
    items = _read_items(_entries(heads, every=True))
    is_item = F.col("item_pos").isNotNull()
    joined = items.groupBy(*known).agg(
        F.max("unknown_top_level_keys").alias("unknown_top_level_keys"),
        F.count("item_pos").cast("int").alias("n_items"),
        F.count_if(is_item & (F.col("variant") == "unknown")).cast("int").alias("unknown_items"),
        F.sum(F.when(is_item, F.size("issues")).otherwise(0)).cast("int").alias("item_issues"),
        *[F.count_if(is_item & (F.col("section") == s)).cast("int").alias(f"n_{s}") for s in SECTION_CAPS],
        *[F.count_if(is_item & (F.col("variant") == v)).cast("int").alias(f"v_{v}") for v in ("prose", "fields", "summary_comment")],
    )
    counts = [c for c in joined.columns if c not in (*known, "unknown_top_level_keys")]
    over_cap = sum(((F.col(f"n_{s}") > cap).cast("int") for s, cap in SECTION_CAPS.items()), F.lit(0))
    failures = F.col("head_failures") + F.col("item_issues") + over_cap
    odd = (F.col("unknown_sections") > 0) | (F.col("unknown_items") > 0)
    return joined.select(
        "day",
        F.when(~F.col("broken"), failures).alias("failures"),
        F.when(F.col("broken"), "fail").when(odd, "cannot_verify").when(failures > 0, "fail").otherwise("pass").alias("decision"),
        F.when(F.col("broken"), "policy_violation").when(odd, "unknown_variant").when(failures > 0, "policy_violation").alias("failure_class"),
        "unknown_sections", "n_refs", *counts, "unknown_top_level_keys",
    )


def references_gate(articles: DataFrame) -> DataFrame:
    """Reference problems per article; an orphan reference only warns.

    Declared and cited ids meet in one aggregate per (day, id), so resolving them needs no
    lookup list per article.
    """
    refs = references(articles)
    web = F.col("url").startswith("http://") | F.col("url").startswith("https://")
    declared = refs.select(
        "day", F.col("id").alias("id"), "id_text", F.lit(1).alias("refs"), F.lit(0).alias("cites"),
        (~web).cast("int").alias("bad_url"), (strip(F.col("title")) == "").cast("int").alias("untitled"), F.lit(0).alias("bad_source"),
    )
    cited = item_sources(articles).select(
        "day", F.col("source").alias("id"), F.col("source").cast("string").alias("id_text"), F.lit(0).alias("refs"),
        F.col("source").isNotNull().cast("int").alias("cites"), F.lit(0).alias("bad_url"), F.lit(0).alias("untitled"),
        F.col("source").isNull().cast("int").alias("bad_source"),
    )
    per_id = declared.unionByName(cited).groupBy("day", "id", "id_text").agg(
        *[F.sum(c).alias(c) for c in ("refs", "cites", "bad_url", "untitled", "bad_source")]
    )
    has_id = F.col("id").isNotNull()
    tally = per_id.groupBy("day").agg(
        F.sum("refs").cast("int").alias("references"),
        F.count_if(has_id & (F.col("cites") > 0)).cast("int").alias("cited"),
        F.max((F.col("refs") > 1).cast("int")).alias("duplicate_ids"),
        F.sum("bad_url").cast("int").alias("bad_urls"),
        F.sum("untitled").cast("int").alias("untitled"),
        F.sum("bad_source").cast("int").alias("bad_sources"),
        F.sum(F.when(has_id & (F.col("refs") == 0), F.col("cites")).otherwise(0)).cast("int").alias("dangling"),
        F.count_if(has_id & (F.col("refs") > 0) & (F.col("cites") == 0)).cast("int").alias("orphans"),
    )
    counts = [c for c in tally.columns if c != "day"]
    parsed = parse_articles(articles).select("day", F.col("doc").isNull().alias("broken"))
    return (
        parsed.join(tally, "day", "left")
        .fillna(0, counts)
        .withColumn("problems", F.expr("duplicate_ids + bad_urls + untitled + bad_sources + dangling"))
        .withColumn("decision", F.when(F.col("broken") | (F.col("problems") > 0), F.lit("fail")).otherwise(F.lit("pass")))
        .drop("broken")
    )


def _readable(articles: DataFrame) -> DataFrame:
    return parse_articles(articles).select("day", F.col("doc").isNull().alias("broken"))


def _undecided(broken: Column, decision: Column | None) -> dict[str, Column]:
    """Decision and class of a gate that needs a profile; without one (None) only an unreadable article is decided."""
    given = F.lit("cannot_verify") if decision is None else decision
    unknown = F.lit("precondition_unknown" if decision is None else None).cast("string")
    return {"decision": F.when(broken, F.lit("fail")).otherwise(given), "failure_class": F.when(~broken, unknown)}


def depth_gate(articles: DataFrame, min_ratio: float = 0.6, profile: Profile | None = None) -> DataFrame:
    """Share of items whose body names a limitation, for every article; advisory, so content never fails it.

    The profile has the words that are signals of a `mechanism` and of a `limit`. Without a profile
    the gate cannot verify. An article without items has nothing to fault (ratio 1); one that cannot be
    read fails.
    """
    parsed = _readable(articles)
    if profile is None:
        none = {c: F.lit(0).cast("long") for c in ("items", "with_limit", "without_substance")}
        empty = parsed.withColumns({**none, "limit_ratio": F.lit(None).cast("double"), "below_target": F.lit(None).cast("boolean")})
        return empty.withColumns(_undecided(F.col("broken"), None)).drop("broken")
    items = flatten_items(articles)
    body = F.when(F.col("body_zh") != "", F.col("body_zh")).otherwise(F.col("body_en"))
    tally = items.groupBy("day").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(contains_any(body, profile.get("limit", ()))).alias("with_limit"),
        F.count_if(~contains_any(body, profile.get("mechanism", ()))).alias("without_substance"),
    )
    every = parsed.join(tally, "day", "left").fillna(0, ["items", "with_limit", "without_substance"])
    ratio = F.when(F.col("items") == 0, F.lit(1.0)).otherwise(F.bround(F.col("with_limit") / F.col("items"), 3))
    judged = every.withColumn("limit_ratio", ratio).withColumn("below_target", ratio < min_ratio)
    return judged.withColumns(_undecided(F.col("broken"), F.lit("pass"))).drop("broken")


def _brief_texts(items: DataFrame) -> DataFrame:
    """What a brief looks at in each of flatten_items()."""
    said = F.concat_ws(" ", "title_zh", "title_en", "body_zh", "body_en")
    body = F.when(F.col("body_zh") != "", F.col("body_zh")).otherwise(F.col("body_en"))
    return items.withColumns({"body": body, "said": said})


def _brief_marks(texts: DataFrame, profile: Profile) -> DataFrame:
    """What the profile says of each item, in place of its texts."""
    marked = texts.withColumns({"said": lowered(F.col("said")), "body": lowered(F.col("body")), "bare": F.col("body_zh") == ""}).withColumns({
        "hits": held(F.col("said"), profile.get("interest", ())), "out": holds_any(F.col("said"), profile.get("exclude", ())),
        "states_limit": holds_any(F.col("body"), profile.get("limit", ())),
    })
    return marked.withColumns({"why": F.array_join("hits", ", "), "interest": F.size("hits")}).drop("hits", "body_zh", "body", "said")


def _first_marks(marks: DataFrame, profile: Profile, limit: int) -> DataFrame:
    from attesta.operators.ranking import top_k

    fit = marks.filter(~F.col("out") & ((F.col("interest") > 0) if profile.get("interest", ()) else F.lit(True)))
    return top_k(fit, limit, ["day"], [F.desc("interest"), F.col("section_pos"), F.col("item_pos")], "place")


def brief_items(articles: DataFrame) -> DataFrame:
    """What a brief looks at in each item, written once: parsing is the dear part."""
    columns = ["day", "section_pos", "item_pos", "location", "body_zh", "body", F.lower("said").alias("said")]
    return materialise(_brief_texts(flatten_items(articles)).select(*columns), "items")


def select_brief(items: DataFrame, profile: Profile, limit: int = 5) -> DataFrame:
    """The items a reader should see first: (day, place, location, why, ...), at most `limit` of an article.

    Of brief_items(). Those with a word of `exclude` are out, and so are those without a word of `interest`, if the
    profile has any. Those with most interest words come first, then in document order; `why` lists the words.
    """
    chosen = _first_marks(_brief_marks(items, profile), profile, limit)
    return chosen.select("day", "location", "bare", "why", "interest", "states_limit", "place")


def brief_gate(articles: DataFrame, limit: int = 5, profile: Profile | None = None) -> DataFrame:
    """Does the profile find a brief in each article, and has every entry a Chinese body and a reason?

    Without a profile the gate cannot verify. An article in which nothing is selected fails, as does
    one that cannot be read. An article is parsed once; of its items only the marks are written.
    """
    counts = ["entries", "candidates", "excluded", "without_body", "without_reason", "without_limit"]
    if profile is None:
        return _readable(articles).withColumns({c: F.lit(0) for c in counts}).withColumns(_undecided(F.col("broken"), None)).drop("broken")
    doc = F.col("doc")
    parsed = parse_articles(articles).select("day", doc.isNull().alias("broken"), _sections(doc).alias("sections"))
    texts = _brief_texts(_read_items(_entries(parsed, every=True)))
    marks = _brief_marks(texts.select("day", "broken", "section_pos", "item_pos", "body_zh", "body", "said"), profile)
    marks = materialise(marks, "marks")
    items = marks.filter("item_pos is not null")
    chosen = _first_marks(items, profile, limit).groupBy("day").agg(
        F.count(F.lit(1)).cast("int").alias("entries"), F.count_if("bare").cast("int").alias("without_body"),
        F.count_if(F.col("why") == "").cast("int").alias("without_reason"), F.count_if(~F.col("states_limit")).cast("int").alias("without_limit"),
    )
    every = marks.groupBy("day", "broken").agg(
        F.count("item_pos").cast("int").alias("candidates"), F.count_if(F.col("item_pos").isNotNull() & F.col("out")).cast("int").alias("excluded")
    )
    joined = every.join(chosen, "day", "left").fillna(0, counts)
    bad = (F.col("entries") == 0) | (F.col("without_body") > 0) | (F.col("without_reason") > 0)
    return joined.withColumns(_undecided(F.col("broken"), F.when(bad, F.lit("fail")).otherwise(F.lit("pass")))).select("day", *counts, "decision", "failure_class")


def dedup_candidates(articles: DataFrame) -> DataFrame:
    """Items as duplicate candidates: rank is the document order, urls come from the references.

    When a reference id repeats, its last address counts.
    """
    # Both positions are 32-bit and not negative, so the rank is exact and unique within its article.
    items = flatten_items(articles).withColumn("rank", F.shiftleft(F.col("section_pos").cast("long"), 32) + F.col("item_pos"))
    urls = (
        references(articles)
        .filter("id is not null and url <> ''")
        .groupBy("day", "id")
        .agg(F.max_by(F.regexp_replace("url", "/+$", ""), "ref_pos").alias("url"))
    )
    linked = (
        items.select("day", "rank", F.explode("sources").alias("id"))
        .join(urls, ["day", "id"])
        .groupBy("day", "rank")
        .agg(F.collect_set("url").alias("urls"))
    )
    return items.join(linked, ["day", "rank"], "left").select(
        F.col("day").alias("article"), "rank", "location", "section", "title_zh", "title_en", "body_zh", "body_en",
        F.coalesce("urls", F.array().cast("array<string>")).alias("urls"),
    )
