"""Near-duplicate entries inside an article: exact scores without comparing all pairs.

Input: candidates(article, rank, location, section, title_zh, title_en, body_zh, body_en, urls)
with `rank` a bigint unique within its article.

How quadratic work is avoided, with nothing dropped, capped or sampled:
* entries equal in everything the score reads are folded into one *entry class* with a count;
* entries with the same normalised title always score 0.95, so they are handled as groups
  (an aggregate), never as pairs;
* other pairs at or above the 0.60 line must pass one of three overlap thresholds. Entries with the
  same tokens are one set; sets are dealt out in blocks by size, a set passes by the blocks of sizes it may
  overlap, and in a task it meets them on its rarest tokens only (overlap). Pairs leave the task when their
  whole sets overlap enough, so what is shuffled is sets and true pairs, never pairs that share a token;
* titles and whole token sets are compared by digests, texts are fetched for entries of found pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions.text import jaccard, normalise_title, title_band, tokens
from attesta.functions.vocabulary import BORDERLINE_SCORE, DUPLICATE_SCORE
from attesta.operators.overlap import overlapping
from attesta.operators.skew import few
from attesta.session import materialise, written

_TITLE_OVERLAP = 0.5    # lowest overlap that scores 0.62 by title alone
_SHARED_OVERLAP = 0.3   # lowest overlap that matters when a cited URL is shared
_BODY_OVERLAP = 0.6
#: Keys from which a node's sets are dealt out in blocks, keys of a block, and parts into which sets of one size can be cut.
HOT_NODE, BLOCK_KEYS, SLICES = 1_000_000, 16_000_000, 1_024


def entry_classes(candidates: DataFrame) -> DataFrame:
    """One row per distinct entry of an article: the first copy, and how many copies there are."""
    text = [F.coalesce(c, F.lit("")) for c in ("title_zh", "title_en", "body_zh", "body_en")]
    urls = F.array_sort(F.array_distinct(F.coalesce("urls", F.array().cast("array<string>"))))
    identity = F.sha2(F.concat_ws("\x1f", "section", *text, F.array_join(urls, "\x1e")), 256)
    columns = ["section", "location", "title_zh", "title_en", "body_zh", "body_en"]
    node = ["article", "rank"]
    # Numbers are folded; texts stay where they are unless very many entries are copies.
    folded = (
        candidates.select(*node, F.unhex(identity).alias("identity"))
        .groupBy("article", "identity")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("rank").alias("rank"))
        .select(*node, "copies")
    )
    placed = candidates.select(*node, F.lit(None).cast("long").alias("copies")).unionByName(folded).dropna(subset=node)
    counts = placed.groupBy(*node).agg(F.sort_array(F.collect_list("copies")).alias("copies")).filter("copies <> array(1L)")
    copied = few(materialise(counts, "copied"))
    held = candidates.select(*node, *columns, urls.alias("urls")).dropna(subset=node).join(copied, node, "left")
    first = held.withColumn("copies", F.explode(F.coalesce("copies", F.expr("array(1L)"))))
    return first.select(
        "article",
        "rank",
        "copies",
        "location",
        "section",
        "urls",
        normalise_title(F.coalesce("title_zh", F.lit(""))).alias("norm_zh"),
        normalise_title(F.coalesce("title_en", F.lit(""))).alias("norm_en"),
        tokens(F.col("title_zh")).alias("title_zh"),
        tokens(F.col("title_en")).alias("title_en"),
        tokens(F.col("body_zh")).alias("body_zh"),
        tokens(F.col("body_en")).alias("body_en"),
    )


def plan(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry classes, class pairs), each written once: every later step reads both."""
    spark = candidates.sparkSession
    classes = written(lambda: entry_classes(candidates), spark, "entries")
    return classes, written(lambda: class_pairs(classes), spark, "pairs")


def short_digest(text: Column) -> Column:
    """The first 16 bytes of the SHA-256 digest."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _token_sets(classes: DataFrame) -> DataFrame:
    """(article, rank, norm_zh, norm_en, scope, needed, tokens, keys, digest): every set an overlap rule looks at, with the
    lowest overlap that matters to it. Titles are also scoped by each cited URL.

    A key is a hash of article, scope and token, one for each token. Equal keys of unlike tokens only add to
    what is scored; the digest tells sets apart.
    """

    def entry(scope: Column, needed: float, tokens_: Column) -> Column:
        return F.struct(scope.alias("scope"), F.lit(needed).alias("needed"), tokens_.alias("tokens"))

    plain = [
        entry(F.lit(f"{stem}-{lang}"), needed, F.col(f"{stem}_{lang}"))
        for stem, needed in (("title", _TITLE_OVERLAP), ("body", _BODY_OVERLAP))
        for lang in ("zh", "en")
    ]
    linked = [
        F.transform("urls", lambda url: entry(F.concat(F.lit("zh "), url), _SHARED_OVERLAP, F.col("title_zh"))),
        F.transform("urls", lambda url: entry(F.concat(F.lit("en "), url), _SHARED_OVERLAP, F.col("title_en"))),
    ]
    spread = classes.select("article", "rank", "norm_zh", "norm_en", F.explode(F.concat(F.array(*plain), *linked)).alias("s"))
    digest = short_digest(F.array_join(F.sort_array("s.tokens"), " "))
    keys = F.transform("s.tokens", lambda token: F.hash("article", "s.scope", token))
    return spread.filter("size(s.tokens) > 0 and s.scope is not null").select("article", "rank", "norm_zh", "norm_en", "s.scope", "s.needed", "s.tokens", keys.alias("keys"), digest.alias("digest"))


def _node() -> Column:
    """A number for article and scope, whose sets are compared."""
    return F.xxhash64("article", "scope")


def _blocks(sets: DataFrame, hot: int, block: int) -> tuple[DataFrame, int]:
    """(node, needed, blocks) of the nodes with more than `hot` keys, and how many tasks the other nodes are packed into.

    A block is (size, slice), where it begins in that order. Large nodes have few large blocks, as a set goes to several.
    """
    key = ["node", "needed"]
    weights = materialise(sets.groupBy(*key).agg(F.sum("size").alias("weight")), "weights")
    large = weights.filter(F.col("weight") > hot).select(*key, F.least(F.lit(block), F.greatest(F.col("weight") / 4, F.lit(block / 8))).alias("block"))
    rest = weights.filter(F.col("weight") <= hot).agg(F.sum("weight")).first()[0] or 0
    cells = sets.join(F.broadcast(large), key).groupBy(*key, "block", "size", _slice()).agg(F.sum("size").alias("weight"))
    before = F.sum("weight").over(W.partitionBy(*key).orderBy("size", "slice")) - F.col("weight")
    numbered = cells.withColumn("no", F.floor(before / F.col("block"))).groupBy(*key, "no").agg(F.min(F.struct("size", "slice")).alias("start"))
    blocks = numbered.groupBy(*key).agg(F.array_sort(F.collect_list("start")).alias("blocks"))
    return materialise(blocks, "blocks"), int(rest // max(block // 4, 1)) + 1


def _sized() -> list[Column | str]:
    return [_node().alias("node"), "needed", "digest", F.size("tokens").alias("size")]


def _slice() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(SLICES)).cast("int").alias("slice")


def _meeting_sets(sets: DataFrame, sized: DataFrame | None = None, hot: int = HOT_NODE, block: int = BLOCK_KEYS) -> DataFrame:
    """Distinct (node, small, large) digests of different sets whose overlap can be enough by their whole keys.

    `sized` has node, needed, digest and size of the same sets, if that is at hand.

    The sets of an article and scope stand in the order of their sizes. Small nodes are packed, several to a
    task. Those of more than `hot` keys are cut into blocks of at most about `block` keys. A task holds one block, and the sets
    of earlier blocks that are not too small for its first set pass by it, so its memory doesn't grow with the node.
    """
    blocks, packs = _blocks(sets.select(*_sized()) if sized is None else sized, hot, block)
    placed = sets.select(*_sized(), "keys").withColumn("slice", _slice()).join(F.broadcast(blocks), ["node", "needed"], "left")
    own = F.size(F.filter("blocks", lambda b: b <= F.struct("size", "slice"))) - 1
    last = F.size("blocks") - 1
    reached = F.filter(F.sequence("own", last), lambda j: (j == F.col("own")) | (F.col("blocks")[j]["size"] * (F.col("needed") - 1e-9) <= F.col("size")))
    packed = F.col("blocks").isNull()
    dealt = placed.withColumn("own", F.when(packed, -1).otherwise(own)).select(
        "needed",
        F.when(packed, F.pmod("node", F.lit(packs))).otherwise(F.col("node")).alias("unit"),
        F.explode(F.when(packed, F.array(F.lit(-1))).otherwise(reached)).alias("part"),
        "own", "size", "node", "digest", "keys",
    )
    task = ["needed", "unit", "part"]
    columns = [*task, (F.col("part") != F.col("own")).alias("passes"), "size", "node", "digest", F.sort_array("keys").alias("keys")]
    ordered = dealt.select(*columns).repartition(*task).sortWithinPartitions(*task, "passes", "size", "node", "digest")
    return ordered.mapInArrow(overlapping, "node long, small binary, large binary")


def _similar_sets(sets: DataFrame, sized: DataFrame | None = None, **limits: int) -> DataFrame:
    """_meeting_sets, written: each later step reads them."""
    return written(lambda: _meeting_sets(sets, sized, **limits), sets.sparkSession, "similar")


def _title_key(norm: str) -> Column:
    """A digest in place of a title; an empty title stays empty."""
    return F.when(F.col(norm) == "", F.lit(bytearray())).otherwise(short_digest(F.col(norm))).alias(norm)


def _meeting_pairs(classes: DataFrame, **limits: int) -> DataFrame:
    """Distinct (article, rank_a, rank_b), rank_a < rank_b, of entries that pass some overlap and share no normalised title.

    Entries with the same tokens are one set, which is compared once. Similar sets, and the entries of one
    set, are told apart by their titles before they are listed, so entries of one title never meet.
    """
    node, titles = ["article", "node", "digest"], ["norm_zh", "norm_en"]
    owned = _token_sets(classes)
    every = materialise(owned.select("article", *_sized(), *[_title_key(t) for t in titles], "rank"), "sized")
    similar = _similar_sets(owned, sized=every, **limits)
    title = F.struct(*titles)
    untitled = (F.length("last.norm_zh") == 0) & (F.length("last.norm_en") == 0)
    shared = every.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.min(title).alias("first"), F.max(title).alias("last"))
    own = materialise(shared.filter((F.col("n") > 1) & ((F.col("first") != F.col("last")) | untitled)).select(*node), "own")
    # Of most sets no more is needed than that they are alone.
    ends = similar.select("node", F.explode(F.array("small", "large")).alias("digest"))
    wanted = few(materialise(ends.unionByName(own.select("node", "digest")).distinct(), "wanted"))
    members = materialise(every.join(wanted, ["node", "digest"], "left_semi").select(*node, *titles, "rank"), "members")
    groups = members.groupBy(*node, *titles).agg(F.min("rank").alias("first"))
    a = groups.withColumnsRenamed({"digest": "small", **{c: f"{c}_a" for c in (*titles, "first")}})
    b = groups.withColumnsRenamed({"digest": "large", **{c: f"{c}_b" for c in (*titles, "first")}})
    same = [(F.col(f"{t}_a") == F.col(f"{t}_b")) & (F.length(f"{t}_a") > 0) for t in titles]
    once = (F.col("small") != F.col("large")) | (F.col("first_a") <= F.col("first_b"))
    met = similar.unionByName(own.select("node", F.col("digest").alias("small"), F.col("digest").alias("large")))
    apart = met.join(a, ["node", "small"]).join(b, ["article", "node", "large"]).filter(once & ~same[0] & ~same[1])
    entries = apart
    for side, digest in (("a", "small"), ("b", "large")):
        one = members.withColumnsRenamed({"digest": digest, "rank": f"rank_{side}", **{t: f"{t}_{side}" for t in titles}})
        entries = entries.join(one, ["article", "node", digest, *[f"{t}_{side}" for t in titles]])
    pair = entries.filter("rank_a <> rank_b").select("article", F.least("rank_a", "rank_b").alias("rank_a"), F.greatest("rank_a", "rank_b").alias("rank_b"))
    return pair.distinct()


def _linked_pairs(meeting: DataFrame, classes: DataFrame, bodies: bool) -> DataFrame:
    """Pairs with their score by titles and cited URLs (`linked`) and, if asked for, the overlap of their bodies.

    The steps are separate projections, so an overlap is computed once and not once per rule.
    """
    ends = meeting.select("article", F.explode(F.array("rank_a", "rank_b")).alias("rank")).distinct()
    used = classes.join(few(materialise(ends, "ends")), ["article", "rank"], "left_semi")
    a, b, m = used.alias("a"), used.alias("b"), meeting.alias("m")
    joined = m.join(a, (F.col("m.article") == F.col("a.article")) & (F.col("m.rank_a") == F.col("a.rank"))).join(
        b, (F.col("m.article") == F.col("b.article")) & (F.col("m.rank_b") == F.col("b.rank"))
    )

    def same(lang: str) -> Column:
        return (F.col(f"a.norm_{lang}") == F.col(f"b.norm_{lang}")) & (F.col(f"a.norm_{lang}") != "")

    def overlap(lang: str) -> Column:
        untitled = (F.col(f"a.norm_{lang}") == "") | (F.col(f"b.norm_{lang}") == "")
        shared = jaccard(F.col(f"a.title_{lang}"), F.col(f"b.title_{lang}"))
        return F.when(untitled, F.lit(0.0)).when(same(lang), F.lit(1.0)).otherwise(shared)

    body = [F.greatest(*[jaccard(F.col(f"a.body_{lang}"), F.col(f"b.body_{lang}")) for lang in ("zh", "en")]).alias("body")] if bodies else []
    measured = joined.select(
        "m.article", "m.rank_a", "m.rank_b",
        *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("a", "b") for c in ("location", "copies")],
        (F.col("a.section") == F.col("b.section")).alias("together"),
        F.arrays_overlap("a.urls", "b.urls").alias("shares"),
        *[same(lang).alias(f"same_{lang}") for lang in ("zh", "en")],
        *[overlap(lang).alias(f"overlap_{lang}") for lang in ("zh", "en")],
        *body,
    )

    def title(lang: str) -> Column:
        return F.when(F.col(f"same_{lang}"), F.lit(0.95)).otherwise(title_band(F.col(f"overlap_{lang}")))

    titled = measured.withColumns({"title": F.greatest(title("zh"), title("en")), "overlap": F.greatest("overlap_zh", "overlap_en")})
    proven = F.when(F.col("together"), F.col("overlap") >= 0.4).otherwise(F.col("overlap") >= 0.75)
    linked = (
        F.when(F.col("shares") & proven, F.greatest("title", F.lit(0.9)))
        .when(F.col("shares") & (F.col("title") < BORDERLINE_SCORE) & (F.col("overlap") >= _SHARED_OVERLAP), F.lit(0.66))
        .otherwise(F.col("title"))
    )
    return titled.withColumn("linked", linked).drop("together", "shares", "same_zh", "same_en", "overlap_zh", "overlap_en", "title", "overlap")


def score_pairs(meeting: DataFrame, classes: DataFrame) -> DataFrame:
    """Exact score of each pair by the fixed rules for titles, cited URLs and bodies.

    Bodies are fetched only for pairs that are below the grey line without them.
    """
    linked = materialise(_linked_pairs(meeting, classes, False), "linked")
    below = F.col("linked") < BORDERLINE_SCORE
    rest = materialise(linked.filter(below).select("article", "rank_a", "rank_b").distinct(), "below")
    by_body = _linked_pairs(rest, classes, True).filter(below)
    scored = linked.filter(~below).withColumn("score", F.col("linked")).unionByName(
        by_body.withColumn("score", F.when(F.col("body") >= _BODY_OVERLAP, F.lit(0.62)).otherwise(F.col("linked"))).drop("body")
    )
    return scored.select("article", "rank_a", "rank_b", "location_a", "location_b", "copies_a", "copies_b", "score")


def band(score: Column) -> Column:
    return (
        F.when(score >= DUPLICATE_SCORE, F.lit("duplicate"))
        .when(score >= BORDERLINE_SCORE, F.lit("borderline"))
        .otherwise(F.lit("distinct"))
    )


def class_pairs(classes: DataFrame, **limits: int) -> DataFrame:
    """Pairs of entry classes at or above 0.60 whose normalised titles differ.

    Pairs of copies repeat the score of their first copies, so a row stands for
    copies_a * copies_b pairs of entries (`pairs`). Equal titles are in title_groups().
    """
    scored = score_pairs(materialise(_meeting_pairs(classes, **limits), "meeting"), classes)
    return (
        scored.filter((F.col("score") >= BORDERLINE_SCORE) & (F.col("score") < 0.95))
        .withColumn("verdict", band(F.col("score")))
        .withColumn("pairs", F.col("copies_a") * F.col("copies_b"))
    )


def _titled(classes: DataFrame) -> DataFrame:
    """One row per class and non-empty normalised title."""
    both = F.array(
        F.struct(F.lit("zh").alias("lang"), F.col("norm_zh").alias("norm")),
        F.struct(F.lit("en").alias("lang"), F.col("norm_en").alias("norm")),
    )
    return (
        classes.select("article", "rank", "location", "copies", F.explode(both).alias("t"))
        .filter("t.norm <> ''")
        .select("article", "rank", "location", "copies", "t.lang", "t.norm")
    )


def _grouped(titled: DataFrame, title: str) -> DataFrame:
    members = F.sum("copies")
    return (
        titled.groupBy("article", "lang", title)
        .agg(
            members.alias("members"),
            F.min("rank").alias("first_rank"),
            F.min_by("location", "rank").alias("first_location"),
        )
        .filter("members > 1")
        .withColumn("pairs", F.expr("members * (members - 1) div 2"))
    )


def title_groups(classes: DataFrame) -> DataFrame:
    """Entries that share a normalised title: all their pairs score 0.95."""
    return _grouped(_titled(classes), "norm")


def _digest_groups(classes: DataFrame) -> DataFrame:
    """title_groups() by the digests of titles (`title`), which are shorter."""
    return _grouped(_titled(classes).withColumn("title", short_digest(F.col("norm"))).drop("norm"), "title")


def resolve(candidates: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries dropped without a judge: (article, rank, location, kept, score).

    The later entry of every duplicate pair is dropped, and the pair with the best score, then
    the earliest partner, names the entry kept. A same-title partner (0.95) always outranks a
    shared-source partner (0.90), and only the first copy of a class can lack the former.
    """
    first = _digest_groups(classes).select(
        "article", "lang", "title", F.struct("first_rank", "first_location").alias("first")
    )
    norms = F.array(
        F.struct(F.lit("zh").alias("lang"), normalise_title(F.col("title_zh")).alias("norm")),
        F.struct(F.lit("en").alias("lang"), normalise_title(F.col("title_en")).alias("norm")),
    )
    entries = candidates.select("article", "rank", "location", F.explode(norms).alias("t")).filter("t.norm <> ''").select(
        "article", "rank", "location", "t.lang", short_digest(F.col("t.norm")).alias("title")
    )
    by_title = (
        entries.join(first, ["article", "lang", "title"])
        .filter("rank > first.first_rank")
        .groupBy("article", "rank", "location")
        .agg(F.min("first")["first_location"].alias("kept"))
        .withColumn("score", F.lit(0.95))
    )
    by_source = (
        pairs.filter("verdict = 'duplicate'")
        .groupBy("article", F.col("rank_b").alias("rank"), F.col("location_b").alias("location"))
        .agg(F.max(F.struct("score", (-F.col("rank_a")).alias("r"), F.col("location_a").alias("kept"))).alias("best"))
        .select("article", "rank", "location", F.col("best.kept").alias("kept"), F.col("best.score").alias("score"))
    )
    return by_title.unionByName(by_source.join(by_title.select("article", "rank"), ["article", "rank"], "left_anti"))


def unjudged(pairs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Grey-band pairs of distinct entries whose later one was not dropped: work for a judge."""
    gone = dropped.select("article", F.col("rank").alias("rank_b"))
    return pairs.filter("verdict = 'borderline'").join(gone, ["article", "rank_b"], "left_anti")


def judged_pairs(pairs: DataFrame, answers: DataFrame | None = None, max_calls: int = 8) -> DataFrame:
    """Grey pairs of unjudged() with `same`, `call` and `outcome`: dropped, distinct, unjudged or skipped.

    An article's pairs are asked about in order of score, then ranks, as long as it has calls left; a pair whose
    later entry has gone is skipped and costs no call. `answers` is (article, rank_a, rank_b, same): true drops the
    later entry, false leaves both, and a call without an answer settles nothing. Without `answers` these are the
    pairs to ask about first. The limit is the judge's call budget; pairs beyond it stay unjudged.

    A pair is skipped if a better one with the same later entry was confirmed, and the first confirmed one of an
    entry is never skipped itself. So the fold needs no state: aggregates find the first, a numbering the calls.
    """
    from attesta.operators.ranking import top_k

    key, place = ["article", "rank_a", "rank_b"], F.struct((-F.col("score")).alias("n"), "rank_a")
    answered = pairs.withColumn("same", F.lit(None).cast("boolean")) if answers is None else pairs.join(answers.select(*key, "same"), key, "left")
    first = answered.filter("same").groupBy("article", "rank_b").agg(F.min(place).alias("first"))
    placed = answered.join(first, ["article", "rank_b"], "left").withColumn("open", F.col("first").isNull() | (place <= F.col("first")))
    order = [F.desc("score"), F.col("rank_a"), F.col("rank_b")]
    calls = top_k(placed.filter("open").select(*key, "score", "same"), max_calls, ["article"], order, "call")
    gone = calls.filter("same").select("article", "rank_b", F.lit(True).alias("gone"))
    joined = placed.join(calls.select(*key, "call"), key, "left").join(gone, ["article", "rank_b"], "left")
    outcome = (
        F.when(F.col("call").isNull(), F.when(~F.col("open") & F.col("gone"), F.lit("skipped")).otherwise(F.lit("unjudged")))
        .when(F.col("same"), F.lit("dropped")).when(~F.col("same"), F.lit("distinct")).otherwise(F.lit("unjudged"))
    )
    return joined.withColumn("outcome", outcome).drop("first", "open", "gone")


def all_dropped(dropped: DataFrame, judged: DataFrame) -> DataFrame:
    """Entries that go, with who decided: (article, rank, location, kept, score, source)."""
    own = dropped.withColumn("source", F.lit("deterministic"))
    told = judged.filter("outcome = 'dropped'").select(
        "article", F.col("rank_b").alias("rank"), F.col("location_b").alias("location"), F.col("location_a").alias("kept"), "score", F.lit("model").alias("source")
    )
    return own.unionByName(told)


def judged_metrics(pairs: DataFrame, dropped: DataFrame, judged: DataFrame) -> DataFrame:
    """Per article: entries dropped, clear and grey pairs, calls, and grey pairs left open; pairs are those listed."""
    listed = pairs.groupBy("article").agg(
        F.count_if(F.col("verdict") == "duplicate").alias("clear"), F.count_if(F.col("verdict") == "borderline").alias("grey")
    )
    told = judged.groupBy("article").agg(F.count("call").alias("judged"), F.count_if(F.col("outcome") == "unjudged").alias("unjudged"))
    gone = all_dropped(dropped, judged).groupBy("article").agg(F.count(F.lit(1)).alias("dropped"))
    return gone.join(listed, "article", "full").join(told, "article", "full").fillna(0)


def duplicate_gate(
    candidates: DataFrame, classes: DataFrame, pairs: DataFrame, dropped: DataFrame, borderline: str = "warn"
) -> DataFrame:
    """Per article: exact pair counts, drops and the decision, all from class counts.

    Same-title pairs of two languages are counted once by inclusion and exclusion. Untitled
    copies with a body meet the body rule and count as borderline pairs.
    """
    choose2 = "n * (n - 1) div 2"
    items = candidates.groupBy("article").agg(F.count(F.lit(1)).alias("items"))
    by_lang = _digest_groups(classes).groupBy("article").agg(F.sum("pairs").alias("same_title"))
    both = (
        classes.filter("norm_zh <> '' and norm_en <> ''")
        .groupBy("article", *[short_digest(F.col(f"norm_{lang}")) for lang in ("zh", "en")])
        .agg(F.sum("copies").alias("n"))
        .groupBy("article")
        .agg(F.sum(F.expr(choose2)).alias("same_both"))
    )
    counted = pairs.groupBy("article").agg(
        F.sum(F.when(F.col("verdict") == "duplicate", F.col("pairs"))).alias("linked"),
        F.sum(F.when(F.col("verdict") == "borderline", F.col("pairs"))).alias("grey"),
        F.max("score").alias("pair_score"),
    )
    untitled = (
        classes.filter("norm_zh = '' and norm_en = '' and (size(body_zh) > 0 or size(body_en) > 0) and copies > 1")
        .groupBy("article")
        .agg(F.sum(F.expr("copies * (copies - 1) div 2")).alias("copies_grey"))
    )
    drops = dropped.groupBy("article").agg(F.count(F.lit(1)).alias("dropped"))
    joined = items
    for part in (by_lang, both, counted, untitled, drops):
        joined = joined.join(part, "article", "left")
    joined = joined.fillna(0, ["same_title", "same_both", "linked", "grey", "copies_grey", "dropped"])
    duplicate = F.col("same_title") - F.col("same_both") + F.col("linked")
    grey = F.col("grey") + F.col("copies_grey")
    best = (
        F.when(F.col("same_title") > 0, F.lit(0.95))
        .otherwise(F.greatest(F.coalesce("pair_score", F.lit(0.0)), F.when(F.col("copies_grey") > 0, F.lit(0.62)).otherwise(F.lit(0.0))))
    )
    undecided = F.lit("cannot_verify") if borderline == "cannot_verify" else F.lit("pass")
    return joined.select(
        "article",
        "items",
        duplicate.alias("duplicate_pairs"),
        grey.alias("borderline_pairs"),
        best.alias("max_pair_score"),
        "dropped",
        F.when(F.col("dropped") > 0, F.lit("fail")).when(grey > 0, undecided).otherwise(F.lit("pass")).alias("decision"),
    )
