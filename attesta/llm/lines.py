"""Near-duplicate lines: segment-partition join with one edit, exact and without pairs inside a bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import materialise

#: Lines with fewer characters between the blanks at their ends are never removed: short ones recur by chance.
MIN_CHARS = 20
EDITS = 1
PLACE = "decimal(31,0)"


def _part(text: Column, start: Column, length: Column) -> Column:
    """`length` characters from the 0-based start."""
    return text.substr((start + 1).cast("int"), length.cast("int"))


def line_rows(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, digest, line_no, line, n) for every line of at least `min_chars` characters, blanks at its ends included."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return own.withColumn("n", F.length("line")).filter(F.col("n") >= min_chars)


def _names() -> list[Column]:
    """128 bits for a line's text."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")]


def _place() -> Column:
    """Ids and line numbers in one exact, ordered number; null ids come last."""
    return (F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)") * F.lit(2**31) + F.col("line_no")).cast(PLACE)


def segment_keys(line: Column, n: Column) -> Column:
    """Index and probe keys of a line under one edit, which leaves one of two segments whole.

    Segments are those of the shorter line's layout. A line stands under both segments of its own
    length, and probes the layout one shorter: its first segment begins at the beginning, its second
    one ends at the end, so a line one longer is met at its ends.
    """
    def key(layout: Column, which: int) -> Column:
        half = F.floor(layout / 2)
        piece = _part(line, F.lit(0), half) if which == 0 else _part(line, n - (layout - half), layout - half)
        return F.xxhash64(layout.cast("int"), F.lit(which), piece)

    return F.array(*[key(layout, which) for layout in (n, n - 1) for which in (0, 1)])


def distinct_lines(rows: DataFrame) -> DataFrame:
    """(h1, h2, n, keys, place, copies): equal lines fold before anything is joined; no text is shuffled."""
    keys = segment_keys(F.col("line"), F.col("n"))
    named = rows.select(*_names(), "n", _place().alias("place"), *[keys[i].alias(f"k{i}") for i in range(4)])
    folded = named.groupBy("h1", "h2", "n", "k0", "k1", "k2", "k3").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    return folded


def _sharing(distinct: DataFrame) -> DataFrame:
    """(h1, h2, place) of lines that share a segment with another line."""
    entries = distinct.select("h1", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = entries.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("key")
    found = entries.join(shared, "key").select("h1").distinct()
    return distinct.join(found, "h1").select("h1", "h2", "place")


def _texts(docs: DataFrame, sharing: DataFrame, id_col: str, text: str) -> DataFrame:
    """(h1, h2, place, line): the texts of these lines, fetched by document."""
    # Line numbers of one document, as many as it has lines.
    wanted = sharing.select(
        _split_place("place")[0].alias("doc_id"), _split_place("place")[1].alias("line_no"), "h1", "h2", "place"
    ).groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1", "h2", "place")).alias("wanted"))
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("doc_id"), F.col(text).alias("text"))
    joined = own.join(wanted, "doc_id").select("wanted", F.split("text", "\n").alias("lines"))
    each = joined.select("lines", F.explode("wanted").alias("w")).select("w.*", F.get("lines", F.col("w.line_no")).alias("line"))
    # Rows that repeat an id may hold another text at that place.
    return each.filter((F.xxhash64("line") == F.col("h1")) & (F.xxhash64(F.lit(1), F.col("line")) == F.col("h2"))).select("h1", "h2", "place", "line").distinct()


def _blocks(texts: DataFrame) -> DataFrame:
    """(key, same, block, h1, h2, place): a line under all of itself but one block, for its own layout and the one shorter.

    Blocks grow with the root of the length. Two lines one edit apart agree before and behind one block of
    the shorter line's layout, whatever their number, so hot segments come apart here.
    """
    n = F.length("line")
    both = texts.select("*", n.alias("n"), F.explode(F.array(n, n - 1)).alias("layout")).filter("layout >= 0")
    size = F.greatest(F.lit(1), F.ceil(F.sqrt("layout"))).cast("int")
    cut = both.withColumn("size", size).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.expr("cast(greatest(layout - 1, 0) div size as int)")))
    )
    low = F.col("at") * F.col("size")
    behind = F.greatest(F.lit(0), F.col("layout") - low - F.col("size"))
    line = F.col("line")
    head, tail = _part(line, F.lit(0), low), _part(line, F.col("n") - behind, behind)
    block = _part(line, low, F.col("n") - behind - low)
    return cut.select(
        F.xxhash64("layout", "at", head, tail).alias("key"), (F.col("n") == F.col("layout")).alias("same"), block.alias("block"), "h1", "h2", "place"
    )


def _links(blocks: DataFrame) -> DataFrame:
    """(a, b, group, links) with places a < b.

    In a group all lines are one substitution at one place apart, or all longer ones give the one
    shorter line by leaving out a character. Groups hold as many lines as there are characters to
    put at one place, so every other line is linked to the earliest or the shorter one.
    """
    met = blocks.groupBy("key").agg(F.min("place").alias("low"), F.max("place").alias("high")).filter("low < high").select("key")
    rows = blocks.join(met, "key")
    n = F.length("block")
    without = F.transform(
        F.sequence(F.lit(1), n),
        lambda p: F.concat(F.substring("block", 1, p - 1), F.col("block").substr(p + 1, F.length("block"))),
    )
    kept = F.when(n > 0, without).otherwise(F.array().cast("array<string>"))
    swaps = F.transform(kept, lambda rest, p: F.xxhash64(F.lit("s"), F.col("key"), p, rest))
    whole = F.array(F.xxhash64(F.lit("i"), F.col("key"), F.col("block")))
    shorter = F.transform(F.array_distinct(kept), lambda rest: F.xxhash64(F.lit("i"), F.col("key"), rest))
    tagged = rows.select(
        "place", F.explode(F.when(F.col("same"), F.concat(
            F.transform(swaps, lambda k: F.struct(k.alias("key"), F.lit("swap").alias("role"))),
            F.transform(whole, lambda k: F.struct(k.alias("key"), F.lit("short").alias("role"))),
        )).otherwise(F.transform(shorter, lambda k: F.struct(k.alias("key"), F.lit("long").alias("role"))))).alias("t"),
    ).select("place", F.col("t.key").alias("key"), F.col("t.role").alias("role"))
    centres = tagged.groupBy("key").agg(
        F.min(F.when(F.col("role") == "swap", F.col("place"))).alias("first"), F.min(F.when(F.col("role") == "short", F.col("place"))).alias("short"),
        F.count(F.lit(1)).alias("size"),
    ).filter("size > 1 and (first is not null or short is not null)")
    joined = tagged.join(centres, "key")
    swap = joined.filter("role = 'swap'").select(F.col("first").alias("a"), F.col("place").alias("b"), "key", "size")
    indel = joined.filter("role = 'long' and short is not null").select(F.col("short").alias("a"), F.col("place").alias("b")).distinct()
    return swap.withColumn("indel", F.lit(False)).unionByName(
        indel.select("a", "b", F.lit(0).cast("long").alias("key"), F.lit(2).cast("long").alias("size"), F.lit(True).alias("indel"))
    )


def edit_distance_within(a: Column, b: Column, limit: int) -> Column:
    """Banded bit-parallel edit distance: the distance if it is at most `limit`, else limit + 1.

    In column j bit i of the band stands for row j - limit + i; `up` and `down` hold the cells one above
    or below the cell over them, moved on for the next column. The score runs along the lowest
    diagonal of the band, and the last column leads back from there to the corner.
    """
    width = 2 * limit + 1
    full = F.lit((1 << width) - 1).cast("long")
    m, n = F.length(a), F.length(b)

    def bit(i: int) -> Column:
        return F.lit(1 << i).cast("long")

    def step(s: Column, c: Column) -> Column:
        equal = F.lit(0).cast("long")
        for i in range(width):
            at = c["j"] - limit + i
            hit = (at >= 0) & F.get(s["pattern"], F.greatest(at, F.lit(0))).eqNullSafe(c["sign"])
            equal = equal.bitwiseOR(F.when(hit, bit(i)).otherwise(F.lit(0).cast("long")))
        up, down = s["up"], s["down"]
        same = (equal.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(equal).bitwiseOR(down).bitwiseAND(full)
        return F.struct(s["pattern"].alias("pattern"), up.alias("old_up"), down.alias("old_down"), same.alias("same"), s["score"].alias("score"))

    def move(s: Column) -> Column:
        up, down, same = s["old_up"], s["old_down"], s["same"]
        right = down.bitwiseOR(full.bitwiseAND(F.bitwise_not(same.bitwiseOR(up))))
        left = same.bitwiseAND(up)
        shifted = F.shiftright(same, 1)
        return F.struct(
            s["pattern"].alias("pattern"), left.bitwiseOR(full.bitwiseAND(F.bitwise_not(shifted.bitwiseOR(right)))).alias("up"),
            shifted.bitwiseAND(right).alias("down"),
            (s["score"] + F.when(same.bitwiseAND(bit(width - 1)) == 0, 1).otherwise(0)).alias("score"),
        )

    start = F.struct(
        F.split(a, "").alias("pattern"), F.lit((1 << width) - (1 << limit)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"),
        F.lit(limit).alias("score"),
    )
    signs = F.transform(F.split(b, ""), lambda sign, j: F.struct(sign.alias("sign"), j.alias("j")))

    def whole(s: Column, c: Column) -> Column:
        # One element per intermediate, so that each is evaluated once.
        return F.element_at(F.transform(F.array(step(s, c)), move), 1)

    def corner(s: Column) -> Column:
        back = F.lit(0)
        for i in range(width - 1):
            change = F.shiftright(s["up"], i).bitwiseAND(bit(0)) - F.shiftright(s["down"], i).bitwiseAND(bit(0))
            back = back + F.when(F.lit(i) >= m - n + limit, change).otherwise(F.lit(0).cast("long"))
        return F.least(s["score"] - back, F.lit(limit + 1).cast("long")).cast("int")

    found = F.aggregate(signs, start, whole, corner)
    return F.when(F.abs(m - n) > limit, limit + 1).when(F.least(m, n) == 0, F.greatest(m, n)).otherwise(found)


def line_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(lines, links): distinct lines (h1, h2, place, copies), and all links between them.

    links: (place, first, n_links) for each line one edit from another: the earliest of itself and its
    neighbours, and how many neighbours it has. Every link found is verified on the texts.
    """
    folded = materialise(distinct_lines(line_rows(docs, id_col, text, min_chars)), "lines")
    texts = materialise(_texts(docs, _sharing(folded), id_col, text), "texts")
    found = materialise(_links(_blocks(texts)), "links")
    named = texts.select("place", "line")
    pairs = found.filter("a <> b")
    checked = (
        pairs.join(named.select(F.col("place").alias("a"), F.col("line").alias("line_a")), "a")
        .join(named.select(F.col("place").alias("b"), F.col("line").alias("line_b")), "b")
        .filter(edit_distance_within(F.col("line_a"), F.col("line_b"), EDITS) <= EDITS)
        .select("a", "b", "key", "size", "indel")
    )
    # A swap group of s lines gives each of them s - 1 links, the earliest one through its own row.
    swaps = checked.filter("not indel")
    heads = swaps.select(F.col("a").alias("place"), F.col("a").alias("first"), "key", F.col("size") - 1).distinct().drop("key").toDF("place", "first", "n")
    tails = swaps.select(F.col("b").alias("place"), F.col("a").alias("first"), (F.col("size") - 1).alias("n"))
    indels = checked.filter("indel")
    short = indels.select(F.col("a").alias("place"), F.least("a", "b").alias("first"), F.lit(1).cast("long").alias("n"))
    long = indels.select(F.col("b").alias("place"), F.least("a", "b").alias("first"), F.lit(1).cast("long").alias("n"))
    each = heads.unionByName(tails).unionByName(short).unionByName(long)
    links = each.groupBy("place").agg(F.least(F.min("first"), F.min("place")).alias("first"), F.sum("n").alias("n_links"))
    return folded, links


def _split_place(place: str) -> tuple[Column, Column]:
    number = F.expr(f"pmod({place}, cast(2147483648 as decimal(31,0)))")
    return F.expr(f"({place} - pmod({place}, cast(2147483648 as decimal(31,0)))) div 2147483648").cast("long"), number.cast("int")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, digest, line_no, class_doc, class_line, n_links, copies, kept) for every line of enough characters.

    The class of a line is its earliest neighbour: by document id, then line number, over all lines equal
    to it or one edit away. A line is kept if it is the first of its text and has no earlier neighbour.
    `n_links` counts other texts one edit away, `copies` the rows with this very text. Null ids come
    last and, with no other place, are always kept; null texts and short lines have no rows; rows that
    repeat one id and text are one document. `digest` tells rows of one id apart.
    """
    return _classes(docs, id_col, text, min_chars).drop("inner")


def _classes(docs: DataFrame, id_col: str, text: str, min_chars: int) -> DataFrame:
    """`line_classes`, and the number of characters between the blanks at a line's ends as `inner`."""
    folded, links = line_links(docs, id_col, text, min_chars)
    known = folded.join(links, "place", "left").select(
        "h1", "h2", F.col("place").alias("own"), F.coalesce("first", "place").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies"
    )
    rows = line_rows(docs, id_col, text, min_chars).select(
        "doc_id", "digest", "line_no", _place().alias("place"), *_names(), F.length(F.trim("line")).alias("inner")
    )
    doc, line = _split_place("first")
    kept = (F.col("place") == F.col("own")) & (F.col("first") == F.col("own")) | F.col("doc_id").isNull()
    return rows.join(known, ["h1", "h2"]).select(
        "doc_id", "digest", "line_no", doc.alias("class_doc"), line.alias("class_line"), "n_links", "copies", kept.alias("kept"), "inner"
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines, all columns; `n_chars` follows the text.

    Lines of fewer than `min_chars` characters between the blanks at their ends stay; one edit shorter
    ones are read too, as longer lines may repeat them. A document of which no character is left goes; one without repeated lines stays as it is.
    """
    gone = _classes(docs, id_col, text, max(0, min_chars - EDITS)).filter(~F.col("kept") & (F.col("inner") >= min_chars))
    # Line numbers of one document, as many as it has lines.
    per_doc = gone.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_set("line_no").alias("_gone"))
    # The row travels in a struct, so its column names cannot clash with those used here.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    joined = own.join(per_doc, (F.col("id") == F.col("_id")) & (F.col("own") == F.col("_digest")), "left")
    numbered = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i))
    kept = F.when(F.col("_gone").isNotNull(), F.array_join(numbered, "\n"))
    out = joined.select("row", "_gone", "text", kept.alias("kept")).filter("_gone is null or length(trim(kept)) > 0")
    changed = {text: F.coalesce("kept", "text")}
    if n_chars and n_chars in docs.columns:
        own_count = F.col("row").getField(n_chars)
        changed[n_chars] = F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema[n_chars].dataType)).otherwise(own_count)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
