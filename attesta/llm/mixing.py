"""Mixing sources to target weights: budgets down a tree, then a token prefix of each leaf's seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import materialise

#: A token is a run of characters other than blanks.
TOKEN = "[^ \\t\\n\\r\\f\\x0B]+"
SLICE_ROWS = 1000


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th token, blanks before and between tokens included."""
    blanks = TOKEN.replace("[^", "[").removesuffix("+") + "*"
    pieces = F.regexp_extract_all(text, F.lit(f"({blanks}{TOKEN})"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def _weight(levels: list[str], depth: int, weights: dict[tuple[str, ...], int]) -> Column:
    """Weight of a node among its siblings: that of the longest ending of its path that is named, else 1."""
    named = F.lit(1).cast("long")
    for size in range(1, depth + 1):
        for path, w in weights.items():
            if len(path) == size:
                fits = F.lit(True)
                for name, value in zip(levels[depth - size : depth], path):
                    fits = fits & F.col(name).eqNullSafe(F.lit(value))
                named = F.when(fits, F.lit(w).cast("long")).otherwise(named)
    return named


def _share(children: DataFrame, parents: DataFrame | None, above: list[str], own: list[str], budget: int) -> DataFrame:
    """Give each parent's budget to its children by weight, none beyond its capacity.

    Children are taken by capacity for their weight. One is full while its capacity is below its share of
    what the ones before it left; what full ones cannot take goes to their siblings, so a shortage
    reaches an ancestor only as far as a whole subtree is short of it. Shares are rounded down.
    """
    if parents is None:
        joined = children.withColumn("budget", F.lit(budget).cast("long"))
    else:
        # Null-safe on the path, so nodes with a null name keep their budget.
        renamed = parents.select(*[F.col(c).alias(f"_{c}") for c in above], F.col("given").alias("budget"))
        same = F.lit(True)
        for c in above:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        joined = children.join(renamed, same).drop(*[f"_{c}" for c in above])
    order = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    # Null names stand behind all others on a tie.
    ranked = order.orderBy(F.col("capacity") / F.col("weight"), *[F.col(c).asc_nulls_last() for c in own])
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        joined.filter("weight > 0")
        .withColumn("_cap", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("_left", F.sum("weight").over(order) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_full", F.expr(
            "cast(capacity as decimal(19,0)) * cast(_left as decimal(19,0)) <= cast(budget - _cap as decimal(19,0)) * cast(weight as decimal(19,0))"
        ))
        .withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(order))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(order))
    )
    share = F.expr("(cast(budget - _taken as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(_open as decimal(19,0))")
    given = F.when(F.col("_full"), F.col("capacity")).otherwise(share)
    return filled.withColumn("given", given).select(*own, "capacity", "given")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: int, max_epochs: int) -> DataFrame:
    """(levels, docs, tokens, given): the token budget of every leaf of the tree.

    `leaves` has a row for each leaf with its documents and tokens; a leaf may be read `max_epochs` times.
    The budget is propagated from the root, one level after the other; windows run over leaf rows only.
    """
    given = None
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        nodes = leaves.groupBy(*own).agg((F.sum("tokens") * max_epochs).cast("long").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(levels, depth, weights))
        given = _share(nodes, given, own[:-1], own, budget)
    renamed = given.select(*[F.col(c).alias(f"_{c}") for c in levels], "given")
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return leaves.join(renamed, same).select(*levels, "docs", "tokens", "given")


def _place(seed: int) -> Column:
    """Place of a document in an epoch of its leaf: a seeded digest of epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _slice() -> Column:
    head = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    return F.shiftright(head * F.col("slices"), 32)


def _placed(rows: DataFrame, plan: DataFrame, levels: list[str], seed: int) -> DataFrame:
    named = plan.select(*[F.col(c).alias(f"_{c}") for c in levels], *[c for c in plan.columns if c not in levels])
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = rows.join(named, same).drop(*[f"_{c}" for c in levels])
    return joined.withColumn("place", _place(seed)).withColumn("slice", _slice())


def cuts(rows: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], budget: int, max_epochs: int, seed: int) -> DataFrame:
    """One row for each leaf: whole epochs, and where its last epoch is cut.

    The last epoch of a leaf is ordered by seeded digests, which cut it into slices of about a thousand
    rows whatever its size. Slice sums are added up along the leaf; only the slice in which the
    budget runs out is ordered row by row.
    """
    leaves = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")).filter("tokens > 0")
    plan = budgets(materialise(leaves, "leaves"), levels, weights, budget, max_epochs)
    plan = plan.select(
        *levels, "given", F.expr("given div tokens").alias("full"), F.expr("given % tokens").alias("rest"), F.expr("1 + docs div 1000").alias("slices"),
    )
    plan = materialise(plan, "plan")
    placed = _placed(rows.select("doc_id", *levels, "tokens"), plan, levels, seed)
    along = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*levels, "slice", "rest").agg(F.sum("tokens").alias("sum"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(along), F.lit(0)))
    edge = materialise(sums.filter("before < rest and rest <= before + sum").select(*levels, F.col("slice").alias("edge"), "before"), "edge")
    at_edge = _placed(rows.select("doc_id", *levels, "tokens"), _with(plan, edge, levels), levels, seed).filter("slice = edge")
    inside = Window.partitionBy(*levels).orderBy("place", F.col("doc_id").asc_nulls_first(), "tokens").rowsBetween(Window.unboundedPreceding, -1)
    running = at_edge.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    last = running.filter("so_far < rest and rest <= so_far + tokens").select(
        *levels, F.col("place").alias("cut_place"), F.col("doc_id").alias("cut_id"), F.col("tokens").alias("cut_tokens"),
        (F.col("rest") - F.col("so_far")).alias("cut_take"),
    )
    return materialise(_with(_with(plan, edge, levels), last.dropDuplicates(levels), levels), "cuts")


def _with(left: DataFrame, right: DataFrame, levels: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_{c}") for c in levels], *[c for c in right.columns if c not in levels])
    same = F.lit(True)
    for c in levels:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return left.join(renamed, same, "left").drop(*[f"_{c}" for c in levels])


def select(
    rows: DataFrame, levels: list[str], weights: dict[tuple[str, ...], int], share: float = 0.5, max_epochs: int = 2, seed: int = 7,
    keep: tuple[str, ...] = (), id_col: str = "doc_id",
) -> DataFrame:
    """(doc_id, levels, keep, epoch, tokens, take): the chosen rows, once for each epoch they are read in.

    `rows` has an id, the level columns from the root down, and `tokens`. The budget is `share` of all
    tokens. `weights` names nodes by path, or by the ending of a path for every parent; other nodes
    weigh 1, a weight of 0 leaves a subtree out. `take` is below `tokens` only for the row at which a
    leaf's budget ends. Null names are nodes like others; rows without tokens are never chosen; rows
    that repeat an id count each, and at the cut those with equal tokens are taken alike.
    """
    # Columns get names of their own here, so those of the caller cannot clash.
    names, levels = levels, [f"level{i}" for i in range(len(levels))]
    rows = rows.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).alias(n) for c, n in zip(names, levels)], F.col("tokens").cast("long").alias("tokens"),
        (F.struct(*keep) if keep else F.lit(None)).alias("kept"),
    )
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    plan = cuts(rows, levels, weights, int(total * share), max_epochs, seed)
    placed = _placed(rows.filter("tokens > 0"), plan, levels, seed)
    order = F.struct("place", F.coalesce("doc_id", F.lit(-(2**63))), "tokens")
    cut = F.struct("cut_place", F.coalesce("cut_id", F.lit(-(2**63))), "cut_tokens")
    partial = F.coalesce((F.col("slice") < F.col("edge")) | ((F.col("slice") == F.col("edge")) & (order <= cut)), F.lit(False))
    at_cut = partial & (F.col("slice") == F.col("edge")) & (order == cut)
    epochs = F.col("full") + partial.cast("long")
    chosen = placed.withColumn("_cut", F.coalesce(at_cut, F.lit(False))).withColumn("_epochs", epochs).filter("_epochs > 0")
    each = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)))
    take = F.when(F.col("_cut") & (F.col("epoch") == F.col("full")), F.col("cut_take")).otherwise(F.col("tokens"))
    return each.select(
        F.col("doc_id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(names, levels)], *[F.col(f"kept.{c}").alias(c) for c in keep],
        F.col("epoch").cast("int").alias("epoch"), "tokens", take.alias("take"),
    )
