"""Chat formatting: a finite-state machine over roles and segments with loss flags from a template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """How turns are written. Every marker holds [ or <, which no escaped text does.

    `other` marks turns of any other role; {role} stands for the escaped role. `order` is the machine:
    (state, role) to state, from `start`; a conversation is in order if it ends in a state of `final`.
    """

    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS] ", "[/SYS]\n"), "user": Turn("[INST] ", "[/INST]\n"), "assistant": Turn("[OUT] ", "</s>\n", True),
    })
    other: Turn = Turn("[ROLE:{role}] ", "[/ROLE]\n")
    order: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    })
    final: tuple[str, ...] = ("asked", "answered")


TEMPLATE = Template()
#: Escapes of the characters that begin or end markers; the first is the escape sign itself (fixed values).
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\r"))


def escape(text: Column) -> Column:
    """The text without any [, ] or <; `unescape` gives it back exactly. Null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, code in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    """In escaped text each escape sign begins a code, so the sign's own code may be resolved last."""
    out = text
    for plain, code in reversed(ESCAPES):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def state(roles: Column, template: Template = TEMPLATE) -> Column:
    """State of the machine after all roles; `out of order` from the first role it has no step for."""
    steps = F.create_map(*[F.lit(x) for (s, r), t in template.order.items() for x in (f"{s} {r}", t)])
    return F.aggregate(
        roles, F.lit("start"),
        lambda at, role: F.coalesce(F.try_element_at(steps, F.concat_ws(" ", at, role)), F.lit("out of order")),
    )


def _segments(turn: Column, template: Template) -> Column:
    def marks(part: str) -> Column:
        known = F.lit(None).cast("string")
        for role, t in template.turns.items():
            known = F.when(turn["role"] == role, F.lit(getattr(t, part))).otherwise(known)
        return F.coalesce(known, F.replace(F.lit(getattr(template.other, part)), F.lit("{role}"), escape(turn["role"])))

    trained = F.lit(template.other.loss)
    for role, t in template.turns.items():
        trained = F.when(turn["role"] == role, F.lit(t.loss)).otherwise(trained)
    no = F.lit(False)
    return F.array(
        F.struct(marks("open").alias("text"), no.alias("loss")),
        F.struct(escape(turn["text"]).alias("text"), F.coalesce(trained, no).alias("loss")),
        F.struct(marks("close").alias("text"), no.alias("loss")),
    )


def format_chats(
    rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = TEMPLATE
) -> DataFrame:
    """(conv_id, state, in_order, segments, formatted) for every conversation.

    Turns stand by number, rows of one number by role, then text; nulls come first, a null role or text
    is an empty one. Conversations out of order are formatted all the same and flagged. A conversation
    is one output text, so its turns meet in one row; rows with a null id form one conversation.
    """
    own = rows.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).alias("t"))
    turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    made = turns.select(
        "conv_id", state(F.col("turns.role"), template).alias("state"),
        F.concat(begin, F.flatten(F.transform("turns", lambda t: _segments(t, template)))).alias("segments"),
    )
    return made.select(
        "conv_id", "state", F.col("state").isin(*template.final).alias("in_order"), "segments",
        F.array_join("segments.text", "").alias("formatted"),
    )


def parse(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    def name(mark: str) -> str:
        return mark[1 : mark.index("]")]

    roles = {name(t.open): r for r, t in template.turns.items()}
    other = name(template.other.open).replace("{role}", "")
    head = "|".join(roles)
    pattern = rf"\[((?:{head}|{other}[^\]\[<]*))\] ([^\[<]*)"
    marks = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(pattern), F.lit(2))
    back = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    role = lambda m: F.coalesce(F.try_element_at(back, m), unescape(F.substring(m, len(other) + 1, 2**31 - 1)))
    return F.zip_with(marks, texts, lambda m, t: F.struct(role(m).alias("role"), unescape(t).alias("text")))


def trained(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def trained_turns(turns: Column, template: Template = TEMPLATE) -> Column:
    """The same read back from a formatted conversation: texts of parsed turns of the roles that are trained."""
    plain = [role for role, t in template.turns.items() if t.loss != template.other.loss]
    apart = lambda t: t["role"].isin(plain) if plain else F.lit(False)
    wanted = F.filter(turns, lambda t: ~apart(t) if template.other.loss else apart(t))
    return F.array_join(F.transform(wanted, lambda t: t["text"]), "")
