"""Chat formatting with a role state machine and a declarative template.

DataFrame functions only. Turns are grouped by conversation (one shuffle of
the turns), ordered, checked by a transition table and written as text segments
with a loss flag each. Control strings inside texts are escaped by a code in
which neither marker character can occur, so ``parse`` undoes it exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qualispark.llm.common import let


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the roles under the loss, and the transitions allowed.

    ``escapes`` maps a character to its code; the first must be the escape
    character itself. Every mark begins with an escaped character, so no mark
    can occur inside an escaped text.
    """

    open_mark: str = "### "
    after_role: str = ": "
    close_mark: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
    start: tuple[str, ...] = ("system", "user")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    accept: tuple[str, ...] = ("assistant",)

    def escape(self, text: Column) -> Column:
        for raw, code in self.escapes:
            text = F.replace(text, F.lit(raw), F.lit(code))
        return text

    def unescape(self, text: Column) -> Column:
        for raw, code in reversed(self.escapes):
            text = F.replace(text, F.lit(code), F.lit(raw))
        return text


def _allowed(previous: Column, role: Column, template: Template) -> Column:
    """The transition table as one expression; null ``previous`` is the start."""
    out = previous.isNull() & role.isin(*template.start)
    for state, roles in template.follows.items():
        out = out | ((previous == state) & role.isin(*roles))
    return F.coalesce(out, F.lit(False))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: formatted text, segments, and the machine's verdict.

    Input columns: conv_id, turn, role, text; others are ignored. Turns are
    ordered by turn, ties by role and text, nulls first; a null text or role is
    empty; rows with a null conv_id form one conversation of that id; repeated
    rows are turns of their own. ``segments`` is an array of
    ``struct<text, loss>`` whose concatenation is ``formatted``. ``valid`` tells
    whether every transition is allowed and the last role may end a
    conversation; ``first_error`` is the position of the first turn refused, or
    -1. Invalid conversations are formatted all the same: nothing is dropped.
    """
    t = template or Template()
    own = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    grouped = own.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def segments(e: Column) -> Column:
        head = F.concat(F.lit(t.open_mark), t.escape(e["role"]), F.lit(t.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(t.escape(e["text"]).alias("text"), e["role"].isin(*t.loss_roles).alias("loss")),
            F.struct(F.lit(t.close_mark).alias("text"), F.lit(False).alias("loss")),
        )

    items = F.col("turns")
    refused = F.filter(
        F.transform(
            items,
            lambda e, i: F.when(_allowed(F.get(items, i - 1)["role"], e["role"], t), F.lit(-1)).otherwise(i),
        ),
        lambda i: i >= 0,
    )
    built = grouped.select(
        "conv_id",
        F.flatten(F.transform(items, segments)).alias("segments"),
        F.coalesce(F.get(refused, F.lit(0)), F.lit(-1)).alias("first_error"),
        F.element_at(items, -1)["role"].isin(*t.accept).alias("ends"),
    )
    return built.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        ((F.col("first_error") < 0) & F.col("ends")).alias("valid"),
        "first_error",
    )


def parse(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted text: ``array<struct<role, text>>``."""
    t = template or Template()
    pieces = F.split(formatted, "\\Q" + t.close_mark + "\\E")
    bodies = F.filter(pieces, lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.locate(t.after_role, p)
        role = F.substring(p, F.lit(len(t.open_mark) + 1), at - F.lit(len(t.open_mark) + 1))
        text = F.substring(p, at + len(t.after_role), F.length(p))
        return F.struct(t.unescape(role).alias("role"), t.unescape(text).alias("text"))

    return F.transform(bodies, turn)


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests read back from the formatted text and the loss flags."""
    t = template or Template()
    under_loss = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"])), ""
    )
    back = formatted.select(
        "conv_id",
        parse(F.col("formatted"), t).alias("turns"),
        let(under_loss, lambda x: F.struct(F.length(x).alias("n"), F.sha2(x, 256).alias("h"))).alias("loss"),
        F.length("formatted").alias("chars"),
        "valid",
    )
    flat = F.array_join(F.transform("turns", lambda e: F.concat(e["role"], F.lit("\n"), e["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.col("loss.n").cast("long").alias("loss_chars"),
        F.col("loss.h").alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
        "valid",
    )
