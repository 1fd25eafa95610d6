"""Dialogues as one training text with a loss mask, from a declarative template."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START = "(start)"


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written and which role may follow which.

    The states of the machine are ``START`` and the roles; ``follows`` gives the
    roles a state accepts, ``ends`` the states in which a dialogue may stop.
    ``controls`` are all strings that mean something to a reader of the text;
    inside a role name or a turn they are escaped. They must not contain ``&``.
    """

    opens: str = "<|turn|>"
    after_role: str = "<|says|>"
    closes: str = "<|done|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    ends: tuple[str, ...] = ("user", "assistant")
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")

    @property
    def controls(self) -> tuple[str, ...]:
        own = (self.opens, self.after_role, self.closes)
        every = tuple(dict.fromkeys(own + self.foreign))
        if any("&" in c or not c for c in every):
            raise ValueError("a control string is not empty and has no '&'")
        written = ["&amp;", *(f"&c{i};" for i in range(len(every)))]
        if any(c in w for c in every for w in written):
            raise ValueError("a control string does not occur in what stands for another one")
        return tuple(sorted(every, key=len, reverse=True))


def escape(text: Column, template: ChatTemplate) -> Column:
    """``&`` becomes ``&amp;``, then the i-th control string ``&ci;``: no control string is left."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for i, control in enumerate(template.controls):
        out = F.replace(out, F.lit(control), F.lit(f"&c{i};"))
    return out


def unescape(text: Column, template: ChatTemplate) -> Column:
    out = text
    for i, control in reversed(list(enumerate(template.controls))):
        out = F.replace(out, F.lit(f"&c{i};"), F.lit(control))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def dialogue_segments(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Dialogues as text segments with a loss flag each. General: the road records hold no dialogues.

    Method: a finite-state machine over the roles walks the turns in order. Its
    state is the role of the turn before; it accepts a turn if that state allows
    its role, enters the new state, and emits the turn's segments by the template
    (opening, escaped text, closing) with their loss flags: only the text of a
    loss role carries one.

    Returns per dialogue: conv_id, n_turns, segments (array of segment, loss,
    start in characters from 0), valid (every turn accepted and the last state may end) and bad_turn (place,
    from 0, of the first turn that is not accepted; null when all are).

    Turns are escaped one by one before they are brought together; a dialogue is
    one output text, so its turns meet in one row.

    Edge cases: a null text is empty; a null role is the empty role, which no
    state accepts. Turns with the same number follow each other by role, then
    text; a null number comes first. Invalid dialogues are formatted like others
    and marked. A null ``conv`` is a dialogue of its own. Other columns are
    ignored. An empty table gives an empty result.
    """
    template = template or ChatTemplate()
    said = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    accepted = F.create_map(
        *[x for state, roles in template.follows.items() for x in (F.lit(state), F.array(*map(F.lit, roles)))]
    )
    in_order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    said = said.withColumns(
        {"_nth": F.row_number().over(in_order), "_state": F.lag("_role", 1, START).over(in_order)}
    ).select(
        "conv_id",
        "_nth",
        "_role",
        F.coalesce(F.array_contains(F.try_element_at(accepted, F.col("_state")), F.col("_role")), F.lit(False)).alias("_accepted"),
        F.col("_role").isin(*template.loss_roles).alias("_loss"),
        F.concat(F.lit(template.opens), escape(F.col("_role"), template), F.lit(template.after_role)).alias("_head"),
        escape(F.col("_text"), template).alias("_body"),
    )
    length = F.char_length("_head") + F.char_length("_body") + len(template.closes)
    so_far = F.sum(length).over(Window.partitionBy("conv_id").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0))
    said = said.withColumn("_start", (so_far - length).cast("long"))
    ordered = said.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "_loss", "_head", "_body", "_start"))).alias("_turns"),
        F.min(F.when(~F.col("_accepted"), F.col("_nth") - 1)).alias("bad_turn"),
        F.max_by("_role", "_nth").isin(*template.ends).alias("_may_end"),
    )

    def segments(t: Column) -> Column:
        head, body = F.char_length(t["_head"]), F.char_length(t["_body"])
        pieces = (
            (t["_head"], F.lit(False), t["_start"]),
            (t["_body"], t["_loss"], t["_start"] + head),
            (F.lit(template.closes), F.lit(False), t["_start"] + head + body),
        )
        return F.array(
            *[F.struct(s.alias("segment"), loss.alias("loss"), start.alias("start")) for s, loss, start in pieces]
        )

    return ordered.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("_turns", segments)).alias("segments"),
        (F.col("bad_turn").isNull() & F.col("_may_end")).alias("valid"),
        "bad_turn",
    )


def formatted_dialogues(segments: DataFrame) -> DataFrame:
    """One text per dialogue and the spans (start from 0, length; in characters) under the loss mask."""
    spans = F.filter("segments", lambda s: s["loss"])
    return segments.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("formatted"),
        F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), F.char_length(s["segment"]).alias("length"))
        ).alias("loss_spans"),
        "valid",
        "bad_turn",
    )


def read_dialogues(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The turns (array of role, text) and the loss texts (array) back from formatted dialogues."""
    template = template or ChatTemplate()
    bodies = F.filter(
        F.split("formatted", "\\Q" + template.closes + "\\E"), lambda s: s != ""
    )

    def turn(body: Column) -> Column:
        halves = F.split(body, "\\Q" + template.after_role + "\\E", 2)
        name = F.substr(F.get(halves, F.lit(0)), F.lit(len(template.opens) + 1))
        return F.struct(
            unescape(name, template).alias("role"), unescape(F.get(halves, F.lit(1)), template).alias("text")
        )

    masked = F.transform(
        "loss_spans",
        lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"]), template),
    )
    return formatted.select(
        "conv_id",
        "n_turns",
        "formatted",
        F.transform(bodies, turn).alias("turns"),
        masked.alias("loss_texts"),
        "valid",
        "bad_turn",
    )
