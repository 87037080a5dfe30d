"""Chat formatting with built-in functions only.

A template, plain data, says how turns are marked, which role may follow which, and which
roles' texts are learned from. A finite-state machine over the roles checks the order of
turns. The output is a conversation's text segments with a loss flag each; joined they are
the formatted text.

Texts and roles are escaped so that no control string can come out of them: ``<|`` becomes
``<\\|`` and a backslash is doubled, in roles also a line end becomes ``\\n``. Reading back
undoes this.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replipulse.llm.common import pick

OPEN = "<|"


@dataclass(frozen=True)
class Template:
    """``next``: state, role -> state. Any other step is an error and keeps the state."""

    before: str = "<|im_start|>"
    after_role: str = "\n"
    after: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    next: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )


CHAT = Template()


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """A backslash stands for what follows it."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    # A backslash, then n: a line end; then anything else: that. Doubled ones go first.
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: unescaped(F.replace(p, F.lit("\\n"), F.lit("\n")))), "\\")


def _checked(turns: Column, template: Template) -> Column:
    """The machine's last state, and the first turn (from 0) that is out of order, or -1."""

    def step(acc: Column, turn: Column) -> Column:
        state = F.lit(None).cast("string")
        for (source, role), target in template.next.items():
            state = F.when((acc["state"] == source) & (turn["role"] == role), target).otherwise(state)
        return F.struct(
            F.coalesce(state, acc["state"]).alias("state"),
            F.when((acc["error"] < 0) & state.isNull(), acc["at"]).otherwise(acc["error"]).alias("error"),
            (acc["at"] + 1).alias("at"),
        )

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(-1).alias("error"), F.lit(0).alias("at"))
    return F.aggregate(turns, begin, step)


def _segments(turns: Column, template: Template) -> Column:
    def of_turn(turn: Column) -> Column:
        head = F.concat(F.lit(template.before), escaped_role(turn["role"]), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(
                escaped(turn["text"]).alias("text"), turn["role"].isin(*template.learned).alias("loss")
            ),
            F.struct(F.lit(template.after).alias("text"), F.lit(False).alias("loss")),
        )

    return F.flatten(F.transform(turns, of_turn))


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: Template = CHAT,
) -> DataFrame:
    """One row per conversation: id, ``segments`` (``text``, ``loss``), ``valid``, ``error_turn``.

    Turns go by number; rows with the same number go by role, then text, and each is a
    turn. A null number comes first. Null roles and texts are empty; a role the template
    does not know is an error in the order of turns but is formatted. Conversations out of
    order keep all turns, with ``valid`` false and the first wrong turn (from 0); one that
    ends in no final state is not valid either and has ``error_turn`` -1. Rows with a null
    id are one conversation. An empty table gives no row; other columns are not read.
    """
    rows = pick(turns, id=id_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # A conversation is one row of the result, so its turns do meet in one place.
    chats = rows.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    checked = chats.select(
        "id", _segments(F.col("turns"), template).alias("segments"), _checked(F.col("turns"), template).alias("check")
    )
    return checked.select(
        F.col("id").alias(id_col),
        "segments",
        ((F.col("check.error") < 0) & F.col("check.state").isin(*template.final)).alias("valid"),
        F.col("check.error").alias("error_turn"),
    )


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def learned(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def parsed(text: Column, template: Template = CHAT) -> Column:
    """The turns of a formatted text, ``array<struct<role, text>>``, from the text alone."""

    def of_part(part: Column) -> Column:
        body = F.substring(part, F.lit(len(template.before) + 1), F.length(part))
        at = F.instr(body, F.lit(template.after_role))
        return F.struct(
            unescaped_role(F.substring(body, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substring(body, at + len(template.after_role), F.length(body))).alias("text"),
        )

    literal = "".join(f"\\{c}" if c in "<|>\\[](){}.*+?^$" else c for c in template.after)
    parts = F.split(text, literal, -1)
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), of_part)


def digest(chats: DataFrame, id_col: str = "conv_id", template: Template = CHAT) -> DataFrame:
    """Counts and digests of what is read back from formatted conversations."""
    read = chats.select(
        id_col, "valid", "segments", formatted(F.col("segments")).alias("formatted")
    ).select(
        id_col,
        "valid",
        parsed(F.col("formatted"), template).alias("turns"),
        learned(F.col("segments")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        id_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )
