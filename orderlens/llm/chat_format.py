"""Conversations as training text: a template, reversible escapes, a loss mask."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.plans.running import evaluated_once


@dataclass(frozen=True)
class Template:
    """The control strings around turns.

    Adjacent turns of one role are one block: ``open text (next text)* close``.
    A role that is neither user nor assistant writes its name between
    ``named`` and ``open``.

    A control string inside a text gets a backslash after its first character;
    where backslashes are there already, one more. Texts without one stay as
    they are. That is reversible, and marks never run into texts, if no control
    string has a backslash or the first character of a control string further on.
    """

    user: tuple[str, str] = ("[INST]", "[/INST]")
    assistant: tuple[str, str] = ("<s>", "</s>")
    named: str = "[ROLE]"
    other: tuple[str, str] = ("[TEXT]", "[/TEXT]")
    next_turn: str = "[TURN]"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        controls = (*self.user, *self.assistant, self.named, *self.other, self.next_turn)
        object.__setattr__(self, "controls", controls)
        first = {c[:1] for c in controls}
        if len(set(controls)) < len(controls) or any(len(c) < 2 for c in controls):
            raise ValueError("control strings must differ and have two characters at least")
        if any(set(c[1:]) & (first | {"\\"}) for c in controls) or "\\" in first:
            raise ValueError("control strings must not hold a backslash or a first character again")

    @property
    def _parts(self) -> tuple[str, str]:
        first = "|".join(sorted({re.escape(c[0]) for c in self.controls}))
        return f"({first})", "(" + "|".join(re.escape(c[1:]) for c in self.controls) + ")"

    def escaped(self, text: Column) -> Column:
        first, rest = self._parts
        return F.regexp_replace(text, rf"{first}(\\*){rest}", r"$1\\$2$3")

    def unescaped(self, text: Column) -> Column:
        first, rest = self._parts
        return F.regexp_replace(text, rf"{first}\\(\\*){rest}", "$1$2$3")

    def opening(self, role: Column) -> Column:
        named = F.concat(F.lit(self.named), self.escaped(role), F.lit(self.other[0]))
        return self._by_role(role, F.lit(self.user[0]), F.lit(self.assistant[0]), named)

    def closing(self, role: Column) -> Column:
        return self._by_role(role, *[F.lit(c[1]) for c in (self.user, self.assistant, self.other)])

    @staticmethod
    def _by_role(role: Column, user: Column, assistant: Column, other: Column) -> Column:
        return F.when(role == "user", user).when(role == "assistant", assistant).otherwise(other)


INSTRUCT = Template()


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation, in order."""
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merged_blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, blocks``: adjacent turns of one role under that role."""
    t = F.col("_turns")
    kept = turns.select("conv_id", F.explode(F.array("turns")).alias("_turns"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]),
    )
    kept = evaluated_once(kept, "_starts", starts)
    s = F.col("_starts")

    def block(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(s, i + 1), F.size(t))
        return F.struct(
            F.get(t, start)["role"].alias("role"),
            F.slice(t, start + 1, end - start)["text"].alias("texts"),
        )

    return kept.select("conv_id", F.size(t).cast("bigint").alias("n_turns"),
                       F.transform(s, block).alias("blocks"))


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Each conversation as one training text.

    ``conversations``: ``conv_id, turn, role, text``; other columns are not
    read. Turns are sorted by ``turn`` (null first), equal ones by role and
    text, so repeated rows are repeated turns and reruns agree. A null role or
    text is an empty one; a null id is a conversation of its own. The loss mask
    holds each assistant text and no mark. An empty table gives no rows. One
    conversation is one value, so it must stay below Spark's 2 GB a value.

    Returns ``conv_id, n_turns, n_blocks, segments`` (``text, loss``, in order) and
    ``formatted``, the texts of the segments joined.
    """
    blocks = evaluated_once(
        merged_blocks(sorted_turns(conversations)).select(
            "conv_id", "n_turns", F.col("blocks").alias("_merged")
        ),
        "blocks",
        F.col("_merged"),
    )

    def mark(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def segments_of(block: Column) -> Column:
        role = block["role"]

        def turn(text: Column, i: Column) -> Column:
            own = F.struct(template.escaped(text).alias("text"), (role == "assistant").alias("loss"))
            return F.when(i == 0, F.array(own)).otherwise(
                F.array(mark(F.lit(template.next_turn)), own)
            )

        return F.concat(
            F.array(mark(template.opening(role))),
            F.flatten(F.transform(block["texts"], turn)),
            F.array(mark(template.closing(role))),
        )

    segments = F.flatten(F.transform("blocks", segments_of))
    return evaluated_once(blocks, "segments", segments).select(
        "conv_id",
        "n_turns",
        F.size("blocks").cast("bigint").alias("n_blocks"),
        "segments",
        F.array_join(F.col("segments")["text"], "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (``role, text``) that a formatted text holds."""
    opens = [template.user[0], template.assistant[0], template.named]
    blocks = F.split(formatted, "(?=" + "|".join(map(re.escape, opens)) + ")")

    def inside(block: Column, marks: tuple[str, str]) -> Column:
        return F.substring(
            block,
            F.lit(len(marks[0]) + 1),
            F.char_length(block) - (len(marks[0]) + len(marks[1])),
        )

    def turns_of(role: Column, body: Column) -> Column:
        return F.transform(
            F.split(body, re.escape(template.next_turn)),
            lambda text: F.struct(role.alias("role"), template.unescaped(text).alias("text")),
        )

    def block(b: Column) -> Column:
        named = F.split(inside(b, (template.named, template.other[1])), re.escape(template.other[0]), 2)
        return (
            F.when(b.startswith(template.user[0]), turns_of(F.lit("user"), inside(b, template.user)))
            .when(
                b.startswith(template.assistant[0]),
                turns_of(F.lit("assistant"), inside(b, template.assistant)),
            )
            .otherwise(turns_of(template.unescaped(F.get(named, F.lit(0))), F.get(named, F.lit(1))))
        )

    return F.flatten(F.transform(blocks, block))


def loss_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """What lies under the loss mask, without escapes."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: template.unescaped(s["text"])), "")


def digest(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Read formatted conversations back and describe what they hold.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_blocks``.
    """
    read = evaluated_once(formatted, "_read", read_turns(F.col("formatted"), template))
    read = evaluated_once(read, "_loss", loss_text(F.col("segments"), template))
    lines = F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_read").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        "n_blocks",
    )
