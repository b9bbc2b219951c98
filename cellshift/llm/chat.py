"""Conversations as marked text with a loss mask, from a declarative template.

Everything is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Escapes: put behind the first character of a control string in a text, and behind an
# escape character that the text has itself.
_ESCAPE = "\u001b"
_BROKEN, _OWN, _LINE = _ESCAPE + "1", _ESCAPE + "0", _ESCAPE + "2"


@dataclass(frozen=True)
class Template:
    """marks: role -> (before, after). `learnt`: roles whose text counts for the loss.

    steps: state -> {role: next state}; a conversation begins in state "start" and may
    end in any state of `final`. A role without marks is written with those of `other`,
    and its name in front. No control string is part of another one or starts with
    what another one ends with.
    """

    marks: dict
    learnt: frozenset
    steps: dict
    final: frozenset
    other: tuple = ("[ROLE] ", " [/ROLE]")
    control: tuple = ()


INSTRUCT = Template(
    marks={
        "system": ("[SYS] ", " [/SYS]"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("<s>", "</s>"),
    },
    learnt=frozenset({"assistant"}),
    steps={
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=frozenset({"answered"}),
    control=("[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<s>", "</s>"),
)


def escape(text: Column, template: Template) -> Column:
    """text without a control string; `unescape` gives it back."""
    broken = "|".join(
        f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(template.control)
    )
    own = F.replace(text, F.lit(_ESCAPE), F.lit(_OWN))
    return F.regexp_replace(own, broken, "$0" + _BROKEN)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_BROKEN), F.lit("")), F.lit(_OWN), F.lit(_ESCAPE))


def turn_segments(role: Column, text: Column, template: Template) -> Column:
    """array<struct<text, loss>>: the mark before, the escaped text, the mark after."""
    before, after = F.lit(template.other[0]), F.lit(template.other[1])
    name_line = F.replace(escape(role, template), F.lit("\n"), F.lit(_LINE))
    body = F.concat(name_line, F.lit("\n"), escape(text, template))
    for name, (first, last) in template.marks.items():
        before = F.when(role == name, F.lit(first)).otherwise(before)
        after = F.when(role == name, F.lit(last)).otherwise(after)
        body = F.when(role == name, escape(text, template)).otherwise(body)
    parts = ((before, F.lit(False)), (body, role.isin(*template.learnt)), (after, F.lit(False)))
    return F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts])


def end_state(roles: Column, template: Template) -> Column:
    """State of the machine after the roles, or "wrong" from the first role that it bars."""
    moves = [F.lit(x) for state, to in template.steps.items() for role, new in to.items() for x in (f"{state}\n{role}", new)]
    table = F.create_map(*moves)
    return F.aggregate(
        roles,
        F.lit("start"),
        lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit("\n"), role)), F.lit("wrong")),
    )


def format_chats(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """(conv_id, segments, formatted, state, valid) of rows (conv_id, turn, role, text).

    Rows are taken by turn; equal turns by role and text, so the order is defined, and
    a repeated row is said twice. Null roles and texts are empty; null ids are one
    conversation. A conversation whose roles break the machine's rules, or which ends
    in no final state, is written as it is and marked as not valid. One conversation is
    one value of the result, hence one task builds it; it can be as long as a value can.
    """
    said = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chats = turns.select("conv_id", said.alias("said")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("said")).alias("said")
    )
    segments = F.flatten(F.transform("said", lambda t: turn_segments(t["role"], t["text"], template)))
    return (
        chats.select(
            "conv_id",
            segments.alias("segments"),
            end_state(F.transform("said", lambda t: t["role"]), template).alias("state"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .withColumn("valid", F.col("state").isin(*template.final))
        .select("conv_id", "segments", "formatted", "state", "valid")
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> of the turns, from nothing but the formatted text."""
    all_marks = {**template.marks, "": template.other}
    turn = "|".join(f"{re.escape(a)}(?:.*?){re.escape(b)}" for a, b in all_marks.values())
    found = F.regexp_extract_all(formatted, F.lit(f"(?s)({turn})"), F.lit(1))

    def inner(t, marks):
        a, b = marks
        return F.substring(t, F.lit(len(a) + 1), F.char_length(t) - len(a) - len(b))

    def parse(t):
        body = inner(t, template.other)
        role = unescape(F.replace(F.substring_index(body, "\n", 1), F.lit(_LINE), F.lit("\n")))
        text = unescape(F.substring(body, F.char_length(F.substring_index(body, "\n", 1)) + 2, F.char_length(body)))
        for name, marks in template.marks.items():
            here = F.startswith(t, F.lit(marks[0]))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, unescape(inner(t, marks))).otherwise(text)
        return F.struct(role.alias("role"), text.alias("text"))

    return F.transform(found, parse)


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
