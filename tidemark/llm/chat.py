"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation becomes one text made of segments; every segment says whether it counts towards the loss. Control strings
inside turn texts are broken by an escape sign, so the only control strings in the output are the template's own, and the
turns can be read back from the output alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """``marks``: role -> (opening, closing); any other role is written between ``other``'s three marks.
    ``moves``: state -> roles that may follow; ``final``: states a conversation may end in; ``loss``: roles that are learnt."""

    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    control: tuple = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    moves: dict = field(default_factory=lambda: {
        "start": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    final: frozenset = frozenset({"assistant"})
    loss: frozenset = frozenset({"assistant"})


DEFAULT = Template()


def escape(text: str, template: Template) -> str:
    """Double the escape sign, then put one behind the first sign of every control string."""
    pattern = "|".join(re.escape(c) for c in sorted(template.control, key=len, reverse=True))
    return re.sub(pattern, lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_order(roles: list[str], template: Template) -> int:
    """Index of the first turn the machine refuses, the number of turns if it ends too early, -1 if it accepts."""
    state = "start"
    for i, role in enumerate(roles):
        if role not in template.moves.get(state, ()):
            return i
        state = role
    return -1 if state in template.final else len(roles)


def segments(turns: list[tuple[str, str]], template: Template) -> list[tuple[str, bool]]:
    out = []
    for role, text in turns:
        body = (escape(text, template), role in template.loss)
        if role in template.marks:
            before, after = template.marks[role]
            out += [(before, False), body, (after, False)]
        else:
            a, b, c = template.other
            out += [(a + escape(role, template) + b, False), body, (c, False)]
    return out


def read_back(text: str, template: Template) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    kinds = list(template.marks.items())
    parts = [f"{re.escape(a)}(.*?){re.escape(b)}" for _, (a, b) in kinds]
    a, b, c = map(re.escape, template.other)
    turns, at = [], 0
    for m in re.finditer("|".join([*parts, f"{a}(.*?){b}(.*?){c}"]), text, flags=re.S):
        if m.start() != at:
            raise ValueError(f"text outside of turns at {at}")
        at = m.end()
        k = next(i for i, g in enumerate(m.groups()) if g is not None)
        if k < len(kinds):
            turns.append((kinds[k][0], unescape(m[k + 1])))
        else:
            turns.append((unescape(m[k + 1]), unescape(m[k + 2])))
    if at != len(text):
        raise ValueError(f"text outside of turns at {at}")
    return turns


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, end in code points), segments, valid, first_bad_turn.

    ``turns`` needs conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn (null last), then role,
    then text, so ties and repeated rows have a fixed order and all are kept. A null text or role reads as empty; rows
    without conv_id form one conversation. A conversation the machine refuses is formatted all the same and marked
    ``valid = false``. An empty table gives an empty result. A conversation is one value, so one task holds it whole.
    """
    schema = ("conv_id long, formatted string, loss_spans array<struct<start:int,end:int>>, "
              "segments array<struct<text:string,loss:boolean>>, valid boolean, first_bad_turn int")
    arrow = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()),
                       ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                       ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
                       ("valid", pa.bool_()), ("first_bad_turn", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, listed in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist(), strict=True):
                listed = sorted(listed, key=lambda t: (t["turn"] is None, t["turn"] or 0, t["role"], t["text"]))
                said = [(t["role"], t["text"]) for t in listed]
                made, spans, at = segments(said, template), [], 0
                for text, loss in made:
                    if loss:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                bad = turn_order([r for r, _ in said], template)
                rows.append({"conv_id": conv, "formatted": "".join(t for t, _ in made), "loss_spans": spans,
                             "segments": [{"text": t, "loss": x} for t, x in made], "valid": bad < 0,
                             "first_bad_turn": None if bad < 0 else bad})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.collect_list(row).alias("turns"))
    return grouped.mapInArrow(run, schema)


def digest(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Read every formatted conversation back: its turns, and the text under the loss mask."""
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                       ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = read_back(text, template)
                learnt = "".join(unescape(text[s["start"]:s["end"]]) for s in r["loss_spans"])
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(told.encode()).hexdigest(),
                             "loss_chars": len(learnt), "loss_sha256": hashlib.sha256(learnt.encode()).hexdigest(),
                             "formatted_chars": len(text), "valid": r["valid"]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return formatted.select("conv_id", "formatted", "loss_spans", "valid").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
