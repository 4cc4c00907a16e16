"""Conversations as training text: marked turns in segments with loss flags, and the way back.

A template is data: markers, the roles it knows, the order of turns its state machine allows, and the roles whose text
counts for the loss. Control strings inside texts are escaped, so that what was written can be read again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``names``: role to name in the header; other roles are written as ``other`` and the hexadecimal digits of their
    bytes, which no name may look like. ``escape`` is one character and marks control strings inside texts. ``follows``: state
    to the roles that may come next, each of which is the next state; ``final``: states a conversation may end in."""

    opening: str = "### "
    after_name: str = ": "
    closing: str = " </turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    escape: str = "\\"
    other: str = "@"
    names: Mapping[str, str] = field(
        default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"}
    )
    loss: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: tuple[str, ...] = ("start", "assistant")

    def _marked(self) -> str:
        return "|".join(re.escape(c) for c in sorted((self.escape, *self.controls), key=len, reverse=True))

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._marked()})", _literal(self.escape) + "$1")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"{re.escape(self.escape)}({self._marked()})", "$1")

    def header(self, role: Column) -> Column:
        name = F.concat(F.lit(self.other), F.hex(role.cast("binary")))
        for known, shown in self.names.items():
            name = F.when(role == known, shown).otherwise(name)
        return F.concat(F.lit(self.opening), name, F.lit(self.after_name))

    def name_in(self, turn: Column) -> Column:
        """The name in the header of a formatted turn."""
        start = f"^{re.escape(self.opening)}"
        names = "|".join([*map(re.escape, self.names.values()), re.escape(self.other) + "[0-9A-F]*"])
        return F.regexp_extract(turn, f"{start}({names}){re.escape(self.after_name)}", 1)

    def role_of(self, name: Column) -> Column:
        role = F.unhex(F.substr(name, F.lit(len(self.other) + 1))).cast("string")
        for known, shown in self.names.items():
            role = F.when(name == shown, known).otherwise(role)
        return role

    def text_in(self, turn: Column, name: Column) -> Column:
        """The text of a formatted turn as it was."""
        before = F.char_length(name) + len(self.opening) + len(self.after_name)
        return self.unescaped(F.substr(turn, before + 1, F.char_length(turn) - before - len(self.closing)))


def _literal(text: str) -> str:
    """``text`` as a replacement that means itself."""
    return re.sub(r"([\\$])", r"\\\1", text)


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv_key")


def _walk(template: Template) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the place of each turn, and whether the state machine allows it there and an end after it."""
    follows, final = {s: frozenset(r) for s, r in template.follows.items()}, frozenset(template.final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, position = None, "start", 0
        for batch in batches:
            positions, legal, ends = [], [], []
            for key, role in zip(batch.column("conv_key").to_pylist(), batch.column("role").to_pylist()):
                if key != conv:
                    conv, state, position = key, "start", 0
                legal.append(role in follows.get(state, ()))
                if legal[-1] or role in follows:
                    state = role  # after a turn out of order the machine goes on from that turn
                ends.append(state in final)
                positions.append(position)
                position += 1
            added = [pa.array(positions, pa.int64()), pa.array(legal, pa.bool_()), pa.array(ends, pa.bool_())]
            kept = [c for c in batch.schema.names if c != "conv_key"]
            columns = [*(batch.column(c) for c in kept), *added]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "position", "legal", "may_end"])

    return run


def format_turns(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Every turn of ``conversations`` (conv_id, turn, role, text) as text segments with loss flags.

    Columns: conv_id, role, segments (text, loss), position (from 0), legal (the state machine allows the turn after those
    before it), may_end. Turns follow the column turn, nulls first, then role and text; repeated rows are turns of
    their own. Null text: empty; null role: empty role, never legal. Null conv_id: a conversation like others. Empty
    table: no rows. Other columns are ignored. Turns out of order are formatted all the same.

    Segments are built before rows of a conversation meet. They then come in one partition and in order, of which a task
    holds a batch at a time; an operator without a shuffle may rely on that.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = [(template.header(role), F.lit(False)), (template.escaped(text), role.isin(*template.loss)), (F.lit(template.closing), F.lit(False))]
    segments = F.array(*[F.struct(t.alias("text"), loss.alias("loss")) for t, loss in parts]).alias("segments")
    turns = conversations.select(_key(), "conv_id", F.col("turn").alias("turn"), role.alias("role"), segments)
    # the text is only read again where turn and role are the same
    order = ["conv_key", F.col("turn").asc_nulls_first(), "role", template.unescaped(F.col("segments")[1]["text"])]
    placed = turns.repartition("conv_key").sortWithinPartitions(*order).drop("turn")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.drop("conv_key").schema)
    return placed.mapInArrow(_walk(template), f"{fields}, position bigint, legal boolean, may_end boolean")


def read_turns(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What ``format_turns`` wrote, read from its text alone: role_read, text_read, loss_text (null without loss), chars."""
    joined = formatted.withColumn("turn_text", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    named = joined.withColumn("name_read", template.name_in(F.col("turn_text")))
    under = F.filter("segments", lambda s: s["loss"])
    loss = template.unescaped(F.array_join(F.transform(under, lambda s: s["text"]), ""))
    return named.select(
        "conv_id",
        "position",
        "legal",
        "may_end",
        template.role_of(F.col("name_read")).alias("role_read"),
        template.text_in(F.col("turn_text"), F.col("name_read")).alias("text_read"),
        F.when(F.size(under) > 0, loss).alias("loss_text"),
        F.char_length("turn_text").cast("bigint").alias("chars"),
    )


_SUMMARY = (
    "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list | None = None  # conv_id, turns, digest, loss characters, digest, characters, legal, may end
    schema = None

    def table(rows: list[list]) -> pa.RecordBatch:
        done = [(i, n, a.hexdigest(), m, b.hexdigest(), c, legal and end) for i, n, a, m, b, c, legal, end in rows]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    columns = ("conv_id", "position", "said", "loss", "loss_chars", "chars", "legal", "may_end")
    for batch in batches:
        fields = [(c.split()[0], types[c.split()[1]]) for c in _SUMMARY.split(", ")]
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields])
        done = []
        for conv, position, said, loss, loss_chars, chars, legal, end in zip(*(batch.column(c).to_pylist() for c in columns)):
            if position == 0:
                if now is not None:
                    done.append(now)
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, True]
            now[1] += 1
            now[2].update(said)
            if loss is not None:
                now[3] += loss_chars
                now[4].update(loss)
            now[5] += chars
            now[6], now[7] = now[6] and legal, end
        if done:
            yield table(done)
    if now is not None:
        yield table([now])


def summaries(read: DataFrame) -> DataFrame:
    """One row per conversation of ``read_turns``: turns and loss text as digests, lengths, and whether the order is valid."""
    said = F.concat("role_read", F.lit("\n"), "text_read", F.lit("\n")).cast("binary").alias("said")
    loss, size = F.col("loss_text").cast("binary").alias("loss"), F.char_length("loss_text").cast("bigint").alias("loss_chars")
    rows = read.select("conv_id", "position", said, loss, size, "chars", "legal", "may_end")
    return rows.mapInArrow(_summed, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_SUMMARY}")
