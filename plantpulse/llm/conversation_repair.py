"""Repair of damaged conversations at least cost, with an audit of the edits.

The roles of a repaired conversation start with letters that form ``(s?(ua)+)?``. A row is kept, gets another role, or is
deleted; turns without text may be inserted. Cost is a shortest path through the states of that grammar: every kind
of row (its role and fault) is a min-plus matrix over states. Equal neighbours are collapsed to runs, a run advances the
costs by cached binary powers of its matrix, and its choices are unrolled until they repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that do not count as text.
SPACES = " \t\n\v\f\r"
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# States: nothing yet, after s, after u, after a. Classes of roles: s, u, a, others. Symbols: class, class of a
# truncated row + 4, rows that must go, and nothing at all.
_NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_FILLER = (1, 1, 2, 1)  # class of the only role that can be inserted or given in a state
_ROLES = {1: "user", 2: "assistant"}
_FINAL = (0, 3)
_GONE, _NOTHING = 8, 9
_FAR = 1 << 60

Costs = tuple[int, ...]


def _edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row."""
    if symbol == _NOTHING:
        yield "", 0, state
        return
    yield "D", DELETE, state
    if symbol != _GONE:
        broken, kind = (TRUNCATED, symbol - 4) if symbol >= 4 else (0, symbol)
        if kind in _NEXT[state]:
            yield "K", broken, _NEXT[state][kind]
        yield "R", RELABEL + broken, _NEXT[state][_FILLER[state]]


def _inserted(state: int) -> int:
    return _NEXT[state][_FILLER[state]]


def _product(a: tuple[Costs, ...], b: tuple[Costs, ...]) -> tuple[Costs, ...]:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


@lru_cache(maxsize=None)
def _power(symbol: int, exponent: int) -> tuple[Costs, ...]:
    """Min-plus matrix of 2**exponent rows: from the state before them to the state after."""
    if exponent:
        half = _power(symbol, exponent - 1)
        return _product(half, half)
    rows = []
    for state in range(4):
        row, paid, at = [_FAR] * 4, 0, state
        for _ in range(4):  # up to three insertions reach every state
            for _, cost, after in _edits(symbol, at):
                row[after] = min(row[after], paid + cost)
            paid, at = paid + INSERT, _inserted(at)
        rows.append(tuple(row))
    return tuple(rows)


#: Costs from the end of a conversation: what has to be inserted there.
_END: Costs = tuple(next(k * INSERT for k, at in enumerate((q, _inserted(q), _inserted(_inserted(q)))) if at in _FINAL) for q in range(4))


def _less(costs: Costs) -> tuple[Costs, int]:
    """Costs above their least, and that."""
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(maxsize=1 << 16)
def advance(symbol: int, length: int, after: Costs) -> Costs:
    """Costs before a run of ``length`` equal symbols from the costs after it."""
    exponent = 0
    while length:
        if length & 1:
            m = _power(symbol, exponent)
            after = tuple(min(m[q][k] + after[k] for k in range(4)) for q in range(4))
        length, exponent = length >> 1, exponent + 1
    return after


@lru_cache(maxsize=1 << 16)
def _choice(symbol: int, after: Costs) -> str:
    """The letter to take in each state: of the cheapest edits the least."""
    before = advance(symbol, 1, after)
    letters = []
    for q in range(4):
        ways = [(letter, cost + after[to]) for letter, cost, to in _edits(symbol, q)]
        ways.append(("I", INSERT + before[_inserted(q)]))
        letters.append(min(letter for letter, cost in ways if cost == before[q]) or "-")
    return "".join(letters)


def unroll(symbol: int, length: int, after: Costs) -> list[str]:
    """Choices of the rows of a run, last row first; once relative costs come back, choices repeat."""
    seen: dict[Costs, int] = {}
    choices: list[str] = []
    costs = _less(after)[0]
    while len(choices) < length:
        if costs in seen:
            cycle = choices[seen[costs] :]
            choices += cycle * (-(-(length - len(choices)) // len(cycle)))
            break
        seen[costs] = len(choices)
        choices.append(_choice(symbol, costs))
        costs = _less(advance(symbol, 1, costs))[0]
    return choices[:length]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after damage dealt by a checksum of conversation and turn.

    Nulls of role and text become one space, as they do in the checksum. A dropped row leaves one with no copies, so that
    its conversation stays known.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    case = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), part[2].alias("role"), part[3].alias("text"), case.alias("case"))
    gone, text, role = F.col("case") == 0, F.col("text"), F.col("role")
    cut = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(
        "conv_id",
        F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("case") == 4, "user").otherwise(role).alias("role"),
        F.when(gone, "").otherwise(cut).alias("text"),
        F.when(gone, 0).when(F.col("case") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _key() -> Column:
    """Conversations as text; no number is a space."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv_key")


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of one turn as one row with ``copies``; ``fault`` is that of the first copy, the others are duplicates."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    place = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    whole = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    seen = rows.where("copies > 0").groupBy(_key(), "role", digest).agg(F.min(place).alias("first"), F.sum("copies").alias("n"))
    seen = seen.where("n > 1").drop("n")
    tight = F.rtrim("text", F.lit(SPACES))
    fault = (
        F.when(F.col("copies") == 0, None)
        .when(tight == "", "blank")
        .when(place > F.col("first"), "duplicate")
        .when(~F.right(tight, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    found = whole.select("*", _key(), digest).join(seen, ["conv_key", "role", "digest"], "left")
    return found.select("conv_key", "conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def _symbol() -> Column:
    kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    broken = F.when(F.col("fault") == "truncated", 4).otherwise(0)
    gone = F.col("fault").isin("blank", "duplicate")
    return F.when(F.col("copies") == 0, _NOTHING).when(gone, _GONE).otherwise(kind + broken).alias("symbol")


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last row first: adds each row's choices and, to the first row of a conversation, its whole cost."""
    conv, costs, paid = None, _END, 0
    for batch in batches:
        keys, symbols, copies = (batch.column(c).to_pylist() for c in ("conv_key", "symbol", "copies"))
        choices: list[str] = []
        totals: list[int] = []
        i = 0
        while i < len(keys):
            if keys[i] != conv:
                conv, costs, paid = keys[i], _END, 0
            j = i
            while j < len(keys) and keys[j] == conv and symbols[j] == symbols[i]:
                j += 1
            choices += unroll(symbols[i], j - i, costs)
            costs, least = _less(advance(symbols[i], j - i, costs))
            paid += least + DELETE * sum(c - 1 for c in copies[i:j] if c > 1)  # further copies are deleted
            totals += [0] * (j - i - 1) + [paid + costs[0]]
            i = j
        columns = [*batch.columns, pa.array(choices, pa.string()), pa.array(totals, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "choices", "cost"])


_EDITS = "position bigint, edit string, times bigint, role string, fault string, cost bigint, new_role string"


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First row first: follows the choices from the empty conversation, one row per edit."""
    conv, conv_id, turn_type, state, position, id_type = None, None, pa.int64(), 0, 0, None

    def closing() -> list[tuple]:
        """Insertions at the end of the present conversation."""
        nonlocal state, position
        added = []
        while conv is not None and state not in _FINAL:
            added.append((None, conv_id, position, "I", 1, _ROLES[_FILLER[state]], None, 0, _ROLES[_FILLER[state]]))
            state, position = _inserted(state), position + 1
        return added

    def table(rows: list[tuple], batch: pa.RecordBatch | None) -> pa.RecordBatch:
        """Rows start with their place in ``batch``, none for inserted ones."""
        at, ids, positions, edits, times, roles, faults, costs, new = zip(*rows)
        places = pa.array(at, pa.int64())
        if batch is None:
            turns, texts = pa.nulls(len(rows), turn_type), pa.array([""] * len(rows))
        else:
            turns = batch.column("turn").take(places)
            texts = batch.column("text").take(places).fill_null("")
        columns = [pa.array(ids, id_type), turns, texts, pa.array(positions, pa.int64()), pa.array(edits, pa.string())]
        columns += [pa.array(times, pa.int64()), pa.array(roles, pa.string()), pa.array(faults, pa.string())]
        columns += [pa.array(costs, pa.int64()), pa.array(new, pa.string())]
        names = ["conv_id", "turn", "text", *(c.split()[0] for c in _EDITS.split(", "))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        keys, ids, roles, copies, faults, choices, costs = (
            batch.column(c).to_pylist() for c in ("conv_key", "conv_id", "role", "copies", "fault", "choices", "cost")
        )
        rows: list[tuple] = []
        for i, key in enumerate(keys):
            if key != conv:
                rows += closing()
                conv, conv_id, state, position = key, ids[i], 0, 0
            cost = costs[i] if position == 0 else 0
            if not copies[i]:
                rows.append((i, conv_id, position, "", 0, "", None, cost, None))
                position += 1
                continue
            while (letter := choices[i][state]) == "I":
                rows.append((None, conv_id, position, "I", 1, _ROLES[_FILLER[state]], None, cost, _ROLES[_FILLER[state]]))
                state, position, cost = _inserted(state), position + 1, 0
            new = None
            if letter == "K":
                new, kind = roles[i], "sua".index(roles[i][0])
                state = _NEXT[state][kind]
            elif letter == "R":
                new, state = _ROLES[_FILLER[state]], _inserted(state)
            rows.append((i, conv_id, position, letter, 1, roles[i], faults[i], cost, new))
            position += 1
            if copies[i] > 1:
                fault = "blank" if faults[i] == "blank" else "duplicate"
                rows.append((i, conv_id, position, "D", copies[i] - 1, roles[i], fault, 0, None))
                position += 1
        if rows:
            yield table(rows, batch)
    if rows := closing():
        yield table(rows, None)


def repairs(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every conversation, in order; of those, the ones whose letters come first.

    ``rows`` has conv_id, turn, role, text (not null) and copies (0: nothing, but the conversation exists). Columns:
    conv_id, turn, text, position, edit (``K``eep, ``R``erole, ``D``elete, ``I``nsert; empty for no copies), times,
    role (before), fault, cost (of the whole conversation, in its first row), new_role (null if deleted). Rows of a
    conversation are in one partition and in order; an operator without a shuffle may rely on that.

    Rows are ordered by turn, nulls first, then role and text. Null conv_id: a conversation like others. Equal rows of a turn are
    copies, all but the first duplicates. A long run costs as many matrix products as its length has binary digits.
    Empty table: no rows. Other columns are ignored.

    Copies are summed and first places found by aggregation, before rows of a conversation meet. They do meet in one task:
    its digest is one chain over all of its text. That task holds a batch of rows, however long the conversation
    is: costs are found in descending order, choices followed in ascending order, between two sorts that can spill.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    down = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    placed = with_faults(rows).select("*", _symbol()).repartition("conv_key").sortWithinPartitions("conv_key", *down)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    chosen = placed.mapInArrow(_backward, f"{fields}, choices string, cost bigint")
    kind = placed.schema["conv_id"].dataType.simpleString()
    ordered = chosen.sortWithinPartitions("conv_key", *order)
    return ordered.mapInArrow(_forward, f"conv_id {kind}, turn bigint, text string, {_EDITS}")


_LEGAL = ("su", "ua", "au")
_REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


class _Report:
    """Sums over the edits of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.faults, self.illegal, self.cost = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.turns, self.low, self.high, self.turn, self.role = 0, None, None, None, None
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0

    def add(self, turn, edit: str, times: int, role: str, fault: str | None, cost: int, new_role, text) -> None:
        self.cost += cost
        self.audit.append(edit * times)
        if fault:
            self.faults[fault] += times
        if new_role is not None:
            self.hash.update(f"{chr(10) if self.lines else ''}{new_role}:{text}".encode())
            self.lines += 1
        if edit == "I" or not times:
            return
        initial = role[:1]
        self.illegal += times - 1 + (self.role is not None and self.role + initial not in _LEGAL)
        self.role = initial
        if turn is not None and turn != self.turn:  # turns come in order
            self.turn, self.turns, self.high = turn, self.turns + 1, turn
            self.low = turn if self.low is None else self.low

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, schema = None, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        names = [c.split() for c in _REPORT.split(", ")]
        fields = [(n, pa.string() if t == "string" else pa.int64()) for n, t in names]
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *fields])
        columns = ("conv_id", "position", "turn", "edit", "times", "role", "fault", "cost", "new_role", "text")
        done = []
        for conv_id, position, *edit in zip(*(batch.column(c).to_pylist() for c in columns)):
            if position == 0:
                if now is not None:
                    done.append(now.row())
                now = _Report(conv_id)
            now.add(*edit)
        if done:
            yield table(done)
    if now is not None:
        yield table([now.row()])


def reports(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repairs``: gaps in turns, faults, illegal neighbours, cost, audit, digest of the result."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    return edits.mapInArrow(_reported, f"conv_id {kind}, {_REPORT}")
