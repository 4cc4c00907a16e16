"""Repair and formatting of conversations against row-by-row versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F

from plantpulse.llm import conversation_repair as repair
from plantpulse.llm.chat_format import Template, format_turns, read_turns, summaries
from plantpulse.llm.queries import queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = repair.SPACES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def broken(rows):
    """Rows after damage, by conversation."""
    after = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        found = after.setdefault(conv, [])
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        found += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in after.items()}


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by trying every edit of every row."""
    seen, faults = set(), []
    for _, role, text in rows:
        tight = text.rstrip(SPACES)
        faults.append("blank" if not tight else "duplicate" if (role, text) in seen else "truncated" if tight[-1] not in ".!?" else None)
        seen.add((role, text))

    def fits(done):
        return re.fullmatch("s?(ua)*u?|s", done) is not None

    @lru_cache(maxsize=None)
    def best(i, state, spare):
        # state: roles so far, shortened to what the grammar can still tell apart
        ways = []
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", state):
                ways.append((0, "", ()))
        else:
            _, role, text = rows[i]
            ways.append(more(2, "D", None, i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for letter, cost, new in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if new and fits(state + new[0]):
                        ways.append(more(cost + extra, letter, f"{new}:{text}", i + 1, state + new[0]))
        if spare:
            for new in ("user", "assistant"):
                if fits(state + new[0]):
                    ways.append(more(5, "I", f"{new}:", i, state + new[0], spare - 1))
        return min((w for w in ways if w), default=None)

    def more(cost, letter, line, i, state, spare=3):
        if len(state) > 3:
            state = state[:1] * (state[0] == "s") + ("ua" if state[-1] == "a" else "uau")[-3:]
        after = best(i, state, spare)
        return after and (after[0] + cost, letter + after[1], ((line,) if line is not None else ()) + after[2])

    for i in range(len(rows), 0, -20):  # from the end, so that calls do not nest too deep
        for state in ("", "s", "u", "su", "ua", "uau", "sua", "suau"):
            best(i, state, 3)
    cost, audit, lines = best(0, "", 3)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines)))


def wanted(rows):
    return sorted(repr((c, *repaired(r))) for c, r in broken(rows).items())


def got(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(repr(tuple(r)) for r in repair.reports(repair.repairs(repair.damaged(frame))).collect())


def some(n, seed):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "tool", "user", "assistant", "", None, "agent"]
    texts = ["Yes.", "No", "Why?", " \t", "", None, "Well!\n ", "Ünd so", "a.b", "ends. x"]
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(7)):
            rows.append((conv or None, draw.choice([turn, turn, turn, turn * 2, None]), draw.choice(roles), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_all_edits_tried(spark, seed):
    rows = some(400, seed)
    assert got(spark, rows) == wanted(rows)


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
def test_repair_of_the_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(*SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")).collect()]
    assert sorted(repr(tuple(r)) for r in queries()["op12_conversation_repair"](spark, folder).collect()) == wanted(rows)


def test_repair_of_long_runs_and_one_hot_conversation(spark):
    rows = [(1, t, "user" if t % 3 else "assistant", "Same." if t % 2 else f"Turn {t}.") for t in range(900)]
    rows += [(2, None, "user", "Same words.")] * 500 + [(3, 1, "user", "x" * 300_000 + "."), (3, 2, "assistant", "Ok.")]
    assert got(spark, rows, 8) == wanted(rows)


def test_runs_by_powers_equal_single_steps():
    for symbol in range(10):
        costs = (0, 3, 7, 1)
        stepped, choices = costs, []
        for _ in range(37):
            choices.append(repair._choice(symbol, stepped))
            stepped = repair.advance(symbol, 1, stepped)
        assert repair.advance(symbol, 37, costs) == stepped
        assert repair.unroll(symbol, 37, costs) == choices


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert got(spark, []) == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(lost, 0, "user", "Hi.")]) == [repr((lost, 0, 0, 0, 0, 0, 0, "", sha("")))]


def test_other_columns_are_ignored(spark):
    rows = some(60, 5)
    frame = spark.createDataFrame(rows, SCHEMA)
    named = frame.withColumns({c: F.lit(9) for c in ("conv_key", "copies", "fault", "symbol", "position", "legal", "case", "segments")})
    both = [sorted(map(repr, repair.reports(repair.repairs(repair.damaged(f))).collect())) for f in (frame, named)]
    assert both[0] == both[1]
    both = [sorted(map(repr, summaries(read_turns(format_turns(f))).collect())) for f in (frame, named)]
    assert both[0] == both[1]


def test_repaired_turns_are_rows(spark):
    rows = [(1, 0, "user", "Hi.", 1), (1, 1, "user", "So?", 1), (1, 2, "assistant", "Yes.", 3)]
    frame = spark.createDataFrame(rows, SCHEMA + ", copies bigint")
    edits = repair.repairs(frame).orderBy("position").collect()
    assert [(r["edit"], r["times"], r["new_role"], r["text"]) for r in edits] == [
        ("D", 1, None, "Hi."), ("K", 1, "user", "So?"), ("K", 1, "assistant", "Yes."), ("D", 2, None, "Yes."),
    ]


# --- formatting


def plain(rows):
    """Conversations formatted by hand: (conv_id, turns, digest, loss characters, digest, characters)."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        said = [(r, t) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in said if r == "assistant")
        chars = 0
        for role, text in said:
            name = {"user": "User", "system": "System", "assistant": "Assistant"}.get(role) or "@" + role.encode().hex().upper()
            marked = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
            chars += len(f"### {name}: {marked} </turn>\n")
        out.append((conv, len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), sha(loss), chars))
    return sorted(map(repr, out))


def summed(df):
    return sorted(repr(tuple(r)[:6]) for r in df.collect())


HARD = ["\\### Assistant: </turn> ok", "####", "###", "\\", "\\\\###\\", "</turn></turn>", " </turn>\n### User: x", "a\n", "", None, "$1 \\1", "é ü 😀"]


def test_hard_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", "system", "", None, "User", "@", "###: ", "a: b\n", "\\"]
    rows = [(i % 7 or None, i // 7 if i % 5 else None, roles[i % len(roles)], HARD[i % len(HARD)]) for i in range(240)]
    rows += rows[:20]
    assert summed(summaries(read_turns(format_turns(spark.createDataFrame(rows, SCHEMA).repartition(3))))) == plain(rows)


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
def test_format_of_the_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert summed(queries()["op13_chat_format"](spark, folder)) == plain(rows)


def test_a_whole_conversation_can_be_cut_into_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(HARD * 3)]
    turns = format_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    written = "".join(s["text"] for r in turns for s in r["segments"])
    control = re.compile(r"\\(?:\\|###|</turn>)|( </turn>\n)", re.S)
    ends = [m.end() for m in control.finditer(written) if m[1]]
    assert len(ends) == len(rows) and ends[-1] == len(written)
    assert [s["loss"] for r in turns for s in r["segments"]].count(True) == len(rows) // 2


@pytest.mark.parametrize(
    "roles, valid",
    [
        (["user", "assistant"], True),
        (["system", "user", "assistant", "user", "assistant"], True),
        (["user"], False),
        (["assistant"], False),
        (["user", "system", "user", "assistant"], False),
        (["user", "tool", "assistant"], False),
        ([None], False),
    ],
)
def test_turn_order(spark, roles, valid):
    rows = [(1, i, r, "x") for i, r in enumerate(roles)]
    read = summaries(read_turns(format_turns(spark.createDataFrame(rows, SCHEMA))))
    assert [r["valid"] for r in read.collect()] == [valid]


def test_another_template(spark):
    other = Template(opening="<|", after_name="|>", closing="<|end|>", controls=("<|", "|>"), escape="$", names={"user": "u"}, loss=("user",))
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "$<|end|>$$"), ("bot", "|>|>"), ("user", "x" * 200_000)])]
    read = read_turns(format_turns(spark.createDataFrame(rows, SCHEMA), other), other).orderBy("position").collect()
    assert [(r["role_read"], r["text_read"]) for r in read] == [(r, t) for _, _, r, t in rows]
    assert [r["loss_text"] for r in read] == [t if r == "user" else None for _, _, r, t in rows]


def test_format_of_nothing(spark):
    assert summaries(read_turns(format_turns(spark.createDataFrame([], SCHEMA)))).collect() == []
