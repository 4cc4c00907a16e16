"""Line dedup in chunks."""

import hashlib
import random

from plantpulse.llm import line_dedup
from plantpulse.llm.line_dedup import remove_repeated

FIELDS = "doc_id bigint, text string, removed string"


def chunks_of(text):
    """(start, size) of each chunk, line by line."""
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    ends = []
    for i in range(len(lines)):
        before = h[i - 1] if i else 0
        turned = ((before << 7) & 0xFFFFFFFF) | (before >> 25)
        if (h[i] ^ turned) % line_dedup.MEAN_LINES == 0 or i == len(lines) - 1:
            ends.append(i)
    starts = [0, *(e + 1 for e in ends[:-1])]
    return [(s, e - s + 1) for s, e in zip(starts, ends)]


def brute(rows):
    seen, out = set(), []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, kept, gone = (text or "").split("\n"), [], []
        for start, size in chunks_of(text or ""):
            chunk = tuple(lines[start : start + size])
            if size >= line_dedup.LEAST_LINES and chunk in seen:
                gone.append((start, size))
            else:
                kept += chunk
            seen.add(chunk)
        out.append((doc_id, "\n".join(kept) if gone else text, gone))
    return sorted(out, key=repr)


def result(docs):
    rows = remove_repeated(docs).select("doc_id", "text", "removed").collect()
    return sorted(((r[0], r[1], [tuple(c) for c in r[2]]) for r in rows), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(3)
    passages = ["\n".join(f"line {rng.randrange(400)}" for _ in range(rng.randint(2, 12))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(passages), f"own {i} {k}", ""]) for k in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(parts), "x"))
    got = result(spark.createDataFrame(rows, FIELDS))
    assert got == brute(rows)
    assert any(r[2] for r in got)


def test_passage_is_found_wherever_it_stands():
    passage = [f"sentence {i}" for i in range(30)]
    a = chunks_of("\n".join(["x", *passage]))
    b = chunks_of("\n".join(["p", "q", "r", "s", *passage, "end"]))
    inner = {(s - 1, n) for s, n in a[1:-1]} & {(s - 4, n) for s, n in b}
    assert len(inner) >= len(a) - 3


def test_nulls_repeats_and_long_texts(spark):
    long = "\n".join(f"l{i}" for i in range(20_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (None, long, "x"), (5, "one line", "x"), (6, "one line", "x")]
    rows += [(7, "a\nb\nc\nd", "x")] * 2
    got = {(r[0], r[1] if r[1] is None or len(r[1]) < 99 else len(r[1])) for r in result(spark.createDataFrame(rows, FIELDS))}
    assert {(1, None), (2, ""), (3, len(long)), (5, "one line"), (6, "one line"), (7, "a\nb\nc\nd")} <= got
    dropped = [r for r in result(spark.createDataFrame(rows, FIELDS)) if r[0] is None][0]
    assert sum(n for _, n in dropped[2]) > 15_000
    assert remove_repeated(spark.createDataFrame(rows, FIELDS)).columns == ["doc_id", "text", "removed"]
    assert remove_repeated(spark.createDataFrame([], FIELDS)).count() == 0


def test_equal_digests_of_different_bytes_stay(spark):
    docs = spark.createDataFrame([(b"1", [(0, 2, b"d", True)], "a\nb"), (b"2", [(0, 2, b"d", False)], "a\nc"), (b"3", [(0, 2, b"d", False)], "a\nb")],
                                 "__row_key binary, __suspects array<struct<start:int,size:int,digest:binary,stays:boolean>>, text string")
    assert [(bytes(r[0]), r[1]) for r in line_dedup._different(docs).collect()] == [(b"2", 0)]


def test_no_python_in_the_plan(spark):
    plan = remove_repeated(spark.createDataFrame([(1, "a\nb", "")], FIELDS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
