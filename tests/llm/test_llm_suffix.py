"""Repeated passages."""

import random
import re

import numpy as np
import pytest

from plantpulse.llm.suffix_dedup import PASSAGE, WINDOW, compare, minimisers, repeated_passages

SMALL = "/root/testdata/sf0.001"
FIELDS = "doc_id bigint, text string, spans string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    """doc_id of rows with a window of PASSAGE words that another row has, with the words of such windows."""
    owners = {}
    for k, (_, text) in enumerate(rows):
        w = words_of(text)
        for i in range(len(w) - PASSAGE + 1):
            owners.setdefault(tuple(w[i : i + PASSAGE]), set()).add(k)
    out = []
    for doc_id, text in rows:
        w, covered = words_of(text), set()
        for i in range(len(w) - PASSAGE + 1):
            if len(owners[tuple(w[i : i + PASSAGE])]) > 1:
                covered |= set(range(i, i + PASSAGE))
        if covered:
            out.append((doc_id, len(covered)))
    return sorted(out)


def result(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], FIELDS)
    return sorted((r["doc_id"], r["repeated_words"]) for r in repeated_passages(docs).collect())


def corpus(rng):
    def own(n):
        return [f"o{rng.randrange(10**9)}" for _ in range(n)]

    passages = [own(n) for n in (49, 50, 51, 80, 200)]
    return [
        (i, " ".join(own(rng.randint(0, 60)) + rng.choice(passages) + own(rng.randint(0, 60)))) for i in range(80)
    ]


def test_against_brute_force(spark):
    rows = corpus(random.Random(4))
    assert result(spark, rows) == brute(rows)


def test_removable_leaves_one_copy(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(30)] + passage), "") for i in range(20)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in repeated_passages(spark.createDataFrame(rows, FIELDS)).collect()}
    assert [d for d, r in got.items() if not r["removable"]] == [0]
    assert all([(s["start"], s["end"]) for s in r["spans"]] == [(30, 100)] for r in got.values())


def test_copies_nulls_repeats_and_short_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, ""), (2, text.upper(), ""), (2, text.upper(), ""), (None, text, ""), (5, None, ""), (6, "", ""), (7, "short", ""), (8, "short", "")]
    got = repeated_passages(spark.createDataFrame(rows, FIELDS)).collect()
    assert sorted((str(r["doc_id"]), len(r["removable"])) for r in got) == [("2", 0), ("2", 1), ("3", 1), ("None", 1)]
    assert all(r["repeated_words"] == 60 for r in got)
    assert repeated_passages(spark.createDataFrame([], FIELDS)).count() == 0


def test_long_text_with_a_repeated_word(spark):
    rows = [(1, "x " * 20_000), (2, "x " * 15_000 + "y")]
    assert [d for d, _ in result(spark, rows)] == [1, 2]


def test_every_passage_keeps_a_suffix_among_its_first():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h = rng.integers(0, rng.choice([3, 2**63]), 300, dtype=np.uint64)
        kept = minimisers(h)
        for s in range(len(h) - PASSAGE + 1):
            assert ((kept >= s) & (kept < s + WINDOW)).any()
        # the same words elsewhere keep the same suffixes
        moved = minimisers(np.concatenate([rng.integers(0, 2**63, 77, dtype=np.uint64), h]))
        assert {p - 77 for p in moved if p >= 77 + WINDOW} >= {p for p in kept if p >= WINDOW}


def test_match_hidden_by_a_neighbour():
    left = [f"l{i}" for i in range(25)]
    group = sorted(
        [(1, 1, 99, left, ["r"] * 30 + ["a"]), (2, 2, 99, ["q"], ["r"] * 30 + ["b"]), (3, 3, 99, left, ["r"] * 30 + ["c"])],
        key=lambda g: g[4],
    )
    assert sorted(compare(group)) == [(1, 74, 129, False), (3, 74, 129, True)]


def test_nested_passages():
    r, more = [f"r{i}" for i in range(50)], [f"m{i}" for i in range(20)]
    # A and C share 20 words more to the left than B
    group = [(1, 1, 70, ["a", *more], r), (2, 2, 70, ["b"], r), (3, 3, 70, ["c", *more], r)]
    assert covered(compare(group)) == {(1, False): {*range(50, 120)}, (2, True): {*range(70, 120)}, (3, True): {*range(50, 120)}}
    # B and C share 20 words more to the right than A: B keeps these
    group = [(n, n, 9, [], r + tail) for n, tail in ((1, ["a"]), (2, more), (3, more))]
    group = [(n, d, p, ["x"] * 5 + [str(n)], right[: PASSAGE]) for n, d, p, _, right in group]
    group += [(n, n, 29, r[:20][-WINDOW + 1 :], r[20:] + more) for n in (2, 3)]
    got = covered(compare(group))
    assert got[1, False] == {*range(9, 59)} and got[3, True] == {*range(9, 79)}
    # two pairs with different words to the left, and the same 50 to the right
    group = [(n, n, 70, [side], r) for n, side in ((1, "p"), (2, "p"), (3, "q"), (4, "q"))]
    assert [n for n, removable in sorted(covered(compare(group))) if not removable and n > 2] == [3]


def covered(found):
    out = {}
    for node, start, end, removable in found:
        out.setdefault((node, removable), set()).update(range(start, end))
    return out


def test_hidden_pairs_are_chained(spark):
    """Removable words are those of windows that a smaller doc_id has; repeated words are as in the brute force."""
    rng = random.Random(12)

    def own(n):
        return [f"o{rng.randrange(10**9)}" for _ in range(n)]

    common, sides, tails = own(52), [own(25) for _ in range(3)], [own(25) for _ in range(3)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(own(20) + rng.choice(sides)[rng.choice([0, 9, 25]) :] + common + rng.choice(tails)[: rng.choice([0, 9, 25])] + own(20))))
    assert result(spark, rows) == brute(rows)
    first, wanted = {}, {}
    for d, text in rows:
        w = words_of(text)
        for i in range(len(w) - PASSAGE + 1):
            if first.setdefault(tuple(w[i : i + PASSAGE]), d) != d:
                wanted.setdefault(d, set()).update(range(i, i + PASSAGE))
    got = repeated_passages(spark.createDataFrame([(d, t, "x") for d, t in rows], FIELDS)).collect()
    assert {r["doc_id"]: {k for s in r["removable"] for k in range(s["start"], s["end"])} for r in got if r["removable"]} == wanted


def lengths(words):
    """Numbers of a set as (start, end) of its runs."""
    out = []
    for k in sorted(words):
        if out and out[-1][1] == k:
            out[-1][1] = k + 1
        else:
            out.append([k, k + 1])
    return [tuple(o) for o in out]


def brute_spans(rows):
    """Per row of different texts: spans of repeated windows, and of those that a smaller doc_id has."""
    owners, texts = {}, {d: words_of(t) for d, t in rows}
    for d, w in texts.items():
        for i in range(len(w) - PASSAGE + 1):
            owners.setdefault(tuple(w[i : i + PASSAGE]), set()).add(d)
    out = {}
    for d, w in texts.items():
        spans, removable = set(), set()
        for i in range(len(w) - PASSAGE + 1):
            having = owners[tuple(w[i : i + PASSAGE])]
            spans |= set(range(i, i + PASSAGE)) if len(having) > 1 else set()
            removable |= set(range(i, i + PASSAGE)) if min(having) < d else set()
        if spans:
            out[d] = lengths(spans), lengths(removable)
    return out


def spans_of(found):
    def listed(spans):
        return [(s["start"], s["end"]) for s in spans]

    return {r["doc_id"]: (listed(r["spans"]), listed(r["removable"])) for r in found.collect()}


@pytest.fixture
def many_tasks(spark):
    """Ranges of the order so small that a frequent block or window lies in many."""
    names = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {}  # copies of a text are one node
    for r in sorted(docs.select("doc_id", "text").collect()):
        texts.setdefault(tuple(words_of(r["text"])), (r["doc_id"], r["text"]))
    got, kept = spans_of(repeated_passages(docs)), [t for t in texts.values()]
    copied = {d for d, _ in kept if d in got and got[d][0] == [(0, len(words_of(dict(kept)[d])))]}
    wanted = brute_spans(kept)
    assert wanted
    for d, _ in kept:
        if d not in copied:
            assert got.get(d) == wanted.get(d)
        elif d in wanted:
            assert got[d][1] == wanted[d][1]


def test_blocks_and_windows_over_many_tasks(spark, many_tasks):
    rows = corpus(random.Random(9))
    assert spans_of(repeated_passages(spark.createDataFrame([(d, t, "x") for d, t in rows], FIELDS))) == brute_spans(rows)


def test_repeats_within_a_document_over_many_tasks(spark, many_tasks):
    rows = [(1, "x " * 3_000), (2, "y " * 2_000 + "x " * 60), (3, "z " * 500 + "y"), (4, "w " * 900)]
    assert spans_of(repeated_passages(spark.createDataFrame([(d, t, "x") for d, t in rows], FIELDS))) == brute_spans(rows)


def test_hot_passages_lose_no_match(spark, many_tasks):
    rng = random.Random(11)

    def own(n):
        return [f"o{rng.randrange(10**9)}" for _ in range(n)]

    # a short text that all have hides the pairs that share more, and 60 have a whole passage
    shared, more, passage = own(45), [own(10) for _ in range(20)], own(70)
    rows = [(i, " ".join(own(40) + shared + (more[i % 20] if i < 40 else own(10)) + own(40))) for i in range(100)]
    rows += [(100 + i, " ".join(own(30) + passage + own(30))) for i in range(60)] + [(None, " ".join(own(9) + passage))]
    rows += [(300, rows[120][1]), (301, rows[120][1].upper())]
    named = [r for r in rows if r[0] is not None and r[0] < 300]
    assert result(spark, named) == brute(named)
    docs = spark.createDataFrame([(d, t, "x") for d, t in named], FIELDS)
    assert spans_of(repeated_passages(docs)) == brute_spans(named)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], FIELDS)
    got = {r["doc_id"]: r for r in repeated_passages(docs).collect()}
    lost = {d: sum(s["end"] - s["start"] for s in r["removable"]) for d, r in got.items()}
    assert [d for d in range(40) if lost[d]] == list(range(20, 40))
    assert [d for d in range(100, 160) if lost[d] != 70] == [100] and lost[100] == 0 and lost[None] == 70
    assert lost[300] == lost[301] == 130
