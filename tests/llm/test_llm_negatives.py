"""Residue-number products and mining of hard negatives."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plantpulse.llm import hard_negatives
from plantpulse.llm.hard_negatives import PRIMES, mine, residue_product

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def exact(left, right):
    return [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in right] for x in left]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 30), st.integers(1, 200), st.integers(0, 2**31))
def test_product_is_exact(bits, width, seed):
    rng = np.random.default_rng(seed)
    top = 1 << min(bits, int((62 - math.log2(width)) // 2))
    left, right = rng.integers(-top, top + 1, (3, width)), rng.integers(-top, top + 1, (4, width))
    assert residue_product(left, right).tolist() == exact(left, right)


def test_product_at_the_ends():
    assert all(all(p % q for q in range(2, p)) for p in PRIMES) and math.prod(PRIMES) > 1 << 65
    big = np.full((1, 1), 3_000_000_000, np.int64)
    assert residue_product(big, -big).tolist() == [[-9_000_000_000_000_000_000]]
    with pytest.raises(OverflowError):
        residue_product(big * 2, big)
    assert residue_product(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2
    assert residue_product(np.zeros((0, 5), np.int64), np.ones((3, 5), np.int64)).shape == (0, 3)


def brute(rows, every=100, k=5):
    """All rows sorted anew for every anchor and positive."""
    kept = []
    for vec, parts, label in rows:
        if label is not None and parts is not None and all(x is not None and math.isfinite(x) for x in parts):
            kept.append((vec, [math.floor(256 * x) for x in parts], label))
    rank = lambda r: (-r[1], r[0] is None, r[0] or 0)
    found = []
    for vec, parts, label in kept:
        if vec is None or vec % every:
            continue
        others = [(i, sum(a * b for a, b in zip(parts, q)), y) for i, q, y in kept if i != vec]
        for p, ps, _ in sorted((o for o in others if o[2] == label), key=rank)[:k]:
            fit = sorted((o for o in others if o[2] != label and 80 * ps <= 100 * o[1] <= 100 * ps), key=rank)[:k]
            found += [(vec, p, j, n, ps, ns) for j, (n, ns, _) in enumerate(fit, 1)]
    return sorted(map(repr, found))


def mined(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(repr(tuple(r)) for r in mine(frame, F.col("vec_id") % 100 == 0).collect())


def vectors(n, seed, width=6):
    rng = np.random.default_rng(seed)
    return [(i * 25, (rng.integers(-40, 90, width) / 128).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("blocks", [(1024, 2048), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", blocks[1])
    rows = vectors(120, 1)
    assert mined(spark, rows) == brute(rows) != []


def test_beyond_the_broadcast_and_with_few_entries_held(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(hard_negatives, "HELD_ENTRIES", 10)
    rows = vectors(80, 2)
    assert mined(spark, rows) == brute(rows) != []


def test_nulls_ties_repeats_and_lengths(spark):
    same = [0.5, 0.25]
    rows = [(i, same, i % 2) for i in range(97, 130)] + [(100, same, 0), (100, [0.75], 0), (103, same, 1), (103, same, 1)]
    rows += [(None, same, 0), (None, same, 1), (200, None, 1), (201, [0.5, None], 1), (202, [float("nan"), 1.0], 1)]
    rows += [(300, [float("inf")], 0), (301, same, None), (400, [], 1), (402, [0.5, 0.25, 9.0], 0), (500, [-1.0, -1.0], 1)]
    assert mined(spark, rows, 2) == brute(rows) != []


def test_one_vector_in_a_third_of_all_rows(spark):
    rows = vectors(60, 3) + [(10_000 + i, [0.3] * 6, i % 3) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_without_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_other_columns_are_ignored(spark):
    rows = spark.createDataFrame(vectors(40, 4), SCHEMA)
    named = rows.withColumns({c: F.lit("x") for c in ("id", "number", "block", "a_block", "place", "score", "rank", "vector")})
    want = sorted(map(repr, mine(rows, F.col("vec_id") % 100 == 0).collect()))
    assert sorted(map(repr, mine(named, F.col("vec_id") % 100 == 0).collect())) == want != []
