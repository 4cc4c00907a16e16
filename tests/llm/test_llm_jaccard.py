"""Similarity join, its index keys and bit maps, and components."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm import jaccard_join
from plantpulse.llm.components import components
from plantpulse.llm.jaccard_join import Frequent, index_keys, jaccard_groups, parity_bits

FIELDS = "doc_id bigint, text string, group string"


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def result(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], FIELDS)
    got = jaccard_groups(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got))


def near_copies(rng, groups, copies, words, vocabulary):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, words // 30))):
                text[rng.randrange(len(text))] = f"e{rng.randrange(50)}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 60), (3, 100)])
def test_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    rows = near_copies(rng, 12, 6, 80, 500)
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "a", "A ", "a b", "a b c d e", "a b\tc d E"])]
    assert result(spark, rows, words=size, percent=percent) == brute(rows, size, percent)


@pytest.mark.parametrize("paired", [8, 256])
def test_one_group_of_near_copies_with_frequent_shingles(spark, monkeypatch, paired):
    made = jaccard_join.Frequent.__init__
    monkeypatch.setattr(jaccard_join.Frequent, "__init__", lambda self, h, n: made(self, h, n * 256 // paired))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(1, 3)):
            text[rng.randrange(100)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    # a passage of that text in otherwise different documents
    rows += [(200 + i, " ".join(base[:40] + [f"o{i}_{k}" for k in range(60)])) for i in range(60)]
    assert result(spark, rows, words=4, percent=85) == brute(rows, 4, 85)


def test_nulls_repeats_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None), (2, " \n"), (5, long), (4, long + " more"), (7, "x y"), (7, "x y")]
    assert result(spark, rows) == [(1, 0, 1), (2, 0, 2), (4, 19_997, 4), (5, 19_996, 4), (7, 1, 7), (7, 1, 7)]
    docs = spark.createDataFrame([(None, "p q"), (3, "p q"), (None, "r s")], "doc_id bigint, text string")
    assert {(r[0], r[2]) for r in jaccard_groups(docs).collect()} == {(None, 3), (3, 3), (None, None)}
    assert jaccard_groups(docs.limit(0)).count() == 0


def random_pair(rng, percent):
    n = int(rng.integers(1, 400))
    base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    out = int(rng.integers(0, len(base) * (100 - percent) // 100 + 1))
    other = np.unique(np.concatenate([base[: len(base) - out], rng.integers(0, 2**63, int(rng.integers(0, out + 1)), dtype=np.uint64)]))
    return base, np.sort(other)


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    while tried < 400:
        a, b = random_pair(rng, percent)
        both = len(np.intersect1d(a, b))
        if len(b) == 0 or np.array_equal(a, b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        tried += 1
        chosen = np.union1d(a, b)
        chosen = chosen[rng.random(len(chosen)) < rng.choice([0, 0.5, 0.9, 1])]
        frequent = Frequent(chosen, rng.integers(1, 10_000, len(chosen)))
        assert len(np.intersect1d(index_keys(a, frequent, percent), index_keys(b, frequent, percent)))


def test_keys_of_frequent_shingles_grow_with_the_set_not_its_square():
    tokens = np.sort(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    assert len(index_keys(tokens, Frequent(tokens, np.full(len(tokens), 999)), 85)) < 5 * len(tokens)


def test_sets_that_share_single_shingles_share_few_keys():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 8000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, 200)) for _ in range(400)]
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    frequent = Frequent(tokens[counts >= 8], counts[counts >= 8])
    _, sharing = np.unique(np.concatenate([index_keys(s, frequent, 85) for s in sets]), return_counts=True)
    assert sharing[sharing > 1].sum() < 0.05 * sharing.sum()


def test_repeated_shingles_are_counted_in_little_more_than_their_window():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**15, 1000, dtype=np.uint64) << np.uint64(48)) for _ in range(20)]
    counts = Counter(int(t) for found in sets for t in found)
    (got,) = jaccard_join.repeated(iter(sets), 1 << 16)
    assert {int(t): int(n) for t, n in zip(*got)} == {t: n for t, n in counts.items() if n >= 2}
    assert sum(int(n.sum()) for _, n in jaccard_join.repeated(iter(sets), 300)) < sum(map(len, sets))
    window = 1 << 20
    tokens = rng.integers(0, 2**63, window, dtype=np.uint64)
    tracemalloc.start()
    try:
        assert len(list(jaccard_join.repeated((tokens[i : i + 1024] for i in range(0, window, 1024)), window))) == 1
        assert tracemalloc.get_traced_memory()[1] < 1.5 * tokens.nbytes
    finally:
        tracemalloc.stop()


def test_bit_maps_bound_the_difference(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    pairs = [random_pair(rng, 60) for _ in range(100)]
    rows = [(parity_bits(a).tolist(), parity_bits(b).tolist(), int(len(np.setxor1d(a, b)))) for a, b in pairs if len(b)]
    df = spark.createDataFrame(rows, "x array<bigint>, y array<bigint>, differ bigint")
    bits = jaccard_join._differing_bits(F.col("x"), F.col("y"))
    assert df.where(bits > F.col("differ")).count() == 0
    assert df.where((F.col("differ") > 0) & (bits > 0)).count() > 50


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(100, 100), (5, 6)]
    top = {n: n for e in edges for n in e}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert sorted(map(tuple, components(df).collect())) == sorted((n, find(n)) for n in linked)
    assert components(df.limit(0)).count() == 0
