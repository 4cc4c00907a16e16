"""Similarity join of word-shingle sets with token-combination prefixes.

Hash ranges deal the shingles of a set into classes; those of one class are a combination. Combinations have one
order: by the rarest of their shingles, then by how many and how rare they are. If two sets are similar enough, the
first few combinations of either (its prefix) cannot all be missing from the other. They are the index keys: sets
that have a rare shingle or a passage in common by chance seldom have a combination in common, however many they are.
Sets that share a key are compared exactly.

Equal sets are merged first. Within the sets of a key, all are compared with one leader; only
sets that are not yet in one component are compared further. So a group of thousands of near copies costs
as many comparisons as it has members.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.components import components
from plantpulse.llm.hashing import SPACE, Words, combine, rows_of_lists, shingles, slices
from plantpulse.llm.staging import discard, drop_shuffles, staged, staged_ids

#: A shingle is frequent if at least so many documents are seen to have it ...
FREQUENT_DOCUMENTS = 8
#: ... and at least this share of all shingle occurrences is its own: so there are at most as many frequent
#: shingles (of 9 bytes each), whatever the size of the corpus.
MOST_FREQUENT = 1 << 21
#: Occurrences that are counted together before those without a second one are left out.
_WINDOW = 1 << 22
_LEAST_IN_WINDOW = 2
#: Classes of shingles for each that the largest similar sets of a span of sizes may differ in. More make more of the
#: classes empty, fewer let more sets fall short of combinations.
_SPARE_CLASSES = 1.15
#: Logarithm of how far sizes within a span differ: sets of one span have their shingles in the same classes. Wide
#: spans mean that few sets are in two, but smaller combinations.
_SPAN = math.log(2)


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in slices(column):
        yield from shingles(Words(data, offsets, SPACE), words)


#: 64-bit words of the bit maps that go with every key of a set.
SMALL_MAP = 32
#: Leaders that are tried for a key at most before all its members in different components are compared.
STAR_TURNS = 8


class Frequent:
    """Frequent shingles by hash, and the level of each: the logarithm of its count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.levels = np.log2(np.maximum(counts[order], 1)).astype(np.uint8)

    def levels_of(self, tokens: np.ndarray) -> np.ndarray:
        """Level of each of ``tokens``; 0 of those that are not frequent."""
        if not len(self.hashes):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[at] == tokens, self.levels[at], 0).astype(np.int64)


def repeated(sets: Iterator[np.ndarray], window: int = _WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per ``window`` occurrences of ``sets`` the hashes that occur ``_LEAST_IN_WINDOW`` times or more, and how often.

    The occurrences are held once and sorted where they are.
    """
    held, size = np.empty(window, np.uint64), 0

    def counted() -> tuple[np.ndarray, np.ndarray]:
        part = held[:size]
        part.sort()
        again = part[1:][part[1:] == part[:-1]]  # all but the first occurrence of each
        found, n = np.unique(again, return_counts=True)
        often = n + 1 >= _LEAST_IN_WINDOW
        return found[often], n[often] + 1

    for found in sets:
        while len(found):
            taken = found[: window - size]
            held[size : size + len(taken)] = taken
            size += len(taken)
            found = found[len(taken) :]
            if size == window:
                yield counted()
                size = 0
    if size:
        yield counted()


def frequent_shingles(docs: DataFrame, words: int) -> Frequent:
    """Frequent shingles, counted over all documents.

    A task leaves out shingles that occur once among four million, so a count may fall short, and
    a shingle spread evenly over a corpus of ``n`` tasks is seen from about the square root of ``n`` documents on. How
    often a shingle is taken to occur decides its place in the order and the kind of its keys, never a result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0

        def sets() -> Iterator[np.ndarray]:
            nonlocal total
            for batch in batches:
                for found in _sets(batch.column(0), words):
                    total += len(found)
                    yield found

        for found, n in repeated(sets()):
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["shingle", "n"])

    counts = docs.select("text").mapInArrow(run, "shingle bigint, n bigint")
    counts = staged(counts.groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts")
    total = counts.where("shingle IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    least = max(FREQUENT_DOCUMENTS, total // MOST_FREQUENT)
    found = counts.where((F.col("n") >= least) & F.col("shingle").isNotNull()).toArrow()
    discard(counts)
    return Frequent(found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy())


def _allowed(n: int, percent: int) -> int:
    """How many shingles a set of ``n`` may lack in a similar one."""
    return n - -(-n * percent // 100)


def _differing(n: int, m: int, percent: int) -> int:
    """Shingles in one alone of two similar sets of ``n`` and ``m``, at most."""
    return (n + m) * (100 - percent) // (100 + percent)


def index_keys(tokens: np.ndarray, frequent: Frequent, percent: int) -> np.ndarray:
    """Index keys of a set of sorted shingle hashes. Two similar sets have one in common, unless they are equal.

    Ranges of hashes are classes of shingles; what a set has in one class makes a combination. Two similar sets differ in no
    more combinations than in shingles, so their first combinations, one more than that, share one, in any order
    that depends on the combination alone. A set with too few combinations has all of them as keys, and
    its first shingles besides: another set with too few meets it there.
    """
    n = len(tokens)
    levels = frequent.levels_of(tokens)
    keys, short = [], False
    # the neighbourhoods of the sizes of two similar sets meet, so the sets share the span that has their middle
    reach = 0.5005 * math.log(100 / percent)
    low, high = (int((math.log(n) + r) // _SPAN) for r in (-reach, reach))
    for tag in range(low, high + 1):
        top = math.exp((tag + 1) * _SPAN)
        largest = min(n * 100 // percent, int(top * top / n * 1.000001) + 1)
        need = _differing(n, largest, percent) + 1
        classes = int(_SPARE_CLASSES * (100 - percent) / percent * top) + 1
        # equal ranges of hashes are the classes, so the shingles lie in their order
        dealt = ((tokens >> np.uint64(32)) * np.uint64(classes)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
        found = combine(np.add.reduceat(tokens, starts), dealt[starts], np.full(len(starts), tag + 1, np.uint64))
        if len(starts) > need:
            # one rare shingle makes a combination rare, so do many
            rarest = np.minimum.reduceat(levels, starts)
            weight = np.add.reduceat(64 - levels, starts)
            found = found[np.lexsort((-weight, rarest))[:need]]
        keys.append(found)
        short |= len(starts) < need
    if short:
        keys.append(tokens[np.argsort(levels, kind="stable")[: _allowed(n, percent) + 1]])
    return np.concatenate(keys)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Bit map of a set, as 64-bit words: bit ``i`` tells whether an odd number of shingles hash to ``i``.

    Two sets differ in at least as many shingles as their maps differ in bits. A map has 2 to 4 bits per shingle.
    """
    size = max(64, 2 << int(len(tokens)).bit_length())
    odd = (np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """A bit map of at most ``SMALL_MAP`` words, which bounds differences as well, only not as closely."""
    return bits if len(bits) <= SMALL_MAP else np.bitwise_xor.reduce(bits.reshape(-1, SMALL_MAP), axis=0)


def _fingerprints(docs: DataFrame, words: int, percent: int, carry: Sequence[str]) -> DataFrame:
    """doc_id, ``carry``, n, identity of the set (128 bits; null if it is empty), its index keys and bit map, row number."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    kept = ["doc_id", *carry]
    frame = docs.select("text", *kept)
    fields = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            sizes, identities, keys, bits, small = [], [], [], [], []
            for found in _sets(batch.column(0), words):
                sizes.append(len(found))
                identities.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                keys.append(index_keys(found, frequent, percent).view(np.int64) if len(found) else np.zeros(0, np.int64))
                bits.append(parity_bits(found))
                small.append(folded(bits[-1]))
            columns = [pa.array(sizes, pa.int64()), pa.array(identities, pa.binary())]
            columns += [rows_of_lists(lists, pa.int64()) for lists in (keys, bits, small)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*kept, *(c.split()[0] for c in own)])

    own = ["n bigint", "identity binary", "keys array<bigint>", "bits array<bigint>", "small array<bigint>"]
    found = frame.mapInArrow(run, ", ".join([fields, *own]))
    return staged(found.withColumn("row", F.monotonically_increasing_id()), "fingerprints")


def _token_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(node, tokens) of the nodes in ``pairs``: texts are read again for these only."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = staged_ids(nodes.join(needed, "node").select("node", "rep", "identity"), "wanted")
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task
        for batch in batches:
            nodes, chosen = [], []
            rows = zip(_sets(batch.column(0), words), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for found, node, identity in rows:
                # not for a repeated row, nor for another text under the same doc_id
                if node not in seen and hashlib.blake2b(found.tobytes(), digest_size=16).digest() == identity:
                    seen.add(node)
                    nodes.append(node)
                    chosen.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), rows_of_lists(chosen, pa.int64())], ["node", "tokens"])

    found = texts.select("text", "node", "identity").mapInArrow(run, "node bigint, tokens array<bigint>")
    sets = staged(found, "token-sets")
    discard(wanted)
    return sets


def _most_differing(n: Column, m: Column, percent: int) -> Column:
    """Shingles in one alone of two similar sets of these sizes, at most."""
    return n + m - 2 * F.ceil((n + m) * percent / F.lit(100 + percent) - F.lit(1e-9))


def _differing_bits(x: Column, y: Column) -> Column:
    """Bits in which two maps differ; the larger one is folded to the size of the other."""

    def folded(a: Column, b: Column) -> Column:
        half = F.size(b)
        return F.when(
            F.size(a) > half, F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        ).otherwise(a)

    unlike = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(unlike, F.lit(0), lambda total, n: total + n)


def _close(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _maybe_similar(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b), each once, but for those that sizes or bit maps rule out: the small maps first, as they
    are what most pairs are joined with. Few pairs are broadcast, so that the maps of all nodes stay where they are."""
    left = pairs.distinct()
    for bits in ("small", "bits"):
        few = staged_ids(left, "pairs-to-compare")
        first = maps.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col(bits).alias("x"))
        second = maps.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col(bits).alias("y"))
        both = few.join(first, "a").join(second, "b")
        most = _most_differing(F.col("an"), F.col("bn"), percent)
        both = both.where(_close(F.col("an"), F.col("bn"), percent))
        left = staged(both.where(_differing_bits(F.col("x"), F.col("y")) <= most).select("a", "b"), "pairs")
        discard(few)
    return left


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose sets are similar, compared shingle by shingle."""
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("s"))
    second = sets.select(F.col("node").alias("b"), F.col("tokens").alias("t"))
    # by ``a`` first: leaders repeat there, and a pair alone is small
    both = pairs.join(first, "a").join(second, "b")
    shared = F.size(F.array_intersect("s", "t"))
    union = F.size("s") + F.size("t") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) that lie in two components of ``found``."""
    first = found.select(F.col("node").alias("a"), F.col("component").alias("ac"))
    second = found.select(F.col("node").alias("b"), F.col("component").alias("bc"))
    placed = pairs.join(first, "a", "left").join(second, "b", "left")
    return placed.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")


def _with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``found`` after more ``links`` (a, b), both of which are deleted."""
    merged = staged(components(found.toDF("a", "b").union(links)), "components")
    discard(found, links)
    return merged


def _without_twins(members: DataFrame) -> DataFrame:
    """Of keys with the same members one each; the members of near copies share many keys. Sets of members are
    compared by size, ends and 128 bits of a hash."""
    same = [F.min("node"), F.max("node"), F.count("*")]
    same += [F.expr(f"bit_xor(xxhash64(node, {seed}))") for seed in (1, 2)]
    names = ["lo", "hi", "size", "x", "y"]
    lists = members.groupBy("key").agg(*[c.alias(name) for c, name in zip(same, names)])
    return members.join(lists.groupBy(*names).agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of keys that have nodes of several components: key, node, n, component, the key's ``main``
    component, that of most of its members, and how many pairs ``_cross_pairs`` looks at for the key."""
    placed = members.select("key", "node", "n").join(found, "node", "left").select(
        "key", "node", "n", F.coalesce("component", "node").alias("component")
    )
    placed = staged(placed, "members-placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("members"))
    keys = parts.groupBy("key").agg(
        F.sum("members").alias("all"), F.max(F.struct("members", "component")).alias("most"), F.count("*").alias("parts")
    )
    work = (F.col("all") - F.col("most.members")) * F.col("all")
    keys = keys.where("parts > 1").select("key", F.col("most.component").alias("main"), work.alias("work"))
    unsettled = staged(placed.join(keys, "key"), "members-unsettled")
    discard(placed)
    return unsettled


def _star_pairs(unsettled: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of one member of each key, another in each turn, with the key's members of other components."""
    drawn = F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)).alias("draw"), "node", "n", "component"))
    leaders = unsettled.groupBy("key").agg(drawn.alias("o"))
    leaders = leaders.select("key", F.col("o.node").alias("o"), F.col("o.n").alias("on"), F.col("o.component").alias("oc"))
    met = unsettled.join(leaders, "key").where(
        (F.col("oc") != F.col("component")) & _close(F.col("n"), F.col("on"), percent)
    )
    return met.select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b"))


def _cross_pairs(unsettled: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of a key that lie in two components, but for those that sizes or small bit maps
    rule out: every node outside the main component meets all others. The maps are compared within the join,
    as many keys may bring the same two nodes together."""
    mapped = unsettled.join(maps.select("node", "small"), "node")
    others = mapped.where("component <> main").select(
        "key", F.col("node").alias("o"), F.col("n").alias("on"), F.col("component").alias("oc"), F.col("small").alias("other")
    )
    # two outsiders meet once
    once = (F.col("component") == F.col("main")) | (F.col("o") < F.col("node"))
    apart = (F.col("oc") != F.col("component")) & _close(F.col("n"), F.col("on"), percent)
    alike = _differing_bits(F.col("small"), F.col("other")) <= _most_differing(F.col("n"), F.col("on"), percent)
    met = others.join(mapped, "key").where(once & apart & alike)
    return met.select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b"))


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``carry``, n_shingles, component_id, group.

    Words are runs of other characters than ASCII white space, A-Z in lower case. The set of a document
    has its distinct runs of ``words`` words; with fewer words the whole sequence. Two documents are linked if
    ``100 * intersection >= percent * union``. ``component_id`` is the smallest doc_id reachable by links, ``group`` an
    arbitrary number of the component.

    Null text, or none but white space: an empty set, linked with nothing (group is null, component_id the
    own doc_id). Repeated rows are linked. Null doc_id: takes part, but never names a component that has
    a doc_id. No cap on candidates. Empty table: no rows. Columns beside doc_id, text and ``carry`` are ignored.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must be 60 to 100")
    prints = _fingerprints(docs, words, percent, carry)
    # documents with equal sets are one node, named by the row of the least doc_id
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    nodes = prints.where("n > 0").groupBy("identity").agg(F.min(order).alias("first"))
    nodes = staged(
        nodes.select("identity", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("node")), "nodes"
    )
    sizes = prints.select(F.col("row").alias("node"), "n")
    posted = prints.select(F.col("row").alias("node"), "keys").join(nodes.select("node"), "node")
    # dealt by key once, for the ends of its members and for the join
    posted = posted.select(F.explode("keys").alias("key"), "node").repartition("key")
    leaders = posted.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
    every = staged(posted.join(leaders.where("leader < last").select("key", "leader"), "key"), "members")
    del posted, leaders  # what holds their shuffles
    members = staged(_without_twins(every).join(sizes, "node"), "members")
    discard(every)
    drop_shuffles(docs.sparkSession)
    involved = members.select("node").distinct()
    maps = prints.select(F.col("row").alias("node"), "n", "bits", "small").join(involved, "node", "left_semi")
    maps = staged(maps, "bit-maps")

    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = _maybe_similar(pairs, maps, percent)
    sets = _token_sets(docs, nodes, pairs, words)
    # one pair of each node first; others only where that leaves two components
    some = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = staged(_similar(some, sets, percent), "links")
    found = staged(components(links), "components")
    more = staged(_similar(_across(pairs.exceptAll(some), found), sets, percent), "links")
    found = _with_links(found, more)
    discard(sets, pairs, links)
    drop_shuffles(docs.sparkSession)
    # further leaders, as long as they find links in plenty and comparing everyone with everyone outside the main
    # components is more than a few times the members; then that
    idle = False
    for turn in range(STAR_TURNS + 1):
        # keys whose members are of one component are done with
        unsettled = _unsettled(members, found)
        discard(members)
        members = unsettled
        work, size = unsettled.groupBy("key").agg(F.first("work").alias("work"), F.count("*").alias("size")).agg(
            F.coalesce(F.sum("work"), F.lit(0)), F.count("*") + F.coalesce(F.sum("size"), F.lit(0))
        ).first()
        last = turn == STAR_TURNS or work <= 4 * size or idle
        drawn = _cross_pairs(unsettled, maps, percent) if last else _star_pairs(unsettled, percent, turn)
        rest = _maybe_similar(drawn, maps, percent)
        sets = _token_sets(docs, nodes, rest, words)
        more = staged(_similar(rest, sets, percent), "links")
        idle = 100 * more.count() < found.count()
        found = _with_links(found, more)
        discard(sets, rest)
        if last:
            break
    discard(members, maps)

    # the smallest doc_id of each component, by identity of the sets
    placed = nodes.join(found, "node", "left").select(
        "identity", "rep", F.coalesce("component", "node").alias("group")
    )
    named = placed.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes = staged(placed.select("identity", "group").join(named, "group"), "classes")
    discard(nodes, found)
    return prints.join(classes, "identity", "left").select(
        "doc_id",
        *carry,
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "group",
    )
