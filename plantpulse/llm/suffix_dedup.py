"""Repeated passages by sparse suffix arrays.

Of all suffixes of the corpus only those are kept that start at a minimiser: the place of the least hash
among ``WINDOW`` neighbouring runs of words. Which places these are follows from the words alone, so two copies of
a passage keep the same suffixes. The kept suffixes are sorted by their words, over all tasks. Neighbours tell how far a match goes to
the right, a second order by the words before them how far to the left; matches of ``PASSAGE`` words are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.hashing import FOLD, SPACE, Words, rows_of_lists, runs, slices
from plantpulse.llm.staging import staged

#: Words of the shortest passage that counts as repeated.
PASSAGE = 50
#: Words whose hash is compared for minimisers, and places among which one is kept.
RUN, WINDOW = 8, 32
#: Words that suffixes must share before they are compared: what a passage has right of its first minimiser.
BLOCK = PASSAGE - WINDOW + 1
#: Suffixes whose matches are worked out at once, at least; a block is never parted.
CHUNK = 5000

MATCH = "node bigint, start bigint, end bigint, removable boolean"


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """Minimiser of each place's ``WINDOW`` runs. It depends on the ``PASSAGE`` words from the place on alone."""
    many = len(hashes) - RUN + 1
    if len(hashes) < PASSAGE:
        return np.zeros(0, np.int64)
    least = runs(hashes, np.arange(many), RUN)
    views = np.lib.stride_tricks.sliding_window_view(least, WINDOW)
    return views.argmin(axis=1) + np.arange(len(views))


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Kept places of a text, from the hashes of its words. A passage of ``PASSAGE`` words has one among its first ``WINDOW``."""
    places = np.unique(_anchors(hashes))
    return places[places + BLOCK <= len(hashes)]


def _identity(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, identity of the sequence of words, places of kept suffixes and hashes of their first words."""
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "identity", "places", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, identities, places, blocks = [], [], [], []
            for _, _, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, SPACE)
                for a, b in zip(words.first, words.first[1:]):
                    hashes = words.hashes[a:b]
                    at = minimisers(hashes)
                    sizes.append(len(hashes))
                    identities.append(_identity(hashes))
                    places.append(at)
                    blocks.append(runs(hashes, at, BLOCK).view(np.int64))
            columns = [
                pa.array(sizes, pa.int64()),
                pa.array(identities, pa.binary()),
                rows_of_lists(places, pa.int32()),
                rows_of_lists(blocks, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    fields = f"doc_id {key}, n_words bigint, identity binary, places array<int>, blocks array<bigint>"
    found = docs.select("doc_id", "text").mapInArrow(run, fields)
    return staged(found.withColumn("row", F.monotonically_increasing_id()), "suffix-places")


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words right of every suffix of ``wanted`` (rep, identity, node, suffixes), and left of it from right to left, read from the texts again.

    They reach as far as the windows of ``PASSAGE`` words that have the suffix as their minimiser; equal windows have equal minimisers,
    so every window is looked at once. Every word ends in a space, so that texts with the same first words are neighbours in the order of the strings.
    """
    fields = "block bigint, node bigint, doc_id {}, place int, left string, right string"
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "node", "doc_id", "place", "left", "right"]
    texts = docs.select(F.col("doc_id").alias("rep_id"), "text").join(wanted, F.col("rep_id").eqNullSafe(F.col("rep")))

    def of_slice(seen: set, batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        words, lower = Words(data, offsets, SPACE), FOLD[data].tobytes()
        rows, where = [], []
        for d in range(i, j):
            a, b = words.first[d - i], words.first[d - i + 1]
            node = batch.column(3)[d].as_py()
            if node in seen or _identity(words.hashes[a:b]) != batch.column(2)[d].as_py():
                continue  # a repeated row, or another text under the same doc_id
            seen.add(node)
            own, anchors = lower[offsets[d - i] : offsets[d - i + 1]].split(), _anchors(words.hashes[a:b])[: b - a - PASSAGE + 1]
            for s in batch.column(4)[d].as_py():
                p = s["place"]
                low, high = np.searchsorted(anchors, [p, p + 1])
                if low == high:
                    continue
                left, right = own[low:p][::-1], own[p : high - 1 + PASSAGE]
                rows.append((s["block"], p, *(b"".join(w + b" " for w in side).decode() for side in (left, right))))
                where.append(d)
        block, place, left, right = zip(*rows) if rows else ((),) * 4
        of = pa.array(where, pa.int64())
        columns = [
            pa.array(block, pa.int64()),
            batch.column(3).take(of),
            batch.column(0).take(of),
            pa.array(place, pa.int32()),
            pa.array(left, pa.string()),
            pa.array(right, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task
        for batch in batches:
            for part in slices(batch.column(1)):
                yield of_slice(seen, batch, *part)

    return texts.select("rep_id", "text", "identity", "node", "suffixes").mapInArrow(run, fields.format(key))


def _common(a: list[str], b: list[str]) -> int:
    if a == b:
        return len(a)
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _neighbours(blocks: list, sides: list[list[str]]) -> np.ndarray:
    """Words that each row shares with the one before it; -1 where a block begins, and once more after the last row."""
    shared = np.full(len(blocks) + 1, -1, np.int64)
    for i in range(1, len(blocks)):
        if blocks[i] == blocks[i - 1]:
            shared[i] = _common(sides[i - 1], sides[i])
    return shared


def _intervals(shared: np.ndarray, size: int) -> np.ndarray:
    """First row of the rows in order that share ``size`` words with each row."""
    return np.maximum.accumulate(np.where(shared[:-1] < size, np.arange(len(shared) - 1), 0))


def _resolve(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """node, start, end, removable of the repeated passages among suffixes (block, node, doc_id, place, left, right) in order.

    A window of ``PASSAGE`` words with ``k`` words left of the suffix is common to the rows that share ``PASSAGE - k`` words in the order
    to the right and ``k`` in the order to the left: an interval in each. Suffixes whose neighbours in either order share too few words have
    no such window.
    """
    blocks, nodes, doc_ids, places, lefts, rights = zip(*group)
    n, node, place = len(group), np.array(nodes, np.int64), np.array(places, np.int64)
    ranks = {of: r for r, (*_, of) in enumerate(sorted({(d is None, d, of) for d, of in zip(doc_ids, nodes)}))}
    rank = np.fromiter((ranks[of] for of in nodes), np.int64, n)
    to_right = _neighbours(blocks, rights)
    reach_right = np.maximum(to_right[:-1], to_right[1:])
    by_left = sorted(range(n), key=lambda i: (blocks[i], lefts[i]))
    to_left = _neighbours([blocks[i] for i in by_left], [lefts[i] for i in by_left])
    reach_left = np.zeros(n, np.int64)
    reach_left[by_left] = np.maximum(to_left[:-1], to_left[1:])
    # by row and words to the left: 0 no, 1 repeated and kept here, 2 repeated and removable
    marks = np.zeros((n, WINDOW + 2), np.int8)
    left_interval = np.zeros(n, np.int64)
    for k in range(WINDOW):
        rows = np.flatnonzero((reach_right >= PASSAGE - k) & (reach_left >= k))
        if len(rows) < 2:
            continue
        left_interval[by_left] = _intervals(to_left, k)
        window = _intervals(to_right, PASSAGE - k)[rows] * n + left_interval[rows]
        _, window = np.unique(window, return_inverse=True)
        least, most = np.full(len(rows), n, np.int64), np.zeros(len(rows), np.int64)
        np.minimum.at(least, window, rank[rows])
        np.maximum.at(most, window, rank[rows])
        least, most = least[window], most[window]
        marks[rows, k + 1] = (least < most) * (1 + (rank[rows] > least))
    # runs of equal marks along a row are one span
    change = np.diff(marks, axis=1) != 0
    row, first = np.nonzero(change[:, :-1] & (marks[:, 1:-1] > 0))
    _, last = np.nonzero(change[:, 1:] & (marks[:, 1:-1] > 0))
    return node[row], place[row] - last, place[row] - first + PASSAGE, marks[row, first + 1] == 2


def compare(group: list[tuple]) -> list[tuple[int, int, int, bool]]:
    """(node, start, end, removable) of the repeated passages among suffixes of one block.

    ``group`` has (node, doc_id, place, left words, right words). Windows of ``PASSAGE`` words that several nodes have are repeated, and
    removable in all but the least doc_id. Consecutive ones are joined.
    """
    rows = sorted(((0, n, d, p, left[::-1], right) for n, d, p, left, right in group), key=lambda g: g[5])
    return list(zip(*(c.tolist() for c in _resolve(rows))))


def _digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def _open_windows(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(node, start, end, removable, window, doc_id) for suffixes in order, of a block that other tasks may have a part of.

    Of suffixes with the same words on both sides the first has the least document: those of other documents are settled by it,
    and only it and one more go on as windows that may be repeated.
    """
    rows = iter(rows)
    row, before, after = next(rows), PASSAGE, next(rows, None)
    same, first, more = None, None, False
    while row:
        _, node, doc_id, place, left, right = row
        shared = _common(right, after[5]) if after else PASSAGE
        if same != (left, right):
            same, first, more = (left, right), node, False
        if node != first and more:
            yield node, place - len(left), place + len(right), True, None, None
        else:
            more |= node != first
            for k in range(max(0, PASSAGE - min(len(right), max(before, shared))), len(left) + 1):
                start = place - k
                yield node, start, start + PASSAGE, None, _digest(left[:k][::-1] + right[: PASSAGE - k]), doc_id
        row, before, after = after, shared, next(rows, None)


def _emitted(key: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (node, start, end, removable, window, doc_id); window is null where the match is settled."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), key)
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    names = ["node", "start", "end", "removable", "window", "doc_id"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for block, node, doc_id, place, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            yield block, node, doc_id, place, left.split(" ")[:-1], right.split(" ")[:-1]


def _matches(contexts: DataFrame) -> DataFrame:
    """``MATCH``, window, doc_id: settled matches of blocks that one task has whole, windows of the others.

    The order is cut into ranges of about the same size, so a block with many suffixes is dealt over tasks. A task's first and last block
    may go on in others. The task streams these and holds ``CHUNK`` suffixes, or one whole block, of the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return
        key, rows = head.schema.field("doc_id").type, _suffixes(chain([head], batches))
        row = next(rows, None)
        if row is None:
            return
        first, beyond = row[0], []

        def of_first() -> Iterator[tuple]:
            yield row
            for r in rows:
                if r[0] != first:
                    beyond.append(r)
                    return
                yield r

        out = []
        for found in _open_windows(of_first()):
            out.append(found)
            if len(out) >= 10_000:
                yield _emitted(key, out)
                out = []
        whole, current = [], beyond
        for r in rows:
            if r[0] != current[-1][0]:
                whole += current if len(current) > 1 else []
                current = []
                if len(whole) >= CHUNK:
                    yield _emitted(key, _settled(whole))
                    whole = []
            current.append(r)
        out += _settled(whole)
        if current:
            out += _open_windows(current)
        yield _emitted(key, out)

    order = [*(F.col(c) for c in ("block", "right", "left")), F.col("doc_id").isNull(), *(F.col(c) for c in ("doc_id", "node", "place"))]
    ordered = contexts.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = contexts.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"{MATCH}, window binary, doc_id {kind}")


def _settled(whole: list[tuple]) -> list[tuple]:
    found = zip(*(c.tolist() for c in _resolve(whole))) if whole else ()
    return [(*f, None, None) for f in found]


def _window_matches(windows: DataFrame) -> DataFrame:
    """``MATCH`` of windows (window, node, doc_id, start) from several tasks.

    Sorted by window and document, equal windows are neighbours and the first of them stays. Ranges of the order deal a frequent window
    over tasks; what a task has of its first and last window is settled by the least document of these, two at most a task.
    """
    spark, kind = windows.sparkSession, windows.schema["doc_id"].dataType.simpleString()
    order = [F.col("window"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("node")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at, keeper, held, shared = None, None, None, [], False
        for batch in batches:
            key, out = batch.schema.field("doc_id").type, []
            for window, node, doc_id, start in zip(*(c.to_pylist() for c in batch.columns)):
                first = first or window
                if window == first:
                    out.append((node, start, start + PASSAGE, None, window, doc_id))
                    continue
                if window != at:
                    at, keeper, held, shared = window, node, [], False
                row = (node, start, start + PASSAGE)
                if node == keeper:
                    held.append((*row, None, window, doc_id))
                else:
                    out += [] if shared else [(*h[:3], False, None, None) for h in held]
                    shared = True
                    out.append((*row, True, None, None))
            yield _emitted(key, out)
        # the last window may go on in the next task, which then needs its keeper
        if first:
            yield _emitted(key, held)

    ordered = windows.select("window", "node", "doc_id", "start").repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ordered.mapInArrow(run, f"{MATCH}, window binary, doc_id {kind}"), "suffix-window-matches")
    left = found.where(F.col("window").isNotNull())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node"))["node"]
    ends = left.groupBy("window").agg(least.alias("keeper"), (F.min("node") < F.max("node")).alias("shared"))
    keepers = {bytes(r["window"]): r["keeper"] for r in ends.where("shared").collect()}  # two a task at most
    known = spark.sparkContext.broadcast(keepers)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            rows = [(n, s, s + PASSAGE, n != known.value[w]) for n, s, w in rows if w in known.value]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "start", "end", "removable"])

    settled = found.where(F.col("window").isNull()).select("node", "start", "end", "removable")
    return settled.unionAll(left.select("node", "start", "window").mapInArrow(settle, MATCH))


def _union(spans: Column) -> Column:
    """Spans of an array joined where they meet or overlap, in order."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        meets = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) >= s["start"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(s))
        )

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` that shares a passage of ``PASSAGE`` words or more with another document.

    Columns: doc_id, n_words, repeated_words, spans and removable: arrays of (start, end) in words, end excluded. ``removable``
    is the part of ``spans`` that an earlier document (smaller doc_id) has too, so that removing it leaves one copy.
    Words are runs of other characters than ASCII white space, A-Z in lower case. Repeats within one document do not
    count.

    Documents with the same words throughout are merged first; all but the least doc_id are removable as a whole. Else a span
    is made of windows of ``PASSAGE`` words that another document has, and the least doc_id of each window keeps it; spans
    of one document are joined.

    Null and empty texts and texts of fewer words: no row. Repeated rows are copies of each other. Null doc_ids come
    last. Empty table: no rows. Other columns are ignored.
    """
    prints = _fingerprints(docs)
    # documents with the same words are one node, named by the row of the least doc_id
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    nodes = prints.where(F.col("n_words") >= PASSAGE).groupBy("identity")
    nodes = nodes.agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    nodes = nodes.select("identity", "copies", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("node"))
    nodes = staged(nodes, "suffix-nodes")
    posted = (
        prints.select(F.col("row").alias("node"), "places", "blocks")
        .join(nodes.select("node"), "node")
        .select("node", F.explode(F.arrays_zip("places", "blocks")).alias("s"))
        .select("node", F.col("s.places").alias("place"), F.col("s.blocks").alias("block"))
    )
    posted = staged(posted, "suffixes")
    repeated = posted.groupBy("block").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    repeated = staged(repeated.where("lo < hi").select("block"), "suffix-blocks")
    suffixes = posted.join(repeated, "block").select("node", F.struct("block", "place").alias("s"))
    per_node = suffixes.groupBy("node").agg(F.collect_list("s").alias("suffixes"))  # a document's own
    wanted = nodes.select("node", "rep", "identity").join(per_node, "node")
    # staged: ranges of the order are drawn from it before it is sorted
    found = staged(_matches(staged(_contexts(docs, wanted), "suffix-contexts")), "suffix-matches")
    windows = found.where(F.col("window").isNotNull())
    found = found.where(F.col("window").isNull()).select("node", "start", "end", "removable").unionAll(_window_matches(windows))
    span = F.struct("start", "end")
    spans = found.groupBy("node").agg(
        _union(F.collect_list(span)).alias("spans"),
        _union(F.collect_list(F.when(F.col("removable"), span))).alias("removable"),
    )
    classes = nodes.join(spans, "node", "left").where((F.col("copies") > 1) | F.col("spans").isNotNull())
    classes = staged(classes.select("identity", "node", "copies", "spans", "removable"), "suffix-classes")
    all_words = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
    first = F.col("row") == F.col("node")
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (
        prints.where(F.col("n_words") >= PASSAGE)
        .select("doc_id", "n_words", "identity", "row")
        .join(classes, "identity")
        .withColumn("removable", F.when((F.col("copies") > 1) & ~first, all_words).otherwise(F.coalesce("removable", none)))
        .withColumn("spans", F.when(F.col("copies") > 1, all_words).otherwise(F.col("spans")))
        .select("doc_id", "n_words", total.alias("repeated_words"), "spans", "removable")
    )
