"""Hard negatives by exact integer scores: matrix products in residue numbers.

Scores are inner products of integer vectors. Both matrices are reduced modulo several small primes, multiplied in
float32 in slices so narrow that every sum is exact, and the scores are rebuilt by Chinese remaindering in mixed radix
with digits around zero, which gives signed results at once. As many primes are taken as the norms of the two blocks
call for. Anchors are packed into blocks that are joined with blocks of all rows; a task keeps the best few per anchor, and
a window over these partial lists selects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged

#: Vectors of an anchor block and of a row block, and components of either at most.
ANCHOR_BLOCK, ROW_BLOCK, BLOCK_COMPONENTS = 1024, 2048, 1 << 20
#: Packed anchors are broadcast up to this many bytes, counted before; more are joined by shuffle in this many slices.
BROADCAST_BYTES, SLICES = 32 << 20, 16
#: Partial lists a task holds, in entries; beyond that it hands them out early.
HELD_ENTRIES = 2_000_000

NOTHING = np.iinfo(np.int64).min
PRIMES = [p for p in range(255, 2, -2) if all(p % q for q in range(3, math.isqrt(p) + 1, 2))]

_BLOCK = "block int, n int, width int, kind string, ids binary, named binary, labels binary, components binary"
_ANCHORS = _BLOCK + ", numbers binary, bounds binary"


def _reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Float32 integers below 2**20 in size, modulo ``p`` around zero; exact, as x/p stays clear of halves by 1/2p."""
    return x - np.float32(p) * np.rint(x / np.float32(p))


def _residues(x: np.ndarray, p: int) -> np.ndarray:
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _norm(x: np.ndarray) -> float:
    return math.sqrt(float(np.max(np.sum(np.square(x.astype(np.float64)), axis=1), initial=0.0)))


def residue_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of integer matrices, exact. A product that might not fit into 64 bits raises OverflowError."""
    bound = math.ceil(_norm(left) * _norm(right) * (1 + 1e-9)) + 1
    if bound >= 1 << 63:
        raise OverflowError("scores need more than 64 bits")
    primes, reach = [], 1
    for p in PRIMES:
        if reach > 2 * bound:
            break
        primes.append(p)
        reach *= p
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        a, b = _residues(left, p), _residues(right, p)
        step = (1 << 20) // (p // 2) ** 2
        rest = np.zeros((len(left), len(right)), np.float32)
        for i in range(0, a.shape[1], step):
            rest = _reduced(rest + _reduced(a[:, i : i + step] @ b[:, i : i + step].T, p), p)
        for q, digit in zip(primes[:k], digits):
            inverse = pow(q, -1, p)
            rest = _reduced((rest - digit) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(rest)
    scores = digits[-1].astype(np.int64)
    for p, digit in zip(primes[-2::-1], digits[-2::-1]):
        scores *= p
        scores += digit.astype(np.int64)
    return scores


def _vectors(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and the integer components of these; shorter vectors are padded with zeros."""
    lists = batch.column("vector")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    whole = bad[ends] == bad[ends - sizes]
    good = whole & batch.column("label").is_valid().to_numpy(False) & lists.is_valid().to_numpy(False)
    with np.errstate(invalid="ignore"):
        scaled = np.floor(scale * flat)
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
    row = np.repeat(np.arange(len(sizes)), sizes)
    matrix[row, np.arange(len(flat)) - np.repeat(ends - sizes, sizes)] = scaled
    matrix = matrix[good]
    if np.abs(matrix).max(initial=0.0) >= 1 << 53:
        raise OverflowError("components need more than 53 bits")
    return good, matrix.astype(np.int64)


def _packed(block: int, ids: np.ndarray, named: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> dict:
    """One row of ``_BLOCK``, vectors in order of their ids, those without one last."""
    order = np.lexsort((ids, ~named))
    matrix = matrix[order]
    top = int(np.abs(matrix).max(initial=0))
    kind = next(k for k in ("<i2", "<i4", "<i8") if top <= np.iinfo(k).max)
    return {
        "block": block, "n": len(ids), "width": matrix.shape[1], "kind": kind,
        "ids": ids[order].astype("<i8").tobytes(), "named": named[order].astype("u1").tobytes(),
        "labels": labels[order].astype("<i8").tobytes(), "components": matrix.astype(kind).tobytes(),
    }


class _Block:
    """An unpacked row of ``_BLOCK``."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.named = np.frombuffer(row["named"], "u1").astype(bool)
        self.labels = np.frombuffer(row["labels"], "<i8")
        self.matrix = np.frombuffer(row["components"], row["kind"]).reshape(row["n"], row["width"]).astype(np.int64)

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.matrix, ((0, 0), (0, max(0, width - self.matrix.shape[1]))))


def _scores(left: _Block, rows: np.ndarray, right: _Block, columns: np.ndarray) -> np.ndarray:
    width = max(left.matrix.shape[1], right.matrix.shape[1])
    return residue_product(left.widened(width)[rows], right.widened(width)[columns])


def _ids_and_labels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = batch.column("id")
    return (
        pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64),
        ids.is_valid().to_numpy(False),
        pc.fill_null(batch.column("label"), 0).to_numpy(zero_copy_only=False).astype(np.int64),
    )


def _row_blocks(scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            ids, named, labels = _ids_and_labels(batch)
            good, matrix = _vectors(batch, scale)
            ids, named, labels = ids[good], named[good], labels[good]
            step = max(1, min(ROW_BLOCK, BLOCK_COMPONENTS // max(1, matrix.shape[1])))
            for i in range(0, len(ids), step):
                cut = slice(i, i + step)
                row = _packed(number, ids[cut], named[cut], labels[cut], matrix[cut])
                yield pa.RecordBatch.from_pylist([row], _ROW_SCHEMA)

    return pack


_ROW_SCHEMA = pa.schema(
    [("block", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string())]
    + [(c, pa.binary()) for c in ("ids", "named", "labels", "components")]
)
_ANCHOR_SCHEMA = pa.schema([*_ROW_SCHEMA, ("numbers", pa.binary()), ("bounds", pa.binary())])


def _anchor_blocks(scale: float, low: int, high: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """Packs the anchors of one block; ``bounds`` holds (least, largest) score of negatives per positive."""

    def pack(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0] if table.num_rows else None
        if batch is None:
            return _ANCHOR_SCHEMA.empty_table()
        ids, named, labels = _ids_and_labels(batch)
        good, matrix = _vectors(batch, scale)
        ids, named, labels = ids[good], named[good], labels[good]
        numbers = batch.column("number").to_numpy(zero_copy_only=False)[good]
        found = [p for p, g in zip(batch.column("positives").to_pylist(), good) if g]
        bounds = np.full((len(ids), most, 2), [np.iinfo(np.int64).max, NOTHING])
        for i, scores in enumerate(found):
            for j, score in enumerate(scores or ()):
                bounds[i, j] = -(-low * score // high), score
        row = _packed(batch.column("block")[0].as_py(), ids, named, labels, matrix)
        order = np.lexsort((ids, ~named))
        row["numbers"] = numbers[order].astype("<i8").tobytes()
        row["bounds"] = bounds[order].astype("<i8").tobytes()
        return pa.Table.from_pylist([row], _ANCHOR_SCHEMA)

    return pack


class _Best:
    """The best ``k`` (score, id) of each of ``n`` places, kept over many blocks; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores = np.full((n, k), NOTHING)
        self.ids = np.zeros((n, k), np.int64)
        self.named = np.zeros((n, k), bool)

    def add(self, places: np.ndarray, scores: np.ndarray, right: _Block, columns: np.ndarray) -> None:
        """``scores`` (places x columns; NOTHING: does not count) is used up. Columns are in order of ids."""
        some = np.flatnonzero(np.any(scores > NOTHING, axis=1))
        if not len(some):
            return
        places, scores = places[some], scores[some]
        k, rows = self.scores.shape[1], np.arange(len(some))
        found = _Best(len(some), min(k, len(columns)))
        for j in range(found.scores.shape[1]):
            at = scores.argmax(axis=1)  # the first of equals
            found.scores[:, j] = scores[rows, at]
            found.ids[:, j], found.named[:, j] = right.ids[columns[at]], right.named[columns[at]]
            scores[rows, at] = NOTHING
        both = [np.hstack([getattr(self, c)[places], getattr(found, c)]) for c in ("scores", "ids", "named")]
        order = np.lexsort((both[1], ~both[2], -both[0].clip(NOTHING + 1)), axis=1)[:, :k]
        for c, values in zip(("scores", "ids", "named"), both):
            getattr(self, c)[places] = np.take_along_axis(values, order, axis=1)


_PARTIAL = "number bigint, anchor_id bigint, place int, id bigint, score bigint"
_PARTIAL_SCHEMA = pa.schema(
    [("number", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())]
)


def _mine(positive: bool, most: int, kept: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over pairs of an anchor block (columns ``a_*``) and a row block: partial lists of positives or of negatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[_Block, np.ndarray, np.ndarray, _Best]] = {}
        places = 1 if positive else most
        for batch in batches:
            for i in range(batch.num_rows):
                pair = batch.slice(i, 1).to_pylist()[0]
                right = _Block(pair)
                if pair["a_block"] not in held:
                    left = _Block({c: pair[f"a_{c}"] for c in ("n", "width", "kind", "ids", "named", "labels", "components")})
                    numbers = np.frombuffer(pair["a_numbers"], "<i8")
                    bounds = np.frombuffer(pair["a_bounds"], "<i8").reshape(len(numbers), most, 2)
                    held[pair["a_block"]] = (left, numbers, bounds, _Best(len(numbers) * places, kept))
                left, _, bounds, best = held[pair["a_block"]]
                (_positives if positive else _negatives)(left, right, bounds, best)
            if sum(best.scores.size for *_, best in held.values()) > HELD_ENTRIES:
                yield from _handed_out(held, places)
                held = {}
        yield from _handed_out(held, places)

    return run


def _positives(left: _Block, right: _Block, bounds: np.ndarray, best: _Best) -> None:
    for label in np.intersect1d(left.labels, right.labels):
        rows, columns = np.flatnonzero(left.labels == label), np.flatnonzero(right.labels == label)
        scores = _scores(left, rows, right, columns)
        itself = (left.ids[rows][:, None] == right.ids[columns]) & right.named[columns]
        scores[itself] = NOTHING
        best.add(rows, scores, right, columns)


def _negatives(left: _Block, right: _Block, bounds: np.ndarray, best: _Best) -> None:
    rows, columns = np.flatnonzero((bounds[:, :, 0] <= bounds[:, :, 1]).any(axis=1)), np.arange(len(right.ids))
    if not len(rows):
        return
    scores = _scores(left, rows, right, columns)
    scores[left.labels[rows][:, None] == right.labels] = NOTHING
    for j in range(bounds.shape[1]):
        least, largest = bounds[rows, j, 0], bounds[rows, j, 1]
        places = rows * bounds.shape[1] + j
        # nothing below what is in the list already can enter it
        least = np.maximum(least, best.scores[places, -1])
        fits = (scores >= least[:, None]) & (scores <= largest[:, None])
        some = np.flatnonzero(fits.any(axis=1))
        best.add(places[some], np.where(fits[some], scores[some], NOTHING), right, columns)


def _handed_out(held: dict, places: int) -> Iterator[pa.RecordBatch]:
    for left, numbers, _, best in held.values():
        row, column = np.nonzero(best.scores > NOTHING)
        anchor = row // places
        ids = pa.array(best.ids[row, column], mask=~best.named[row, column])
        columns = [numbers[anchor], left.ids[anchor], (row % places).astype(np.int32), ids, best.scores[row, column]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_PARTIAL_SCHEMA)


def mine(
    vectors: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: float = 256.0,
) -> DataFrame:
    """Hard negatives for the rows of ``vectors`` (vec_id, embedding, label) that ``anchors`` (on vec_id) selects.

    An anchor's positives are the ``positives`` rows of its label with the highest scores; the negatives of a positive
    the ``negatives`` highest rows of other labels with low * positive_score <= high * negative_score <= high *
    positive_score. Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are floor(scale * x). Rows with a null label or vector, or a null or non-finite component, take no part.
    Vectors of different length are compared as if padded with zeros; an empty vector scores 0. Ties go to the smaller
    vec_id, null last. Every row counts, repeated ones too; rows with an anchor's own vec_id are not among the others.
    Null vec_id: never an anchor, else a row like others. No anchor, or an empty table: no rows. Scores beyond 64 bits
    and components beyond 53 bits raise OverflowError. Other columns are ignored.

    All rows are scored against every anchor, in blocks. Rows are not shuffled while packed anchors are below
    ``BROADCAST_BYTES``; beyond, blocks are joined by shuffle on a grid of anchor blocks and slices of rows. What is
    shuffled else are partial lists, at most ``positives * negatives`` entries an anchor and task.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").alias("vector")
    )
    known = staged(_chosen(vectors, anchors), "anchors")
    blocks = max(1, -(-known.count() // ANCHOR_BLOCK))
    known = known.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int"))
    packed_rows = rows.mapInArrow(_row_blocks(scale), _BLOCK)

    def partial(table: DataFrame, positive: bool) -> DataFrame:
        pack = _anchor_blocks(scale, low, high, positives)
        table = table.select("block", "number", "id", "label", "vector", "positives")
        packed = staged(table.groupBy("block").applyInArrow(pack, _ANCHORS), "anchor-blocks")
        pairs = _grid(packed_rows, packed, blocks)
        return pairs.mapInArrow(_mine(positive, positives, positives if positive else negatives), _PARTIAL)

    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    unknown = known.withColumn("positives", F.lit(None).cast("array<bigint>"))
    near = partial(unknown, True).withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy(*order)) - 1)
    near = staged(near.where(F.col("place") < positives), "positives")
    scores = near.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("found"))
    bounded = known.join(scores.select("number", F.col("found.score").alias("positives")), "number")
    hard = partial(bounded, False).withColumn(
        "rank", F.row_number().over(Window.partitionBy("number", "place").orderBy(*order))
    )
    hard = hard.where(F.col("rank") <= negatives).select(
        "number", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return near.join(hard, ["number", "place"]).select(
        "anchor_id",
        F.col("id").alias("positive_id"),
        "rank",
        "negative_id",
        F.col("score").alias("positive_score"),
        "negative_score",
    )


def _chosen(vectors: DataFrame, anchors: Column) -> DataFrame:
    """Anchors as (number, id, label, vector); the number tells repeated rows apart."""
    return vectors.where(anchors).select(
        F.monotonically_increasing_id().alias("number"),
        F.col("vec_id").cast("bigint").alias("id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").alias("vector"),
    )


def _grid(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Every row block beside every anchor block."""
    named = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns])
    size = anchors.agg(F.sum(sum(F.octet_length(c) for c in ("components", "ids", "labels", "bounds")))).first()[0]
    rows = rows.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(named), "a_block")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(SLICES)))
    named = named.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SLICES - 1).cast("bigint"))))
    return rows.join(named, ["a_block", "slice"])
