"""Toxicity scores of a factorization machine over hashed terms.

Besides a weight of its own every term has a vector; the product of two terms' vectors is
the weight of their meeting in a text. So an insult together with a group counts more than the two
alone, which additive weights cannot say. Terms are words and beginnings of words, as inflected
and compound insults share these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.hashing import NOT_WORD, Words, mix, rows_of_lists, slices

#: Hash buckets of terms, length of a term's vector, lengths in bytes of beginnings of words.
BUCKETS = 1 << 18
FACTORS = 8
BEGINNINGS = (4, 5)
#: Most training texts, toxic and others.
TOXIC_TEXTS, OTHER_TEXTS = 4000, 12_000
#: A term gets weights if so many training texts have it and its texts' labels differ so much from
#: those of all texts, as a chi-squared statistic, or if it tells something together with another term.
LEAST_TEXTS = 3
LEAST_CHI_SQUARED = 20.0


def terms(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the sorted distinct buckets of its terms."""
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for _, _, data, offsets in slices(column):
        words = Words(data, offsets, NOT_WORD)
        of_text = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
        found, owners = [words.hashes], [of_text]
        for n in BEGINNINGS:
            longer = np.flatnonzero(words.ends - words.starts > n)
            starts = words.starts[longer]
            found.append(mix(words.span(starts, starts + n) + np.uint64(n)))
            owners.append(of_text[longer])
        buckets = (np.concatenate(found) >> shift).astype(np.int64)
        both = np.unique(np.concatenate(owners) * BUCKETS + buckets)
        cuts = np.searchsorted(both, np.arange(len(offsets)) * BUCKETS)
        buckets = both % BUCKETS
        for d in range(len(offsets) - 1):
            yield buckets[cuts[d] : cuts[d + 1]]


@dataclass(frozen=True)
class Machine:
    """``bias``, ``weights`` and ``vectors`` by bucket. Terms that tell nothing weigh nothing."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        """Probability that a text with these terms is toxic."""
        v = self.vectors[found]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        z = self.bias + float(self.weights[found].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def telling(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets of the terms that say something about the label."""
    sizes = [len(t) for t in texts]
    found = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    seen = np.bincount(found, minlength=BUCKETS)
    toxic = np.bincount(found, np.repeat(labels, sizes), BUCKETS)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.001, 0.999)
    chi_squared = (toxic - seen * share) ** 2 / np.maximum(seen * share * (1 - share), 1e-9)
    return np.flatnonzero((seen >= LEAST_TEXTS) & (chi_squared >= LEAST_CHI_SQUARED))


def meeting(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Buckets of the terms that say something about the label together with another one, beyond what each says alone.

    Of each two terms the toxic among their common texts are held against the number that adding up the terms' own
    log-odds makes likely, by a likelihood ratio. All pairs are tried: the ratio must be ``LEAST_CHI_SQUARED`` and twice the
    logarithm of their number, which chance exceeds next to never. Terms too rare to reach this are left out before.
    """
    lowest = 0.01  # of expected shares
    found = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    seen = np.bincount(found, minlength=BUCKETS)
    many = int((seen >= LEAST_TEXTS).sum())
    limit = LEAST_CHI_SQUARED + 2 * np.log(max(1, many * (many - 1) // 2))
    least = max(LEAST_TEXTS, int(np.ceil(limit / (-2 * np.log(lowest)))))
    places = np.flatnonzero(seen >= least)
    to_place = np.full(BUCKETS, -1)
    to_place[places] = np.arange(len(places))
    rows = [p[p >= 0] for p in (to_place[t] for t in texts)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    where = np.argsort(flat, kind="stable")  # places in ``flat`` by term
    ends = np.cumsum([len(r) for r in rows])
    cuts = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(places)))])
    toxic = np.bincount(flat, labels[owner], len(places))
    share = np.clip(labels.mean() if len(labels) else 0.5, lowest, 1 - lowest)
    alone = (toxic + share) / (np.diff(cuts) + 1)
    odds = np.log(alone / (1 - alone))
    base = np.log(share / (1 - share))
    chosen = np.zeros(len(places), bool)
    for i in range(len(places)):
        own = where[cuts[i] : cuts[i + 1]]
        n = x = np.zeros(len(places), np.int64)
        for label in (0.0, 1.0):
            held = own[labels[owner[own]] == label]
            # terms are in order, so those after this one are the rest of the text
            part = [flat[a:b] for a, b in zip((held + 1).tolist(), ends[owner[held]].tolist())]
            if part:
                counts = np.bincount(np.concatenate(part), minlength=len(places))
                n, x = n + counts, counts if label else x
        others = np.flatnonzero(n >= least)
        n, x = n[others], x[others]
        p = np.clip(1 / (1 + np.exp(base - odds[i] - odds[others])), lowest, 1 - lowest)
        ratio = 2 * (x * np.log(np.maximum(x, 1) / (n * p)) + (n - x) * np.log(np.maximum(n - x, 1) / (n * (1 - p))))
        strong = others[ratio >= limit]
        chosen[strong] = True
        chosen[i] |= len(strong) > 0
    return places[chosen]


def fit(texts: list[np.ndarray], labels: np.ndarray, steps: int = 1500, batch: int = 256) -> Machine:
    """``steps`` of adaptive gradient descent on the log loss, with decay, over the terms that tell something alone or with another."""
    places = np.union1d(telling(texts, labels), meeting(texts, labels))  # training works on these alone
    to_place = np.full(BUCKETS, -1)
    to_place[places] = np.arange(len(places))
    rows = [p[p >= 0] for p in (to_place[t] for t in texts)]
    random = np.random.default_rng(7)
    size = len(places)
    w, v = np.zeros(size), random.normal(0, 0.01, (size, FACTORS))
    gw, gv = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    bias = float(np.log(share / (1 - share)))
    for _ in range(-(-steps * batch // max(1, len(rows)))):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in part])
            if not lengths.sum():
                continue
            index = np.concatenate([rows[i] for i in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            vi = v[index]
            sums = np.stack([np.bincount(owner, vi[:, f], len(part)) for f in range(FACTORS)], 1)
            squares = np.bincount(owner, (vi**2).sum(1), len(part))
            z = bias + np.bincount(owner, w[index], len(part)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            bias -= 0.1 * float(error.mean())
            pull = error[owner] / len(part)
            step = np.bincount(index, pull, size)
            used = np.flatnonzero(np.bincount(index, minlength=size))
            step = step[used] + 1e-6 * w[used]
            gw[used] += step**2
            w[used] -= 0.1 * step / np.sqrt(gw[used])
            slope = pull[:, None] * (sums[owner] - vi)
            step = np.stack([np.bincount(index, slope[:, f], size)[used] for f in range(FACTORS)], 1) + 1e-5 * v[used]
            gv[used] += step**2
            v[used] -= 0.02 * step / np.sqrt(gv[used])
    weights, vectors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    weights[places], vectors[places] = w, v
    return Machine(bias, weights, vectors)


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_TEXTS, other: int = OTHER_TEXTS) -> Machine:
    """Machine learnt from texts of ``docs`` whose doc_id has a non-null ``toxic`` in ``labels``.

    Pseudo-random samples of about ``toxic`` and ``other`` texts are taken, never more than twice as many in
    all; terms are found by the executors. Several labels of one doc_id count as their
    maximum. Without labelled texts every score is 1/2.
    """
    most = 2 * (toxic + other)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = 1 << 30
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    limit = {y: int(min(1.0, n / counts.get(y, 1)) * parts) for y, n in ((True, toxic), (False, other))}
    sample = known.where(chance < F.when(F.col("toxic"), limit[True]).otherwise(limit[False]))
    # the sample has at most so many rows, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.limit(most)), "doc_id").select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(terms(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows_of_lists(found, pa.int32())], ["toxic", "terms"])

    # a doc_id that many rows share must not fill the driver
    found = rows.limit(most).mapInArrow(run, "toxic boolean, terms array<int>").toArrow()
    texts = [np.array(t, np.int64) for t in found["terms"].to_pylist()]
    if not texts:
        return Machine(0.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    return fit(texts, np.array(found["toxic"].to_pylist(), float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row: the probability that its whole text is toxic.

    Null and empty texts have no terms: their score is that of the bias alone. One row per row, repeated
    rows and null doc_ids too. Other columns are ignored. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS * (FACTORS + 1) numbers
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            found = pa.array([machine.score(t) for t in terms(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, score double")
