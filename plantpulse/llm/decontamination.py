"""Benchmark decontamination by the q-gram lemma and banded alignment.

If a passage of a text is a benchmark item but for ``k`` edits, it shares at least
``length + 1 - q * (k + 1)`` q-grams with the item, and the diagonals (place in the text minus place in
the item) of these lie within ``k`` of each other. So shared q-grams are counted in overlapping bands of diagonals; bands that
reach the bound are verified by alignment within the band.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plantpulse.llm.hashing import mix

#: Length of q-grams, and one edit allowed per so many characters of an item.
Q = 12
CHARACTERS_PER_EDIT = 20
#: Benchmark items are searched for in blocks of about so many characters; a block is broadcast.
BLOCK_CHARACTERS = 4_000_000

_WORD = re.compile(r"[^\W_]+")
_BITS = 20


def normalised(text: str) -> str:
    """Letters and digits in lower case, one space between runs of them."""
    return " ".join(_WORD.findall(text.lower()))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the q-grams at each place."""
    many = max(0, len(codes) - Q + 1)
    h = np.zeros(many, np.uint64)
    for k in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + many]
    return mix(h)


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int
    bound: int  # q-grams that a band must share

    @classmethod
    def of(cls, item_id: int, text: str) -> Item:
        """The edit budget is lowered for short items so that the bound is 1 at least; an item
        shorter than a q-gram must occur as it is."""
        text = normalised(text)
        n = len(text)
        budget = max(0, min(n // CHARACTERS_PER_EDIT, n // Q - 1))
        return cls(item_id, text, budget, n + 1 - Q * (budget + 1))


class Block:
    """Index of the q-grams of some items."""

    def __init__(self, items: list[Item]):
        self.items = [i for i in items if i.text]
        self.short = [n for n, i in enumerate(self.items) if i.bound < 1]
        grams = [_qgrams(_codes(i.text)) if i.bound >= 1 else np.zeros(0, np.uint64) for i in self.items]
        sizes = [len(g) for g in grams]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams = flat[order]
        self.item = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place = np.concatenate([np.arange(s) for s in sizes])[order] if sizes else np.zeros(0, int)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[self.grams >> np.uint64(64 - _BITS)] = True
        self.width = np.array([i.budget + 1 for i in self.items], np.int64)
        self.bound = np.array([i.bound for i in self.items], np.int64)

    def bands(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest diagonal + 1) of bands with enough shared q-grams."""
        grams = _qgrams(codes)
        at = np.flatnonzero(self.maybe[grams >> np.uint64(64 - _BITS)])
        if not len(at):
            return []
        lo = np.searchsorted(self.grams, grams[at], side="left")
        many = np.searchsorted(self.grams, grams[at], side="right") - lo
        at, lo, many = at[many > 0], lo[many > 0], many[many > 0]
        if not len(at):
            return []
        # every posting of every shared q-gram
        posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        item = self.item[posting]
        diagonal = np.repeat(at, many) - self.place[posting]
        band = diagonal // self.width[item]
        # a band spans two widths, so that it overlaps the next: a diagonal lies in two
        key = np.concatenate([item, item]) * (1 << 40) + np.concatenate([band, band - 1]) + (1 << 30)
        keys, counts = np.unique(key, return_counts=True)
        items = keys >> 40
        enough = counts >= self.bound[items]
        items, bands = items[enough], (keys[enough] & ((1 << 40) - 1)) - (1 << 30)
        return [(int(i), int(b * self.width[i]), int((b + 2) * self.width[i])) for i, b in zip(items, bands)]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of every item found in a normalised text: its best place."""
        best: dict[int, tuple[int, int, int]] = {}
        codes = _codes(text)
        for n, low, high in self.bands(codes):
            item = self.items[n]
            a = max(0, low - item.budget)
            b = min(len(text), high + len(item.text) + item.budget)
            found = _align(item, codes, text, a, b)
            if found:
                best[n] = min(best.get(n, found), found)
        for n in self.short:
            at = text.find(self.items[n].text)
            if at >= 0:
                best[n] = (0, at, at + len(self.items[n].text))
        return [(self.items[n].item_id, *found) for n, found in sorted(best.items())]


def _align(item: Item, codes: np.ndarray, text: str, a: int, b: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the item in ``text[a:b]`` within its budget."""
    at = text.find(item.text, a, b)
    if at >= 0:
        return 0, at, at + len(item.text)
    pattern, window = _codes(item.text), codes[a:b]
    distance, end = _edits(pattern, window, free_start=True)
    if distance > item.budget:
        return None
    # backwards from the end, the same number of edits leads to the start
    _, length = _edits(pattern[::-1], window[:end][::-1][: len(pattern) + item.budget], free_start=False)
    return distance, a + end - length, a + end


def _edits(pattern: np.ndarray, window: np.ndarray, free_start: bool) -> tuple[int, int]:
    """Fewest edits between the pattern and a stretch of the window, and where it ends.

    The window is a band's width longer than the pattern, so all its cells are those of the band. One
    row per character of the pattern; insertions along a row are a running minimum.
    """
    places = np.arange(len(window) + 1)
    row = np.zeros_like(places) if free_start else places.copy()
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (window != c))
        row = np.minimum.accumulate(new - places) + places
    end = int(np.argmin(row))
    return int(row[end]), end


def blocks(benchmark: DataFrame, characters: int = BLOCK_CHARACTERS) -> Iterator[Block]:
    """Items of ``benchmark`` (item_id, text) in blocks of bounded size."""
    items, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        items.append(Item.of(row["item_id"], row["text"] or ""))
        size += len(items[-1].text)
        if size >= characters:
            yield Block(items)
            items, size = [], 0
    if items:
        yield Block(items)


def contaminations(docs: DataFrame, benchmark: DataFrame, characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for every document and item found in its whole text.

    Texts are compared by their letters and digits in lower case, with one space between runs; start, end
    and distance count characters of that form. An item counts as found if at most one edit per
    ``CHARACTERS_PER_EDIT`` characters is needed; of several places the best is given. Items go to the executors in blocks of
    bounded size, and documents are read once per block; nothing is shuffled.

    Null or empty texts and items: not found. Items of fewer than ``2 * Q`` characters: only without edits.
    Repeated rows: a result each. Null ids stay null. Empty tables: no rows. Other columns are ignored.
    """
    found = None
    key, item_key = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    fields = f"doc_id {key}, item_id {item_key}, distance int, start bigint, end bigint"
    for block in blocks(benchmark, characters):
        part = docs.select("doc_id", "text").mapInArrow(_search(docs, block), fields)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], fields) if found is None else found


def _search(docs: DataFrame, block: Block):
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "distance", "start", "end"]
        for batch in batches:
            rows = [
                (i, *match)
                for i, text in enumerate(batch.column(1).to_pylist())
                if text
                for match in shared.value.matches(normalised(text))
            ]
            if rows:
                of, items, distances, starts, ends = zip(*rows)
                columns = [pa.array(items), pa.array(distances, pa.int32()), pa.array(starts), pa.array(ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns], names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, characters: int = BLOCK_CHARACTERS) -> DataFrame:
    """Rows of ``docs`` with all their columns whose text holds no item, by the rule of ``contaminations``."""
    place, names = docs.columns.index("text"), docs.columns

    def without(block: Block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    clean = [not (t and shared.value.matches(normalised(t))) for t in part.column(place).to_pylist()]
                    yield part.filter(pa.array(clean, pa.bool_()))

        return run

    clean = docs
    for block in blocks(benchmark, characters):
        clean = clean.mapInArrow(without(block), docs.schema)
    return clean.select(*names)
