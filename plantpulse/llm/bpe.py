"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token with which its encoding ends: a token that
ends there and goes with the last token of the prefix before it. Tokens that end at a place come from a
suffix automaton of the vocabulary; whether two tokens go together is decided by undoing merges at
their seam. Following the tokens back from the end of the word gives the exact ids.

Ids are those of the tokenizers library for every assigned character. What counts as a letter follows
the Unicode version of the regex package, so unassigned characters may differ.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from plantpulse.llm.hashing import rows_of_lists

# --- Fixed values: how vocabulary files of this kind say they are to be read. ---
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WHITE_SPACE = r"\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# --- End of fixed values. ---

#: Separators for str.split that white space does not include.
_INNER_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")
#: Encodings of words, and of chunks between white space, that a task remembers: at most twice as many each. A
#: word takes longer to encode than a chunk of known words.
MEMO_WORDS, MEMO_CHUNKS = 150_000, 100_000
#: Pairs of tokens for which a task remembers whether they go together.
MEMO_PAIRS = 150_000


def byte_letters() -> str:
    """The letter that stands for each byte in vocabulary files: printable ones stand for
    themselves, the others get letters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


@dataclass(frozen=True)
class Vocabulary:
    """``tokens[i]`` is token ``i`` as the file writes it, ``parts[i]`` the two tokens it was merged
    from (itself twice if it is a symbol), ``special`` maps strings that are never split to their ids."""

    tokens: list[str]
    parts: list[tuple[int, int]]
    special: dict[str, int]

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """Reads a vocabulary with word ends. ValueError if it asks for another way of encoding."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        added = spec.get("added_tokens", [])
        as_expected = (
            model["type"] == "BPE"
            and model.get("end_of_word_suffix") == WORD_END
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and [s["type"] for s in steps] == NORMALIZERS
            and steps[1]["pattern"] == {"Regex": WHITE_SPACE}
            and split.get("pattern") == {"Regex": WORD_PATTERN}
            and spec.get("decoder") is None
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not as_expected:
            raise ValueError(f"{path}: not a byte-level vocabulary with word ends")
        ids = model["vocab"]
        size = 1 + max([*ids.values(), *(t["id"] for t in added)])
        tokens, parts = [""] * size, [(i, i) for i in range(size)]
        for token, i in ids.items():
            tokens[i] = token
        previous = -1
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            merged = ids[left + right]
            if merged <= previous:
                raise ValueError(f"{path}: merges are not in the order of their ids")
            previous, parts[merged] = merged, (ids[left], ids[right])
        for t in added:
            tokens[t["id"]] = t["content"]
        return cls(tokens, parts, {t["content"]: t["id"] for t in added})


class Encoder:
    """Encodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.parts = vocabulary.parts
        self.merged = {
            (a << 32) | b: i for i, (a, b) in enumerate(vocabulary.parts) if (a, b) != (i, i)
        }
        to_byte = {letter: b for b, letter in enumerate(byte_letters())}
        self.automaton = ahocorasick.Automaton()
        names = set(vocabulary.special)
        for i, token in enumerate(vocabulary.tokens):
            if token and token not in names:
                ends = token.endswith(WORD_END) and token != WORD_END
                letters = [to_byte[c] for c in (token[: -len(WORD_END)] if ends else token)]
                if ends:
                    letters[-1] += 256  # the last byte of a word is a symbol of its own
                self.automaton.add_word("".join(map(chr, letters)), (i, len(letters)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.words = regex.compile(WORD_PATTERN)
        self.special = (
            regex.compile("|".join(regex.escape(s) for s in sorted(names, key=len, reverse=True))) if names else None
        )
        self.known_words = _Memo(self.word, MEMO_WORDS)
        self.chunks = _Memo(self.chunk, MEMO_CHUNKS)

    def forget(self) -> None:
        """Gives the memory of the memos back: the worker may live on for other work."""
        for memo in (self.known_words, self.known_words.old, self.chunks, self.chunks.old, self.compatible):
            memo.clear()

    def goes_with(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens stay apart: no merge across their seam comes before the
        merges that made them, undone from the latest on."""
        key = (left << 32) | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        earliest = 1 << 32
        while True:
            across = self.merged.get((left << 32) | right)
            if across is not None and across < earliest:
                return False
            a, b = self.parts[left][1], self.parts[right][0]
            if left > right or b == right:  # the left token was made later, or the right one is a symbol
                if a == left:
                    if b == right:
                        return True
                    earliest, right = right + 1, b
                else:
                    earliest, left = left, a
            else:
                earliest, right = right + 1, b

    def word(self, text: str) -> bytes:
        """Ids of one word, as 32-bit integers."""
        data = text.encode("utf-8")
        symbols = data[:-1].decode("latin-1") + chr(data[-1] + 256)
        last: list[tuple[int, int] | None] = [None] * (len(symbols) + 1)
        for end, token in self.automaton.iter(symbols):  # the longest first at each place
            if last[end + 1] is None:
                start = end + 1 - token[1]
                if start == 0 or (last[start] is not None and self.goes_with(last[start][0], token[0])):
                    last[end + 1] = token
        ids, at = [], len(symbols)
        while at:
            token = last[at]
            ids.append(token[0])
            at -= token[1]
        return np.array(ids[::-1], np.int32).tobytes()

    def chunk(self, text: str) -> bytes:
        """Ids, as 32-bit integers, of a text without white space."""
        lower = text.replace("Σ", "σ").lower()  # no special final sigma
        return b"".join(map(self.known_words.__getitem__, self.words.findall(lower)))

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        parts = _SPACES.split(text) if _INNER_SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self._plain(text), np.int32)
        found, at = [], 0
        for m in self.special.finditer(text):
            found += [self._plain(text[at : m.start()]), np.int32(self.vocabulary.special[m[0]]).tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*found, self._plain(text[at:])]), np.int32)


class Decoder:
    """Decodes with one vocabulary: tokens as it writes them, joined by spaces, special ones included."""

    def __init__(self, vocabulary: Vocabulary):
        self.size = len(vocabulary.tokens)
        self.tokens = pa.array([t or None for t in vocabulary.tokens], pa.string())

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Texts of lists of ids. Null lists are empty texts; null and unknown ids are left out."""
        offsets = lists.offsets.to_numpy()
        ids = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.int64()).fill_null(-1).to_numpy()
        tokens = self.tokens.take(pa.array(np.where((ids >= 0) & (ids < self.size), ids, 0)))
        known = tokens.is_valid().to_numpy(zero_copy_only=False) & (ids >= 0) & (ids < self.size)
        starts = offsets - offsets[0]
        if not known.all():
            starts = np.concatenate([[0], np.cumsum(known)])[starts].astype(offsets.dtype)
            tokens = tokens.filter(pa.array(known))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), tokens), " ")
        return pc.if_else(lists.is_valid(), joined, "")


class _Memo(dict):
    """Results of a function by text. Full, it becomes the old generation, from which what is
    still asked for is taken over; what was old before is forgotten."""

    def __init__(self, function, most: int):
        super().__init__()
        self.function, self.most, self.old = function, most, {}

    def __missing__(self, text: str) -> bytes:
        found = self.old.get(text)
        if found is None:
            found = self.function(text)
        if len(text) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = found
        return found


#: The encoder of a Python worker, with the vocabulary it was made from.
_HELD: list = [None, None]


def _encoder(vocabulary: Vocabulary) -> Encoder:
    if _HELD[0] is not vocabulary:
        _HELD[:] = [vocabulary, Encoder(vocabulary)]
    return _HELD[1]


def encode(docs: DataFrame, vocabulary: Vocabulary, *, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every row; ids is an array of int. With ``decoded`` also the text they decode to, in the
    same pass.

    Every whole text is encoded on its own, without a shuffle. The vocabulary is broadcast: its size is
    that of its file. Null text and text without words: an empty array. Rows are neither merged nor
    ordered, so repeated rows and null doc_ids stay. Other columns are ignored. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ids", "decoded"] if decoded else ["doc_id", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = rows_of_lists([encoder.encode(t or "") for t in part.column(1).to_pylist()], pa.int32())
                columns = [part.column(0), ids, *([decoder.decode(ids)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names)
        encoder.forget()

    fields = f"doc_id {key}, ids array<int>" + ", decoded string" * decoded
    return docs.select("doc_id", "text").mapInArrow(run, fields)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (ids and any other columns) with the decoded text as column ``decoded``.

    Null ids, or none: an empty text. Null and unknown numbers among them are left out.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in encoded.columns if c != "decoded"]
    frame = encoded.select(*others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    place = others.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = decoder.decode(part.column(place))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*others, "decoded"])

    return frame.mapInArrow(run, f"{fields}, decoded string")
