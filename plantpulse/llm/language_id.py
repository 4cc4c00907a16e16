"""Language identification in two steps: the family first, then the languages within it.

One linear support vector machine per family tells families apart. Within a family one machine
per pair of languages is trained on texts of these two only, so that close relatives are told apart
by what distinguishes them. Features are letter n-grams (1 to 3, with word boundaries) of whole texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.hashing import mix, rows_of_lists

# --- Fixed values: families of closely related languages. A language not listed is a family of its own. ---
FAMILIES = {
    "Germanic": ["da", "de", "en", "nl", "no", "sv"],
    "Romance": ["ca", "es", "fr", "it", "pt", "ro"],
    "Slavic": ["bg", "cs", "pl", "ru", "sk", "uk"],
}
# --- End of fixed values. ---

UNDETERMINED = "und"
#: Hash buckets of letter n-grams.
BUCKETS = 1 << 13
#: Most training texts per language, and of all languages together.
TEXTS_PER_LANGUAGE = 400
TEXTS_IN_ALL = 20_000

_SLICE_CHARS = 1 << 18
_SPACE = 32


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])


_LETTERS: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Lower-case letters of a text with one space around each word."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTERS[0][np.minimum(raw, 0xFFFF)]  # beyond the basic plane: as its last place, no letter
    if len(raw) and raw.max() > 0xFFFF:
        high = np.flatnonzero(raw > 0xFFFF)
        letter[high] = [chr(c).isalpha() for c in raw[high]]
    codes = np.full(len(raw) + 2, _SPACE, np.uint64)
    codes[1:-1] = np.where(letter, raw, _SPACE)
    space = codes == _SPACE
    return codes[~(space & np.concatenate([[False], space[:-1]]))]


def ngrams(text: str) -> list[np.ndarray]:
    """Buckets of the letter n-grams of a text, for n of 1 to 3; empty without letters.

    Spaces alone are no feature, nor are n-grams that span two words.
    """
    c = _codes(text)
    if len(c) < 3:
        return [np.zeros(0, np.int64)] * 3
    space = c == _SPACE
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    k = np.uint64(0x100000001B3)
    one = c[~space]
    two = c[:-1] * k + c[1:] + np.uint64(1 << 40)
    three = ((c[:-2] * k + c[1:-1]) * k + c[2:] + np.uint64(1 << 41))[~space[1:-1]]
    return [(mix(g) >> shift).astype(np.int64) for g in (one, two, three)]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): each order of n-grams counts as a third, whatever the text's length."""
    x = np.zeros(BUCKETS)
    for g in ngrams(text):
        if len(g):
            x += np.bincount(g, minlength=BUCKETS) / (3 * len(g))
    found = np.flatnonzero(x)
    return found, x[found]


@dataclass(frozen=True)
class Model:
    """``families`` and, per family, its languages; ``weights`` by name of a machine, bias last."""

    families: list[str]
    languages: dict[str, list[str]]
    weights: dict[str, np.ndarray]

    def scores(self, text: str) -> tuple[str, float]:
        """(language, confidence) of a text: the product of family and pair confidences."""
        found, values = features(text)
        if not len(found) or not self.families:
            return UNDETERMINED, 0.0

        def margin(name: str) -> float:
            w = self.weights[name]
            return float(values @ w[found] + w[-1])

        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = [margin(f"family {f}") for f in self.families]
            best = int(np.argmax(margins))
            family, sure = self.families[best], _confidence(margins[best])
        members = self.languages[family]
        if len(members) == 1:
            return members[0], sure
        totals, least = dict.fromkeys(members, 0.0), dict.fromkeys(members, np.inf)
        for a, b in itertools.combinations(members, 2):
            m = margin(f"{a} {b}")
            totals[a] += m
            totals[b] -= m
            least[a], least[b] = min(least[a], m), min(least[b], -m)
        lang = max(members, key=lambda x: totals[x])
        return lang, sure * _confidence(least[lang])


def _confidence(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(3 * margin, -30, 30))))


def _machine(x: np.ndarray, y: np.ndarray, steps: int = 80, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss; both classes weigh the same.

    ``x`` is single precision with a row per text; rare n-grams are scaled up.
    """
    scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
    x = x * scale
    x /= (norm := np.sqrt((x**2).sum(1).mean()) or np.float32(1))
    y = y.astype(np.float32)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead, ahead_b, rate = w.copy(), b, np.float32(0.25)
    for step in range(steps):  # accelerated gradient descent
        slack = np.maximum(0, 1 - y * (x @ ahead + ahead_b))
        pull = -2 * share * slack * y
        new = ahead - rate * (pull @ x + penalty * ahead)
        new_b = ahead_b - rate * pull.sum()
        momentum = np.float32(step / (step + 3))
        ahead, ahead_b = new + momentum * (new - w), new_b + momentum * (new_b - b)
        w, b = new, new_b
    return np.append(w * scale / norm, b).astype(np.float32)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """Model of rows of features and their languages."""
    y = np.array(langs)
    names = sorted(set(langs))
    languages: dict[str, list[str]] = {}
    for lang in names:
        languages.setdefault(family_of(lang), []).append(lang)
    weights = {}
    if len(languages) > 1:
        for name, members in languages.items():
            weights[f"family {name}"] = _machine(x, np.where(np.isin(y, members), 1.0, -1.0))
    for members in languages.values():
        for a, b in itertools.combinations(members, 2):
            pair = np.isin(y, [a, b])
            weights[f"{a} {b}"] = _machine(x[pair], np.where(y[pair] == a, 1.0, -1.0))
    return Model(list(languages), languages, weights)


def train(labelled: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> Model:
    """Model learnt from ``text`` and non-null ``lang`` of ``labelled``.

    Of each language a pseudo-random sample of about ``per_language`` rows is taken, in all
    ``TEXTS_IN_ALL`` at most; features are computed by the executors, so what reaches the driver is bounded by
    ``TEXTS_IN_ALL * BUCKETS`` numbers. Without labelled rows the model knows no language.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], {}, {})
    parts = 1 << 30
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))
    wanted = F.lit(0)
    for lang, n in counts.items():
        wanted = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * parts)).otherwise(wanted)
    sample = usable.where(chance < wanted).select("lang", "text").limit(TEXTS_IN_ALL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()),
                    rows_of_lists([r[0] for r in rows], pa.int32()),
                    rows_of_lists([r[1] for r in rows], pa.float32()),
                ],
                ["lang", "bucket", "value"],
            )

    rows = sample.mapInArrow(run, "lang string, bucket array<int>, value array<float>").toArrow()
    x = np.zeros((rows.num_rows, BUCKETS), np.float32)
    for i, (found, values) in enumerate(zip(rows["bucket"].to_pylist(), rows["value"].to_pylist())):
        x[i, found] = values
    known = x.any(1)
    langs = [lang for lang, ok in zip(rows["lang"].to_pylist(), known) if ok]
    return fit(x[known], langs) if langs else Model([], {}, {})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from ``text`` alone.

    Null text and text without letters: ``und`` with score 0. One row per row, repeated rows too; columns
    of these names that ``docs`` has already are replaced, all others stay. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per machine
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    frame = docs.select(*others)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    place = others.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [model.scores(t or "") for t in part.column(place).to_pylist()]
                columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*others, "lang_pred", "score"])

    return frame.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(parts: int, part: int) -> Column:
    """Whether a row belongs to the fold that models must not see, by the checksum of its doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
