"""Cleaning a text corpus: five stages, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm import bpe, decontamination, jaccard_join, language_id, line_dedup
from plantpulse.llm.queries import table, vocabulary
from plantpulse.llm.staging import stage_of_pipeline, staged, staged_ids

#: Least confidence in a document's language.
LEAST_CONFIDENCE = 0.2

#: Column that tells rows apart where doc_id does not.
_KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    parts = F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return docs.withColumn(_KEY, F.unhex(F.md5(parts.cast("binary"))))


def without_copies(docs: DataFrame) -> DataFrame:
    """Of documents with the same text the one with the smallest doc_id (null last) stays.

    Repeated rows (doc_id and text) all stay. Null texts are no copies. Digests alone are shuffled; texts are only if the
    copies are too many to be broadcast as ids.
    """
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    places = _keyed(docs.select("doc_id", "text")).where("text IS NOT NULL").select("doc_id", _KEY, digest)
    places = staged(places, "text-digests")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    repeated = places.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    repeated = staged(repeated.where("first <> last").select("digest", "first"), "texts-repeated")
    # keys tell rows apart by doc_id and text
    copies = places.join(repeated, "digest").where(order != F.col("first")).select(_KEY)
    return _keyed(docs).join(staged_ids(copies, "text-copies"), _KEY, "left_anti").select(*docs.columns)


@stage_of_pipeline
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or less than ``LEAST_CONFIDENCE`` in any.

    Exact copies go before that: line dedup would leave those of their lines that its chunk rule does not remove, too
    little to be found similar to the original. Texts alone decide about the language, so none is lost.

    The model learns from the rows of ``docs`` that have a ``lang``. The column itself stays as it is.
    """
    model = language_id.train(docs)
    docs = without_copies(docs)
    marked = language_id.predict(docs.withColumnsRenamed({"lang_pred": "__lang_pred", "score": "__score"}), model)
    kept = marked.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_CONFIDENCE))
    return kept.drop("lang_pred", "score").withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"})


@stage_of_pipeline
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes chunks of lines that an earlier document has out of texts; documents with nothing left go.

    ``n_chars``, where there is one, follows the text.
    """
    names = docs.columns
    cleaned = line_dedup.remove_repeated(docs, removed="__removed")
    cleaned = cleaned.where((F.size("__removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in names:
        length = F.when(F.size("__removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        cleaned = cleaned.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return cleaned.select(*names)


@stage_of_pipeline
def dedup_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (5-word shingles, 0.8) the smallest doc_id stays, once."""
    keyed = _keyed(docs)
    groups = jaccard_join.jaccard_groups(keyed, carry=[_KEY])
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", _KEY)
    first = groups.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(order)[_KEY].alias(_KEY))
    alone = groups.where(F.col("group").isNull()).select(_KEY)
    kept = staged(first.select(_KEY).union(alone).distinct(), "kept-documents")
    # identical rows have one key: the first of them stays
    return keyed.join(kept, _KEY, "left_semi").dropDuplicates([_KEY]).select(*docs.columns)


@stage_of_pipeline
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage_of_pipeline
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, with digests of the ids and of what they decode to."""
    words = vocabulary()
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encode(docs, words, decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_similar),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: A learnt stage and a tokenizer: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
