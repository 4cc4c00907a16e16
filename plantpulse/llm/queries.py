"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm import (
    bpe,
    chat_format,
    conversation_repair,
    decontamination,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    language_id,
    line_dedup,
    revisits,
    suffix_dedup,
    toxicity,
    url_reputation,
)
from plantpulse.session import work_path

#: Vocabulary of the token query; the file is read by the driver alone.
VOCABULARY = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against an index of their own, from empty."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = exact_dedup.DigestIndex(spark, work_path(spark, "digest-index"), buckets)
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.held_out(4, 2)
    model = language_id.train(docs.where(~out))
    predicted = language_id.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines before and after, and the digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(line_dedup.lines_of()).alias("n_lines"))
    cleaned = line_dedup.remove_repeated(docs)
    lost = F.aggregate("removed", F.lit(0), lambda total, c: total + c["size"])
    return cleaned.select(
        "doc_id",
        F.col("n_lines").cast("bigint").alias("n_lines"),
        lost.cast("bigint").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at a similarity of 0.85."""
    groups = jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels of four fifths of them."""
    docs, out = table(spark, sf_dir, "documents"), language_id.held_out(5, 0)
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    return toxicity.score(docs, machine).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.from_file(public_tokenizers.path(VOCABULARY))


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    words = vocabulary()
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return bpe.encode(table(spark, sf_dir, "documents"), words, decoded=True).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Web-archive records of the pages: each was captured once in full and once as not modified.

    Page ``n`` was captured in minute ``n`` and revisited 1 to 72 hours later. Of five revisits three
    name the page's entity tag, one its modification date, one an entity tag of another version.
    """
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    at = 1_700_000_000 + page * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5(html.cast("binary")), 1, 16), F.lit('"'))
    modified = (F.lit(1_600_000_000) + page * 60).cast("string")
    case = page % 5
    full = F.create_map(
        F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), F.octet_length(html).cast("string"),
        F.lit("ETag"), tag,
        F.lit("Last-Modified"), modified,
        F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    update = F.create_map(
        F.lit("content-length"), F.lit("0"),
        F.lit("cache-control"), F.concat(F.lit("max-age="), (page % 1000).cast("string")),
        F.lit("etag"), F.when(case <= 2, F.concat(F.lit("W/"), tag)).when(case == 4, F.lit('"other"')),
        F.lit("last-modified"), F.when(case == 3, modified),
    )
    digest = F.md5(html.cast("binary"))
    seen = pages.select(
        F.explode(
            F.array(
                F.struct((page * 2).alias("record_id"), at.alias("captured_at"), F.lit("response").alias("kind"),
                         full.alias("headers"), digest.alias("payload_digest")),
                F.struct((page * 2 + 1).alias("record_id"), (at + 3600 * (1 + page % 72)).alias("captured_at"),
                         F.lit("revisit").alias("kind"), update.alias("headers"),
                         F.lit(None).cast("string").alias("payload_digest")),
            )
        ).alias("r"),
        F.col("url").alias("uri"),
    )
    return seen.select("r.*", "uri")


@query
def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages, with the merged headers as text."""
    resolved = revisits.resolve_revisits(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.withColumn("headers", F.array_join(F.array_sort(lines), "\n"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share passages of 50 words, with the places of these."""
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a page's outcome is the quality label under its number (0: bad)."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors; labels of some are moved on first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at least cost."""
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.reports(conversation_repair.repairs(rows))


@query
def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks in control strings, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.summaries(chat_format.read_turns(chat_format.format_turns(rows)))
