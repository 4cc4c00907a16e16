"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New rows are reduced to one candidate
per digest, anti-joined with the index by sort-merge join, and what is left is appended. Text
itself is read once, for its digest; everything after works on about 60 bytes a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged, text_or_empty

#: Characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\x0c\r"

#: Entries of the index: which row stays for a digest.
ENTRY = "digest binary, doc_id bigint, n_chars bigint, row bigint, run string"

#: Name of the empty file that tells an index's number of buckets, but for the number.
NOTE = "_buckets-"


def digest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, row, digest) of every row; the only step that reads texts.

    ``n_chars`` counts code points of the original text, ``digest`` is SHA-256 of the text without
    the ignored characters. A null text counts as empty. ``row`` tells repeated rows apart; it is
    only stable once written.
    """
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.char_length(text).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2(F.translate(text, IGNORED, "").cast("binary"), 256)).alias("digest"),
    )


def best_per_digest(rows: DataFrame) -> DataFrame:
    """One candidate per digest: most code points, then smallest doc_id (null last).

    The minimum is taken before the shuffle already, so a digest that a third of all rows share
    sends one row per task.
    """
    order = F.struct(
        (-F.col("n_chars")).alias("shorter"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.col("doc_id"),
        F.col("row"),
    )
    return (
        rows.groupBy("digest")
        .agg(F.min(order).alias("best"))
        .select(
            "digest", "best.doc_id", (-F.col("best.shorter")).alias("n_chars"), F.col("best.row").alias("row")
        )
    )


class DigestIndex:
    """Digests of all rows that stay, as a bucketed and sorted table at ``path``.

    The path is the index: opening it again, in any session, continues it. The number of buckets is that of its first opening, kept
    beside the data; ``buckets`` counts for a new index alone. A bucket should hold a few hundred MB at most (4 million entries or so).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets = self._noted_buckets(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({ENTRY}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _noted_buckets(self, buckets: int) -> int:
        """Buckets of the index by the name of its note; a new index notes ``buckets``. Data without a note, or two, are refused:
        read with another number of buckets, entries would not be found."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        noted = [int(n.removeprefix(NOTE)) for n in names if n.startswith(NOTE)]
        if len(noted) > 1 or (not noted and any(n.endswith(".parquet") for n in names)):
            raise ValueError(f"number of buckets of {self.path} is not known")
        if not noted:
            files.create(jvm.org.apache.hadoop.fs.Path(folder, f"{NOTE}{buckets}")).close()
        return noted[0] if noted else buckets

    def entries(self) -> DataFrame:
        """All entries as a bucketed scan."""
        return self.spark.table(self.name)

    def plain(self) -> DataFrame:
        """The same entries without bucketing: a join with skewed rows is then a join of two
        shuffles, which adaptive execution can split."""
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Candidates among ``rows`` whose digest the index lacks."""
        return best_per_digest(rows).join(self.entries().hint("merge"), "digest", "left_anti")

    def append(self, rows: DataFrame, run: str) -> None:
        """Adds what is unseen under the name ``run``; rows whose digest is present, from earlier
        rows or within ``rows``, leave no trace. One file per bucket and call.

        The unseen rows are staged first: a task that is run again must not see the entries that
        its own job has added.
        """
        fresh = staged(self.unseen(rows), "digests-new")
        (
            fresh.select("digest", "doc_id", "n_chars", "row", F.lit(run).alias("run"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, long_text: int = 2000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` enter the index as two batches, texts of ``long_text`` code points or more first. As
    an entry once made stays, this keeps the rule "most code points first" for any split;
    within a batch the smallest doc_id wins. If the index held a digest before, all rows of ``docs`` with
    it are dropped in favour of the indexed one.

    Null text: empty. Empty texts: one group. Repeated rows (same doc_id too): one of them is
    kept. Null doc_id: loses ties; keep_id is null if such a row stays. Empty table: no rows.
    Other columns are ignored.
    """
    run = uuid.uuid4().hex
    rows = staged(digest_rows(docs), "digests")
    for batch in (F.col("n_chars") >= long_text, F.col("n_chars") < long_text):
        index.append(rows.where(batch), run)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    stays = index.plain().select(
        "digest",
        F.col("doc_id").alias("keep_id"),
        F.when(F.col("run") == run, F.col("row")).alias("keep_row"),
    )
    # staged: with a shuffle on either side, adaptive execution splits a digest with many rows
    groups = staged(sizes.join(stays, "digest"), "digest-groups")
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
