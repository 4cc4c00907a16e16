"""Exact dedup and its index."""

import hashlib

import pytest

from plantpulse.llm.exact_dedup import ENTRY, DigestIndex, deduplicate, digest_rows
from plantpulse.session import work_path

FIELDS = "doc_id bigint, text string, digest string"


def index(spark, path=None):
    return DigestIndex(spark, path or work_path(spark, "index"), 4)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept").collect()), key=repr)


def test_longest_then_smallest_stays(spark):
    rows = [(1, "ab", "x"), (2, "a b", "x"), (3, "a\tb", "x"), (4, None, "x"), (5, "", "x"), (6, " \n", "x"), (7, "é", "x")]
    got = result(deduplicate(spark.createDataFrame(rows, FIELDS), index(spark)))
    assert got == [
        (1, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False),
        (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True),
    ]


def test_digest_is_of_the_normalised_text(spark):
    rows = [(1, "Á b\r\nc\x0b", "")]
    got = deduplicate(spark.createDataFrame(rows, FIELDS), index(spark)).first()
    assert got["text_sha256"] == hashlib.sha256("Ábc".encode()).hexdigest()


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "x", ""), (1, "x", ""), (None, "x", ""), (None, "y", "")]
    got = deduplicate(spark.createDataFrame(rows, FIELDS), index(spark)).collect()
    assert [r["kept"] for r in got if r["group_size"] == 3].count(True) == 1
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in got if r["group_size"] == 1] == [(None, None, True)]


def test_empty_table(spark):
    assert deduplicate(spark.createDataFrame([], FIELDS), index(spark)).count() == 0


def test_split_into_batches_does_not_matter(spark):
    rows = [(i, ("ab " * (i % 5)) + " " * (i % 7), "") for i in range(60)]
    docs = spark.createDataFrame(rows, FIELDS)
    got = [result(deduplicate(docs, index(spark), long_text=n)) for n in (0, 6, 10**6)]
    assert got[0] == got[1] == got[2]


def test_index_persists(spark):
    path = work_path(spark, "index")
    first = spark.createDataFrame([(5, "a", ""), (6, "b", "")], FIELDS)
    later = spark.createDataFrame([(1, "a ", ""), (2, "c", ""), (3, "c", "")], FIELDS)
    deduplicate(first, index(spark, path)).collect()
    again = index(spark, path)
    assert result(deduplicate(later, again)) == [(1, 5, 1, False), (2, 2, 2, True), (3, 2, 2, False)]
    assert sorted(r["doc_id"] for r in again.entries().collect()) == [2, 5, 6]


def test_index_keeps_its_number_of_buckets(spark):
    path = work_path(spark, "index")
    docs = spark.createDataFrame([(i, f"text {i}", "") for i in range(200)], FIELDS)
    DigestIndex(spark, path, 8).append(digest_rows(docs), "first")
    for buckets in (4, 16):
        again = DigestIndex(spark, path, buckets)
        assert again.buckets == 8 and again.unseen(digest_rows(docs)).count() == 0


def test_data_without_their_number_of_buckets_are_refused(spark):
    path = work_path(spark, "index")
    spark.createDataFrame([], ENTRY).write.parquet(path)
    with pytest.raises(ValueError):
        DigestIndex(spark, path, 8)


def test_anti_join_is_a_merge_join_on_the_bucketed_index(spark):
    own = index(spark)
    docs = spark.createDataFrame([(1, "a", "")], FIELDS)
    plan = own.unseen(digest_rows(docs))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Python" not in plan
