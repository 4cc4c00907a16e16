"""Queries against their SQL, and the pipeline against its parts."""

import re

import pytest
from conftest import MEDIUM, SMALL
from oracle_check import connect, spark_rows, sql_rows

from plantpulse.llm.oracle import oracle_sql
from plantpulse.llm.queries import queries


def test_names():
    assert [re.match(r"op(\d+)_", n)[1] for n in sorted(queries(), key=lambda n: int(re.match(r"op(\d+)", n)[1]))] == [str(n) for n in range(1, 14)]
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("folder", [SMALL, MEDIUM], ids=["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name, folder):
    con = connect(folder)
    try:
        assert spark_rows(queries()[name](spark, folder)) == sql_rows(con, oracle_sql()[name])
    finally:
        con.close()


def test_tokens_of_all_documents_are_the_library_s(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries()["op10_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_passages_of_all_documents(spark):
    from test_llm_suffix import brute

    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = queries()["op8_suffix_dedup"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == [d for d, _ in brute(rows)]


def test_benchmark_in_all_documents(spark):
    from plantpulse.llm.decontamination import normalised

    items = {r["item_id"]: normalised(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    texts = {r["doc_id"]: normalised(r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    exact = {(d, i) for d, t in texts.items() for i, item in items.items() if item in t}
    got = queries()["op3_decontamination"](spark, SMALL).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == exact


def test_pipeline(spark):
    import corpus_pipeline as cp
    from test_llm_jaccard import brute as groups
    from test_llm_lines import brute as lines

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    after = {}
    for name, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, SMALL), f"test-{name}")
        after[name] = docs
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(df.columns == columns for name, df in after.items() if name != "bpe")
    texts = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in after.items() if name != "bpe"}
    wanted = {d: t for d, t, gone in lines([(d, t, "") for d, t in texts["language_id"].items()]) if not gone or t.strip()}
    assert texts["line_dedup"] == wanted
    kept = {d for d, _, c in groups(sorted(texts["line_dedup"].items()), 5, 80) if c == d}
    assert set(texts["jaccard_join"]) == kept
    dirty = {r["doc_id"] for r in cp.decontamination.contaminations(after["jaccard_join"], cp.table(spark, SMALL, "benchmark")).collect()}
    assert set(texts["decontamination"]) == kept - dirty
    assert {r["doc_id"] for r in after["bpe"].collect()} == kept - dirty
    again = cp.run(spark, SMALL)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, after["bpe"].collect()))
    assert [len(r["text"]) == r["n_chars"] for r in after["decontamination"].collect()].count(False) == 0


def test_pipeline_cases(spark):
    import corpus_pipeline as cp

    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, group string"
    text = "\n".join(f"the house number {i} stands with the other houses" for i in range(40))
    rows = [(1, text), (None, text), (3, None), (4, ""), (5, "12 34"), (6, "own words of the house"), (6, "own words of the house")]
    full = [(d, t, "en", None, None if t is None else len(t), "s", "g") for d, t in rows]
    for docs in (spark.createDataFrame(full, fields), spark.createDataFrame([], fields)):
        for name, stage in cp.STAGES:
            before, docs = docs.columns, cp.staged(stage(spark, docs, SMALL), f"test-{name}")
            assert name == "bpe" or docs.columns == before
    docs = spark.createDataFrame(full, fields)
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 6]
