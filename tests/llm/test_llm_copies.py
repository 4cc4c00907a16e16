"""Copies of documents of several lines in the pipeline."""

import random

from conftest import SMALL


def test_exact_copies_of_documents_of_several_lines_do_not_survive(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    texts = ["\n".join(f"the house {rng.randrange(10**9)} stands with the other houses {k}" for k in range(9)) for _ in range(30)]
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", None, len(texts[3])), rows[4], (200, None, "en", None, None)]
    docs = spark.createDataFrame(rows, fields)
    for _, stage in cp.STAGES[:4]:
        docs = cp.staged(stage(spark, docs, SMALL), "test-copies")
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(30))


def test_copies_cases(spark):
    import corpus_pipeline as cp

    rows = [(2, "a"), (1, "a"), (1, "a"), (None, "a"), (3, None), (4, None), (5, ""), (6, ""), (7, "b"), (None, "c"), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(str, (tuple(r) for r in cp.without_copies(docs).collect())))
    wanted = [(1, "a"), (1, "a"), (3, None), (4, None), (5, ""), (7, "b"), (None, "c"), (None, "c")]
    assert got == sorted(map(str, wanted))
    assert cp.without_copies(docs.limit(0)).count() == 0


def test_stages_leave_no_tables_of_earlier_stages(spark):
    import glob

    import corpus_pipeline as cp
    from conftest import SMALL
    from plantpulse.llm import staging

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/*"))
    docs, kept = cp.table(spark, SMALL, "documents"), set()
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        docs = staging.staged(docs, f"test-{name}")
        kept |= {p for p in glob.glob(f"{shared}/test-{name}-*") if p not in before}
    left = set(glob.glob(f"{shared}/*")) - before - kept
    assert len(kept) == len(cp.STAGES) and left == set()  # the last two stages stage nothing
    assert docs.count() > 0
