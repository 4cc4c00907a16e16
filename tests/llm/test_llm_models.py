"""Learnt operators: held-out accuracy and defined cases."""

import random

from conftest import MEDIUM
from pyspark.sql import functions as F

from plantpulse.llm import language_id, toxicity
from plantpulse.llm.queries import queries


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    got = queries()["op2_language_id"](spark, MEDIUM).join(docs, "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.where("score < 0 OR score > 1").count() == 0


def test_close_languages_of_one_family(spark):
    rng = random.Random(1)
    words = {"en": ["the", "with", "house"], "nl": ["het", "met", "huis"], "es": ["casa", "con", "el"], "xx": ["qqz", "zzq"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(list(words) * 30)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == {"Germanic": ["en", "nl"], "Romance": ["es"], "xx": ["xx"]}
    assert {"en nl", "family Germanic", "family Romance", "family xx"} == set(model.weights)
    for lang, own in words.items():
        assert model.scores(" ".join(own * 3))[0] == lang


def test_language_cases(spark):
    fields = "doc_id bigint, text string, lang string, score string"
    rows = [(1, "the house", "en", "s"), (2, "la casa", "es", "s"), (3, None, None, "s"), (4, "12 ?!", "en", "s"), (5, "", "es", "s")]
    rows += [(1, "the house", "en", "s"), (None, "𝒳 the house " * 5_000, None, "s")]
    docs = spark.createDataFrame(rows, fields)
    got = language_id.predict(docs, language_id.train(docs))
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got.collect()) == [
        ("1", "en"), ("1", "en"), ("2", "es"), ("3", "und"), ("4", "und"), ("5", "und"), ("None", "en"),
    ]
    assert {r["score"] for r in got.where("lang_pred = 'und'").collect()} == {0.0}
    untaught = language_id.train(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in language_id.predict(docs, untaught).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), untaught).count() == 0
    assert language_id.train(docs.select("doc_id", "text", F.lit("fr").alias("lang"))).scores("abc")[0] == "fr"


def test_toxicity_of_held_out_documents(spark):
    large = MEDIUM.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    got = queries()["op6_toxicity"](spark, large).join(labels, "doc_id").where("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / n[0, 0] < 0.01


def test_pairs_count_where_single_terms_do_not(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        filler = [f"w{rng.randrange(30)}" for _ in range(4)]
        rows.append((i, " ".join(filler + ["insult" if a else "praise"] + ["group" if b else "thing"]), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    machine = toxicity.train(docs.drop("toxic"), docs.drop("text"))
    # no single term tells anything here, so terms are taken as they come
    import numpy as np
    import pyarrow as pa

    texts = list(toxicity.terms(pa.array([r[1] for r in rows])))
    labels = np.array([r[2] for r in rows], float)
    toxicity_chi, toxicity.LEAST_CHI_SQUARED = toxicity.LEAST_CHI_SQUARED, 0.0
    try:
        machine = toxicity.fit(texts, labels)
    finally:
        toxicity.LEAST_CHI_SQUARED = toxicity_chi
    right = np.mean([(machine.score(t) >= 0.5) == (y > 0) for t, y in zip(texts, labels)])
    assert right > 0.95


def test_toxicity_cases(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "idiot " * 20_000, "x"), (3, "idiot", "x"), (None, "idiot", "x")], "doc_id bigint, text string, score string"
    )
    labels = spark.createDataFrame([(3, 1), (3, 0), (2, 0), (9, 1), (None, 1), (1, None)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    blank = [r["score"] for r in got if r["doc_id"] in (1, 2)]
    assert blank[0] == blank[1]
    untaught = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score(docs, untaught).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), untaught).count() == 0
