"""Terms that tell something only together."""

import random

from plantpulse.llm import toxicity


def test_pairs_are_learnt_with_production_parameters(spark):
    rng = random.Random(6)
    rows = []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        filler = [f"w{rng.randrange(30)}" for _ in range(4)]
        rows.append((i, " ".join(filler + ["insult" if a else "praise"] + ["group" if b else "thing"]), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    taught = docs.where("doc_id < 1200")
    machine = toxicity.train(taught.select("doc_id", "text"), taught.select("doc_id", "toxic"))
    labels = {i: y for i, _, y in rows}
    got = toxicity.score(docs.where("doc_id >= 1200").select("doc_id", "text"), machine).collect()
    assert len(got) == 400
    assert sum((r["score"] >= 0.5) == (labels[r["doc_id"]] > 0) for r in got) > 0.95 * len(got)
