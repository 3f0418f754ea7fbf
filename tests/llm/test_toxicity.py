"""Toxicity of long clean texts: length alone is not toxic."""

import random

from pyspark.sql import functions as F

from hushline.llm import toxicity


def test_length_alone_is_not_toxic(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["tree", "river", "stone", "cloud", "field", "house"])
    clean = lambda: " ".join(word() for _ in range(6))
    rows = []
    for i in range(400):
        parts = [clean() for _ in range(5)]
        if i % 8 == 0:
            parts[2] = f"{word()} vile {word()}"
        rows.append((i, ". ".join(parts) + ".", int(i % 4 == 0)))  # half of the toxic labels have no telling word
    long = ". ".join(clean() for _ in range(20_000))
    rows += [(1000, long, None), (1001, long + ". so vile it is.", None), (1002, ". ".join(["unseen things here"] * 20_000), None), (1003, clean(), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for labels in (docs.where("toxic IS NOT NULL"), docs.where("toxic = 0"), docs.where("false")):
        weights = toxicity.train(docs, labels.select("doc_id", "toxic"))
        got = {r.doc_id: r.score for r in toxicity.score(docs, weights).where(F.col("doc_id") >= 1000).collect()}
        assert max(got[1000], got[1002], got[1003]) < toxicity.THRESHOLD
        assert abs(got[1002] - got[1003]) < 0.01 and abs(got[1000] - got[1003]) < 0.2
    weights = toxicity.train(docs, docs.where("toxic IS NOT NULL").select("doc_id", "toxic"))
    assert toxicity.score(docs, weights).where("doc_id = 1001").first().score >= toxicity.THRESHOLD
