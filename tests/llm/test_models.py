"""Quality, toxicity and personal data: held-out accuracy on the given tables, brute force, odd rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from hushline.llm import pii, quality, toxicity
from hushline.llm.common import held_out
from hushline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n .!"), (4, "word " * 50_000), (5, "same"), (5, "same"), (None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("ord", F.lit(1)).withColumn("_label", F.lit(2))


def held(spark, name, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return QUERIES[name](spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", label).toPandas()


def test_quality_on_held_out_rows(spark):
    got = held(spark, "op8_quality", "quality")
    assert (got.predicted == got.quality).mean() > 0.9


def test_toxicity_on_held_out_rows(spark):
    got = held(spark, "op10_toxicity", "toxic")
    assert (got.predicted == got.toxic).mean() > 0.9 and got[got.toxic == 1].score.mean() > got[got.toxic == 0].score.mean() + 0.3


def test_odd_rows_and_no_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for op, label in ((quality, "quality"), (toxicity, "toxic")):
            got = op.score(docs, op.train(docs, labels, label))
            assert got.columns == docs.columns
            rows = got.collect()
            assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
            assert op.score(docs.where("false"), op.train(docs.where("false"), labels, label)).count() == 0
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}


def test_held_out_fold(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_sentences_are_located(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["tree", "river", "stone", "cloud", "field", "house"])
    clean = lambda: " ".join(word() for _ in range(6))
    rows = []
    for i in range(400):
        parts = [clean() for _ in range(5)]
        if i % 4 == 0:
            parts[i % 5] = f"{word()} vile {word()}"
        rows.append((i, ". ".join(parts) + ".", int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    weights = toxicity.train(docs, docs.select("doc_id", "toxic"))
    got = toxicity.locate(toxicity.score(docs, weights), weights).collect()
    for r in got:
        assert (r.score >= 0.5) == bool(r.toxic)
        assert ["vile" in r.text[s.start:s.end] for s in r.toxic_sentences] == [True] * r.toxic


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15])


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "1", "23", ".", "+1", " ", "-", "(555)", "4111 1111 1111 1111", "a@b.c", "255", "256", "\ue000", "😀", "%", "x@y.z%q@r.s", "\n", "0000255.1.1.1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(400)] + [None, "", "1" * 60_000, "a" * 60_000, "1.2.3.4 " * 500, "4111111111111111", "4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("row", F.lit(1)).withColumn("votes", F.lit(1))
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in got[i].base] == base(t or ""), t
        assert set(map(tuple, got[i].base)) <= set(map(tuple, got[i].spans))
    assert pii.find(docs.where("false")).count() == 0


def test_secrets_are_added_and_decoys_are_not(spark):
    rng = random.Random(5)
    rows = [f"some words token = \"{rng.randbytes(20).hex()}\" and more" for _ in range(60)] + [f"the commit {rng.randbytes(20).hex()} was fine" for _ in range(30)]
    rows += [f"a number {rng.randint(10**15, 10**16 - 1)} in a text" for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = pii.find(docs)
    got = {r.doc_id: [pii.KINDS[s.kind] for s in r.spans] for r in found.collect()}
    assert all(got[i] == ["secret"] for i in range(60))
    assert not any("secret" in got[i] for i in range(90, 150)) and sum(len(got[i]) for i in range(90, 150)) == sum(len(base(rows[i])) for i in range(90, 150))
    assert pii.masked(docs, found).where("doc_id = 0").first().text == 'some words token = "[secret]" and more'


def test_reliabilities():
    rng, counts = np.random.default_rng(4), {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = tuple(0 if rng.random() < 0.3 else (1 if truth else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    post, rates = pii.expectation_maximisation(sorted(counts.items()))
    right = [(r[1][1] + r[-1][0]) / (r[1][0] + r[1][1] + r[-1][0] + r[-1][1]) for r in rates]
    assert right[0] > right[2] and right[1] > right[2] and post[1, 1, 1] > 0.9 > 0.1 > post[-1, -1, -1]
