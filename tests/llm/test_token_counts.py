"""Token counts against the library that owns the vocabulary file."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushline.llm import token_counts
from hushline.llm.queries import op13_token_counts, vocabulary


def counts(texts):
    return [len(e.ids) for e in Tokenizer.from_file(vocabulary()).encode_batch(texts, add_special_tokens=False)]


def test_every_character_cuts_as_in_the_library():
    chars = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b 1{c}2 {c}{c} {c}." for c in chars[k:k + 40]) for k in range(0, len(chars), 40)]
    assert token_counts._counted(texts, token_counts.merges(vocabulary()), {}) == counts(texts)


def test_odd_texts(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["", "x" * 5000, "aaa" * 7, "<|endoftext|>", "a <|endoftext|><|endoftext|> b", " " * 301 + "x", "\n\n \t a", "😀" * 50, "the " * 40_000]
    texts += ["".join(rng.choice("ab aé1' \n😀s") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(20_000))]  # one pre-token
    rows = [(k, t) for k, t in enumerate(texts)] + [(-1, None), (None, "no id"), (1, "again"), (1, "again"), (2**53 + 1, "far")]
    want = sorted(zip([i for i, _ in rows], [len((t or "").encode()) for _, t in rows], counts([t or "" for _, t in rows]), strict=True), key=str)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    for slice_, memory in ((100_000, 400_000), (3, 50)):
        monkeypatch.setattr(token_counts, "SLICE", slice_)
        monkeypatch.setattr(token_counts, "MEMORY", memory)
        table, known = token_counts.merges(vocabulary()), {}
        assert token_counts._counted([t or "" for _, t in rows], table, known) == counts([t or "" for _, t in rows])
    assert sorted(map(tuple, token_counts.count_tokens(frame, vocabulary()).collect()), key=str) == want
    assert token_counts.count_tokens(frame.where("false"), vocabulary()).count() == 0


def test_query_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (len((r.text or "").encode()), n, n > 1024) for r, n in zip(docs, counts([r.text or "" for r in docs]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op13_token_counts(spark, sf).collect()} == want
