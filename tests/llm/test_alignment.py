"""Cross-tokenizer alignment against a brute force over bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushline.llm import alignment
from hushline.llm.common import stored
from hushline.llm.queries import op11_alignment, pieces_model, vocabulary


def brute(texts):
    """Contract columns of each text, by looking at every byte."""
    import sentencepiece

    coder = Tokenizer.from_file(vocabulary())
    coder.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=pieces_model())
    decode = {v: k for k, v in coder.get_vocab().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    rows, held = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        a = [(i, bytes(back[c] for c in decode[i])) for i in coder.encode(" " + (t or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()) for i in model.encode(t or "")]
        if not t or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() if side else [] for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, links = defaultdict(lambda: ([], [])), []
        for side, tokens in enumerate((a, b)):
            for (i, _), end in zip(tokens, ends[side], strict=True):
                groups[next(c for c in cuts if c >= end)][side].append(i)
        at = 0
        for (i, x), end in zip(a, ends[0], strict=True):
            links += [(i, j) for (j, y), e in zip(b, ends[1], strict=True) if e > end - len(x) and e - len(y) < end]
            at = end
        held.update(set(links))
        text = ";".join(",".join(map(str, groups[c][0])) + "|" + ",".join(map(str, groups[c][1])) for c in cuts)
        rows.append((len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups.values())))
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    return [(na, nb, ng, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha, ns) for na, nb, ng, links, sha, ns in rows]


def test_alignment_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " ", "Hello world", "Hello world", "▁ hidden", "<|endoftext|> <s>", "naïve  café\n\n😀 don't 12345", "a\x00b", "x" * 700, " lead", "word " * 300]
    texts += ["".join(rng.choice(["the ", "é", "\n", "Über", "123", " ", "ing", "😀", "zq"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    path = f"{tmp_path}/documents.parquet"
    rows = list(enumerate(texts)) + [(None, "no id here"), (2**53 + 1, "far id")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS pairs", "3 AS n_a", "'x' AS groups").repartition(3).write.parquet(path)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in op11_alignment(spark, str(tmp_path)).collect()}
    assert got == dict(zip([i for i, _ in rows], brute([t for _, t in rows]), strict=True))


def test_small_blocks_and_products_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the same words and number {i % 7} again" * (1 + i % 3)) for i in range(60)], "doc_id long, text string").coalesce(1)
    big, small = (stored(alignment.align(docs, vocabulary(), pieces_model(), block=n)) for n in (10**9, 100))
    assert small.select("block").distinct().count() > 5
    want, got = (sorted(map(tuple, alignment.with_counts(x).collect())) for x in (big, small))
    assert got == want and len(got) == 60
    one = big.where("doc_id = 9").first()
    assert len(one.links) == 8 * one.n_links and np.frombuffer(one.times, "<u4").sum() == one.n_links
    assert alignment.with_counts(stored(alignment.align(docs.where("false"), vocabulary(), pieces_model()))).count() == 0


def test_row_products_equal_dense_products(monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.random((40, 30)) < 0.2, rng.random((25, 30)) < 0.3
    sparse = lambda m: (np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1])
    for most in (7, 10**6):
        monkeypatch.setattr(alignment, "PRODUCTS", most)
        parts = list(alignment.row_products(sparse(a), alignment.transposed(*sparse(b), 30), 25))
        got = np.zeros((40, 25), int)
        for r, c, n in parts:
            got[r, c] = n
        assert (got == a.astype(int) @ b.T.astype(int)).all() and (len(parts) > 20) == (most == 7)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text[:1500] for r in docs]  # the brute force is quadratic in a text; the query below sees the same texts
    frame = spark.createDataFrame([(r.doc_id, t) for r, t in zip(docs, texts, strict=True)], "doc_id long, text string")
    found = alignment.with_counts(stored(alignment.align(frame, vocabulary(), pieces_model(), links=False).withColumn("sha", F.sha2("groups", 256))))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha, r.n_shared) for r in found.collect()}
    assert got == {r.doc_id: x for r, x in zip(docs, brute(texts), strict=True)}
