"""Packing along a space-filling curve.

Texts are tokenised; the counts of their token ids, projected by hashed signs to few dimensions, give a vector, and the
vectors' cell on a Hilbert curve a sort key.  Documents are laid end to end along the curve, and the stream is cut every
``LENGTH`` tokens: neighbours on the curve share sequences, and only the last sequence is padded.

The order is a range sort of slim rows (key, row, tokens); one number per partition goes to the driver to place the
partitions one after another.  Token ids are moved once, to the places found.

The ids are those of the ``tokenizers`` file; since that file's merges are in the order of its ids, ``tiktoken`` gives the
same ids from the same vocabulary several times faster, and is used for that.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each for itself; the strings of special
tokens in a text become these tokens, as the file says; without documents there are no sequences; other columns are
ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import stored, text_of

LENGTH = 2_048
END = 1
DIMENSIONS = 4
LEVELS = 8
# Fixed value: how byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(2)
def encoder(path: str):
    """The byte-level tokenizer of a ``tokenizers`` file, once per worker, and the strings of its special tokens."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"]: t["id"] for t in data.get("added_tokens", []) if t.get("special")}
    # byte-level vocabularies write a byte as a printable character: itself if printable, else one from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(to_byte[c] for c in token): id for token, id in data["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def token_ids(text: str, path: str) -> list[int]:
    code, special = encoder(path)
    return code.encode(text, allowed_special="all") if any(s in text for s in special) else code.encode_ordinary(text)


@functools.lru_cache(2)
def signs(size: int, dimensions: int) -> np.ndarray:
    """A sign for each id and dimension, from a hash."""
    x = np.arange(size * dimensions, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (((x >> np.uint64(40)) & np.uint64(1)).astype(np.float32) * 2 - 1).reshape(size, dimensions)


def tokenised(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", end: int = END, dimensions: int = DIMENSIONS) -> DataFrame:
    """Stored (row, doc_id, n, vector, ids): ids end with ``end`` and are bytes of two or four each, by the vocabulary's size."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, _ = encoder(path)
        kind = np.uint16 if code.n_vocab <= 65536 else np.uint32
        table = signs(code.n_vocab, dimensions)
        for b in batches:
            ids, ns, vectors = [], [], []
            for t in b["text"]:
                one = token_ids(t, path)
                one.append(end)
                one = np.array(one, kind)
                ids.append(one.tobytes())
                ns.append(len(one))
                vectors.append(table[one].sum(0) / len(one))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": ns, "vector": vectors, "ids": ids})

    # ids travel as text: pandas would turn a column with nulls into floats
    rows = docs.select(docs[id].cast("string").alias("doc_id"), text_of(docs, text).alias("text")).mapInPandas(tokens, "doc_id string, n bigint, vector array<float>, ids binary")
    kind = docs.schema[id].dataType
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast(kind).alias("doc_id"), "n", "vector", "ids"), "tokens")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer cells (rows of coordinates below ``2 ** bits``)."""
    x = cells.astype(np.uint64).T.copy()
    one, dims = np.uint64(1), len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of each level, from the coarsest on
        q = one << np.uint64(level)
        low = q - one
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(high, low, swap)
            x[d] ^= swap
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        turn ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << one | (x[d] >> np.uint64(level)) & one
    return key


def placed(tokens: DataFrame, levels: int = LEVELS, dimensions: int = DIMENSIONS) -> DataFrame:
    """(row, at): where each document starts in the stream along the curve.

    Coordinates are cut at approximate quantiles, ``2 ** levels - 1`` numbers a dimension, so that cells are evenly filled.
    """
    slim = tokens.select("row", "n", "vector")
    shares = [k / 2**levels for k in range(1, 2**levels)]
    cuts = slim.agg(*[F.percentile_approx(F.get("vector", F.lit(d)), shares, 10_000).alias(f"c{d}") for d in range(dimensions)]).first()
    edges = [np.array(c if c is not None else [], float) for c in cuts]

    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            v = np.stack(b.to_list()) if len(b) else np.zeros((0, dimensions))
            cells = np.stack([np.searchsorted(e, v[:, d]) for d, e in enumerate(edges)], 1)
            yield pd.Series(hilbert(cells, levels).astype(np.int64))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = 0
        for b in batches:
            total = b["n"].cumsum()
            yield pd.DataFrame({"row": b["row"], "part": b["part"], "local": before + total - b["n"], "n": b["n"]})
            before += int(total.iloc[-1]) if len(b) else 0

    curve = slim.select("row", "n", F.pandas_udf(keys, "bigint")("vector").alias("key")).repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    runs = stored(curve.select("row", "n", F.spark_partition_id().alias("part")).mapInPandas(summed, "row bigint, part int, local bigint, n bigint"), "runs")
    sizes = sorted((r["part"], r["n"]) for r in runs.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one number per partition
    bases = dict(zip([p for p, _ in sizes], np.cumsum([0, *[n for _, n in sizes]]).tolist(), strict=False))
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv]) if bases else F.expr("cast(map() AS map<int,bigint>)")
    return runs.select("row", (F.col("local") + base[F.col("part")]).cast("bigint").alias("at"))


def pieces(tokens: DataFrame, places: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): ids are little-endian numbers of four bytes."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, n, at, raw in zip(b["doc_id"], b["n"], b["at"], b["ids"], strict=True):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    out.append((doc, start, size, n, seq, offset, ids[start:start + size].tobytes()))
                    start += size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = tokens.schema["doc_id"].dataType
    laid = tokens.select("row", F.col("doc_id").cast("string").alias("doc_id"), "n", "ids").join(places, "row").drop("row")
    laid = laid.mapInPandas(cut, "doc_id string, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
    return laid.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """All pieces of all documents, each token in exactly one."""
    tokens = tokenised(docs, path, id, text, end)
    return pieces(tokens, placed(tokens), length)


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): pieces put together; a sequence is padded to ``length`` unless its size is a power of two."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for seq, parts in zip(b["sequence_id"], b["parts"], strict=True):
                ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts]).astype(np.int64)
                n = len(ids)
                out.append((seq, n, ids if n & (n - 1) == 0 else np.pad(ids, (0, length - n), constant_values=pad)))
            yield pd.DataFrame(out, columns=["sequence_id", "n_tokens", "ids"])

    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInPandas(join, "sequence_id bigint, n_tokens bigint, ids array<bigint>")

