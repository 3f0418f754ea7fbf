"""Alignment of two tokenizers over the same text by sparse products of token-byte incidence matrices.

The tokens of each tokenizer cut a text's bytes into ranges.  ``A`` has a row per token of the first and a column per byte,
with a one where the token covers the byte; ``B`` likewise.  Both are built by hand as compressed rows (row starts and column
numbers).  The rows of A times B transposed, made one block of rows at a time by Gustavson's method (merge the rows of the
right matrix that a row of the left one names), are the overlap links.  Bytes at which tokens of both end cut the tokens into
groups; token-group incidences and the same product give the links of tokens that share a group.  The matrices of a batch of
texts stand on one diagonal, so that numpy works on a batch at a time.

Corpus statistics of links: documents are dealt into blocks of about ``BLOCK`` links.  A block tells once for each pair of
ids how many of its documents hold it linked; these rows alone are summed over the corpus, and the sums go back to the blocks
that asked.  So a pair that every document holds costs a row a block, and no pair or id gathers rows in one task.

Edge cases: texts that are null or empty, or whose tokens of either kind do not give the bytes of a space and the text, have
no tokens, zeros everywhere and an empty group string; repeated rows count as documents of their own; a null id stays null;
a text of any length is one row, whose products are made in blocks of rows; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import stored, text_of
from hushline.llm.packing import encoder

#: Links of a block of documents, about; bytes of text put on one diagonal; products of one block of rows.
BLOCK = 2_000_000
DIAGONAL = 1_000_000
PRODUCTS = 4_000_000


# --- sparse matrices: (row starts, column numbers), values of one ---

def from_ends(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that cover the bytes up to their ends, one after another: rows of tokens, columns of bytes."""
    return np.r_[0, ends].astype(np.int64), np.arange(ends[-1] if len(ends) else 0)


def transposed(starts: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows for columns."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.r_[0, np.cumsum(np.bincount(columns, minlength=width))], rows[np.argsort(columns, kind="stable")]


def product_sizes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Products that each row of A times B adds up; where no two fall together, its length."""
    sums = np.r_[0, np.cumsum(np.diff(b[0])[a[1]])]
    return sums[a[0][1:]] - sums[a[0][:-1]]


def row_products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, columns, sums) of A times B, some rows at a time, sorted; B is ``width`` wide."""
    totals, at = np.r_[0, np.cumsum(product_sizes(a, b))], 0
    while at < len(a[0]) - 1:
        to = max(at + 1, int(np.searchsorted(totals, totals[at] + PRODUCTS, side="right")) - 1)
        inner = a[1][a[0][at]:a[0][to]]
        rows = np.repeat(np.arange(at, to), np.diff(a[0][at:to + 1]))
        sizes = b[0][inner + 1] - b[0][inner]
        before = np.cumsum(sizes) - sizes
        columns = b[1][np.repeat(b[0][inner] - before, sizes) + np.arange(sizes.sum())]
        keys = np.repeat(rows, sizes) * width + columns
        if (keys[1:] < keys[:-1]).any():
            keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
        yield keys[first] // width, keys[first] % width, np.diff(np.r_[first, len(keys)])
        at = to


# --- tokens of a batch of texts ---

@functools.lru_cache(2)
def byte_tokens(path: str) -> list[bytes | None]:
    """Bytes of each id of a byte-level vocabulary."""
    code, _ = encoder(path)
    out: list[bytes | None] = [None] * code.n_vocab
    for bytes_ in code.token_byte_values():
        out[code.encode_single_token(bytes_)] = bytes_
    return out


@functools.lru_cache(2)
def pieces(path: str):
    """A ``sentencepiece`` model, once per worker, and the bytes of each of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    written = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return model, [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(written)]


@dataclass
class Side:
    """Tokens of a batch of texts by one tokenizer, laid end to end."""

    ids: np.ndarray
    ends: np.ndarray  # in bytes of the batch
    first: np.ndarray  # place of each text's first token; one more at the end


def _side(tokens: list[list[int]], lengths: np.ndarray) -> Side:
    ids = np.concatenate([np.array(t, np.int64) for t in tokens]) if tokens else np.zeros(0, np.int64)
    return Side(ids, np.cumsum(lengths[ids]), np.r_[0, np.cumsum([len(t) for t in tokens], dtype=np.int64)])


@functools.lru_cache(4)
def _lengths(path: str, of_pieces: bool) -> np.ndarray:
    return np.array([len(x or b"") for x in (pieces(path)[1] if of_pieces else byte_tokens(path))], np.int64)


def tokenised(texts: list[str], a_path: str, b_path: str) -> tuple[Side, Side]:
    """Tokens of both; a text whose tokens do not give its bytes back has none."""
    code, known_a = encoder(a_path)[0], byte_tokens(a_path)
    model, known_b = pieces(b_path)
    a, b = [code.encode_ordinary(" " + t) if t else [] for t in texts], model.encode(texts, num_threads=1)
    for k, t in enumerate(texts):
        raw = (" " + t).encode("utf-8", "replace")
        if not t or b"".join([known_a[i] for i in a[k]]) != raw or b"".join([known_b[i] for i in b[k]]) != raw:
            a[k], b[k] = [], []
    return _side(a, _lengths(a_path, False)), _side(b, _lengths(b_path, True))


@functools.lru_cache(2)
def _written(a_size: int, b_size: int) -> np.ndarray:
    """Ids as text with the mark that follows: an A id within a group, as its last, a B id within, as its last."""
    return np.array([f"{i}{mark}" for size, marks in ((a_size, ",|"), (b_size, ",;")) for mark in marks for i in range(size)], object)


def aligned(a: Side, b: Side, a_size: int, b_size: int) -> dict[str, list]:
    """Per text: numbers of tokens, groups and links, the groups as text, and the links' pairs of ids with their times."""
    n_bytes, texts = int(a.ends[-1]) if len(a.ends) else 0, len(a.first) - 1
    both = np.zeros(n_bytes + 1, np.int8)
    both[a.ends] += 1
    both[b.ends] += 1
    cuts = np.flatnonzero(both == 2)  # ends of the groups
    group_a, group_b = np.searchsorted(cuts, a.ends), np.searchsorted(cuts, b.ends)

    bytes_of_a, tokens_at = from_ends(a.ends), transposed(*from_ends(b.ends), n_bytes)
    rows, columns = [], []
    for r, c, _ in row_products(bytes_of_a, tokens_at, max(len(b.ids), 1)):
        rows.append(r)
        columns.append(c)
    rows, columns = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, columns))
    shared = product_sizes((np.arange(len(a.ids) + 1), group_a), transposed(np.arange(len(b.ids) + 1), group_b, len(cuts)))
    shared = np.r_[0, np.cumsum(shared)]

    # groups as text: each token goes where those before it end
    tokens_a, tokens_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    last_a, last_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    last_a[np.cumsum(tokens_a) - 1] = 1
    last_b[np.cumsum(tokens_b) - 1] = 1
    order = np.zeros(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + (np.cumsum(tokens_b) - tokens_b)[group_a]] = a.ids + a_size * last_a
    order[np.arange(len(b.ids)) + np.cumsum(tokens_a)[group_b]] = b.ids + 2 * a_size + b_size * last_b
    marks, words = a.first + b.first, _written(a_size, b_size)

    link_first = np.searchsorted(rows, a.first)
    codes = a.ids[rows] << 32 | b.ids[columns]
    group_first = np.searchsorted(cuts, np.r_[0, a.ends][a.first], side="right")
    out = {"n_a": np.diff(a.first), "n_b": np.diff(b.first), "n_groups": np.diff(group_first), "n_links": np.diff(link_first), "n_shared": np.diff(shared[a.first]),
           "groups": [], "links": [], "pairs": [], "times": []}
    for k in range(texts):
        out["groups"].append("".join(words[order[marks[k]:marks[k + 1]]].tolist())[:-1])
        mine = slice(link_first[k], link_first[k + 1])
        out["links"].append(np.stack([rows[mine] - a.first[k], columns[mine] - b.first[k]], 1).astype("<u4").tobytes())
        pairs, times = np.unique(codes[mine], return_counts=True)
        out["pairs"].append(pairs.astype("<i8").tobytes())
        out["times"].append(times.astype("<u4").tobytes())
    return out


ALIGNED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups string, links binary, pairs binary, times binary"


def align(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", links: bool = True, block: int = BLOCK) -> DataFrame:
    """(doc_id, block, n_a, n_b, n_groups, n_links, n_shared, groups, links, pairs, times) of every row.

    ``groups`` lists the ids of each group, ``links`` (null unless asked for) the places of linked tokens as pairs of little-
    endian numbers of four bytes, ``pairs`` the distinct linked ids (A's times 2**32 plus B's, eight bytes each), ``times`` how
    often each is linked, and ``n_shared`` the number of links of tokens that share a group.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = len(byte_tokens(a_path)), len(pieces(b_path)[1])
        part, held, number = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            lengths, at = batch["text"].str.len().cumsum().to_numpy(), 0
            while at < len(batch):
                to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + min(DIAGONAL, block), side="right")))
                few = batch.iloc[at:to]
                out = pd.DataFrame(aligned(*tokenised(few["text"].tolist(), a_path, b_path), *sizes))
                if not links:
                    out["links"] = None
                yield out.assign(doc_id=few["doc_id"].to_numpy(), block=part + number)
                held, at = held + int(out["n_links"].sum()), to
                if held >= block:
                    held, number = 0, number + 1

    # ids travel as text: pandas would turn a column with nulls into floats
    out = docs.select(docs[id].cast("string").alias("doc_id"), text_of(docs, text).alias("text")).mapInPandas(rows, f"doc_id string, block bigint, {ALIGNED}")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id].dataType))


# --- corpus statistics ---

def _pairs(raw: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of several rows laid end to end, and where each row starts."""
    return np.frombuffer(b"".join(raw), "<i8"), np.r_[0, np.cumsum(raw.str.len().to_numpy() // 8)].astype(np.int64)


def block_pairs(rows: DataFrame) -> DataFrame:
    """(block, a, b, n): how many documents of a block hold a pair of ids linked."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}  # the rows of a block follow each other in a file

        def told(block: int) -> pd.DataFrame:
            parts = held.pop(block)
            pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
            return pd.DataFrame({"block": block, "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "n": n})

        for batch in batches:
            for block, group in batch.groupby("block", sort=True):
                for other in [x for x in held if x != block]:
                    yield told(other)
                held.setdefault(int(block), []).append(np.unique(_pairs(group["pairs"])[0], return_counts=True))
        for block in list(held):
            yield told(block)

    return rows.select("block", "pairs").mapInPandas(count, "block bigint, a bigint, b bigint, n bigint")


def with_counts(rows: DataFrame) -> DataFrame:
    """Stored rows of ``align`` with ``n_best`` and ``count_sum``.

    A pair's count is the number of documents of the corpus that hold it linked; ``n_best`` are a document's links whose
    count is the highest of their A id, ``count_sum`` the sum of the counts of all its links.
    """
    asked = stored(block_pairs(rows), "block_pairs")
    counts = stored(asked.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("most"))
    known = counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    told = asked.select("block", "a", "b").join(known, ["a", "b"]).select("block", (F.shiftleft("a", 32) + F.col("b")).alias("pair"), "count", "best")
    kept = [c for c in rows.columns if c not in ("links", "pairs", "times", "block")]

    def finish(docs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("pair")
        pairs, first = _pairs(docs["pairs"])
        times = np.frombuffer(b"".join(docs["times"]), "<u4").astype(np.int64)
        at = np.searchsorted(told["pair"].to_numpy(), pairs)
        best = np.r_[0, np.cumsum(times * told["best"].to_numpy()[at])] if len(pairs) else np.zeros(1, np.int64)
        total = np.r_[0, np.cumsum(times * told["count"].to_numpy()[at])] if len(pairs) else np.zeros(1, np.int64)
        return docs[kept].assign(n_best=best[first[1:]] - best[first[:-1]], count_sum=total[first[1:]] - total[first[:-1]])

    slim = rows.select(*[F.col(c).cast("string").alias(c) if c == "doc_id" else F.col(c) for c in kept], "block", "pairs", "times")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*kept).schema)
    out = slim.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(finish, f"{types}, n_best bigint, count_sum bigint")
    return out.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))
