"""Token counts of a byte-level BPE by rank-synchronous merging of arrays.

A text is cut at the strings of special tokens, each of which is one token, and the rest into pre-tokens.  Pre-tokens that
this worker has not met yet are held together as one ragged numpy array of symbols, first one a byte.  In each round every
sequence finds its pair of lowest rank and merges all places of that pair at once (of overlapping places the first, third
and so on); sequences without a pair of the vocabulary are done, and their surviving symbols are their tokens.  Merging a
pair makes a symbol that only later ranks use, so that a round gives what merging place by place gives.

Edge cases: a null or empty text has no tokens; repeated rows are counted each for itself; a null id stays null; texts of
any length are walked in slices of pre-tokens; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import text_of

LIMIT = 1_024
#: Pre-tokens whose count a worker remembers; then it starts anew.
MEMORY = 400_000
#: Pre-tokens taken from a text at a time.
SLICE = 100_000
# The white space of the pre-tokeniser, and how it cuts text.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Merges:
    """Merges of a vocabulary as sorted arrays, the first symbol of each byte, and how to cut a text."""

    size: int
    pairs: np.ndarray
    ranks: np.ndarray
    symbols: np.ndarray
    of_byte: np.ndarray
    cut: regex.Pattern
    special: regex.Pattern | None


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    """The merges of a ``tokenizers`` file of a byte-level BPE, once per worker."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if data["model"]["type"] != "BPE" or data.get("normalizer") or (data.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        raise ValueError("a byte-level BPE without a normalizer is needed")
    vocab = data["model"]["vocab"]
    rules = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
    size = max(vocab.values()) + 1
    pairs = np.array([vocab[a] * size + vocab[b] for a, b in rules], np.int64)
    order = np.argsort(pairs, kind="stable")
    symbols = np.array([vocab[a + b] for a, b in rules], np.int64)
    # byte-level vocabularies write a byte as a printable character: itself if printable, else one from 256 on
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    of_byte = np.array([vocab[chr(b if b in plain else next(hidden))] for b in range(256)], np.int64)
    special = [regex.escape(t["content"]) for t in data.get("added_tokens", [])]
    return Merges(size, pairs[order], np.arange(len(rules))[order], symbols[order], of_byte, regex.compile(PATTERN),
                  regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None)


def surviving(words: list[bytes], table: Merges) -> np.ndarray:
    """How many symbols each byte string is left with when no pair can be merged any more."""
    lengths = np.array([len(w) for w in words], np.int64)
    counts = np.zeros(len(words), np.int64)
    name = np.flatnonzero(lengths)  # which word each sequence is
    lengths = lengths[name]
    symbols = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    while len(name):
        starts = np.cumsum(lengths) - lengths
        last = starts + lengths - 1
        keys = symbols * table.size
        keys[:-1] += symbols[1:]
        at = np.minimum(np.searchsorted(table.pairs, keys), len(table.pairs) - 1)
        ranks = np.where(table.pairs[at] == keys, table.ranks[at], _NONE)
        ranks[last] = _NONE  # no pair reaches into the next sequence
        lowest = np.minimum.reduceat(ranks, starts)
        hits = np.flatnonzero((ranks != _NONE) & (ranks == np.repeat(lowest, lengths)))
        if len(hits):
            opens = np.r_[True, np.diff(hits) != 1]  # overlapping places follow each other
            hits = hits[(hits - np.maximum.accumulate(np.where(opens, hits, 0))) % 2 == 0]
            symbols[hits] = table.symbols[at[hits]]
        stays = np.ones(len(symbols), bool)
        stays[hits + 1] = False
        done = lowest == _NONE
        counts[name[done]] = lengths[done]
        lost = np.bincount(np.searchsorted(starts, hits, side="right") - 1, minlength=len(name)) if len(hits) else 0
        stays &= np.repeat(~done, lengths)
        symbols, lengths, name = symbols[stays], (lengths - lost)[~done], name[~done]
    return counts


def _counted(texts: list[str], table: Merges, memory: dict[str, int]) -> list[int]:
    """Tokens of each text; ``memory`` has the counts of pre-tokens met before."""
    totals = [0] * len(texts)
    pending: list[tuple[int, list[str]]] = []
    waiting, unknown = 0, set()

    def settle() -> None:
        nonlocal waiting, unknown
        if unknown:
            new = list(unknown)
            memory.update(zip(new, surviving([w.encode("utf-8", "replace") for w in new], table).tolist(), strict=True))
        for k, words in pending:
            totals[k] += sum(map(memory.__getitem__, words))
        if len(memory) > MEMORY:
            memory.clear()
        pending.clear()
        waiting, unknown = 0, set()

    for k, text in enumerate(texts):
        parts = [text]
        if table.special is not None:
            parts = table.special.split(text)
            totals[k] += len(parts) - 1
        for part in parts:
            found = (m.group() for m in table.cut.finditer(part)) if len(part) > 10 * SLICE else iter(table.cut.findall(part))
            while words := list(islice(found, SLICE)):
                pending.append((k, words))
                unknown.update(w for w in words if w not in memory)
                waiting += len(words)
                if waiting > 10 * SLICE:
                    settle()
    settle()
    return totals


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row: bytes of the text in UTF-8, and its tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, memory = merges(path), {}
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": _counted(b["text"].tolist(), table, memory)})

    # ids travel as text: pandas would turn a column with nulls into floats
    whole = text_of(docs, text)
    rows = docs.select(docs[id].cast("string").alias("doc_id"), F.octet_length(whole).cast("bigint").alias("n_bytes"), whole.alias("text"))
    rows = rows.mapInPandas(count, "doc_id string, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id].dataType))
