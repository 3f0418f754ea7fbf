"""Quality rules over lines that many documents of a host share.

Lines are normalised (A-Z lowered, runs of digits to 0, runs of blanks to one space, trimmed) and hashed.  Per host,
the documents that hold a line are counted; lines of more documents than the limit are removed, and a document that
keeps too small a share of its words is rejected.

Edge cases: a null text is empty and has no words; a null host is a host of its own; rows with the same id and text are
one document in the counts but keep their own result rows; a document without words is depleted only if ``min_words``
says so, as it loses nothing.  Other columns are ignored by ``judge_lines`` and kept by ``remove_lines``.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import LOWER, UPPER, salted_join, stored, text_of

MAX_DOCS = 20
MIN_KEPT = 0.5
SYMBOLS = "#*$%&|<>"
_FOLD = str.maketrans(UPPER, LOWER)
_DIGITS, _BLANKS = re.compile("[0-9]+"), re.compile("[\x20\x09\x0b-\x0d]+")
_MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_LINES = "array<struct<line_hash: binary, n_words: int>>"


def line_hashes(text: str) -> list[bytes]:
    """Hash of every normalised line, in order; empty bytes for a line without words."""
    folded = _BLANKS.sub(" ", _DIGITS.sub("0", text.translate(_FOLD)))
    return [xxhash.xxh3_128_digest(x) if (x := line.strip(" ")) else b"" for line in folded.split("\n")]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in ``size``-word windows that occur twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    keys, many = ids[:n], len(number)
    for k in range(1, size):
        keys = keys * many + ids[k:n + k]
        if many ** 3 > 2 ** 62:  # keep the products within 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k:n + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six ASCII blanks
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    held: dict[bytes, int] = {}
    if words:
        for h, line in zip(line_hashes(text), text.split("\n"), strict=True):
            if h:
                held[h] = held.get(h, 0) + len(line.encode("utf-8", "surrogatepass").split())
    return (len(words), len(text) - blanks, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
            [{"line_hash": h, "n_words": n} for h, n in held.items()])


def _measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _MEASURES.split(", ")] + ["lines"]
    for batch in texts:
        yield pd.DataFrame([measure(t) for t in batch], columns=names)


def judge_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS,
                min_kept: float = MIN_KEPT) -> DataFrame:
    """One row per document: measures of its words and lines, ``n_removed_words``, ``removed_lines`` (hashes) and ``depleted``.

    One pass reads the texts; what follows moves hashes and counts only.  The distinct (host, line, document) rows are
    counted in two steps, so a line in a third of all documents is summed up before it meets in one task, and the
    join of lines with the frequent ones is salted.
    """
    seen = docs.select(docs[id].alias("doc_id"), docs[host].alias("host"), F.xxhash64(text_of(docs, text)).alias("text_hash"), F.pandas_udf(_measured, f"{_MEASURES}, lines {_LINES}")(text_of(docs, text)).alias("m"))
    seen = stored(seen.select(F.monotonically_increasing_id().alias("row"), "doc_id", "host", "text_hash", "m.*"), "lines")
    lines = seen.select("row", "doc_id", "host", "text_hash", F.explode("lines").alias("l")).select("row", "doc_id", "host", "text_hash", "l.line_hash", "l.n_words")
    frequent = (lines.groupBy("host", "line_hash", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "line_hash").count()
                .where(F.col("count") > max_docs).select("host", "line_hash", F.lit(True).alias("frequent")))
    removed = (salted_join(lines, frequent, ["host", "line_hash"], F.col("row"), "inner").groupBy("row")
               .agg(F.sum("n_words").alias("n_removed_words"), F.collect_list("line_hash").alias("removed_lines")))
    out = seen.drop("lines").join(removed, "row", "left")
    lost = F.coalesce("n_removed_words", F.lit(0))
    return out.select("doc_id", "host", "text_hash", *[x.split()[0] for x in _MEASURES.split(", ")], lost.alias("n_removed_words"), "removed_lines",
                      ((lost > 0) & (F.col("n_words") - lost < min_kept * F.col("n_words"))).alias("depleted"))


def _without(texts: pd.Series, removed: pd.Series) -> pd.Series:
    def clean(text: str, hashes) -> str:
        if hashes is None or not len(hashes):
            return text
        gone = {bytes(h) for h in hashes}
        return "\n".join(line for h, line in zip(line_hashes(text), text.split("\n"), strict=True) if h not in gone)

    return pd.Series([clean(t, h) for t, h in zip(texts, removed, strict=True)])


def remove_lines(docs: DataFrame, judged: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not depleted, with the frequent lines taken out of their texts."""
    keyed = docs.withColumn("_text_hash", F.xxhash64(text_of(docs, text)))
    marks = judged.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("removed_lines").alias("_removed"), F.col("depleted").alias("_depleted")).dropDuplicates(["_id", "_hash"])
    joined = keyed.join(marks, keyed[id].eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left").where(~F.coalesce("_depleted", F.lit(False)))
    return joined.withColumn(text, F.pandas_udf(_without, "string")(text_of(joined, text), F.col("_removed"))).select(*docs.columns)
