"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its word and symbol runs, their bigrams, and repeated neighbours (a token equal to one of the two
before it), hashed into ``2 ** BITS`` places; a text's vector is its counts over the root of their sum.  FTRL-proximal
(per-coordinate rates, L1 and L2) fits the weights on a bounded sample of labelled rows; scoring is a sparse dot product in
one pass without a shuffle.

Edge cases: a null or empty text has no features and gets the score of the bias; labels of null are not learned from;
several labels of one id all count; without any labelled row every score is 0.5; extra columns stay where a function
returns the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import held_out, sample_by_hash, text_of, token_hashes

BITS = 20
#: At most about so many labelled rows are fitted, those with the lowest hashes of their ids.
MAX_TRAINING_ROWS = 8_000
_TOKENS = re.compile(r"\w+|[^\w\s]+")


def features(text: str, memo: dict) -> np.ndarray:
    """Places of all features of a text, with repetitions."""
    h = np.array(token_hashes(memo, _TOKENS.findall(text.lower()), BITS), np.int64)
    if not len(h):
        return h
    mask = (1 << BITS) - 1
    pairs = (h[:-1] * 1000003 + h[1:] * 8191 + 17) & mask
    again = np.array([11, 12], np.int64).repeat([(h[1:] == h[:-1]).sum(), (h[2:] == h[:-2]).sum()])
    return np.concatenate([h, pairs, again])


def dot(places: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[-1] + (weights[places].sum() / np.sqrt(len(places)) if len(places) else 0.0))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, epochs: int = 4) -> np.ndarray:
    """Weights, the bias last, from rows of (places, values, label)."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, label in rows:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - rate * w
            n[at] += g * g
    return weights(np.arange(size)).astype(np.float32)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict = {}
    for b in batches:
        out = []
        for ord, label, text in zip(b["ord"], b["label"], b["text"], strict=True):
            at, n = np.unique(features(text, memo), return_counts=True)
            out.append((ord, label, at.astype(np.uint32).tobytes(), (n / np.sqrt(max(n.sum(), 1))).astype(np.float32).tobytes()))
        yield pd.DataFrame(out, columns=["ord", "label", "places", "counts"])


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ord", "label", "places"])
    data = [(np.frombuffer(p, np.uint32).astype(np.int64), np.frombuffer(c, np.float32).astype(float), int(y)) for y, p, c in zip(rows["label"], rows["places"], rows["counts"], strict=True)]
    return pd.DataFrame({"weights": [ftrl(data).tobytes()]})


def labelled(docs: DataFrame, labels: DataFrame, label: str, at_most: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(ord, label, text) of a bounded sample of labelled rows that are not held out.

    The sample of labels is broadcast: it has about ``at_most`` rows of two numbers.
    """
    known = labels.where(~held_out(F.col(id)) & F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"))
    picked = F.broadcast(sample_by_hash(known, "_id", at_most, known.count()))
    texts = docs.select(docs[id].alias("_doc"), text_of(docs, text).alias("text"))
    return texts.join(picked, F.col("_doc") == F.col("_id")).select(F.xxhash64("_id").alias("ord"), F.col("_label").alias("label"), "text")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", at_most: int = MAX_TRAINING_ROWS, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights fitted on the labelled rows outside the held-out fold; sparse vectors of the bounded sample meet in one task."""
    rows = labelled(docs, labels, label, at_most, id, text)
    vectors = rows.mapInPandas(_vectors, "ord bigint, label int, places binary, counts binary")
    fitted = vectors.groupBy(F.lit("all")).applyInPandas(_fit, "weights binary").first()
    return np.frombuffer(fitted["weights"], np.float32) if fitted else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1.  The weights have a fixed size (4 MB) and are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict = {}
        for texts in batches:
            logits = np.array([dot(features(t, memo), shared.value) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-logits)))

    return docs.withColumn(out, F.pandas_udf(scored, "double")(text_of(docs, text)))
