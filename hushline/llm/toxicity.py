"""Toxicity by multiple-instance learning: sentence scores are trained from document labels.

A sentence's evidence is the sum of the weights of its distinct hashed features, which are its words and their openings
with the word's length.  Its score is the logistic of that sum and a fixed bias, less a floor, so a sentence with
little evidence, none, or evidence against scores 0.  A document's score combines its sentences and one fitted
leak per document by noisy-or, ``1 - (1 - leak) * prod(1 - p)``: labels without a telling word raise the leak, which does
not grow with the number of sentences.  The document's log loss flows back through that product to the sentences, so
the weights learn which sentences explain a toxic label, and the scores then point at the offending sentences.

Edge cases: a null or empty text has no sentence with words, hence the score 0; labels of null are not learned from; if
either class is missing from the labels, the first leak alone remains and all scores are near 0; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import place_of, text_of, token_hashes
from hushline.llm.quality import labelled

BITS = 18
#: At most about so many labelled rows are fitted, those with the lowest hashes of their ids.
MAX_TRAINING_ROWS = 10_000
BIAS = -7.0
#: A sentence of a lower logistic has no evidence: weights of mere chance must not add up over a long text.
FLOOR = 0.02
THRESHOLD = 0.5
OPENINGS = (5, 7)
_PARTS = re.compile(r"\w+|[.!?\n]+")
_SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")


def _shapes(word: str) -> list[str]:
    return [f"{word[:k]}#{len(word)}#{k}" for k in OPENINGS]


def words_of(text: str, memo: dict) -> np.ndarray:
    """Distinct (sentence, feature place) pairs as ``sentence << BITS | place``; sentences without words are not counted."""
    parts = _PARTS.findall(text.lower())
    ends = np.fromiter((p[0] in ".!?\n" for p in parts), bool, len(parts))
    sentence = np.cumsum(ends)[~ends]
    if not len(sentence):
        return np.zeros(0, np.int64)
    sentence = np.concatenate([[0], np.cumsum(np.diff(sentence) > 0)])
    places = np.array(token_hashes(memo, [p for p, e in zip(parts, ends, strict=True) if not e], BITS, _shapes), np.int64)
    return np.unique(np.repeat(sentence, 1 + len(OPENINGS)) << BITS | places)


def evidence_scores(sums: np.ndarray) -> np.ndarray:
    """Sentence scores from sums of weights: what the logistic has above its floor, scaled to reach 1."""
    return np.maximum((1 / (1 + np.exp(-np.clip(sums + BIAS, -35, 35))) - FLOOR) / (1 - FLOOR), 0)


def sentence_scores(pairs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return np.zeros(0)
    return evidence_scores(np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)]))


def noisy_or(p: np.ndarray, leak: float) -> float:
    """A document's score from those of its sentences and the logit of the leak; 0 without sentences."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum() - np.logaddexp(0, leak))) if len(p) else 0.0


def _sums(keys: np.ndarray, values: np.ndarray, at: np.ndarray, size: int, block: int = 1 << 20) -> np.ndarray:
    """Per key the sum of ``values[at]``, block by block, so that no long array of floats is made."""
    out = np.zeros(size)
    for k in range(0, len(keys), block):
        out += np.bincount(keys[k:k + block], values[at[k:k + block]], size)
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 200, rate: float = 0.8, l1: float = 0.5) -> np.ndarray:
    """Weights, the logit of the leak last, by AdaGrad over all documents with an L1 pull on features; those of a single document are left out.

    A document is the places of all its sentences, one after another, and their numbers per sentence.
    """
    size = 1 << BITS
    in_docs = np.zeros(size, np.int32)
    for places, _ in docs:
        in_docs[np.unique(places)] += 1
    used = np.flatnonzero(in_docs > 1)
    column_of = np.full(size, -1, np.int32)
    column_of[used] = np.arange(len(used), dtype=np.int32)
    per_sentence = np.concatenate([c for _, c in docs]).astype(np.int64) if docs else np.zeros(0, np.int64)
    of_doc = np.repeat(np.arange(len(docs)), [len(c) for _, c in docs])
    row = np.repeat(np.arange(len(per_sentence), dtype=np.int32), per_sentence)
    column = np.concatenate([column_of[p] for p, _ in docs]) if docs else np.zeros(0, np.int32)
    keep = column >= 0
    row, column = row[keep], column[keep]
    w, grads, leak = np.zeros(len(used)), np.full(len(used), 1e-3), BIAS
    filled = np.bincount(of_doc, minlength=len(docs)) > 0
    for _ in range(steps if 0 < labels.sum() < len(labels) else 0):
        sums = _sums(row, w, column, len(of_doc))
        p = 1 / (1 + np.exp(-np.clip(BIAS + sums, -35, 35)))
        clean = np.bincount(of_doc, np.log1p(-np.minimum(evidence_scores(sums), 1 - 1e-12)), len(docs)) - np.logaddexp(0, leak) * filled
        toxic = np.maximum(-np.expm1(clean), 1e-9)
        # d loss / d sum: p for a clean document, -p (1 - P) / P for a toxic one; also where the score is cut at 0, so that weights can come back
        pull = np.where(labels == 1, -np.exp(clean) / toxic, 1.0)
        g = p * pull[of_doc]
        gw = _sums(column, g, row, len(used))
        grads += gw * gw
        step = rate / np.sqrt(grads)
        w -= step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        # the leak becomes the mean of how far it explains a label (expectation-maximisation)
        rate_of = np.clip((filled * (labels == 1) / toxic).sum() / (1 + np.exp(-leak)) / max(1, filled.sum()), 1e-6, 1 - 1e-6)
        leak = float(np.log(rate_of / (1 - rate_of)))
    out = np.zeros(size + 1, np.float32)
    out[used], out[-1] = w, leak
    return out


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict = {}
    for b in batches:
        pairs = [words_of(t, memo) for t in b["text"]]
        yield pd.DataFrame({"ord": b["ord"], "label": b["label"], "places": [(p & ((1 << BITS) - 1)).astype(np.uint32).tobytes() for p in pairs],
                            "counts": [np.bincount(p >> BITS).astype(np.uint32).tobytes() for p in pairs]})


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["ord", "label", "places"])
    docs = [(np.frombuffer(p, np.uint32), np.frombuffer(c, np.uint32)) for p, c in zip(rows["places"], rows["counts"], strict=True)]
    return pd.DataFrame({"weights": [fit(docs, rows["label"].to_numpy()).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", at_most: int = MAX_TRAINING_ROWS, id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights fitted on the labelled rows outside the held-out fold; the bags of the bounded sample meet in one task."""
    rows = labelled(docs, labels, label, at_most, id, text).mapInPandas(_bags, "ord bigint, label int, places binary, counts binary")
    fitted = rows.groupBy(F.lit("all")).applyInPandas(_fit, "weights binary").first()
    return np.frombuffer(fitted["weights"], np.float32) if fitted else np.concatenate([np.zeros(1 << BITS, np.float32), [np.float32(BIAS)]])


class _Weighted(dict):
    """Part of a text to its places with a weight, in most cases none; None for the end of a sentence.  Made on first use, emptied when large."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, part: str):
        if len(self) > 600_000:
            self.clear()
        places = None if part[0] in ".!?\n" else tuple(h for h in place_of([part, *_shapes(part)], BITS) if self.weights[h])
        self[part] = places
        return places


def weighted_scores(text: str, table: _Weighted) -> np.ndarray:
    """What ``sentence_scores`` gives for all features, from those with a weight only: after an L1 fit they are few."""
    found, sentence, fresh = {}, -1, True
    for places in [table[p] for p in _PARTS.findall(text.lower())]:
        if places is None:
            fresh = True
            continue
        if fresh:
            sentence, fresh = sentence + 1, False
        if places:
            found.setdefault(sentence, set()).update(places)
    sums = np.zeros(sentence + 1)
    for k, places in found.items():
        sums[k] = float(table.weights[list(places)].sum(dtype=float))
    return evidence_scores(sums)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with the document's score.  The weights have a fixed size (1 MB) and are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _Weighted(shared.value)
        for texts in batches:
            yield pd.Series([noisy_or(weighted_scores(t, table), float(shared.value[-1])) for t in texts], dtype=float)

    return docs.withColumn(out, F.pandas_udf(scored, "double")(text_of(docs, text)))


def locate(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "toxic_sentences", at_least: float = THRESHOLD) -> DataFrame:
    """The rows with the sentences that score ``at_least``: start and end in code points, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def found(texts: pd.Series) -> pd.Series:
        memo: dict = {}

        def of(t: str) -> list[dict]:
            p = sentence_scores(words_of(t, memo), shared.value)
            return [{"start": m.start(), "end": m.end(), "score": float(s)} for m, s in zip(_SENTENCE.finditer(t), p, strict=True) if s >= at_least]

        return pd.Series([of(t) for t in texts])

    return docs.withColumn(out, F.pandas_udf(found, "array<struct<start:int,end:int,score:double>>")(text_of(docs, text)))
