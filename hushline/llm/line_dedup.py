"""Exact line deduplication that can be extended and undone.

A ``LineIndex`` keeps, per 128-bit key of a normalised line, the documents that hold it (``postings``) and their number
with the largest id (``refs``), the exact reference-count table.  Keys are dealt over shards by hash, and each shard has
a cuckoo filter of its keys.  An insertion asks the filters first: a key that no filter knows is new and is appended to the
tables unseen, and only the other keys are looked up in them.  ``build`` too inserts its documents in parts, so all results
come through the filters.  Filters of shards without new keys stay; when shards grow beyond ``KEYS_PER_SHARD`` keys, all are
dealt anew.  Deleting documents lowers the counts and takes keys that nobody holds out of
the filters, so the index equals one that never saw those documents.

A line's key is the line without blanks at its ends and with A-Z lowered; keys of fewer than ``min_chars`` code points
are not indexed.  Edge cases: a null or empty text is one empty line; documents with a null id count as one document,
which is never the largest; repeated rows of a document count once and all get the same result; an id whose rows have
different texts holds the lines of all of them; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushline.llm.common import BLANKS, ascii_lower, salted_join, stored, text_of

MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 200_000
#: Parts in which ``build`` inserts a table.
BATCHES = 2
SLOTS = 4
KEY = ["k1", "k2"]


# --- cuckoo filters: numpy tables of 16-bit marks, four slots a bucket ---

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _mark(k2: np.ndarray) -> np.ndarray:
    return (_mixed(k2) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def _other(bucket: np.ndarray, mark: np.ndarray, buckets: int) -> np.ndarray:
    return bucket ^ (_mixed(mark.astype(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)


def _home(k1: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(k1) & np.uint64(buckets - 1)).astype(np.int64)


def cuckoo_add(table: np.ndarray, k1: np.ndarray, k2: np.ndarray, rounds: int = 500) -> bool:
    """Add distinct keys in place, all keys at a time in rounds; False if some found no place."""
    buckets = len(table)
    at, mark, rng = _home(k1, buckets), _mark(k2), np.random.default_rng(7)
    for turn in range(rounds):
        if not len(at):
            return True
        order = np.argsort(at, kind="stable")
        at, mark = at[order], mark[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        free = (table == 0)
        fits = rank < free[at].sum(1)
        spot = np.argsort(~free[at[fits]], axis=1, kind="stable")[np.arange(fits.sum()), rank[fits]]
        table[at[fits], spot] = mark[fits]
        at, mark = at[~fits], mark[~fits]
        if turn:  # both buckets were full: one key of each bucket changes places with a random one, which then tries its other bucket
            _, first = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(first))
            out = table[at[first], slot].copy()
            table[at[first], slot] = mark[first]
            mark[first] = out
        at = _other(at, mark, buckets)
    return not len(at)


def cuckoo_has(table: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    at, mark = _home(k1, len(table)), _mark(k2)
    return (table[at] == mark[:, None]).any(1) | (table[_other(at, mark, len(table))] == mark[:, None]).any(1)


def cuckoo_drop(table: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> None:
    """Take out keys that were added; each takes one equal mark of its two buckets."""
    home, mark = _home(k1, len(table)), _mark(k2)
    for a, b, m in zip(home, _other(home, mark, len(table)), mark, strict=True):
        for bucket in (a, b):
            hit = np.flatnonzero(table[bucket] == m)
            if len(hit):
                table[bucket, hit[0]] = 0
                break


def _new_table(keys: int) -> np.ndarray:
    buckets = 1
    while buckets * SLOTS * 0.85 < keys:
        buckets *= 2
    return np.zeros((buckets, SLOTS), np.uint16)


def _unsigned(x: pd.Series) -> np.ndarray:
    return x.to_numpy(np.int64).view(np.uint64)


def _read(filters: pd.DataFrame) -> np.ndarray | None:
    return np.frombuffer(filters["cells"].iloc[0], np.uint16).reshape(-1, SLOTS).copy() if len(filters) else None


def _grown(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with its new keys; ``keys`` has all others too, for the case that it is full."""
    new = keys[keys["new"]]
    table = _read(filters)
    if table is None:
        table = _new_table(len(new))
    if not cuckoo_add(table, _unsigned(new["k1"]), _unsigned(new["k2"])):
        room = max(len(keys), 1)
        while True:
            table = _new_table(room)
            if cuckoo_add(table, _unsigned(keys["k1"]), _unsigned(keys["k2"])):
                break
            room = table.size
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "cells": [table.tobytes()]})


def _probe(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    table = _read(filters)
    known = np.zeros(len(keys), bool) if table is None else cuckoo_has(table, _unsigned(keys["k1"]), _unsigned(keys["k2"]))
    return keys.assign(known=known)


def _shrunk(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    table = _read(filters)
    if table is None:
        return pd.DataFrame({"shard": [], "cells": []})
    cuckoo_drop(table, _unsigned(keys["k1"]), _unsigned(keys["k2"]))
    return pd.DataFrame({"shard": [int(filters["shard"].iloc[0])], "cells": [table.tobytes()]})


# --- lines and the index ---

def stripped(line: Column) -> Column:
    """The line without blanks at its ends; most lines have none, which their first and last characters tell."""
    ends = F.substring(line, 1, 1).isin(list(BLANKS)) | F.substring(line, -1, 1).isin(list(BLANKS))
    return F.when(ends, F.btrim(line, F.lit(BLANKS))).otherwise(line)


def line_key(line: Column) -> Column:
    """The key of a stripped line.  ``lower`` is much faster than a translation, and the same on texts of one byte a character."""
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(ascii_lower(line))


def line_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per indexed line: id, hash of the text, position (from 0), both halves of the key."""
    whole = text_of(docs, text)
    # a text is hashed before its lines are taken apart, not again with each of them
    rows = docs.select(docs[id].alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    rows = rows.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select("doc_id", "text_hash", "pos", stripped(F.col("line")).alias("line")).where(F.length("line") >= min_chars)
    return rows.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit(1)).alias("k2"))


@dataclass(frozen=True)
class LineIndex:
    """Tables in the shared folder; every change returns a new index and leaves the old one as it was."""

    postings: DataFrame  # shard, k1, k2, doc_id
    refs: DataFrame  # shard, k1, k2, n_docs, last_doc
    filters: DataFrame  # shard, cells
    shards: int
    min_chars: int = MIN_CHARS
    keys_per_shard: int = KEYS_PER_SHARD

    @staticmethod
    def empty(spark: SparkSession, shards: int, min_chars: int = MIN_CHARS, id_type: str = "bigint", keys_per_shard: int = KEYS_PER_SHARD) -> "LineIndex":
        table = lambda schema: spark.createDataFrame([], schema)
        return LineIndex(table(f"shard int, k1 bigint, k2 bigint, doc_id {id_type}"), table(f"shard int, k1 bigint, k2 bigint, n_docs bigint, last_doc {id_type}"),
                         table("shard int, cells binary"), shards, min_chars, keys_per_shard)

    @staticmethod
    def build(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> "LineIndex":
        """Index of all documents, inserted in ``batches`` parts by a hash of the id, so that all but the first go through the filters."""
        part = F.pmod(F.xxhash64(docs[id], F.lit(3)), F.lit(batches))
        index = LineIndex.empty(docs.sparkSession, 1, min_chars, docs.schema[id].dataType.simpleString())
        for k in range(batches):
            index = index.insert(docs.where(part == k), id, text, 1 if k else batches)
        return index

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("k1"), F.lit(self.shards)).cast("int")

    def probe(self, keys: DataFrame) -> DataFrame:
        """Distinct keys with ``known``: false only if the index surely lacks the key."""
        keys = keys.select(self._shard().alias("shard"), *KEY)
        return keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_probe, "shard int, k1 bigint, k2 bigint, known boolean")

    def _resharded(self, keys: int) -> "LineIndex":
        """As many shards as so many keys need; all filters are built anew if that is more than before."""
        shards = -(-keys // self.keys_per_shard)
        if shards <= self.shards:
            return self
        wide = replace(self, shards=2 * shards if self.shards > 1 else shards)
        moved = lambda df, name: stored(df.drop("shard").select(wide._shard().alias("shard"), *[c for c in df.columns if c != "shard"]), name)
        wide = replace(wide, postings=moved(self.postings, "postings"), refs=moved(self.refs, "refs"), filters=self.filters.where("false"))
        return replace(wide, filters=wide._with_keys(wide.refs.withColumn("new", F.lit(True))))

    def _with_keys(self, refs: DataFrame) -> DataFrame:
        """Filters with the keys added that are ``new`` in refs; those of other shards stay as they are."""
        touched = stored(refs.where("new").select("shard").distinct(), "touched")
        keys = refs.select("shard", *KEY, "new").join(touched, "shard", "left_semi")
        grown = keys.groupBy("shard").cogroup(self.filters.join(touched, "shard", "left_semi").groupBy("shard")).applyInPandas(_grown, "shard int, cells binary")
        return stored(self.filters.join(touched, "shard", "left_anti").unionByName(grown), "filters")

    def insert(self, docs: DataFrame, id: str = "doc_id", text: str = "text", room: int = 1) -> "LineIndex":
        """Add documents.  Rows that the index holds already change nothing; ``room`` makes shards for so many times their keys.

        Keys that no filter knows are new: they are counted alone and appended.  Only the others are looked up in the
        exact tables.
        """
        raw = stored(_held(docs, id, text, self.min_chars), "batch")
        keys = raw.agg(F.approx_count_distinct("k1")).first()[0]
        self = self._resharded(self.refs.count() + keys * room)
        held, refs, postings = raw.withColumn("shard", self._shard()), self.refs.withColumn("new", F.lit(False)), self.postings
        if self.filters.isEmpty():
            fresh = held
        else:
            known = self.probe(held.select(*KEY).distinct())
            held = stored(held.join(known, ["shard", *KEY]), "probed")
            fresh, maybe = held.where(~F.col("known")), held.where("known")
            old = self.postings.withColumnRenamed("doc_id", "_doc")
            added = stored(maybe.join(old, [maybe[c] == old[c] for c in ("shard", *KEY)] + [maybe["doc_id"].eqNullSafe(old["_doc"])], "left_anti").drop("known"), "added")
            more = _counted(added).withColumnsRenamed({"n_docs": "_n", "last_doc": "_last"})
            # a key that a filter knew by mistake is new after all
            refs = self.refs.withColumn("_here", F.lit(True)).join(more, ["shard", *KEY], "full").select(
                "shard", *KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "_last").alias("last_doc"), F.col("_here").isNull().alias("new"))
            postings = postings.unionByName(added.select("shard", *KEY, "doc_id"))
        refs = stored(refs.unionByName(_counted(fresh).withColumn("new", F.lit(True))), "refs")
        return replace(self, postings=stored(postings.unionByName(fresh.select("shard", *KEY, "doc_id")), "postings"), refs=refs.drop("new"), filters=self._with_keys(refs))

    def delete(self, ids: DataFrame, id: str = "doc_id") -> "LineIndex":
        """Take documents out, given their ids."""
        gone_ids = ids.select(ids[id].alias("_gone")).distinct()
        match = self.postings["doc_id"].eqNullSafe(F.col("_gone"))
        touched = stored(self.postings.join(gone_ids, match, "left_semi").select("shard", *KEY).distinct(), "touched")
        left = stored(self.postings.join(gone_ids, match, "left_anti"), "postings")
        again = _counted(left.join(touched, ["shard", *KEY], "left_semi"))
        refs = stored(self.refs.join(touched, ["shard", *KEY], "left_anti").unionByName(again), "refs")
        orphans = touched.join(refs, ["shard", *KEY], "left_anti")
        filters = orphans.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_shrunk, "shard int, cells binary")
        return replace(self, postings=left, refs=refs, filters=stored(filters, "filters"))

    def dropped_lines(self, docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
        """Per (doc_id, text_hash) that loses lines: their positions.

        A line goes if ``min_docs`` documents or more hold its key and this one is not the largest of them.
        """
        often = self.refs.where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc")
        lines = line_keys(docs, id, text, self.min_chars)
        lost = salted_join(lines, often, KEY, F.struct("doc_id", "pos"), "inner").where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))

    def clean(self, docs: DataFrame, id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
        """The documents with their text cleaned, and ``n_lines`` (before) and ``n_dropped``; other columns stay, but for those named so or ``dropped``."""
        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "dropped")]
        lost = self.dropped_lines(docs, id, text, min_docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "dropped")
        rows = docs.select(*names)
        rows = rows.join(lost, rows[id].eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(rows, text)) == F.col("_hash")), "left")
        lines = F.split(text_of(rows, text), "\n")
        # the lines are bound to a variable once, so that taking out many of them stays linear
        kept = F.transform(F.array(lines), lambda all: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all) - 1), "dropped"), lambda i: F.get(all, i)))
        cleaned = F.when(F.col("dropped").isNull(), rows[text]).otherwise(F.array_join(F.get(kept, F.lit(0)), "\n"))
        return rows.select(*[cleaned.alias(c) if c == text else rows[c] for c in names],
                           F.size(lines).cast("bigint").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"))


def _held(docs: DataFrame, id: str, text: str, min_chars: int) -> DataFrame:
    return line_keys(docs, id, text, min_chars).select(*KEY, "doc_id").distinct()


def _counted(held: DataFrame) -> DataFrame:
    return held.groupBy("shard", *KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
