"""Groups of near copies: word shingles, SimHash comparison in tiles, and an exact check of the similarity.

Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; a group is what such
links connect.  Fingerprints alone are no sure way to them (measured: 3 to 17 of 64 bits differ), and within that radius
tiles of all fingerprints would have to be compared with nearly all others.  So fingerprints are compared within buckets:

* Texts of equal shingle sets are one set.  Each set shows its first fifth of shingles, and one more, in an order that all
  sets share: two sets that are similar enough show a shingle in common, so they meet in its bucket.  The order puts last
  what many texts share, by a table of ``CELLS`` counts of shingles that occur again nearby; any such order is as sure.
* In each bucket all sets are first held against the one with the lowest key; a large group of near copies thus costs rows in
  proportion to its size.  Links are merged to components.
* Buckets that still hold several components are cut into tiles.  Pairs of tiles whose population counts differ by more than
  the radius are skipped; the others are compared by exclusive-or and bit counts, and pairs within the radius that are not
  connected yet are checked exactly.  Only such pairs are ever made.

``RADIUS`` is 20 bits: at a similarity of 0.8 about 10 bits differ, more than 20 in about one pair of 10,000.  All other
steps lose nothing; shingles and sets are told apart by hashes of 64 bits.

Edge cases: a null text is empty; texts without words are one group; with fewer words than a shingle the whole sequence is one
shingle; repeated rows each get their result; null ids come last among a group's ids; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import salted_join, stored, text_of
from hushline.llm.simhash import SEED, bits_of, merged, shingle_hashes
from hushline.operators import skew

SHINGLE = 5
#: A similarity of 4 / 5.
PART, WHOLE = 4, 5
RADIUS = 20
CELLS = 1 << 20
TILE = 1_024
#: Buckets of so many sets are joined with themselves; larger ones are compared in tiles.
SMALL = 32
#: Shingles looked at together when repeats are counted.
NEARBY = 2_000_000


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough; two empty sets are."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def shown(size: int) -> int:
    """How many shingles of a set must be shown so that a similar set shows one of them too."""
    return size - (PART * size + WHOLE - 1) // WHOLE + 1 if size else 0


def repeats(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each of ``CELLS`` ranges of hashes, how often shingles occur that occur again nearby; of this size always."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size = [], 0
            for k, t in enumerate(b["text"]):
                held.append(np.unique(shingle_hashes(t, SHINGLE)))
                size += len(held[-1])
                if size >= NEARBY or k == len(b) - 1:
                    grams, n = np.unique(np.concatenate(held), return_counts=True)
                    cells, where = np.unique((grams[n > 1] >> np.uint64(44)).astype(np.int64), return_inverse=True)
                    yield pd.DataFrame({"cell": cells, "n": np.bincount(where, n[n > 1], minlength=len(cells)).astype(np.int64)})
                    held, size = [], 0

    counts = docs.select(text_of(docs, text).alias("text")).mapInPandas(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CELLS, np.int64)
    out[counts["cell"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return np.minimum(out, 2**32 - 1).astype(np.uint32)


def shingle_sets(docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, sid, fp, n, first) of every row: key, fingerprint and size of its set, and the shingles it shows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sids, fps, sizes, firsts = [], [], [], []
            for t in b["text"]:
                hashes = shingle_hashes(t, SHINGLE)
                grams = np.unique(hashes)
                order = np.argsort(weights[(grams >> np.uint64(44)).astype(np.int64)], kind="stable")
                sids.append(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)))
                fps.append(np.uint64(bits_of(hashes)))
                sizes.append(len(grams))
                firsts.append(grams[order[:shown(len(grams))]].view(np.int64))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_hash": b["text_hash"], "sid": signed(sids), "fp": signed(fps), "n": sizes, "first": firsts})

    whole = text_of(docs, text)
    # ids travel as text: pandas would turn a column with nulls into floats
    out = docs.select(docs[id].cast("string").alias("doc_id"), F.xxhash64(whole).alias("text_hash"), whole.alias("text"))
    out = out.mapInPandas(rows, "doc_id string, text_hash bigint, sid bigint, fp bigint, n bigint, first array<bigint>")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id].dataType))


def _buckets(sets: DataFrame) -> DataFrame:
    """Stored (bucket, sid, leader, size): sets that show the same shingle; buckets of the same sets are one."""
    shows = sets.select("sid", F.explode("first").alias("bucket"))
    named = shows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("leader"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("_same"))
    named = named.where("size > 1").groupBy("size", "leader", "_same").agg(F.min("bucket").alias("bucket")).drop("_same")
    return stored(shows.join(named, "bucket").select("bucket", "sid", "leader", "size"), "buckets")


def _close(fp: str, other: str, n: str, m: str):
    """Pairs that may be similar, by their fingerprints and sizes."""
    return (F.bit_count(F.col(fp).bitwiseXOR(F.col(other))) <= RADIUS) & (WHOLE * F.least(n, m) >= PART * F.greatest(n, m))


def _grams(docs: DataFrame, rows: DataFrame, sids: DataFrame, id: str, text: str) -> DataFrame:
    """Stored (sid, grams): whole sets of the given keys, from one text each."""
    one = rows.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct(F.xxhash64("doc_id").alias("_i"), F.col("text_hash").alias("_t"))).alias("_row")).select("sid", "_row.*")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sid": b["sid"], "grams": [np.unique(shingle_hashes(t, SHINGLE)).tobytes() for t in b["text"]]})

    texts = docs.select(F.xxhash64(docs[id]).alias("_i"), F.xxhash64(text_of(docs, text)).alias("_t"), text_of(docs, text).alias("text"))
    return stored(texts.join(one, ["_i", "_t"]).select("sid", "text").mapInPandas(sets, "sid bigint, grams binary").dropDuplicates(["sid"]), "grams")


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def tile_pairs(a: pd.DataFrame, b: pd.DataFrame | None) -> list[tuple[int, int]]:
    """Pairs of sets of different components that may be similar, by their fingerprints and sizes."""
    other = a if b is None else b
    fa, fb = (x["fp"].to_numpy(np.int64).view(np.uint64) for x in (a, other))
    na, nb = (x["n"].to_numpy(np.int64) for x in (a, other))
    ca, cb = (x["component"].to_numpy(np.int64) for x in (a, other))
    sa, sb = (x["sid"].to_numpy(np.int64) for x in (a, other))
    out = []
    for k in range(0, len(a), 256):
        near = np.bitwise_count(fa[k:k + 256, None] ^ fb[None, :]) <= RADIUS
        near &= ca[k:k + 256, None] != cb[None, :]
        near &= WHOLE * np.minimum(na[k:k + 256, None], nb[None, :]) >= PART * np.maximum(na[k:k + 256, None], nb[None, :])
        u, v = np.nonzero(near)
        out += zip(sa[u + k].tolist(), sb[v].tolist(), strict=True)
    return out


def _rest(members: DataFrame) -> DataFrame:
    """(sid, leader): pairs that may be similar in buckets of several components; ``members`` has (bucket, sid, fp, n, component).

    Small buckets are joined with themselves, larger ones compared tile by tile.
    """
    mixed = members.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b")
    rows = stored(salted_join(members, mixed.select("bucket", "_n"), ["bucket"], F.col("sid"), "inner"), "mixed")
    few = rows.where(F.col("_n") <= SMALL)
    left, right = (few.select(F.col("bucket").alias(f"bucket_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("sid", "fp", "n", "component")]) for s in "ab")
    some = left.join(right, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("sid_a") < F.col("sid_b")) & (F.col("component_a") != F.col("component_b")) & _close("fp_a", "fp_b", "n_a", "n_b"))
    some = some.select(F.col("sid_a").alias("sid"), F.col("sid_b").alias("leader"))

    # a tile holds sets of near population counts; no two sets of tiles further apart than the radius are within it
    many = rows.where(F.col("_n") > SMALL).withColumn("band", F.floor(F.bit_count("fp") / (RADIUS + 1)).cast("int"))
    tiled = stored(many.withColumn("tile", F.pmod(F.xxhash64("sid"), F.ceil(F.col("_n") / TILE)).cast("int")).drop("_n"), "tiled")
    tiles = tiled.groupBy("bucket", "band", "tile").agg(F.min(F.bit_count("fp")).alias("low"), F.max(F.bit_count("fp")).alias("high"))
    left, right = (tiles.select("bucket", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "tile", "low", "high")]) for s in "ab")
    pairs = left.join(right, "bucket").where("struct(band_a, tile_a) <= struct(band_b, tile_b)")
    pairs = pairs.where((F.col("low_b") - F.col("high_a") <= RADIUS) & (F.col("low_a") - F.col("high_b") <= RADIUS))
    pairs = stored(pairs.select("bucket", "band_a", "tile_a", "band_b", "tile_b", F.monotonically_increasing_id().alias("pair")), "pairs")

    def side(s: str) -> DataFrame:
        named = pairs.select("pair", "bucket", F.col(f"band_{s}").alias("band"), F.col(f"tile_{s}").alias("tile"), F.expr("band_a = band_b AND tile_a = tile_b").alias("same"))
        return tiled.join(named, ["bucket", "band", "tile"]).select(*[F.col(c).alias(f"{c}_{s}") for c in ("pair", "same", "sid", "fp", "n", "component")])

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (x.rename(columns=lambda c: c[:-2]) for x in (a, b))
        found = tile_pairs(a, None if len(a) and a["same"].iloc[0] else b) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["sid", "leader"], dtype="int64")

    found = side("a").groupBy("pair_a").cogroup(side("b").groupBy("pair_b")).applyInPandas(compare, "sid bigint, leader bigint")
    return some.unionByName(found).distinct()


def _with_grams(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """(sid, leader, ga, gb): pairs with both sets.  Sets are large, so only those of leaders of more than a task's share of pairs are repeated."""
    hot = skew.heavy(pairs, ["leader"])
    dealt = pairs.withColumn("_piece", F.pmod(F.xxhash64("sid"), skew.pieces(hot, ["leader"])))
    leaders = grams.select(F.col("sid").alias("leader"), F.col("grams").alias("gb")).join(pairs.select("leader").distinct(), "leader", "left_semi")
    leaders = leaders.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), skew.pieces(hot, ["leader"]) - 1)))
    return dealt.join(grams.withColumnRenamed("grams", "ga"), "sid").join(leaders, ["leader", "_piece"]).drop("_piece")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, sid, fp, group) of every row; ``group`` is the key of one of the group's sets."""
    rows = stored(shingle_sets(docs, repeats(docs, text), id, text), "shingles")
    sets = stored(rows.select("sid", "fp", "n", "first").dropDuplicates(["sid"]), "sets")
    slim = sets.select("sid", "fp", "n")
    buckets = _buckets(sets)
    of = lambda name, end: slim.select(F.col("sid").alias(name), F.col("fp").alias(f"fp_{end}"), F.col("n").alias(f"n_{end}"))
    pairs = buckets.where("sid <> leader").select("sid", "leader").distinct().join(of("sid", "a"), "sid")
    pairs = skew.split_join(pairs, of("leader", "b"), ["leader"], spread=["sid"]).where(_close("fp_a", "fp_b", "n_a", "n_b"))

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs.select("sid", "leader"), f"{name}_pairs")
        grams = _grams(docs, rows, pairs.select("sid").union(pairs.select("leader")).distinct(), id, text)
        both = _with_grams(pairs, grams)
        return stored(both.where(F.pandas_udf(_similar, "boolean")("ga", "gb")).select(F.col("sid").alias("u"), F.col("leader").alias("v")), name)

    links = checked(pairs, "stars")
    known = merged(links).withColumnRenamed("node", "sid")
    members = buckets.select("bucket", "sid").join(slim, "sid").join(known, "sid", "left").select("bucket", "sid", "fp", "n", F.coalesce("root", "sid").alias("component"))
    more = checked(_rest(stored(members, "members")), "rest")
    roots = merged(links.unionByName(more)).withColumnRenamed("node", "sid")
    found = salted_join(rows.select("doc_id", "text_hash", "sid", "fp"), roots, ["sid"], F.xxhash64("doc_id", "text_hash"), "left")
    return found.select("doc_id", "text_hash", "sid", "fp", F.coalesce("root", "sid").alias("group"))
