"""Near-duplicate groups by SimHash, with an exact tiled comparison of all fingerprints.

A fingerprint's bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's word shingles.  Distinct
fingerprints are dealt into tiles by the population counts of their four 16-bit parts.  Two fingerprints within the
radius differ in these counts by no more than the radius in sum, so only such pairs of tiles are compared, by numpy
exclusive-or and bit counts; all links are found.  Of each pair of tiles only a spanning set of links is returned, so that
a dense group costs rows in proportion to its size, not its square.  Linked fingerprints are then merged by rounds of
contraction: each joins its smallest neighbour until no link is left.

Edge cases: a null text is empty; texts without words have the fingerprint zero and are linked like any other; with fewer
words than a shingle the whole sequence is one shingle; repeated rows each get their result; a component's id is the
smallest id that is not null, and null where all its ids are; other columns are ignored; ``one_of_each`` keeps one row of a
group, whatever the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from hushline.llm.common import salted_join, stored, text_of

SHINGLE = 3
RADIUS = 2
TILE = 2_048
SEED = 42
_BASE = 21  # a part's count of 0 to 16, moved by up to two either way


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all word shingles of a text, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*[words[k:] for k in range(size)]))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, max(1, len(words) - size + 1))


def bits_of(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):  # bounded memory for long texts
        ones += np.unpackbits(hashes[k:k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    return bits_of(shingle_hashes(text, size))


def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp is the fingerprint as a signed number."""
    whole = text_of(docs, text)
    return docs.select(docs[id].alias("doc_id"), F.xxhash64(whole).alias("text_hash"), F.pandas_udf(_fingerprints, "bigint")(whole).alias("fp"))


def tiles(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(key, block, fps): distinct fingerprints by the counts of their parts, in blocks of about ``tile``.

    The table of key sizes is broadcast; it has at most 17**4 rows, whatever the input.
    """
    part = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) + 2
    keyed = fps.select("fp", (part(0) + _BASE * part(1) + _BASE**2 * part(2) + _BASE**3 * part(3)).cast("int").alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("bigint").alias("blocks"))
    dealt = keyed.join(F.broadcast(sizes), "key").select("key", F.pmod(F.xxhash64("fp"), "blocks").alias("block"), "fp")
    return dealt.groupBy("key", "block").agg(F.collect_list("fp").alias("fps"))


def _roots(size: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest node that its links reach."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all() and (root[u] == root[v]).all():
            return root
        root = new


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what ``a`` and ``b`` (or ``a`` with itself) connect within the radius; at most one per member."""
    nodes = a if b is None else np.concatenate([a, b])
    us, vs, other, shift = [], [], a if b is None else b, 0 if b is None else len(a)
    for k in range(0, len(a), 256):
        close = np.bitwise_count(a[k:k + 256, None] ^ other[None, :]) <= radius
        u, v = np.nonzero(close)
        u, v = u + k, v + shift
        if b is None:
            u, v = u[u < v], v[u < v]
        us.append(u)
        vs.append(v)
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return []
    root = _roots(len(nodes), u, v)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    signed = nodes.view(np.int64)
    return list(zip(signed[moved].tolist(), signed[root[moved]].tolist(), strict=True))


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(u, v): links whose connected components are those of all pairs within the radius (0 to 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("the tiles hold pairs within a radius of 0 to 2")
    grid = stored(tiles(fps, tile), "tiles")
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    steps = sorted(x for x in (sum(c * _BASE**k for k, c in enumerate(d)) for d in near) if x >= 0)  # the other half meets from the other side
    left = grid.select(F.col("key").alias("ka"), F.col("block").alias("ba"), F.col("fps").alias("a"), F.explode(F.array(*map(F.lit, steps))).alias("step"))
    pairs = left.join(grid.select("key", F.col("block").alias("bb"), F.col("fps").alias("b")), F.col("key") == F.col("ka") + F.col("step"))
    pairs = pairs.where((F.col("step") > 0) | (F.col("ba") <= F.col("bb"))).select("a", "b", ((F.col("step") == 0) & (F.col("ba") == F.col("bb"))).alias("same"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, same in zip(batch["a"], batch["b"], batch["same"], strict=True):
                a, b = np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64)
                out += tile_links(a, None if same else b, radius)
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return pairs.mapInPandas(compare, "u bigint, v bigint")


def merged(edges: DataFrame) -> DataFrame:
    """(node, root): every linked node with one node of its component, by contraction.

    A round joins each node to its smallest neighbour and renames both ends of all links; links within a merged group
    vanish.  Each round is written to the shared folder, so the plan does not grow.
    """
    edges = stored(edges.where("u <> v").distinct(), "links")
    labels = stored(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        parents = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")), "parents")
        of = lambda c, name: parents.select(F.col("u").alias(c), F.col("p").alias(name))
        moved = salted_join(salted_join(edges, of("u", "pu"), ["u"], F.col("v"), "inner"), of("v", "pv"), ["v"], F.col("u"), "inner")
        edges = stored(moved.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
        labels = stored(salted_join(labels, of("root", "p"), ["root"], F.col("node")).select("node", F.coalesce("p", "root").alias("root")), "labels")
    return labels


def components(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, fp, group, component_id) per row.  Copies share a fingerprint, which is compared once.

    ``group`` is one of the component's fingerprints: ids that occur with several texts may share a component's id.
    """
    rows = stored(fingerprints(docs, id, text), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = merged(links(fps.select("fp"), radius, tile)).withColumnRenamed("node", "fp")
    fps = fps.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = fps.groupBy("root").agg(F.min("first").alias("component_id"))
    named = salted_join(fps, lowest, ["root"], F.col("fp"), "inner").select("fp", F.col("root").alias("group"), "component_id")
    return salted_join(rows, named, ["fp"], F.xxhash64("doc_id", "text_hash"), "inner").select("doc_id", "text_hash", "fp", "group", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row per group: that of the smallest id (null last), of its texts that of the lowest hash.

    ``found`` has (doc_id, text_hash, group); rows are known by id and text, so that an id with several texts loses none.
    """
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_last"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_t"))).alias("_k"))
    kept = first.select(F.xxhash64("_k._id").alias("_k1"), F.col("_k._t").alias("_k2"))
    keyed = docs.withColumns({"_k1": F.xxhash64(docs[id]), "_k2": F.xxhash64(text_of(docs, text))})
    return keyed.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select(*docs.columns)


def hex_of(fp):
    """A signed fingerprint as 16 hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
