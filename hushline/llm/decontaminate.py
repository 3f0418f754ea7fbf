"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are hashed, ``K``-grams of them are hashed, and in every window of ``WINDOW`` consecutive grams the least hash is
kept as a fingerprint.  A span of ``K + WINDOW - 1 = SPAN`` words or more that two texts share has a whole window in common,
hence a common fingerprint.  Fingerprints of documents are joined with those of the benchmark; at each hit the spans of
``SPAN`` words around it are compared word for word with the benchmark's, and the words that equal spans cover are marked.
Items of fewer words are a single shorter span; for each such length that occurs, all grams of that length are compared.

Edge cases: null has no words; an item without words takes no part; items that repeat all count; repeated rows each get
their result; results are joined on (id, hash of the text), so rows with one id and different texts are told apart; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hushline.llm.common import ascii_lower, stored, text_of

SPAN = 13
K = 8
WINDOW = SPAN - K + 1
#: Up to so many rows of numbers (16 bytes each) a side is broadcast; beyond that the join is a shuffled one.
BROADCAST_ROWS = 1_000_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = ["doc_id", "text_hash"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BREAKS), "")


def _paired(a: Column, b: Column, step: int, combine) -> Column:
    """``combine(a[i], b[i + step])``; past the end of b the second value is null."""
    return F.zip_with(a, F.slice(b, step + 1, F.greatest(F.size(b) - step, F.lit(0))), combine)


def _wide(df: DataFrame, column: str, size: int, combine, out: str) -> DataFrame:
    """Column ``out``: for every i, ``combine`` over column[i : i + size], by doubling; shorter arrays give an empty one.

    Each doubling is a projection of its own: one expression would contain the one before twice, and so on down.
    """
    have, df = 1, df.withColumn(out, F.col(column))
    while have < size:
        step = min(have, size - have)
        df, have = df.withColumn(out, _paired(F.col(out), F.col(out), step, combine)), have + step
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size(column) - size + 1, F.lit(0))))


def grams(df: DataFrame, hashes: str, size: int, out: str) -> DataFrame:
    """Hash of the ``size`` words from each position on.  Doubling may overlap, which still makes a hash of just these words."""
    return _wide(df, hashes, size, lambda a, b: F.xxhash64(a, b), out)


def fingerprints(df: DataFrame, hashes: str, size: int, out: str) -> DataFrame:
    """What represents a text among spans of ``size`` words: for full spans the distinct least gram hashes of all windows,
    for the shorter spans of short items all grams."""
    if size < SPAN:
        df = grams(df, hashes, size, out)
    else:
        df = _wide(grams(df, hashes, K, out), out, WINDOW, lambda a, b: F.least(a, b), out + "_least").drop(out).withColumnRenamed(out + "_least", out)
    return df.withColumn(out, F.array_distinct(out))


def _few(df: DataFrame) -> DataFrame:
    """A stored slim table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *[c for c in right.columns if c not in _ROW])
    return left.join(right, left["doc_id"].eqNullSafe(F.col("_id")) & (left["text_hash"] == F.col("_hash")), how).drop("_id", "_hash")


def benchmark_spans(items: DataFrame, id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(size, span, set_id): every distinct span with the set of its items; (set_id, items): each set once, ids as strings."""
    split = items.select(items[id].cast("string").alias("item"), words(text_of(items, text)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(SPAN))
    spans = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    rows = split.select("item", size.alias("size"), F.explode(F.array_distinct(spans)).alias("span"))
    sets = stored(rows.groupBy("size", "span").agg(F.array_sort(F.collect_set("item")).alias("items")), "spans")
    sets = sets.withColumn("set_id", F.sha2(F.array_join("items", ","), 256))
    return sets.select("size", "span", "set_id"), sets.select("set_id", "items").dropDuplicates(["set_id"])


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document doc_id, text_hash, n_words, hits (sorted positions of hit words) and items (sorted ids, as strings)."""
    spark = docs.sparkSession
    spans, sets = benchmark_spans(items, item_id, item_text)
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    sizes = sorted(r["size"] for r in spans.select("size").distinct().collect())  # at most SPAN numbers
    # (size, hash): fingerprints of long items, the single gram of each shorter one
    test = [fingerprints(spans.where(F.col("size") == n).select(hashed(F.split("span", " ")).alias("h")), "h", n, "p").select(F.lit(n).alias("size"), F.explode_outer("p").alias("hash")) for n in sizes]
    # (outer, here and below: for an inner explode Spark adds a filter on the array's size below all projections, which makes the grams twice per level)
    test = stored(reduce(DataFrame.union, test).where(F.col("hash").isNotNull()).distinct() if test else spark.createDataFrame([], "size int, hash bigint"), "test")

    # one pass over the texts
    row = docs.select(docs[id].alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("text_hash"), words(text_of(docs, text)).alias("w"))
    row = row.select(*_ROW, F.size("w").alias("n_words"), hashed(F.col("w")).alias("h"))
    for n in sizes:
        row = fingerprints(row, "h", n, f"p{n}")
    prints = [F.struct(F.lit(n).alias("size"), F.col(f"p{n}").alias("hashes")) for n in sizes]
    prints = F.array(*prints) if prints else F.expr("cast(array() AS array<struct<size:int,hashes:array<bigint>>>)")
    seen = stored(row.select(*_ROW, F.col("n_words").cast("bigint").alias("n_words"), prints.alias("prints")), "prints")
    flat = seen.select(*_ROW, F.explode("prints").alias("p")).select(*_ROW, "p.size", F.explode("p.hashes").alias("hash"))
    found = stored(flat.join(_few(test), ["size", "hash"], "left_semi").select(*_ROW).distinct(), "candidates")

    # around the hits of these documents, spans are compared word for word
    texts = docs.select(docs[id].alias("doc_id"), F.xxhash64(text_of(docs, text)).alias("text_hash"), text_of(docs, text).alias("t"))
    texts = stored(_same_row(texts, _few(found), "left_semi").dropDuplicates(_ROW).select(*_ROW, words(F.col("t")).alias("w")), "texts")
    grammed = texts.select(*_ROW, hashed(F.col("w")).alias("h"))
    starts = []
    for n in sizes:
        met = grams(grammed, "h", K if n == SPAN else n, "g").select(*_ROW, F.posexplode_outer("g").alias("pos", "hash"))
        met = met.join(_few(test.where(F.col("size") == n).select("hash")), "hash", "left_semi")
        reach = F.sequence(F.greatest(F.col("pos") - (SPAN - K), F.lit(0)), F.col("pos")) if n == SPAN else F.array("pos")
        starts.append(met.select(*_ROW, F.lit(n).alias("size"), reach.alias("reach")))
    if not starts:
        return seen.select(*_ROW, "n_words", F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    near = reduce(DataFrame.union, starts).groupBy(*_ROW, "size").agg(F.array_distinct(F.flatten(F.collect_list("reach"))).alias("starts"))
    near = _same_row(texts, near, "inner")
    cut = F.transform(F.filter("starts", lambda s: s + F.col("size") <= F.size("w")), lambda s: F.struct(s.alias("start"), F.array_join(F.slice("w", s + 1, F.col("size")), " ").alias("span")))
    near = near.select(*_ROW, "size", F.explode(cut).alias("c")).select(*_ROW, "size", "c.start", "c.span")
    hits = stored(near.join(_few(spans), ["size", "span"]).select(*_ROW, "size", "start", "set_id"), "hits")
    covered = hits.groupBy(*_ROW).agg(F.collect_set(F.struct("start", "size")).alias("s"))
    covered = covered.select(*_ROW, F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1))))).alias("hits"))
    named = hits.select(*_ROW, "set_id").distinct().join(sets, "set_id").groupBy(*_ROW).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = _same_row(_same_row(seen.drop("prints"), covered, "left"), named, "left")
    return out.select(*_ROW, "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(found: DataFrame) -> Column:
    """A twentieth of the words or more is hit."""
    return (F.size(found["hits"]) > 0) & (20 * F.size(found["hits"]) >= found["n_words"])


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = contamination(docs, items, id, text)
    bad = found.where(contaminated(found)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    return docs.join(bad, docs[id].eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(docs, text)) == F.col("_hash")), "left_anti")
