"""Hot keys, found by a sketch and split by their size.

One pass over the keys fills a frequent-items sketch (``approx_top_k``).  It is merged from task to task, holds at most
``tracked`` hashes whatever the data, and tells the keys that hold more than one task's share of the rows; there are fewer of
those than tasks, so the list that the driver gets is bounded too.  Only such keys are split, each into as many pieces as its
size asks for; without any, the plan is that of the plain operation.

The sketch only sets how much is split.  What it misses or overrates costs time, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.operators import lexicon as L

#: Pieces for each share of a task; with several, chance deals them evenly.
PIECES = 8
#: Hashes that the sketch holds for each task; its counts are wrong by less than a quarter of a share.
TRACKED = 16


def _hash(keys: list) -> Column:
    return F.xxhash64(*[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])


def heavy(df: DataFrame, keys: list[str], tasks: int | None = None) -> dict[int, int]:
    """Hashes of the keys with more than one task's share of the rows, and the pieces that each is to be split into.

    ``tasks`` is ``spark.sql.shuffle.partitions`` unless given.  Null keys count like others; an empty table has none.
    """
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketch = F.expr(f"approx_top_k(_h, {tasks}, {TRACKED * tasks})").alias("top")
    row = df.select(_hash(keys).alias("_h")).agg(sketch, F.count(F.lit(1)).alias("n")).first()
    return {r["item"]: -(-r["count"] * tasks * PIECES // row.n) for r in row.top or [] if r["count"] * tasks > row.n}


def pieces(hot: dict[int, int], keys: list) -> Column:
    """Into how many pieces a row's key is split; 1 for all that are not hot."""
    if not hot:
        return F.lit(1).cast("bigint")
    table = F.map_from_arrays(F.array(*[F.lit(h).cast("bigint") for h in hot]), F.array(*[F.lit(n).cast("bigint") for n in hot.values()]))
    return F.when(_hash(keys).isin(list(hot)), F.element_at(table, _hash(keys))).otherwise(F.lit(1).cast("bigint"))


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", spread: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` (inner or left) with the hot keys of the left side split.

    A hot key's rows on the left are dealt over its pieces by a hash of ``spread`` (all columns unless given), and its rows
    on the right are repeated in each piece.
    """
    hot = heavy(left, on, tasks)
    if not hot:
        return left.join(right, on, how)
    dealt = left.withColumn("_piece", F.pmod(F.xxhash64(*(spread or left.columns)), pieces(hot, on)))
    repeated = right.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces(hot, on) - 1)))
    return dealt.join(repeated, [*on, "_piece"], how).drop("_piece")


def checked_join(left: DataFrame, small: DataFrame, on: list[str], spread: list[str] | None = None, limit: int = 200_000) -> DataFrame:
    """Join to a table that is broadcast if it has at most ``limit`` rows; beyond that, hot keys of the left side are split."""
    return left.join(F.broadcast(small), on) if L.fits(small, limit) else split_join(left, small, on, spread=spread)


def finer_chunks(df: DataFrame, keys: list[str], at: Column, width: float, tasks: int | None = None) -> Column:
    """Chunks of ``width`` along ``at`` per key; those that hold more than a task's share are cut at quantiles of their rows.

    Chunks still rise along ``at``, as the windows of ``ordered`` ask, and a burst within a chunk is cut too.  The driver gets
    at most ``PIECES`` quantiles for each task.  Rows of one key at one instant stay together.
    """
    base = F.floor(at / width).cast("double")
    hot = heavy(df.select(*keys, base.alias("_chunk")), [*keys, "_chunk"], tasks)
    if not hot:
        return base
    most, whole = max(hot.values()), [*keys, base]
    busy = df.select(_hash(whole).alias("_h"), pieces(hot, whole).alias("_n"), at.cast("double").alias("_at")).where(F.col("_h").isin(list(hot)))
    quantiles = busy.groupBy("_h", "_n").agg(F.percentile_approx("_at", [i / most for i in range(1, most + 1)]).alias("_q"))
    cut = quantiles.select("_h", F.expr(f"transform(sequence(1, _n - 1), i -> element_at(_q, cast(i * {most} / _n as int)))").alias("_q")).collect()
    table = F.map_from_arrays(F.array(*[F.lit(r._h).cast("bigint") for r in cut]), F.array(*[F.array(*map(F.lit, r._q)) for r in cut]))
    passed = F.size(F.filter(F.element_at(table, _hash(whole)), lambda q: q < at))
    return base + F.when(_hash(whole).isin(list(hot)), passed / pieces(hot, whole)).otherwise(0.0)
