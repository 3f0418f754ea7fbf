"""Order-dependent columns over groups of any size.

A window over ``(key)`` puts a whole key into one task.  Here every key is cut
into chunks along its order (for example one hour of time), the window runs per
``(key, chunk)``, and a summary with one row per chunk carries what earlier
chunks add.  A key that holds a third of the table is thus spread over as many
tasks as it has chunks.  ``chunk`` must not decrease along ``order``.

The summary is ordered per key, but holds one row per chunk, not per input row.
The input is read twice: pass a stored table, or ``materialize`` an expensive one.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window, functions as F

_CHUNK = "_chunk"


def materialize(df: DataFrame) -> DataFrame:
    """Write a derived table once, so that steps which read it twice do not derive it twice.

    The reliable checkpoint goes to the shared folder of ``spark.checkpoint.dir``;
    a temporary folder is used only in local mode.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def _local(keys: list[str], order: list[Column]):
    return Window.partitionBy(*keys, _CHUNK).orderBy(*order)


def _carry(df: DataFrame, keys: list[str], aggs: list[Column]) -> tuple[DataFrame, object]:
    """One row per (key, chunk) and the window over all earlier chunks of a key."""
    summary = df.groupBy(*keys, _CHUNK).agg(*aggs)
    before = Window.partitionBy(*keys).orderBy(_CHUNK)
    return summary, before


def _attach(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Join a summary back on (key, chunk); keys may be null."""
    renamed = summary.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col(_CHUNK).alias("_s_chunk"),
                             *[c for c in summary.columns if c not in keys and c != _CHUNK])
    on = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys] + [F.col(_CHUNK) == F.col("_s_chunk")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return df.join(renamed, cond, "left").drop(*[f"_s_{k}" for k in keys], "_s_chunk")


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, name: str) -> DataFrame:
    """1-based position of every row within its key."""
    df = df.withColumn(_CHUNK, chunk)
    summary, before = _carry(df, keys, [F.count(F.lit(1)).alias("_n")])
    summary = summary.withColumn(
        "_base", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    out = df.withColumn(name, F.row_number().over(_local(keys, order)))
    return _attach(out, summary, keys).withColumn(name, F.col(name) + F.col("_base")).drop("_base", _CHUNK)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including this one."""
    df = df.withColumn(_CHUNK, chunk).withColumn("_v", value)
    summary, before = _carry(df, keys, [F.sum("_v").alias("_total")])
    summary = summary.withColumn(
        "_base", F.coalesce(F.sum("_total").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_total")
    local = F.sum("_v").over(_local(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn(name, F.coalesce(local, F.lit(0)))
    return _attach(out, summary, keys).withColumn(name, F.col(name) + F.col("_base")).drop("_base", "_v", _CHUNK)


def running_max_before(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: Column, name: str) -> DataFrame:
    """Largest ``value`` over all earlier rows of the key; null for the first."""
    df = df.withColumn(_CHUNK, chunk).withColumn("_v", value)
    summary, before = _carry(df, keys, [F.max("_v").alias("_top")])
    summary = summary.withColumn(
        "_base", F.max("_top").over(before.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_top")
    out = df.withColumn(name, F.max("_v").over(_local(keys, order).rowsBetween(Window.unboundedPreceding, -1)))
    return _attach(out, summary, keys).withColumn(name, F.greatest(name, "_base")).drop("_base", "_v", _CHUNK)


def last_value_before(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: Column, name: str, inclusive: bool = True
) -> DataFrame:
    """Latest non-null ``value`` of the key, up to this row or strictly before it.

    ``order`` must be ascending; its columns also rank the rows of one chunk.
    """
    df = df.withColumn(_CHUNK, chunk).withColumn("_v", value)
    rank = F.when(F.col("_v").isNotNull(), F.struct(*order))
    summary, before = _carry(df, keys, [F.max_by("_v", rank).alias("_latest")])
    summary = summary.withColumn(
        "_base", F.last("_latest", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_latest")
    frame = _local(keys, order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = df.withColumn(name, F.last("_v", ignorenulls=True).over(frame))
    return _attach(out, summary, keys).withColumn(name, F.coalesce(name, "_base")).drop("_base", "_v", _CHUNK)


def previous_row(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, values: list[str], name: str) -> DataFrame:
    """Struct of ``values`` of the row just before; null for the first row of a key."""
    row = F.struct(*values)
    return last_value_before(df, keys, order, chunk, row, name, inclusive=False)


def neighbour_rows(
    df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: Column, n: int, name: str, after: bool
) -> DataFrame:
    """Array of up to n values of the next (or previous) rows, nearest first.

    The rows at the edge of a chunk come from its neighbours: every chunk hands
    on at most n values.  ``value`` must not be null.
    """
    df = df.withColumn(_CHUNK, chunk).withColumn("_v", value)
    edge_order = order if after else [c.desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys, _CHUNK).orderBy(*edge_order))
    edge = df.withColumn("_rn", rank).filter(F.col("_rn") <= n)
    summary = edge.groupBy(*keys, _CHUNK).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_v"))), lambda r: r["_v"]).alias("_edge"))
    line = Window.partitionBy(*keys).orderBy(F.col(_CHUNK) if after else F.col(_CHUNK).desc()).rowsBetween(1, n)
    summary = summary.withColumn("_beyond", F.flatten(F.collect_list("_edge").over(line))).drop("_edge")
    frame = Window.partitionBy(*keys, _CHUNK).orderBy(*edge_order).rowsBetween(1, n)
    out = df.withColumn(name, F.collect_list("_v").over(frame))
    return _attach(out, summary, keys).withColumn(name, F.slice(F.concat(name, "_beyond"), 1, n)).drop("_beyond", "_v", _CHUNK)


def merge_islands(df: DataFrame, keys: list[str], start: str, end: str, chunk_ms: int, touching: bool = True) -> DataFrame:
    """Union of overlapping intervals per key: (keys, start, end, n)."""
    order = [F.col(start), F.col(end)]
    chunk = F.floor(F.col(start) / chunk_ms)
    # equal intervals are counted first, so copies never pile up in one task
    packed = materialize(df.groupBy(*keys, start, end).agg(F.count(F.lit(1)).alias("_copies")))
    flagged = running_max_before(packed, keys, order, chunk, F.col(end), "_reach")
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach"))
    numbered = running_sum(flagged, keys, order, chunk, F.when(opens, 1).otherwise(0), "_island")
    return (
        numbered.groupBy(*keys, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_copies").alias("n"))
        .drop("_island")
    )
