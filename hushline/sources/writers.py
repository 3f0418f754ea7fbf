"""Cue tables, subtitle files and backups: writing and reading back."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushline.functions import text as T
from hushline.sources import vtt_files

BUNDLE_VERSION = 1


def write_cues(cues: DataFrame, path: str, partition_by: list[str] = ("language",)) -> None:
    """Cues as Parquet, rows of one track together, overwritten as a whole.

    Rows are placed by track and a slice of its time, so one huge track is
    written by several tasks.
    """
    keys = [c for c in partition_by if c in cues.columns]
    placed = cues.repartition(*keys, F.col("track_id"), F.floor(F.col("start_ms") / 3_600_000)).sortWithinPartitions("track_id", "start_ms")
    placed.write.mode("overwrite").partitionBy(*keys).parquet(path)


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """Cues as written.  Findings are not stored: detect again with current settings."""
    return spark.read.parquet(path)


def _vtt_block() -> Column:
    return F.concat(T.vtt_time(F.col("start_ms")), F.lit(" --> "), T.vtt_time(F.col("end_ms")), F.lit("\n"), F.col("text"), F.lit("\n\n"))


def vtt_text(cues: DataFrame) -> DataFrame:
    """One WebVTT text per track: (track_id, content).  A track is one row here; ``write_vtt`` streams tracks of any size."""
    rows = F.sort_array(F.collect_list(F.struct("start_ms", "cue_id", _vtt_block().alias("b"))))
    return cues.groupBy("track_id").agg(
        F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(rows, lambda r: r["b"]), "")).alias("content"))


def write_vtt(cues: DataFrame, path: str) -> None:
    """WebVTT, one named file per track (see ``vtt_files``); cues without times or text are left out."""
    vtt_files.write_blocks(cues.select("track_id", "start_ms", "cue_id", _vtt_block().alias("block")).filter("block IS NOT NULL"), path)


def restore_cues(stored: DataFrame, detect) -> DataFrame:
    """Cues of a backup or of storage with fresh findings: stored ones are dropped, ``detect`` runs with current settings."""
    return detect(stored.drop("matches", "score", "has_profanity", "censored_text"))


@dataclass(frozen=True)
class Version:
    """A schema version of backups: the columns of each table, and the steps to the next version's tables.

    A table without a step is carried over as it is; a step may rename, retype, add or drop columns.
    """

    schemas: dict[str, str]
    steps: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


def export_bundle(path: str, version: int = BUNDLE_VERSION, mode: str = "overwrite", **tables: DataFrame) -> None:
    """Backup of named tables as JSON lines: one row per record, with its table, version and checksum."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(version).alias("version"), F.lit(name).alias("kind"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("checksum", _checksum())
    out.write.mode(mode).partitionBy("kind").json(path)


def _checksum() -> Column:
    return F.sha2(F.concat_ws("|", F.col("version").cast("string"), F.col("kind"), F.col("record")), 256)


_BUNDLE = "version int, record string, checksum string, kind string"


def damaged_records(spark: SparkSession, path: str) -> DataFrame:
    """(kind, version, record): rows of a backup that differ from their checksum; rows without one are taken as they are."""
    return spark.read.schema(_BUNDLE).json(path).filter(F.col("checksum") != _checksum()).select("kind", "version", "record")


def migrate_bundle(spark: SparkSession, path: str, versions: dict[int, Version], current: int = BUNDLE_VERSION) -> dict[str, DataFrame]:
    """Tables of a backup in the current schema, whatever the versions of its rows, which may be mixed.

    Rows are read with the columns of their version and taken from version to version.  Damaged rows, those of a version
    that ``versions`` does not describe and those of tables that it does not name are left out; ``damaged_records`` lists the first.
    """
    raw = spark.read.schema(_BUNDLE).json(path).filter(F.col("checksum").isNull() | (F.col("checksum") == _checksum()))
    out = {}
    for kind in versions[current].schemas:
        carried = None
        for v in sorted(n for n in versions if n <= current):
            if kind in versions[v].schemas:
                rows = raw.filter((F.col("kind") == kind) & (F.col("version") == v)).select(F.from_json("record", versions[v].schemas[kind]).alias("_r")).select("_r.*")
                carried = rows if carried is None else carried.unionByName(rows)
            if carried is not None and v < current:
                carried = versions[v].steps.get(kind, lambda df: df)(carried)
        out[kind] = carried
    return out


def import_bundle(spark: SparkSession, path: str, schemas: dict[str, str], version: int = BUNDLE_VERSION) -> dict[str, DataFrame]:
    """Tables of a backup, read with explicit schemas; another version only warns (``migrate_bundle`` migrates)."""
    raw = spark.read.schema(_BUNDLE).json(path)
    if raw.filter(F.col("version") != version).limit(1).count():
        warnings.warn("the backup has another schema version and may need migration", stacklevel=2)
    return {kind: raw.filter(F.col("kind") == kind).select(F.from_json("record", schema).alias("_r")).select("_r.*")
            for kind, schema in schemas.items()}
