"""What the operators of this subpackage share: stored intermediate tables, salted joins, held-out rows."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent and the session is local (tests), a temporary folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a derived table once to the shared folder and read it back.

    The table is then neither derived twice nor lost with an executor, and ids given to rows stay the same.
    """
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a side with hot keys to a slim side with one row per key.

    A key's rows on the left are dealt over ``salts`` tasks by ``salt``, whose values must differ within the
    key; the right side is repeated that many times.  Keys may be null (null matches null).
    """
    left = left.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in right.columns if c not in on],
                         F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_r_salt"))
    cond = F.col("_salt") == F.col("_r_salt")
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in on])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text, modulo ``folds``, is 0; an id of null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sample_by_hash(rows: DataFrame, key: str, at_most: int, total: int) -> DataFrame:
    """About ``at_most`` of ``total`` rows, always the same ones: those with the lowest hashes."""
    share = min(1.0, at_most / max(total, 1))
    return rows.where(F.crc32(F.concat(F.lit("sample"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")) < int(share * 2**32))


def place_of(strings: list[str], bits: int) -> list[int]:
    """Hash of each string, below ``2 ** bits``."""
    mask = (1 << bits) - 1
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) * 2654435761 >> 7 & mask for x in strings]


def token_hashes(memo: dict, tokens: list[str], bits: int, shapes=None) -> list[int]:
    """Hash of each token, below ``2 ** bits``, followed by those of ``shapes(token)``, a list of as many strings for any token.

    ``memo`` saves repeated work and is emptied when it grows large.
    """
    if len(memo) > 300_000:
        memo.clear()
    out = []
    for t in tokens:
        h = memo.get(t)
        if h is None:
            h = memo[t] = place_of([t, *shapes(t)] if shapes else [t], bits)
        out += h
    return out
