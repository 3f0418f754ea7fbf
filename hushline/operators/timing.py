"""Estimated word times, mute windows and speaking rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import fixed_values as fv, text as T
from hushline.functions.spoken import spoken
from hushline.operators import ordered
from hushline.operators.detect import KEYS


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def word_timing(detected: DataFrame) -> DataFrame:
    """One row per match with the time its word is expected to be spoken.

    A cue's time is shared out by syllables.  When no white-space word begins at
    the match, all syllables count as spoken before it.  All work is done inside
    the row of the cue.
    """
    of = lambda name: F.transform("matches", lambda m: m[name])
    df = detected.filter(F.size("matches") > 0).withColumn("_s", spoken(F.col("text"), of("start_idx"), of("word")))
    timed = F.zip_with("matches", "_s.m", lambda m, s: F.struct(
        m["word"].alias("word"), m["start_idx"].alias("start_idx"), m["end_idx"].alias("end_idx"),
        s["before"].alias("syllables_before"), s["own"].alias("word_syllables")))
    rows = df.select(
        *KEYS, F.col("start_ms").alias("cue_start_ms"), F.col("end_ms").alias("cue_end_ms"),
        F.length("text").alias("text_length"), F.col("_s.total").alias("_total"), F.inline_outer(timed))
    length = F.col("cue_end_ms") - F.col("cue_start_ms")
    per = length / F.col("_total")
    start = F.when(F.col("_total") == 0, F.col("cue_start_ms") + length * F.col("start_idx") / F.col("text_length")).otherwise(
        F.col("cue_start_ms") + F.col("syllables_before") * per)
    end = F.when(F.col("_total") == 0, F.col("cue_start_ms") + length * F.col("end_idx") / F.col("text_length")).otherwise(
        start + F.col("word_syllables") * per)
    return rows.withColumn("word_start_ms", start.cast("double")).withColumn("word_end_ms", end.cast("double")).drop("_total")


def mute_windows(detected: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Padded window per match of a flagged cue; none at high sensitivity."""
    rows = word_timing(detected.filter("has_profanity"))
    if sensitivity == "high":
        rows = rows.filter(F.lit(False))
    pad_before, pad_after = fv.PADS.get(sensitivity, fv.PADS["medium"])
    r = F.col("start_idx") / F.col("text_length")
    late = (r - 0.5) / 0.5
    end_part = (r - 0.7) / 0.3
    before = (
        F.lit(pad_before)
        + F.when(F.col("word_syllables") <= 2, 100).when(F.col("word_syllables") > 3, 150).otherwise(0)
        + F.when(r > 0.5, _half_up(200 + 1200 * late * late)).when(r > 0.3, _half_up(150 * (r - 0.3) / 0.2)).otherwise(0))
    after = F.lit(pad_after) + F.when(r > 0.7, _half_up(300 + 500 * end_part * end_part)).when(
        r > 0.5, _half_up(200 * (r - 0.5) / 0.2)).otherwise(0)
    rows = rows.withColumn("buffer_before_ms", before.cast("int")).withColumn("buffer_after_ms", after.cast("int"))
    start = F.greatest(F.col("cue_start_ms").cast("double"), F.col("word_start_ms") - F.col("buffer_before_ms"))
    open_end = F.col("word_end_ms") + F.col("buffer_after_ms")
    end = F.when(r > 0.75, open_end).otherwise(F.least(F.col("cue_end_ms").cast("double"), open_end))
    return rows.select(*KEYS, "word", "start_idx", start.alias("start_ms"), end.alias("end_ms"), "word_start_ms", "word_end_ms",
                       "buffer_before_ms", "buffer_after_ms")


def merge_windows(windows: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Islands of overlapping windows per track: (track_id, start_ms, end_ms, n)."""
    return ordered.merge_islands(windows.select("track_id", "start_ms", "end_ms"), ["track_id"], "start_ms", "end_ms", chunk_ms)


def muted_time(windows: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Milliseconds each track is muted: padded windows, overlaps counted once."""
    padded = windows.select("track_id", (F.col("start_ms") - fv.MUTE_EARLY_MS).alias("start_ms"), (F.col("end_ms") + fv.MUTE_LATE_MS).alias("end_ms"))
    merged = ordered.merge_islands(padded, ["track_id"], "start_ms", "end_ms", chunk_ms)
    return merged.groupBy("track_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("muted_ms"), F.count(F.lit(1)).alias("n_mutes"), F.sum("n").alias("n_windows"))


def speaking_rate(cues: DataFrame) -> DataFrame:
    """Words per minute, ms per syllable, syllables per word of every track."""
    per_cue = cues.select(
        "track_id", F.size(T.space_words(F.col("text"))).alias("_w"), T.total_syllables(F.col("text")).alias("_s"),
        (F.col("end_ms") - F.col("start_ms")).alias("_d"))
    total = per_cue.groupBy("track_id").agg(F.sum("_w").alias("_w"), F.sum("_s").alias("_s"), F.sum("_d").alias("_d"))
    unknown = (F.col("_d") == 0) | (F.col("_s") == 0)
    usual = fv.FALLBACK_RATE
    return total.select(
        "track_id",
        F.when(unknown, usual["wpm"]).otherwise(F.try_divide("_w", "_d") * 60000).alias("wpm"),
        F.when(unknown, usual["ms_per_syllable"]).otherwise(F.try_divide("_d", "_s")).alias("ms_per_syllable"),
        F.when(unknown, usual["syllables_per_word"]).otherwise(F.try_divide("_s", "_w")).alias("syllables_per_word"))
