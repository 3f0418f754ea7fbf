"""Counts, rates and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import text as T
from hushline.operators import ordered


def profanity_summary(scored: DataFrame) -> DataFrame:
    """Cues, flagged cues and rate per track, language and in total.

    Counted once per track; the rollup above runs on these small counts.
    """
    per_track = scored.groupBy("language", "track_id").agg(
        F.count(F.lit(1)).alias("cues"), F.count_if("has_profanity").alias("flagged"))
    rolled = per_track.rollup("language", "track_id").agg(
        F.sum("cues").alias("cues"), F.sum("flagged").alias("flagged"), F.count(F.lit(1)).alias("tracks"),
        (F.grouping("language") + F.grouping("track_id")).cast("int").alias("level"))
    return rolled.withColumn("rate", F.round(F.col("flagged") * 100.0 / F.col("cues"), 2))


def word_counts(matches: DataFrame, by: list[str] = ()) -> DataFrame:
    """How often each matched word occurs."""
    return matches.groupBy(*by, T.normalize_text(F.col("word")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def track_stats(scored: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """Cue counts, duration (end of the last cue) and number of mute windows per track.

    Without ``windows``, ``scored`` has ``matches``, and each match of a flagged cue counts as one, which is what
    ``timing.mute_windows`` makes of it (high sensitivity aside): one pass over the cues, without their timing and a join.
    """
    aggs = [F.count(F.lit(1)).alias("cues"), F.count_if("has_profanity").alias("flagged"),
            F.max_by("end_ms", F.struct("start_ms", "cue_id")).alias("duration_ms")]
    if windows is None:
        own = F.when(F.col("has_profanity"), F.size("matches")).otherwise(0)
        return scored.groupBy("track_id").agg(*aggs, F.sum(own).alias("windows"))
    per_track = windows.groupBy("track_id").agg(F.count(F.lit(1)).alias("windows"))
    return scored.groupBy("track_id").agg(*aggs).join(per_track, "track_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0).cast("bigint")))


def session_status(frames: DataFrame) -> DataFrame:
    """All frames of a tab as one row, with the sorted list of its distinct tracks and their number."""
    return frames.groupBy("tab_id").agg(
        F.bool_or("has_video").alias("has_video"), F.bool_or("active").alias("active"),
        F.max("cue_count").alias("cue_count"), F.max("profanity_count").alias("profanity_count"),
        F.min_by("track", F.when(F.col("track").isNotNull(), F.col("frame_id"))).alias("current_track"),
        F.array_sort(F.collect_set("track")).alias("tracks"), F.count_distinct("track").alias("n_tracks"), F.bool_or("user_upload").alias("user_upload"))


def number_labels(tracks: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Tracks of one language and label numbered in order; a lone track of a language stays bare.

    ``tracks(title, language, label, ord)``; numbering runs in chunks of ``ord``.
    """
    low = tracks.withColumn("_lang", F.lower("language"))
    numbered = ordered.row_numbers(low, ["title", "_lang", "label"], [F.col("ord")], F.floor(F.col("ord") / chunk), "_n")
    totals = low.groupBy("title", "_lang").agg(F.count(F.lit(1)).alias("_total"))
    out = numbered.join(totals, ["title", "_lang"])
    label = F.when((F.col("_total") == 1) & (F.col("_n") == 1), F.col("label")).otherwise(F.concat("label", F.lit(" "), F.col("_n").cast("string")))
    return out.withColumn("numbered_label", label).drop("_lang", "_n", "_total")


def sample_flagged(scored: DataFrame, n: int, per_track: bool = False, chars: int = 100, matches: Column | None = None) -> DataFrame:
    """First n flagged cues with their time and an excerpt, overall or per track."""
    rows = scored.filter("has_profanity").select(
        "track_id", "cue_id", "start_ms", T.format_time(F.col("start_ms")).alias("at"), T.excerpt(F.col("text"), chars).alias("excerpt"))
    if not per_track:
        return rows.orderBy("track_id", "start_ms", "cue_id").limit(n)
    from pyspark.sql import Window

    # the engine keeps only the first n of a group before it shuffles
    first = F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "cue_id"))
    return rows.withColumn("rank", first).filter(F.col("rank") <= n)


def detection_quality(scored: DataFrame, labels: DataFrame, by: list[str] = ("language",)) -> DataFrame:
    """Precision, recall and false-positive rate of document-level flags against labels.

    ``labels(track_id, toxic)`` covers some documents; the others are left out.
    """
    flags = scored.groupBy("track_id", *by).agg(F.bool_or("has_profanity").alias("_flag"))
    both = flags.join(labels, "track_id")
    hit = F.col("toxic") == 1
    out = both.groupBy(*by).agg(
        F.count_if(F.col("_flag") & hit).alias("tp"), F.count_if(F.col("_flag") & ~hit).alias("fp"),
        F.count_if(~F.col("_flag") & hit).alias("fn"), F.count_if(~F.col("_flag") & ~hit).alias("tn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return (
        out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("false_positive_rate", ratio(F.col("fp"), F.col("fp") + F.col("tn"))))


def main_video(videos: DataFrame) -> DataFrame:
    """The longest usable video of every page: connected, and over 30 s long or ready."""
    usable = F.col("connected") & (F.coalesce(F.col("duration_s") > 30, F.lit(False)) | (F.col("ready_state") >= 1))
    best = F.max_by(F.struct("video_id", "duration_s"), F.struct(F.coalesce("duration_s", F.lit(0.0)), -F.col("video_id")))
    return videos.filter(usable).groupBy("page_id").agg(best.alias("_b")).select("page_id", "_b.*")
