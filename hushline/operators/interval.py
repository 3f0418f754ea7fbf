"""Point-in-interval joins, and the playback lookups built on them.

A bare range condition is planned as a nested loop.  Here time is a tree of
nodes: those of level 0 are ``bucket_ms`` long, those of each further level twice
as long.  An interval is filed under the one or two nodes that it touches at the
lowest level whose nodes are as long as itself, whatever its length.  A point
looks under its node at each level that holds any interval (a few dozen at most; the
filed intervals are stored once, which tells them), the two meet by equality on ``(key, level, node)``, and the
exact condition is a residual filter.  No pair is produced twice.

A node that is hot on the point side (many viewers of one scene) can be split
further with ``salt``: points are spread over ``salt`` parts by a hash and
intervals repeated into each of them; with ``BY_SIZE``, only nodes that a sketch finds hot are split, each by its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import fixed_values as fv, text as T
from hushline.operators import lexicon as L, ordered, skew

#: A ``salt`` that splits hot nodes alone.
BY_SIZE = 0


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: list[str],
    point: Column,
    start: Column,
    end: Column,
    condition: Column,
    bucket_ms: int = 10_000,
    how: str = "inner",
    salt: int = 1,
) -> DataFrame:
    """Join points to the intervals that hold them.

    ``start``/``end`` must enclose every point that ``condition`` accepts; the
    columns of both sides other than ``on`` must have different names.  With
    ``left``, a point also gives one row without an interval for each level at
    which it lies in none.
    """
    filed = ordered.materialize(filed_intervals(intervals, start, end, bucket_ms))
    # without intervals a point still looks at level 0, so that a left join keeps it
    levels = sorted(r[0] for r in filed.select("_level").distinct().collect()) or [0]
    left = points.withColumn("_level", F.explode(F.lit(levels)) if len(levels) > 1 else F.lit(levels[0])).withColumn("_b", _node(point, bucket_ms, F.col("_level")))
    keys = [*on, "_level", "_b"]
    if salt > 1:
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt)))
        filed = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keys.append("_salt")
    elif salt == BY_SIZE:
        parts = skew.pieces(skew.heavy(left, keys), keys)
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), parts))
        filed = filed.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
        keys.append("_salt")
    renamed = filed.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in intervals.columns if c not in on])
    cond = condition
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop("_level", "_b", "_salt", *[f"_r_{k}" for k in keys])


def _node(at: Column, bucket_ms: int, level: Column) -> Column:
    return F.floor(at / (F.lit(float(bucket_ms)) * F.pow(F.lit(2.0), level)))


def filed_intervals(intervals: DataFrame, start: Column, end: Column, bucket_ms: int = 10_000) -> DataFrame:
    """The intervals with (_level, _b): one row for each node, two at most, that one is filed under.

    An interval of ``n`` to ``n + 1`` node lengths goes to the level of as many doublings as ``n`` has binary digits.  An
    interval that ends before it starts holds nothing; one without an end or a start is filed nowhere.
    """
    n = F.greatest(F.floor((end - start) / bucket_ms), F.lit(0).cast("bigint"))
    level = F.when(n == 0, 0).otherwise(F.length(F.bin(n)))
    rows = intervals.withColumn("_level", level.cast("int"))
    first = _node(start, bucket_ms, F.col("_level"))
    return rows.withColumn("_b", F.explode(F.when(start.isNotNull() & end.isNotNull(), F.sequence(first, F.greatest(_node(end, bucket_ms, F.col("_level")), first)))))


def reachable(cues: DataFrame, positions: DataFrame, ahead_ms: int = 0) -> DataFrame:
    """The cues that begin no later than ``ahead_ms`` after the last position of their track; those of other tracks are left out.

    What is shown, muted or coming up at any of the positions begins no earlier than its cue does, so a cue that is left out
    here can be part of no answer, and need not be judged.
    """
    last = positions.groupBy("track_id").agg(F.max("position_ms").alias("_last")).filter("_last is not null")
    side = L.bounded_broadcast(last.withColumnRenamed("track_id", "_track"))
    return cues.join(side, (F.col("track_id") == F.col("_track")) & (F.col("start_ms") <= F.col("_last") + ahead_ms), "left_semi")


def _rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _cue_side(cues: DataFrame, extra: list[str] = ()) -> DataFrame:
    return cues.select("track_id", "cue_id", F.col("start_ms").alias("cue_start_ms"), F.col("end_ms").alias("cue_end_ms"), *extra)


def active_cues(cues: DataFrame, positions: DataFrame, offset_ms: int = 0, bucket_ms: int = 10_000, salt: int = 1, extra: list[str] = ()) -> DataFrame:
    """Every cue shown at a position: start <= position + offset <= end."""
    at = F.col("position_ms") + offset_ms
    side = _cue_side(cues, list(extra))
    return interval_join(
        positions, side, ["track_id"], at, F.col("cue_start_ms"), F.col("cue_end_ms"),
        (F.col("cue_start_ms") <= at) & (at <= F.col("cue_end_ms")), bucket_ms, salt=salt,
    )


def active_cue(cues: DataFrame, positions: DataFrame, position_key: list[str], offset_ms: int = 0, bucket_ms: int = 10_000, extra: list[str] = (), salt: int = 1) -> DataFrame:
    """One cue per position: the latest start, then the lowest id."""
    hits = active_cues(cues, positions, offset_ms, bucket_ms, salt, extra)
    picked = ["cue_id", "cue_start_ms", "cue_end_ms", *extra]
    keep = [c for c in positions.columns if c not in position_key]
    best = F.max_by(F.struct(*picked, *keep), F.struct(F.col("cue_start_ms"), -F.col("cue_id")))
    return hits.groupBy(*position_key).agg(best.alias("_best")).select(*position_key, "_best.*")


def mute_state(
    positions: DataFrame, flagged_cues: DataFrame, windows: DataFrame, position_key: list[str],
    sensitivity: str = "medium", offset_ms: int = 0, bucket_ms: int = 10_000, salt: int = 1,
) -> DataFrame:
    """Whether each position is muted, by which window and which cue.

    High sensitivity mutes whole flagged cues, half-open; the others mute word
    windows, closed.  Both start early and end late by fixed paddings.
    """
    at = F.col("position_ms") + offset_ms
    if sensitivity == "high":
        side = flagged_cues.select(
            "track_id", F.col("cue_id").alias("mute_cue_id"), F.lit(None).cast("string").alias("mute_word"),
            F.col("start_ms").cast("double").alias("mute_start_ms"), F.col("end_ms").cast("double").alias("mute_end_ms"))
    else:
        side = windows.select(
            "track_id", F.col("cue_id").alias("mute_cue_id"), F.col("word").alias("mute_word"),
            F.col("start_ms").cast("double").alias("mute_start_ms"), F.col("end_ms").cast("double").alias("mute_end_ms"))
    lo, hi = F.col("mute_start_ms") - fv.MUTE_EARLY_MS, F.col("mute_end_ms") + fv.MUTE_LATE_MS
    inside = (at >= lo) & ((at < hi) if sensitivity == "high" else (at <= hi))
    hits = interval_join(
        positions.select(*position_key, *[c for c in ("track_id", "position_ms") if c not in position_key]),
        side, ["track_id"], at, lo, hi, inside, bucket_ms, salt=salt)
    best = F.min_by(
        F.struct("mute_cue_id", "mute_word", "mute_start_ms", "mute_end_ms"),
        F.struct("mute_start_ms", "mute_end_ms", "mute_cue_id", F.coalesce("mute_word", F.lit(""))))
    found = hits.groupBy(*position_key).agg(best.alias("_m")).select(*position_key, "_m.*")
    return positions.join(found, position_key, "left").withColumn("should_mute", F.col("mute_cue_id").isNotNull())


def next_cues(cues: DataFrame, positions: DataFrame, position_key: list[str], n: int = 2, offset_ms: int = 0, chunk_ms: int = 600_000, extra: list[str] = ()) -> DataFrame:
    """The next n cues that start strictly after each position.

    Cues get their position in the track first.  A position then needs only the
    number of cues that started up to it, and an equality join picks the next n;
    far-away cues are never paired with it.  Cues, their numbers and the positions are stored, so each input is read once.
    """
    tracks = ["track_id"]
    slim = ordered.materialize(cues.select("track_id", "cue_id", "start_ms", *extra))
    numbered = ordered.materialize(ordered.row_numbers(slim, tracks, [F.col("start_ms"), F.col("cue_id")], F.floor(F.col("start_ms") / chunk_ms), "_seq"))
    positions = ordered.materialize(positions)
    marks = numbered.select("track_id", F.col("start_ms").alias("_at"), F.lit(0).alias("_side"), F.col("_seq").alias("_started"),
                            *[F.lit(None).cast(positions.schema[c].dataType).alias(f"_p_{c}") for c in positions.columns])
    asks = positions.select("track_id", (F.col("position_ms") + offset_ms).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("bigint").alias("_started"),
                            *[F.col(c).alias(f"_p_{c}") for c in positions.columns])
    line = marks.unionByName(asks)
    line = ordered.last_value_before(
        line, tracks, [F.col("_at"), F.col("_side"), F.col("_started")], F.floor(F.col("_at") / chunk_ms), F.col("_started"), "_seen")
    asked = line.filter(F.col("_side") == 1).select(
        *[F.col(f"_p_{c}").alias(c) for c in positions.columns],
        F.explode(F.sequence(F.coalesce("_seen", F.lit(0)) + 1, F.coalesce("_seen", F.lit(0)) + n)).alias("_seq"),
        F.coalesce("_seen", F.lit(0)).alias("_base"))
    following = numbered.select("track_id", "_seq", "cue_id", F.col("start_ms").alias("cue_start_ms"), *extra)
    return asked.join(following, ["track_id", "_seq"]).withColumn("rank", (F.col("_seq") - F.col("_base")).cast("int")).drop("_seq", "_base")


def preview_text(start: Column, shown: Column) -> Column:
    """Preview line of an upcoming cue: time, then the first 50 characters."""
    return F.concat(T.format_time(start), F.lit(": "), T.excerpt(shown, 50))


def upcoming_flagged(items: DataFrame, positions: DataFrame, lookahead_ms: int, offset_ms: int = 0, bucket_ms: int = 10_000, salt: int = 1) -> DataFrame:
    """Flagged cues or windows that start within [position, position + lookahead].

    Seen from the item, the positions it answers are an interval that ends at
    its own start, so this is a point-in-interval join again.
    """
    at = F.col("position_ms") + offset_ms
    side = items.withColumnRenamed("start_ms", "item_start_ms").withColumnRenamed("end_ms", "item_end_ms")
    return interval_join(
        positions, side, ["track_id"], at, F.col("item_start_ms") - lookahead_ms, F.col("item_start_ms"),
        (F.col("item_start_ms") >= at) & (F.col("item_start_ms") <= at + lookahead_ms), bucket_ms, salt=salt)


def segment_relevant(segments: DataFrame, positions: DataFrame, tolerance_ms: int = 30_000) -> DataFrame:
    """Keep a segment when the session is at 0 or near the segment's own range."""
    at = positions.select("session_id", "position_ms")
    first, last = F.col("first_cue_ms") - tolerance_ms, F.col("last_cue_ms") + tolerance_ms
    inside = (first <= F.col("position_ms")) & (last >= F.col("position_ms"))
    near = interval_join(at.filter("position_ms <> 0"), segments, ["session_id"], F.col("position_ms"), first, last, inside, 60_000)
    start = segments.join(at.filter("position_ms = 0"), "session_id")  # at the start all segments are wanted
    return near.select(*start.columns).unionByName(start)


def display_text(flagged: Column, censored: Column, original: Column) -> Column:
    return T.sanitize_text(F.when(flagged, censored).otherwise(original))


def only_flagged(scored: DataFrame) -> DataFrame:
    """Flagged cues with the text that is shown for them."""
    return scored.filter("has_profanity").withColumn(
        "shown_text", display_text(F.col("has_profanity"), F.col("censored_text"), F.col("text")))


def positions_to_cues(heartbeats: DataFrame, scored: DataFrame, position_key: list[str], offset_ms: int = 0, flagged_only: bool = False, bucket_ms: int = 10_000) -> DataFrame:
    """Text shown at every heartbeat.

    The judged cues are stored once; times and row numbers alone take part in the search, and the texts are joined to what it picks.
    """
    side = scored.filter("has_profanity") if flagged_only else scored
    side = side.withColumn("shown_text", display_text(F.col("has_profanity"), F.col("censored_text"), F.col("text")))
    side = ordered.materialize(side.select("track_id", "cue_id", "start_ms", "end_ms", "has_profanity", "shown_text", F.monotonically_increasing_id().alias("_row")))
    picked = active_cue(side.drop("has_profanity", "shown_text"), heartbeats, position_key, offset_ms, bucket_ms, extra=["_row"])
    shown = picked.join(side.select("_row", "has_profanity", "shown_text"), "_row")
    keep = [c for c in heartbeats.columns if c not in position_key]
    return shown.select(*position_key, "cue_id", "cue_start_ms", "cue_end_ms", "has_profanity", "shown_text", *keep)


def asof_position(events: DataFrame, heartbeats: DataFrame, key: list[str] = ("session_id",), duration_ms: Column | None = None, chunk_seconds: int = 86_400, split_hot: bool = True) -> DataFrame:
    """Position at the time of each event: last heartbeat plus elapsed time times rate.

    As-of join by union and last non-null value; chunked by time so that one
    busy session is not one task, and with ``split_hot`` a busy day of a session is cut by its size.  Paused or unknown sessions do not advance.
    """
    key = list(key)
    state = F.struct(F.col("ts").alias("at"), "position_ms", "rate", "paused")
    beats = heartbeats.select(*key, "ts", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("event_id"), state.alias("_state"))
    asks = events.select(*key, "ts", F.lit(1).alias("_side"), "event_id", F.lit(None).cast(beats.schema["_state"].dataType).alias("_state"))
    both, at = beats.unionByName(asks), F.unix_micros("ts")
    chunk = skew.finer_chunks(both, key, at, chunk_seconds * 1_000_000) if split_hot else F.floor(at / (chunk_seconds * 1_000_000))
    line = ordered.last_value_before(both, key, [F.col("ts"), F.col("_side"), F.col("event_id")], chunk, F.col("_state"), "_last")
    elapsed = F.unix_millis("ts") - F.unix_millis("_last.at")
    moved = F.col("_last.position_ms") + F.when(F.col("_last.paused"), 0).otherwise(elapsed * F.col("_last.rate"))
    capped = F.least(moved, duration_ms) if duration_ms is not None else moved
    return line.filter(F.col("_side") == 1).select(*key, "event_id", "ts", F.coalesce(capped, F.lit(0.0)).cast("double").alias("position_ms"))
