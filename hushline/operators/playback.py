"""Playback positions: jumps, live alignment, mute transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hushline.functions import fixed_values as fv
from hushline.operators import ordered

FRAME_MS = 20
SAFETY_EXTRA_MS = 1_000
SAFETY_MAX_MS = 300_000
INVALID_EXPECTED_MS = 5_000


def _by_time(df: DataFrame, values: list[str], name: str, key: str, chunk_seconds: int) -> DataFrame:
    return ordered.previous_row(
        df, [key], [F.col("ts"), F.col("event_id")], F.floor(F.unix_seconds("ts") / chunk_seconds), values, name)


def _in_session(gap, idle_ms: int | None):
    """Whether a row belongs to the session of the row before it."""
    return F.lit(True) if idle_ms is None else gap <= idle_ms


def classify_jumps(heartbeats: DataFrame, key: str = "session_id", chunk_seconds: int = 86_400, settle: int = 5) -> DataFrame:
    """Label every sample: play, seek, hover (a short look elsewhere) or return.

    A sample that moves by more than three frames is a jump away from the
    position before it.  If one of the next samples, before ``settle`` have
    passed, is back within two thresholds of that position, it was a hover; the
    sample that comes back is its return.
    """
    order = [F.col("ts"), F.col("event_id")]
    chunk = F.floor(F.unix_seconds("ts") / chunk_seconds)
    pos = F.col("position_ms")
    df = ordered.neighbour_rows(heartbeats, [key], order, chunk, pos, settle, "_before", after=False)
    df = ordered.neighbour_rows(df, [key], order, chunk, pos, settle - 1, "_after", after=True)
    threshold = F.lit(FRAME_MS * 3) * F.col("rate")
    home = F.get("_before", F.lit(0))
    delta = pos - home
    jump = F.coalesce(F.abs(delta) > threshold, F.lit(False)) & ~F.col("paused")
    hover = F.exists("_after", lambda p: F.abs(p - home) < 2 * threshold)
    # a position before an earlier jump, close to where this sample is now
    left_from = F.zip_with(F.slice("_before", 2, settle), F.slice("_before", 1, settle - 1), lambda old, new: F.struct(old.alias("old"), new.alias("new")))
    back = F.exists(left_from, lambda p: F.coalesce((F.abs(p["new"] - p["old"]) > threshold) & (F.abs(pos - p["old"]) < 2 * threshold), F.lit(False)))
    kind = F.when(~jump, "play").when(back, "return").when(hover, "hover").otherwise("seek")
    return df.withColumn("delta_ms", delta).withColumn("kind", kind).drop("_before", "_after")


def align_segments(segments: DataFrame, chunk_seconds: int = 86_400, idle_ms: int | None = None) -> DataFrame:
    """Shift of every segment and whether it is kept.

    ``segments(segment_id, session_id, arrival, source, stream_type, first_cue_ms,
    last_cue_ms, mtp_ms, position_ms, media_ms, has_map)``.  A synced source is
    trusted as it is and makes the session forget the last first-cue time, as
    ``idle_ms`` (if given) without a segment do.
    """
    synced = F.col("source").isin(fv.SYNCED_SEGMENT_SOURCES)
    df = segments.withColumn("_synced", synced)
    # null values are skipped by the as-of lookup, so "forgotten" is a value of its own
    seen = F.struct(F.when(~synced, F.col("first_cue_ms")).alias("first"), F.unix_millis("arrival").alias("at"))
    df = ordered.last_value_before(
        df, ["session_id"], [F.col("arrival"), F.col("segment_id")], F.floor(F.unix_seconds("arrival") / chunk_seconds), seen, "_seen", inclusive=False)
    rising = F.coalesce((F.col("first_cue_ms") > F.col("_seen.first")) & _in_session(F.unix_millis("arrival") - F.col("_seen.at"), idle_ms), F.lit(False))
    df = df.withColumn("rising", rising & ~F.col("_synced"))
    return _aligned(df).drop("_synced", "_seen")


def _aligned(df: DataFrame) -> DataFrame:
    """Alignment of rows that carry ``rising`` and ``_synced``."""
    first, last, pos, media = (F.col(c) for c in ("first_cue_ms", "last_cue_ms", "position_ms", "media_ms"))
    absolute = ((first > 30_000) & (media > 0) & (first > media * 2)) | F.col("rising")
    live = (F.col("stream_type") == "live") | (F.col("stream_type").isNull() & (media > 0) & (media < 60_000) & absolute)
    live = F.coalesce(live, F.lit(False)) & F.col("has_map")
    near = (pos == 0) | ((first <= pos + 30_000) & (last >= pos - 30_000))
    kind = F.when(F.col("_synced"), "synced").when(live & absolute, "live-absolute").when(live, "live-relative").otherwise("vod")
    shift = F.when(kind == "live-absolute", pos - first).when(kind == "live-relative", F.coalesce("mtp_ms", F.lit(0))).otherwise(0)
    return df.withColumn("alignment", kind).withColumn("shift_ms", shift.cast("bigint")).withColumn(
        "kept", F.when(kind == "vod", near).otherwise(True))


def shift_cues(cues: DataFrame, aligned: DataFrame) -> DataFrame:
    """Cues of kept segments, moved by the shift of their segment."""
    moves = aligned.filter("kept").select("segment_id", "shift_ms")
    out = cues.join(moves, "segment_id")
    return out.withColumn("start_ms", F.col("start_ms") + F.col("shift_ms")).withColumn(
        "end_ms", F.col("end_ms") + F.col("shift_ms")).drop("shift_ms")


def mute_transitions(states: DataFrame, key: str = "session_id", chunk_seconds: int = 86_400, idle_ms: int | None = None) -> DataFrame:
    """MUTE when a session enters a muted range, UNMUTE when it leaves it; after ``idle_ms`` (if given) without a row it starts anew."""
    needed = states.select(key, "event_id", "ts", "position_ms", "should_mute", "mute_cue_id", "mute_end_ms")
    df = _by_time(ordered.materialize(needed), ["should_mute", "mute_cue_id", "ts"], "_prev", key, chunk_seconds)
    before = F.coalesce(F.col("_prev.should_mute") & _in_session(F.unix_millis("ts") - F.unix_millis("_prev.ts"), idle_ms), F.lit(False))
    changed = df.filter(F.col("should_mute") != before)
    muted = F.col("should_mute")
    return changed.select(
        key, "event_id", "ts", "position_ms", F.when(muted, "MUTE").otherwise("UNMUTE").alias("action"),
        F.concat(F.lit("cue-"), F.when(muted, F.col("mute_cue_id")).otherwise(F.col("_prev.mute_cue_id")).cast("string")).alias("reason_id"),
        F.when(muted, F.col("mute_end_ms")).alias("expected_unmute_ms"))


def mute_changes(events: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """When each tab turns silent and when it may be heard again: (tab_id, ts_ms, action, reason_id, active).

    ``events(event_id, tab_id, ts, kind, reason_id, expected_unmute_ms)``, kind mute, unmute or reset.  A mute holds its
    reason from its time to the first of: the next event of that reason, the next reset of the tab, and one second
    after the end it expects (five minutes at most, six seconds if none is given; an end that has passed sets no limit).
    A tab is muted while it has a reason.  The reasons' intervals become edges of +1 and -1, and the tab changes
    where their running sum leaves or reaches zero.  At one event an opening edge comes before closing ones, so that
    a mute that replaces another is no change; ends by time come before events of the same time.
    """
    now = F.unix_millis("ts")
    expected = F.when(F.col("expected_unmute_ms") >= 0, F.col("expected_unmute_ms")).otherwise(now + INVALID_EXPECTED_MS)
    delay = expected - now + SAFETY_EXTRA_MS
    rows = events.select("tab_id", "reason_id", "event_id", "kind", now.alias("t"), F.when(delay > 0, now + F.least(delay, F.lit(SAFETY_MAX_MS))).alias("_end"))
    rows = ordered.materialize(rows.withColumn("_to", -F.col("t")))
    order, chunk = [F.col("_to"), -F.col("event_id")], F.floor(F.col("_to") / (1000 * chunk_seconds))
    place = F.struct("t", F.lit(1).alias("phase"), F.col("event_id").cast("bigint").alias("id"), F.when(F.col("kind") == "reset", "reset").otherwise(F.col("reason_id")).alias("label"))
    reset = F.col("kind") == "reset"
    rows = ordered.last_value_before(rows, ["tab_id"], order, chunk, F.when(reset, place), "_reset", inclusive=False)
    rows = ordered.last_value_before(ordered.materialize(rows), ["tab_id", "reason_id"], order, chunk, F.when(~reset, place), "_same", inclusive=False)
    ends = F.when(F.col("_end").isNotNull(), F.struct(F.col("_end").alias("t"), F.lit(0).alias("phase"), F.lit(0).cast("bigint").alias("id"), F.concat(F.lit("safety:"), "reason_id").alias("label")))
    mutes = rows.filter("kind = 'mute'").select("tab_id", place.alias("_open"), F.least("_reset", "_same", ends).alias("_close"))
    edge = lambda c, side, step: F.struct(f"{c}.*", F.lit(side).alias("side"), F.lit(step).alias("step"))
    edges = mutes.select("tab_id", F.inline(F.array(edge("_open", 0, 1), edge("_close", 1, -1)))).filter("t IS NOT NULL")
    summed = ordered.running_sum(
        ordered.materialize(edges), ["tab_id"], [F.col(c) for c in ("t", "phase", "id", "side", "label")], F.floor(F.col("t") / (1000 * chunk_seconds)), F.col("step"), "_n")
    opened = F.col("step") == 1
    changed = summed.filter((opened & (F.col("_n") == 1)) | (~opened & (F.col("_n") == 0)))
    return changed.select("tab_id", F.col("t").alias("ts_ms"), F.when(opened, "MUTED").otherwise("UNMUTED").alias("action"), F.col("label").alias("reason_id"),
                          F.when(opened, 1).otherwise(0).alias("active"))
