"""Stateful streams against a plain replay of the same events."""

import random

from pyspark.sql import functions as F

from hushline.operators import interval as I, playback as P
from hushline.streaming import jobs as J

T0 = 1_700_000_000_000


def stream(spark, folder, rows, schema):
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def test_mute_sessions(spark, tmp_path):
    rows = [
        (0, "a", 0, "mute", "r1", 2_000), (1, "a", 500, "mute", "r2", 60_000), (2, "a", 1_000, "unmute", "r1", None), (3, "a", 1_500, "unmute", "r2", None),
        (4, "a", 9_000, "mute", "r3", 10_000), (5, "a", 30_000, "unmute", "zz", None), (6, "b", 100, "mute", "x", None), (7, "b", 200, "reset", "", None),
        (8, "a", 40_000, "mute", "r4", 41_000), (9, "z", 9_000_000, "unmute", "q", None),
    ]
    rows = [(i, t, T0 + ms, k, r, None if e is None else T0 + e) for i, t, ms, k, r, e in rows]
    s = stream(spark, str(tmp_path / "in"), rows, "event_id int, tab_id string, ts_ms bigint, kind string, reason_id string, expected_unmute_ms bigint")
    got = sorted((r.tab_id, r.ts_ms - T0, r.action, r.reason_id) for r in J.run_to_table(J.mute_sessions(s), "m").collect())
    assert got == [
        ("a", 0, "MUTED", "r1"), ("a", 1_500, "UNMUTED", "r2"), ("a", 9_000, "MUTED", "r3"), ("a", 11_000, "UNMUTED", "safety:r3"),
        ("a", 40_000, "MUTED", "r4"), ("a", 42_000, "UNMUTED", "safety:r4"), ("b", 100, "MUTED", "x"), ("b", 200, "UNMUTED", "reset")]


def test_stream_dedupe(spark, tmp_path):
    rows = [("t", 1, "x", T0), ("t", 1, "x", T0 + 10), ("t", 1, "y", T0 + 20), ("u", 1, "x", T0 + 30)]
    s = stream(spark, str(tmp_path / "in"), rows, "track_id string, start_ms bigint, text string, ts_ms bigint")
    assert J.run_to_table(J.stream_dedupe(s).select("track_id", "text"), "d").count() == 3


def _many_batches(spark, folder, rows, schema, job, parts=6):
    """Output of a job over ``parts`` files, one a batch, with a stop and a restart from the checkpoint in between."""
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms"))
    names = frame.columns
    for k in range(parts):
        frame.where(f"part = {k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if k in (parts // 2, parts - 1):
            source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").select(*names)
            out = job(source)
            query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
            batches, held = len(query.recentProgress), query.lastProgress
    return frame, spark.read.schema(out.schema).parquet(f"{folder}/out"), batches, held


def _events(seed, n, spread_ms=900_000, late_ms=100_000):
    """Rows of a few keys; each comes in the file of its time or the next, some twice the length of a session apart."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.randrange(spread_ms) // 50 * 50  # many equal times
        rows.append((i, rnd.choice("ab") if i % 3 else "hot", T0 + t, min(5, t * 6 // spread_ms + (rnd.random() < 0.3))))
    end = T0 + spread_ms + 100_000_000
    return rows, [(n, "~end", end, 5)]


def test_mute_sessions_over_many_batches(spark, tmp_path):
    rows, end = _events(1, 400)
    rnd = random.Random(2)
    full = [(i, k, t, p, rnd.choice(["mute", "mute", "unmute", "unmute", "reset"] if i % 9 == 0 else ["mute", "unmute"]), rnd.choice(["r1", "r2", "r3"]),
             rnd.choice([None, -5, t - 9_000, t + rnd.randrange(0, 9_000), t + 400_000])) for i, k, t, p in rows + end]
    schema = "event_id bigint, tab_id string, ts_ms bigint, part int, kind string, reason_id string, expected_unmute_ms bigint"
    frame, got, batches, held = _many_batches(spark, str(tmp_path), full, schema, lambda s: J.mute_sessions(s, "400 seconds"))
    want = P.mute_changes(frame.where("tab_id <> '~end'"), chunk_seconds=60)
    plain = lambda df: sorted(map(tuple, df.where("tab_id <> '~end'").collect()))
    assert plain(got) == plain(want) == replay_mutes([r for r in full if r[1] != "~end"]) and len(plain(got)) > 50
    assert batches >= 3


def replay_mutes(rows):
    """One tab at a time, one event at a time."""
    out = []
    for tab in sorted({r[1] for r in rows}):
        held = {}

        def expire(now):
            for reason, e in sorted(held.items(), key=lambda x: (x[1], x[0])):
                if e <= now:
                    del held[reason]
                    if not held:
                        out.append((tab, e, "UNMUTED", f"safety:{reason}", 0))

        for i, _, t, _, kind, reason, end in sorted((r for r in rows if r[1] == tab), key=lambda r: (r[2], r[0])):
            expire(t)
            before = bool(held)
            if kind == "mute":
                wait = (end if end is not None and end >= 0 else t + 5_000) - t + 1_000
                held[reason] = t + min(wait, 300_000) if wait > 0 else 10**18
                if not before:
                    out.append((tab, t, "MUTED", reason, 1))
            else:
                if kind == "reset":
                    held.clear()
                else:
                    held.pop(reason, None)
                if before and not held:
                    out.append((tab, t, "UNMUTED", "reset" if kind == "reset" else reason, 0))
        expire(10**17)
    return sorted(out)


def test_keyed_streams_end_sessions_and_keep_event_order(spark, tmp_path):
    rows, end = _events(3, 300)
    rnd = random.Random(4)
    idle = 20_000
    segs = [(i, k, t, p, rnd.choice(["video-site", "network", "uploaded"]), "vod", rnd.randrange(100_000)) for i, k, t, p in rows + end]
    schema = "segment_id bigint, session_id string, ts_ms bigint, part int, source string, stream_type string, first_cue_ms bigint"

    def segments(df):
        return df.selectExpr("segment_id", "session_id", "ts AS arrival", "source", "stream_type", "first_cue_ms", "first_cue_ms + 5 AS last_cue_ms", "CAST(NULL AS BIGINT) AS mtp_ms",
                             "CAST(0 AS BIGINT) AS position_ms", "CAST(5 AS BIGINT) AS media_ms", "false AS has_map")

    frame, got, _, held = _many_batches(spark, str(tmp_path / "a"), segs, schema, lambda s: J.align_stream(segments(s), "400 seconds", idle))
    want = P.align_segments(segments(frame), 60, idle)
    pick = lambda df: sorted((r.segment_id, r.rising, r.alignment) for r in df.where("session_id <> '~end'").collect())
    assert pick(got) == pick(want) and pick(want) != pick(P.align_segments(segments(frame), 60))
    # all that waits or is remembered belongs to the last row's key
    assert sum(op.numRowsTotal for op in held.stateOperators) <= 4

    cues = [(i, k, t, p, rnd.choice(["cue", "cue", "cue", "upload", "unload", "pick"]), rnd.choice(["api", "user-upload"])) for i, k, t, p in rows + end]

    def uploads(s):
        return J.upload_suppression(s.where("kind = 'cue'").select("session_id", "event_id", "ts_ms", "source"), s.where("kind <> 'cue'").select("session_id", "event_id", "ts_ms", "kind"), "400 seconds", idle)

    _, got, _, _ = _many_batches(spark, str(tmp_path / "b"), cues, "event_id bigint, session_id string, ts_ms bigint, part int, kind string, source string", uploads)
    kept = []
    for key in "ab", "hot":
        for k in key if key == "ab" else [key]:
            active, last = False, None
            for i, _, t, _, kind, source in sorted((r for r in cues if r[1] == k), key=lambda r: (r[2], r[0])):
                active = active and t - last <= idle
                last = t
                if kind == "cue":
                    kept += [i] if source == "user-upload" or not active else []
                else:
                    active = kind == "upload"
    assert sorted(r.event_id for r in got.where("session_id <> '~end'").collect()) == sorted(kept)

    windows = spark.createDataFrame([(k, c, float(s), float(s + d)) for k in ("a", "b", "hot") for c, (s, d) in enumerate([(0, 9_000), (5_000, 200), (40_000, 300_000), (600_000, 1)])],
                                    "track_id string, cue_id int, start_ms double, end_ms double")
    beats = [(i, k, t, p, t - T0) for i, k, t, p in rows + end]
    job = lambda s: J.mute_transitions_stream(s.withColumn("track_id", F.col("session_id")), windows, delay="400 seconds", idle_ms=idle)
    frame, got, _, _ = _many_batches(spark, str(tmp_path / "c"), beats, "event_id bigint, session_id string, ts_ms bigint, part int, position_ms bigint", job)
    beats = frame.withColumn("track_id", F.col("session_id"))
    states = I.mute_state(beats, None, windows.withColumn("word", F.lit("w")), ["event_id"])
    want = P.mute_transitions(states, chunk_seconds=60, idle_ms=idle)
    pick = lambda df: sorted((r.event_id, r.action) for r in df.where("session_id <> '~end'").collect())
    assert pick(got) == pick(want) and len(pick(want)) > 5
