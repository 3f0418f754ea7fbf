"""Streaming jobs over the given tables; the keyed ones in several runs, with rows out of order."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushline.functions import fixed_values as fv
from hushline.operators import playback as P, timing as W
from hushline.plans import corpus as C, reference_sql as S
from hushline.plans.catalog_detect import _W
from hushline.plans.catalog_playback import SEGMENTS, _STATE, detected_near, segments_of
from hushline.streaming import jobs as J

CASES: dict[str, tuple] = {}
#: The comparison SQL knows no end of a session.
UNENDING = 10**12


def case(name: str, sql: str | None = None):
    def add(fn):
        CASES[name] = (fn, sql)
        return fn

    return add


@case("stream_detect", S.with_(*S.ALL, S.detected(), then="SELECT track_id, cue_id, round(score, 3) AS score, has_profanity FROM scored"))
def _(spark, sf):
    docs = J.table_stream(spark, sf, "documents")
    cues = C.lines_to_cues(docs, F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang"))
    r = C.corpus_rules(spark)
    out = J.stream_detect(cues, r["lexicon"], r["patterns"], r["rules"], r["exempt"])
    return J.run_to_table(out.select("track_id", "cue_id", F.round("score", 3).alias("score"), "has_profanity"), "detect")


def _beats(spark, sf):
    return C.as_heartbeats(J.table_stream(spark, sf, "events"))


@case("stream_dedupe", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS track_id, CAST(floor(value) AS BIGINT) * 1000 AS start_ms, event_type AS text FROM events")
def _(spark, sf):
    """Segments that overlap: many rows of one start and text per track."""
    hb = _beats(spark, sf)
    cues = hb.select("track_id", (F.floor("value") * 1000).alias("start_ms"), F.col("event_type").alias("text"), "ts")
    return J.run_to_table(J.stream_dedupe(cues, "60 days").select("track_id", "start_ms", "text"), "dedupe")


@case("status_windows", S.with_(S.HEARTBEATS, then="""
SELECT session_id, (ts_ms // 3600000) * 3600000 AS window_start_ms, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS flagged, CAST(count(*) FILTER (NOT paused) AS BIGINT) AS playing, max(position_ms) AS last_position_ms FROM hb
GROUP BY session_id, ts_ms // 3600000 HAVING (ts_ms // 3600000) * 3600000 + 3600000 <= (SELECT max(epoch_us(ts)) // 1000 - 10000 FROM events)"""))
def _(spark, sf):
    """Hours that the watermark has passed; the last one stays open."""
    hb = _beats(spark, sf).withColumn("flagged", F.col("event_type") == "click")
    return J.run_to_table(J.status_windows(hb, "1 hour"), "status")


@case("visits", S.with_(S.HEARTBEATS, """
v1 AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w < 7200000 THEN 0 ELSE 1 END AS opens FROM (SELECT session_id, epoch_us(ts) / 1000 AS ts_ms, event_id FROM hb) WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id)),
v2 AS (SELECT *, sum(opens) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS visit FROM v1)""", then="""
SELECT session_id, CAST(floor(min(ts_ms)) AS BIGINT) AS start_ms, CAST(floor(max(ts_ms) + 7200000) AS BIGINT) AS end_ms, CAST(count(*) AS BIGINT) AS n FROM v2 GROUP BY session_id, visit HAVING max(ts_ms) + 7200000 <= (SELECT floor(max(epoch_us(ts)) / 1000) - 10000 FROM events)"""))
def _(spark, sf):
    return J.run_to_table(J.visits(_beats(spark, sf), "2 hours"), "visits")


@case("detected_urls", """WITH r AS (SELECT event_id AS request_id, user_id, epoch_us(ts) // 1000 AS ts_ms, event_type, '/s/' || (event_id % 5) || '_en.vtt' AS p FROM events),
g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ms, request_id ROWS UNBOUNDED PRECEDING) AS page FROM r)
SELECT CAST(user_id AS VARCHAR) AS tab_id, ts_ms, 'https://h.test' || p AS url, 'en' AS language, 'vtt' AS format, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY user_id, page, p ORDER BY ts_ms, request_id) >= 36000000, TRUE) AS is_new FROM g WHERE event_type IN ('view', 'click')""")
def _(spark, sf):
    """Requests read off the events; a signup is a navigation."""
    hb = _beats(spark, sf)
    t = F.col("event_type")
    path = F.concat(F.lit("https://h.test/s/"), (F.col("event_id") % 5).cast("string"), F.lit("_en.vtt"))
    requests = hb.select(
        F.col("event_id").alias("request_id"), F.col("session_id").alias("tab_id"), "ts", F.when(t.isin("view", "click"), path).otherwise("https://h.test/page").alias("url"),
        F.lit("").alias("content_type"), F.when(t == "signup", "navigate").otherwise("request").alias("kind"))
    return J.run_to_table(J.detected_urls(requests, ttl_ms=36_000_000, delay="0 seconds"), "urls")


@case("align_stream", S.with_(SEGMENTS, then="SELECT segment_id, rising, alignment, shift_ms FROM aligned WHERE kept"))
def _(spark, sf):
    out = J.replayed(segments_of(C.heartbeats(spark, sf)), lambda s, delay: J.align_stream(s, delay, UNENDING), "align", time="arrival", late="segment_id")
    return out.select("segment_id", "rising", "alignment", "shift_ms")


def mute_events(hb):
    """Mute events read off the events."""
    t = F.col("event_type")
    return hb.select(
        "event_id", F.col("session_id").alias("tab_id"), "ts", F.when(t.isin("view", "purchase"), "mute").when(t == "error", "reset").otherwise("unmute").alias("kind"),
        F.concat(F.lit("cue-"), (F.col("event_id") % 3).cast("string")).alias("reason_id"),
        F.when(F.col("event_id") % 10 != 0, F.col("ts_ms") + (F.col("value") * 20_000).cast("bigint")).alias("expected_unmute_ms"))


#: Intervals per reason, then a sweep over their edges.
MUTES = S.with_(S.HEARTBEATS, """
ev AS (
  SELECT event_id, session_id AS tab_id, ts_ms AS t, CASE WHEN event_type IN ('view', 'purchase') THEN 'mute' WHEN event_type = 'error' THEN 'reset' ELSE 'unmute' END AS kind,
         'cue-' || (event_id % 3) AS reason_id, CASE WHEN event_id % 10 <> 0 THEN ts_ms + CAST(trunc(value * 20000) AS BIGINT) END AS expected FROM hb),
lim AS (SELECT *, coalesce(CASE WHEN expected >= 0 THEN expected END, t + 5000) - t + 1000 AS wait FROM ev),
nxt AS (
  SELECT *, lead(t) OVER same AS same_t, lead(event_id) OVER same AS same_id,
         first_value(CASE WHEN kind = 'reset' THEN t END IGNORE NULLS) OVER later AS reset_t, first_value(CASE WHEN kind = 'reset' THEN event_id END IGNORE NULLS) OVER later AS reset_id
  FROM lim WINDOW same AS (PARTITION BY tab_id, reason_id, kind = 'reset' ORDER BY t, event_id), later AS (PARTITION BY tab_id ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
held AS (SELECT tab_id, event_id, t, reason_id, unnest([
    CASE WHEN same_t IS NOT NULL THEN {'t': same_t, 'phase': 1, 'id': same_id, 'label': reason_id} END,
    CASE WHEN reset_t IS NOT NULL THEN {'t': reset_t, 'phase': 1, 'id': reset_id, 'label': 'reset'} END,
    CASE WHEN wait > 0 THEN {'t': t + least(wait, 300000), 'phase': 0, 'id': 0, 'label': 'safety:' || reason_id} END]) AS c FROM nxt WHERE kind = 'mute'),
closing AS (SELECT tab_id, event_id, min(c) AS c FROM held WHERE c IS NOT NULL GROUP BY tab_id, event_id),
edges AS (
  SELECT tab_id, t, 1 AS phase, event_id AS id, 0 AS side, reason_id AS label, 1 AS step FROM nxt WHERE kind = 'mute'
  UNION ALL SELECT tab_id, c.t, c.phase, c.id, 1, c.label, -1 FROM closing),
swept AS (SELECT *, sum(step) OVER (PARTITION BY tab_id ORDER BY t, phase, id, side, label ROWS UNBOUNDED PRECEDING) AS n FROM edges)""", then="""
SELECT tab_id, t AS ts_ms, CASE WHEN step = 1 THEN 'MUTED' ELSE 'UNMUTED' END AS action, label AS reason_id, CASE WHEN step = 1 THEN 1 ELSE 0 END AS active
FROM swept WHERE (step = 1 AND n = 1) OR (step = -1 AND n = 0)""")


@case("mute_sessions", MUTES)
def _(spark, sf):
    return J.replayed(mute_events(C.heartbeats(spark, sf)), J.mute_sessions, "mutes", key="tab_id")


@case("mute_changes", MUTES)
def _(spark, sf):
    return P.mute_changes(mute_events(C.heartbeats(spark, sf)))


@case("mute_transitions_stream", S.with_(*_W, S.HEARTBEATS, _STATE, """
seq AS (SELECT *, lag(should_mute) OVER w AS was, lag(mute_cue_id) OVER w AS was_cue FROM states WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, event_id))""", then="""
SELECT event_id, session_id, ts_ms, CASE WHEN should_mute THEN 'MUTE' ELSE 'UNMUTE' END AS action, CAST(CASE WHEN should_mute THEN mute_cue_id ELSE was_cue END AS BIGINT) AS cue_id FROM seq WHERE should_mute <> coalesce(was, FALSE)"""))
def _(spark, sf):
    from hushline.operators.ordered import materialize

    windows = materialize(W.mute_windows(detected_near(spark, sf, ahead_ms=fv.MUTE_EARLY_MS)))
    return J.replayed(C.heartbeats(spark, sf), lambda s, delay: J.mute_transitions_stream(s, windows, delay=delay, idle_ms=UNENDING), "transitions")


@case("upload_suppression", """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS ts_ms, event_type, CASE WHEN event_id % 6 = 0 THEN 'user-upload' ELSE 'api' END AS source FROM events),
g AS (SELECT *, last_value(CASE event_type WHEN 'purchase' THEN TRUE WHEN 'error' THEN FALSE WHEN 'signup' THEN FALSE END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS active FROM e)
SELECT session_id, event_id, ts_ms, source FROM g WHERE event_type IN ('view', 'click') AND (source = 'user-upload' OR NOT coalesce(active, FALSE))""")
def _(spark, sf):
    t = F.col("event_type")

    def job(hb, delay):
        hb = hb.withColumn("ts_ms", F.unix_millis("ts"))
        cues = hb.filter(t.isin("view", "click")).select("session_id", "event_id", "ts_ms", F.when(F.col("event_id") % 6 == 0, "user-upload").otherwise("api").alias("source"))
        control = hb.filter(~t.isin("view", "click")).select("session_id", "event_id", "ts_ms", F.when(t == "purchase", "upload").when(t == "error", "unload").otherwise("pick").alias("kind"))
        return J.upload_suppression(cues, control, delay, UNENDING)

    return J.replayed(C.heartbeats(spark, sf), job, "uploads")
