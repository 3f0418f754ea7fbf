"""Queries over playback positions: interval joins, as-of joins, jumps, alignment, mutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushline.functions import fixed_values as fv
from hushline.operators import censor as X, interval as I, merge as M, playback as P, timing as W
from hushline.operators.ordered import materialize
from hushline.plans import corpus as C, reference_sql as S
from hushline.plans.catalog_detect import _W, detected

CASES: dict[str, tuple] = {}
KEY = ["event_id"]


def case(name: str, sql: str | None = None):
    def add(fn):
        CASES[name] = (fn, sql)
        return fn

    return add


def positions(spark, sf):
    return C.heartbeats(spark, sf).select("event_id", "track_id", "position_ms")


def detected_near(spark, sf, sensitivity="medium", ahead_ms=0):
    """Detected cues, without those that no heartbeat can reach."""
    return detected(spark, sf, sensitivity, cues=I.reachable(C.document_cues(spark, sf), positions(spark, sf), ahead_ms))


ACTIVE = "FROM hb h JOIN cues c ON c.track_id = h.track_id AND c.start_ms <= h.position_ms AND h.position_ms <= c.end_ms"


@case("active_cues", S.with_(S.CUES, S.HEARTBEATS, then=f"SELECT h.event_id, h.track_id, h.position_ms, c.cue_id, c.start_ms AS cue_start_ms, c.end_ms AS cue_end_ms {ACTIVE}"))
def _(spark, sf):
    return I.active_cues(C.document_cues(spark, sf), positions(spark, sf))


@case("active_cues_salted", S.with_(S.CUES, S.HEARTBEATS, then="SELECT h.event_id, c.cue_id FROM hb h JOIN cues c ON c.track_id = h.track_id AND c.start_ms <= h.position_ms + 1500 AND h.position_ms + 1500 <= c.end_ms"))
def _(spark, sf):
    return I.active_cues(C.document_cues(spark, sf), positions(spark, sf), offset_ms=1500, salt=4).select("event_id", "cue_id")


@case("active_cues_by_size", S.with_(S.CUES, S.HEARTBEATS, then=f"SELECT h.event_id, c.cue_id {ACTIVE}"))
def _(spark, sf):
    """Only hot nodes are split, as a sketch of the positions tells."""
    return I.active_cues(C.document_cues(spark, sf), positions(spark, sf), salt=I.BY_SIZE).select("event_id", "cue_id")


@case("active_cue", S.with_(S.CUES, S.HEARTBEATS, then=f"SELECT h.event_id, arg_max(c.cue_id, c.start_ms) AS cue_id, max(c.start_ms) AS cue_start_ms {ACTIVE} GROUP BY h.event_id"))
def _(spark, sf):
    return I.active_cue(C.document_cues(spark, sf), positions(spark, sf), KEY).select("event_id", "cue_id", "cue_start_ms")


_STATE = f"""
hits AS (SELECT h.event_id, w.cue_id, w.word, w.start_ms, w.end_ms FROM hb h JOIN windows w ON w.track_id = h.track_id
  AND h.position_ms >= w.start_ms - {fv.MUTE_EARLY_MS} AND h.position_ms <= w.end_ms + {fv.MUTE_LATE_MS}),
pick AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY start_ms, end_ms, cue_id, word) AS rn FROM hits),
states AS (SELECT h.*, p.cue_id AS mute_cue_id, p.word AS mute_word, p.start_ms AS mute_start_ms, p.end_ms AS mute_end_ms, p.cue_id IS NOT NULL AS should_mute
  FROM hb h LEFT JOIN (SELECT * FROM pick WHERE rn = 1) p USING (event_id))"""


def _states(spark, sf):
    d = detected_near(spark, sf, ahead_ms=fv.MUTE_EARLY_MS)
    return I.mute_state(C.heartbeats(spark, sf), d.filter("has_profanity"), W.mute_windows(d), KEY)


@case("mute_state", S.with_(*_W, S.HEARTBEATS, _STATE, then="SELECT event_id, should_mute, mute_cue_id, mute_word, round(mute_start_ms, 3) AS mute_start_ms, round(mute_end_ms, 3) AS mute_end_ms FROM states"))
def _(spark, sf):
    return _states(spark, sf).select("event_id", "should_mute", "mute_cue_id", "mute_word", F.round("mute_start_ms", 3).alias("mute_start_ms"), F.round("mute_end_ms", 3).alias("mute_end_ms"))


@case("mute_state_high", S.with_(*S.ALL, S.detected("high"), S.HEARTBEATS, then=f"""
SELECT h.event_id, count(c.cue_id) > 0 AS should_mute, arg_min(c.cue_id, c.start_ms) AS mute_cue_id FROM hb h LEFT JOIN scored c ON c.has_profanity AND c.track_id = h.track_id
 AND h.position_ms >= c.start_ms - {fv.MUTE_EARLY_MS} AND h.position_ms < c.end_ms + {fv.MUTE_LATE_MS} GROUP BY h.event_id"""))
def _(spark, sf):
    d = detected_near(spark, sf, "high", fv.MUTE_EARLY_MS).filter("has_profanity")
    return I.mute_state(positions(spark, sf), d, None, KEY, "high").select("event_id", "should_mute", "mute_cue_id")


@case("next_cues", S.with_(S.CUES, S.HEARTBEATS, then="""
SELECT event_id, cue_id, cue_start_ms, rank FROM (SELECT h.event_id, c.cue_id, c.start_ms AS cue_start_ms, CAST(row_number() OVER (PARTITION BY h.event_id ORDER BY c.start_ms, c.cue_id) AS INTEGER) AS rank
 FROM hb h JOIN cues c ON c.track_id = h.track_id AND c.start_ms > h.position_ms) WHERE rank <= 2"""))
def _(spark, sf):
    return I.next_cues(C.document_cues(spark, sf), positions(spark, sf), KEY, 2).select("event_id", "cue_id", "cue_start_ms", "rank")


@case("next_cue_previews", S.with_(S.CUES, S.HEARTBEATS, then=f"""
SELECT event_id, cue_id, {S.format_time('start_ms')} || ': ' || substring(text, 1, 50) || CASE WHEN length(text) > 50 THEN '...' ELSE '' END AS preview FROM (SELECT h.event_id, c.cue_id, c.start_ms, c.text, row_number() OVER (PARTITION BY h.event_id ORDER BY c.start_ms, c.cue_id) AS rank
 FROM hb h JOIN cues c ON c.track_id = h.track_id AND c.start_ms > h.position_ms) WHERE rank <= 1"""))
def _(spark, sf):
    out = I.next_cues(C.document_cues(spark, sf), positions(spark, sf), KEY, 1, extra=["text"])
    return out.select("event_id", "cue_id", I.preview_text(F.col("cue_start_ms"), F.col("text")).alias("preview"))


@case("upcoming_flagged", S.with_(*S.ALL, S.detected(), S.HEARTBEATS, then="""
SELECT h.event_id, c.cue_id, c.start_ms AS item_start_ms FROM hb h JOIN scored c ON c.has_profanity AND c.track_id = h.track_id AND c.start_ms >= h.position_ms AND c.start_ms <= h.position_ms + 15000"""))
def _(spark, sf):
    items = detected_near(spark, sf, ahead_ms=15_000).filter("has_profanity").select("track_id", "cue_id", "start_ms", "end_ms")
    return I.upcoming_flagged(items, positions(spark, sf), 15_000).select("event_id", "cue_id", "item_start_ms")


@case("upcoming_windows", S.with_(*_W, S.HEARTBEATS, then="""
SELECT h.event_id, w.cue_id, w.word, round(w.start_ms, 3) AS item_start_ms FROM hb h JOIN windows w ON w.track_id = h.track_id AND w.start_ms >= h.position_ms AND w.start_ms <= h.position_ms + 5000"""))
def _(spark, sf):
    items = W.mute_windows(detected_near(spark, sf, ahead_ms=5_000)).select("track_id", "cue_id", "word", "start_ms", "end_ms")
    return I.upcoming_flagged(items, positions(spark, sf), 5_000).select("event_id", "cue_id", "word", F.round("item_start_ms", 3).alias("item_start_ms"))


@case("positions_to_cues", S.with_(*S.ALL, S.detected(), S.CENSORED, S.HEARTBEATS, then=f"""
SELECT event_id, cue_id, has_profanity, shown_text FROM (SELECT h.event_id, c.cue_id, c.has_profanity, {S.sanitize('CASE WHEN c.has_profanity THEN c.censored_text ELSE c.text END')} AS shown_text,
 row_number() OVER (PARTITION BY h.event_id ORDER BY c.start_ms DESC, c.cue_id) AS rn {ACTIVE.replace('JOIN cues', 'JOIN censored')}) WHERE rn = 1"""))
def _(spark, sf):
    out = I.positions_to_cues(positions(spark, sf), X.censor(detected_near(spark, sf)), KEY)
    return out.select("event_id", "cue_id", "has_profanity", "shown_text")


_ASOF = """
beats AS (SELECT * FROM hb WHERE event_type IN ('view', 'click', 'error')),
asks AS (SELECT * FROM hb WHERE event_type NOT IN ('view', 'click', 'error'))"""


@case("asof_position", S.with_(S.HEARTBEATS, _ASOF, then="""
SELECT a.event_id, a.session_id, CAST(coalesce(least(b.position_ms + CASE WHEN b.paused THEN 0 ELSE (a.ts_ms - b.ts_ms) * b.rate END, 150000), 0) AS DOUBLE) AS position_ms
 FROM asks a ASOF LEFT JOIN beats b ON a.session_id = b.session_id AND a.ts >= b.ts"""))
def _(spark, sf):
    hb = C.heartbeats(spark, sf)
    known = F.col("event_type").isin("view", "click", "error")
    out = I.asof_position(hb.filter(~known), hb.filter(known), duration_ms=F.lit(150_000))
    return out.select("event_id", "session_id", "position_ms")


@case("mute_transitions", S.with_(*_W, S.HEARTBEATS, _STATE, """
seq AS (SELECT *, lag(should_mute) OVER w AS was, lag(mute_cue_id) OVER w AS was_cue FROM states WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))""", then="""
SELECT event_id, session_id, CASE WHEN should_mute THEN 'MUTE' ELSE 'UNMUTE' END AS action, 'cue-' || CASE WHEN should_mute THEN mute_cue_id ELSE was_cue END AS reason_id,
 CASE WHEN should_mute THEN round(mute_end_ms, 3) END AS expected_unmute_ms FROM seq WHERE should_mute <> coalesce(was, FALSE)"""))
def _(spark, sf):
    out = P.mute_transitions(_states(spark, sf))
    return out.select("event_id", "session_id", "action", "reason_id", F.round("expected_unmute_ms", 3).alias("expected_unmute_ms"))


_SLOW = f"""{S.HEARTBEATS},
slow AS (SELECT * REPLACE (CAST(event_id % 3 + CAST(floor(value) AS BIGINT) % 50 + CASE event_type WHEN 'purchase' THEN 5000 WHEN 'signup' THEN 9000 ELSE 0 END AS BIGINT) AS position_ms) FROM hb),
near AS (SELECT *, 60 * rate AS thr, {', '.join(f'lag(position_ms, {i}) OVER w AS b{i}' for i in range(1, 6))}, {', '.join(f'lead(position_ms, {i}) OVER w AS n{i}' for i in range(1, 5))}
  FROM slow WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id))"""
_BACK = " OR ".join(f"coalesce(abs(b{i} - b{i + 1}) > thr AND abs(position_ms - b{i + 1}) < 2 * thr, FALSE)" for i in range(1, 5))
_HOVER = " OR ".join(f"coalesce(abs(n{i} - b1) < 2 * thr, FALSE)" for i in range(1, 5))


@case("classify_jumps", S.with_(_SLOW, then=f"""
SELECT event_id, position_ms - b1 AS delta_ms, CASE WHEN NOT (coalesce(abs(position_ms - b1) > thr, FALSE) AND NOT paused) THEN 'play' WHEN {_BACK} THEN 'return' WHEN {_HOVER} THEN 'hover' ELSE 'seek' END AS kind FROM near"""))
def _(spark, sf):
    return P.classify_jumps(C.slow_heartbeats(spark, sf)).select("event_id", "delta_ms", "kind")


# ------------------------------------------------------------------ segments from events

_SOURCES = ["hls", "fmovies", "plutotv-texttracks", "hls", "api"]
_TYPES = ["live", "vod", None, None, "live"]


def segments(spark, sf):
    return segments_of(C.heartbeats(spark, sf))


def segments_of(hb):
    e = F.col("event_id")
    of = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (e % len(xs) + 1).cast("int"))
    first = (e * 7919) % 400_000
    return hb.select(
        e.alias("segment_id"), "session_id", F.col("ts").alias("arrival"), of(_SOURCES).alias("source"),
        F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.floor(e / 3) % 5 + 1).cast("int")).alias("stream_type"), first.alias("first_cue_ms"),
        (first + 6000).alias("last_cue_ms"), F.when(e % 2 == 0, e % 1000).alias("mtp_ms"), F.when(e % 9 == 0, 0).otherwise(F.col("position_ms") * 3).alias("position_ms"),
        F.when(e % 4 == 0, 45_000).when(e % 4 == 1, 0).otherwise(5_400_000).cast("bigint").alias("media_ms"), (e % 3 != 0).alias("has_map"))


def _list(xs):
    return "[" + ", ".join("NULL" if x is None else S.q(x) for x in xs) + "]"


_SYNCED = "source IN (" + ", ".join(S.q(s) for s in fv.SYNCED_SEGMENT_SOURCES) + ")"
SEGMENTS = f"""{S.HEARTBEATS},
seg AS (SELECT event_id AS segment_id, session_id, ts AS arrival, {_list(_SOURCES)}[event_id % 5 + 1] AS source, {_list(_TYPES)}[(event_id // 3) % 5 + 1] AS stream_type, (event_id * 7919) % 400000 AS first_cue_ms,
  (event_id * 7919) % 400000 + 6000 AS last_cue_ms, CASE WHEN event_id % 2 = 0 THEN event_id % 1000 END AS mtp_ms, CASE WHEN event_id % 9 = 0 THEN 0 ELSE position_ms * 3 END AS position_ms,
  CASE event_id % 4 WHEN 0 THEN 45000 WHEN 1 THEN 0 ELSE 5400000 END AS media_ms, event_id % 3 <> 0 AS has_map FROM hb),
seg2 AS (SELECT *, {_SYNCED} AS synced, NOT {_SYNCED} AND coalesce(first_cue_ms > lag(CASE WHEN NOT ({_SYNCED}) THEN first_cue_ms END) OVER (PARTITION BY session_id ORDER BY arrival, segment_id), FALSE) AS rising FROM seg),
seg3 AS (SELECT *, (first_cue_ms > 30000 AND media_ms > 0 AND first_cue_ms > media_ms * 2) OR rising AS absolute FROM seg2),
seg4 AS (SELECT *, coalesce(stream_type = 'live' OR (stream_type IS NULL AND media_ms > 0 AND media_ms < 60000 AND absolute), FALSE) AND has_map AS live FROM seg3),
aligned AS (SELECT *, CASE WHEN synced THEN 'synced' WHEN live AND absolute THEN 'live-absolute' WHEN live THEN 'live-relative' ELSE 'vod' END AS alignment,
  CAST(CASE WHEN synced THEN 0 WHEN live AND absolute THEN position_ms - first_cue_ms WHEN live THEN coalesce(mtp_ms, 0) ELSE 0 END AS BIGINT) AS shift_ms,
  synced OR live OR position_ms = 0 OR (first_cue_ms <= position_ms + 30000 AND last_cue_ms >= position_ms - 30000) AS kept FROM seg4)"""


@case("align_segments", S.with_(SEGMENTS, then="SELECT segment_id, rising, alignment, shift_ms, kept FROM aligned"))
def _(spark, sf):
    return P.align_segments(segments(spark, sf)).select("segment_id", "rising", "alignment", "shift_ms", "kept")


@case("shift_cues", S.with_(SEGMENTS, then="""
SELECT segment_id, k AS cue_id, first_cue_ms + k * 2000 + shift_ms AS start_ms, first_cue_ms + k * 2000 + 1500 + shift_ms AS end_ms FROM aligned, unnest([0, 1, 2]) AS t(k) WHERE kept"""))
def _(spark, sf):
    seg = segments(spark, sf)
    cues = seg.select("segment_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cue_id"), "first_cue_ms")
    start = F.col("first_cue_ms") + F.col("cue_id") * 2000
    cues = cues.select("segment_id", "cue_id", start.alias("start_ms"), (start + 1500).alias("end_ms"))
    return P.shift_cues(cues, P.align_segments(seg))


@case("segment_relevant", S.with_(SEGMENTS, """
now AS (SELECT session_id, arg_max(position_ms, event_id) AS pos FROM hb GROUP BY session_id)""", then="""
SELECT segment_id FROM seg JOIN now USING (session_id) WHERE pos = 0 OR (first_cue_ms <= pos + 30000 AND last_cue_ms >= pos - 30000)"""))
def _(spark, sf):
    now = C.heartbeats(spark, sf).groupBy("session_id").agg(F.max_by("position_ms", "event_id").alias("position_ms"))
    return I.segment_relevant(segments(spark, sf).drop("position_ms"), now).select("segment_id")


# ------------------------------------------------------------------ merging

_SPLIT = """
old AS (SELECT * FROM cues),
new AS (SELECT track_id, cue_id, CASE WHEN CAST(track_id AS BIGINT) % 5 = 0 THEN start_ms + 7 ELSE start_ms END AS start_ms, CASE WHEN CAST(track_id AS BIGINT) % 5 = 0 THEN end_ms + 7 ELSE end_ms END AS end_ms, CASE WHEN cue_id % 4 = 1 THEN text || '.' ELSE text END AS text,
  ['user-upload', 'youtube', 'plutotv-x', 'fmovies', 'api', 'my.user-subtitle'][CAST(track_id AS BIGINT) % 6 + 1] AS source, language FROM cues)"""


def two_versions(spark, sf, stored: bool = False):
    """All cues, and all cues as another source has them: some tracks later, some cues reworded."""
    cues = C.document_cues(spark, sf)
    cues = materialize(cues) if stored else cues
    t = F.col("track_id").cast("bigint")
    moved = F.when(t % 5 == 0, 7).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("user-upload", "youtube", "plutotv-x", "fmovies", "api", "my.user-subtitle")])
    new = cues.withColumn("start_ms", F.col("start_ms") + moved).withColumn("end_ms", F.col("end_ms") + moved)
    new = new.withColumn("text", F.when(F.col("cue_id") % 4 == 1, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return cues, new.withColumn("source", F.element_at(names, (t % 6 + 1).cast("int")))


@case("new_cues_only", S.with_(S.CUES, _SPLIT, then="SELECT track_id, cue_id, start_ms FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.track_id = n.track_id AND o.start_ms = n.start_ms AND o.text = n.text)"))
def _(spark, sf):
    old, new = two_versions(spark, sf)
    return M.new_cues_only(old, new).select("track_id", "cue_id", "start_ms")


_RANGES = """
ro AS (SELECT track_id, min(start_ms) AS s, arg_max(end_ms, start_ms) AS e, count(*) AS n, arg_min(source, start_ms) AS src FROM old GROUP BY track_id),
rn AS (SELECT track_id, min(start_ms) AS s, arg_max(end_ms, start_ms) AS e, count(*) AS n, arg_min(source, start_ms) AS src FROM new GROUP BY track_id),
lap AS (SELECT track_id, greatest(0, least(ro.e, rn.e) - greatest(ro.s, rn.s)) AS overlap_ms, rn.n > 5 AND ro.e - ro.s > 0 AND greatest(0, least(ro.e, rn.e) - greatest(ro.s, rn.s)) > (ro.e - ro.s) * 0.5 AS replaces FROM ro JOIN rn USING (track_id))"""


@case("range_overlap", S.with_(S.CUES, _SPLIT, _RANGES, then="SELECT * FROM lap"))
def _(spark, sf):
    old, new = two_versions(spark, sf)
    return M.range_overlap(old, new, min_cues=5).select("track_id", "overlap_ms", "replaces")


_POLICY = """
pol AS (SELECT rn.track_id, CASE WHEN ro.src = 'src0' AND NOT (rn.src IN ('user-upload', 'user-selection') OR contains(rn.src, 'user-subtitle')) THEN 'reject' WHEN ro.src IS NULL THEN 'accumulate'
  WHEN rn.src IN ('user-upload', 'user-selection', 'lookmovie.user-subtitle-selected', 'lookmovie.auto-selected') OR contains(rn.src, 'user-subtitle') THEN 'replace' WHEN rn.src = 'fmovies' AND rn.n > 100 AND l.replaces THEN 'replace' ELSE 'accumulate' END AS policy
  FROM rn LEFT JOIN ro USING (track_id) LEFT JOIN lap l USING (track_id))"""


def _uploads(cues):
    return cues.filter("source = 'src0'").select("track_id").distinct()


@case("merge_policies", S.with_(S.CUES, _SPLIT, _RANGES, _POLICY, then="SELECT * FROM pol"))
def _(spark, sf):
    old, new = two_versions(spark, sf)
    return M.merge_policies(old, new, _uploads(C.document_cues(spark, sf)))


@case("merge_cues", S.with_(S.CUES, _SPLIT, _RANGES, _POLICY, """
kept AS (SELECT o.*, 0 AS side FROM old o LEFT JOIN pol USING (track_id) WHERE coalesce(policy, 'accumulate') <> 'replace'),
added AS (SELECT n.*, 1 AS side FROM new n JOIN pol USING (track_id) WHERE policy <> 'reject' AND NOT EXISTS (SELECT 1 FROM kept o WHERE o.track_id = n.track_id AND o.start_ms = n.start_ms AND o.text = n.text))""".replace("kept AS", "kept_old AS").replace("FROM kept o", "FROM kept_old o"), then="""
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_ms, side, cue_id) - 1 AS INTEGER) AS cue_id, start_ms, end_ms, text, source FROM (SELECT * FROM kept_old UNION ALL SELECT * FROM added)"""))
def _(spark, sf):
    old, new = two_versions(spark, sf, stored=True)
    out = M.merge_cues(old, new, M.merge_policies(old, new, _uploads(old)))
    return out.select("track_id", "cue_id", "start_ms", "end_ms", "text", "source")


@case("renumber", S.with_(S.CUES, then="SELECT track_id, start_ms, text, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_ms, cue_id) - 1 AS INTEGER) AS cue_id FROM (SELECT language AS track_id, start_ms, text, cue_id + 100000 * CAST(track_id AS BIGINT) AS cue_id FROM cues)"))
def _(spark, sf):
    """All cues of a language as one track: the largest holds most of the table."""
    cues = C.document_cues(spark, sf)
    one = cues.select(F.col("language").alias("track_id"), "start_ms", "text", (F.col("cue_id") + 100_000 * F.col("track_id").cast("bigint")).alias("cue_id"))
    return M.renumber(one, chunk_ms=2_000).select("track_id", "start_ms", "text", "cue_id")


@case("sort_cues", S.with_(S.CUES, then="SELECT track_id, cue_id, start_ms FROM cues ORDER BY track_id, start_ms, cue_id"))
def _(spark, sf):
    return M.sort_cues(C.document_cues(spark, sf)).select("track_id", "cue_id", "start_ms")


_OVERRIDES = [("src1", "high", None, False), ("src2", None, 250, None), ("src3", "low", -100, True)]


@case("resolve_profile", f"""
SELECT doc_id, coalesce(o.sensitivity, 'medium') AS sensitivity, coalesce(o.offset_ms, 40) AS offset_ms, coalesce(o.use_substitutions, FALSE) AS use_substitutions, 'en' AS preferred_language, 2 AS upcoming_count
 FROM documents d LEFT JOIN {S.values(_OVERRIDES, 'site, sensitivity, offset_ms, use_substitutions')} o ON o.site = d.source""")
def _(spark, sf):
    rows = C.table(spark, sf, "documents").select("doc_id", F.col("source").alias("site"))
    overrides = spark.createDataFrame(_OVERRIDES, "site string, sensitivity string, offset_ms int, use_substitutions boolean")
    stored = spark.createDataFrame([(40, False)], "offset_ms int, use_substitutions boolean")
    return M.resolve_profile(rows, stored, overrides).select("doc_id", "sensitivity", "offset_ms", "use_substitutions", "preferred_language", "upcoming_count")
