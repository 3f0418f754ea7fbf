"""Structured Streaming jobs.

State is keyed by tab or session.  A micro-batch is bounded by the source's rate
options (files or offsets per trigger); rows of one key wait for the watermark
and touch the state in event order.
"""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hushline.functions import fixed_values as fv, language as G, urls as U
from hushline.operators import detect as D, interval as I, playback as P

# executors need not have this package installed to run the processors below
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAFETY_EXTRA_MS, SAFETY_MAX_MS, INVALID_EXPECTED_MS = P.SAFETY_EXTRA_MS, P.SAFETY_MAX_MS, P.INVALID_EXPECTED_MS
#: A session without a row for a day is over; what it remembers is forgotten.
IDLE_MS = 86_400_000


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for stream output and checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``; a machine's own
    temporary folder is used only in local mode.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data that is available now; read what it wrote."""
    spark = stream.sparkSession
    folder = workspace(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """One of the given tables as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(sf_dir))


# ---------------------------------------------------------------- stateless and built-in state


def stream_detect(cue_stream: DataFrame, lexicon: DataFrame, patterns=None, rules=None, exempt=None, sensitivity: str = "medium", use_context: bool = True) -> DataFrame:
    """Detection on arrival; the lexicon is part of the plan, so there is no join and no state."""
    return D.detect_matches(cue_stream, lexicon, patterns, rules, exempt, sensitivity, use_context)


def stream_dedupe(cue_stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per (track, start, text) across overlapping segments."""
    keyed = cue_stream.withColumn("_text", F.md5("text")).withWatermark("ts", delay)
    return keyed.dropDuplicatesWithinWatermark(["track_id", "start_ms", "_text"]).drop("_text")


def status_windows(heartbeats: DataFrame, width: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Counts per session and time window."""
    return (
        heartbeats.withWatermark("ts", delay).groupBy(F.window("ts", width), "session_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"), F.count_if(~F.col("paused")).alias("playing"),
             F.max("position_ms").alias("last_position_ms"))
        .select("session_id", F.unix_millis("window.start").alias("window_start_ms"), "n", "flagged", "playing", "last_position_ms"))


def visits(heartbeats: DataFrame, gap: str = "30 minutes", delay: str = "10 seconds") -> DataFrame:
    """Visits of a session: heartbeats with no gap longer than ``gap``."""
    return (
        heartbeats.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("session_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n"))


# ---------------------------------------------------------------- keyed state


def _columns(schema) -> list[tuple[str, bool]]:
    """Names of a row's columns, and whether they hold whole numbers."""
    return [(f.name, f.dataType.typeName() in ("integer", "long", "short", "byte")) for f in schema]


def _tuples(frame, columns: list[tuple[str, bool]]) -> list[tuple]:
    """Rows as the state store takes them: plain numbers, null for what is missing."""
    parts = [[None if x is None or x != x else int(x) if whole else x for x in frame[name].tolist()] for name, whole in columns]
    return list(zip(*parts, strict=True))


class _InOrder(StatefulProcessor):
    """Base: rows wait until the watermark has passed them, then reach ``on_rows`` in event order.

    Rows may thus come in any order, and over any number of batches, as long as
    none is later than the watermark's delay; those that are, are dropped by the
    engine.  A timer stands at the first waiting row.  When a key has had no row for
    ``idle_ms`` its session is over, and its state goes.  ``ts_ms`` must be the
    time of the watermark.
    """

    order = ["ts_ms"]
    columns: list[str] = []
    schema = ""

    def __init__(self, rows, idle_ms: int = 0):
        self.fields, self.types = _columns(rows.schema), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.types)
        self.value = handle.getValueState("value", self.schema)

    def load(self):
        """State of the current key: null, or a tuple of which the last is the time of its last row."""
        return self.value.get() if self.value.exists() else None

    def save(self, state) -> None:
        if state is None:
            self.value.clear()
        else:
            self.value.update(tuple(state))

    def on_rows(self, key, rows, state):
        """Output rows, and the new state."""
        raise NotImplementedError

    def on_time(self, key, now: int, state):
        """Output rows when time has come to ``now``, and the new state: none if the session is over."""
        if state is not None and state[-1] + self.idle_ms <= now:
            state = None
        return None, state

    def next_time(self, state) -> int | None:
        return None if state is None else int(state[-1]) + self.idle_ms

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for frame in rows:
            self.waiting.appendList(_tuples(frame, self.fields))
            low = int(frame["ts_ms"].min())
            first = low if first is None else min(first, low)
        self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.waiting.get()), columns=[n for n, _ in self.fields])
        state, out = self.load(), []
        ready = held[held["ts_ms"] <= now]
        if len(ready):
            found, state = self.on_rows(key, ready.sort_values(self.order, kind="stable").reset_index(drop=True), state)
            out.append(found)
            rest = held[held["ts_ms"] > now]
            if len(rest):
                self.waiting.put(_tuples(rest, self.fields))
                self.handle.registerTimer(int(rest["ts_ms"].min()))
            else:
                self.waiting.clear()
        found, state = self.on_time(key, now, state)
        out.append(found)
        self.save(state)
        if (due := self.next_time(state)) is not None:
            self.handle.registerTimer(due)
        for frame in out:
            if frame is not None and len(frame):
                yield frame[self.columns]

    def close(self) -> None:
        pass


class _AtOnce(StatefulProcessor):
    """Base: hand the rows of a key and batch to ``on_row`` in event order, emit what it yields.

    Every state call is a round trip to the engine, so the state of a key is
    loaded once per batch, changed in memory and saved once.
    """

    order = ["ts_ms"]
    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        state, out = self.load(), []
        for row in batch.itertuples(index=False):
            out.extend(self.on_row(key, row, state))
        self.save(state)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class _UrlSightings(_AtOnce):
    order = ["ts_ms", "request_id"]
    columns = ["tab_id", "ts_ms", "url", "language", "format", "is_new"]

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        super().init(handle)
        self.seen = handle.getMapState("seen", "url string", "ts_ms bigint")

    def load(self):
        known = {k[0]: v[0] for k, v in self.seen.iterator()}
        return {"urls": known, "cleared": False, "changed": set()}

    def save(self, state):
        if state["cleared"]:
            self.seen.clear()
        for url in state["changed"]:
            self.seen.updateValue((url,), (state["urls"][url],))
        if state["changed"]:
            self.handle.registerTimer(max(state["urls"][u] for u in state["changed"]) + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Forget URLs whose time is over; nothing is emitted."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        for url, ts in [(k[0], v[0]) for k, v in self.seen.iterator()]:
            if ts + self.ttl_ms <= now:
                self.seen.removeKey((url,))
        return iter(())

    def on_row(self, key, row, state):
        if row.kind == "navigate":
            state["urls"].clear()
            state["changed"].clear()
            state["cleared"] = True
            return
        last = state["urls"].get(row.url)
        new = last is None or row.ts_ms - last >= self.ttl_ms
        state["urls"][row.url] = int(row.ts_ms)
        state["changed"].add(row.url)
        yield (key[0], int(row.ts_ms), row.url, row.language, row.format, new)


def detected_urls(requests: DataFrame, ttl_ms: int = 300_000, delay: str = "10 minutes") -> DataFrame:
    """Sightings of subtitle URLs per tab; ``is_new`` tells the first one of a page.

    ``requests(request_id, tab_id, ts, url, content_type, kind)``.  A URL is
    forgotten on navigation and when it was not seen for the time to live, in
    event time, so that a replay gives the same result.
    """
    use_state_store(requests.sparkSession)
    wanted = requests.withWatermark("ts", delay).filter((F.col("kind") == "navigate") | U.is_subtitle_url(F.col("url"))).select(
        "request_id", "tab_id", "ts", F.unix_millis("ts").alias("ts_ms"), "kind", "url", G.url_language(F.col("url")).alias("language"),
        U.url_format(F.col("url"), F.col("content_type")).alias("format"))
    return wanted.groupBy("tab_id").transformWithStateInPandas(
        _UrlSightings(ttl_ms), "tab_id string, ts_ms bigint, url string, language string, format string, is_new boolean",
        "Append", "EventTime")


def _before(rows, name: str, state, at: int, idle_ms: int):
    """A column's value in the row before, over the border of batches; missing after a session's end."""
    import pandas as pd

    old = pd.Series([None if state is None else state[at]], dtype=object)
    times = pd.concat([pd.Series([None if state is None else state[-1]], dtype=object), rows["ts_ms"].astype(object)], ignore_index=True)
    gap = pd.to_numeric(times).diff().iloc[1:].reset_index(drop=True)
    values = pd.concat([old, rows[name].astype(object)], ignore_index=True).iloc[:-1]
    return values.where((gap <= idle_ms).to_numpy())


class _FirstCue(_InOrder):
    order = ["ts_ms", "segment_id"]
    schema = "first_cue_ms bigint, ts_ms bigint"

    def __init__(self, rows, idle_ms, synced):
        super().__init__(rows, idle_ms)
        self.columns = [*rows.columns, "rising", "_synced"]
        self.synced = list(synced)

    def on_rows(self, key, rows, state):
        import pandas as pd

        rows["_synced"] = rows["source"].isin(self.synced)
        rows["_first"] = rows["first_cue_ms"].astype(object).where(~rows["_synced"])
        before = pd.to_numeric(_before(rows, "_first", state, 0, self.idle_ms)).to_numpy(float)
        rows["rising"] = ~rows["_synced"] & (pd.to_numeric(rows["first_cue_ms"]).to_numpy(float) > before)
        last = rows["_first"].iloc[-1]
        return rows, (None if last is None or last != last else int(last), int(rows["ts_ms"].iloc[-1]))


def align_stream(segments: DataFrame, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Alignment of segments in the order of their arrival times; out-of-range ones are dropped as late data.

    Only the previous first-cue time of a session is state, until the session is
    idle for ``idle_ms``; the rest is columns.
    """
    use_state_store(segments.sparkSession)
    flat = segments.withWatermark("arrival", delay).withColumn("ts_ms", F.unix_millis("arrival"))
    flat = flat.select("arrival", *[c for c in flat.columns if c != "arrival"])
    one = _FirstCue(flat.drop("arrival"), idle_ms, fv.SYNCED_SEGMENT_SOURCES)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.drop("arrival").schema) + ", rising boolean, _synced boolean"
    marked = flat.groupBy("session_id").transformWithStateInPandas(one, schema, "Append", "EventTime")
    return P._aligned(marked).filter("kept").drop("_synced")


class _Reasons(_InOrder):
    """State: the reasons that hold a tab muted, each with the time of its end; no reason, no state."""

    order = ["ts_ms", "event_id"]
    columns = ["tab_id", "ts_ms", "action", "reason_id", "active"]

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.types)
        self.reasons = handle.getMapState("reasons", "reason string", "expiry_ms bigint")

    def load(self):
        self.old = {k[0]: v[0] for k, v in self.reasons.iterator()}
        return dict(self.old)

    def save(self, state):
        for reason in self.old.keys() - state.keys():
            self.reasons.removeKey((reason,))
        for reason, expiry in state.items():
            if self.old.get(reason) != expiry:
                self.reasons.updateValue((reason,), (expiry,))

    def next_time(self, state):
        ends = [e for e in state.values() if e < sys.maxsize]
        return min(ends) if ends else None

    @staticmethod
    def expire(key, now, state):
        """Drop reasons whose safety time has come, oldest first."""
        for reason, expiry in sorted(state.items(), key=lambda x: (x[1], x[0])):
            if expiry <= now:
                del state[reason]
                if not state:
                    yield (key[0], int(expiry), "UNMUTED", f"safety:{reason}", 0)

    def _replay(self, key, rows, state):
        for row in rows.itertuples(index=False):
            now = int(row.ts_ms)
            yield from self.expire(key, now, state)
            was_muted = bool(state)
            if row.kind == "mute":
                given = row.expected_unmute_ms
                expected = int(given) if given is not None and given == given and given >= 0 else now + INVALID_EXPECTED_MS
                # an end that has already passed gets no safety time
                delay = expected - now + SAFETY_EXTRA_MS
                state[row.reason_id] = now + min(delay, SAFETY_MAX_MS) if delay > 0 else sys.maxsize
                if not was_muted:
                    yield (key[0], now, "MUTED", row.reason_id, 1)
            elif was_muted:
                if row.kind == "reset":
                    state.clear()
                else:
                    state.pop(row.reason_id, None)
                if not state:
                    yield (key[0], now, "UNMUTED", "reset" if row.kind == "reset" else row.reason_id, 0)

    def on_rows(self, key, rows, state):
        import pandas as pd

        return pd.DataFrame(list(self._replay(key, rows, state)), columns=self.columns), state

    def on_time(self, key, now, state):
        import pandas as pd

        return pd.DataFrame(list(self.expire(key, now, state)), columns=self.columns), state


def mute_sessions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Muted from the first reason of a tab to the end of its last one.

    ``events(event_id, tab_id, ts, kind, reason_id, expected_unmute_ms)``, kind
    mute, unmute or reset.  A reason ends by itself one second after it was
    expected to, five minutes at most; all times are event times.
    """
    use_state_store(events.sparkSession)
    rows = events.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts")).select("ts", "event_id", "tab_id", "ts_ms", "kind", "reason_id", "expected_unmute_ms")
    return rows.groupBy("tab_id").transformWithStateInPandas(
        _Reasons(rows.drop("ts")), "tab_id string, ts_ms bigint, action string, reason_id string, active int", "Append", "EventTime")


class _Transitions(_InOrder):
    order = ["ts_ms", "event_id", "mute_start_ms"]
    columns = ["session_id", "event_id", "ts_ms", "action", "cue_id"]
    schema = "muted boolean, cue_id bigint, ts_ms bigint"

    def on_rows(self, key, rows, state):
        import numpy as np

        # further windows that hold the same position, and levels without any, come after the first window
        rows = rows.drop_duplicates("event_id").reset_index(drop=True)
        rows["muted"] = rows["mute_cue_id"].notna()
        was = _before(rows, "muted", state, 0, self.idle_ms).eq(True).to_numpy()
        last = _before(rows, "mute_cue_id", state, 1, self.idle_ms)
        now, end = rows["muted"].to_numpy(), rows.iloc[-1]
        rows["action"] = np.where(now, "MUTE", "UNMUTE")
        rows["cue_id"] = rows["mute_cue_id"].where(now, last.to_numpy())
        return rows[now != was], (bool(end.muted), int(end.mute_cue_id) if end.muted else None, int(end.ts_ms))


def mute_transitions_stream(heartbeats: DataFrame, windows: DataFrame, bucket_ms: int = 10_000, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Mute transitions of a heartbeat stream against a static window table."""
    use_state_store(heartbeats.sparkSession)
    at = F.col("position_ms")
    side = windows.select("track_id", F.col("cue_id").cast("bigint").alias("mute_cue_id"), F.col("start_ms").alias("mute_start_ms"), F.col("end_ms").alias("mute_end_ms"))
    lo, hi = F.col("mute_start_ms") - fv.MUTE_EARLY_MS, F.col("mute_end_ms") + fv.MUTE_LATE_MS
    beats = heartbeats.withWatermark("ts", delay).select("ts", "session_id", "track_id", "event_id", F.unix_millis("ts").alias("ts_ms"), "position_ms")
    states = I.interval_join(beats, side, ["track_id"], at, lo, hi, (at >= lo) & (at <= hi), bucket_ms, how="left")
    states = states.select("ts", "session_id", "event_id", "ts_ms", "mute_cue_id", "mute_start_ms")
    return states.groupBy("session_id").transformWithStateInPandas(
        _Transitions(states.drop("ts"), idle_ms), "session_id string, event_id bigint, ts_ms bigint, action string, cue_id bigint", "Append", "EventTime")


class _Uploads(_InOrder):
    order = ["ts_ms", "event_id"]
    schema = "active boolean, ts_ms bigint"

    def __init__(self, rows, idle_ms):
        super().__init__(rows, idle_ms)
        self.columns = rows.columns

    def on_rows(self, key, rows, state):
        import pandas as pd

        rows["_told"] = rows["kind"].map({"upload": 1.0, "unload": 0.0, "pick": 0.0})
        times = pd.Series([rows["ts_ms"].iloc[0] if state is None else state[1], *rows["ts_ms"]])
        visit = (times.diff().iloc[1:] > self.idle_ms).cumsum().reset_index(drop=True)
        known = rows["_told"].groupby(visit).ffill()
        if state is not None:
            known = known.where(known.notna() | (visit > 0), float(state[0]))
        active = known.eq(1.0)
        out = rows[(rows["kind"] == "cue") & (rows["user_source"].eq(True) | ~active)]
        return out, (bool(active.iloc[-1]), int(rows["ts_ms"].iloc[-1]))


def upload_suppression(cues: DataFrame, control: DataFrame, delay: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Cues of a session, without automatic ones while a user upload is active.

    ``cues(session_id, event_id, ts_ms, source, ...)``; ``control(session_id,
    event_id, ts_ms, kind)`` with kind upload, unload or pick.  Both are one
    stream, so their order is the event order.
    """
    from hushline.operators.merge import is_user_source

    use_state_store(cues.sparkSession)
    data = cues.withColumn("kind", F.lit("cue")).withColumn("user_source", is_user_source(F.col("source")))
    line = data.unionByName(control.select("session_id", "event_id", "ts_ms", "kind", F.lit(False).alias("user_source")), allowMissingColumns=True)
    names = line.columns
    line = line.withColumn("_ts", F.timestamp_millis("ts_ms")).withWatermark("_ts", delay).select("_ts", *names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in line.drop("_ts").schema)
    passed = line.groupBy("session_id").transformWithStateInPandas(_Uploads(line.drop("_ts"), idle_ms), schema, "Append", "EventTime")
    return passed.drop("kind", "user_source")


# ---------------------------------------------------------------- replays


def replayed(rows: DataFrame, job, name: str, time: str = "ts", key: str = "session_id", late: str = "event_id", parts: int = 3) -> DataFrame:
    """What a stream job gives for stored rows that arrive in ``parts`` runs, each of which goes on from the checkpoint of the last.

    A run gets the rows of its span of time, and a tenth of those of the span before, so that rows come out of order.
    ``job`` takes the stream and the delay that waits for them.  A last row of a key of its own, far ahead, lets all timers fire.
    """
    spark = rows.sparkSession
    folder = workspace(spark, name)
    low, high = (x or 0 for x in rows.agg(F.min(F.unix_millis(time)), F.max(F.unix_millis(time))).first())
    span = (high - low) // parts + 1
    delay = f"{2 * span} milliseconds"
    part = F.least(F.floor((F.unix_millis(time) - low) / span) + F.when(F.pmod(F.xxhash64(late), F.lit(10)) == 0, 1).otherwise(0), F.lit(parts - 1))
    dealt = rows.withColumn("_part", part)
    end = rows.limit(1).select(*[F.timestamp_millis(F.lit(high + 3 * span + 10**10)).alias(c) if c == time else F.lit("~end").alias(c) if c == key else F.col(c) for c in rows.columns])
    for k in range(parts):
        new = dealt.filter(F.col("_part") == k).drop("_part")
        (new.unionByName(end) if k == parts - 1 else new).write.mode("append").parquet(f"{folder}/in")
        stream = job(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), delay)
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        schema = stream.schema
    return spark.read.schema(schema).parquet(f"{folder}/out").filter(F.col(key) != "~end")
