"""Interval joins, chunked windows and islands against brute force, with hot keys."""

import random

from pyspark.sql import Window, functions as F

from hushline.operators import interval as I, ordered as O


def hot_rows(n, seed):
    """A third of all rows share one key."""
    rnd = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"k{rnd.randrange(5)}", i, rnd.randrange(0, 50_000)) for i in range(n)]


def test_interval_join_equals_nested_loop(spark):
    pts = [(k, i, at) for k, i, at in hot_rows(300, 1)]
    ivs = [(k, i, s, s + random.Random(i).randrange(0, 9_000)) for k, i, s in hot_rows(200, 2)]
    p = spark.createDataFrame(pts, "track_id string, pid int, position_ms bigint")
    c = spark.createDataFrame(ivs, "track_id string, cue_id int, start_ms bigint, end_ms bigint")
    want = sorted((i, j) for k, i, at in pts for q, j, s, e in ivs if k == q and s <= at <= e)
    for salt in (1, 4):
        got = I.active_cues(c, p, bucket_ms=1_000, salt=salt)
        assert sorted((r.pid, r.cue_id) for r in got.collect()) == want


def test_intervals_of_all_lengths(spark):
    rnd = random.Random(8)
    hours = 3_600_000
    ivs = [("t", 0, 0, 100 * hours), ("t", 1, -5 * hours, 7), ("t", 2, 50, 40), ("t", 3, 90, 90), ("u", 4, 10, None), ("t", 5, -3, -1)]
    for i in range(6, 200):
        s = rnd.randrange(-hours, 100 * hours)
        ivs.append((rnd.choice("tu"), i, s, s + int(10 ** rnd.uniform(0, 8.5))))
    pts = [(rnd.choice("tuv"), i, rnd.choice([0, 7, 40, 90, 100 * hours, -1, rnd.randrange(-hours, 110 * hours), ivs[i % 200][2], ivs[i % 200][3] or 0])) for i in range(400)]
    p = spark.createDataFrame(pts, "track_id string, pid int, position_ms bigint")
    c = spark.createDataFrame(ivs, "track_id string, cue_id int, start_ms bigint, end_ms bigint")
    want = sorted((i, j) for k, i, at in pts for q, j, s, e in ivs if k == q and e is not None and s <= at <= e)
    for bucket in (7, 10_000):
        assert sorted((r.pid, r.cue_id) for r in I.active_cues(c, p, bucket_ms=bucket).collect()) == want
        filed = I.filed_intervals(c, F.col("start_ms"), F.col("end_ms"), bucket).groupBy("cue_id").count()
        assert filed.agg(F.max("count")).first()[0] <= 2
    assert I.active_cues(c.where("false"), p).count() == 0


def test_relevant_segments(spark):
    rnd = random.Random(2)
    segs = [(rnd.choice("ab"), i, s, s + rnd.randrange(0, 90_000)) for i in range(60) for s in [rnd.randrange(0, 900_000)]]
    at = [(rnd.choice("abc"), rnd.choice([0, rnd.randrange(0, 900_000)])) for _ in range(40)]
    got = I.segment_relevant(spark.createDataFrame(segs, "session_id string, sid int, first_cue_ms bigint, last_cue_ms bigint"), spark.createDataFrame(at, "session_id string, position_ms bigint"))
    want = sorted((i, p) for k, i, f, e in segs for q, p in at if k == q and (p == 0 or (f <= p + 30_000 and e >= p - 30_000)))
    assert sorted((r.sid, r.position_ms) for r in got.collect()) == want


def test_chunked_windows_equal_plain_windows(spark):
    df = spark.createDataFrame(hot_rows(600, 3), "k string, i int, at bigint").withColumn("v", F.when(F.col("i") % 4 == 0, F.col("i")))
    order, chunk = [F.col("at"), F.col("i")], F.floor(F.col("at") / 1_000)
    w = Window.partitionBy("k").orderBy("at", "i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "i", F.row_number().over(w).alias("rn"), F.sum("i").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max("i").over(before).alias("m"), F.last("v", True).over(before).alias("l"),
        F.collect_list("i").over(w.rowsBetween(1, 3)).alias("next"))
    out = O.row_numbers(df, ["k"], order, chunk, "rn")
    out = O.running_sum(out, ["k"], order, chunk, F.col("i"), "s")
    out = O.running_max_before(out, ["k"], order, chunk, F.col("i"), "m")
    out = O.last_value_before(out, ["k"], order, chunk, F.col("v"), "l", inclusive=False)
    out = O.neighbour_rows(out, ["k"], order, chunk, F.col("i"), 3, "next", after=True)
    key = lambda rows: sorted((r.i, r.rn, r.s, r.m, r.l, tuple(r.next)) for r in rows)
    assert repr(key(out.collect())) == repr(key(want.collect()))


def test_islands(spark):
    rows = [(k, s, s + 400) for k, _, s in hot_rows(400, 4)]
    df = spark.createDataFrame(rows, "k string, start_ms bigint, end_ms bigint")
    want = []
    for k in {r[0] for r in rows}:
        cur = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if cur and s <= cur[2]:
                cur = [k, cur[1], max(cur[2], e), cur[3] + 1]
            else:
                if cur:
                    want.append(tuple(cur))
                cur = [k, s, e, 1]
        want.append(tuple(cur))
    got = O.merge_islands(df, ["k"], "start_ms", "end_ms", 2_000)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_mute_state_fixture(spark):
    w = spark.createDataFrame([("t", 231, "bullshit", 862360.0, 865796.0)], "track_id string, cue_id int, word string, start_ms double, end_ms double")
    at = [862360 - 600, 862360 - 400, 862360, 865796, 865796 + 25, 865796 + 30]
    p = spark.createDataFrame([("t", i, x) for i, x in enumerate(at)], "track_id string, event_id int, position_ms bigint")
    got = I.mute_state(p, None, w, ["event_id"])
    assert [r.should_mute for r in sorted(got.collect(), key=lambda r: r.event_id)] == [False, True, True, True, True, False]
