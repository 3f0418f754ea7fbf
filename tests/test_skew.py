"""Hot keys: the sketch finds them, only they are split, and results stay those of the plain operations."""

import random
import statistics

from pyspark.sql import functions as F

from hushline.operators import detect as D, interval as I, lexicon as L, skew as K

TASKS = 16


def rows_with_a_hot_key(spark, n=30_000):
    """A third of all rows share one key; the others are spread over 500."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(500)))).alias("k"))


def test_the_sketch_finds_what_is_hot(spark):
    df = rows_with_a_hot_key(spark)
    hot = K.heavy(df, ["k"], TASKS)
    want = df.where("k = 'hot'").select(F.xxhash64("k")).first()[0]
    assert list(hot) == [want] and 40 <= hot[want] <= 60  # a third of 16 tasks, eight pieces each
    assert K.heavy(df.where("k <> 'hot'"), ["k"], TASKS) == {}
    assert K.heavy(df.where("false"), ["k"], TASKS) == {}


def test_split_join_equals_join_and_is_even(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    parts, limit = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    left = rows_with_a_hot_key(spark).union(spark.range(90_000, 90_050).select("id", F.lit(None).cast("string")))
    right = left.where("k is not null").select("k").distinct().where("k <> 'k7'").withColumn("v", F.crc32(F.col("k").cast("binary")))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(TASKS))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for how in ("inner", "left"):
            got, want = K.split_join(left, right, ["k"], how), left.join(right, ["k"], how)
            assert got.columns == want.columns
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        split, plain = sizes(K.split_join(left, right, ["k"])), sizes(left.join(right, "k"))
        assert max(split) <= 2 * statistics.median(split) and len(split) == TASKS
        assert max(plain) > 2 * statistics.median(plain)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_interval_join_with_pieces_by_size(spark):
    rnd = random.Random(5)
    pts = [("hot" if i % 3 else rnd.choice("abc"), i, rnd.randrange(0, 900) if i % 2 else rnd.randrange(0, 90_000)) for i in range(600)]
    ivs = [(rnd.choice(["hot", "a", "b"]), i, s, s + rnd.randrange(0, 9_000)) for i in range(150) for s in [rnd.randrange(0, 60_000)]]
    p = spark.createDataFrame(pts, "track_id string, pid int, position_ms bigint")
    c = spark.createDataFrame(ivs, "track_id string, cue_id int, start_ms bigint, end_ms bigint")
    want = sorted((i, j) for k, i, at in pts for q, j, s, e in ivs if k == q and s <= at <= e)
    got = I.active_cues(c, p, bucket_ms=1_000, salt=I.BY_SIZE)
    assert sorted((r.pid, r.cue_id) for r in got.collect()) == want


def test_finer_chunks_rise_and_change_nothing(spark):
    rnd = random.Random(6)
    beats = [("hot" if i % 3 else f"s{i % 7}", i, rnd.randrange(0, 80_000) / 1000, float(i), 1.0, i % 5 == 0) for i in range(900)]
    schema = "session_id string, event_id bigint, at double, position_ms double, rate double, paused boolean"
    df = spark.createDataFrame(beats, schema).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("bigint")))
    heartbeats, events = df.where("event_id % 2 = 0"), df.where("event_id % 2 = 1")
    key = lambda out: sorted(map(tuple, out.collect()))
    assert key(I.asof_position(events, heartbeats)) == key(I.asof_position(events, heartbeats, split_hot=False))
    cut = df.withColumn("chunk", K.finer_chunks(df, ["session_id"], F.col("at"), 86_400, TASKS))
    n = {r.session_id: r.n for r in cut.groupBy("session_id").agg(F.countDistinct("chunk").alias("n")).collect()}
    assert n["hot"] > 8 and max(cut.groupBy("session_id", "chunk").count().select("count").toPandas()["count"]) < 100
    rows = sorted((r.session_id, r.at, r.chunk) for r in cut.collect())
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def test_phrases_and_words_by_split_joins(spark):
    texts = ["son of a bitch"] * 40 + ["son of mine", "swear to god, son of a bitch", "shit happens", None, ""]
    cues = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "track_id string, cue_id int, text string")
    lex = L.build_lexicon(L.terms_df(spark, ["shit", "son of a bitch", "swear to god"]))
    key = lambda out: sorted(map(tuple, out.collect()))
    for find in (D.phrase_matches_joined, D.exact_matches):
        want = key(find(cues, lex))
        assert want and key(find(cues, lex, most_broadcast=0)) == want
