"""Syllables counted over arrays equal those of the column functions; one pass where two were made."""

from pyspark.sql import functions as F

from hushline.functions import text as T
from hushline.functions.spoken import spoken
from hushline.operators import detect as D, lexicon as L, report as R, timing as W

TEXTS = ["The little table, a-e queue of the  DAY", "İ İa Kİle Kapple Kle e", "", None, "le ble -- 12 x.y.e 　bees rhyme\tthe", "\U0001F600 été café ape", " pale\n\nale "] * 4


def table(spark):
    return spark.createDataFrame([("t", i, 1000 * i, 1000 * i + 700, x) for i, x in enumerate(TEXTS)], "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string").coalesce(1)


def test_syllables_of_many_texts_equal_the_column_functions(spark, monkeypatch):
    from hushline.functions import spoken as module

    df = table(spark).withColumn("w", F.coalesce(T.spans("text", f"[^{T.WS}]+"), F.array().cast(T.SPAN_TYPE)))
    want = df.select("cue_id", T.total_syllables(F.coalesce("text", F.lit(""))).alias("total"), F.transform("w", lambda w: T.syllables(w["word"])).alias("own")).orderBy("cue_id").collect()
    for block in (1, 20, 200_000):
        monkeypatch.setattr(module, "BLOCK", block)
        # a match within a word has all syllables before it
        starts = F.concat(F.transform("w", lambda w: w["start_idx"]), F.array(F.lit(1)))
        words = F.concat(F.transform("w", lambda w: w["word"]), F.array(F.lit(" of\tthe")))
        got = df.select("cue_id", spoken(F.col("text"), starts, words).alias("s")).orderBy("cue_id").collect()
        assert [r.s.total for r in got] == [r.total for r in want] and sum(r.total for r in want) > 50
        assert [[m.own for m in r.s.m] for r in got] == [[*r.own, 1] for r in want]
        for r, w in zip(got, want, strict=True):
            assert [m.before for m in r.s.m][:-1] == [sum(w.own[:i]) for i in range(len(w.own))]
        assert got[0].s.m[-1].before == want[0].total


def test_track_stats_detect_once(spark):
    lex = L.build_lexicon(L.terms_df(spark, ["the", "of the", "le"]))
    found = D.detect_matches(table(spark), lex)
    one = R.track_stats(found)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("run(text") == 1
    two = R.track_stats(found, W.mute_windows(found))
    assert one.collect() == two.select(*one.columns).collect() and one.first().windows > 8


def test_timing_keeps_no_expressions_per_word(spark):
    lex = L.build_lexicon(L.terms_df(spark, ["the"]))
    plan = W.word_timing(D.detect_matches(table(spark), lex))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_cues_that_no_position_reaches_are_not_judged(spark):
    from hushline.operators import interval as I

    cues = spark.createDataFrame([("a", 0, 0, 900, "the"), ("a", 1, 6000, 7000, "the le"), ("a", 2, 60000, 61000, "the"), ("b", 0, 0, 900, "the"), (None, 0, 0, 900, "the")],
                                 "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string")
    beats = spark.createDataFrame([(1, "a", 100), (2, "a", 1000), (3, "c", 5), (4, "b", None), (5, None, 5)], "event_id bigint, track_id string, position_ms bigint")
    near = I.reachable(cues, beats, 5000)
    assert sorted((r.track_id, r.cue_id) for r in near.collect()) == [("a", 0), ("a", 1)]
    lex = L.build_lexicon(L.terms_df(spark, ["the"]))
    up = lambda c: sorted(map(str, I.upcoming_flagged(W.mute_windows(D.detect_matches(c, lex)), beats, 5000).collect()))
    assert up(near) == up(cues) and up(cues)


def test_texts_take_no_part_in_the_search_for_cues(spark, monkeypatch):
    from hushline.operators import interval as I

    seen, plain = [], I.interval_join
    monkeypatch.setattr(I, "interval_join", lambda points, intervals, *a, **k: seen.append(intervals.columns) or plain(points, intervals, *a, **k))
    scored = spark.createDataFrame([("a", 0, 0, 900, "the", "x<b>", True), ("a", 1, 500, 1500, "le", "le", False), ("a", 1, 500, 1500, "le", "le", False)],
                                   "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string, censored_text string, has_profanity boolean")
    beats = spark.createDataFrame([(1, "a", 100), (2, "a", 600), (3, "b", 5)], "event_id bigint, track_id string, position_ms bigint")
    out = I.positions_to_cues(beats, scored, ["event_id"]).orderBy("event_id")
    # a cue that is given twice is shown once
    assert [tuple(r) for r in out.collect()] == [(1, 0, 0, 900, True, "x", "a", 100), (2, 1, 500, 1500, False, "le", "a", 600)]
    assert out.columns == ["event_id", "cue_id", "cue_start_ms", "cue_end_ms", "has_profanity", "shown_text", "track_id", "position_ms"]
    assert "shown_text" not in seen[0]
