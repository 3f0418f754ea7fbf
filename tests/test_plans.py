"""How often queries read the given tables, counted over every plan that they run or return."""

import pytest

from hushline.operators import merge, ordered

MOST_SCANS = {"merge_cues": 1, "next_cues": 2, "ingest_cues": 1, "range_overlap": 2}


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


@pytest.mark.parametrize("name", MOST_SCANS)
def test_inputs_are_read_seldom(spark, monkeypatch, name):
    from hushline.plans import catalog, catalog_playback

    seen, plain = [], ordered.materialize

    def counted(df):
        seen.append(scans(df))
        return plain(df)

    monkeypatch.setattr(ordered, "materialize", counted)
    monkeypatch.setattr(catalog_playback, "materialize", counted)
    seen.append(scans(catalog.CASES[name][0](spark, "/root/testdata/sf0.001")))
    assert sum(seen) <= MOST_SCANS[name], seen


def test_merge_keeps_repeats_and_nulls(spark):
    schema = "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string, source string"
    old = spark.createDataFrame([("a", 0, 0, 5, "x", "s"), ("a", 1, 9, 12, None, "s"), ("b", 0, 0, 5, "x", "s"), (None, 0, 3, 4, "n", "s")], schema)
    new = spark.createDataFrame([("a", 0, 0, 6, "x", "t"), ("a", 1, 0, 6, "y", "t"), ("a", 2, 0, 6, "y", "t"), ("a", 3, 9, 12, None, "t"), ("b", 0, 1, 5, "z", "t"), ("c", 0, 7, 8, "w", "t"), ("d", 0, 7, 8, "w", "t"),
                                 (None, 0, 3, 4, "n", "t")], schema)
    policies = spark.createDataFrame([("a", "accumulate"), ("b", "replace"), ("d", "reject")], "track_id string, policy string")
    got = sorted(((r.track_id or "", r.cue_id, r.start_ms, r.text, r.source) for r in merge.merge_cues(old, new, policies).collect()), key=str)
    # repeats among the incoming cues stay, and what is null is never known
    assert got == sorted([("", 0, 3, "n", "s"), ("", 1, 3, "n", "t"), ("a", 0, 0, "x", "s"), ("a", 1, 0, "y", "t"), ("a", 2, 0, "y", "t"), ("a", 3, 9, None, "s"), ("a", 4, 9, None, "t"),
                          ("b", 0, 1, "z", "t"), ("c", 0, 7, "w", "t")], key=str)
    assert merge.merge_cues(old.where("false"), new.where("false"), policies).count() == 0
