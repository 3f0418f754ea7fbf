"""Inputs beyond former limits: sizes, depths and numbers that must not change a result."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hushline.functions import urls as U
from hushline.operators import detect as D, lexicon as L, merge as M
from hushline.sources import discovery, subtitle_files


def test_dot_steps_of_any_number(spark):
    base = "https://h.test/a/b/c/d/e/f.m3u8?x=1"
    want = {"../../../../x.vtt": "https://h.test/a/x.vtt", "../" * 9 + "x.vtt": "https://h.test/x.vtt", "./x.vtt": "https://h.test/a/b/c/d/e/x.vtt", "g/../../x.vtt?q=../y": "https://h.test/a/b/c/d/x.vtt?q=../y",
            "..": "https://h.test/a/b/c/d/", "x.vtt": "https://h.test/a/b/c/d/e/x.vtt", "https://o.test/a/./b/../c.vtt": "https://o.test/a/c.vtt"}
    df = spark.createDataFrame([(r,) for r in want], "ref string")
    assert {r.ref: r.u for r in df.select("ref", U.absolute_url(F.lit(base), F.col("ref")).alias("u")).collect()} == want


def test_nested_urls_at_any_depth(spark):
    deep = {"url": "https://h.test/deep.vtt", "lang": "en"}
    for k in ("tracks", "cc", "subs", "captions", "subtitles", "tracks", "cc"):
        deep = {k: [deep]}
    rows = [(1, json.dumps(deep)), (2, "{broken"), (3, None), (4, json.dumps({"file": "https://h.test/top.srt"}))]
    got = discovery.nested_track_urls(spark.createDataFrame(rows, "payload_id int, body string")).collect()
    assert sorted((r.payload_id, r.url) for r in got) == [(1, "https://h.test/deep.vtt"), (4, "https://h.test/top.srt")]


def test_vtt_cue_of_very_many_lines(spark):
    text = "\n".join(f"l{i}" for i in range(120_000))
    files = spark.createDataFrame([("a.vtt", f"WEBVTT\n\n00:01.000 --> 00:04.000\n{text}\n")], "path string, content string")
    cue = subtitle_files.ingest_cues(files).first()
    assert cue.text.startswith("l0 l1 ") and cue.text.endswith("l119999")


@pytest.mark.parametrize("saved, want", [([], 0), ([(250, True)], 250)])
def test_profile_without_stored_settings(spark, saved, want):
    rows = spark.createDataFrame([("a",), ("b",)], "site string")
    stored = spark.createDataFrame(saved, "offset_ms int, use_substitutions boolean")
    overrides = spark.createDataFrame([("a", 9)], "site string, offset_ms int")
    got = {r.site: r.offset_ms for r in M.resolve_profile(rows, stored, overrides).collect()}
    assert got["a"] == 9 and (got["b"] == want or not saved)
    two = spark.createDataFrame([(1, True), (2, True)], "offset_ms int, use_substitutions boolean")
    with pytest.raises(ValueError):
        M.resolve_profile(rows, two, overrides)


@pytest.mark.parametrize("more", [0, 63, 64, 3_000])
def test_matches_do_not_depend_on_the_number_of_terms(spark, more):
    cues = spark.createDataFrame([("t", 0, "Alors, C'ÉTAIT LÀ et fuck, et FUCKK"), ("t", 1, "rien du tout")], "track_id string, cue_id int, text string")
    terms = ["c'était là", "fuck", "fuckk"] + [f"phrase numéro {i}" for i in range(more)] + [f"mot{i}" for i in range(more)]
    lex = L.build_lexicon(L.terms_df(spark, terms))
    got = [(m.word, m.confidence) for r in D.detect_matches(cues, lex, use_context=False).orderBy("cue_id").collect() for m in r.matches]
    assert got == [("C'ÉTAIT LÀ", 100.0), ("fuck", 100.0), ("FUCKK", 100.0)]


def test_fuzzy_confidence_is_the_same_both_ways(spark):
    cues = spark.createDataFrame([("t", 0, "oh fuckk and fukck")], "track_id string, cue_id int, text string")
    lex = L.build_lexicon(L.terms_df(spark, ["fuck"]))
    ways = [{(m.word, m.confidence) for m in way(cues, lex, fuzzy_threshold=0.25).first().matches} for way in (D.detect_matches, D.detect_by_joins)]
    assert ways[0] == ways[1] and len(ways[0]) == 1 + ("fukck" in {w for w, _ in ways[0]})
    with pytest.raises(ValueError):
        D.fuzzy_vocabulary(spark.createDataFrame([("a",)], "norm string"), lex, 1.0)


def test_redetection_finds_fuzzy_changes_and_many_terms(spark):
    cues = spark.createDataFrame([("t", 0, "oh fukck no"), ("t", 1, "clean words"), ("t", 2, "term77 here")], "track_id string, cue_id int, text string")
    old, new = (L.build_lexicon(L.terms_df(spark, t)) for t in (["zzz"], ["zzz", "fuck", *[f"term{i}" for i in range(5_000)]]))
    again = lambda c: D.detect_matches(c, new, fuzzy_threshold=0.2)
    got = M.redetect(D.detect_matches(cues, old, fuzzy_threshold=0.2), old, new, again, fuzzy_threshold=0.2)
    plain = lambda df: sorted((r.cue_id, [m.word for m in r.matches], r.score) for r in df.collect())
    assert plain(got) == plain(again(cues))


def test_fuzzy_index_misses_nothing_and_asks_for_little(spark):
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n))
    entries = [word(rnd.randint(1, 14)) for _ in range(400)]
    words = [word(rnd.randint(1, 14)) for _ in range(300)]
    for e in entries[:200]:  # edited entries
        x = list(e)
        for _ in range(rnd.randint(1, 3)):
            k = rnd.randrange(len(x) + 1)
            x[k:k + rnd.randint(0, 1)] = rnd.choice(["", "a", "z"])
        words.append("".join(x) or "q")
    lex = spark.createDataFrame([(e, i) for i, e in enumerate(entries)], "norm_term string, ord int")
    voc = spark.createDataFrame([(w,) for w in words], "norm string")
    both = voc.distinct().crossJoin(lex).withColumn("d", F.levenshtein("norm", "norm_term")).withColumn("m", F.greatest(F.length("norm"), F.length("norm_term"))).cache()
    for threshold in (0.0, 0.2, 0.25, 0.34, 0.6, 0.85):
        want = both.where(F.col("d") / F.col("m") <= threshold).groupBy("norm").agg(F.min_by("norm_term", "ord").alias("t"))
        got = D.fuzzy_vocabulary(voc, lex, threshold)
        assert sorted((r.norm, r.fuzzy_term) for r in got.collect()) == sorted(map(tuple, want.collect()))
    # natural spread of letters: candidates a word against entries of near length
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("norm")).where(F.length("norm") > 3).distinct()
    terms = real.select(F.reverse("norm").alias("norm_term")).union(real.select(F.concat("norm", F.substring(F.reverse("norm"), 1, 3)))).union(real.select(F.concat(F.substring("norm", 2, 9), F.lit("en"))))
    terms = terms.distinct().limit(25_000).withColumn("ord", F.monotonically_increasing_id().cast("int"))
    near = F.floor(0.25 * F.greatest("a", "b"))
    sizes = lambda df, c, n: df.groupBy(F.length(c).alias(n)).count().withColumnRenamed("count", f"n_{n}")
    blocked = sizes(real, "norm", "a").crossJoin(sizes(terms, "norm_term", "b")).where(F.abs(F.col("a") - F.col("b")) <= near).agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0]
    assert terms.count() > 5_000 and D.fuzzy_candidates(real, terms, 0.25).count() * 20 < blocked
