"""Detecting again: which cues are marked, and what the search over plain texts sends to its workers."""

import random
import re

import pytest

from hushline.functions import fixed_values as fv, text as T
from hushline.operators import detect as D, lexicon as L, merge as M


def test_plain_texts_are_sent_alone(monkeypatch, spark):
    """Lists that are not given are no columns of nulls, whose size is asked for after every row."""
    sent = []
    monkeypatch.setattr(D.H.F, "arrow_udf", lambda run, kind: lambda *c: sent.append(len(c)))
    D.H.hits(D.F.col("text"), ["that"], ["of the"])
    D.H.hits(D.F.col("text"), ["that"], found=D.F.col("found"))
    assert sent == [1, 2]


def test_rows_with_and_without_lists_of_their_own(spark):
    rows = [(0, "the that", None, None, None), (1, "the that", ["that"], {"tha": 80.0}, None), (2, "tha of the", None, {"tha": 80.0}, ["3:of the"]), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "i int, text string, f array<string>, c map<string,double>, s array<string>").coalesce(1)
    got = df.select("i", D.H.hits(D.F.col("text"), ["the"], found=D.F.col("f"), close=D.F.col("c"), said=D.F.col("s")).alias("h")).orderBy("i").collect()
    assert [([m.word for m in r.h.t], [m.word for m in r.h.p]) for r in got] == [(["the"], []), (["that"], []), (["tha", "the"], ["of the"]), ([], [])]


def test_marking_runs_no_rules_and_marks_what_a_detection_of_changed_terms_finds(spark):
    rnd = random.Random(11)
    parts = ["that", "THAT", "of the", "of", "the", "with", "w1th", " ", "-", "é", "'"]
    cues = spark.createDataFrame([("t", i, " ".join(rnd.choices(parts, k=rnd.randrange(6)))) for i in range(300)] + [("t", 300, None)], "track_id string, cue_id int, text string")
    old, new = (L.build_lexicon(L.terms_df(spark, t)) for t in (["that", "the"], ["the", "with", "of the", "the of"]))
    changed = L.build_lexicon(L.terms_df(spark, ["that", "with", "of the", "the of"]))
    for fuzzy in (None, 0.25):
        stored = M.ordered.materialize(D.detect_matches(cues, old, fuzzy_threshold=fuzzy))
        marked = M.touched_cues(stored, old, new, fuzzy)
        assert "aggregate(" not in marked._jdf.queryExecution().optimizedPlan().toString()
        want = {r.cue_id for r in D.detect_matches(cues, changed, use_context=False, fuzzy_threshold=fuzzy).collect() if r.matches}
        assert 0 < len(want) < 300 and {r.cue_id for r in marked.filter("touched").collect()} == want
        again = lambda c: D.detect_matches(c, new, fuzzy_threshold=fuzzy)  # noqa: B023, E731
        plain = lambda df: sorted((r.cue_id, [m.word for m in r.matches], r.score, r.has_profanity) for r in df.collect())
        assert plain(M.redetect(stored, old, new, again, fuzzy)) == plain(again(cues))


@pytest.mark.parametrize("pattern", [r"\b(of\s+that|that\s+of)\b", r"\bwas\s+(it|on)\b", r"\bDer\b", r"\ba?x\b", r"\b(a|b*)x", r"\b(x|ab)?c", r"x\b-?a\b", r"\b\s+a", r"(a|\bx)b?", r"\b(?:a|xb)\ba?", r"\b(a(b)?|x)"])
def test_boundaries_mean_the_same_when_the_next_character_is_known(spark, pattern):
    rnd = random.Random(3)
    alphabet = ["a", "b", "x", "c", "X", " ", "-", "_", "é", "1", "of that", "that of", "was it", "was on", "Der", "der"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(12))) for _ in range(6_000)]
    plain = "(?i)" + pattern.replace(r"\b", T.BOUNDARY).replace(r"\s", f"[{T.WS}]")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(D.F.col("t").rlike(T.ascii_pattern(pattern)).alias("a"), D.F.col("t").rlike(plain).alias("b")).collect()
    assert any(r.b for r in got) and all(r.a == r.b for r in got)
    assert [re.search(T.ascii_pattern(pattern), t) is None for t in texts] == [re.search(plain, t) is None for t in texts]


def test_listed_rules_seldom_test_for_a_boundary_at_each_place():
    rules = [T.ascii_pattern(p, c) for _, _, p, c in fv.CONTEXT_RULES]
    assert sum(not r.removeprefix("(?i)").startswith(T.BOUNDARY) for r in rules) * 3 > len(rules)


def test_vocabulary_is_that_of_the_texts(spark):
    """Words, apostrophes, look-alikes, non-ASCII letters, nulls, also when a worker forgets and over many blocks."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("aBZz019_' '-\n\téKİ𝒳$@", k=rnd.randrange(30))) for _ in range(3_000)] + [None, "", "'", "''a''b'", "x" * 300_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {r[0] for r in df.select(D.F.explode(D.H.norms(D.F.col("text")))).collect()}
    assert {r[0] for r in D.H.vocabulary(df).collect()} == want and len(want) > 500
    repeated = D.H.vocabulary(spark.createDataFrame([("one two one",)] * 5_000, "text string").coalesce(1)).collect()
    assert sorted(r[0] for r in repeated) == ["one", "two"]


def test_fuzzy_redetection_gathers_words_once_and_compares_short_lists_by_length(spark, monkeypatch):
    cues = spark.createDataFrame([("t", i, f"that thaat {i} wodr with") for i in range(20)] + [("t", 20, "nothing")], "track_id string, cue_id int, text string")
    old, new = (L.build_lexicon(L.terms_df(spark, t)) for t in (["thats", "word"], ["word", "withs"]))
    read, real = [], D.H.vocabulary
    monkeypatch.setattr(D.H, "vocabulary", lambda texts: read.append(1) or real(texts))
    words = D.vocabulary(cues)
    again = lambda c: D.detect_matches(c, new, fuzzy_threshold=0.5, words=words)
    got = M.redetect(D.detect_matches(cues, old, fuzzy_threshold=0.5, words=words), old, new, again, 0.5, words)
    plain = lambda df: sorted((r.cue_id, [m.word for m in r.matches], r.score) for r in df.collect())
    rows = plain(got)
    assert len(read) == 1 and rows == plain(D.detect_matches(cues, new, fuzzy_threshold=0.5)) and len(rows[0][1]) > 1
    pairs = D.fuzzy_candidates(words.withColumnRenamed(words.columns[0], "norm"), old, 0.25)
    assert "_piece" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    for most in (0, 200):
        monkeypatch.setattr(D, "MOST_COMPARED", most)
        close = D.fuzzy_vocabulary(words.unionAll(spark.createDataFrame([("",), (None,), ("thats",)], "norm string")), old.unionAll(spark.createDataFrame([("", "", "word", 9)], old.schema)), 0.5)
        rows = sorted(map(tuple, close.collect()))
        assert (most == 0 or rows == before) and len(rows) >= 4
        before = rows
