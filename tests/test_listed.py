"""Listed words, phrases and patterns by one walk over a text; large lists stay tables."""

import random
import re

import pytest

from hushline.operators import detect as D, lexicon as L

TEXTS = ["The shit of the DAY, sh1t-shit o'shit", "son of  a-bitch, son of a bitch", "İ K of the é of-the", "", None, "f_u_c.k that fuck"] * 3


def table(spark):
    return spark.createDataFrame([("t", i, x) for i, x in enumerate(TEXTS)], "track_id string, cue_id int, text string")


def shown(df):
    return [[tuple(m) for m in r.matches] for r in df.orderBy("cue_id").collect()]


@pytest.mark.parametrize("fuzzy", [None, 0.25])
def test_a_large_lexicon_is_not_read_by_the_driver(spark, monkeypatch, fuzzy):
    rnd = random.Random(1)
    lex = L.build_lexicon(L.terms_df(spark, ["shit", "fuck", "day", "of the", "son of a bitch"] + ["".join(rnd.choices("qxzj", k=9)) for _ in range(40)]))
    want = shown(D.detect_matches(table(spark), lex, use_context=False, fuzzy_threshold=fuzzy))
    assert sum(map(len, want)) > 20
    monkeypatch.setattr(D, "MOST_FOLDED", 10)
    plain, seen = L.rows_up_to, []
    monkeypatch.setattr(L, "rows_up_to", lambda df, most: seen.append(plain(df, most)) or seen[-1])
    got = shown(D.detect_matches(table(spark), lex, use_context=False, fuzzy_threshold=fuzzy))
    assert got == want
    assert seen[0] is None and max(len(r or []) for r in seen) <= 10


def test_joined_phrase_rows_carry_no_text(spark):
    lex = L.build_lexicon(L.terms_df(spark, ["of the", "son of a bitch", "of the day"]))
    for limit in (0, 10):
        plan = D.phrase_matches_joined(table(spark), lex, most_broadcast=limit)._jdf.queryExecution().optimizedPlan().toString()
        exploded = [line for line in plan.splitlines() if "Generate explode" in line]
        assert not any(re.search(r"\btext#\d+\]", line) for line in exploded), exploded
        got = sorted((r.cue_id, r.word, r.start_idx) for r in D.phrase_matches_joined(table(spark), lex, most_broadcast=limit).collect())
        want = sorted((r.cue_id, r.word, r.start_idx) for r in D.phrase_matches(table(spark), lex).collect())
        assert got == want and want


def test_patterns_in_the_walk_equal_those_of_the_engine(spark):
    texts = ["F_u.c-k fUcks efuck fuck_ fuck's İfuck Kfuck ſhit", "s-h_i.t!s shits? shitty éshit", "f*u*c*k fuck", None, "", "d.a.m.n damn_ ndamn damn9"]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "track_id string, cue_id int, text string")
    patterns = L.obfuscation_patterns(spark)
    taken = D.read_rules(patterns=patterns)
    assert len(taken.scans) > 5 and taken.patterns  # both ways are used
    steps = D.pattern_steps(D.F.col("text"), [(r.term, D.T.ascii_pattern(r.pattern), r.letters) for r in sorted(patterns.collect(), key=lambda r: r.ord)])
    want = sorted(map(tuple, D._explode_matches(D._with_steps(df, steps), D.F.col("_r")).collect()))
    assert want and sorted(map(tuple, D.obfuscated_matches(df, patterns).collect())) == want


def test_texts_taken_together_give_what_each_gives_alone(spark, monkeypatch):
    """All ways of cutting a table into blocks, and the walk over one text at a time, find the same."""
    rnd = random.Random(7)
    parts = ["of", "the", "THE", " ", "\t", "-", "'", "K", "É", "Σ", "ς", "mart", "k", "a b", "that", "Th4t", "o'that", "''", "_", "　the", "f.u*ck", "of the", "\U0001f600", "\n"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(14))) for _ in range(400)] + [None, "", "the", "of", "the", "".join(map(chr, range(10, 32))) + "of the"]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "track_id string, cue_id int, text string").coalesce(1)
    lex = L.build_lexicon(L.terms_df(spark, ["that", "the", "of the", "k mart", "é of", "the of", "a b a", "'s", "ς the"]))
    seen = []
    for together, block in ((2_000_000, 200_000), (2_000_000, 1), (2_000_000, 40), (0, 200_000)):
        monkeypatch.setattr(D.H, "MOST_TOGETHER", together)
        monkeypatch.setattr(D.H, "BLOCK", block)
        seen.append(shown(D.detect_matches(df, lex, L.obfuscation_patterns(spark), fuzzy_threshold=0.25)))
    assert sum(map(len, seen[0])) > 200 and all(s == seen[0] for s in seen)


def test_plain_texts_are_not_walked_one_by_one(spark, monkeypatch):
    """A batch of plain texts costs no regular expression per text, but few array operations."""
    runs = []
    monkeypatch.setattr(D.H.F, "arrow_udf", lambda run, kind: runs.append(run) or (lambda *c: None))
    D.H.hits(None, ["that"], ["of the"])
    import pyarrow as pa

    compiled = []

    class Counting:
        def __init__(self, pattern):
            self.of = re.compile(pattern)

        def __getattr__(self, name):
            return lambda *a: compiled.append(name) or getattr(self.of, name)(*a)

    monkeypatch.setattr(D.H, "re", type("R", (), {"compile": staticmethod(Counting), "fullmatch": re.fullmatch, "findall": re.findall}))
    none = pa.nulls(500)
    out = runs[0](pa.array(["nothing listed in here, but words and gaps"] * 499 + ["that of the day"]), none, none, none)
    assert [len(out[499][k].as_py()) for k in "tp"] == [1, 1]
    assert len(compiled) < 5
