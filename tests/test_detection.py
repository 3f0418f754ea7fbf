"""Documented examples of detection, censoring, syllables and windows."""

import pytest
from pyspark.sql import functions as F

from hushline.functions import fixed_values as fv, text as T
from hushline.operators import censor as X, detect as D, lexicon as L, timing as W

CUES = "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string"
BASIC = ["fuck", "shit", "ass", "bitch", "bullshit", "swear to god", "son of a bitch"]


def cues(spark, *texts, length=2000):
    return spark.createDataFrame([("t", i, i * 10_000, i * 10_000 + length, x) for i, x in enumerate(texts)], CUES)


def run(spark, texts, terms, sensitivity="medium", context=False, patterns=True, fuzzy=None, by_joins=False):
    lex = L.build_lexicon(L.terms_df(spark, terms))
    args = (L.obfuscation_patterns(spark) if patterns else None, L.context_rules(spark), L.exempt_terms(spark), sensitivity, context, fuzzy)
    df = cues(spark, *texts)
    out = D.detect_by_joins(df, lex, *args) if by_joins else D.detect_matches(df, lex, *args)
    return sorted(X.censor(out).collect(), key=lambda r: r.cue_id)


def test_default_lexicon_size():
    assert len(fv.words_of(fv.DEFAULT_TERMS)) == 159
    assert len(fv.words_of(fv.EXEMPT_TERMS)) == 29


@pytest.mark.parametrize("by_joins", [False, True])
def test_phrases_patterns_and_censoring(spark, by_joins):
    rows = run(spark, ["What the f_u_c_k!", "You son of a bitch!", "Swear  to-GOD, really", "hello world", "landlord lordship", "été fuck l'été sh1t"], BASIC, by_joins=by_joins)
    assert rows[0].censored_text == "What the [CENSORED]!"
    assert [m.word for m in rows[1].matches] == ["son of a bitch"]
    assert [m.word for m in rows[2].matches] == ["Swear  to-GOD"]
    assert rows[3].matches == [] and rows[3].score == 0 and not rows[3].has_profanity
    assert rows[4].matches == []
    assert [(m.word, m.start_idx, m.type) for m in rows[5].matches] == [("fuck", 4, "regex"), ("sh1t", 15, "exact")]
    assert rows[5].censored_text == "été [CENSORED] l'été [CENSORED]"


def test_overlapping_phrases_keep_the_first(spark):
    rows = run(spark, ["swear to god damn it"], ["swear to god", "god damn"], patterns=False)
    assert [m.word for m in rows[0].matches] == ["swear to god"]


def test_context(spark):
    rows = run(spark, ["[Guns cock]", "suck my cock", "that cock"], ["cock", "suck", "sucking"], context=True, patterns=False)
    assert rows[0].matches == []
    assert rows[1].has_profanity and rows[1].score == 87.5
    assert rows[2].score == 75.0


def test_exempt_at_low(spark):
    terms = fv.words_of(fv.DEFAULT_TERMS)
    rows = run(spark, ["God is great", "god damn", "goddamn it"], terms, "low", context=True)
    assert [r.has_profanity for r in rows] == [False, True, True]


def test_fuzzy_takes_the_first_entry(spark):
    rows = run(spark, ["fuckk shitt clean"], ["fuck", "shit"], patterns=False, fuzzy=0.25)
    assert [(m.word, m.type, m.confidence) for m in rows[0].matches] == [("fuckk", "fuzzy", 80.0), ("shitt", "fuzzy", 80.0)]


def test_large_and_small_lexicons_agree(spark):
    texts = ["the god damn thing", "a x y 5hit-shit", "o'clock son of a bitch ass", "l'ass é ass's"]
    pick = lambda rows: [[tuple(m)[:5] for m in r.matches] for r in rows]
    terms = fv.words_of(fv.DEFAULT_TERMS)
    assert pick(run(spark, texts, terms, context=True)) == pick(run(spark, texts, terms, context=True, by_joins=True))


@pytest.mark.parametrize("word, n", [("apple", 2), ("banana", 3), ("hello", 2), ("make", 1), ("", 0), ("table", 2), ("a", 1), ("123", 1)])
def test_syllables(spark, word, n):
    assert spark.createDataFrame([(word,)], "w string").select(T.syllables(F.col("w"))).first()[0] == n


def test_text_functions(spark):
    df = spark.createDataFrame([("<script>alert('xss')</script>", "&amp;lt;b&amp;gt;x&nbsp;y", "a<b {\\i1}c\x00", 3_723_456, "01:02:03", "fuck")], "a string, b string, c string, ms bigint, t string, w string")
    r = df.select(T.clean_text(F.col("a")), T.clean_text(F.col("b")), T.sanitize_text(F.col("c")), T.vtt_time(F.col("ms")), T.format_time(F.col("ms")), T.parse_time(F.col("t")), T.mask_word(F.col("w")),
                  T.total_syllables(F.lit("this is a test")), T.normalize_text(F.lit("SH1T @$$"))).first()
    assert list(r) == ["alert('xss')", "x y", "a", "01:02:03.456", "1:02:03", 3_723_000, "f**k", 4, "shit ass"]


def test_spans_of_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(500))
    out = spark.createDataFrame([(text,)], "text string").select(T.token_spans("text").alias("s")).first().s
    assert len(out) == 500 and all(text[s.start_idx : s.end_idx] == s.word for s in out)


def test_mute_windows(spark):
    lex = L.build_lexicon(L.terms_df(spark, ["fuck"]))
    d = D.detect_matches(cues(spark, "what the fuck is this"), lex)
    w = W.mute_windows(d).first()
    assert w.buffer_before_ms == 696 and w.buffer_after_ms == 300
    assert W.mute_windows(d, "high").count() == 0


def test_speaking_rate_fallback(spark):
    r = W.speaking_rate(spark.createDataFrame([("t", 0, 5, 5, "hi")], CUES)).first()
    assert (r.wpm, r.ms_per_syllable, r.syllables_per_word) == (170.0, 175.0, 1.5)


def test_substitution_of_roots_and_custom(spark):
    d = D.detect_matches(cues(spark, "fuckface shit xxx"), L.build_lexicon(L.terms_df(spark, ["fuckface", "shit", "xxx"])))
    custom = L.custom_substitutions(spark.createDataFrame([("shit=bunnies", 0)], "line string, ord int"))
    text = X.substitute(d, L.root_substitutions(spark), L.substitution_roots(spark), custom, "polite").first().censored_text
    assert text.split(" ")[0] in {"darn-face", "bother-face", "drat-face"} and text.endswith("bunnies [CENSORED]")


def test_lexicon_custom_lines(spark):
    lex = L.build_lexicon(L.terms_df(spark, ["a", "b"]), L.terms_df(spark, ["-A", "new one"]))
    assert sorted((r.norm_term, r.kind) for r in lex.collect()) == [("b", "word"), ("new one", "phrase")]
