"""The default substitutions are the whole table of the reference."""

from hushline.functions import fixed_values as fv
from hushline.operators import censor as X, detect as D, lexicon as L


def test_default_substitutions_are_complete(spark):
    rows = L.root_substitutions(spark).collect()
    assert len(rows) == 158 * 3 == len({(r.term, r.category) for r in rows}) and all(r.options for r in rows)
    of = {(r.term, r.category): r.options for r in rows}
    assert of["shut up", "silly"] == ["hush up", "hush", "hush your mouth", "quiet", "quiet please"]
    assert of["bitchy", "polite"] == ["grouchy", "irritable", "cranky"] and of["bitchy", "random"] == ["noodly", "bananical"]


def test_every_term_gets_its_own_word(spark):
    terms = [t for t, *_ in fv.ROOT_SUBSTITUTIONS]
    cues = spark.createDataFrame([("t", i, 0, 1000, t) for i, t in enumerate(terms)], "track_id string, cue_id int, start_ms long, end_ms long, text string")
    found = D.detect_matches(cues, L.build_lexicon(L.terms_df(spark, terms)))
    none = L.custom_substitutions(spark.createDataFrame([], "line string, ord int"))
    for k, category in enumerate(fv.SUBSTITUTION_CATEGORIES):
        got = X.substitute(found, L.root_substitutions(spark), L.substitution_roots(spark), none, category).select("cue_id", "text", "censored_text").collect()
        assert len(got) == 158 and [r for r in got if r.censored_text not in fv.ROOT_SUBSTITUTIONS[r.cue_id][1 + k]] == []
