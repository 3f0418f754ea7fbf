"""The url filter's dictionary: glued host names are split."""

from hushline.llm import url_filter
from hushline.llm.queries import QUERIES

GLUED = {"cheappillsnow": "cheap pills now", "bestcasino": "best casino", "spamfarm": "spam farm", "freebetsonline": "free bets online"}


def test_glued_host_names_are_split(spark, tmp_path):
    rows = [(k, f"https://www.plain{'abcdefgh'[k % 8]}.org/p", f"<p>{' '.join(GLUED.values())} and more words</p>") for k in range(40)]
    for k, name in enumerate(GLUED):
        link = f"https://{name}.org/x"
        rows += [(100 + 10 * k + n, link, f'<a href="{link}">see {link} or www.{name}.org</a>') for n in range(5)]
    rows += [(200, None, None), (201, "no address", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in QUERIES["op1_url_filter"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert all(v == ("block" if 100 <= i < 200 else "allow") for i, v in got.items())
    words = url_filter.unigrams(url_filter.visible_text(pages), "text")
    assert not {r.word for r in words.collect()} & GLUED.keys()
    total = words.groupBy().sum("n").first()[0]
    cut = url_filter.segmented(spark.createDataFrame([(x,) for x in GLUED], "label string"), words, total).collect()
    assert {r.label: " ".join(r.words) for r in cut} == GLUED


def test_unknown_words_stay_whole(spark):
    words = spark.createDataFrame([("garden", 100), ("he", 9000), ("in", 20_000), ("ch", 120), ("ea", 130), ("ar", 500), ("pills", 1000)], "word string, n long")
    labels = ["gardenshed", "cheap", "win", "farm", "cheappills", "x", "é" * 2000]
    got = {r.label: r.words for r in url_filter.segmented(spark.createDataFrame([(x,) for x in labels], "label string"), words, 1_000_000).collect()}
    assert got == {"gardenshed": ["garden", "shed"], "cheap": ["cheap"], "win": ["win"], "farm": ["farm"], "cheappills": ["cheap", "pills"], "x": ["x"], "é" * 2000: ["é" * 2000]}


def test_viterbi_equals_all_splits():
    import itertools
    import math
    import random

    rng = random.Random(3)
    for _ in range(300):
        label = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
        cost = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): rng.uniform(1, 12) for _ in range(8)}
        price = lambda ws: sum(cost.get(w, 7 + 1.6 * len(w)) for w in ws)
        cheapest = math.inf
        for cuts in itertools.product((0, 1), repeat=len(label) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
            cheapest = min(cheapest, price([label[a:b] for a, b in itertools.pairwise(at)]))
        got = url_filter.viterbi(label, cost, 7.0)
        assert "".join(got) == label and math.isclose(min(price(got), cheapest), price(got))


def test_urls_without_seed_words(spark):
    """Words that keep company with seeds block urls without any; the scores are those of a plain count."""
    import math

    from collections import Counter

    rows = [(i, f"http://casino-slots{'-roulette' if i % 2 else ''}.org/play") for i in range(20)] + [(100 + i, f"http://garden-tools.org/{'play' if i % 8 == 0 else 'page'}") for i in range(80)]
    rows += [(900, "http://slots-roulette.org/page"), (901, "http://tools.org/play"), (902, "http://never-seen-before.org/")]
    words = spark.createDataFrame([("casino", 5)], "word string, n long")
    rules = url_filter.rule_table(spark, [])
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules, words).collect()}
    assert {i for i, r in got.items() if r.verdict == "block"} == {*range(20), 900}
    tokens = {i: [*u.split("//")[1].split(".org/")[0].split("-"), *["/" + p for p in u.split(".org/")[1:] if p]] for i, u in rows}
    counts = {1: Counter(), 0: Counter()}
    for ts in tokens.values():
        counts[int("casino" in ts)].update(t for t in ts if t != "casino")
    t1, t0 = sum(counts[1].values()), sum(counts[0].values())
    share = (t1 + 0.5) / (t1 + t0 + 1)
    for i, ts in tokens.items():
        odds = math.log((20 + 1) / (len(rows) - 20 + 1)) + 6.0 * ("casino" in ts)
        odds += sum(math.log((counts[1][t] + share) / (counts[0][t] + 1 - share)) - math.log(share / (1 - share)) for t in ts if t != "casino")
        assert math.isclose(got[i].log_odds, odds, abs_tol=1e-9), i
