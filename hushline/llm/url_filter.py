"""URL filter: rules on hosts and paths, and for the other urls naive Bayes over segmented words.

Host labels are runs of letters glued together (``cheappillsnow``).  A unigram Viterbi search splits each label into
the words with the highest total log probability; word counts come from the corpus.  A multinomial naive Bayes model
over the words of host and path then scores the url.

Edge cases: a null url, or one without ``://``, has an empty host and path, no words, and gets the prior's verdict; an
empty path fits no rule that asks for one; of several fitting rules the longest wins, of equally long ones the first in
order; repeated rows each get their own result; other columns are ignored; a host label longer than ``LONGEST_LABEL`` is one word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushline.llm.common import ascii_lower, salted_join, stored

MAX_WORD = 24
RULE_BROADCAST = 100_000
#: A longer label is one word (names of the DNS have at most 63 characters in a label).
LONGEST_LABEL = 1000
#: Cost of each letter of an unknown word, beside the cost of a word seen once.
LETTER = 1.6
#: Words of at most so many letters may lie in very many labels.
SHORT_WORD, SALTS = 4, 16
#: What a seed word says for its class.
SEED_LOG_ODDS = 6.0

# Words that mark unwanted sites, the weak labels of the registered query.
SEEDS = ("adult", "porn", "sex", "xxx", "nude", "escort", "casino", "poker", "bet", "bets", "betting", "gambling", "jackpot", "lottery", "pills", "viagra",
         "cialis", "pharma", "spam", "ads", "advert", "malware", "phishing", "warez", "keygen", "torrent")


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def parsed(urls: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """Id, url, ``host`` and ``path`` of every row and a row number, stored once."""
    return stored(urls.select(F.monotonically_increasing_id().alias("row"), urls[id].alias("page_id"), urls[url].alias("url"), url_host(urls[url]).alias("host"), url_path(urls[url]).alias("path")), "urls")


def fitting_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, action) of the longest fitting rule.

    ``rules``: ord, rule (``host/path``), action.  A url meets the rules of its host's suffixes by an equality join, so
    work does not grow with the number of rules.
    """
    parts = rules.select("ord", "rule", "action", F.regexp_extract("rule", "^([^/]*)", 1).alias("_host"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("_path"))
    if rules.count() <= RULE_BROADCAST:  # a rule is a short line
        parts = F.broadcast(parts)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = rows.select("row", "path", F.explode(suffixes).alias("_host")).join(parts, "_host").where(F.col("path").startswith(F.col("_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), (-F.col("ord")).alias("o"), "rule", "action")).alias("b")
    return met.groupBy("row").agg(best).select("row", "b.rule", "b.action")


# --- segmentation ---

def pieces(text: Column) -> Column:
    """Runs of letters and digits, lower case; numbers of any value are one token."""
    runs = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(runs, lambda x: x != ""), lambda x: F.when(x.rlike(r"^\p{N}+$"), F.lit("<num>")).otherwise(x))


def visible_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """(text): what each page shows, without the web addresses in it.

    A host name among the words would be a word itself, and cheaper whole than split.
    """
    shown = F.regexp_replace(F.coalesce(pages[html], F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return pages.select(F.regexp_replace(shown, r"(?i)\b(?:[a-z][a-z0-9+.-]*://|www\.)\S*", " ").alias("text"))


def unigrams(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows: the words that a segmentation may use, with their counts."""
    words = texts.select(F.explode(F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), lambda w: (F.length(w) > 1) & (F.length(w) <= MAX_WORD))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, cost: dict[str, float], unknown: float, letter: float = LETTER) -> list[str]:
    """The cheapest split of ``label``; a run outside known words is one word, for ``unknown`` and ``letter`` for each of its letters.

    Two unknown runs never meet, as one run of both is cheaper; of equally cheap splits the one with the later last word start stands.
    """
    best, back = [0.0] + [math.inf] * len(label), [0] * (len(label) + 1)
    run = 0  # where the cheapest unknown run that reaches the place at hand begins
    for end in range(1, len(label) + 1):
        if best[end - 1] - letter * (end - 1) <= best[run] - letter * run:
            run = end - 1
        best[end], back[end] = best[run] + unknown + letter * (end - run), run
        for start in range(max(0, end - MAX_WORD), end):
            c = cost.get(label[start:end])
            if c is not None and best[start] + c <= best[end]:
                best[end], back[end] = best[start] + c, start
    out, end = [], len(label)
    while end:
        out.append(label[back[end]:end])
        end = back[end]
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(label, words): every distinct label split by the Viterbi search.

    The dictionary is never broadcast: a label's substrings meet it in a join, so each label brings only the words that
    it can use to its task.  Short substrings occur in many labels, so their words are repeated into ``SALTS`` parts.
    ``total``: the count of all words.
    """
    starts = F.sequence(F.lit(1), F.length("label"))
    subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(MAX_WORD), F.length("label") - i + 1)),
                                                              lambda n: F.substr(F.col("label"), i, n))))
    some = F.when(F.length("label").between(2, LONGEST_LABEL), F.filter(F.array_distinct(subs), lambda s: F.length(s) > 1)).otherwise(F.array().cast("array<string>"))
    short = F.length("word") <= SHORT_WORD
    wanted = labels.select("label", F.explode_outer(some).alias("word")).withColumn("_part", F.when(short, F.pmod(F.xxhash64("label"), F.lit(SALTS))).otherwise(0))
    parts = F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<bigint>")
    met = wanted.join(words.select("word", "n", F.explode(parts).alias("_part")), ["word", "_part"], "left")
    met = met.groupBy("label").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))
    unknown = math.log(max(total, 1))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"label": b["label"], "words": [
                viterbi(x, {k["word"]: math.log(total) - math.log(k["n"]) for k in known}, unknown) for x, known in zip(b["label"], b["known"], strict=True)]})

    return met.mapInPandas(split, "label string, words array<string>")


def url_tokens(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(row, token, n): words of the segmented host, without its last label, and of the path."""
    host = F.regexp_replace("host", r"\.?[^.]*$", "")
    names = rows.select("row", F.explode(pieces(host)).alias("label"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    cut = stored(segmented(names.select("label").where("label <> '<num>'").distinct(), words, total), "segments")
    split = salted_join(names, cut, ["label"], F.col("row")).select("row", F.explode(F.coalesce("words", F.array("label"))).alias("token"))
    paths = rows.select("row", F.explode(pieces(F.col("path"))).alias("token")).select("row", F.concat(F.lit("/"), "token").alias("token"))
    return split.unionByName(paths).groupBy("row", "token").agg(F.count(F.lit(1)).alias("n"))


# --- naive Bayes ---

def train(tokens: DataFrame, labels: DataFrame, smooth: float = 1.0) -> tuple[DataFrame, float, float]:
    """From tokens (row, token, n) and labels (row, label 0/1): (token, weight), the weight of an unseen token, the prior's log odds.

    Counts are smoothed by ``smooth`` tokens shared out as the classes share all tokens, so a rare token says little and an
    unseen one nothing.  Class totals are two numbers; the model itself stays a table.
    """
    n1, n0 = "sum(CASE WHEN label = 1 THEN n ELSE 0 END)", "sum(CASE WHEN label = 0 THEN n ELSE 0 END)"
    counts = stored(tokens.join(labels, "row").groupBy("token").agg(F.expr(n1).alias("n1"), F.expr(n0).alias("n0")), "counts")
    t = counts.agg(F.sum("n1"), F.sum("n0")).first()
    share1 = ((t[0] or 0) + 0.5) / ((t[0] or 0) + (t[1] or 0) + 1)
    d = labels.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    prior = math.log((d[0] + 1) / (d[1] - d[0] + 1))
    weight = F.log((F.col("n1") + smooth * share1) / (F.col("n0") + smooth * (1 - share1))) - math.log(share1 / (1 - share1))
    return counts.select("token", weight.alias("weight")), 0.0, prior


def score(tokens: DataFrame, model: tuple[DataFrame, float, float]) -> DataFrame:
    """(row, log_odds) of rows that have tokens; frequent tokens are spread by a salted join."""
    weights, unseen, prior = model
    met = salted_join(tokens, weights, ["token"], F.col("row"))
    return met.groupBy("row").agg((F.lit(prior) + F.sum(F.col("n") * F.coalesce("weight", F.lit(unseen)))).alias("log_odds"))


def is_seed(seeds: tuple[str, ...]) -> Column:
    return F.ltrim(F.col("token"), F.lit("/")).isin(*seeds) if seeds else F.lit(False)


def seed_labels(tokens: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """Weak labels (row, label): 1 if any token is a seed word."""
    return tokens.groupBy("row").agg(F.max(is_seed(seeds).cast("int")).alias("label"))


def seeded_scores(tokens: DataFrame, seeds: tuple[str, ...] = SEEDS) -> tuple[DataFrame, float]:
    """(row, log_odds), and the prior, of a model whose labels come from seed words and whose weights come from all other words.

    What names a label takes no part in learning from it: the model is fitted to the words beside the seeds, so it can judge
    urls without any seed.  A seed word itself counts ``SEED_LOG_ODDS``, once a url, which is given and not learned.
    """
    weights, unseen, prior = train(tokens.where(~is_seed(seeds)), seed_labels(tokens, seeds))
    met = salted_join(tokens, weights, ["token"], F.col("row"))
    learned = F.sum(F.when(~is_seed(seeds), F.col("n") * F.coalesce("weight", F.lit(unseen))).otherwise(0.0))
    odds = F.lit(prior) + learned + F.max(is_seed(seeds).cast("int")) * SEED_LOG_ODDS
    return met.groupBy("row").agg(odds.alias("log_odds")), prior


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, r, a) for i, (r, a) in enumerate(rules)], "ord int, rule string, action string")


def judge(urls: DataFrame, rules: DataFrame, words: DataFrame, labels=None, id: str = "page_id", url: str = "url", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """Per row page_id, url, host, path, rule (or null), log_odds and verdict: the rule's action, else block where the odds are above even.

    ``words`` is a table of ``unigrams``.  ``labels`` makes (row, label) from the tokens, for a model over all words; without
    it labels come from ``seeds``, and the model learns from the words beside them.
    """
    rows = parsed(urls, id, url)
    tokens = stored(url_tokens(rows, words), "tokens")
    if labels is None:
        scores, prior = seeded_scores(tokens, seeds)
    else:
        model = train(tokens, labels(tokens))
        scores, prior = score(tokens, model), model[2]
    out = rows.join(fitting_rules(rows, rules), "row", "left").join(scores, "row", "left").drop("row")
    odds = F.coalesce("log_odds", F.lit(prior))
    return out.withColumn("log_odds", odds).withColumn("verdict", F.coalesce("action", F.when(odds > 0, F.lit("block")).otherwise(F.lit("allow"))))
