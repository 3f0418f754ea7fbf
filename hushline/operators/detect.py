"""Detection: lexicon and pattern matches in cues, overlap and context rules, scores.

``detect_matches`` hands lexicons of up to ``MOST_FOLDED`` words to the tasks as hash sets:
a cue is judged inside its own row, with no shuffle and no join, in batch and on a
stream.  A larger lexicon stays a table: the distinct words of each text meet it in a
join, and a cue is then judged by the words found in it.  ``detect_by_joins`` gives the
same matches by match tables.

The operators below work on a match table with one row per match:
``track_id, cue_id, word, start_idx, end_idx, type, confidence, term, context``.
``term`` is what exempt and context rules look up; ``context`` is the text
around the match.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import fixed_values as fv, listed as H, text as T
from hushline.functions.listed import MATCH_TYPE
from hushline.operators import lexicon as L, ordered as O, skew

MATCH_FIELDS = ["word", "start_idx", "end_idx", "type", "confidence", "term", "context"]
KEYS = ["track_id", "cue_id"]
#: More rows than this in a rule table are an error; nothing is ever cut off.
MOST_RULES = 1_000_000
#: Words of a lexicon that the driver reads; a larger one is joined.
MOST_FOLDED = 50_000
#: Entries that each word is compared with by length; more are found by their pieces.
MOST_COMPARED = 200


def _nothing() -> Column:
    return F.array().cast(MATCH_TYPE)


@dataclass
class Rules:
    """Rule tables of one run, read once on the driver; all are small by nature."""

    words: list[str] | None = field(default_factory=list)  # None: too many, they stay a table
    phrases: list[str] = field(default_factory=list)
    patterns: list[tuple[str, str, str | None]] = field(default_factory=list)  # those that Spark's own expressions look up
    scans: list[tuple[str, str, str]] = field(default_factory=list)  # those that ``listed.hits`` looks up
    exempt: list[str] = field(default_factory=list)
    context: dict[str, dict[str, list[str]]] = field(default_factory=dict)


def read_rules(lexicon: DataFrame | None = None, patterns: DataFrame | None = None, rules: DataFrame | None = None, exempt: DataFrame | None = None, most: int | None = None) -> Rules:
    """Rule tables read by the driver; of a lexicon with more than ``most`` rows the phrases alone."""
    out = Rules()
    if lexicon is not None:
        listed = L.rows_up_to(lexicon.select("ord", "norm_term", "kind"), MOST_FOLDED if most is None else most)
        if listed is None:
            out.words, listed = None, L.all_rows(lexicon.filter("kind = 'phrase'").select("ord", "norm_term", "kind"), MOST_RULES)
        for r in sorted(listed):
            (out.phrases if r.kind == "phrase" else out.words).append(r.norm_term)
    by_ord = lambda df: sorted(L.all_rows(df, MOST_RULES), key=lambda r: r.ord)
    if patterns is not None:
        for r in by_ord(patterns):
            scan = H.scanned(r.term, r.pattern, r.letters)
            if scan:
                out.scans.append(scan)
            else:
                out.patterns.append((r.term, T.ascii_pattern(r.pattern), r.letters))
    if rules is not None:
        for r in by_ord(rules):
            of = out.context.setdefault(r.term.lower(), {"allowed": [], "profane": []})
            if r.kind in of:
                of[r.kind].append(T.ascii_pattern(r.pattern, r.case_sensitive))
    if exempt is not None:
        out.exempt = [r.term for r in L.all_rows(exempt, MOST_RULES)]
    return out


# ---------------------------------------------------------------- in one row


def _around(text: Column, start: Column, end: Column) -> Column:
    first = F.greatest(F.lit(0), start - fv.CONTEXT_CHARS)
    return F.substring(text, first + 1, end + fv.CONTEXT_CHARS - first)


def _with_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, column in steps:
        df = df.withColumn(name, column)
    return df


def _settled(df: DataFrame, name: str) -> DataFrame:
    """The same table with one column that later filters cannot be pushed through.

    A filter on a computed column is otherwise rewritten into the expressions
    below it, which would run the whole chain of steps a second time.
    """
    others = [c for c in df.columns if c != name]
    boxed = F.explode_outer(F.array(F.struct(F.col(name).alias("v")))).alias("_box")
    return df.select(*others, boxed).select(*others, F.col("_box.v").alias(name))


def _match(text, word, start, end, kind: str, confidence: float, term) -> Column:
    return F.struct(
        word.alias("word"), start.alias("start_idx"), end.alias("end_idx"), F.lit(kind).alias("type"),
        F.lit(confidence).alias("confidence"), term.alias("term"), _around(text, start, end).alias("context"))


def _words_of(lexicon: DataFrame) -> DataFrame:
    return lexicon.filter("kind = 'word'").select(F.col("norm_term").alias("_norm"))


def _meeting(cues: DataFrame, table: DataFrame, value: Column, name: str, parts: Column | None = None) -> DataFrame:
    """Cues with ``value`` of all rows of ``table(_norm, ...)`` whose word is in the text, as an array; null for none.

    Only distinct words of distinct texts are shuffled, under a hash of the text.  Should two hashes be equal, both texts get
    the rows of both, of which only those of their own words count.
    """
    texts = cues.select("text").filter("text is not null").distinct()
    rows = texts.select(F.xxhash64("text").alias("_text"), F.explode(H.norms(F.col("text")) if parts is None else parts).alias("_norm"))
    met = skew.split_join(rows, table, ["_norm"], spread=["_text"]).groupBy("_text").agg(F.collect_list(value).alias(name))
    return skew.split_join(cues.withColumn("_text", F.xxhash64("text")), met, ["_text"], "left").drop("_text")


def pattern_steps(text: Column, patterns: list[tuple[str, str, str | None]]) -> list[tuple[str, Column]]:
    """All matches of the obfuscation patterns in column ``_r``.

    A pattern that only puts filler between letters can match only where the
    text without fillers holds these letters, which is cheap to look up.
    """
    if not patterns:
        return [("_r", _nothing())]
    bare = F.lower(F.translate(text, H.FILLERS, "")) if any(p[2] for p in patterns) else F.lit("")

    def of(term, pattern, letters):
        maybe = F.col("_bare").contains(letters) if letters else F.lit(True)
        return F.when(maybe & text.rlike(pattern), F.transform(
            T.spans("text", pattern), lambda s: F.struct(s["word"], s["start_idx"], s["end_idx"], F.lit(term).alias("term")))).otherwise(none)

    none = F.array().cast("array<struct<word:string,start_idx:int,end_idx:int,term:string>>")
    as_match = lambda s: _match(text, s["word"], s["start_idx"], s["end_idx"], "regex", fv.PATTERN_CONFIDENCE, s["term"])
    found = F.transform(F.concat(*[of(*p) for p in patterns]), as_match)
    return [("_bare", F.when(text.rlike(f"[_\\-.*@#$&%!?]"), bare).otherwise(F.lower(text))), ("_r", found)]


def overlaps(a, b) -> Column:
    return (a["start_idx"] < b["end_idx"]) & (b["start_idx"] < a["end_idx"])


def _in_text_order(matches: Column) -> Column:
    """Earliest start first, longest first among equal starts."""
    keyed = F.transform(matches, lambda m: F.struct(m["start_idx"].alias("s"), (-m["end_idx"]).alias("e"), m.alias("m")))
    return F.when(F.size(matches) <= 1, matches).otherwise(F.transform(F.sort_array(keyed), lambda k: k["m"]))


def _first_of_overlapping(matches: Column) -> Column:
    """Left to right, drop a match that overlaps the one kept before."""
    kept = F.aggregate(
        _in_text_order(matches),
        F.struct(F.lit(0).alias("end"), _nothing().alias("kept")),
        lambda acc, m: F.when(m["start_idx"] >= acc["end"], F.struct(m["end_idx"].alias("end"), F.concat(acc["kept"], F.array(m)).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return F.when(F.size(matches) <= 1, matches).otherwise(kept)


def _off(matches: Column, others: Column) -> Column:
    """Matches that overlap none of the others."""
    return F.when((F.size(matches) == 0) | (F.size(others) == 0), matches).otherwise(
        F.filter(matches, lambda m: ~F.exists(others, lambda o: overlaps(m, o))))


def overlap_steps() -> list[tuple[str, Column]]:
    """Phrases (_p) before patterns (_r) before tokens (_t); a lower one that overlaps is dropped."""
    return [
        ("_p", _first_of_overlapping(F.col("_p"))),
        ("_r", _off(F.col("_r"), F.col("_p"))),
        ("_r", _first_of_overlapping(F.col("_r"))),
        ("_h", F.concat("_p", "_r")),
        ("_t", _off(F.col("_t"), F.col("_h"))),
        ("_t", _first_of_overlapping(F.col("_t"))),
        ("matches", _in_text_order(F.concat("_h", "_t"))),
    ]


def context_hit(term: Column, context: Column, rules: dict, kind: str) -> Column:
    """Whether any pattern of this kind, listed for the term, is found in the context."""
    out = F.lit(False)
    for name, lists in rules.items():
        if lists[kind]:
            any_of = F.lit(False)
            for p in lists[kind]:
                any_of = any_of | context.rlike(p)
            out = out | ((term == name) & any_of)
    return out


def _context_confidence(m, rules: dict) -> Column:
    known = m["term"].isin(list(rules)) if rules else F.lit(False)
    sure = context_hit(m["term"], m["context"], rules, "profane")
    return F.when(~known, fv.EXACT_CONFIDENCE).when(sure, fv.EXACT_CONFIDENCE).otherwise(fv.UNSURE_CONFIDENCE)


def _drop(matches: Column, condition) -> Column:
    return F.when(F.size(matches) == 0, matches).otherwise(F.filter(matches, lambda m: ~condition(m)))


def _exempt_condition(exempt: list[str]):
    # patterns are looked up by the word they stand for, the others by their own text
    return lambda m: T.normalize_text(m["term"]).isin(exempt)


def detect_columns(text: Column, rules: Rules, sensitivity: str, use_context: bool, listed: Column) -> list[tuple[str, Column]]:
    """Steps of detection as named columns; each step reads the ones before it.  ``listed`` holds the matches of words and phrases."""
    steps = [("_listed", listed)] + pattern_steps(text, rules.patterns) + [("_r", F.concat("_listed.r", "_r")), ("_t", F.col("_listed.t")), ("_p", F.col("_listed.p"))]
    dropped = []
    if sensitivity == "low" and rules.exempt:
        dropped.append(_exempt_condition(rules.exempt))
    if use_context and rules.context:
        dropped.append(lambda m: context_hit(m["term"], m["context"], rules.context, "allowed"))
    for condition in dropped:
        steps += [(c, _drop(F.col(c), condition)) for c in ("_p", "_r", "_t")]
    if use_context:
        steps.append(("_t", F.transform("_t", lambda m: m.withField("confidence", _context_confidence(m, rules.context)))))
    return steps + overlap_steps()


def score_columns(df: DataFrame, sensitivity: str) -> DataFrame:
    total = F.aggregate("matches", F.lit(0.0), lambda acc, m: acc + m["confidence"])
    n = F.size("matches")
    df = df.withColumn("score", F.when(n > 0, F.least(F.lit(100.0), total / n)).otherwise(0.0))
    return df.withColumn("has_profanity", (n > 0) & (F.col("score") >= fv.FLAG_AT[sensitivity]))


def _listed(cues: DataFrame, lexicon: DataFrame, found: Rules, fuzzy_threshold: float | None, words: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """The cues, and the column of their matches of words, phrases and scanned patterns, before any rule."""
    out, own = cues, {}
    if found.words is None:
        out, own["found"] = _meeting(out, _words_of(lexicon), F.col("_norm"), "_found"), F.col("_found")
    if fuzzy_threshold is not None:
        out, near = _with_close(out, close_words(cues, lexicon, fuzzy_threshold, words))
        own |= near
    return out, H.hits(F.col("text"), found.words or [], found.phrases, patterns=found.scans, **own)


def with_any_match(cues: DataFrame, lexicon: DataFrame, name: str, fuzzy_threshold: float | None = None, words: DataFrame | None = None) -> DataFrame:
    """The cues with ``name``: whether any term of the lexicon is found in them.  Which matches overlap does not matter for that."""
    out, listed = _listed(cues, lexicon, read_rules(lexicon), fuzzy_threshold, words)
    out = out.withColumn("_listed", listed)
    return out.select(*cues.columns, (F.size("_listed.t") + F.size("_listed.p") > 0).alias(name))


def detect_matches(
    cues: DataFrame, lexicon: DataFrame, patterns: DataFrame | None = None, rules: DataFrame | None = None,
    exempt: DataFrame | None = None, sensitivity: str = "medium", use_context: bool = True,
    fuzzy_threshold: float | None = None, words: DataFrame | None = None,
) -> DataFrame:
    """Cues with ``matches ARRAY<STRUCT>``, ``score`` and ``has_profanity``.

    ``words`` is the ``vocabulary`` of these cues, or of more; without it, fuzzy terms have the cues read once more for it.
    """
    # a stream cannot be grouped by its texts
    found = read_rules(lexicon, patterns, rules, exempt, MOST_RULES if cues.isStreaming else MOST_FOLDED)
    out, listed = _listed(cues, lexicon, found, fuzzy_threshold, words)
    out = _with_steps(out, detect_columns(F.col("text"), found, sensitivity, use_context, listed))
    return score_columns(_settled(out.select(*cues.columns, "matches"), "matches"), sensitivity)


def match_table(detected: DataFrame) -> DataFrame:
    """One row per match.  The outer form keeps the plan from testing every cue twice."""
    rows = detected.select(*KEYS, F.inline_outer("matches")).filter(F.col("word").isNotNull())
    return rows.select(*KEYS, *MATCH_FIELDS)


# ---------------------------------------------------------------- match tables


def _explode_matches(cues: DataFrame, column: Column) -> DataFrame:
    rows = cues.select(*KEYS, F.inline_outer(column)).filter(F.col("word").isNotNull())
    return rows.select(*KEYS, *MATCH_FIELDS)


def tokens(cues: DataFrame) -> DataFrame:
    """tokens(track_id, cue_id, pos, word, start_idx, end_idx)."""
    rows = cues.select(*KEYS, F.posexplode_outer(T.token_spans("text")).alias("pos", "t")).filter(F.col("pos").isNotNull())
    return rows.select(*KEYS, "pos", "t.word", "t.start_idx", "t.end_idx")


def exact_matches(cues: DataFrame, lexicon: DataFrame, most_broadcast: int = MOST_FOLDED) -> DataFrame:
    """Tokens whose normalised form is in the lexicon; beyond ``most_broadcast`` terms texts meet it in a join, frequent words split."""
    slim, words = cues.select(*KEYS, "text"), L.rows_up_to(_words_of(lexicon), most_broadcast)
    if words is None:
        slim = _meeting(slim, _words_of(lexicon), F.col("_norm"), "_found")
        return _explode_matches(slim, H.hits(F.col("text"), found=F.col("_found"))["t"])
    return _explode_matches(slim, H.hits(F.col("text"), [r[0] for r in words])["t"])


def phrase_matches(cues: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every place of every listed phrase; overlaps are left to ``drop_overlaps``."""
    found = read_rules(lexicon.filter("kind = 'phrase'"), most=MOST_RULES)
    return _explode_matches(cues.select(*KEYS, "text"), H.hits(F.col("text"), phrases=found.phrases)["p"])


def obfuscated_matches(cues: DataFrame, patterns: DataFrame) -> DataFrame:
    found = read_rules(patterns=patterns)
    steps = pattern_steps(F.col("text"), found.patterns) + [("_r", F.concat(H.hits(F.col("text"), patterns=found.scans)["r"], "_r"))]
    return _explode_matches(_with_steps(cues, steps), F.col("_r"))


def _parts(size: Column, edits: Column, part: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of a part when ``size`` letters are cut into ``edits + 1`` parts, the longer ones last."""
    short, long_ones = (size / (edits + 1)).cast("int"), size % (edits + 1)
    turn = edits + 1 - long_ones  # the first part that is a letter longer
    return part * short + F.greatest(F.lit(0), part - turn), short + F.when(part >= turn, 1).otherwise(0)


def fuzzy_candidates(vocabulary: DataFrame, lexicon: DataFrame, threshold: float) -> DataFrame:
    """(norm, norm_term, ord, max_len): pairs that may be close enough, found by equality on pieces of text.

    An entry of which at most ``d`` letters are edited keeps one of its ``d + 1``
    parts whole.  In a word of ``e`` letters more, part ``i`` then begins at most
    ``i`` places from its own and at most ``d - i`` places from ``e`` after it, if
    the parts before and after are taken together; so a word asks for few pieces.
    The number of edits follows from the lengths of both, so a piece is looked up
    under (length of the entry, edits, part).

    A word has dozens of pieces, so a list of up to ``MOST_COMPARED`` entries is
    met by length alone.
    """
    if not 0 <= threshold < 1:
        raise ValueError("a threshold of 1 or more fits every word")
    edits = lambda a, b: F.floor(threshold * F.greatest(a, b) + 1e-9).cast("int")
    entries = lexicon.select("norm_term", "ord").filter("length(norm_term) > 0").distinct()
    if L.fits(entries, MOST_COMPARED):
        longer = F.greatest(F.length("norm"), F.length("norm_term"))
        near = F.abs(F.length("norm") - F.length("norm_term")) <= F.floor(threshold * longer + 1e-9)
        return vocabulary.select("norm").distinct().join(F.broadcast(entries), near).select("norm", "norm_term", "ord", longer.alias("max_len"))
    i = F.col("_i")
    entry_start, entry_size = _parts(F.col("_len"), F.col("_d"), i)
    longest = F.floor(F.col("_len") / (1 - threshold) + 1).cast("int")
    entries = lexicon.select("norm_term", "ord", F.length("norm_term").alias("_len"))
    entries = entries.withColumn("_d", F.explode(F.sequence(edits(F.col("_len"), F.col("_len")), edits(F.col("_len"), longest))))
    entries = entries.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d"))))
    entries = entries.select("norm_term", "ord", "_len", "_d", "_i", F.substring("norm_term", entry_start + 1, entry_size).alias("_piece"))

    size = F.length("norm")
    low, high = F.greatest(F.lit(1), F.floor(size * (1 - threshold))).cast("int"), F.floor(size / (1 - threshold) + 1).cast("int")
    words = vocabulary.select("norm").distinct().withColumn("_len", F.explode(F.sequence(low, F.greatest(low, high))))
    words = words.withColumn("_d", edits(size, F.col("_len"))).filter(F.abs(size - F.col("_len")) <= F.col("_d"))
    words = words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_d"))))
    start, length = _parts(F.col("_len"), F.col("_d"), i)
    longer = size - F.col("_len")
    first = F.greatest(F.lit(0), start - i, start + longer - (F.col("_d") - i))
    last = F.least(size - length, start + i, start + longer + (F.col("_d") - i))
    words = words.withColumn("_at", F.explode(F.when(first <= last, F.sequence(first, last))))
    words = words.select("norm", "_len", "_d", "_i", F.substring("norm", F.col("_at") + 1, length).alias("_piece")).distinct()
    found = words.join(entries, ["_len", "_d", "_i", "_piece"])
    return found.select("norm", "norm_term", "ord", F.greatest(size, F.col("_len")).alias("max_len")).distinct()


def fuzzy_vocabulary(vocabulary: DataFrame, lexicon: DataFrame, threshold: float) -> DataFrame:
    """vocabulary(norm) to its first close lexicon entry: (norm, fuzzy_term, fuzzy_confidence).

    Every distinct word is judged once, against the candidates of the index of pieces.
    """
    close = fuzzy_candidates(vocabulary, lexicon, threshold).withColumn("_d", F.levenshtein("norm", "norm_term"))
    close = close.filter(F.col("_d") / F.col("max_len") <= threshold)
    best = close.groupBy("norm").agg(F.min_by(F.struct("norm_term", "_d", "max_len"), "ord").alias("_b"))
    return best.select("norm", F.col("_b.norm_term").alias("fuzzy_term"),
                       (100.0 - F.col("_b._d") / F.col("_b.max_len") * 100.0).alias("fuzzy_confidence"))


def vocabulary(cues: DataFrame) -> DataFrame:
    """Stored (norm): the distinct normalised words of the cues, for several searches for close words."""
    return O.materialize(H.vocabulary(cues).distinct())


def close_words(cues: DataFrame, lexicon: DataFrame, threshold: float, words: DataFrame | None = None) -> DataFrame:
    """Stored (_norm, confidence) of the words in the cues, or in ``words``, that are not in the lexicon, but close to an entry."""
    words = H.vocabulary(cues).distinct() if words is None else words
    words = words.join(lexicon.select(F.col("norm_term").alias("norm")).distinct(), "norm", "left_anti")
    return O.materialize(fuzzy_vocabulary(words, lexicon, threshold).select(F.col("norm").alias("_norm"), F.col("fuzzy_confidence").alias("confidence")))


def _with_close(cues: DataFrame, close: DataFrame) -> tuple[DataFrame, dict]:
    """The cues, and close words as an argument for ``listed.hits``: for all rows, or, if there are many, as a column of the cues."""
    rows = L.rows_up_to(close, MOST_FOLDED)
    if rows is not None:
        return cues, {"near": {r[0]: r[1] for r in rows}}
    return _meeting(cues, close, F.struct("_norm", "confidence"), "_close"), {"close": F.map_from_entries("_close")}


def fuzzy_matches(cues: DataFrame, lexicon: DataFrame, threshold: float) -> DataFrame:
    """Tokens without an exact hit that are close to a lexicon entry.

    The cues are read for their distinct words, which are judged once each, and again for the places of the close ones.
    """
    slim, near = _with_close(cues.select(*KEYS, "text"), close_words(cues, lexicon, threshold))
    return _explode_matches(slim, H.hits(F.col("text"), **near)["t"])


def drop_overlaps(matches: DataFrame) -> DataFrame:
    """Phrases before patterns before tokens, per cue.

    A cue is one row of text, so its matches are few; they are gathered per cue
    and judged in order.
    """
    phrase = (F.col("type") == "exact") & F.col("word").rlike(rf"[{T.WS}\-]")
    kind = F.when(phrase, 0).when(F.col("type") == "regex", 1).otherwise(2)
    of = lambda k: F.filter("_all", lambda m: m["_kind"] == k)
    plain = lambda a: F.transform(a, lambda m: F.struct(*[m[f].alias(f) for f in MATCH_FIELDS]))
    packed = matches.withColumn("_kind", kind).groupBy(*KEYS).agg(F.collect_list(F.struct(*MATCH_FIELDS, "_kind")).alias("_all"))
    for i, name in enumerate(("_p", "_r", "_t")):
        packed = packed.withColumn(name, plain(of(i)))
    packed = _with_steps(packed, overlap_steps())
    return match_table(packed.select(*KEYS, "matches"))


def context_allowed(matches: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop matches that one of the allowed patterns of their word explains."""
    found = read_rules(rules=rules).context
    return matches.filter(~context_hit(F.col("term"), F.col("context"), found, "allowed"))


def context_confidence(matches: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Confidence of token matches after the context was looked at; without rules all are certain."""
    found = read_rules(rules=rules).context
    as_match = {c: F.col(c) for c in ("term", "context")}
    return matches.withColumn("confidence", _context_confidence(as_match, found))


def exempt_low(matches: DataFrame, exempt: DataFrame, sensitivity: str) -> DataFrame:
    """At low sensitivity, drop exempt terms; otherwise keep everything."""
    if sensitivity != "low":
        return matches
    names = exempt.select(T.normalize_text(F.col("term")).alias("_norm")).distinct()
    return matches.withColumn("_norm", T.normalize_text(F.col("term"))).join(
        L.bounded_broadcast(names), "_norm", "left_anti").drop("_norm")


def score_cues(cues: DataFrame, matches: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Mean confidence per cue, capped at 100; clean cues stay with score 0."""
    per_cue = matches.groupBy(*KEYS).agg(F.least(F.lit(100.0), F.avg("confidence")).alias("score"), F.count(F.lit(1)).alias("n_matches"))
    out = cues.join(per_cue, KEYS, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("bigint")))
    out = out.withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.withColumn("has_profanity", (F.col("n_matches") > 0) & (F.col("score") >= fv.FLAG_AT[sensitivity]))


def detect_by_joins(
    cues: DataFrame, lexicon: DataFrame, patterns: DataFrame | None = None, rules: DataFrame | None = None,
    exempt: DataFrame | None = None, sensitivity: str = "medium", use_context: bool = True, fuzzy_threshold: float | None = None,
) -> DataFrame:
    """The same result as ``detect_matches`` for lexicons that should stay tables; not for streams."""
    words = exact_matches(cues, lexicon)
    if fuzzy_threshold is not None:
        words = words.unionByName(fuzzy_matches(cues, lexicon, fuzzy_threshold))
    if use_context:
        words = context_confidence(words, rules)
    found = words.unionByName(phrase_matches(cues, lexicon))
    if patterns is not None:
        found = found.unionByName(obfuscated_matches(cues, patterns))
    if exempt is not None:
        found = exempt_low(found, exempt, sensitivity)
    if use_context and rules is not None:
        found = context_allowed(found, rules)
    kept = drop_overlaps(found)
    ordered = F.array_sort(F.collect_list(F.struct("start_idx", F.struct(*MATCH_FIELDS).alias("m"))))
    per_cue = kept.groupBy(*KEYS).agg(F.transform(ordered, lambda k: k["m"]).alias("matches"))
    out = cues.join(per_cue, KEYS, "left").withColumn("matches", F.coalesce("matches", _nothing()))
    return score_columns(out, sensitivity)


def phrase_matches_joined(cues: DataFrame, lexicon: DataFrame, most_broadcast: int = MOST_FOLDED) -> DataFrame:
    """Phrase places for lists of any length: beyond ``most_broadcast`` phrases, runs of pieces meet the list in a join.

    Of each distinct text only its distinct runs are shuffled, those that begin as a phrase does if the first pieces are few
    enough to be handed to the tasks; frequent runs are split by their size.
    """
    slim = cues.select(*KEYS, "text")
    terms = lexicon.filter("kind = 'phrase'").select("norm_term")
    listed = L.rows_up_to(terms, most_broadcast)
    if listed is not None:
        return _explode_matches(slim, H.hits(F.col("text"), phrases=[r[0] for r in listed])["p"])
    known = O.materialize(terms.select(H.phrase_keys(F.col("norm_term")).alias("_k")).select(F.col("_k.key").alias("_norm"), "_k.first", "_k.n").distinct())
    sizes = [r[0] for r in L.all_rows(known.select("n").distinct(), MOST_FOLDED)]
    rows, firsts = L.rows_up_to(known.select("first", "n").distinct(), MOST_FOLDED), None
    if rows is not None:
        firsts = {}
        for r in rows:
            firsts.setdefault(r[0], []).append(r[1])
    met = _meeting(slim, known.select("_norm"), F.col("_norm"), "_said", H.runs(F.col("text"), sizes, firsts))
    return _explode_matches(met.filter("_said is not null"), H.hits(F.col("text"), said=F.col("_said"))["p"])
