"""Queries over text, detection, censoring, timing and reports, with comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushline.functions import fixed_values as fv, text as T
from hushline.operators import censor as X, detect as D, lexicon as L, merge as M, report as R, timing as W
from hushline.plans import corpus as C, reference_sql as S

CASES: dict[str, tuple] = {}


def case(name: str, sql: str | None = None):
    def add(fn):
        CASES[name] = (fn, sql)
        return fn

    return add


def detected(spark, sf, sensitivity="medium", fuzzy=None, cues=None, words=None):
    r = C.corpus_rules(spark)
    return D.detect_matches(C.document_cues(spark, sf) if cues is None else cues, r["lexicon"], r["patterns"], r["rules"], r["exempt"], sensitivity, True, fuzzy, words)


def all_candidates(spark, sf):
    cues, r = C.document_cues(spark, sf), C.corpus_rules(spark)
    found = D.exact_matches(cues, r["lexicon"]).unionByName(D.phrase_matches(cues, r["lexicon"]))
    return found.unionByName(D.obfuscated_matches(cues, r["patterns"]))


M_COLS = "track_id, cue_id, word, start_idx, end_idx, type, confidence, term, context"
CANDIDATES = "(SELECT * FROM exact_m UNION ALL SELECT * FROM phrase_m UNION ALL SELECT * FROM regex_m)"

# ------------------------------------------------------------------ text columns


@case("document_cues", S.with_(S.CUES, then="SELECT * FROM cues"))
def _(spark, sf):
    return C.document_cues(spark, sf)


@case("clean_text", f"SELECT page_id, {S.clean('html')} AS cleaned FROM pages")
def _(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


@case("sanitize_text", f"SELECT page_id, {S.sanitize('html')} AS sanitized FROM pages")
def _(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", T.sanitize_text(F.col("html")).alias("sanitized"))


@case("normalize_text", f"SELECT doc_id, {S.norm('text')} AS normalized FROM documents")
def _(spark, sf):
    return C.table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@case("tokens", S.with_(S.CUES, S.TOKENS, then="SELECT * FROM tokens"))
def _(spark, sf):
    return D.tokens(C.document_cues(spark, sf))


@case("syllables", S.with_(S.CUES, S.SPACE_WORDS, then="SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(max(syl) AS INTEGER) AS syllables FROM space_words GROUP BY word"))
def _(spark, sf):
    words = C.document_cues(spark, sf).select(F.explode_outer(T.space_words(F.col("text"))).alias("word")).filter("word is not null")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("syllables", T.syllables(F.col("word")))


@case("total_syllables", S.with_(S.CUES, S.SPACE_WORDS, then="SELECT c.track_id, c.cue_id, CAST(coalesce(sum(syl), 0) AS INTEGER) AS syllables FROM cues c LEFT JOIN space_words USING (track_id, cue_id) GROUP BY ALL"))
def _(spark, sf):
    return C.document_cues(spark, sf).select("track_id", "cue_id", T.total_syllables(F.col("text")).alias("syllables"))


@case("format_time", f"SELECT event_id, {S.format_time('(epoch_us(ts) // 1000) % 90000000')} AS shown FROM events")
def _(spark, sf):
    ev = C.table(spark, sf, "events")
    ms = F.pmod(F.floor(C.instant_micros(ev) / 1000), F.lit(90_000_000))
    return ev.select("event_id", T.format_time(ms).alias("shown"))


@case("parse_time", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (user_id * 60 + event_id % 60) * 1000 WHEN 1 THEN ((user_id % 24) * 3600 + (event_id % 60) * 60 + user_id % 60) * 1000 END AS ms FROM events")
def _(spark, sf):
    ev = C.table(spark, sf, "events")
    e, u = F.col("event_id"), F.col("user_id")
    s = lambda c: c.cast("string")
    shown = (
        F.when(e % 4 == 0, F.concat(s(u), F.lit(":"), s(e % 60)))
        .when(e % 4 == 1, F.concat_ws(":", s(u % 24), F.lpad(s(e % 60), 2, "0"), s(u % 60)))
        .when(e % 4 == 2, F.concat(F.lit("x"), s(u), F.lit(":1"))).otherwise(s(u)))
    return ev.select("event_id", T.parse_time(shown).alias("ms"))


@case("mask_word", S.with_(S.CUES, S.TOKENS, then="SELECT DISTINCT word, CASE WHEN length(word) <= 2 THEN word ELSE word[1] || repeat('*', length(word) - 2) || word[-1] END AS masked FROM tokens"))
def _(spark, sf):
    words = C.document_cues(spark, sf).select(F.explode_outer(T.words(F.col("text"))).alias("word")).filter("word is not null").distinct()
    return words.select("word", T.mask_word(F.col("word")).alias("masked"))


# ------------------------------------------------------------------ detection


def _line_lexicon():
    lines = [(t, i) for i, t in enumerate(C.CUSTOM)]
    base = [(t, i) for i, t in enumerate(C.WORDS + C.PHRASES)]
    trim = f"regexp_replace(term, '^[{S.WS}]+|[{S.WS}]+$', '', 'g')"
    return f"""WITH docs AS (SELECT count(*) AS n FROM documents),
custom AS (SELECT {trim} AS term, ord FROM {S.values(lines, 'term, ord')} WHERE {trim} <> ''),
base AS (SELECT term, ord FROM {S.values(base, 'term, ord')} UNION ALL SELECT term, ord + 1000000000 FROM custom WHERE term NOT LIKE '-%'),
gone AS (SELECT {S.norm("trim(substring(term, 2))")} AS n FROM custom WHERE term LIKE '-%'),
lex AS (SELECT {S.norm('term')} AS norm_term, first(term ORDER BY ord) AS term FROM base GROUP BY 1 HAVING {S.norm('first(term)')} NOT IN (SELECT n FROM gone)),
lens AS (SELECT unnest(regexp_extract_all(text, '{S.TOKEN}')) AS w FROM documents)
SELECT norm_term, any_value(term) AS term, any_value(CASE WHEN contains(norm_term, ' ') THEN 'phrase' ELSE 'word' END) AS kind, CAST(count(w) AS BIGINT) AS n
FROM lex LEFT JOIN (SELECT {S.norm('w')} AS w FROM lens) ON w = norm_term GROUP BY norm_term"""


@case("build_lexicon", _line_lexicon())
def _(spark, sf):
    """The lexicon with its custom lines applied, and how often its words occur."""
    lex = L.build_lexicon(L.terms_df(spark, C.WORDS + C.PHRASES), L.terms_df(spark, C.CUSTOM))
    words = C.table(spark, sf, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("w")).filter("w is not null")
    counts = words.groupBy(T.normalize_text(F.col("w")).alias("norm_term")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(lex.select("norm_term", "term", "kind")), "norm_term", "right").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


@case("exact_matches", S.with_(*S.BASE, S.EXACT, then=f"SELECT {M_COLS} FROM exact_m"))
def _(spark, sf):
    return D.exact_matches(C.document_cues(spark, sf), C.corpus_lexicon(spark))


@case("phrase_matches", S.with_(S.CUES, S.LEXICON, S.PHRASES, then=f"SELECT {M_COLS} FROM phrase_m"))
def _(spark, sf):
    return D.phrase_matches(C.document_cues(spark, sf), C.corpus_lexicon(spark))


@case("phrase_matches_joined", S.with_(S.CUES, S.LEXICON, S.PHRASES, then=f"SELECT {M_COLS} FROM phrase_m"))
def _(spark, sf):
    return D.phrase_matches_joined(C.document_cues(spark, sf), C.corpus_lexicon(spark))


@case("phrase_matches_split", S.with_(S.CUES, S.LEXICON, S.PHRASES, then=f"SELECT {M_COLS} FROM phrase_m"))
def _(spark, sf):
    """The way taken for phrase lists too large for a broadcast: frequent first pieces are split by their size."""
    return D.phrase_matches_joined(C.document_cues(spark, sf), C.corpus_lexicon(spark), most_broadcast=0)


@case("obfuscated_matches", S.with_(S.CUES, S.PATTERNS, then=f"SELECT {M_COLS} FROM regex_m"))
def _(spark, sf):
    return D.obfuscated_matches(C.document_cues(spark, sf), L.obfuscation_patterns(spark, C.PATTERNS))


FUZZY = f"""
vocab AS (SELECT DISTINCT {S.norm('word')} AS n FROM tokens),
pairs AS (SELECT v.n, l.norm_term, l.ord, levenshtein(v.n, l.norm_term) AS d, greatest(length(v.n), length(l.norm_term)) AS mx
  FROM vocab v JOIN lexicon l ON abs(length(v.n) - length(l.norm_term)) <= 0.25 * greatest(length(v.n), length(l.norm_term)) WHERE v.n NOT IN (SELECT norm_term FROM lexicon)),
near AS (SELECT n, first(d ORDER BY ord) AS d, first(mx ORDER BY ord) AS mx FROM pairs WHERE d / CAST(mx AS DOUBLE) <= 0.25 GROUP BY n),
fuzzy_m AS (SELECT t.track_id, t.cue_id, t.word, t.start_idx, t.end_idx, 'fuzzy' AS type, 100.0 - d / CAST(mx AS DOUBLE) * 100.0 AS confidence, lower(t.word) AS term,
  {S.context_of('t.start_idx', 't.end_idx')} AS context FROM tokens t JOIN near ON near.n = {S.norm('t.word')} JOIN cues USING (track_id, cue_id))"""


@case("fuzzy_matches", S.with_(*S.BASE, FUZZY, then="SELECT track_id, cue_id, word, start_idx, end_idx, type, round(confidence, 3) AS confidence, term, context FROM fuzzy_m"))
def _(spark, sf):
    return D.fuzzy_matches(C.document_cues(spark, sf), C.corpus_lexicon(spark), 0.25).withColumn("confidence", F.round("confidence", 3))


OPEN_RULES = S.detected().replace(f"WHERE NOT {S.ALLOWED}", "WHERE TRUE").replace(f" AND NOT {S.EXEMPT}", "")


def _overlap_sql():
    plain = OPEN_RULES.replace(S.TOKEN_CONFIDENCE, "confidence")
    return S.with_(*S.ALL, plain, then=f"SELECT {M_COLS} FROM kept_m")


@case("drop_overlaps", _overlap_sql())
def _(spark, sf):
    return D.drop_overlaps(all_candidates(spark, sf))


@case("context_allowed", S.with_(*S.ALL, then=f"SELECT {M_COLS} FROM {CANDIDATES} WHERE NOT {S.ALLOWED}"))
def _(spark, sf):
    return D.context_allowed(all_candidates(spark, sf), L.context_rules(spark, C.CONTEXT))


@case("context_confidence", S.with_(*S.BASE, S.EXACT, then=f"SELECT track_id, cue_id, word, start_idx, CAST({S.TOKEN_CONFIDENCE} AS DOUBLE) AS confidence FROM exact_m"))
def _(spark, sf):
    found = D.exact_matches(C.document_cues(spark, sf), C.corpus_lexicon(spark))
    return D.context_confidence(found, L.context_rules(spark, C.CONTEXT)).select("track_id", "cue_id", "word", "start_idx", "confidence")


@case("exempt_low", S.with_(*S.ALL, then=f"SELECT {M_COLS} FROM {CANDIDATES} WHERE NOT {S.EXEMPT}"))
def _(spark, sf):
    return D.exempt_low(all_candidates(spark, sf), L.exempt_terms(spark, C.EXEMPT), "low").select(*D.KEYS, *D.MATCH_FIELDS)


@case("detect", S.with_(*S.ALL, S.detected(), then="SELECT track_id, cue_id, word, start_idx, end_idx, type, CAST(confidence AS DOUBLE) AS confidence FROM kept_m"))
def _(spark, sf):
    return D.match_table(detected(spark, sf)).drop("term", "context")


@case("detect_low", S.with_(*S.ALL, S.detected("low"), then="SELECT track_id, cue_id, word, start_idx, end_idx, type, CAST(confidence AS DOUBLE) AS confidence FROM kept_m"))
def _(spark, sf):
    return D.match_table(detected(spark, sf, "low")).drop("term", "context")


@case("detect_by_joins", S.with_(*S.ALL, S.detected(), then="SELECT track_id, cue_id, word, start_idx, end_idx, type, CAST(confidence AS DOUBLE) AS confidence FROM kept_m"))
def _(spark, sf):
    """The way taken for lexicons too large to be folded into the plan."""
    r = C.corpus_rules(spark)
    out = D.detect_by_joins(C.document_cues(spark, sf), r["lexicon"], r["patterns"], r["rules"], r["exempt"], "medium", True, None)
    return D.match_table(out).drop("term", "context")


@case("detect_fuzzy", S.with_(*S.ALL, FUZZY, S.detected(extra_tokens="UNION ALL SELECT * FROM fuzzy_m"), then="SELECT track_id, cue_id, word, start_idx, end_idx, type, CAST(confidence AS DOUBLE) AS confidence FROM kept_m"))
def _(spark, sf):
    return D.match_table(detected(spark, sf, fuzzy=0.25)).drop("term", "context")


@case("score_cues", S.with_(*S.ALL, S.detected(), then="SELECT track_id, cue_id, round(score, 3) AS score, n_matches, has_profanity FROM scored"))
def _(spark, sf):
    cues = C.document_cues(spark, sf)
    out = D.score_cues(cues, D.match_table(detected(spark, sf)))
    return out.select("track_id", "cue_id", F.round("score", 3).alias("score"), "n_matches", "has_profanity")


@case("scored_cues_high", S.with_(*S.ALL, S.detected("high"), then="SELECT track_id, cue_id, round(score, 3) AS score, has_profanity FROM scored"))
def _(spark, sf):
    return detected(spark, sf, "high").select("track_id", "cue_id", F.round("score", 3).alias("score"), "has_profanity")


@case("only_flagged", S.with_(*S.ALL, S.detected(), S.CENSORED, then=f"SELECT track_id, cue_id, {S.sanitize('censored_text')} AS shown_text FROM censored WHERE has_profanity"))
def _(spark, sf):
    from hushline.operators import interval as I

    return I.only_flagged(X.censor(detected(spark, sf))).select("track_id", "cue_id", "shown_text")


NEW_WORDS = [w for w in C.WORDS if w != "was"] + ["with", "onen"]
_redetected = S.with_(S.CUES, S.TOKENS, S.lexicon(NEW_WORDS + C.PHRASES), S.EXACT, S.PHRASES, S.PATTERNS, S.detected(), then="SELECT track_id, cue_id, n_matches, round(score, 3) AS score, has_profanity FROM scored")


@case("redetect", _redetected)
def _(spark, sf):
    r = C.corpus_rules(spark)
    new = L.build_lexicon(L.terms_df(spark, NEW_WORDS + C.PHRASES))
    again = lambda cues: D.detect_matches(cues, new, r["patterns"], r["rules"], r["exempt"])
    out = M.redetect(detected(spark, sf), r["lexicon"], new, again)
    return out.select("track_id", "cue_id", F.size("matches").cast("bigint").alias("n_matches"), F.round("score", 3).alias("score"), "has_profanity")


_redetected_fuzzy = S.with_(S.CUES, S.TOKENS, S.lexicon(NEW_WORDS + C.PHRASES), S.EXACT, S.PHRASES, S.PATTERNS, FUZZY, S.detected(extra_tokens="UNION ALL SELECT * FROM fuzzy_m"),
                            then="SELECT track_id, cue_id, n_matches, round(score, 3) AS score, has_profanity FROM scored")


@case("redetect_fuzzy", _redetected_fuzzy)
def _(spark, sf):
    r = C.corpus_rules(spark)
    new = L.build_lexicon(L.terms_df(spark, NEW_WORDS + C.PHRASES))
    # the words of the cues are gathered once for the three searches for close ones
    words = D.vocabulary(C.document_cues(spark, sf))
    again = lambda cues: D.detect_matches(cues, new, r["patterns"], r["rules"], r["exempt"], fuzzy_threshold=0.25, words=words)
    out = M.redetect(detected(spark, sf, fuzzy=0.25, words=words), r["lexicon"], new, again, fuzzy_threshold=0.25, words=words)
    return out.select("track_id", "cue_id", F.size("matches").cast("bigint").alias("n_matches"), F.round("score", 3).alias("score"), "has_profanity")


@case("detect_large_lexicon", S.with_(S.CUES, S.TOKENS, then=f"""SELECT track_id, cue_id, count(t.pos) AS n_matches FROM cues
LEFT JOIN (SELECT * FROM tokens WHERE length({S.norm('word')}) >= 7) t USING (track_id, cue_id) GROUP BY ALL"""))
def _(spark, sf):
    """A lexicon of all longer words of the table, tens of thousands, as a hash set in the plan."""
    words = C.table(spark, sf, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("term")).filter(F.length(T.normalize_text(F.col("term"))) >= 7)
    lex = L.build_lexicon(words.distinct().select("term", F.lit(0).alias("ord")))
    out = D.detect_matches(C.document_cues(spark, sf), lex, use_context=False)
    return out.select("track_id", "cue_id", F.size("matches").cast("bigint").alias("n_matches"))


@case("redetect_sensitivity", S.with_(*S.ALL, S.detected("high"), then="SELECT track_id, cue_id, round(score, 3) AS score, has_profanity FROM scored"))
def _(spark, sf):
    return M.reflag(detected(spark, sf), "high").select("track_id", "cue_id", F.round("score", 3).alias("score"), "has_profanity")


@case("detection_quality", S.with_(*S.ALL, S.detected(), then="""
SELECT language, tp, fp, fn, tn, round(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS "precision", round(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall,
 round(CASE WHEN fp + tn = 0 THEN NULL ELSE fp / CAST(fp + tn AS DOUBLE) END, 6) AS false_positive_rate FROM (
 SELECT language, count(*) FILTER (flag AND toxic = 1) AS tp, count(*) FILTER (flag AND toxic <> 1) AS fp, count(*) FILTER (NOT flag AND toxic = 1) AS fn, count(*) FILTER (NOT flag AND toxic <> 1) AS tn
 FROM (SELECT track_id, language, bool_or(has_profanity) AS flag FROM scored GROUP BY ALL) f JOIN labels l ON CAST(l.doc_id AS VARCHAR) = f.track_id GROUP BY language)"""))
def _(spark, sf):
    labels = C.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("track_id"), "toxic")
    return R.detection_quality(detected(spark, sf), labels)


# ------------------------------------------------------------------ reports


@case("profanity_summary", S.with_(*S.ALL, S.detected(), then="""
SELECT language, track_id, CAST(count(*) AS BIGINT) AS cues, CAST(count(*) FILTER (has_profanity) AS BIGINT) AS flagged, CAST(count(DISTINCT track_id) AS BIGINT) AS tracks,
 CAST(grouping(language) + grouping(track_id) AS INTEGER) AS level, round(count(*) FILTER (has_profanity) * 100.0 / count(*), 2) AS rate FROM scored GROUP BY ROLLUP (language, track_id)"""))
def _(spark, sf):
    return R.profanity_summary(detected(spark, sf)).withColumn("rate", F.col("rate").cast("double"))


@case("word_counts", S.with_(*S.ALL, S.detected(), then=f"SELECT c.source, {S.norm('word')} AS term, CAST(count(*) AS BIGINT) AS n FROM kept_m JOIN cues c USING (track_id, cue_id) GROUP BY ALL"))
def _(spark, sf):
    d = detected(spark, sf)
    rows = d.select("source", F.inline_outer("matches")).filter("word is not null")
    return R.word_counts(rows, ["source"])


@case("track_stats", S.with_(*S.ALL, S.detected(), S.SPACE_WORDS, S.TIMING, S.windows(), then="""
SELECT s.track_id, CAST(count(*) AS BIGINT) AS cues, CAST(count(*) FILTER (has_profanity) AS BIGINT) AS flagged, arg_max(end_ms, start_ms) AS duration_ms,
 CAST(coalesce(any_value(w.n), 0) AS BIGINT) AS windows FROM scored s LEFT JOIN (SELECT track_id, count(*) AS n FROM windows GROUP BY track_id) w USING (track_id) GROUP BY s.track_id"""))
def _(spark, sf):
    return R.track_stats(detected(spark, sf))


@case("speaking_rate", S.with_(S.CUES, S.SPACE_WORDS, then="""
SELECT track_id, round(CASE WHEN d = 0 OR s = 0 THEN 170.0 ELSE w / CAST(d AS DOUBLE) * 60000 END, 3) AS wpm, round(CASE WHEN d = 0 OR s = 0 THEN 175.0 ELSE d / CAST(s AS DOUBLE) END, 3) AS ms_per_syllable,
 round(CASE WHEN d = 0 OR s = 0 THEN 1.5 ELSE s / CAST(w AS DOUBLE) END, 3) AS syllables_per_word
 FROM (SELECT track_id, sum(wn) AS w, sum(sn) AS s, sum(end_ms - start_ms) AS d FROM (SELECT c.track_id, c.cue_id, c.start_ms, c.end_ms, count(word) AS wn, coalesce(sum(syl), 0) AS sn
  FROM cues c LEFT JOIN space_words USING (track_id, cue_id) GROUP BY ALL) GROUP BY track_id)"""))
def _(spark, sf):
    out = W.speaking_rate(C.document_cues(spark, sf))
    return out.select("track_id", *[F.round(c, 3).alias(c) for c in ("wpm", "ms_per_syllable", "syllables_per_word")])


@case("sample_flagged", S.with_(*S.ALL, S.detected(), then=f"""
SELECT track_id, cue_id, start_ms, "at", excerpt, rank FROM (SELECT track_id, cue_id, start_ms, {S.format_time('start_ms')} AS at, substring(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS excerpt,
 CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_ms, cue_id) AS INTEGER) AS rank FROM scored WHERE has_profanity) WHERE rank <= 3"""))
def _(spark, sf):
    return R.sample_flagged(detected(spark, sf), 3, per_track=True)


@case("sample_flagged_first", S.with_(*S.ALL, S.detected(), then=f"""
SELECT track_id, cue_id, start_ms, {S.format_time('start_ms')} AS at, substring(text, 1, 40) || CASE WHEN length(text) > 40 THEN '...' ELSE '' END AS excerpt FROM scored WHERE has_profanity ORDER BY track_id, start_ms, cue_id LIMIT 30"""))
def _(spark, sf):
    return R.sample_flagged(detected(spark, sf), 30, chars=40)


# ------------------------------------------------------------------ censoring


@case("censor", S.with_(*S.ALL, S.detected(), S.CENSORED, then="SELECT track_id, cue_id, has_profanity, censored_text FROM censored"))
def _(spark, sf):
    return X.censor(detected(spark, sf)).select("track_id", "cue_id", "has_profanity", "censored_text")


def _substitute_sql(category: str) -> str:
    wanted = category if category in fv.SUBSTITUTION_CATEGORIES else "silly"
    custom = {}
    for line in C.CUSTOM_LINES:
        if "=" in line:
            a, b = [p.strip() for p in line.split("=", 1)]
            if a and b:
                custom[a.lower()] = b
    lists = f"""lists AS (SELECT term, CASE WHEN len(max(options) FILTER (category = '{wanted}')) > 0 THEN max(options) FILTER (category = '{wanted}') ELSE max(options) FILTER (category = 'silly') END AS options
  FROM {S.values(C.SUBSTITUTIONS, 'term, category, options')} GROUP BY term)"""
    monkeys = "[" + ", ".join(S.q(m) for m in fv.MONKEYS) + "]"
    direct = f"CASE WHEN c.replacement IS NOT NULL THEN [c.replacement] ELSE {monkeys if category == 'monkeys' else 'l.options'} END"
    return S.with_(*S.ALL, S.detected(), lists, f"""
custom AS {S.values(list(custom.items()), 'term, replacement')},
roots AS {S.values([(r, i) for i, r in enumerate(C.ROOTS)], 'root, root_ord')},
norms AS (SELECT DISTINCT {S.norm('word')} AS n FROM kept_m),
direct AS (SELECT n, {direct} AS options, '' AS tail FROM norms LEFT JOIN custom c ON c.term = n LEFT JOIN lists l ON l.term = n),
viaroot AS (SELECT d.n, first(l.options ORDER BY root_ord) AS options, '-' || substring(d.n, length(first(root ORDER BY root_ord)) + 1) AS tail
  FROM direct d JOIN roots ON starts_with(d.n, root) AND d.n <> root JOIN lists l ON l.term = root WHERE d.options IS NULL AND len(l.options) > 0 GROUP BY d.n),
chosen AS (SELECT * FROM direct WHERE options IS NOT NULL UNION ALL SELECT * FROM viaroot),
put AS (SELECT k.track_id, k.cue_id, k.start_idx, k.end_idx, coalesce(options[('0x' || substring(md5('7|' || k.track_id || '|' || k.cue_id || '|' || k.start_idx), 1, 8))::BIGINT % len(options) + 1] || tail, '{fv.CENSOR_MARK}') AS put
  FROM kept_m k LEFT JOIN chosen ON chosen.n = {S.norm('k.word')}),
cut AS (SELECT *, coalesce(lag(end_idx) OVER (PARTITION BY track_id, cue_id ORDER BY start_idx), 0) AS prev FROM put),
parts AS (SELECT track_id, cue_id, string_agg(substring(text, prev + 1, start_idx - prev) || put, '' ORDER BY start_idx) AS head, max(end_idx) AS last FROM cut JOIN cues USING (track_id, cue_id) GROUP BY ALL)""",
                   then="SELECT s.track_id, s.cue_id, CASE WHEN p.head IS NULL THEN s.text ELSE p.head || substring(s.text, p.last + 1) END AS censored_text FROM scored s LEFT JOIN parts p USING (track_id, cue_id)")


def _substituted(spark, sf, category):
    subs = spark.createDataFrame(C.SUBSTITUTIONS, "term string, category string, options array<string>")
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(C.CUSTOM_LINES)], "line string, ord int")
    out = X.substitute(detected(spark, sf), subs, L.substitution_roots(spark, C.ROOTS), L.custom_substitutions(lines), category, seed="7")
    return out.select("track_id", "cue_id", "censored_text")


for _category in ("silly", "polite", "random", "monkeys"):
    CASES[f"substitute_{_category}"] = ((lambda c: lambda spark, sf: _substituted(spark, sf, c))(_category), _substitute_sql(_category))


@case("redetect_substitutions", _substitute_sql("polite"))
def _(spark, sf):
    """Cues stored with silly words get polite ones, without another detection."""
    from hushline.operators.ordered import materialize

    subs = spark.createDataFrame(C.SUBSTITUTIONS, "term string, category string, options array<string>")
    lines = spark.createDataFrame([(x, i) for i, x in enumerate(C.CUSTOM_LINES)], "line string, ord int")
    tables = subs, L.substitution_roots(spark, C.ROOTS), L.custom_substitutions(lines)
    stored = materialize(X.substitute(detected(spark, sf), *tables, "silly", seed="1"))
    return X.resubstitute(stored, *tables, "polite", seed="7").select("track_id", "cue_id", "censored_text")


@case("all_substitutions", f"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{S.TOKEN}'))) AS term FROM documents)
SELECT term, category, unnest(options) AS option FROM w JOIN {S.values(C.SUBSTITUTIONS, 'term, category, options')} s USING (term)""")
def _(spark, sf):
    subs = spark.createDataFrame(C.SUBSTITUTIONS, "term string, category string, options array<string>")
    words = C.table(spark, sf, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("term")).filter("term is not null")
    return X.all_substitutions(words, subs)


_DEFAULTS = [(t, c, options) for t, *lists in fv.ROOT_SUBSTITUTIONS for c, options in zip(fv.SUBSTITUTION_CATEGORIES, lists)]


@case("default_substitutions", f"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS term FROM documents UNION ALL SELECT term FROM {S.values(_DEFAULTS, 'term, category, options')} s)
SELECT term, category, unnest(options) AS option FROM (SELECT DISTINCT lower(term) AS term FROM w) JOIN {S.values(_DEFAULTS, 'term, category, options')} s USING (term)""")
def _(spark, sf):
    words = C.table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("term"))
    subs = L.root_substitutions(spark)
    return X.all_substitutions(words.union(subs.select("term")), subs)


@case("lexicon_diff", f"""WITH a AS (SELECT DISTINCT {S.norm('w')} AS t FROM (SELECT unnest(regexp_extract_all(text, '{S.TOKEN}')) AS w FROM documents)),
b AS (SELECT DISTINCT {S.norm('w')} AS t FROM (SELECT unnest(regexp_extract_all(text, '{S.TOKEN}')) AS w FROM conversations))
SELECT t AS norm_term, 'added' AS change FROM (SELECT t FROM b EXCEPT SELECT t FROM a) UNION ALL SELECT t, 'removed' FROM (SELECT t FROM a EXCEPT SELECT t FROM b)""")
def _(spark, sf):
    """Two lexicons read off the vocabularies of two tables."""
    vocab = lambda n: C.table(spark, sf, n).select(F.explode_outer(T.words(F.col("text"))).alias("w")).filter("w is not null").select(
        T.normalize_text(F.col("w")).alias("norm_term")).distinct()
    return L.lexicon_diff(vocab("documents"), vocab("conversations"))


# ------------------------------------------------------------------ timing


@case("word_timing", S.with_(*S.ALL, S.detected(), S.SPACE_WORDS, S.TIMING, then="SELECT track_id, cue_id, word, start_idx, syllables_before, word_syllables, round(ws, 3) AS word_start_ms, round(we, 3) AS word_end_ms FROM timing"))
def _(spark, sf):
    out = W.word_timing(detected(spark, sf))
    return out.select("track_id", "cue_id", "word", "start_idx", "syllables_before", "word_syllables", F.round("word_start_ms", 3).alias("word_start_ms"), F.round("word_end_ms", 3).alias("word_end_ms"))


_WINDOW_COLS = "track_id, cue_id, word, start_idx, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, buffer_before_ms, buffer_after_ms"


def _windows(spark, sf, sensitivity):
    out = W.mute_windows(detected(spark, sf, sensitivity), sensitivity)
    return out.select("track_id", "cue_id", "word", "start_idx", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "buffer_before_ms", "buffer_after_ms")


for _s in ("medium", "low"):
    CASES["mute_windows" if _s == "medium" else "mute_windows_low"] = (
        (lambda s: lambda spark, sf: _windows(spark, sf, s))(_s), S.with_(*S.ALL, S.detected(_s), S.SPACE_WORDS, S.TIMING, S.windows(_s), then=f"SELECT {_WINDOW_COLS} FROM windows"))


def islands_sql(source: str, early: int, late: int) -> str:
    return f"""
w AS (SELECT track_id, start_ms - {early} AS s, end_ms + {late} AS e FROM {source}),
i1 AS (SELECT *, max(e) OVER (PARTITION BY track_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w),
i2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i1),
islands AS (SELECT track_id, min(s) AS start_ms, max(e) AS end_ms, CAST(count(*) AS BIGINT) AS n FROM i2 GROUP BY track_id, island)"""


_W = [*S.ALL, S.detected(), S.SPACE_WORDS, S.TIMING, S.windows()]


@case("merge_windows", S.with_(*_W, islands_sql("windows", 0, 0), then="SELECT track_id, round(start_ms, 3) AS start_ms, round(end_ms, 3) AS end_ms, n FROM islands"))
def _(spark, sf):
    out = W.merge_windows(W.mute_windows(detected(spark, sf)))
    return out.select("track_id", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "n")


@case("muted_time", S.with_(*_W, islands_sql("windows", fv.MUTE_EARLY_MS, fv.MUTE_LATE_MS), then="SELECT track_id, round(sum(end_ms - start_ms), 3) AS muted_ms, CAST(count(*) AS BIGINT) AS n_mutes, CAST(sum(n) AS BIGINT) AS n_windows FROM islands GROUP BY track_id"))
def _(spark, sf):
    return W.muted_time(W.mute_windows(detected(spark, sf))).withColumn("muted_ms", F.round("muted_ms", 3))
