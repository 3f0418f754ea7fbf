"""Building blocks of the comparison SQL (DuckDB dialect).

Each block is a common table expression over the given tables.  They reach the
same results on another way: unnest, windows and plain range joins.
"""

from __future__ import annotations

from hushline.functions import fixed_values as fv, text as T
from hushline.plans import corpus as C

WS = T.WS
TOKEN = T.TOKEN.replace("'", "''")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        if isinstance(v, list):
            return "[" + ", ".join(one(x) for x in v) + "]::VARCHAR[]"
        return q(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS t({names}))"


def with_(*blocks: str, then: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(b.strip() for b in blocks) + "\n" + then


LINES = "lines AS (SELECT doc_id, lang, source, u.line AS text, u.ord AS ord FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, ord))"
KEPT = f"kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS cid, CAST(greatest(500, 60 * length(text)) AS BIGINT) AS dur FROM lines WHERE NOT regexp_full_match(text, '[{WS}]*'))"
CUES = LINES + ",\n" + KEPT + """,
cues AS (SELECT CAST(doc_id AS VARCHAR) AS track_id, CAST(cid AS INTEGER) AS cue_id,
  CAST(coalesce(sum(dur + 100) OVER (PARTITION BY doc_id ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms,
  CAST(coalesce(sum(dur + 100) OVER (PARTITION BY doc_id ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + dur AS BIGINT) AS end_ms,
  text, source, lang AS language FROM kept)"""


def norm(c: str) -> str:
    return f"translate(lower({c}), '{fv.LOOKALIKE_FROM}', '{fv.LOOKALIKE_TO}')"


TOKENS = f"""
pieces AS (SELECT track_id, cue_id, u.p, u.o FROM cues, unnest(regexp_extract_all(text, '{TOKEN}|[^0-9A-Za-z_]+')) WITH ORDINALITY AS u(p, o)),
placed AS (SELECT track_id, cue_id, p AS word, o, CAST(sum(length(p)) OVER (PARTITION BY track_id, cue_id ORDER BY o) - length(p) AS INTEGER) AS start_idx FROM pieces),
tokens AS (SELECT track_id, cue_id, CAST(row_number() OVER (PARTITION BY track_id, cue_id ORDER BY o) - 1 AS INTEGER) AS pos, word, start_idx,
  CAST(start_idx + length(word) AS INTEGER) AS end_idx FROM placed WHERE regexp_matches(word, '^[0-9A-Za-z_]'))"""


def lexicon(words: list[str], name: str = "lexicon") -> str:
    rows = [(t, i) for i, t in enumerate(words)]
    n = norm("term")
    return f"""{name} AS (SELECT first(term ORDER BY ord) AS term, n AS norm_term, CASE WHEN contains(n, ' ') THEN 'phrase' ELSE 'word' END AS kind, CAST(min(ord) AS INTEGER) AS ord
  FROM (SELECT term, ord, {n} AS n FROM {values(rows, 'term, ord')}) GROUP BY n)"""


LEXICON = lexicon(C.WORDS + C.PHRASES)


def context_of(start: str, end: str) -> str:
    return f"substring(text, greatest(0, {start} - 50) + 1, {end} + 50 - greatest(0, {start} - 50))"


EXACT = f"""
exact_m AS (SELECT t.track_id, t.cue_id, t.word, t.start_idx, t.end_idx, 'exact' AS type, CAST(100 AS DOUBLE) AS confidence, lower(t.word) AS term,
  {context_of('t.start_idx', 't.end_idx')} AS context
  FROM tokens t JOIN lexicon l ON l.kind = 'word' AND l.norm_term = {norm('t.word')} JOIN cues USING (track_id, cue_id))"""

_PIECE = f"[A-Za-z'']+|[{WS}\\-]+|[^A-Za-z''{WS}\\-]"
_RUN = "(PARTITION BY track_id, cue_id ORDER BY o)"
PHRASES = f"""
runs AS (SELECT track_id, cue_id, u.p, u.o FROM cues, unnest(regexp_extract_all(text, '{_PIECE}')) WITH ORDINALITY AS u(p, o)),
grams AS (SELECT track_id, cue_id, o, CASE WHEN regexp_full_match(p, '[{WS}\\-]+') THEN ' ' ELSE lower(p) END AS k, p,
  CAST(sum(length(p)) OVER {_RUN} - length(p) AS BIGINT) AS s FROM runs),
gram2 AS (SELECT *, lead(k, 1) OVER {_RUN} AS k1, lead(k, 2) OVER {_RUN} AS k2, lead(k, 3) OVER {_RUN} AS k3, lead(k, 4) OVER {_RUN} AS k4,
  lead(p, 1) OVER {_RUN} AS p1, lead(p, 2) OVER {_RUN} AS p2, lead(p, 3) OVER {_RUN} AS p3, lead(p, 4) OVER {_RUN} AS p4 FROM grams),
found AS (SELECT track_id, cue_id, s, k || k1 || k2 AS term, p || p1 || p2 AS word FROM gram2 WHERE k || k1 || k2 IN (SELECT norm_term FROM lexicon WHERE kind = 'phrase')
  UNION ALL SELECT track_id, cue_id, s, k || k1 || k2 || k3 || k4, p || p1 || p2 || p3 || p4 FROM gram2 WHERE k || k1 || k2 || k3 || k4 IN (SELECT norm_term FROM lexicon WHERE kind = 'phrase')),
phrase_m AS (SELECT track_id, cue_id, word, CAST(s AS INTEGER) AS start_idx, CAST(s + length(word) AS INTEGER) AS end_idx, 'exact' AS type, CAST(100 AS DOUBLE) AS confidence, term,
  {context_of('s', '(s + length(word))')} AS context FROM found JOIN cues USING (track_id, cue_id))"""


def patterns() -> str:
    from hushline.operators.lexicon import obfuscated_pattern

    parts = []
    for term, letters, ending in C.PATTERNS:
        p = q(f"(?i){obfuscated_pattern(letters, ending)}|(?s:.)")
        bare = q(f"(?i){obfuscated_pattern(letters, ending)}")
        parts.append(f"""SELECT track_id, cue_id, {q(term)} AS term, u.p AS word, u.o AS o, text FROM cues, unnest(regexp_extract_all(text, {p})) WITH ORDINALITY AS u(p, o)
  WHERE regexp_matches(text, {bare})""")
    return f"""
marks AS ({' UNION ALL '.join(parts)}),
spots AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY track_id, cue_id, term ORDER BY o) - length(word) AS INTEGER) AS start_idx FROM marks),
regex_m AS (SELECT track_id, cue_id, word, start_idx, CAST(start_idx + length(word) AS INTEGER) AS end_idx, 'regex' AS type, CAST(95 AS DOUBLE) AS confidence, term,
  {context_of('start_idx', '(start_idx + length(word))')} AS context FROM spots WHERE length(word) > 1)"""


PATTERNS = patterns()


def _context_test(kind: str, term: str = "term") -> str:
    tests = []
    for t, k, p, cs in C.CONTEXT:
        if k == kind:
            tests.append(f"({term} = {q(t)} AND regexp_matches(context, {q(('' if cs else '(?i)') + p)}))")
    return "(" + " OR ".join(tests) + ")"


ALLOWED = _context_test("allowed")
PROFANE = _context_test("profane")
RULED = "term IN (" + ", ".join(q(t) for t in sorted({r[0] for r in C.CONTEXT})) + ")"
TOKEN_CONFIDENCE = f"CASE WHEN NOT {RULED} THEN 100.0 WHEN {PROFANE} THEN 100.0 ELSE 75.0 END"
EXEMPT = f"{norm('term')} IN (" + ", ".join(q(t) for t in C.EXEMPT) + ")"


def detected(sensitivity: str = "medium", extra_tokens: str = "") -> str:
    """kept_m: all matches after exempt, context and overlap rules; scored: one row per cue."""
    drop = f"NOT {ALLOWED}" + (f" AND NOT {EXEMPT}" if sensitivity == "low" else "")
    at = fv.FLAG_AT[sensitivity]
    return f"""
p0 AS (SELECT *, row_number() OVER (PARTITION BY track_id, cue_id ORDER BY start_idx, end_idx DESC) AS rn FROM phrase_m WHERE {drop}),
chain AS (SELECT track_id, cue_id, rn, end_idx AS reach, TRUE AS keep FROM p0 WHERE rn = 1
  UNION ALL SELECT p.track_id, p.cue_id, p.rn, CASE WHEN p.start_idx >= c.reach THEN p.end_idx ELSE c.reach END, p.start_idx >= c.reach
  FROM chain c JOIN p0 p ON p.track_id = c.track_id AND p.cue_id = c.cue_id AND p.rn = c.rn + 1),
p1 AS (SELECT p0.* EXCLUDE (rn) FROM p0 JOIN chain USING (track_id, cue_id, rn) WHERE keep),
r1 AS (SELECT * FROM regex_m m WHERE {drop} AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.track_id = m.track_id AND p1.cue_id = m.cue_id AND p1.start_idx < m.end_idx AND m.start_idx < p1.end_idx)),
h1 AS (SELECT * FROM p1 UNION ALL SELECT * FROM r1),
t0 AS (SELECT track_id, cue_id, word, start_idx, end_idx, type, {TOKEN_CONFIDENCE} AS confidence, term, context FROM (SELECT * FROM exact_m {extra_tokens}) WHERE {drop}),
t1 AS (SELECT * FROM t0 m WHERE NOT EXISTS (SELECT 1 FROM h1 WHERE h1.track_id = m.track_id AND h1.cue_id = m.cue_id AND h1.start_idx < m.end_idx AND m.start_idx < h1.end_idx)),
kept_m AS (SELECT * FROM h1 UNION ALL SELECT * FROM t1),
per_cue AS (SELECT track_id, cue_id, least(100.0, avg(confidence)) AS score, count(*) AS n FROM kept_m GROUP BY ALL),
scored AS (SELECT c.*, coalesce(p.score, 0.0) AS score, coalesce(p.n, 0) AS n_matches, coalesce(p.n, 0) > 0 AND coalesce(p.score, 0.0) >= {at} AS has_profanity
  FROM cues c LEFT JOIN per_cue p USING (track_id, cue_id))"""


BASE = [CUES, TOKENS, LEXICON]
ALL = [CUES, TOKENS, LEXICON, EXACT, PHRASES, PATTERNS]


def syllables(w: str) -> str:
    letters = f"regexp_replace(lower({w}), '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({letters}, '[aeiouy]+'))"
    trimmed = f"regexp_replace({w}, '^[{WS}]+|[{WS}]+$', '', 'g')"
    return (f"CASE WHEN {w} IS NULL OR {w} = '' THEN 0 WHEN length({trimmed}) <= 2 THEN 1 WHEN {letters} = '' THEN 1 ELSE greatest(1, {groups} "
            f"- CASE WHEN {letters} LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches({letters}, '[^aeiouy]le$') THEN 1 ELSE 0 END) END")


SPACE_WORDS = f"""
sp AS (SELECT track_id, cue_id, u.p, u.o FROM cues, unnest(regexp_extract_all(text, '[^{WS}]+|[{WS}]+')) WITH ORDINALITY AS u(p, o)),
sp2 AS (SELECT track_id, cue_id, p, sum(length(p)) OVER (PARTITION BY track_id, cue_id ORDER BY o) - length(p) AS pos FROM sp),
space_words AS (SELECT track_id, cue_id, p AS word, pos, CAST({syllables('p')} AS INTEGER) AS syl FROM sp2 WHERE NOT regexp_full_match(p, '[{WS}]+'))"""

TIMING = f"""
totals AS (SELECT track_id, cue_id, sum(syl) AS total FROM space_words GROUP BY ALL),
befores AS (SELECT m.track_id, m.cue_id, m.start_idx, sum(CASE WHEN w.pos < m.start_idx THEN w.syl ELSE 0 END) AS before, bool_or(w.pos = m.start_idx) AS hit
  FROM kept_m m JOIN space_words w USING (track_id, cue_id) GROUP BY ALL),
timed AS (SELECT m.track_id, m.cue_id, m.word, m.start_idx, m.end_idx, c.start_ms AS cs, c.end_ms AS ce, length(c.text) AS tl, c.has_profanity,
  CAST(CASE WHEN b.hit THEN b.before ELSE t.total END AS INTEGER) AS syllables_before, CAST({syllables('m.word')} AS INTEGER) AS word_syllables, t.total
  FROM kept_m m JOIN befores b USING (track_id, cue_id, start_idx) JOIN totals t USING (track_id, cue_id) JOIN scored c USING (track_id, cue_id)),
timing AS (SELECT *, cs + syllables_before * ((ce - cs) / CAST(total AS DOUBLE)) AS ws, (cs + syllables_before * ((ce - cs) / CAST(total AS DOUBLE))) + word_syllables * ((ce - cs) / CAST(total AS DOUBLE)) AS we FROM timed)"""


def windows(sensitivity: str = "medium") -> str:
    b, a = fv.PADS[sensitivity]
    return f"""
ratio AS (SELECT *, start_idx / CAST(tl AS DOUBLE) AS r FROM timing WHERE has_profanity),
padded AS (SELECT *,
  {b} + CASE WHEN word_syllables <= 2 THEN 100 WHEN word_syllables > 3 THEN 150 ELSE 0 END
   + CASE WHEN r > 0.5::DOUBLE THEN floor(200 + 1200 * ((r - 0.5::DOUBLE) / 0.5::DOUBLE) * ((r - 0.5::DOUBLE) / 0.5::DOUBLE) + 0.5::DOUBLE)
          WHEN r > 0.3::DOUBLE THEN floor(150 * (r - 0.3::DOUBLE) / 0.2::DOUBLE + 0.5::DOUBLE) ELSE 0 END AS pb,
  {a} + CASE WHEN r > 0.7::DOUBLE THEN floor(300 + 500 * ((r - 0.7::DOUBLE) / 0.3::DOUBLE) * ((r - 0.7::DOUBLE) / 0.3::DOUBLE) + 0.5::DOUBLE)
          WHEN r > 0.5::DOUBLE THEN floor(200 * (r - 0.5::DOUBLE) / 0.2::DOUBLE + 0.5::DOUBLE) ELSE 0 END AS pa FROM ratio),
windows AS (SELECT track_id, cue_id, word, start_idx, greatest(CAST(cs AS DOUBLE), ws - pb) AS start_ms,
  CASE WHEN r > 0.75::DOUBLE THEN we + pa ELSE least(CAST(ce AS DOUBLE), we + pa) END AS end_ms, ws AS word_start_ms, we AS word_end_ms,
  CAST(pb AS INTEGER) AS buffer_before_ms, CAST(pa AS INTEGER) AS buffer_after_ms FROM padded)"""


HEARTBEATS = f"""
hb AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS track_id, ts, epoch_us(ts) // 1000 AS ts_ms,
  (epoch_us(ts) // 1000) % {C.TRACK_MS} AS position_ms, CASE WHEN event_type = 'view' THEN 2.0 ELSE 1.0 END AS rate, event_type = 'error' AS paused, event_type, value FROM events)"""

SANITIZE = "regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]*>?', '', 'g'), '\\{{\\\\[^}}]*\\}}', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{FFFD}}]', '', 'g')"


def sanitize(c: str) -> str:
    return SANITIZE.format(c=c)


CENSORED = f"""
cut AS (SELECT track_id, cue_id, start_idx, end_idx, coalesce(lag(end_idx) OVER (PARTITION BY track_id, cue_id ORDER BY start_idx), 0) AS prev FROM kept_m),
parts AS (SELECT track_id, cue_id, string_agg(substring(text, prev + 1, start_idx - prev) || '{fv.CENSOR_MARK}', '' ORDER BY start_idx) AS head, max(end_idx) AS last
  FROM cut JOIN cues USING (track_id, cue_id) GROUP BY ALL),
censored AS (SELECT s.*, CASE WHEN p.head IS NULL THEN s.text ELSE p.head || substring(s.text, p.last + 1) END AS censored_text FROM scored s LEFT JOIN parts p USING (track_id, cue_id))"""


def clean(c: str) -> str:
    d = c
    for _ in range(3):
        for name, ch in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("nbsp", " "), ("amp", "&")]:
            d = f"regexp_replace({d}, '(?i)&{name};', '{ch}', 'g')"
    d = f"regexp_replace(regexp_replace({d}, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>', '', 'g'), '<[^>]*>', '', 'g')"
    return f"regexp_replace(regexp_replace({d}, '[{WS}]+', ' ', 'g'), '^ | $', '', 'g')"


def format_time(ms: str) -> str:
    t = f"CAST(floor({ms} / 1000) AS BIGINT)"
    return (f"CASE WHEN {t} >= 3600 THEN ({t} // 3600) || ':' || lpad(CAST(({t} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0') "
            f"ELSE (({t} % 3600) // 60) || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0') END")
