"""Queries over languages, URLs, tracks, discovery and file ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushline.functions import fixed_values as fv, language as G, text as T, urls as U
from hushline.operators import merge as M, report as R, tracks as K
from hushline.plans import corpus as C, reference_sql as S, renderings as N
from hushline.sources import discovery as D, subtitle_files as I, writers as W

CASES: dict[str, tuple] = {}


def case(name: str, sql: str | None = None):
    def add(fn):
        CASES[name] = (fn, sql)
        return fn

    return add


_TAILS = ", ".join(f"base || {S.q(t)}" for t in C.REQUEST_TAILS)
REQUESTS = f"""
reqs AS (SELECT page_id, u.url, CAST(u.o - 1 AS INTEGER) AS form, CASE (u.o - 1) % 4 WHEN 0 THEN 'text/vtt; charset=utf-8' WHEN 1 THEN 'application/x-subrip' WHEN 2 THEN '' END AS content_type
  FROM (SELECT page_id, url, regexp_replace(url, '[?#].*', '') AS base FROM pages) p, unnest([{_TAILS}, regexp_replace(p.url, '^https?:', 'ftp:'), 'javascript:' || p.url, p.url, base || '/' || md5(p.url) || '.vtt', regexp_replace(p.url, '^https?://[^/]*', '')]) WITH ORDINALITY AS u(url, o)),
parts AS (SELECT *, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AS ok, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM reqs)"""
_KEY = "regexp_matches(query, '(?:^|&)(?:subtitle|subs|captions)(?:=|&|$)')"


@case("url_predicates", S.with_(REQUESTS, then=f"""
SELECT page_id, form, ok AND NOT regexp_matches(lower(path), '\\.(otf|ttf|woff|woff2|eot|mjs|cjs|m3u8)$') AND (regexp_matches(lower(path), '\\.(vtt|srt|ass|ssa|sub)$') OR {_KEY} OR regexp_matches(url, '(?i)/subtitles?/|/subs?/|/cc/|\\.(vtt|srt|ass|ssa)$|manifest=.*\\.vtt')) AS is_subtitle_url,
 url <> '' AND NOT regexp_matches(lower(url), '\\.(otf|ttf|woff|woff2|eot)$') AND (regexp_matches(lower(url), '\\.(vtt|srt|ass|ssa|sub|m3u8)') OR (ok AND {_KEY})) AS is_valid_track_url,
 regexp_matches(url, '(?i)\\.(vtt|srt|ass|ssa)(\\?|$)') AS is_direct_subtitle, ok AND scheme IN ('http', 'https') AS is_fetchable_url,
 ok AND (regexp_matches(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '/watch\\?|/embed/|/v/') OR regexp_matches(url, '(?i)^https?://(www\\.)?youtu\\.be/')) AS is_video_page FROM parts"""))
def _(spark, sf):
    u = F.col("url")
    return C.request_log(spark, sf).select(
        "page_id", "form", U.is_subtitle_url(u).alias("is_subtitle_url"), U.is_valid_track_url(u).alias("is_valid_track_url"),
        U.is_direct_subtitle(u).alias("is_direct_subtitle"), U.is_fetchable_url(u).alias("is_fetchable_url"), U.is_video_page(u).alias("is_video_page"))


def _url_language_sql(wide: bool) -> str:
    ps = G.URL_LANGUAGE_WIDE if wide else G.URL_LANGUAGE
    tests = ", ".join(f"lower(nullif(regexp_extract(url, {S.q('(?i)' + p)}, 1), ''))" for p in ps)
    return f"coalesce({tests}, 'unknown')"


@case("url_fields", S.with_(REQUESTS, then=f"""
SELECT page_id, form, {_url_language_sql(False)} AS language, {_url_language_sql(True)} AS language_wide,
 CASE WHEN content_type LIKE '%vtt%' THEN 'vtt' WHEN content_type LIKE '%subrip%' OR content_type LIKE '%srt%' THEN 'srt' WHEN lower(url) LIKE '%.vtt%' THEN 'vtt' WHEN lower(url) LIKE '%.ass%' OR lower(url) LIKE '%.ssa%' THEN 'ass' WHEN lower(url) LIKE '%.srt%' THEN 'srt' ELSE 'unknown' END AS format,
 coalesce(coalesce(nullif(regexp_extract(url, '(?i)mtp%3D(\\d+)', 1), ''), nullif(regexp_extract(url, '(?i)mtp%3A(\\d+)', 1), ''), nullif(regexp_extract(url, '(?i)[&?]mtp=(\\d+)', 1), ''))::DOUBLE / 1000, 0.0) AS position_s,
 coalesce(nullif(regexp_extract(path, '(?i)/watch/movie/(\\d+)', 1), ''), nullif(regexp_extract(path, '(?i)/watch/tv/(\\d+)', 1), '')) AS tmdb_id, CASE WHEN path LIKE '%/movie/%' THEN 'movie' WHEN path LIKE '%/tv/%' THEN 'tv' END AS content_type,
 nullif(regexp_extract(url, '[?&]server=([^&#]*)', 1), '') AS server, nullif(regexp_extract(url, '[?&]v=([^&#]*)', 1), '') AS video_id, coalesce(nullif(regexp_extract(url, '[?&]lang=([^&#]*)', 1), ''), 'unknown') AS caption_language,
 coalesce(regexp_extract(url, '[?&]kind=([^&#]*)', 1) = 'asr', FALSE) AS is_asr FROM parts"""))
def _(spark, sf):
    rows = C.request_log(spark, sf)
    rows = rows.select("page_id", "form", "url", G.url_language(F.col("url")).alias("language"), G.url_language(F.col("url"), wide=True).alias("language_wide"),
                       U.url_format(F.col("url"), F.col("content_type")).alias("format"), U.stream_position(F.col("url")).alias("position_s"))
    return U.content_ids(rows).drop("url")


_SITES = [("english", r"/en/"), ("blogs", r"^blog\."), ("mobile", r"^m\."), ("com", r"\.com$"), ("blogs", r"^www\.blog"), ("french", r"/fr/\d+")]
_SERVERS = [("one", r"/en/1"), ("vidrock", r"vidrock"), ("two", r"/2\d*"), ("en", r"/en/")]


def _site_tests():
    order = list(dict.fromkeys(s for s, _ in _SITES))
    return [(s, "(" + " OR ".join(f"regexp_matches(host, {S.q('(?i)' + p)}) OR regexp_matches(url, {S.q('(?i)' + p)})" for t, p in _SITES if t == s) + ")") for s in order]


@case("site_name", S.with_(REQUESTS, then=f"SELECT page_id, form, CASE WHEN NOT ok THEN NULL {' '.join(f'WHEN {t} THEN {S.q(s)}' for s, t in _site_tests())} END AS site FROM parts"))
def _(spark, sf):
    return U.site_names(C.request_log(spark, sf), U.site_patterns(spark, _SITES)).select("page_id", "form", "site")


@case("all_sites", S.with_(REQUESTS, then=" UNION ALL ".join(f"SELECT page_id, form, {S.q(s)} AS site FROM parts WHERE ok AND {t}" for s, t in _site_tests())))
def _(spark, sf):
    return U.site_names(C.request_log(spark, sf), U.site_patterns(spark, _SITES), every=True).select("page_id", "form", "site")


_NAMED = "nullif(regexp_extract(url, '[?&]server=([^&#]*)', 1), '')"


@case("video_server", S.with_(REQUESTS, then=f"""SELECT page_id, form, CASE WHEN {_NAMED} IN ({', '.join(S.q(s) for s, _ in _SERVERS)}) THEN {_NAMED}
 {' '.join(f"WHEN regexp_matches(url, {S.q('(?i)' + p)}) THEN {S.q(s)}" for s, p in _SERVERS)} END AS video_server FROM parts"""))
def _(spark, sf):
    return U.video_server(C.request_log(spark, sf), U.video_servers(spark, _SERVERS)).select("page_id", "form", "video_server")


_KNOWN = ", ".join(S.q(c) for c, _ in fv.pairs_of(fv.LANGUAGE_ALIASES))
_ALIASES = S.values([(a, c) for c, names in fv.pairs_of(fv.LANGUAGE_ALIASES) for a in fv.words_of(names)], "alias, code")
_NAMES = S.values(fv.pairs_of(fv.LANGUAGE_NAMES), "code, name")


@case("language_columns", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{S.TOKEN}')) AS w FROM documents), l AS (SELECT w, lower(w) AS low FROM w)
SELECT w AS word, CASE WHEN substring(low, 1, 2) IN ({_KNOWN}) THEN substring(low, 1, 2) ELSE coalesce(a.code, substring(low, 1, 2)) END AS code,
 coalesce(n5.name, n2.name, upper(w)) AS name, substring(low, 1, 2) = 'en' AS fits FROM l LEFT JOIN {_ALIASES} a ON a.alias = low LEFT JOIN {_NAMES} n5 ON n5.code = substring(low, 1, 5) LEFT JOIN {_NAMES} n2 ON n2.code = substring(low, 1, 2)""")
def _(spark, sf):
    """Every distinct word of the texts read as a language code."""
    words = C.table(spark, sf, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("word")).filter("word is not null").distinct()
    w = F.col("word")
    return words.select("word", G.language_code(w).alias("code"), G.language_name(w).alias("name"), G.language_matches(w, F.lit("en-GB")).alias("fits"))


_FORMS = ["_en.srt", "-fr_sdh.vtt", ".txt", "/a_b-c.hearing.DE.ass"]


@case("upload_track", f"""SELECT page_id, form, lower(regexp_extract(f, '(?i)[.\\-_](en|es|fr|de|pt|it|ja|ko|zh|ar|ru)[.\\-_]', 1)) AS language,
 CASE WHEN lower(regexp_extract(f, '([^.]*)$', 1)) IN ('srt', 'vtt', 'ass') THEN lower(regexp_extract(f, '([^.]*)$', 1)) ELSE 'unknown' END AS format,
 CASE WHEN regexp_matches(f, '(?i)[.\\-_](en|es|fr|de|pt|it|ja|ko|zh|ar|ru)[.\\-_]') THEN upper(regexp_extract(f, '(?i)[.\\-_](en|es|fr|de|pt|it|ja|ko|zh|ar|ru)[.\\-_]', 1)) || ' - ' || f ELSE f END AS label, regexp_matches(f, '(?i)sdh|cc|hearing') AS is_sdh,
 trim(regexp_replace(regexp_replace(regexp_extract(f, '([^/]*)$', 1), '\\.[^.]*$', ''), '[_\\-+]+', ' ', 'g')) AS file_label
 FROM (SELECT page_id, u.o - 1 AS form, regexp_extract(url, '^https?://([^/?#]*)', 1) || u.t AS f FROM pages, unnest([{', '.join(S.q(x) for x in _FORMS)}]) WITH ORDINALITY AS u(t, o))""")
def _(spark, sf):
    pages = C.table(spark, sf, "pages")
    rows = pages.select("page_id", F.posexplode(F.array(*[F.concat(F.regexp_extract("url", r"^https?://([^/?#]*)", 1), F.lit(x)) for x in _FORMS])).alias("form", "filename"))
    return K.upload_track(rows).select("page_id", "form", "language", "format", "label", "is_sdh", U.file_label(F.col("filename")).alias("file_label"))


def _code_sql(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN '' ELSE substring(lower({c}), 1, 2) END"


_SDH = "regexp_matches(lower(label), '\\bsdh\\b|\\bcc\\b|\\bclosed.?captions?\\b|\\bhearing.?impaired\\b|\\bdeaf\\b|\\bhi\\b')"
_FORCED = "regexp_matches(lower(label), '\\bforced\\b|\\bforeign.?only\\b|\\bnarrative\\b')"
TRACKS = f"""
tr0 AS (SELECT page_id AS ord, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS title, 't' || (page_id % 97) AS id, [{', '.join(S.q(x) for x in C.TRACK_LABELS)}][page_id % {len(C.TRACK_LABELS)} + 1] AS label,
  regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) || CASE WHEN page_id % 5 = 0 THEN '-XX' ELSE '' END AS language, page_id % 4 = 0 AS is_default, CASE WHEN page_id % 6 <> 0 THEN url END AS url, page_id % 3 = 0 AS embedded,
  CASE WHEN page_id % 11 = 0 THEN 'user' WHEN page_id % 3 = 0 THEN 'video' ELSE 'network' END AS source FROM pages),
tr AS (SELECT *, {_SDH} AS is_sdh, {_FORCED} AS is_forced, CASE WHEN {_code_sql('language')} = 'fr' THEN 10 WHEN {_code_sql('language')} = 'en' THEN 5 ELSE 0 END + CASE WHEN {_SDH} THEN 3 ELSE 0 END
  - CASE WHEN {_FORCED} THEN 5 ELSE 0 END + CASE WHEN is_default THEN 2 ELSE 0 END + CASE WHEN source = 'user' THEN 15 ELSE 0 END AS score FROM tr0)"""


def scored_tracks(spark, sf):
    return K.track_scores(C.track_rows(spark, sf), "fr-FR", True)


@case("track_scores", S.with_(TRACKS, then="SELECT ord, is_sdh, is_forced, CAST(score AS INTEGER) AS recommend_score, label || CASE WHEN is_sdh THEN ' ★' ELSE '' END || CASE source WHEN 'network' THEN ' (detected)' WHEN 'user' THEN ' (uploaded)' ELSE '' END AS shown FROM tr"))
def _(spark, sf):
    return scored_tracks(spark, sf).select("ord", "is_sdh", K.is_forced(F.col("label")).alias("is_forced"), "recommend_score", K.track_label(F.col("label"), F.col("is_sdh"), F.col("source")).alias("shown"))


@case("ranked_tracks", S.with_(TRACKS, then="SELECT title, ord, CAST(score AS INTEGER) AS recommend_score, CAST(row_number() OVER (PARTITION BY title ORDER BY score DESC, ord) AS BIGINT) AS rank FROM tr"))
def _(spark, sf):
    return K.ranked_tracks(scored_tracks(spark, sf), ["title"], chunk=50).select("title", "ord", "recommend_score", F.col("rank").cast("bigint").alias("rank"))


@case("best_track", S.with_(TRACKS, then="SELECT title, ord, n - 1 AS n_alternatives, score >= 0 AND source <> 'user' AS auto_selected FROM (SELECT *, count(*) OVER (PARTITION BY title) AS n, row_number() OVER (PARTITION BY title ORDER BY score DESC, ord) AS rn FROM tr) WHERE rn = 1"))
def _(spark, sf):
    return K.best_track(scored_tracks(spark, sf), ["title"]).select("title", "ord", "n_alternatives", "auto_selected")


@case("dedupe_tracks", S.with_(TRACKS, then=f"SELECT title, ord, id FROM (SELECT *, row_number() OVER (PARTITION BY title, {_code_sql('language')}, is_sdh ORDER BY score DESC, embedded DESC, CASE WHEN embedded THEN -ord ELSE ord END) AS rn FROM tr) WHERE rn = 1"))
def _(spark, sf):
    return K.dedupe_tracks(scored_tracks(spark, sf), ["title"]).select("title", "ord", "id")


@case("number_labels", S.with_(TRACKS, then="""SELECT ord, CASE WHEN count(*) OVER (PARTITION BY title, lower(language)) = 1 THEN label ELSE label || ' ' || row_number() OVER (PARTITION BY title, lower(language), label ORDER BY ord) END AS numbered_label FROM tr"""))
def _(spark, sf):
    return R.number_labels(C.track_rows(spark, sf), chunk=100).select("ord", "numbered_label")


@case("new_tracks_only", S.with_(TRACKS, then="SELECT ord FROM tr t WHERE NOT embedded AND NOT EXISTS (SELECT 1 FROM tr k WHERE k.embedded AND (k.url = t.url OR k.id = t.id))"))
def _(spark, sf):
    tracks = C.track_rows(spark, sf)
    return M.new_tracks_only(tracks.filter("embedded"), tracks.filter("not embedded")).select("ord")


@case("all_tracks", S.with_(TRACKS, then="""SELECT coalesce(url, id) AS k, arg_min(ord, CASE source WHEN 'video' THEN 0 WHEN 'network' THEN 1 ELSE 2 END * 1000000000 + ord) AS ord,
 arg_min(label, CASE source WHEN 'video' THEN 0 WHEN 'network' THEN 1 ELSE 2 END * 1000000000 + ord) AS label, arg_min(source, CASE source WHEN 'video' THEN 0 WHEN 'network' THEN 1 ELSE 2 END * 1000000000 + ord) AS source FROM tr GROUP BY 1"""))
def _(spark, sf):
    t = C.track_rows(spark, sf)
    return K.all_tracks(*[t.filter(F.col("source") == s) for s in ("video", "network", "user")]).select(F.coalesce("url", "id").alias("k"), "ord", "label", "source")


@case("to_tracks", S.with_(TRACKS, then="""
SELECT ord, 'video' AS origin, id, CASE WHEN label = 'Plain' THEN coalesce(nullif(language, ''), 'Unknown') ELSE label END AS shown, TRUE AS embedded, 0 AS recommend_score FROM tr
UNION ALL SELECT ord, 'network', 'network-' || url, CASE WHEN label = 'Plain' THEN coalesce(nullif(language, ''), 'Subtitle (VTT)') ELSE label END, FALSE, 0 FROM tr WHERE url IS NOT NULL
UNION ALL SELECT ord, 'api', id, CASE WHEN label = 'Plain' THEN coalesce(nullif(language, ''), 'Detected') ELSE label END, FALSE, 5 FROM tr"""))
def _(spark, sf):
    rows = C.track_rows(spark, sf).select("ord", "id", F.when(F.col("label") != "Plain", F.col("label")).otherwise("").alias("label"), "language", "url", F.lit("vtt").alias("format"))
    pick = lambda df, o: K.to_tracks(df, o).select("ord", F.lit(o).alias("origin"), "id", F.col("label").alias("shown"), "embedded", "recommend_score")
    return pick(rows, "video").unionByName(pick(rows.filter("url is not null"), "network")).unionByName(pick(rows, "api"))


@case("main_video", """SELECT page_id, video_id, duration_s FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(duration_s, 0) DESC, video_id) AS rn FROM (
 SELECT user_id AS page_id, event_id AS video_id, CASE WHEN event_id % 7 <> 0 THEN floor(value * 10) END AS duration_s, event_type <> 'error' AS connected, event_id % 3 AS ready_state FROM events)
 WHERE connected AND (coalesce(duration_s > 30, FALSE) OR ready_state >= 1)) WHERE rn = 1""")
def _(spark, sf):
    ev = C.table(spark, sf, "events")
    videos = ev.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("video_id"), F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") * 10).cast("double")).alias("duration_s"),
                       (F.col("event_type") != "error").alias("connected"), (F.col("event_id") % 3).alias("ready_state"))
    return R.main_video(videos)


@case("session_status", """SELECT user_id AS tab_id, bool_or(event_type = 'view') AS has_video, bool_or(event_type = 'click') AS active, max(event_id % 977) AS cue_count, max(event_id % 31) AS profanity_count,
 arg_min(CASE WHEN event_id % 4 = 1 THEN event_type END, CASE WHEN event_id % 4 = 1 THEN event_id END) AS current_track, count(DISTINCT CASE WHEN event_id % 4 = 1 THEN event_type END) AS n_tracks,
 coalesce(array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_id % 4 = 1)), ','), '') AS tracks, bool_or(event_type = 'purchase' AND value > 15) AS user_upload FROM events GROUP BY user_id""")
def _(spark, sf):
    ev = C.table(spark, sf, "events")
    t = F.col("event_type")
    frames = ev.select(F.col("user_id").alias("tab_id"), F.col("event_id").alias("frame_id"), (t == "view").alias("has_video"), (t == "click").alias("active"), (F.col("event_id") % 977).alias("cue_count"),
                       (F.col("event_id") % 31).alias("profanity_count"), F.when(F.col("event_id") % 4 == 1, t).alias("track"), ((t == "purchase") & (F.col("value") > 15)).alias("user_upload"))
    return R.session_status(frames).withColumn("tracks", F.array_join("tracks", ","))


# ------------------------------------------------------------------ discovery

_LINK = r'/[^".,&;]*'


@case("page_links", f"""SELECT DISTINCT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || link AS track_url FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="({_LINK})"', 1)) AS link FROM pages)""")
def _(spark, sf):
    return D.page_links(C.table(spark, sf, "pages"), _LINK)


def page_markup(spark, sf):
    """Pages with track elements and script fields written from their own url and number."""
    p = C.table(spark, sf, "pages").select("page_id", "url", "html")
    n = F.col("page_id").cast("string")
    block = F.concat(
        F.lit('<video><track kind="subtitles" src="/t/'), n, F.lit('.vtt" srclang="fr" label="L'), n, F.lit('" default><track kind="metadata" src="x.vtt">'),
        F.lit("<track kind='captions' src='c"), n, F.lit(".srt'></video><script>var p={\"language\": \"es\", \"file\": \"//cdn.test/"), n, F.lit('.ass"};q={"url":"/t/'), n, F.lit('.vtt"}</script>'))
    return p.withColumn("html", F.concat("html", block))


@case("page_tracks", """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract(url, '^(https?):', 1) AS s, regexp_extract(url, '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1) AS f FROM pages)
SELECT page_id, o || '/t/' || page_id || '.vtt' AS track_url, 'fr' AS language, 'L' || page_id AS label, TRUE AS is_default, 'element' AS origin FROM p
UNION ALL SELECT page_id, CASE WHEN f LIKE '%/' THEN f ELSE f || '/' END || 'c' || page_id || '.srt', 'unknown', 'Unknown', FALSE, 'element' FROM p
UNION ALL SELECT page_id, s || '://cdn.test/' || page_id || '.ass', 'es', 'es', FALSE, 'script' FROM p""")
def _(spark, sf):
    return D.page_tracks(page_markup(spark, sf))


def manifests(spark, sf):
    """Playlists written from the pages: tags, comments and URLs in several orders."""
    p = C.table(spark, sf, "pages").select(F.regexp_replace("url", r"[?#].*", "").alias("manifest_url"), F.col("page_id").cast("string").alias("n")).dropDuplicates(["manifest_url"])
    text = F.concat(
        F.lit('#EXTM3U\n#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="g0",LANGUAGE="XX",NAME="Old"\n#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="g1",LANGUAGE="FR",NAME="N1"\n# note\n\n'),
        F.lit("subs/a.m3u8\nvideo/webvtt/1.ts\n"), F.lit('#EXT-X-MEDIA:TYPE=SUBTITLES,NAME="No language"\n  https://cdn.test/b.vtt  \n#EXT-X-MEDIA:TYPE=AUDIO,LANGUAGE="de"\n/c.vtt\n../up/d.vtt\n'),
        F.lit('#EXT-X-MEDIA:TYPE=SUBTITLES,LANGUAGE="es"\n'))
    return p.select("manifest_url", text.alias("content"))


_FOLDER = "CASE WHEN f LIKE '%/' THEN f ELSE f || '/' END"
_MANIFESTS = "m AS (SELECT DISTINCT regexp_replace(url, '[?#].*', '') AS manifest_url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o, regexp_extract(regexp_replace(url, '[?#].*', ''), '^(https?://[^/?#]+(?:/[^?#]*/|/)?)', 1) AS f FROM pages)"


@case("manifest_tracks", S.with_(_MANIFESTS, then=f"""SELECT manifest_url, {_FOLDER} || 'subs/a.m3u8' AS url, 'fr' AS language, 'N1' AS label, 'g1' AS group_id FROM m
UNION ALL SELECT manifest_url, 'https://cdn.test/b.vtt', 'unknown', 'No language', NULL FROM m"""))
def _(spark, sf):
    return D.manifest_tracks(manifests(spark, sf)).drop("ord")


@case("manifest_tracks_known", S.with_(_MANIFESTS, then=f"SELECT manifest_url, {_FOLDER} || 'subs/a.m3u8' AS url, 'fr' AS language FROM m"))
def _(spark, sf):
    return D.manifest_tracks(manifests(spark, sf), need_language=True).select("manifest_url", "url", "language")


@case("manifest_segments", S.with_(_MANIFESTS, then=f"SELECT manifest_url, CAST(0 AS INTEGER) AS ord, {_FOLDER} || 'video/webvtt/1.ts' AS url FROM m UNION ALL SELECT manifest_url, 1, 'https://cdn.test/b.vtt' FROM m UNION ALL SELECT manifest_url, 2, o || '/c.vtt' FROM m"))
def _(spark, sf):
    return D.manifest_segments(manifests(spark, sf), n=3)


def responses(spark, sf):
    """API payloads written from the pages, of two sites in turn."""
    p = C.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("o"))
    n = F.col("page_id").cast("string")
    first = F.concat(F.lit('{"subtitles":[{"file":"/s/'), n, F.lit('.vtt","language":"de","label":"D"},{"url":"u'), n, F.lit('.srt","lang":"it","name":""},{"label":"no url"}]}'))
    second = F.concat(F.lit('{"MediaStreams":[{"Type":"Audio","Path":"a"},{"Type":"Subtitle","DeliveryUrl":"/d/'), n, F.lit('.vtt","Language":"en","Index":4},{"Type":"Subtitle","Path":"p.srt","DisplayTitle":"T","Index":5}]}'))
    even = F.col("page_id") % 2 == 0
    return p.select(F.concat("o", F.when(even, F.lit("/api/x/")).otherwise(F.lit("/Items/PlaybackInfo/")), n).alias("url"), F.when(even, first).otherwise(second).alias("body"),
                    F.when(even, "lookmovie").otherwise("jellyfin").alias("site"))


@case("api_tracks", """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS o FROM pages)
SELECT o || '/api/x/' || page_id AS request_url, CAST(0 AS INTEGER) AS ord, '/s/' || page_id || '.vtt' AS url, 'de' AS language, 'D' AS label, 'lookmovie' AS site FROM p WHERE page_id % 2 = 0
UNION ALL SELECT o || '/api/x/' || page_id, 1, 'u' || page_id || '.srt', 'it', 'English', 'lookmovie' FROM p WHERE page_id % 2 = 0
UNION ALL SELECT o || '/Items/PlaybackInfo/' || page_id, 1, o || '/d/' || page_id || '.vtt', 'en', 'Track 4', 'jellyfin' FROM p WHERE page_id % 2 = 1
UNION ALL SELECT o || '/Items/PlaybackInfo/' || page_id, 2, o || '/p.srt', 'unknown', 'T', 'jellyfin' FROM p WHERE page_id % 2 = 1""")
def _(spark, sf):
    return D.api_tracks(responses(spark, sf))


@case("nested_track_urls", """SELECT page_id AS payload_id, '$' AS at, 'file' AS key, 'a' || page_id || '_es.vtt' AS url, 'es' AS language, 'Top' AS label FROM pages
UNION ALL SELECT page_id, '$.tracks[1]', 'src', 'b' || page_id || '.SRT', 'fr', 'Detected' FROM pages UNION ALL SELECT page_id, '$.tracks[1].captions', 'link', '/c.ass', 'unknown', 'N' FROM pages""")
def _(spark, sf):
    p = C.table(spark, sf, "pages")
    n = F.col("page_id").cast("string")
    body = F.concat(F.lit('{"file":"a'), n, F.lit('_es.vtt","label":"Top","other":{"url":"hidden.vtt"},"tracks":[{"src":"x.mjs"},{"src":"b'), n,
                    F.lit('.SRT","lang":"fr","captions":{"link":"/c.ass","name":"N","path":"m.vtt.mjs"}},7]}'))
    return D.nested_track_urls(p.select(F.col("page_id").alias("payload_id"), body.alias("body")), exclude=[r"\.mjs$"])


@case("caption_tracks", """SELECT page_id AS player_id, CAST(0 AS INTEGER) AS ord, 'https://t.test/' || page_id || '?v=1&fmt=vtt' AS url, 'en' AS language, 'English (Auto)' AS label, TRUE AS is_asr FROM pages
UNION ALL SELECT page_id, 1, 'https://t.test/q?fmt=vtt&a=1', 'de', 'Deutsch', FALSE FROM pages UNION ALL SELECT page_id, 2, 'https://t.test/r?fmt=vtt', 'fr', 'French', FALSE FROM pages""")
def _(spark, sf):
    p = C.table(spark, sf, "pages")
    body = F.concat(F.lit('{"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"baseUrl":"https://t.test/'), F.col("page_id").cast("string"),
                    F.lit('?v=1","languageCode":"en","kind":"asr","name":{"simpleText":"English"}},{"url":"https://t.test/q?fmt=srv3&a=1","lang":"de","name":{"runs":[{"text":"Deutsch"}]}},{"baseUrl":"https://t.test/r","languageCode":"fr"},{"lang":"x"}]}}}'))
    return D.caption_tracks(p.select(F.col("page_id").alias("player_id"), body.alias("body")))


# ------------------------------------------------------------------ files

_FMT = "['srt', 'vtt', 'ass', 'xml', 'json3', 'jellyfin'][CAST(track_id AS BIGINT) % 6 + 1]"
_ROUND = "CASE WHEN f = 'ass' THEN {c} // 10 * 10 ELSE {c} END"
# lines with a clock in them or braces of override tags read differently per format
_FILE_CUES = f"""
fc AS (SELECT *, {_FMT} AS f, {S.clean('text')} AS cleaned FROM cues)"""


def _ingested(columns: str) -> str:
    return S.with_(S.CUES, _FILE_CUES, then=f"SELECT track_id || '.' || f AS track_id, cue_id, {_ROUND.format(c='start_ms')} AS start_ms, {_ROUND.format(c='end_ms')} AS end_ms, {columns} FROM fc")


def _clean_files(spark, sf):
    return N.document_files(spark, sf)


@case("ingest_cues", _ingested("cleaned AS text, f AS format"))
def _(spark, sf):
    return I.ingest_cues(_clean_files(spark, sf)).drop("source")


@case("detect_format", S.with_(S.CUES, _FILE_CUES, then="SELECT DISTINCT track_id || '.' || f AS path, f AS format FROM fc"))
def _(spark, sf):
    return _clean_files(spark, sf).select("path", I.detect_format(F.col("content")).alias("format"))


@case("ingest_report", S.with_(S.CUES, _FILE_CUES, then="SELECT track_id || '.' || f AS path, f AS format, CAST(count(*) AS BIGINT) AS n_cues, CAST(NULL AS VARCHAR) AS error FROM fc GROUP BY track_id, f UNION ALL SELECT page_id || '.html', NULL, 0, 'unknown format' FROM pages"))
def _(spark, sf):
    pages = C.table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    files = _clean_files(spark, sf).unionByName(pages)
    return I.ingest_report(files, I.ingest_cues(files))


for _fmt in I.BRANCHES:
    def _one(fmt):
        def run(spark, sf):
            return I.format_cues(N.as_files(C.document_cues(spark, sf), fmt), fmt).select("path", "ord", "start_ms", "end_ms", T.clean_text(F.col("text")).alias("text"))

        at = (lambda c: f"{c} // 10 * 10") if fmt == "ass" else (lambda c: c)
        return run, S.with_(S.CUES, then=f"SELECT track_id || '.{fmt}' AS path, cue_id AS ord, {at('start_ms')} AS start_ms, {at('end_ms')} AS end_ms, {S.clean('text')} AS text FROM cues")

    CASES[f"{_fmt}_cues"] = _one(_fmt)


@case("timestamp_map", """SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_id % 3 <> 0 THEN event_id * 90000 END AS mpeg_ts, CASE WHEN event_id % 3 <> 0 THEN (event_id % 60) * 1000 + 250 END AS local_ms, CASE WHEN event_id % 3 <> 0 THEN event_id * 1000 - ((event_id % 60) * 1000 + 250) END AS offset_ms FROM events""")
def _(spark, sf):
    ev = C.table(spark, sf, "events")
    e = F.col("event_id")
    head = F.concat(F.lit("WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:"), (e * 90_000).cast("string"), F.lit(", LOCAL:00:00:"), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(".250\n\n"))
    return I.timestamp_map(ev.select(e.cast("string").alias("path"), F.when(e % 3 != 0, head).otherwise("WEBVTT\n\n").alias("content")))


@case("vtt_text", S.with_(S.CUES, then="""SELECT track_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(t(start_ms) || ' --> ' || t(end_ms) || chr(10) || text || chr(10) || chr(10), '' ORDER BY start_ms, cue_id) AS content FROM cues GROUP BY track_id""".replace(
    "t(start_ms)", "printf('%02d:%02d:%02d.%03d', start_ms // 3600000, (start_ms // 60000) % 60, (start_ms // 1000) % 60, start_ms % 1000)").replace("t(end_ms)", "printf('%02d:%02d:%02d.%03d', end_ms // 3600000, (end_ms // 60000) % 60, (end_ms // 1000) % 60, end_ms % 1000)")))
def _(spark, sf):
    return W.vtt_text(C.document_cues(spark, sf))


@case("write_cues", S.with_(S.CUES, then="SELECT track_id, cue_id, start_ms, end_ms, text, source, language FROM cues"))
def _(spark, sf):
    """Written to Parquet and read back."""
    from hushline.streaming.jobs import workspace

    folder = workspace(spark, "cues")
    W.write_cues(C.document_cues(spark, sf), folder)
    return W.read_cues(spark, folder)


@case("export_bundle", S.with_(S.CUES, TRACKS, then="SELECT 'cues' AS kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM cues UNION ALL SELECT 'tracks', count(*), sum(length(label)) FROM tr"))
def _(spark, sf):
    """Written as a backup and read back."""
    from hushline.streaming.jobs import workspace

    folder = workspace(spark, "bundle")
    cues, tracks = C.document_cues(spark, sf), C.track_rows(spark, sf)
    W.export_bundle(folder, cues=cues, tracks=tracks)
    back = W.import_bundle(spark, folder, {"cues": cues.schema.simpleString(), "tracks": tracks.schema.simpleString()})
    total = lambda df, kind, c: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(c)).alias("size")).select(F.lit(kind).alias("kind"), "n", "size")
    return total(back["cues"], "cues", "text").unionByName(total(back["tracks"], "tracks", "label"))


@case("file_round_trip", S.with_(S.CUES, then=f"SELECT track_id || '/' || language AS track_id, cue_id AS ord, start_ms, end_ms, {S.clean('text')} AS text FROM cues"))
def _(spark, sf):
    """All cues as one named file per track, whose ids hold a slash, read back from the folder."""
    from hushline.sources import vtt_files
    from hushline.streaming.jobs import workspace

    folder = workspace(spark, "vtt")
    cues = C.document_cues(spark, sf)
    W.write_vtt(cues.withColumn("track_id", F.concat("track_id", F.lit("/"), "language")), folder)
    files = vtt_files.read_vtt_files(spark, folder).select(F.col("track_id").alias("path"), "content")
    return I.format_cues(files, "vtt").select(F.col("path").alias("track_id"), "ord", "start_ms", "end_ms", T.clean_text(F.col("text")).alias("text"))


def bundle_versions(cues, tracks) -> dict[int, W.Version]:
    """Version 0 held seconds, and called the label of a track its caption."""
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    old_cues = "track_id string, cue_id int, start double, end double, text string, source string, language string"
    old_tracks = tracks.withColumnRenamed("label", "caption").schema
    to_ms = lambda df: df.withColumn("start_ms", ms("start")).withColumn("end_ms", ms("end")).drop("start", "end")
    return {0: W.Version({"cues": old_cues, "tracks": old_tracks.simpleString()}, {"cues": to_ms, "tracks": lambda df: df.withColumnRenamed("caption", "label")}),
            1: W.Version({"cues": cues.schema.simpleString(), "tracks": tracks.schema.simpleString()})}


@case("migrate_bundle", S.with_(S.CUES, TRACKS, then="""SELECT 'cue' AS kind, track_id AS id, cue_id AS n, start_ms, end_ms, text FROM cues
UNION ALL SELECT 'track', CAST(id AS VARCHAR), NULL, NULL, NULL, label FROM tr"""))
def _(spark, sf):
    """Half of the rows from a backup of version 0, half of version 1, in the schema of version 1."""
    from hushline.streaming.jobs import workspace

    folder = workspace(spark, "bundle")
    cues, tracks = C.document_cues(spark, sf), C.track_rows(spark, sf)
    old = F.pmod(F.xxhash64("track_id"), F.lit(2)) == 0
    seconds = cues.filter(old).select("track_id", "cue_id", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "source", "language")
    some = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    W.export_bundle(folder, version=0, cues=seconds, tracks=tracks.filter(some).withColumnRenamed("label", "caption"))
    W.export_bundle(folder, version=1, mode="append", cues=cues.filter(~old), tracks=tracks.filter(~some))
    back = W.migrate_bundle(spark, folder, bundle_versions(cues, tracks))
    none = F.lit(None).cast("bigint")
    return back["cues"].select(F.lit("cue").alias("kind"), F.col("track_id").alias("id"), F.col("cue_id").alias("n"), "start_ms", "end_ms", "text").unionByName(
        back["tracks"].select(F.lit("track").alias("kind"), F.col("id").cast("string").alias("id"), F.lit(None).cast("int").alias("n"), none.alias("start_ms"), none.alias("end_ms"), F.col("label").alias("text")))
