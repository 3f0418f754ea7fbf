"""Track discovery: playlists, API payloads, nested JSON, crawled pages, player data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import language as G, text as T, urls as U
from hushline.operators.ordered import materialize

_blank_null = lambda c: F.nullif(c, F.lit(""))
_TAG = "#EXT-X-MEDIA:TYPE=SUBTITLES"


def _playlist_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n", -1), T.trim_space), lambda l: l != "")


def manifest_tracks(manifests: DataFrame, need_language: bool = False) -> DataFrame:
    """Subtitle tracks of playlists: a tag line, then the next line that is no comment.

    Only the latest tag before a URL counts, and one URL uses it up.  Lines other
    than tags and URLs are dropped, so a track is a tag right before a URL.
    """
    lines = F.filter(_playlist_lines(F.col("content")), lambda l: l.startswith(_TAG) | ~l.startswith("#"))
    df = manifests.withColumn("_l", lines)
    pairs = F.zip_with(F.slice("_l", 1, F.greatest(F.size("_l") - 1, F.lit(0))), F.slice("_l", 2, F.greatest(F.size("_l"), F.lit(1))),
                       lambda a, b: F.struct(a.alias("tag"), b.alias("url")))
    found = F.filter(pairs, lambda p: p["tag"].startswith(_TAG) & ~p["url"].startswith("#"))
    rows = df.select("manifest_url", F.posexplode_outer(F.when(F.size("_l") > 1, found)).alias("ord", "_p")).filter(F.col("ord").isNotNull())
    attribute = lambda n: _blank_null(F.regexp_extract(F.col("_p.tag"), rf'(?i){n}="([^"]+)"', 1))
    language = F.lower(attribute("LANGUAGE"))
    out = rows.select(
        "manifest_url", "ord", U.absolute_url(F.col("manifest_url"), F.col("_p.url")).alias("url"),
        F.coalesce(language, F.lit("unknown")).alias("language"),
        F.coalesce(attribute("NAME"), language, F.lit("Unknown")).alias("label"), attribute("GROUP-ID").alias("group_id"),
        language.isNotNull().alias("_known"))
    return (out.filter("_known") if need_language else out).drop("_known")


def manifest_segments(manifests: DataFrame, n: int = 10) -> DataFrame:
    """The first n subtitle segments of every playlist, as absolute URLs."""
    named = F.filter(_playlist_lines(F.col("content")), lambda l: ~l.startswith("#") & (l.contains(".vtt") | l.contains("webvtt")))
    rows = manifests.select("manifest_url", F.posexplode_outer(F.slice(named, 1, n)).alias("ord", "_u")).filter(F.col("ord").isNotNull())
    return rows.select("manifest_url", "ord", U.absolute_url(F.col("manifest_url"), F.col("_u")).alias("url"))


def subtitle_list_tracks(responses: DataFrame) -> DataFrame:
    """``subtitles[]`` payloads of api URLs."""
    item = "struct<file:string,url:string,downloadLink:string,language:string,lang:string,label:string,name:string>"
    rows = responses.filter(F.col("url").contains("/api/")).select(
        F.col("url").alias("request_url"), F.posexplode_outer(F.from_json("body", f"subtitles array<{item}>")["subtitles"]).alias("ord", "_s"))
    s = lambda n: _blank_null(F.col(f"_s.{n}"))
    return rows.select(
        "request_url", "ord", F.coalesce(s("file"), s("url"), s("downloadLink")).alias("url"),
        F.coalesce(s("language"), s("lang"), F.lit("en")).alias("language"),
        F.coalesce(s("label"), s("name"), s("language"), F.lit("English")).alias("label")).filter(F.col("url").isNotNull())


def media_stream_tracks(responses: DataFrame) -> DataFrame:
    """``MediaStreams[]`` payloads of playback-info URLs; relative paths are made absolute."""
    item = "struct<Type:string,DeliveryUrl:string,Path:string,Language:string,DisplayTitle:string,Index:string>"
    rows = responses.filter(F.col("url").rlike("/[Pp]laybackInfo")).select(
        F.col("url").alias("request_url"), F.posexplode_outer(F.from_json("body", f"MediaStreams array<{item}>")["MediaStreams"]).alias("ord", "_s"))
    s = lambda n: _blank_null(F.col(f"_s.{n}"))
    ref = F.coalesce(s("DeliveryUrl"), s("Path"))
    base = U.origin(F.col("request_url"))
    full = F.when(ref.startswith("http"), ref).otherwise(F.concat(base, F.when(ref.startswith("/"), "").otherwise("/"), ref))
    return rows.filter(F.col("_s.Type") == "Subtitle").select(
        "request_url", "ord", full.alias("url"), F.coalesce(s("Language"), F.lit("unknown")).alias("language"),
        F.coalesce(s("DisplayTitle"), F.concat(F.lit("Track "), s("Index"))).alias("label")).filter(F.col("url").isNotNull())


# one function per payload shape; a new site is one more row here and a pattern row
SITE_READERS = {"lookmovie": subtitle_list_tracks, "jellyfin": media_stream_tracks}


def api_tracks(responses: DataFrame, readers: dict | None = None) -> DataFrame:
    """Tracks of all payloads; ``responses(url, body, site)`` names the site of each."""
    parts = [reader(responses.filter(F.col("site") == site)).withColumn("site", F.lit(site))
             for site, reader in (SITE_READERS if readers is None else readers).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


URL_KEYS = ["file", "url", "src", "downloadLink", "path", "link"]
CHILD_KEYS = ["subtitles", "subs", "captions", "cc", "text_tracks", "tracks"]
_EXTENSIONS = r"(?i)\.(?:vtt|srt|ass|ssa)"


def nested_track_urls(payloads: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Subtitle URLs in nested JSON: ``payloads(payload_id, body)``.

    Objects are tested for URL keys; the search goes down into arrays and a fixed
    set of keys, level by level until a level is empty.  Levels are stored, as each is read twice.
    """
    level = payloads.select("payload_id", F.try_parse_json("body").alias("_v"), F.lit("$").alias("_at"))
    level = level.filter(F.col("_v").isNotNull())
    found, level = None, materialize(level)
    parts = level.rdd.getNumPartitions()  # a union of two children each would double them at every level
    while found is None or not level.isEmpty():
        kind = F.schema_of_variant("_v")
        objects = level.filter(kind.startswith("OBJECT"))
        here = objects.select("payload_id", "_at", "_v", F.explode(F.array(*[
            F.struct(F.lit(k).alias("key"), F.try_variant_get("_v", f"$.{k}", "string").alias("url")) for k in URL_KEYS])).alias("_k"))
        here = here.filter(F.col("_k.url").rlike(_EXTENSIONS))
        for p in exclude:
            here = here.filter(~F.col("_k.url").rlike(p))
        get = lambda n: _blank_null(F.try_variant_get("_v", f"$.{n}", "string"))
        rows = here.select(
            "payload_id", F.col("_at").alias("at"), F.col("_k.key").alias("key"), F.col("_k.url").alias("url"),
            F.coalesce(get("language"), get("lang"), get("code"), G.url_language(F.col("_k.url"), wide=True)).alias("language"),
            F.coalesce(get("label"), get("name"), F.lit("Detected")).alias("label"))
        found = rows if found is None else found.unionByName(rows)
        below = objects.select("payload_id", "_at", F.explode(F.array(*[
            F.struct(F.lit(k).alias("key"), F.try_variant_get("_v", f"$.{k}", "variant").alias("v")) for k in CHILD_KEYS])).alias("_c"))
        below = below.filter(F.col("_c.v").isNotNull()).select("payload_id", F.concat("_at", F.lit("."), "_c.key").alias("_at"), F.col("_c.v").alias("_v"))
        lists = level.filter(kind.startswith("ARRAY"))
        items = lists.lateralJoin(
            lists.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(
            "payload_id", F.concat("_at", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("_at"), F.col("value").alias("_v"))
        level = materialize(below.unionByName(items).filter(F.col("_v").isNotNull()).coalesce(parts))
    return found


def page_tracks(pages: DataFrame, link: str = r"[^\"]+\.(?:vtt|srt|ass)", kinds: list[str] = ("subtitles", "captions")) -> DataFrame:
    """Tracks named by crawled pages, distinct per page and URL: ``pages(page_id, url, html)``.

    ``<track>`` elements of the wanted kinds, and JSON fields url, src or file in
    scripts; a language is looked for in the 100 characters before such a field.
    """
    html = F.col("html")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<track\b[^>]*>"), F.lit(0))
    attribute = lambda e, n: _blank_null(F.regexp_extract(e, rf"(?is)[{T.WS}]{n}[{T.WS}]*=[{T.WS}]*[\"']([^\"']*)[\"']", 1))
    elements = pages.select("page_id", "url", F.posexplode_outer(tags).alias("ord", "_e")).filter(F.col("ord").isNotNull())
    elements = elements.filter(F.lower(attribute(F.col("_e"), "kind")).isin(list(kinds)))
    from_tags = elements.select(
        "page_id", U.absolute_url(F.col("url"), attribute(F.col("_e"), "src")).alias("track_url"),
        F.coalesce(attribute(F.col("_e"), "srclang"), F.lit("unknown")).alias("language"),
        F.coalesce(attribute(F.col("_e"), "label"), F.lit("Unknown")).alias("label"),
        F.col("_e").rlike(rf"(?is)[{T.WS}]default\b").alias("is_default"), F.lit("element").alias("origin"), "ord")
    from_tags = from_tags.filter(F.col("track_url").isNotNull())
    # the hit and up to 100 characters before it; a look-behind keeps hits apart
    field = rf'"(?:url|src|file)"\s*:\s*"({link})"'
    scripts = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*>(.*?)</script>"), F.lit(1)), "\n")
    staged = pages.select("page_id", "url", scripts.alias("_s"))
    hits = staged.select("page_id", "url", "_s", F.posexplode_outer(F.when(F.col("_s").rlike(field), T.spans("_s", f"(?i){field}"))).alias("ord", "_h")).filter(F.col("ord").isNotNull())
    before = F.substring(F.col("_s"), F.greatest(F.lit(0), F.col("_h.start_idx") - 100) + 1, F.least(F.lit(100), F.col("_h.start_idx")))
    language = _blank_null(F.regexp_extract(before, r'(?i)"language?"\s*:\s*"([^"]+)"', 1))
    from_scripts = hits.select(
        "page_id", U.absolute_url(F.col("url"), F.regexp_extract(F.col("_h.word"), f"(?i){field}", 1)).alias("track_url"),
        F.coalesce(language, F.lit("unknown")).alias("language"), F.coalesce(language, F.lit("Detected")).alias("label"),
        F.lit(False).alias("is_default"), F.lit("script").alias("origin"), "ord")
    both = from_tags.unionByName(from_scripts)
    first = F.min_by(F.struct("language", "label", "is_default", "origin"), F.struct("origin", "ord"))
    return both.groupBy("page_id", "track_url").agg(first.alias("_f")).select("page_id", "track_url", "_f.*")


def page_links(pages: DataFrame, link: str = r"[^\"]*") -> DataFrame:
    """Link targets of a page that fit a pattern, made absolute, distinct per page."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(rf'<a href="({link})"'), F.lit(1)))
    rows = pages.select("page_id", "url", F.explode_outer(found).alias("_u")).filter(F.col("_u").isNotNull())
    return rows.select("page_id", U.absolute_url(F.col("url"), F.col("_u")).alias("track_url")).distinct()


def caption_tracks(players: DataFrame) -> DataFrame:
    """Caption tracks of player responses: ``players(player_id, body)``; URLs ask for vtt."""
    name = "string"
    track = f"struct<baseUrl:string,url:string,languageCode:string,lang:string,kind:string,trackName:string,name:{name}>"
    schema = f"captions struct<playerCaptionsTracklistRenderer:struct<captionTracks:array<{track}>>>"
    path = F.from_json("body", schema)["captions"]["playerCaptionsTracklistRenderer"]["captionTracks"]
    rows = players.select("player_id", F.posexplode_outer(path).alias("ord", "_t")).filter(F.col("ord").isNotNull())
    t = lambda n: _blank_null(F.col(f"_t.{n}"))
    raw = F.coalesce(t("baseUrl"), t("url"))
    url = F.when(raw.rlike(r"[?&]fmt="), F.regexp_replace(raw, r"([?&]fmt=)[^&#]*", "$1vtt")).otherwise(
        F.concat(raw, F.when(raw.contains("?"), "&").otherwise("?"), F.lit("fmt=vtt")))
    language = F.coalesce(t("languageCode"), t("lang"), F.lit("unknown"))
    # a name is a string or an object with a simple text or runs
    named = F.col("_t.name")
    label = F.coalesce(
        _blank_null(F.get_json_object(named, "$.simpleText")), _blank_null(F.get_json_object(named, "$.runs[0].text")),
        F.when(~named.startswith("{"), _blank_null(named)), G.language_name(language))
    asr = F.coalesce((F.col("_t.kind") == "asr") | (F.col("_t.trackName") == "auto-generated"), F.lit(False))
    return rows.select("player_id", "ord", url.alias("url"), language.alias("language"),
                       F.concat(label, F.when(asr, " (Auto)").otherwise("")).alias("label"), asr.alias("is_asr")).filter(F.col("url").isNotNull())
