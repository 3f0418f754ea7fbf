"""URL predicates and fields as column functions.

URLs are read with patterns, so that one malformed URL is a null, not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hushline.functions import fixed_values as fv, text as T

_START = r"\A[A-Za-z][A-Za-z0-9+.\-]*:"


def scheme(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.lit("")))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, _START + r"//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _START + r"//[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)


def is_url(url: Column) -> Column:
    return F.coalesce(host(url).isNotNull() & ~url.rlike(f"[{T.WS}]"), F.lit(False))


def query_value(url: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1), F.lit(""))


def _has_query_key(url: Column) -> Column:
    return query(url).rlike(rf"(?:\A|&)(?:{'|'.join(fv.SUBTITLE_QUERY_KEYS)})(?:=|&|\z)")


def _ends(names: list[str]) -> str:
    return rf"\.(?:{'|'.join(names)})\z"


def absolute_url(base: Column, ref: Column) -> Column:
    """A reference resolved against the URL of the document it stands in."""
    folder = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    joined = (
        F.when(ref.rlike(_START), ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin(base), ref))
        .when(ref.startswith("?"), F.concat(F.regexp_extract(base, r"\A([^?#]*)", 1), ref))
        .otherwise(F.concat(folder, ref)))
    return F.when(ref.rlike(r"(\A|/)\.\.?(/|\z|[?#])"), without_dots(joined)).otherwise(joined)


def without_dots(url: Column) -> Column:
    """The path's ``.`` and ``..`` steps carried out, any number of them; ``..`` at the root stays there."""
    site = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rest = F.substr(url, F.length(site) + F.length(path) + 1)
    steps = F.split(F.substr(path, F.lit(2)), "/", -1)

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    # a path that ends in a dot step ends in its folder
    ended = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    done = F.aggregate(ended, F.array().cast("array<string>"), walk)
    return F.when(site != "", F.concat(site, F.lit("/"), F.array_join(done, "/"), rest)).otherwise(url)


def is_subtitle_url(url: Column) -> Column:
    """Strict: fonts, script modules and playlists out; extension, query key or path pattern in."""
    p = F.lower(path(url))
    out = p.rlike(_ends(fv.FONT_EXTENSIONS + fv.MODULE_EXTENSIONS + ["m3u8"]))
    inside = p.rlike(_ends(fv.SUBTITLE_EXTENSIONS)) | _has_query_key(url) | url.rlike(f"(?i)(?:{fv.SUBTITLE_PATHS})")
    return F.coalesce(is_url(url) & ~out & inside, F.lit(False))


def is_valid_track_url(url: Column) -> Column:
    """Loose: fonts out; extension anywhere, playlist or query key in."""
    low = F.lower(url)
    inside = low.rlike(rf"\.(?:{'|'.join(fv.SUBTITLE_EXTENSIONS + ['m3u8'])})") | (is_url(url) & _has_query_key(url))
    return F.coalesce((url != "") & ~low.rlike(_ends(fv.FONT_EXTENSIONS)) & inside, F.lit(False))


def is_direct_subtitle(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)\.(?:vtt|srt|ass|ssa)(?:\?|\z)"), F.lit(False))


def is_fetchable_url(url: Column) -> Column:
    return F.coalesce(is_url(url) & scheme(url).isin("http", "https"), F.lit(False))


def is_video_page(url: Column) -> Column:
    rest = F.concat(path(url), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(""))
    return F.coalesce(is_url(url) & (rest.rlike(r"/watch\?|/embed/|/v/") | url.rlike(r"(?i)\Ahttps?://(?:www\.)?youtu\.be/")), F.lit(False))


def url_format(url: Column, content_type: Column | None = None) -> Column:
    """Subtitle format by content type, then by the URL."""
    low = F.lower(url)
    kind = F.lit(None).cast("string") if content_type is None else content_type
    return (
        F.when(kind.contains("vtt"), "vtt")
        .when(kind.contains("subrip") | kind.contains("srt"), "srt")
        .when(kind.contains("ssa") | kind.contains("ass"), "ass")
        .when(low.contains(".vtt"), "vtt")
        .when(low.contains(".ass") | low.contains(".ssa"), "ass")
        .when(low.contains(".srt"), "srt")
        .otherwise("unknown"))


def stream_position(url: Column) -> Column:
    """Playlist position of a segment URL in seconds, 0 when absent."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in (r"(?i)mtp%3D(\d+)", r"(?i)mtp%3A(\d+)", r"(?i)[&?]mtp=(\d+)")]
    return F.coalesce(F.coalesce(*found).cast("double") / 1000, F.lit(0.0))


def content_ids(df: DataFrame, url: str = "url") -> DataFrame:
    """Ids a watch page or caption URL carries."""
    u = F.col(url)
    p = path(u)
    blank = lambda c: F.nullif(c, F.lit(""))
    return df.select(
        "*",
        F.coalesce(blank(F.regexp_extract(p, r"(?i)/watch/movie/(\d+)", 1)), blank(F.regexp_extract(p, r"(?i)/watch/tv/(\d+)", 1))).alias("tmdb_id"),
        F.when(p.contains("/movie/"), "movie").when(p.contains("/tv/"), "tv").alias("content_type"),
        query_value(u, "server").alias("server"),
        query_value(u, "v").alias("video_id"),
        F.coalesce(query_value(u, "lang"), F.lit("unknown")).alias("caption_language"),
        F.coalesce(query_value(u, "kind") == "asr", F.lit(False)).alias("is_asr"))


def file_label(name: Column) -> Column:
    """Label out of a file name: no folder, no extension, separators as spaces."""
    base = F.regexp_extract(name, r"([^/\\]*)\z", 1)
    stem = F.regexp_replace(F.regexp_replace(base, r"[?#].*\z", ""), r"\.[^.]*\z", "")
    return T.trim_space(F.regexp_replace(stem, r"[_\-+]+", " "))


def site_patterns(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """site_patterns(site, pattern, site_ord): one row per site, its patterns as one."""
    grouped: dict[str, list[str]] = {}
    for site, pattern in fv.SITE_PATTERNS if rows is None else rows:
        grouped.setdefault(site, []).append(pattern)
    out = [(site, "(?i)(?:" + "|".join(ps) + ")", i) for i, (site, ps) in enumerate(grouped.items())]
    return spark.createDataFrame(out, "site string, pattern string, site_ord int")


def _patterns_of(patterns: DataFrame, name: str, order: str) -> list[tuple[str, str]]:
    """All pattern rows as plan-time literals, in order; tables of patterns are short lists."""
    return [(r[name], r["pattern"]) for r in patterns.orderBy(order).collect()]


def site_names(df: DataFrame, patterns: DataFrame, url: str = "url", every: bool = False) -> DataFrame:
    """The first site whose patterns fit, or one row for every fitting site."""
    u, h = F.col(url), host(F.col(url))
    rows = _patterns_of(patterns, "site", "site_ord")
    fit = lambda p: is_url(u) & (h.rlike(p) | u.rlike(p))
    if not every:
        return df.withColumn("site", F.coalesce(*[F.when(fit(p), F.lit(site)) for site, p in rows]))
    all_of = F.array_compact(F.array(*[F.when(fit(p), F.lit(site)) for site, p in rows]))
    return df.withColumn("site", F.explode_outer(all_of)).filter(F.col("site").isNotNull())


def site_endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fv.SITE_ENDPOINTS, "site string, endpoint string")


def video_servers(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    rows = fv.VIDEO_SERVERS if rows is None else rows
    return spark.createDataFrame([(s, "(?i)" + p, i) for i, (s, p) in enumerate(rows)], "server_name string, pattern string, priority int")


def video_server(df: DataFrame, servers: DataFrame, url: str = "url") -> DataFrame:
    """Server of an embed URL: its ``server`` value when known, else the best fitting pattern."""
    u = F.col(url)
    rows = _patterns_of(servers, "server_name", "priority")
    named = query_value(u, "server")
    fits = [F.when(u.rlike(p), F.lit(name)) for name, p in rows]
    return df.withColumn("video_server", F.coalesce(F.when(named.isin([n for n, _ in rows]), named), *fits))
