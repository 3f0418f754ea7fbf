"""Subtitle tracks: labels, scores, ranking, duplicates, discovery unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import fixed_values as fv, language as G, text as T, urls as U
from hushline.operators import ordered

TRACK_FIELDS = ["id", "label", "language", "is_sdh", "is_default", "url", "embedded", "source", "recommend_score"]


def _any(label: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | label.rlike(T.ascii_pattern(p))
    return F.coalesce(out, F.lit(False))


def is_sdh(label: Column) -> Column:
    return _any(F.lower(label), fv.SDH_LABELS)


def is_forced(label: Column) -> Column:
    return _any(F.lower(label), fv.FORCED_LABELS)


def track_label(label: Column, sdh: Column, source: Column) -> Column:
    """Label as it is displayed: a star for SDH, and where the track came from."""
    origin = F.when(source == "network", "(detected)").when(source == "user", "(uploaded)")
    return F.concat_ws(" ", label, F.when(sdh, "★"), origin)


def upload_track(df: DataFrame, name: str = "filename") -> DataFrame:
    """Track fields out of the name of an uploaded file."""
    f = F.col(name)
    codes = "|".join(code for code, _ in fv.pairs_of(fv.LANGUAGE_ALIASES))
    language = F.lower(F.regexp_extract(f, rf"(?i)[.\-_]({codes})[.\-_]", 1))
    extension = F.lower(F.regexp_extract(f, r"([^.]*)\z", 1))
    return df.select(
        "*", language.alias("language"),
        F.when(extension.isin("srt", "vtt", "ass"), extension).otherwise("unknown").alias("format"),
        F.when(language != "", F.concat(F.upper(language), F.lit(" - "), f)).otherwise(f).alias("label"),
        f.rlike("(?i)sdh|cc|hearing").alias("is_sdh"), F.lit(True).alias("is_default"), F.lit("user").alias("source"),
        F.lit(15).alias("recommend_score"))


def to_tracks(df: DataFrame, origin: str) -> DataFrame:
    """Rows of any origin as tracks.

    ``df`` may hold id, label, language, url, format, is_default.  ``origin`` is
    video (embedded), network (seen in traffic), api (found in a payload) or user.
    """
    have = set(df.columns)
    get = lambda c, t="string": (F.nullif(F.col(c), F.lit("")) if t == "string" else F.col(c)) if c in have else F.lit(None).cast(t)
    label, language, url = get("label"), get("language"), get("url")
    if origin == "video":
        shown = F.coalesce(label, language, F.lit("Unknown"))
        ident = F.coalesce(get("id"), F.concat(F.lit("track-"), F.coalesce(label, F.lit("unknown")), F.lit("-"), F.coalesce(language, F.lit("und"))))
    elif origin == "network":
        shown = F.coalesce(label, language, F.concat(F.lit("Subtitle ("), F.upper(F.coalesce(get("format"), F.lit("unknown"))), F.lit(")")))
        ident = F.concat(F.lit("network-"), url)
    else:
        shown = F.coalesce(label, language, F.lit("Detected"))
        ident = F.coalesce(get("id"), F.concat(F.lit(f"{origin}-"), F.md5(F.concat_ws("|", url, shown))))
    out = df.withColumn("_label", shown).withColumn("_id", ident)
    extra = [c for c in df.columns if c not in (*TRACK_FIELDS, "format")]
    return out.select(
        *extra, F.col("_id").alias("id"), F.col("_label").alias("label"), F.coalesce(language, F.lit("")).alias("language"),
        is_sdh(F.col("_label")).alias("is_sdh") if origin in ("video", "network") else F.lit(False).alias("is_sdh"),
        F.coalesce(get("is_default", "boolean"), F.lit(False)).alias("is_default"), url.alias("url"),
        F.lit(origin == "video").alias("embedded"), F.lit({"api": "network"}.get(origin, origin)).alias("source"),
        F.lit(5 if origin == "api" else 15 if origin == "user" else 0).alias("recommend_score"))


def track_scores(tracks: DataFrame, preferred: str = "en", prefer_sdh: bool = True) -> DataFrame:
    """Recommendation score: language, SDH, forced, default and upload points."""
    code = G.language_code(F.col("language"))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = F.when(code == G.language_code(F.lit(preferred)), 10).when(code == "en", 5).otherwise(0)
    if prefer_sdh:
        score = score + points(is_sdh(F.col("label")), 3)
    score = score + points(is_forced(F.col("label")), -5) + points(F.col("is_default"), 2) + points(F.col("source") == "user", 15)
    return tracks.withColumn("recommend_score", score)


def ranked_tracks(scored: DataFrame, group: list[str], chunk: int = 10_000) -> DataFrame:
    """Rank by score within each title; ties keep their order.  ``rank`` 1 wins."""
    order = [(-F.col("recommend_score")).alias("_s"), F.col("ord")]
    part = F.struct((-F.col("recommend_score")).alias("s"), F.floor(F.col("ord") / chunk).alias("o"))
    return ordered.row_numbers(scored, group, order, part, "rank")


def best_track(scored: DataFrame, group: list[str]) -> DataFrame:
    """Winner per title, the number of others, and whether it may be selected by itself.

    The best row is kept during partial aggregation; no title is sorted.
    """
    fields = [c for c in scored.columns if c not in group]
    best = F.max_by(F.struct(*fields), F.struct("recommend_score", -F.col("ord")))
    out = scored.groupBy(*group).agg(best.alias("_b"), (F.count(F.lit(1)) - 1).alias("n_alternatives"))
    auto = (F.col("_b.recommend_score") >= 0) & (F.col("_b.source") != "user")
    return out.select(*group, "_b.*", "n_alternatives", auto.alias("auto_selected"))


def dedupe_tracks(tracks: DataFrame, group: list[str]) -> DataFrame:
    """One track per language and SDH status: higher score, then the last embedded, else the first."""
    fields = [c for c in tracks.columns if c not in group]
    key = [*group, G.language_code(F.col("language")).alias("_lang"), F.col("is_sdh").alias("_sdh")]
    place = F.when(F.col("embedded"), F.col("ord")).otherwise(-F.col("ord"))
    best = F.max_by(F.struct(*fields), F.struct("recommend_score", "embedded", place))
    return tracks.groupBy(*key).agg(best.alias("_b")).select(*group, "_b.*")


def all_tracks(*found: DataFrame) -> DataFrame:
    """Union of discovered tracks, one per group of equal url (or id without a url).

    Earlier tables come first, then lower ``ord`` where there is one, then the row as text, so every run keeps the same row.
    """
    names = found[0].columns
    out = found[0].withColumn("_from", F.lit(0))
    for i, other in enumerate(found[1:], 1):
        out = out.unionByName(other.withColumn("_from", F.lit(i)))
    row = F.struct(*names)
    rank = F.struct("_from", *[F.col(c) for c in ("ord",) if c in names], F.to_json(row).alias("_row"))
    return out.groupBy(F.coalesce("url", "id").alias("_k")).agg(F.min_by(row, rank).alias("_b")).select("_b.*")
