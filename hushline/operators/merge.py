"""Combining cues and tracks that arrive from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hushline.functions import fixed_values as fv
from hushline.operators import detect as D, lexicon as L, ordered
from hushline.operators.detect import KEYS


def renumber(cues: DataFrame, order: list[str] = ("start_ms", "cue_id"), chunk_ms: int = 600_000) -> DataFrame:
    """Zero-based ids by start time per track, stable in the given order."""
    out = ordered.row_numbers(cues, ["track_id"], [F.col(c) for c in order], F.floor(F.col("start_ms") / chunk_ms), "_n")
    return out.withColumn("cue_id", (F.col("_n") - 1).cast("int")).drop("_n")


def sort_cues(cues: DataFrame) -> DataFrame:
    """Total order by track and time, by range partitioning."""
    return cues.orderBy("track_id", "start_ms", "cue_id")


def new_cues_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming cues whose start and text the track does not hold yet.

    Equal cues are reduced to one key before the shuffle; the text is compared by
    a 128-bit hash, so the shuffled keys are short.
    """
    key = lambda df: df.select("track_id", "start_ms", F.md5("text").alias("_text"))
    known = key(existing).distinct()
    return incoming.withColumn("_text", F.md5("text")).join(known, ["track_id", "start_ms", "_text"], "left_anti").drop("_text")


def new_tracks_only(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming tracks of which neither url nor id is known."""
    by_url = incoming.join(known.select("url").filter("url is not null").distinct(), "url", "left_anti")
    return by_url.join(known.select("id").distinct(), "id", "left_anti").select(*incoming.columns)


def _both(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both versions as one table; ``_side`` is 0 for existing cues and 1 for incoming ones."""
    return existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))


def _ranges(existing: DataFrame, incoming: DataFrame, min_cues: int) -> DataFrame:
    """Per track what its two versions span, by one aggregate over both; counts are 0 and all else null where one is missing."""
    order = F.struct("start_ms", "cue_id")
    aggs = []
    for side, name in enumerate(("old", "new")):
        mine = F.when(F.col("_side") == side, order)
        aggs += [F.min(F.when(F.col("_side") == side, F.col("start_ms"))).alias(f"{name}_start_ms"), F.max_by("end_ms", mine).alias(f"{name}_end_ms"),
                 F.count(mine).alias(f"{name}_cues"), F.min_by("source", mine).alias(f"{name}_source")]
    columns = ["track_id", "start_ms", "end_ms", "cue_id", "source"]
    out = _both(existing.select(*columns), incoming.select(*columns)).groupBy("track_id").agg(*aggs)
    overlap = F.greatest(F.lit(0), F.least("old_end_ms", "new_end_ms") - F.greatest("old_start_ms", "new_start_ms"))
    span = F.col("old_end_ms") - F.col("old_start_ms")
    return out.withColumn("overlap_ms", overlap).withColumn("replaces", (F.col("new_cues") > min_cues) & (span > 0) & (overlap > span * 0.5))


def range_overlap(existing: DataFrame, incoming: DataFrame, min_cues: int = 100) -> DataFrame:
    """How far two versions of a track overlap in time, and whether that means replacement; tracks of one version are left out."""
    return _ranges(existing, incoming, min_cues).filter("old_cues > 0 AND new_cues > 0")


def is_user_source(source: Column) -> Column:
    return source.isin(fv.USER_SOURCES) | source.contains("user-subtitle")


def merge_policies(existing: DataFrame, incoming: DataFrame, uploads: DataFrame | None = None) -> DataFrame:
    """replace, accumulate or reject per incoming track.

    ``uploads(track_id)`` names tracks with an active user upload; only user
    sources may add to them.
    """
    pairs = _ranges(existing, incoming, 100).filter("new_cues > 0")
    if uploads is not None:
        pairs = pairs.join(uploads.select("track_id").distinct().withColumn("_up", F.lit(True)), "track_id", "left")
    else:
        pairs = pairs.withColumn("_up", F.lit(False))
    new, old = F.col("new_source"), F.col("old_source")
    policy = (
        F.when(F.coalesce("_up", F.lit(False)) & ~is_user_source(new), "reject")
        .when(old.isNull(), "accumulate")
        .when(is_user_source(new) | new.isin(fv.CHOSEN_SOURCES), "replace")
        .when(new.isin(fv.SAME_SITE_SOURCES), F.when(old.isin(fv.SAME_SITE_SOURCES), "replace").otherwise("accumulate"))
        .when(new.contains("plutotv"), "accumulate")
        .when(new.isin(fv.SYNCED_REPLACE_SOURCES) & F.coalesce("replaces", F.lit(False)), "replace")
        .otherwise("accumulate"))
    return pairs.select("track_id", policy.alias("policy"))


def merge_cues(existing: DataFrame, incoming: DataFrame, policies: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Existing and incoming cues under one policy per track, renumbered by time.

    Replaced tracks drop their old cues; all other tracks are a union without
    cues of equal start and text.

    Both versions are one table, which is read once: a cue is known if an existing one of its track and time slice, all of
    which meet in one task, has its start and text.  A null track, start or text is never known.
    """
    both = _both(existing, incoming).join(policies.select("track_id", "policy"), "track_id", "left")
    dropped = ((F.col("_side") == 0) & (F.col("policy") == "replace")) | ((F.col("_side") == 1) & (F.col("policy") == "reject"))
    both = both.filter(~F.coalesce(dropped, F.lit(False))).drop("policy").withColumn("_slice", F.floor(F.col("start_ms") / chunk_ms))
    keys = ["track_id", "start_ms", "_text"]
    first = F.min("_side").over(Window.partitionBy("track_id", "_slice", "start_ms", "_text"))
    placed = both.withColumn("_text", F.md5("text")).repartition("track_id", "_slice").withColumn("_first", first)
    told = F.col("_first") == 0
    for k in keys:
        told = told & F.col(k).isNotNull()
    out = placed.filter((F.col("_side") == 0) | ~told).drop("_text", "_first", "_slice")
    return renumber(ordered.materialize(out), ("start_ms", "_side", "cue_id"), chunk_ms).drop("_side")


def resolve_profile(rows: DataFrame, stored: DataFrame | None, overrides: DataFrame, site: str = "site") -> DataFrame:
    """Settings per row: built-in values, then stored ones, then those of the site.

    ``overrides`` has one row per site; a null field falls through.  ``stored`` has one row or none.
    """
    sites = overrides.select(F.col("site").alias("_site"), *[F.col(c).alias(f"_o_{c}") for c in overrides.columns if c != "site"])
    out = rows.join(L.bounded_broadcast(sites), F.col(site) == F.col("_site"), "left")
    saved = [r.asDict() for r in L.all_rows(stored, 1)] if stored is not None else []
    for name, default in fv.DEFAULT_PROFILE.items():
        layers = [F.col(c) for c in (f"_o_{name}",) if c in out.columns]
        general = saved[0].get(name) if saved else None
        out = out.withColumn(name, F.coalesce(*layers, F.lit(default if general is None else general)))
    return out.drop(*[c for c in out.columns if c.startswith("_o_")], "_site")


def touched_cues(detected: DataFrame, lexicon_old: DataFrame, lexicon_new: DataFrame, fuzzy_threshold: float | None = None, words: DataFrame | None = None) -> DataFrame:
    """The cues with ``touched``: whether any changed term is found in them.

    The changed terms are a lexicon of their own, and a search for it, by the same rules of tokens, phrases and
    distances, tells where results may differ.
    """
    known = lexicon_old.unionByName(lexicon_new).groupBy("norm_term").agg(F.min_by("term", "ord").alias("term"), F.min("kind").alias("kind"), F.min("ord").alias("ord"))
    changed = L.lexicon_diff(lexicon_old, lexicon_new).select("norm_term").distinct().join(known, "norm_term").select("term", "norm_term", "kind", "ord")
    return D.with_any_match(detected, changed, "touched", fuzzy_threshold, words)


def redetect(detected: DataFrame, lexicon_old: DataFrame, lexicon_new: DataFrame, detect, fuzzy_threshold: float | None = None, words: DataFrame | None = None) -> DataFrame:
    """Detect again only where a changed term is found; other rows are kept as they are.

    ``detect`` maps plain cues to detected cues under the new lexicon, with the same ``fuzzy_threshold``.  ``words`` is the
    vocabulary of the cues; without it, fuzzy terms have ``detected`` read once more, and made once more if it is not stored.
    """
    marked = ordered.materialize(touched_cues(detected, lexicon_old, lexicon_new, fuzzy_threshold, words))
    again = detect(marked.filter("touched").drop("touched", "matches", "score", "has_profanity"))
    return marked.filter("not touched").select(*detected.columns).unionByName(again.select(*detected.columns))


def reflag(detected: DataFrame, sensitivity: str) -> DataFrame:
    """Another sensitivity for detected cues: flags follow the scores, the matches stay."""
    return D.score_columns(detected.drop("score", "has_profanity"), sensitivity).select(*detected.columns)
