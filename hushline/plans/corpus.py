"""Cues, heartbeats, tracks and other inputs derived from the given tables.

Everything here is a plain projection of whole tables, so all queries grow with
the data they are run on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushline.functions import text as T
from hushline.operators import lexicon as L

GAP_MS = 100
TRACK_MS = 120_000

# corpus lexicon: frequent words of the given texts, and phrases seen in them
WORDS = ["that", "was", "thou", "ci", "von", "ment", "rewh", "0n", "hat", "le$", "une", "sich", "por", "this", "eau", "der", "edst", "onen", "thti", "para"]
PHRASES = ["of the", "and the", "de la", "in der", "que de", "the of the", "ci la"]
CUSTOM = ["with", "-une", " - por", "is the", "", "THAT"]
# (term, letters, ending)
PATTERNS = [("from", "from", ""), ("are", "are", ""), ("ing", "ing", r"[_\-.*@#$&%!?]*s?"), ("der", "der", ""), ("edst", "edst", "")]
CONTEXT = [
    ("that", "allowed", r"\b(of\s+that|that\s+of)\b", False),
    ("that", "profane", r"\b(and\s+that|that\s+the)\b", False),
    ("was", "allowed", r"\bit\s+was\b", False),
    ("was", "profane", r"\bwas\s+(it|on|in)\b", False),
    ("der", "allowed", r"\bDer\b", True),
    ("ci", "profane", r"\bci.?la\b", False),
    ("are", "allowed", r"\bthey?\s+are\b", False),
]
EXEMPT = ["this", "from", "de la", "ment"]
SUBSTITUTIONS = [
    ("that", "silly", ["thimble", "thicket", "thistle"]), ("that", "polite", ["such"]), ("that", "random", ["noodle", "waffle"]),
    ("was", "silly", ["wasp", "walrus"]), ("was", "polite", []), ("was", "random", ["waffle"]),
    ("th", "silly", ["thumb", "thunder"]), ("th", "polite", ["the"]), ("on", "silly", ["onion"]), ("on", "random", ["onyx"]),
    ("der", "silly", ["derby"]), ("der", "polite", ["dear", "deer"]), ("de", "silly", ["denim"]),
]
ROOTS = ["thou", "th", "on", "ed", "de"]
CUSTOM_LINES = ["ment=mint", "VON = van ", "nothing", "ment=meant", "=x", "sich="]


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}
SPLIT_BYTES = 128 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core work when a small input would be read by few tasks.

    Text work is heavy per byte.  An input with at least one split per core is
    left alone, so large tables are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, key) if size < cores * SPLIT_BYTES else df


def lines_to_cues(df: DataFrame, track: Column, text: Column, source: Column, language: Column) -> DataFrame:
    """One cue per non-blank line; 60 ms per character, at least half a second.

    Start times are summed up inside the row of a document; nothing is shuffled.
    """
    kept = F.filter(F.split(text, "\n", -1), lambda s: ~T.is_blank(s))
    duration = lambda s: F.greatest(F.lit(500), F.length(s) * 60).cast("bigint")
    starts = F.aggregate(
        "_lines",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("s")),
        lambda acc, s: F.struct((acc["at"] + duration(s) + GAP_MS).alias("at"), F.concat(acc["s"], F.array(acc["at"])).alias("s")),
        lambda acc: acc["s"])
    rows = df.select(track.cast("string").alias("track_id"), source.alias("source"), language.alias("language"), kept.alias("_lines"))
    keep = ["track_id", "source", "language"]
    rows = rows.select(*keep, F.arrays_zip(F.col("_lines").alias("text"), starts.alias("start_ms")).alias("_z"))
    out = rows.select(*keep, F.posexplode_outer("_z").alias("cue_id", "_c")).filter(F.col("cue_id").isNotNull())
    return out.select(
        "track_id", "cue_id", F.col("_c.start_ms").alias("start_ms"),
        (F.col("_c.start_ms") + duration(F.col("_c.text"))).alias("end_ms"), F.col("_c.text").alias("text"), "source", "language")


def document_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines_to_cues(docs, F.col("doc_id"), F.col("text"), F.col("source"), F.col("lang"))


def conversation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue per turn: turn number times ten seconds, 60 ms per character."""
    rows = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 10_000
    return rows.select(
        F.col("conv_id").cast("string").alias("track_id"), F.col("turn").cast("int").alias("cue_id"), start.alias("start_ms"),
        (start + F.greatest(F.lit(500), F.length("text") * 60)).alias("end_ms"), "text", F.col("role").alias("source"))


def instant_micros(df: DataFrame, name: str = "ts") -> Column:
    """Microseconds since the epoch, whatever the session's time zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")
    return F.unix_micros(F.col(name))


def as_heartbeats(ev: DataFrame) -> DataFrame:
    """heartbeats(event_id, session_id, track_id, ts, position_ms, rate, paused, ...) from events."""
    micros = instant_micros(ev)
    ms = F.floor(micros / 1000)
    session = F.col("user_id").cast("string")
    return ev.select(
        "event_id", session.alias("session_id"), session.alias("track_id"), F.timestamp_micros(micros).alias("ts"),
        ms.alias("ts_ms"), F.pmod(ms, F.lit(TRACK_MS)).alias("position_ms"),
        F.when(F.col("event_type") == "view", 2.0).otherwise(1.0).alias("rate"),
        (F.col("event_type") == "error").alias("paused"), "event_type", "value")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_heartbeats(table(spark, sf_dir, "events"))


def slow_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats whose position moves by small steps, with looks elsewhere and seeks."""
    hb = heartbeats(spark, sf_dir)
    step = F.floor(F.col("value")) % 50
    jump = F.when(F.col("event_type") == "purchase", 5_000).when(F.col("event_type") == "signup", 9_000).otherwise(0)
    return hb.withColumn("position_ms", (F.col("event_id") % 3 + step + jump).cast("bigint"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests(page_id, form, url, content_type): every page URL in a number of derived forms."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    base = F.regexp_replace("url", r"[?#].*", "")
    forms = [F.concat(base, F.lit(tail)) for tail in REQUEST_TAILS]
    forms += [F.regexp_replace("url", "^https?:", "ftp:"), F.concat(F.lit("javascript:"), F.col("url")), F.col("url"),
              F.concat(base, F.lit("/"), F.md5("url"), F.lit(".vtt")), F.regexp_replace("url", "^https?://[^/]*", "")]
    rows = pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "url"))
    kind = F.when(F.col("form") % 4 == 0, "text/vtt; charset=utf-8").when(F.col("form") % 4 == 1, "application/x-subrip").when(F.col("form") % 4 == 2, "")
    return rows.withColumn("content_type", kind)


REQUEST_TAILS = [
    ".vtt", "_en.srt", "/es/main.ass", "?subs=1&lang=pt-BR", "/subtitles/list", "/ui/subtitles/x.mjs", "/f.woff2?captions=1",
    ".m3u8?subtitle", "/watch/movie/42?server=vidlink", "/watch/tv/7/season/1?server=zz", "/timedtext?v=a1&lang=de&kind=asr",
    "/seg.vtt?mtp=12500", "/x%3Fmtp%3D7000", "/embed/vidrock", "/watch?v=9", "/a_DE.SSA", "/k-fre.vtt?x", "/cc/1", "?language=ita&captions",
]


def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tracks(title, ord, id, label, language, is_sdh, is_default, url, embedded, source) from pages.

    The title is the host of the page, the label is read off its number.
    """
    from hushline.functions import urls as U
    from hushline.operators import tracks as K

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.col("page_id")
    language = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    label = F.concat(F.element_at(F.array(*[F.lit(x) for x in TRACK_LABELS]), (n % len(TRACK_LABELS) + 1).cast("int")))
    rows = pages.select(
        U.host(F.col("url")).alias("title"), n.alias("ord"), F.concat(F.lit("t"), (n % 97).cast("string")).alias("id"), label.alias("label"),
        F.when(n % 5 == 0, F.concat(language, F.lit("-XX"))).otherwise(language).alias("language"), (n % 4 == 0).alias("is_default"),
        F.when(n % 6 != 0, F.col("url")).alias("url"), (n % 3 == 0).alias("embedded"),
        F.when(n % 11 == 0, "user").when(n % 3 == 0, "video").otherwise("network").alias("source"))
    return rows.withColumn("is_sdh", K.is_sdh(F.col("label")))


TRACK_LABELS = ["English", "English SDH", "Forced", "closed-captions", "Plain", "Hi there", "foreign only", "CC"]


def corpus_lexicon(spark: SparkSession) -> DataFrame:
    return L.build_lexicon(L.terms_df(spark, WORDS + PHRASES))


def corpus_rules(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "lexicon": corpus_lexicon(spark),
        "patterns": L.obfuscation_patterns(spark, PATTERNS),
        "rules": L.context_rules(spark, CONTEXT),
        "exempt": L.exempt_terms(spark, EXEMPT),
    }
