"""Subtitle files to cues: one ingest job over a directory of mixed formats.

Every function takes ``files(path, content)`` and stays inside the row of a file
until the cues are exploded, so no file content is shuffled.  Files are at most
10 MB, which bounds every array below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hushline.functions import text as T

MAX_BYTES = 10 * 1024 * 1024
BOM = chr(0xFEFF)
CUE_TYPE = "array<struct<start_ms:bigint,end_ms:bigint,text:string>>"


def read_subtitle_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """files(path, content, n_bytes, error): one row per file under a directory.

    The file source itself leaves out files without content.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path))
    return decoded(raw, max_bytes)


def decoded(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files(path, content, n_bytes, error) of raw files(path, length, content)."""
    # too large a file is judged by its length; its content is not decoded
    fits = F.col("length") <= max_bytes
    text = F.decode(F.when(fits, F.col("content")), "UTF-8")
    error = F.when(~fits, "file too large")
    return raw.select("path", strip_bom(text).alias("content"), F.col("length").alias("n_bytes"), error.alias("error"))


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{BOM}", "")


def _lines(c: Column) -> Column:
    return F.split(c, r"\r?\n", -1)


def detect_format(content: Column) -> Column:
    """Format by ordered rules; null when nothing fits."""
    t = T.trim_space(strip_bom(content))
    ws = f"[{T.WS}]"
    return (
        F.when(t.startswith("{") & t.contains('"wireMagic"'), "json3")
        .when(t.startswith("{") & t.contains('"TrackEvents"'), "jellyfin")
        .when(t.rlike(r"\A<\?xml") | t.rlike(rf"(?i)<transcript(?:{ws}|>)") | t.rlike(rf"(?i)<tt{ws}"), "xml")
        .when(t.rlike(rf"(?i)\AWEBVTT(?:{ws}|\z)"), "vtt")
        .when(t.rlike(r"(?i)\A\[Script Info\]") | t.rlike(r"(?i)\Assa"), "ass")
        .when(t.rlike(rf"\A\d+{ws}*\r?\n\d{{2}}:\d{{2}}:\d{{2}}[,.]\d{{3}}"), "srt")
        .when(t.rlike(rf"\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}{ws}*-->"), "vtt")
        .when(t.rlike(rf"\d{{2}}:\d{{2}}:\d{{2}},\d{{3}}{ws}*-->"), "srt"))


def clock_ms(c: Column) -> Column:
    """[h:]mm:ss[.,]fraction as milliseconds; the fraction counts as written."""
    part = lambda p, i: F.coalesce(F.regexp_extract(c, p, i).try_cast("bigint"), F.lit(0))
    p = r"(?:(\d+):)?(\d+):(\d+)[.,](\d+)"
    fraction = F.regexp_extract(c, p, 4)
    ms = F.rpad(F.substring(fraction, 1, 3), 3, "0").try_cast("bigint")
    return part(p, 1) * 3_600_000 + part(p, 2) * 60_000 + part(p, 3) * 1000 + F.coalesce(ms, F.lit(0))


def _cue(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"), text.alias("text"))


def _explode(files: DataFrame, cues: Column) -> DataFrame:
    """cues(path, ord, start_ms, end_ms, text) with the text cleaned and empty cues dropped."""
    rows = files.select("path", F.posexplode_outer(cues).alias("ord", "_c")).filter(F.col("_c").isNotNull())
    return rows.select("path", "ord", "_c.start_ms", "_c.end_ms", "_c.text")


_SRT_LINE = rf"(\d{{2}}:\d{{2}}:\d{{2}}[,.]\d{{3}})[{T.WS}]*-->[{T.WS}]*(\d{{2}}:\d{{2}}:\d{{2}}[,.]\d{{3}})"


def _srt(content: Column) -> Column:
    """Blocks between blank lines: optional number, times, text."""
    blocks = F.transform(F.split(T.trim_space(content), r"\r?\n\r?\n", -1), _lines)

    def cue(lines):
        at = F.when(lines[0].rlike(r"\A\d+\z"), 2).otherwise(1)
        clock = F.get(lines, at - 1)
        text = T.trim_space(F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n"))
        made = _cue(clock_ms(F.regexp_extract(clock, _SRT_LINE, 1)), clock_ms(F.regexp_extract(clock, _SRT_LINE, 2)), text)
        return F.when((F.size(lines) >= 2) & clock.rlike(_SRT_LINE) & (text != ""), made)

    return F.array_compact(F.transform(blocks, cue))


_VTT_CLOCK = r"(?:\d{2}:)?\d{2}:\d{2}\.\d{3}"
_VTT_LINE = rf"({_VTT_CLOCK})[{T.WS}]*-->[{T.WS}]*({_VTT_CLOCK})"


def _vtt(content: Column, offset_ms: int = 0) -> Column:
    """A line with times opens a cue; its text runs to a blank line or a line with a time.

    Lines are marked and joined again inside the file's own row; nothing is shuffled.
    """
    # line by line: which lines open, continue or end a cue
    def mark(line):
        timed = line.rlike(r"\d{2}:\d{2}")
        return F.when(line.rlike(_VTT_LINE), "open").when(timed | T.is_blank(line), "end").otherwise("text")

    lines = _lines(content)
    marked = F.transform(lines, lambda l: F.struct(mark(l).alias("m"), T.trim_space(l).alias("l"), l.alias("raw")))
    # a control character separates cues, another one lines; neither survives in a text
    flat = F.transform(marked, lambda x: F.when(x["m"] == "open", F.concat(F.lit("\x1e"), x["raw"]))
                       .when(x["m"] == "text", F.concat(F.lit("\x1f"), x["l"])).otherwise(F.lit("\x1d")))
    blocks = F.filter(F.split(F.array_join(flat, ""), "\x1e", -1), lambda b: b.rlike(_VTT_LINE))

    def cue(block):
        head = F.element_at(F.split(block, "[\x1f\x1d]", -1), 1)
        body = F.element_at(F.split(block, "\x1d", -1), 1)
        lines = F.split(body, "\x1f", -1)
        text = T.trim_space(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"))
        start = clock_ms(F.regexp_extract(head, _VTT_LINE, 1)) - max(offset_ms, 0)
        end = clock_ms(F.regexp_extract(head, _VTT_LINE, 2)) - max(offset_ms, 0)
        return F.when((text != "") & (start < end) & (start >= 0), _cue(start, end, text))

    return F.array_compact(F.transform(blocks, cue))


def _ass(content: Column) -> Column:
    """Dialogue rows of the events section; columns by the format line, else at fields 1, 2, 9."""
    lines = F.transform(_lines(content), T.trim_space)
    # sections begin with a bracket; only the events section is kept
    sections = F.split(F.array_join(lines, "\n"), r"(?m)^(?=\[)", -1)
    events = F.flatten(F.transform(F.filter(sections, lambda s: s.rlike(r"(?i)\A\[Events\]")), lambda s: F.split(s, "\n", -1)))
    return T.let(events, _dialogue)


def _dialogue(events: Column) -> Column:
    formats = F.filter(events, lambda l: l.rlike(r"(?i)\AFormat:"))
    named = F.transform(F.split(F.regexp_replace(F.element_at(formats, -1), r"(?i)\AFormat:", ""), ",", -1), lambda f: F.lower(T.trim_space(f)))
    fields = F.when(F.size(formats) > 0, named).otherwise(F.array().cast("array<string>"))
    place = F.struct(*[F.array_position(fields, n).cast("int").alias(n) for n in ("start", "end", "text")])

    def at(p):
        known = (p["start"] > 0) & (p["end"] > 0) & (p["text"] > 0)
        return F.struct(*[F.when(known, p[n]).otherwise(usual).alias(n) for n, usual in (("start", 2), ("end", 3), ("text", 10))])

    return T.let(at(place), lambda p: _dialogue_rows(events, p))


def _dialogue_rows(events: Column, place: Column) -> Column:
    def cue(line):
        parts = F.split(F.regexp_replace(line, rf"(?i)\ADialogue:[{T.WS}]*", ""), ",", -1)
        text = F.array_join(F.slice(parts, place["text"], F.size(parts)), ",")
        text = F.regexp_replace(F.regexp_replace(text, r"\{\\[^}]*\}", ""), r"(?i)\\n", "\n")
        made = _cue(clock_ms(F.get(parts, place["start"] - 1)), clock_ms(F.get(parts, place["end"] - 1)), text)
        return F.when((F.size(parts) >= 10) & ~T.is_blank(text), made)

    dialogue = F.filter(events, lambda l: l.rlike(r"(?i)\ADialogue:"))
    return F.array_compact(F.transform(dialogue, cue))


def _attribute(element: Column, name: str) -> Column:
    quoted = F.regexp_extract(element, rf"(?s)\A<[^>]*[{T.WS}]{name}[{T.WS}]*=[{T.WS}]*[\"']([^\"']*)[\"']", 1)
    return F.nullif(quoted, F.lit(""))


def xml_clock_ms(c: Column) -> Column:
    """Seconds with or without the unit s, mm:ss.f or hh:mm:ss.f."""
    seconds = F.regexp_extract(c, r"\A(\d+(?:\.\d+)?)s?\z", 1).try_cast("double")
    three = r"(\d+):(\d+):(\d+(?:\.\d+)?)"
    two = r"(\d+):(\d+(?:\.\d+)?)"
    get = lambda p, i: F.regexp_extract(c, p, i).try_cast("double")
    ms = lambda s: F.floor(s * 1000 + 0.5)
    return F.coalesce(
        ms(seconds),
        get(three, 1) * 3_600_000 + get(three, 2) * 60_000 + ms(get(three, 3)),
        get(two, 1) * 60_000 + ms(get(two, 2)),
        F.lit(0)).cast("bigint")


def _xml(c: Column) -> Column:
    """``<text start dur>`` elements, else ``<p begin end>`` elements."""
    texts = F.regexp_extract_all(c, F.lit(rf"(?s)<text(?=[{T.WS}>])[^>]*>.*?</text>"), F.lit(0))
    paragraphs = F.regexp_extract_all(c, F.lit(rf"(?s)<p(?=[{T.WS}>])[^>]*>.*?</p>"), F.lit(0))
    inner = lambda e, tag: F.regexp_extract(e, rf"(?s)\A<{tag}[^>]*>(.*)</{tag}>\z", 1)
    plain = lambda s: T.trim_space(F.regexp_replace(s, "<[^>]*>", ""))

    def timed(e):
        number = lambda a: F.coalesce(F.regexp_extract(_attribute(e, a), r"\A(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
        start, dur, text = number("start"), number("dur"), plain(inner(e, "text"))
        made = _cue(F.floor(start * 1000 + 0.5), F.floor((start + dur) * 1000 + 0.5), text)
        return F.when((text != "") & (dur > 0), made)

    def paragraph(e):
        spans = F.regexp_extract_all(e, F.lit(rf"(?s)<span(?=[{T.WS}>])[^>]*>.*?</span>"), F.lit(0))
        joined = T.trim_space(F.array_join(F.transform(spans, lambda s: F.regexp_replace(s, "<[^>]*>", "")), " "))
        text = F.when(F.size(spans) > 0, joined).otherwise(plain(inner(e, "p")))
        begin, end = (xml_clock_ms(F.coalesce(_attribute(e, a), F.lit("0"))) for a in ("begin", "end"))
        return F.when((text != "") & (end > begin), _cue(begin, end, text))

    found = F.when(F.size(texts) > 0, F.transform(texts, timed)).otherwise(F.transform(paragraphs, paragraph))
    return F.array_compact(found)


def _json3(content: Column) -> Column:
    """Events with text segments; times in milliseconds."""
    schema = "wireMagic string, events array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>"

    def cue(e):
        text = T.trim_space(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), ""))
        start, dur = F.coalesce(e["tStartMs"], F.lit(0)), F.coalesce(e["dDurationMs"], F.lit(0))
        return F.when((text != "") & (dur > 0), _cue(start, start + dur, text))

    return T.let(F.from_json(content, schema), lambda j: F.when(j["wireMagic"] == "pb3", F.array_compact(F.transform(j["events"], cue))))


def _jellyfin(content: Column) -> Column:
    """Track events with times in ticks of 100 ns."""
    schema = "TrackEvents array<struct<Id:string,Text:string,StartPositionTicks:bigint,EndPositionTicks:bigint>>"

    def cue(e):
        text = T.trim_space(e["Text"])
        start, end = F.floor(e["StartPositionTicks"] / 10_000), F.floor(e["EndPositionTicks"] / 10_000)
        return F.when((text != "") & (start < end), _cue(start, end, text))

    return F.array_compact(F.transform(F.from_json(content, schema)["TrackEvents"], cue))


BRANCHES = {"srt": _srt, "vtt": _vtt, "ass": _ass, "xml": _xml, "json3": _json3, "jellyfin": _jellyfin}


def format_cues(files: DataFrame, fmt: str, **options) -> DataFrame:
    """Cues of files that are all of one format: (path, ord, start_ms, end_ms, text)."""
    return _explode(files, BRANCHES[fmt](F.col("content"), **options))


def ingest_cues(files: DataFrame, source: str = "file") -> DataFrame:
    """All formats in one cue table: text cleaned, sorted by start, ids from 0 per file.

    The format decides the branch inside each row, so files are read once.  Ids
    are given inside the row too: a file of at most 10 MB is sorted as an array.
    """
    typed = files.withColumn("format", detect_format(F.col("content")))
    found = F.lit(None).cast(CUE_TYPE)
    for name, branch in BRANCHES.items():
        found = F.when(F.col("format") == name, branch(F.col("content"))).otherwise(found)
    numbered = F.transform(found, lambda c, i: F.struct(c["start_ms"].alias("start_ms"), i.alias("ord"), c["end_ms"].alias("end_ms"), c["text"].alias("text")))
    rows = typed.select("path", "format", F.posexplode_outer(F.sort_array(numbered)).alias("cue_id", "_c")).filter(F.col("cue_id").isNotNull())
    return rows.select(
        F.col("path").alias("track_id"), "cue_id", "_c.start_ms", "_c.end_ms", T.clean_text(F.col("_c.text")).alias("text"),
        F.lit(source).alias("source"), "format")


def ingest_report(files: DataFrame, cues: DataFrame) -> DataFrame:
    """ingest_report(path, format, n_cues, error): files that gave nothing name the reason."""
    counted = cues.groupBy(F.col("track_id").alias("path")).agg(F.count(F.lit(1)).alias("n_cues"))
    base = files.withColumn("format", detect_format(F.col("content")))
    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    out = base.join(counted, "path", "left").withColumn("n_cues", F.coalesce("n_cues", F.lit(0).cast("bigint")))
    error = F.coalesce(known, F.when(F.col("format").isNull(), "unknown format").when(F.col("n_cues") == 0, "no cues"))
    return out.select("path", "format", "n_cues", error.alias("error"))


def timestamp_map(files: DataFrame) -> DataFrame:
    """Stream clock of a segment file: mpeg_ts, local_ms and their offset; null without one."""
    p = rf"(?i)X-TIMESTAMP-MAP=MPEGTS:(\d+)[{T.WS}]*,[{T.WS}]*LOCAL:(\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}})"
    c = F.col("content")
    ticks = F.regexp_extract(c, p, 1).try_cast("bigint")
    local = F.when(ticks.isNotNull(), clock_ms(F.regexp_extract(c, p, 2)))
    return files.select("path", ticks.alias("mpeg_ts"), local.alias("local_ms"), (F.floor(ticks / 90 + 0.5) - local).alias("offset_ms"))
