"""Cues as the text of subtitle files, per format.

Used to derive ``files(path, content)`` from the given texts, so that the ingest
job can be run over whole tables and compared with the cues it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hushline.functions import text as T

FORMATS = ["srt", "vtt", "ass", "xml", "json3", "jellyfin"]


def _clock(ms: Column, mark: str) -> Column:
    return F.concat(F.substring(T.vtt_time(ms), 1, 8), F.lit(mark), F.substring(T.vtt_time(ms), 10, 3))


def _markup(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _json_text(c: Column) -> Column:
    """A string as JSON, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("t"))), r"(?s)\A\{\"t\":(.*)\}\z", 1)


def _pieces(fmt: str):
    """Head, one cue, separator and tail of a file."""
    s, e, t = F.col("start_ms"), F.col("end_ms"), F.col("text")
    number = (F.col("cue_id") + 1).cast("string")
    sec = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), F.pmod(ms, F.lit(1000)))
    if fmt == "srt":
        return "", F.concat(number, F.lit("\n"), _clock(s, ","), F.lit(" --> "), _clock(e, ","), F.lit("\n"), t), "\n\n", "\n"
    if fmt == "vtt":
        return "WEBVTT\n\n", F.concat(_clock(s, "."), F.lit(" --> "), _clock(e, "."), F.lit("\n"), t), "\n\n", "\n"
    if fmt == "ass":
        head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
        cs = lambda ms: F.format_string("%d:%02d:%02d.%02d", F.floor(ms / 3600000), F.floor(F.pmod(ms, F.lit(3600000)) / 60000),
                                        F.floor(F.pmod(ms, F.lit(60000)) / 1000), F.floor(F.pmod(ms, F.lit(1000)) / 10))
        return head, F.concat(F.lit("Dialogue: 0,"), cs(s), F.lit(","), cs(e), F.lit(",Default,,0,0,0,,"), t), "\n", "\n"
    if fmt == "xml":
        cue = F.concat(F.lit('<text start="'), sec(s), F.lit('" dur="'), sec(e - s), F.lit('">'), _markup(t), F.lit("</text>"))
        return "<?xml version=\"1.0\"?><transcript>\n", cue, "\n", "\n</transcript>"
    if fmt == "json3":
        cue = F.concat(F.lit('{"tStartMs":'), s.cast("string"), F.lit(',"dDurationMs":'), (e - s).cast("string"),
                       F.lit(',"segs":[{"utf8":'), _json_text(t), F.lit("}]}"))
        return '{"wireMagic":"pb3","events":[', cue, ",", "]}"
    cue = F.concat(F.lit('{"Id":"'), number, F.lit('","Text":'), _json_text(t), F.lit(',"StartPositionTicks":'), (s * 10000).cast("string"),
                   F.lit(',"EndPositionTicks":'), (e * 10000).cast("string"), F.lit("}"))
    return '{"TrackEvents":[', cue, ",", "]}"


def as_files(cues: DataFrame, fmt: str) -> DataFrame:
    """files(path, content): one file per track."""
    head, cue, between, tail = _pieces(fmt)
    rows = F.sort_array(F.collect_list(F.struct("start_ms", "cue_id", cue.alias("b"))))
    body = F.array_join(F.transform(rows, lambda r: r["b"]), between)
    return cues.groupBy("track_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("content")).select(
        F.concat(F.col("track_id"), F.lit(f".{fmt}")).alias("path"), "content")


def document_files(spark, sf_dir: str) -> DataFrame:
    """Every document as one file; its number decides the format, inside each row, so the cues are read and shuffled once."""
    from hushline.plans import corpus as C

    cues, pieces = C.document_cues(spark, sf_dir), [_pieces(fmt) for fmt in FORMATS]
    number = F.col("track_id").cast("bigint") % len(FORMATS)

    def chosen(values) -> Column:
        out = F.lit(None).cast("string")
        for i, value in enumerate(values):
            out = F.when(number == i, value).otherwise(out)
        return out

    rows = F.sort_array(F.collect_list(F.struct("start_ms", "cue_id", chosen(p[1] for p in pieces).alias("b"))))
    files = cues.groupBy("track_id").agg(F.transform(rows, lambda r: r["b"]).alias("_b"))
    body = F.call_function("array_join", F.col("_b"), chosen(F.lit(p[2]) for p in pieces))
    content = F.concat(chosen(F.lit(p[0]) for p in pieces), body, chosen(F.lit(p[3]) for p in pieces))
    return files.select(F.concat("track_id", F.lit("."), chosen(F.lit(f) for f in FORMATS)).alias("path"), content.alias("content"))
