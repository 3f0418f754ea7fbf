"""Subtitle files of all formats, robustness, and the round trip through WebVTT."""

from pyspark.sql import functions as F

from hushline.sources import subtitle_files as I, writers as W

FILES = {
    "a.srt": "﻿1\r\n00:00:01,000 --> 00:00:04,000\r\nHello\r\nworld\r\n\r\n3\n00:00:00.500 --> 00:00:00.900\nFirst\n\n4\nnot a time\nx",
    "b.vtt": "WEBVTT\nX-TIMESTAMP-MAP=MPEGTS:900000,LOCAL:00:00:00.000\n\n00:01.000 --> 00:04.000 align:start\n<v Bob>Hi &amp; bye\n\n01:02:03.456 --> 01:02:06.789\nL1\nL2\n01:02:07.000 --> 01:02:06.000\nbackwards",
    "c.ass": "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:00:01.00,0:00:04.05,D,,0,0,0,,{\\i1}Hello, there\\Nyou\n[Fonts]\nDialogue: 0,0:00:09.00,0:00:10.00,D,,0,0,0,,no",
    "d.xml": '<?xml version="1.0"?><transcript><text start="3" dur="1.5">How &amp;amp; are</text><text start="0" dur="2.5">Hello world</text><text start="9" dur="0">x</text></transcript>',
    "e.xml": '<tt xmlns="x"><body><div><p begin="0s" end="2.5s">A</p><p begin="00:01:00.5" end="01:02"><span>B</span><span>C</span></p></div></body></tt>',
    "f.json": '{"wireMagic":"pb3","events":[{"tStartMs":0,"dDurationMs":16639,"segs":[{"utf8":"Hello"},{"utf8":" world"}]},{"tStartMs":5}]}',
    "g.json": '{"TrackEvents":[{"Id":"1","Text":"T","StartPositionTicks":10009999,"EndPositionTicks":20000000}]}',
    "h.txt": "random text",
    "i.txt": " ",
}
WANT = {
    "a.srt": [(500, 900, "First"), (1000, 4000, "Hello world")],
    "b.vtt": [(1000, 4000, "Hi & bye"), (3723456, 3726789, "L1 L2")],
    "c.ass": [(1000, 4050, "Hello, there you")],
    "d.xml": [(0, 2500, "Hello world"), (3000, 4500, "How & are")],
    "e.xml": [(0, 2500, "A"), (60500, 62000, "B C")],
    "f.json": [(0, 16639, "Hello world")],
    "g.json": [(1000, 2000, "T")],
}


def test_directory_ingest(spark, tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).write_text(content, encoding="utf8", newline="")
    files = I.read_subtitle_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", "([^/]*)$", 1))
    cues = I.ingest_cues(files)
    got = {}
    for r in sorted(cues.collect(), key=lambda r: (r.track_id, r.cue_id)):
        got.setdefault(r.track_id, []).append((r.start_ms, r.end_ms, r.text))
    assert got == WANT
    report = {r.path: (r.format, r.n_cues, r.error) for r in I.ingest_report(files, cues).collect()}
    assert report["h.txt"] == (None, 0, "unknown format") and report["a.srt"] == ("srt", 2, None) and report["i.txt"][0] is None
    tm = {r.path: r.offset_ms for r in I.timestamp_map(files).collect()}
    assert tm["b.vtt"] == 10000 and tm["a.srt"] is None


def test_size_ceiling(spark, tmp_path):
    (tmp_path / "big.srt").write_text("x" * 100)
    r = I.read_subtitle_files(spark, str(tmp_path), max_bytes=50).first()
    assert r.content is None and r.error == "file too large"


def test_vtt_round_trip(spark):
    rows = [("t", i, i * 1000, i * 1000 + 900, f"This is cue number {i}") for i in range(200)]
    cues = spark.createDataFrame(rows, "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string")
    back = I.ingest_cues(W.vtt_text(cues).withColumnRenamed("track_id", "path"))
    assert sorted((r.cue_id, r.start_ms, r.end_ms, r.text) for r in back.collect()) == [r[1:] for r in rows]


def test_vtt_offset(spark):
    f = spark.createDataFrame([("x", "WEBVTT\n\n00:10.000 --> 00:12.000\na\n\n00:01.000 --> 00:02.000\nb")], "path string, content string")
    assert [(r.start_ms, r.text) for r in I.format_cues(f, "vtt", offset_ms=5000).collect()] == [(5000, "a")]


def test_named_files(spark, tmp_path):
    """Names with slashes, dots, empty, null, very long; a long track; a second write adds files."""
    from hushline.sources import vtt_files as V

    ids = ["a/b", "..", "", None, "x" * 500, "50% off+tax", "Zoë", "plain"]
    rows = [(k, i, 1000 * i, 1000 * i + 900, f"line {i}") for k in ids for i in (2, 0, 1)] + [("long", i, 1000 * i, 1000 * i + 900, "y" * 50) for i in range(20_000)] + [("plain", 9, None, 5, "no start")]
    cues = spark.createDataFrame(rows, "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string")
    W.write_vtt(cues, str(tmp_path))
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    assert sorted(p.name for p in tmp_path.glob("*/*.vtt")) == sorted(V.file_name(k) for k in [*ids, "long"])
    files = V.read_vtt_files(spark, str(tmp_path))
    back = {r.track_id: r.content for r in files.collect()}
    assert back.keys() - {k for k in back if k and k.startswith("xx")} == {*ids, "long"} - {"x" * 500}
    assert back["a/b"] == back[None] == back[".."] == "WEBVTT\n\n" + "".join(f"00:00:0{i}.000 --> 00:00:0{i}.900\nline {i}\n\n" for i in range(3))
    assert back["long"].count("-->") == 20_000
    W.write_vtt(cues.where("false"), str(tmp_path))
    W.write_vtt(cues.where("track_id = 'plain'").withColumn("track_id", F.lit("more")), str(tmp_path))
    assert V.read_vtt_files(spark, str(tmp_path)).count() == len(back) + 1


def test_named_files_are_listed_by_tasks(spark, tmp_path):
    """The driver's plan holds no list of files; rows are those of Spark's own source, whatever the folders."""
    from hushline.sources import vtt_files as V

    (tmp_path / "a" / "b c").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    (tmp_path / ".too").mkdir()
    for name in ("top.vtt", "a/x%2Fy.vtt", "a/b c/z.vtt", "a/b c/Zoë.vtt", "_hidden/no.vtt", ".too/no.vtt", "a/_no.vtt", "a/.no.vtt", "a/other.srt", "a/vtt"):
        (tmp_path / name).write_bytes(chr(0xFEFF).encode() + b"WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nx\n")
    (tmp_path / "a" / "empty.vtt").write_bytes(b"")
    (tmp_path / "a" / "large.vtt").write_bytes(b"x" * (I.MAX_BYTES + 1))
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        files = V.read_vtt_files(spark, path)
        assert files.inputFiles() == [] and "binaryFile" not in files._jdf.queryExecution().optimizedPlan().toString()
        got = sorted((r.path, r.content, r.n_bytes, r.error) for r in files.collect())
        assert got == sorted((r.path, r.content, r.n_bytes, r.error) for r in I.read_subtitle_files(spark, path, "*.vtt").collect()) and len(got) == 5


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    import pytest

    cues = spark.createDataFrame([("a", 0, 0, 5, "x")], "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string")
    with pytest.raises(Exception, match="on purpose"):
        W.write_vtt(cues.withColumn("text", F.raise_error(F.lit("on purpose")).cast("string")), str(tmp_path))
    assert not list(tmp_path.glob("*/*.vtt"))


def test_backup_versions(spark, tmp_path):
    now = W.Version({"cues": "id int, start_ms bigint"})
    versions = {0: W.Version({"cues": "id int, start double"}, {"cues": lambda df: df.select("id", (F.col("start") * 1000).cast("bigint").alias("start_ms"))}), 1: now}
    folder = str(tmp_path / "bundle")
    W.export_bundle(folder, version=0, cues=spark.createDataFrame([(1, 1.5), (2, None)], "id int, start double"))
    W.export_bundle(folder, version=1, mode="append", cues=spark.createDataFrame([(3, 7)], "id int, start_ms bigint"))
    W.export_bundle(folder, version=7, mode="append", cues=spark.createDataFrame([(4, 7)], "id int, start_ms bigint"))
    back = W.migrate_bundle(spark, folder, versions)
    assert sorted((r.id, r.start_ms) for r in back["cues"].collect()) == [(1, 1500), (2, None), (3, 7)]
    for part in (tmp_path / "bundle").glob("*/*.json"):
        part.write_text(part.read_text().replace('\\"id\\":3', '\\"id\\":9'))
    for crc in (tmp_path / "bundle").glob("*/.*.crc"):
        crc.unlink()
    assert sorted(r.id for r in W.migrate_bundle(spark, folder, versions)["cues"].collect()) == [1, 2]
    assert [r.record for r in W.damaged_records(spark, folder).collect()] == ['{"id":9,"start_ms":7}']


def test_restore_detects_afresh(spark):
    from hushline.operators import detect as D, lexicon as L

    cues = spark.createDataFrame([("t", 0, 0, 900, "a brown fox", 9.0, True)], "track_id string, cue_id int, start_ms bigint, end_ms bigint, text string, score double, has_profanity boolean")
    lex = L.build_lexicon(L.terms_df(spark, ["badger"]))
    out = W.restore_cues(cues, lambda c: D.detect_matches(c, lex, use_context=False)).first()
    assert (out.score, out.has_profanity, list(out.matches)) == (0.0, False, [])
