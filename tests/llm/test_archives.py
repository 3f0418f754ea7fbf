"""WARC archives and URL filter."""

import zlib

from pyspark.sql import functions as F

from hushline.llm import url_filter, warc
from hushline.llm.common import shared_folder
from hushline.llm.queries import URL_RULES


def pages(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (5, "x\r\ny: z", "<p>é</p>"), (5, "u", "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", ""), (6, "u", "z" * 300_000),
            (2**53 + 1, "u", "big")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("refers_to", F.lit("x")).withColumn("first", F.lit(2))


def test_round_trip(spark):
    got = warc.archive(pages(spark)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        (-1, "response", None, 0), (1, "revisit", 5, 9), (2, "revisit", 5, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 9), (5, "response", None, 9),
        (6, "response", None, 300_000), (2**53 + 1, "response", None, 3)]
    assert {r.payload_digest for r in got if r.payload_bytes == 0} == {"3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"}
    assert {bytes(r.payload) for r in got if r.page_id == 5} == {"<p>é</p>".encode()}
    assert {r.url for r in got if r.page_id == 2} == {None}
    assert warc.archive(pages(spark), min_bytes=10).where("record_type = 'revisit'").count() == 0
    assert warc.archive(pages(spark).where("false")).count() == 0


def test_any_split(spark, tmp_path):
    """Ranges of all sizes, with the magic inside of stored records and empty members between records."""
    records = [warc._record(str(i), f"http://x/{i}", bytes([65 + i % 20]) * (i * 37 % 900) + warc.MAGIC * (i % 4) + b"end" * (i % 3), None, "2020-01-01T00:00:00Z") for i in range(60)]
    raw = b"".join(zlib.compress(r, 0, wbits=31) + (warc.EMPTY_MEMBER if i % 7 == 0 else b"") for i, r in enumerate(records))
    (tmp_path / "a.warc").write_bytes(raw)
    want = sorted(warc.parse(r) for r in records)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in ("331", "1000", "5003", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read(spark, str(tmp_path)).collect())
            assert got == want, size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "http://example.com/en/", "http://example.com", "http://a.net/es/1#x", "http://net/fr/?", "http://xcom/", "http://b.org/en/",
            "x://y://z/", "http://Éa.com/Ü"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("row", F.lit(0))
    words = spark.createDataFrame([("cheap", 5), ("pills", 5)], "word string, n long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, url_filter.rule_table(spark, URL_RULES), words).collect()}
    assert len(got) == len(urls)
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[6][:3] == ("example.com", "", None) and got[7] == ("a.net", "/es/1", "net/es/", "block") and got[8] == ("net", "/fr/", "net/fr/", "block")
    assert got[9][:3] == ("xcom", "/", None) and got[11][:2] == ("y:", "//z/") and got[12] == ("Éa.com", "/Ü", "com/", "allow")
    assert url_filter.judge(rows.where("false"), url_filter.rule_table(spark, URL_RULES), words.where("false")).count() == 0


def test_segmentation_and_bayes(spark):
    words = spark.createDataFrame([("cheap", 50), ("pills", 40), ("garden", 60), ("tools", 60), ("now", 30), ("he", 90)], "word string, n long")
    labels = spark.createDataFrame([("cheappillsnow",), ("gardentools",), ("zzcheapqq",), ("x",)], "label string")
    got = {r.label: r.words for r in url_filter.segmented(labels, words, 330).collect()}
    assert got == {"cheappillsnow": ["cheap", "pills", "now"], "gardentools": ["garden", "tools"], "zzcheapqq": ["zz", "cheap", "qq"], "x": ["x"]}
    urls = [(i, f"http://cheappills{'now' if i % 2 else ''}.org/buy/{i}") for i in range(20)] + [(100 + i, f"http://gardentools.org/page/{i}") for i in range(20)] + [(900, "http://pillscheap.org/"), (901, "http://toolsgarden.org/")]
    judged = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rule_table(spark, URL_RULES), words).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == {*range(20), 900}


def read_in_ranges(spark, folder, sizes):
    """What ``read`` gives for each range size."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for size in sizes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            yield size, sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in warc.read(spark, str(folder)).collect()), key=str)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def record(kind, body, content_type=None, digest=None, id="<urn:uuid:1>"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {id}", *([f"Content-Type: {content_type}"] if content_type else []),
            *([f"WARC-Payload-Digest: {digest}"] if digest else []), f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archives_inside_records(spark, tmp_path):
    """Payloads that hold one or many gzipped records, stored or packed, longer and shorter than a stored block."""
    import random

    rng = random.Random(5)
    inner = [zlib.compress(record("resource", rng.randbytes(n), id=f"<urn:in:{n}>"), k, wbits=31) for n, k in ((300, 6), (900, 0), (4000, 6), (70_000, 6))]
    records = []
    for i in range(16):
        body = [inner[0], b"".join(inner[:3]), b"".join(inner[:3] * 30), b"".join(inner), b"x" * 90][i % 5]
        records.append((record("resource", body, "application/warc", id=f"<urn:out:{i}>"), 0 if i % 2 else 6))
    (tmp_path / "a.warc").write_bytes(b"".join(zlib.compress(r, k, wbits=31) for r, k in records))
    want = sorted((warc.parse(r) for r, _ in records), key=str)
    for size, got in read_in_ranges(spark, tmp_path, ("5003", "40000", "150000", "128m")):
        assert got == want, size


def test_other_kinds_of_records(spark, tmp_path):
    import hashlib

    text = b"first: part\r\n\r\nsecond part"
    md5 = "md5:" + hashlib.md5(text).hexdigest()
    kinds = [record("warcinfo", b"software: x\r\n", "application/warc-fields", id="<urn:uuid:a>"), record("resource", text, "text/plain", md5, id="<urn:uuid:b>"), record("metadata", text, "application/warc-fields"),
             record("conversion", text, "text/plain", "blake9:zz"), record("response", b"HTTP/1.1 200 OK\r\n\r\nbody", "application/http; msgtype=response"), record("request", b"GET / HTTP/1.1\r\n\r\n", "application/http;msgtype=request"),
             record("resource", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(zlib.compress(r, wbits=31) for r in kinds))
    for size, got in read_in_ranges(spark, tmp_path, ("200", "128m")):
        assert sorted((r[2], r[6]) for r in got) == sorted([("warcinfo", b"software: x\r\n"), ("resource", text), ("metadata", text), ("conversion", text), ("response", b"body"), ("request", b""), ("resource", b"")]), size
        assert {r[7] for r in got} == {"urn:uuid:a", "urn:uuid:b", "urn:uuid:1"} and {r[0] for r in got} == {None}
