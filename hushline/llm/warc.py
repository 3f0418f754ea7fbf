"""WARC archives: a writer with revisit records and a splittable reader, both on Spark's own file sources.

Every record is a gzip member of its own.  The writer hands the members to the text sink: the last byte of a gzip
member is the top byte of the record's length, which is 0 below 16 MiB, and the sink writes that byte as its line
separator.  Longer records are followed by an empty member for the same end.  So archives are committed by Spark like
any other output, on every store that Spark reaches.

The reader lets the text source cut files into byte ranges and split them at the gzip magic ``1F 8B 08``.  A task gets
the candidate members that start in its range.  A candidate is a record's start if its header decodes and the content
begins with ``WARC/``, and the members from there on follow each other without a gap for more than a stored block (so that
records inside a record's payload are not taken for the file's own); other bytes belong to the member before.  What lies
before the first such chain of a range, and what is open at its end, is set aside and joined per file afterwards.

Edge cases: a null payload is empty; a null url gives no target header; rows with a null id are always responses; of
equal payloads every row with the largest id is a response (repeated rows); payloads shorter than ``min_bytes`` are
never revisits; columns other than those named are not written; records with other ids than this writer's have a null
``page_id`` and their id in ``record_id``.  File names must not end like a Hadoop codec's (``.gz``),
or Hadoop would unpack the file before it is split.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from hushline.llm.common import salted_join, shared_folder

MAGIC = b"\x1f\x8b\x08"
#: The most bytes that a stored block of a gzip member holds.
STORED_BLOCK = 65_535
EMPTY_MEMBER = zlib.compress(b"", wbits=31)
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, record_id string"
_PARTS = "path string, block bigint, seq bigint, part binary"


def with_records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): which rows revisit another row's payload.

    Payloads are grouped by SHA-1 and length with a partial aggregate; only groups of two or more take part in the
    salted join back, so one payload may fill a third of the table.
    """
    rows = pages.select(pages[id].alias("page_id"), pages[url].alias("url"), F.coalesce(pages[payload].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload")).withColumn("_n", F.length("payload"))
    copies = rows.where((F.col("_n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("_sha", "_n").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("many"))
    copies = copies.where("many > 1").drop("many")
    rows = salted_join(rows, copies, ["_sha", "_n"], F.col("page_id"))
    return rows.select("page_id", "url", "payload", F.when(F.col("first") > F.col("page_id"), F.col("first")).alias("refers_to"))


def _record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header of the full payload but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id or ''}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c not in "\r\n" else f"%{ord(c):02X}" for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, date: str | None = None, level: int = 6) -> None:
    """Write (page_id, url, payload, refers_to) as archives, one per task."""
    stamp = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, u, body, ref in zip(b["page_id"], b["url"], b["payload"], b["refers_to"], strict=True):
                raw = _record(p, u, bytes(body), ref, stamp)
                member = zlib.compress(raw, level, wbits=31)
                out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
            yield pd.DataFrame({"member": out})

    # ids travel as text: pandas would turn a column with nulls into floats
    data = records.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string")).mapInPandas(members, "member binary")
    data.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(folder)


def _opens(part: bytes) -> bool:
    """Whether the bytes after a magic are the start of a record: flags are legal and the content decodes to ``WARC/``."""
    if len(part) < 7 or part[0] & 0xE0:
        return False
    try:
        z = zlib.decompressobj(31)
        text = z.decompress(MAGIC + part[:4096], 64)
    except zlib.error:
        return False
    return text.startswith(b"WARC/") or not z.eof and not part[0] and len(part) < 64 and b"WARC/".startswith(text)  # or a magic within the first bytes


class _Member:
    """A member that is being put together from parts."""

    def __init__(self) -> None:
        self.z, self.out = zlib.decompressobj(31), []

    def feed(self, part: bytes) -> bool:
        """True once the member is complete."""
        self.out.append(self.z.decompress(MAGIC + part))
        return self.z.eof

    def record(self) -> tuple:
        return parse(b"".join(self.out))


#: Digests that are checked, where a record has one; others are passed over.
DIGESTS = ("md5", "sha1", "sha256", "sha512")


def _matches(stated: str, payload: bytes) -> bool:
    """Whether a digest header fits, in base32 or hexadecimal digits; one of an unknown algorithm always does."""
    algorithm, _, value = stated.partition(":")
    if algorithm.lower() not in DIGESTS:
        return True
    raw = hashlib.new(algorithm.lower(), payload).digest()
    return value.upper().rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), raw.hex().upper())


def parse(raw: bytes) -> tuple:
    """The columns of RECORDS of a decoded record.

    Only a block of the type ``application/http`` has a header before its payload; of any other (warcinfo, metadata,
    resource, conversion) the block is the payload.  ``payload_digest`` is the payload's SHA-1, or for a revisit what it states.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = fields.get("content-length", "")
    block = rest[:int(length)] if length.isdigit() else rest.removesuffix(b"\r\n\r\n")
    number = lambda v: int(n) if (n := (v or "").removeprefix("<urn:x-page:").rstrip(">")).lstrip("-").isdigit() else None
    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    http, payload = b"", block
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        sizes = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.strip().lower() == b"content-length" and v.strip().isdigit()]
        digest, size, payload = stated.removeprefix("sha1:"), int(sizes[0]) if sizes else None, None
    else:
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if stated and not _matches(stated, payload):
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    id = fields.get("warc-record-id")
    return number(id), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), digest, size, payload, id.strip("<>") if id else None


_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_LOOSE = ["path", "block", "seq", "part"]


def _frame(records: list[tuple], loose: list[tuple]) -> pd.DataFrame:
    """Records, and rows of parts that could not be placed within a range."""
    full = pd.DataFrame(records, columns=_NAMES, dtype=object).reindex(columns=_NAMES + _LOOSE)
    rest = pd.DataFrame(loose, columns=_LOOSE, dtype=object).reindex(columns=_NAMES + _LOOSE)
    both = pd.concat([full, rest]) if records and loose else full if records else rest
    for c in ("page_id", "refers_to", "payload_bytes", "block", "seq"):
        both[c] = both[c].astype("Int64")
    return both.astype({c: object for c in ("url", "record_type", "payload_digest", "payload", "record_id", "path", "part")})


class _Range:
    """The parts of one range in file order: ``records`` that are surely whole, ``loose`` parts that only the file can place.

    What looks like a record may lie inside another one, whose payload is an archive.  Such bytes stand in the file as
    they are only within a stored block of the outer member, so at most 65,535 in a row; beyond these, members that follow
    each other without a gap are the file's own.  Until then a chain of members is held back, and given up at the first
    error or gap; then the search goes on behind its first part.
    """

    def __init__(self, path: str, block: int) -> None:
        self.path, self.block, self.seq = path, block, 0
        self.proven, self.member, self.open = False, None, []  # open: the parts of the member that is not complete yet
        self.held, self.waiting = [], []  # parts and records of the chain while it is not proven
        self.records, self.loose = [], []

    def add(self, part: bytes) -> None:
        self.seq += 1
        if self.seq == 1 and not self.block:
            # what lies before the first magic: nothing, and then the file's own first member follows
            self.proven = True
            if part:
                self.loose.append((self.path, self.block, self.seq, part))
            return
        todo = [(self.path, self.block, self.seq, part)]
        while todo:
            row = todo.pop(0)
            again = self._step(row)
            todo = again + todo

    def _step(self, row: tuple) -> list[tuple]:
        """Take one part; returns the parts to take again when a chain was given up."""
        part = row[3]
        if self.member is None:
            if part == EMPTY_MEMBER[3:] and (self.proven or self.held):
                self.held += [] if self.proven else [row]
                return []
            if not _opens(part):
                if self.held:
                    return self._give_up([row])
                self.loose.append(row)
                return []
            self.member, self.open = _Member(), []
        self.open.append(row)
        try:
            done = self.member.feed(part)
        except zlib.error:
            if self.proven:
                raise
            return self._give_up([])
        if not done:
            return []
        if self.proven:
            self.records.append(self.member.record())
            self.member, self.open = None, []
            return []
        if self.member.z.unused_data:
            return self._give_up([])
        self.waiting.append(self.member)
        self.held += self.open
        self.member, self.open = None, []
        if sum(len(r[3]) + len(MAGIC) for r in self.held) > STORED_BLOCK:
            self.proven = True
            self.records += [m.record() for m in self.waiting]
            self.held, self.waiting = [], []
        return []

    def _give_up(self, more: list[tuple]) -> list[tuple]:
        rows = self.held + self.open + more
        self.held, self.waiting, self.member, self.open = [], [], None, []
        self.loose.append(rows[0])
        return rows[1:]

    def flush(self, last: bool) -> pd.DataFrame:
        if last:
            self.loose += self.held + self.open
        out = _frame(self.records, self.loose)
        self.records, self.loose = [], []
        return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of whole ranges, in file order, to records; what stays open at either end of a range is passed on."""
    here = None
    for b in batches:
        for path, block, part in zip(b["path"], b["block"], b["value"], strict=True):
            if here is None or (path, block) != (here.path, here.block):
                if here is not None:
                    yield here.flush(True)
                here = _Range(path, block)
            here.add(bytes(part))
        if here is not None:
            yield here.flush(False)
    if here is not None:
        yield here.flush(True)


def _stitch(parts: pd.DataFrame) -> pd.DataFrame:
    """Records that cross ranges, from the loose parts of one file."""
    member, records = None, []
    for part in map(bytes, parts.sort_values(["block", "seq"])["part"]):
        if member is None:
            if part == EMPTY_MEMBER[3:]:
                continue
            if not _opens(part):
                raise ValueError(f"bytes outside of any record in {parts['path'].iloc[0]}")
            member = _Member()
        if member.feed(part):
            records.append(member.record())
            member = None
    if member is not None:
        raise ValueError(f"the last record is cut off in {parts['path'].iloc[0]}")
    return _frame(records, [])[_NAMES]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives in a folder, one row each (columns of ``RECORDS``); payload is null for revisits."""
    parts = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(folder)
    parts = parts.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    # the second pass returns only what no range could place by itself: hardly ever anything, and never whole files
    loose = parts.mapInPandas(_scan, f"{RECORDS}, {_PARTS}").where(F.col("part").isNotNull()).select("path", "block", "seq", "part")
    crossing = loose.groupBy("path").applyInPandas(_stitch, RECORDS)
    return parts.mapInPandas(_scan, f"{RECORDS}, {_PARTS}").where(F.col("part").isNull()).select(*_NAMES).unionByName(crossing)


def archive(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages as archives to a new folder and read them back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write(with_records(pages, id, url, payload, min_bytes), folder)
    return read(pages.sparkSession, folder)

