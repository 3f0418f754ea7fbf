"""One named WebVTT file per track: a writing data source that streams sorted rows into files and commits them together,
and a reader that lists folders and opens files in tasks.

Rows of a track come to one task in order and go to its file one by one, so neither a track nor a task's share is held
in memory.  Every attempt of a task writes to a folder of its own; only the folders of attempts that Spark reports as
done are moved into place, one rename per task, so lost executors and repeated tasks leave no file behind.

There are as many files as tracks, so the driver never lists them: names are rows of a table, dealt to the tasks that read.

Names: the track id in percent-encoding, so that ``/`` or a leading dot is no part of a path; the empty id is ``%``, a
null id ``%null``.  An encoded id of more than 200 bytes is cut there and ends in ``~`` and its MD5.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "track_id string, block string"
LONGEST_NAME = 200


def file_name(track_id: str | None) -> str:
    if track_id is None:
        return "%null.vtt"
    name = quote(track_id, safe="") or "%"
    if name.startswith("."):
        name = "%2E" + name[1:]
    if len(name) > LONGEST_NAME:
        name = f"{name[:LONGEST_NAME]}~{hashlib.md5(track_id.encode()).hexdigest()}"
    return f"{name}.vtt"


def _files(path: str):
    """The file system of a path or address, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What one task hands to the driver: the folder of its files, or nothing if it had no rows."""

    folder: str | None


class VttWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def write(self, rows) -> Written:
        store, root = _files(self.path)
        folder, now, out = f"_staging-{self.job}/{uuid.uuid4().hex}", (), None
        try:
            for row in rows:
                if (row.track_id,) != now:
                    if out is None:
                        store.create_dir(f"{root}/{folder}", recursive=True)
                    else:
                        out.close()
                    now = (row.track_id,)
                    out = store.open_output_stream(f"{root}/{folder}/{file_name(row.track_id)}")
                    out.write(b"WEBVTT\n\n")
                out.write(row.block.encode("utf-8", "surrogatepass"))
        finally:
            if out is not None:
                out.close()
        return Written(folder if out is not None else None)

    def commit(self, messages) -> None:
        store, root = _files(self.path)
        for i, m in enumerate(m for m in messages if m is not None and m.folder):
            store.move(f"{root}/{m.folder}", f"{root}/part-{i:05d}-{self.job}")
        self._sweep(store, root)

    def abort(self, messages) -> None:
        self._sweep(*_files(self.path))

    def _sweep(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_staging-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_staging-{self.job}")


class VttFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hushline_vtt"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> VttWriter:
        return VttWriter(self.options["path"])


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Write (track_id, start_ms, cue_id, block) as one file per track below a folder; files of earlier calls stay."""
    spark = blocks.sparkSession
    spark.dataSource.register(VttFiles)
    rows = blocks.repartition("track_id").sortWithinPartitions("track_id", "start_ms", "cue_id").select("track_id", "block")
    rows.write.format("hushline_vtt").mode("append").save(path)


def _listed(path: str):
    """A function that lists a folder: (address, length or null for a folder) of what is not hidden, a few names at a time."""
    import os

    from pyarrow import fs

    root = _files(path)[1].rstrip("/")
    # addresses look as Hadoop writes them
    before = "file:" if path.startswith(("/", "file:")) else path.rstrip("/").removesuffix(root)

    def children(folder: str):
        store, inner = _files(folder)
        if folder.startswith(("/", "file:")):
            with os.scandir(inner) as found:
                for e in found:
                    if not e.name.startswith((".", "_")):
                        yield f"{before}{inner.rstrip('/')}/{e.name}", None if e.is_dir() else e.stat().st_size
            return
        for i in store.get_file_info(fs.FileSelector(inner)):
            if not i.base_name.startswith((".", "_")):
                yield f"{before}{i.path}", i.size if i.is_file else None

    return children


def _batched(rows, schema, most: int = 4_000, most_bytes: int = 8 * 1024 * 1024):
    """Record batches of a few rows; the last column may be large."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def raw_files(spark: SparkSession, path: str, ending: str, max_bytes: int) -> DataFrame:
    """files(path, length, content) below a folder as Spark's source of binary files gives them, listed and read by tasks.

    One task lists the folder, others what is in its folders, others read.  Every file with content and that ending
    is a row, unless it or its folder is hidden; of one longer than ``max_bytes`` the content is null.
    """
    import pyarrow as pa

    names = pa.schema([("path", pa.string()), ("length", pa.int64())])
    whole = names.append(pa.field("content", pa.binary()))

    def top(batches):
        for b in batches:
            for _ in range(b.num_rows):
                yield from _batched(_listed(path)(path), names)

    def walk(batches):
        def files():
            children = _listed(path)
            for b in batches:
                todo = [*zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                while todo:
                    at, length = todo.pop()
                    if length is None:
                        for name, size in children(at):
                            if size is None:
                                todo.append((name, None))
                            elif size and name.endswith(ending):
                                yield name, size
                    elif length and at.endswith(ending):
                        yield at, length

        yield from _batched(files(), names)

    def read(batches):
        def contents():
            for b in batches:
                for at, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    content = None
                    if length <= max_bytes:
                        store, inner = _files(at)
                        with store.open_input_stream(inner) as f:
                            content = f.read()
                    yield at, length, content

        yield from _batched(contents(), whole)

    # a name is short and its file is not, so tasks are not merged by the bytes of names
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda df: df.repartition(tasks, "path")
    entries = spark.range(1, numPartitions=1).mapInArrow(top, "path string, length bigint")
    found = deal(entries).mapInArrow(walk, "path string, length bigint")
    return deal(found).mapInArrow(read, "path string, length bigint, content binary")


def read_vtt_files(spark: SparkSession, path: str) -> DataFrame:
    """files(path, content, n_bytes, error) as ``read_subtitle_files`` gives them, with ``track_id`` from the names."""
    from hushline.sources.subtitle_files import MAX_BYTES, decoded

    name = F.regexp_extract("path", r"([^/]*)\.vtt$", 1)
    track = F.when(name == "%", "").when(name == "%null", None).otherwise(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    return decoded(raw_files(spark, path, ".vtt", MAX_BYTES), MAX_BYTES).withColumn("track_id", track)
