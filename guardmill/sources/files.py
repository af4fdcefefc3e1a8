"""Many small files in a folder that every task can open: listed, read and written by tasks.

Spark's readers list all files on the driver and count each as 4 MB when they deal them to
tasks; its writers start processes and checksum files for every file. Neither is bounded by
the bytes when a folder holds a file per document.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files of one batch of a listing, and bytes of one batch of contents.
_LISTED = 10_000
_BATCH_BYTES = 8 << 20
_FILE = pa.schema([("path", pa.binary())])


def open_root(spark: SparkSession, folder: str) -> str | None:
    """The absolute path of a folder in the file system of driver and executors, else None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return root.getPath() if root.getScheme() == "file" and os.path.isdir(root.getPath()) else None


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path of the files below `root` that Spark's readers would read.

    The folders in `root` are dealt to tasks; no task holds more than a batch.
    """
    # rows of the session have no size for the planner, so a listing is not taken for small
    top = spark.createDataFrame([(root.encode(),)], "path binary")
    kind = "path binary"
    folders = top.mapInArrow(_walker("folders"), kind).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    paths = top.mapInArrow(_walker("files"), kind).unionByName(
        folders.mapInArrow(_walker("all"), kind))
    return paths.select(F.concat(F.lit("file:"), F.col("path").cast("string")).alias("path"))


def _walker(wanted: str):
    """Of each given folder its folders, its files, or all files below it."""
    def entries(folder: bytes) -> Iterator[bytes]:
        with os.scandir(folder) as found:
            for entry in found:
                if _hidden(entry.name) and not (
                        entry.is_dir() and entry.name.startswith((b"_metadata", b"_common_metadata"))):
                    continue
                if entry.is_dir():
                    if wanted == "folders":
                        yield entry.path
                    elif wanted == "all":
                        yield from entries(entry.path)
                elif wanted != "folders" and _size(entry):
                    yield entry.path

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for folder in (x for b in batches for x in b.column(0).to_pylist()):
            for path in entries(folder):
                held.append(path)
                if len(held) >= _LISTED:
                    yield pa.record_batch([pa.array(held, pa.binary())], schema=_FILE)
                    held = []
        yield pa.record_batch([pa.array(held, pa.binary())], schema=_FILE)

    return walk


def _hidden(name: bytes) -> bool:
    return (name.startswith(b".") or name.endswith(b"._COPYING_")
            or (name.startswith(b"_") and b"=" not in name))


def _size(entry: os.DirEntry) -> int:
    try:
        return entry.stat().st_size
    except FileNotFoundError:  # gone meanwhile, or a link to nothing
        return 0


@F.arrow_udf(T.BinaryType())
def _contents(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    last, content = None, None
    for paths in batches:
        held: list[bytes | None] = []
        size = 0
        for path in paths.to_pylist():
            if path != last:
                content = None
                if path is not None:
                    with open(path, "rb") as file:
                        content = file.read()
                last = path
            held.append(content)
            size += len(content or b"")
            if size >= _BATCH_BYTES:
                yield pa.array(held, pa.binary())
                held, size = [], 0
        if held:
            yield pa.array(held, pa.binary())


def file_contents(path: F.Column) -> F.Column:
    """The content of the file of a listed path, null without one; equal paths that follow
    each other are read once."""
    return _contents.asNondeterministic()(F.substring(path.cast("binary"), 6, F.octet_length(path)))


def write_files(texts: DataFrame, folder: str) -> None:
    """name, text of unique names as files of these names below `folder`, a text and a line
    end each.

    A file appears under its name when it is complete, so a retried task writes the same.
    """
    run = uuid.uuid4().hex

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        attempt = f"{run}-{TaskContext.get().taskAttemptId()}"
        made: set[str] = set()
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{root}/{name}"
                parent, _, last = place.rpartition("/")
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                hidden = f"{parent}/.{last}.{attempt}.open"
                with store.open_output_stream(hidden, compression=None) as out:
                    out.write(text)
                store.move(hidden, place)
        yield from ()

    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary")
    (texts.select("name", content.alias("text")).mapInArrow(write, "name string")
     .write.format("noop").mode("overwrite").save())
