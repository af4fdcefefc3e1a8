"""Token ids in binary files of Simple-8b blocks.

A file is: the magic; blocks of up to `BLOCK` ids that run on across documents; the index;
the index's length as 8 bytes; the magic again. A block is three 4-byte counts (ids, words,
escapes), the 8-byte words, the 4-byte places and 8-byte values of escapes. The index holds
four counts of 8 bytes (documents, ids, blocks, block size), the offset of every block, and
per document a null mark, its 8-byte id and its number of ids. All numbers are little-endian.
Block b holds the ids from b * BLOCK on, so any range of ids is read by its blocks alone.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardmill.operators.scratch import settled

from . import simple8b, tokens
from .columns import document_text, need_columns

MAGIC = b"S8BTOK01"
BLOCK = 8192
#: A file is closed after the document that brings it over this many ids.
FILE_IDS = 64 << 20
TEXT_BYTES = 4 << 20
_COUNTS = struct.Struct("<III")
_INDEX = struct.Struct("<QQQQ")
_FILES = "part long, file string, docs long, ids long, bytes long"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class IdWriter:
    """Writes documents one after the other to an open stream."""

    def __init__(self, out, block: int = BLOCK):
        self._out, self._block = out, block
        self._held: list[np.ndarray] = []
        self._waiting = self.ids = 0
        self._offsets: list[int] = []
        self._docs: list[tuple[bool, int, int]] = []
        self.size = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._docs.append((doc_id is None, doc_id or 0, len(ids)))
        self._held.append(ids)
        self._waiting += len(ids)
        self.ids += len(ids)
        if self._waiting >= 16 * self._block:
            self._flush(final=False)

    def _flush(self, final: bool) -> None:
        values = np.concatenate(self._held) if self._held else np.empty(0, np.uint64)
        whole = len(values) if final else len(values) - len(values) % self._block
        for at in range(0, whole, self._block):
            packed = simple8b.encode(values[at:min(whole, at + self._block)])
            self._offsets.append(self.size)
            self._put(_COUNTS.pack(packed.n, len(packed.words), len(packed.places))
                      + packed.words.astype("<u8").tobytes()
                      + packed.places.astype("<u4").tobytes()
                      + packed.escaped.astype("<u8").tobytes())
        self._held = [values[whole:]]
        self._waiting = len(values) - whole

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the finished file."""
        self._flush(final=True)
        nulls, names, lengths = zip(*self._docs, strict=True) if self._docs else ((),) * 3
        index = (_INDEX.pack(len(names), self.ids, len(self._offsets), self._block)
                 + np.array(self._offsets, dtype="<u8").tobytes()
                 + np.array(nulls, dtype="u1").tobytes()
                 + np.array(names, dtype="<i8").tobytes()
                 + np.array(lengths, dtype="<u8").tobytes())
        self._put(index + struct.pack("<Q", len(index)) + MAGIC)
        self._out.close()
        return len(names), self.ids, self.size


class IdReader:
    """Reads a file by its index."""

    def __init__(self, source):
        self._source = source
        size = source.size()
        source.seek(0)
        if size < 2 * len(MAGIC) + 8 or source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        source.seek(size - len(MAGIC) - 8)
        length, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("the file of token ids is cut off")
        source.seek(size - 16 - length)
        index = source.read(length)
        docs, self.ids, blocks, self.block = _INDEX.unpack_from(index)
        at = _INDEX.size
        parts = []
        for kind, n in (("<u8", blocks), ("u1", docs), ("<i8", docs), ("<u8", docs)):
            parts.append(np.frombuffer(index, kind, n, at))
            at += parts[-1].nbytes
        self._offsets, self.nulls, self.names, lengths = parts
        self.lengths = lengths.astype(np.int64)
        self._at, self._values = -1, np.empty(0, np.uint32)

    def _load(self, block: int) -> np.ndarray:
        if block != self._at:
            self._source.seek(int(self._offsets[block]))
            n, words, escapes = _COUNTS.unpack(self._source.read(_COUNTS.size))
            data = self._source.read(8 * words + 12 * escapes)
            packed = simple8b.Block(
                n, np.frombuffer(data, "<u8", words),
                np.frombuffer(data, "<u4", escapes, 8 * words),
                np.frombuffer(data, "<u8", escapes, 8 * words + 4 * escapes))
            self._values, self._at = simple8b.decode(packed).astype("<u4"), block
        return self._values

    def pieces(self, start: int, count: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, a block's share at a time."""
        end = min(start + count, self.ids)
        while start < end:
            block, inside = divmod(start, self.block)
            piece = self._load(block)[inside:inside + end - start]
            yield piece
            start += len(piece)

    def read(self, start: int, count: int) -> np.ndarray:
        return np.concatenate([np.empty(0, np.uint32), *self.pieces(start, count)])

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """Id, first id's place, number of ids and their checksum, in file order."""
        starts = np.cumsum(self.lengths) - self.lengths
        for null, name, start, length in zip(
                self.nulls.tolist(), self.names.tolist(), starts.tolist(),
                self.lengths.tolist(), strict=True):
            crc = 0
            for piece in self.pieces(start, length):
                crc = zlib.crc32(piece.tobytes(), crc)
            yield None if null else name, start, length, crc


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1,
              file_ids: int = FILE_IDS, identity: str = "doc_id",
              text: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending id order; lists the files.

    Ranges of ids are dealt to the tasks, so files follow one another by `part` and number.
    Null ids come first; documents of one id follow in the order of their texts' hash. A
    task writes under the name of its attempt and renames what is complete.
    """
    need_columns(docs, identity, text)
    run = uuid.uuid4().hex
    body = document_text(text)
    ordered = (docs.select(F.col(identity).cast("long").alias("id"), body.alias("text"),
                           F.xxhash64(body).alias("tie"))
               .repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
               .select("id", "text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder = tokens.load(tokenizer)
        part = context.partitionId()
        name = f"{run}-{part:06d}-{context.taskAttemptId()}"
        tail = np.array([] if end_id is None else [end_id], dtype=np.uint32)
        done: list[tuple] = []
        out = None

        def close() -> None:
            counts = out.close()
            final = f"{name}-{len(done):05d}.s8b"
            store.move(f"{root}/{name}.open", f"{root}/{final}")
            done.append(((part << 20) + len(done), f"{folder.rstrip('/')}/{final}", *counts))

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in tokens.slices_of_bytes(batch.column(1), TEXT_BYTES):
                for ids in encoder.encode(texts):
                    if out is None:
                        out = IdWriter(store.open_output_stream(
                            f"{root}/{name}.open", compression=None))
                    out.add(next(names), np.concatenate([ids, tail]))
                    if out.ids >= file_ids:
                        close()
                        out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(
                    zip(*done, strict=True),
                    (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()),
                    strict=True)], ["part", "file", "docs", "ids", "bytes"])

    return settled(ordered.mapInArrow(write, _FILES))


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files.

    `start` counts the ids of all documents before, over all files: a running sum over one
    row per file, not per document.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0))
                         .alias("base"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = pafs.FileSystem.from_uri(row["file"])
                with store.open_input_file(path) as source:
                    rows: list[tuple] = []
                    for name, start, length, crc in IdReader(source).documents():
                        rows.append((name, row["base"] + start, length, crc))
                        if len(rows) == 8192:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    tasks = max(1, files.count())
    return based.repartition(tasks).mapInArrow(read, _DOCS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
        ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str,
                   end_id: int | None = 1, identity: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. Null ids come first, repeated ids one after
    the other. No rows give no files and no rows. Other columns are not read. Integer ids of
    any width are taken as 64-bit.
    """
    return read_documents(write_ids(docs, folder, tokenizer, end_id, identity=identity,
                                    text=text))
