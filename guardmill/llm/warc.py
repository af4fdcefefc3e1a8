"""WARC archives: a writer and a sequential reader, one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardmill.operators.joins import spread_join
from guardmill.operators.scratch import settled

from .columns import document_text, need_columns

#: An archive is closed at the first record that brings it over this many bytes.
ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
#: A record's headers may not be longer than this.
HEADER_BYTES = 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HOT_SHARE = 0.001
_WRITTEN = "file string, records long, bytes long"
_RECORDS = ("record_id string, record_type string, target_uri string, refers_to string, "
            "payload_bytes long, payload_digest string, digest_ok boolean, file string, "
            "offset long")


#: The record id of a page without an id; no id gives it.
NO_ID = "<urn:page-without-id>"


class BadArchive(ValueError):
    """The bytes do not follow the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_uri(page_id) -> str:
    return NO_ID if page_id is None else f"<urn:page:{page_id}>"


def record_bytes(kind: str, page_id, url: str | None, payload: bytes, digest: str,
                 refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member of its own.

    A revisit holds the HTTP headers and no payload; their Content-Length and the payload
    digest are those of the full payload.
    """
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uri(page_id)}",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}",
              f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}"]
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def choose_records(pages: DataFrame, identity: str = "page_id", payload: str = "html",
                   url: str = "url", least_bytes: int = 0) -> DataFrame:
    """Rows id, url, payload, digest, kind, refers_to: which record each page becomes.

    Of equal payloads of at least `least_bytes` bytes the smallest id is the response and
    the others revisit it. Null ids come after all others. Rows that share the smallest id
    are all responses. Equality is that of SHA-256. Groups are found on digests alone; only
    groups of two and more are joined back, spread where a group is hot.
    """
    need_columns(pages, identity, payload, url)
    body = document_text(payload).cast("binary")
    rows = pages.select(
        F.col(identity).alias("id"), F.col(url).alias("url"), body.alias("payload"),
        F.sha2(body, 256).alias("sha"))
    long_enough = F.octet_length("payload") >= least_bytes
    groups = settled(rows.filter(long_enough).groupBy("sha").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = pages.count()
    hot = groups.filter(F.col("n") > max(1.0, total * _HOT_SHARE)).select("sha")
    judged = spread_join(rows, groups.drop("n"), ["sha"], "left", hot)
    revisits = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return judged.select(
        "id", "url", "payload", F.when(revisits, "revisit").otherwise("response")
        .alias("kind"), F.when(revisits, F.col("first")).alias("refers_to"))


def _rows(batches: Iterable[pa.RecordBatch], most: int = 64) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield from batch.slice(at, most).to_pylist()


def write_archives(records: DataFrame, folder: str,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of `choose_records` as *.warc.gz in `folder`; file, records, bytes.

    A task writes its own archives under the names of its attempt and renames each when it
    is complete. The returned table lists the archives of the attempts that succeeded;
    whatever a lost executor leaves is not on the list and is never read.
    """
    run = uuid.uuid4().hex

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{run}-{context.partitionId():06d}-{context.taskAttemptId()}"
        done: list[tuple[str, int, int]] = []
        out, count, size = None, 0, 0

        def close() -> None:
            out.close()
            final = f"{name}-{len(done):05d}.warc.gz"
            store.move(f"{root}/{name}.open", f"{root}/{final}")
            done.append((f"{folder.rstrip('/')}/{final}", count, size))

        for row in _rows(batches):
            data = record_bytes(row["kind"], row["id"], row["url"], row["payload"],
                                sha1_base32(row["payload"]), row["refers_to"])
            if out is None:
                out, count, size = store.open_output_stream(
                    f"{root}/{name}.open", compression=None), 0, 0
            out.write(data)
            count, size = count + 1, size + len(data)
            if size >= archive_bytes:
                close()
                out = None
        if out is not None:
            close()
        if done:
            files, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(files), pa.array(counts, pa.int64()),
                 pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return settled(records.mapInArrow(write, _WRITTEN))


@dataclass
class Record:
    """One record as it was read; the payload only on demand."""

    offset: int
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_sha1: str = ""
    block_sha1: str = ""
    payload: bytes | None = None

    @property
    def digest_ok(self) -> bool:
        block = self.headers.get("warc-block-digest")
        whole = self.headers.get("warc-payload-digest")
        if block is not None and block != f"sha1:{self.block_sha1}":
            return False
        if self.headers.get("warc-type") == "revisit" or whole is None:
            return True
        return whole == f"sha1:{self.payload_sha1}"


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    found: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"not a header: {line[:80]!r}")
        found[name.strip().lower()] = value.strip()
    return first, found


class _Member:
    """The inflated bytes of one gzip member, a piece at a time."""

    def __init__(self, source, ahead: bytes):
        self._source, self._ahead = source, ahead
        self._inflate = zlib.decompressobj(31)
        self.taken = 0

    def read(self, most: int = READ_BYTES) -> bytes:
        """Some bytes, none at the end of the member."""
        while not self._inflate.eof:
            if not self._ahead:
                self._ahead = self._source.read(READ_BYTES)
                if not self._ahead:
                    raise BadArchive("the archive ends within a record")
            before = len(self._ahead)
            piece = self._inflate.decompress(self._ahead, most)
            self._ahead = (self._inflate.unused_data if self._inflate.eof
                           else self._inflate.unconsumed_tail)
            self.taken += before - len(self._ahead)
            if piece:
                return piece
        return b""

    @property
    def rest(self) -> bytes:
        return self._ahead


class _Framed:
    """Reads a member by markers and lengths."""

    def __init__(self, member: _Member):
        self._member, self._held = member, b""

    def until(self, marker: bytes, limit: int) -> bytes:
        while marker not in self._held:
            if len(self._held) > limit:
                raise BadArchive("headers are too long")
            piece = self._member.read()
            if not piece:
                raise BadArchive("the record ends within its headers")
            self._held += piece
        head, _, self._held = self._held.partition(marker)
        return head

    def pieces(self, length: int) -> Iterator[bytes]:
        while length:
            piece = self._held or self._member.read()
            if not piece:
                raise BadArchive("the record is shorter than its Content-Length")
            yield piece[:length]
            self._held = piece[length:]
            length -= min(length, len(piece))

    def end(self) -> None:
        rest = self._held
        while piece := self._member.read():
            rest += piece
            if len(rest) > 4:
                break
        if rest != b"\r\n\r\n":
            raise BadArchive("the record is longer than its Content-Length")


def read_archive(source, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an open archive, one after the other.

    Holds one piece of input and one of output; a payload is only kept on demand. A digest
    that does not match is reported in `digest_ok`; bytes that break the framing raise
    BadArchive.
    """
    ahead, offset = source.read(READ_BYTES), 0
    while ahead:
        member = _Member(source, ahead)
        framed = _Framed(member)
        version, headers = _headers(framed.until(b"\r\n\r\n", HEADER_BYTES))
        if not version.startswith("WARC/1."):
            raise BadArchive(f"not a WARC record: {version[:40]!r}")
        record = Record(offset, headers)
        _read_block(record, framed, int(headers["content-length"]), keep_payload)
        framed.end()
        yield record
        offset += member.taken
        ahead = member.rest or source.read(READ_BYTES)


def _read_block(record: Record, framed: _Framed, length: int, keep: bool) -> None:
    block, payload, head, kept = hashlib.sha1(), hashlib.sha1(), b"", []
    in_payload, size = False, 0
    for piece in framed.pieces(length):
        block.update(piece)
        if not in_payload:
            head += piece
            if len(head) > HEADER_BYTES and b"\r\n\r\n" not in head[:HEADER_BYTES]:
                raise BadArchive("HTTP headers are too long")
            start, marker, piece = head.partition(b"\r\n\r\n")
            if not marker:
                continue
            in_payload, record.http = True, _headers(start)[1]
        payload.update(piece)
        size += len(piece)
        if keep:
            kept.append(piece)
    if length and not in_payload:
        raise BadArchive("no end of the HTTP headers")
    record.payload_bytes = size
    record.payload_sha1 = base64.b32encode(payload.digest()).decode()
    record.block_sha1 = base64.b32encode(block.digest()).decode()
    record.payload = b"".join(kept) if keep else None


def read_archives(files: DataFrame) -> DataFrame:
    """One row per record of the archives listed in `files` (column file), read in parallel.

    For a revisit, payload_bytes and payload_digest are those its headers state. A record
    whose bytes do not match its digests has digest_ok false.
    """
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as source:
                    rows: list[tuple] = []
                    for record in read_archive(source):
                        rows.append(_row(record, uri))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    # an archive is the unit of work
    tasks = max(1, files.count())
    return files.select("file").repartition(tasks).mapInArrow(read, _RECORDS)


def _row(record: Record, uri: str) -> tuple:
    h = record.headers
    revisit = h.get("warc-type") == "revisit"
    return (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"),
            h.get("warc-refers-to"),
            int(record.http.get("content-length", 0)) if revisit else record.payload_bytes,
            h.get("warc-payload-digest", "sha1:").removeprefix("sha1:") if revisit
            else record.payload_sha1,
            record.digest_ok, uri, record.offset)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 4 + (pa.int64(), pa.string(), pa.bool_(), pa.string(),
                                  pa.int64())
    names = [part.split()[0] for part in _RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds,
                                                        strict=True)], names)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str,
                  identity: str = "page_id", payload: str = "html", url: str = "url",
                  least_bytes: int = 0) -> DataFrame:
    """Writes one record per page and reads the archives back.

    Columns: identity, payload_bytes, payload_digest, record_type, refers_to, digest_ok.
    Null payload: empty. Null url: no target URI. Repeated rows: a record each. Null ids:
    written as such. No rows: no archives and no rows. Other columns are not read. What was
    read is held against its digests (`verified`): a damaged archive ends the job.
    """
    written = write_archives(choose_records(pages, identity, payload, url, least_bytes),
                             folder)
    kind = pages.schema[identity].dataType

    def page(column: str):
        return F.when(F.col(column).startswith("<urn:page:"), F.regexp_extract(
            column, "(?s)^<urn:page:(.*)>$", 1)).cast(kind)

    return verified(settled(read_archives(written))).select(
        page("record_id").alias(identity), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"), "digest_ok")


def verified(records: DataFrame) -> DataFrame:
    """`records` as they are if all of them agree with their digests, else BadArchive.

    A response's digests are those of the bytes that were read. A revisit has no payload: the
    length and digest it states must be those of the response it refers to, and there has to
    be one. Responses and revisits are summed per response, so a payload that most records
    share is one row to compare. Reads `records` twice, so it should be stored.
    """
    revisit = F.col("record_type") == "revisit"
    damaged = records.filter(~F.col("digest_ok")).select(
        F.concat(F.lit("damaged record "), F.coalesce("record_id", F.lit("without id")),
                 F.lit(" in "), "file").alias("problem"))
    stated = records.groupBy(F.when(revisit, F.col("refers_to")).otherwise(
        F.col("record_id")).alias("response")).agg(
        F.count_if(~revisit).alias("responses"), F.count_if(revisit).alias("revisits"),
        F.min("payload_digest").alias("d1"), F.max("payload_digest").alias("d2"),
        F.min("payload_bytes").alias("b1"), F.max("payload_bytes").alias("b2"))
    unlike = stated.filter((F.col("revisits") > 0) & (
        (F.col("responses") == 0) | F.col("response").isNull()
        | (F.col("d1") != F.col("d2")) | (F.col("b1") != F.col("b2")))).select(
        F.concat(F.lit("revisits unlike their response "),
                 F.coalesce("response", F.lit("without id"))).alias("problem"))
    problems = [r["problem"] for r in damaged.unionByName(unlike).limit(5).collect()]
    if problems:
        raise BadArchive("; ".join(problems))
    return records
