"""WARC archives: writer, monolithic gzip normaliser with a sidecar offset index, and indexed reader.

``normalise`` inflates an archive that is one gzip stream (or several) once, in bounded pieces, rewrites every record
as a gzip member of its own and writes a sidecar index beside it, one JSON line a record.  Files live in the shared
folder; each is written under a name of its own attempt and renamed when whole, so a task that runs again replaces
nothing half-written.

Null html is an empty payload.  Of records with equal payloads of at least ``min_bytes`` bytes the one with the
largest id is the response and the others are revisits of it; rows that repeat an id with the same payload are all
responses when that id is the largest.  A row with a null id revisits the largest id of its payload, or is a response
when its group has none.  Empty tables give no archives and no rows.  Columns other than id, url and html are not read.  An archive that
is cut off, or that holds anything but whole gzip members and zero padding, raises.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices, written

PIECE = 1 << 20
ARCHIVE_BYTES = 512 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _uri(url: str) -> str:
    """A URL that fits a header line: blanks and control characters are written as their bytes in hex."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id: int | None, payload: bytes, refers_to: int | None = None, url: str | None = None) -> bytes:
    """One response, or a revisit without a payload, with its closing blank lines."""
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_id(page_id)}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Target-URI", _uri(url))] if url else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("Payload-Length", str(len(payload))),
    ]
    if revisit:
        head += [("WARC-Refers-To", f"<{_id(refers_to)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Inflated:
    """The bytes of a gzip file of one or more members, read in pieces.  Zero bytes after a member are padding; a member
    that does not reach its end, checksum and length included, raises ``ValueError``, and so does anything else."""

    def __init__(self, source) -> None:
        self.source, self.more, self.data, self.rest = source, None, bytearray(), b""

    def _fill(self) -> bool:
        while True:
            raw = self.rest or self.source.read(PIECE)
            self.rest = b""
            if self.more is None:
                if not raw:
                    return False
                self.rest = raw.lstrip(b"\0")
                if not self.rest:
                    continue
                raw, self.rest, self.more = self.rest, b"", zlib.decompressobj(31)
            try:
                got = self.more.decompress(raw, PIECE)
            except zlib.error as e:
                raise ValueError(f"no gzip stream: {e}") from e
            if self.more.eof:
                self.rest, self.more = self.more.unused_data, None
            elif not raw and not got:
                raise ValueError("a gzip member is cut off")
            else:
                self.rest = self.more.unconsumed_tail
            if got:
                self.data += got
                return True

    def until(self, mark: bytes) -> bytes:
        """Up to ``mark`` and with it; nothing at the end."""
        at = 0
        while (i := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            if not self._fill():
                if self.data.strip():
                    raise ValueError("a record is cut off")
                return b""
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self._fill():
                raise ValueError("a record is cut off")
            out = self.take(min(n, len(self.data)))
            n -= len(out)
            yield out


class _Counted:
    def __init__(self, sink) -> None:
        self.sink, self.at = sink, 0

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)


def normalise(source, sink, level: int = 6) -> Iterator[dict]:
    """Rewrite ``source`` to ``sink`` with a gzip member for each record; yields the index entry of each."""
    stream, out = Inflated(source), _Counted(sink)
    while head := stream.until(b"\r\n\r\n"):
        known = headers(head)
        begin, member = out.at, zlib.compressobj(level, zlib.DEFLATED, 31)
        out.write(member.compress(head))
        for piece in stream.pieces(int(known["content-length"]) + 4):
            out.write(member.compress(piece))
        out.write(member.flush())
        yield {"offset": begin, "length": out.at - begin, "id": known.get("warc-record-id"), "type": known.get("warc-type"), "digest": known.get("warc-payload-digest")}


def _open(uri: str):
    """The file system and path of a URI; what Hadoop calls ``s3a`` or ``s3n`` is ``s3`` here."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _write_file(uri: str, write) -> None:
    """``write(stream)`` to a file that gets its name when it is whole."""
    files, path = _open(uri)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with files.open_output_stream(own, compression=None) as sink:
        write(sink)
    files.move(own, path)


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: ``refers_to`` is the response's id for revisits, ``url`` null where pages have
    none.  Payload groups meet by digest as
    counts and maxima; pages then join only the groups of two or more, a join whose hot digests Spark can split."""
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col("page_id").alias("page_id"), url.alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    own = own.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = own.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    joined = own.join(groups.select("sha", "response"), "sha", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("response")), F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Monolithic archives of ``pages(page_id, url, html, refers_to)``; one row ``path, records`` for each, already written."""
    spark = pages.sparkSession
    files, path = _open(folder)
    files.create_dir(path, recursive=True)

    def run(batches):
        part, names, counts = TaskContext.get().partitionId(), [], []
        rows = ((p, u, h or "", r) for batch in batches for cut in slices(batch, "html") for p, u, h, r in zip(*(c.to_pylist() for c in cut.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            name, n = f"{folder}/a{part:06d}-{len(names):04d}.warc.gz", 0

            def write(sink) -> None:
                nonlocal row, n
                stream, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                while row is not None and size < archive_bytes:
                    raw = record(row[0], row[2].encode("utf-8", "replace"), row[3], row[1])
                    sink.write(stream.compress(raw))
                    size, n, row = size + len(raw), n + 1, next(rows, None)
                sink.write(stream.flush())

            _write_file(name, write)
            names.append(name)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "archives")


def _spread(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """One archive a task, or nearly: as many tasks as archives, each with a range of their names."""
    return archives.repartitionByRange(max(1, archives.count()), "path")


def normalise_archives(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Each archive of ``archives(path)`` rewritten to ``folder`` with its sidecar ``.idx``; rows ``path, records``."""
    spark = archives.sparkSession
    files, path = _open(folder)
    files.create_dir(path, recursive=True)

    def run(batches):
        for batch in batches:
            names, counts = [], []
            for source in batch.column(0).to_pylist():
                target = f"{folder}/{source.rpartition('/')[2]}"
                index: list[bytes] = []
                inner, at = _open(source)

                def write(sink, inner=inner, at=at, index=index) -> None:
                    with inner.open_input_stream(at, compression=None) as raw:
                        index += (json.dumps(e).encode() + b"\n" for e in normalise(raw, sink, level))

                _write_file(target, write)
                _write_file(f"{target}.idx", lambda sink, index=index: sink.write(b"".join(index)))
                names.append(target)
                counts.append(len(index))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(_spread(spark, archives).select("path").mapInArrow(run, "path string, records long"), "normalised")


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").rpartition(":")[2]
    return int(text) if text else None


def read_member(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record from its gzip member.  A response's payload is measured and must have the digest that its header names;
    a revisit has both from its headers."""
    data = zlib.decompress(raw, 31)
    at = data.index(b"\r\n\r\n") + 4
    known = headers(data[:at])
    said = known["warc-payload-digest"].removeprefix("sha1:")
    page, kind = _number(known["warc-record-id"]), known["warc-type"]
    if kind == "revisit":
        return page, int(known["payload-length"]), said, kind, _number(known["warc-refers-to"])
    block = memoryview(data)[at : at + int(known["content-length"])]
    payload = bytes(block[data.index(b"\r\n\r\n", at) + 4 - at :])
    if (own := digest_of(payload)) != said:
        raise ValueError(f"record {page}: payload digest {own}, header {said}")
    return page, len(payload), own, kind, None


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of normalised archives, each found by its sidecar entry and inflated alone."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = _open(uri)
                rows = []
                with files.open_input_stream(f"{path}.idx", compression=None) as idx:
                    entries = [json.loads(line) for line in idx.read().splitlines()]
                with files.open_input_file(path) as raw:
                    for e in entries:
                        raw.seek(e["offset"])
                        rows.append(read_member(raw.read(e["length"])))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return _spread(archives.sparkSession, archives).select("path").mapInArrow(run, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages written to monolithic archives, normalised, and read back."""
    base = scratch_path(pages.sparkSession, "warc")
    raw = write_archives(with_roles(pages, min_bytes), f"{base}/raw")
    neat = normalise_archives(raw, f"{base}/neat")
    files, path = _open(f"{base}/raw")
    files.delete_dir(path)  # all of it is in the normalised archives now
    return read_archives(neat)
