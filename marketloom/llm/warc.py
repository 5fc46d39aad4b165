"""WARC archives compressed with Zstandard and a dictionary: writer and reader.

An archive starts with a skippable frame that holds the dictionary; after it comes one
frame per record.  Tasks write archives into the shared folder and return their paths;
only the paths of tasks that succeeded are read, so a repeated task leaves at worst a file
that nobody reads.  Archives are read as streams, one frame in memory at a time.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the
smallest page_id is a response and the others revisit it: they carry its digest and
length, not the payload.

Edge cases: a null html is an empty payload; a null url gives a record without a target;
control characters and blanks of a url are percent-encoded in the header; rows that repeat
the smallest page_id and its payload are all responses; rows without a page_id revisit
where another row has one and are responses otherwise; an empty table writes nothing and reads
as an empty table; other columns are not read.  A damaged record comes back with an
``error`` and without a payload; after a damaged frame the rest of the archive is not
readable, and the error says so.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.shared import materialize, shared_folder
from marketloom.llm.batches import split_batches

REVISIT_BYTES = 100
#: A task starts another archive beyond this size; the sample for the dictionary and the dictionary's size.
ARCHIVE_BYTES = 256 << 20
SAMPLE_PAGES = 1000
SAMPLE_BYTES = 8 << 10
DICTIONARY = 112 << 10
LEVEL = 3
# Fixed values of the file formats
SKIPPABLE_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

READ_SCHEMA = ("path string, position bigint, record_type string, record_id string, target_uri string, refers_to string, "
               "content_length bigint, payload_bytes bigint, payload_digest string, payload binary, error string")


# --- writing -----------------------------------------------------------------


def payload(html: str | Column) -> Column:
    return F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")).cast("binary")


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns page_id, url, payload, digest and ``refers_to`` (null for responses).

    Repeated payloads are found on the digests alone; payloads travel once, dealt by
    page_id, so a payload that a third of the pages have is no hot key for them.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload(F.col(html_col).cast("string")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.filter(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    later = narrow.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first")))
    decided = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    return rows.join(decided, rows["page_id"].eqNullSafe(decided["_id"]) & (rows["digest"] == decided["_digest"]), "left").drop("_id", "_digest")


def train(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from up to ``SAMPLE_PAGES`` different pages with the smallest hashes; empty if they are too few.

    The number of different pages bounds the hash, so that all tasks together send about
    twice as many starts of pages as are chosen, whatever the size of the table.
    """
    text = payload(F.col(html_col).cast("string"))
    starts = pages.select(F.xxhash64(text).alias("h"), F.substring(text, 1, SAMPLE_BYTES).alias("p"))
    different = starts.agg(F.approx_count_distinct("h")).first()[0]
    if different > 2 * SAMPLE_PAGES:
        starts = starts.filter(F.col("h") < int(2**64 * (2 * SAMPLE_PAGES / different)) - 2**63)
    chosen = starts.groupBy("h").agg(F.min("p").alias("p")).orderBy("h").limit(SAMPLE_PAGES).select("p")
    parts = [bytes(r["p"]) for r in chosen.collect() if len(r["p"]) >= 8]
    total = sum(map(len, parts))
    return zstandard.train_dictionary(min(DICTIONARY, total // 8), parts).as_bytes() if len(parts) >= 64 and total >= 64 << 10 else b""


def _clean(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: object, url: str | None, body: bytes, digest: str, refers_to: object, date: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + body
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://") if uri.startswith("file:/") else f"file://{uri}")


class _Archive:
    def __init__(self, folder: str, dictionary: bytes):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, path = _open(self.uri)
        self.out = system.open_output_stream(path, compression=None)  # by its name it would be compressed twice
        self.dict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.frames = zstandard.ZstdCompressor(LEVEL, dict_data=self.dict, write_checksum=True)
        self.size = self.records = 0
        if dictionary:
            packed = zstandard.ZstdCompressor(LEVEL).compress(dictionary)
            self._write(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self._write(self.frames.compress(data))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.records, self.size


def _write_batches(batches: Iterable[pa.RecordBatch], folder: str, dictionary: bytes, date: str) -> Iterator[pa.RecordBatch]:
    archive, done = None, []
    for part in split_batches(batches, "payload"):
        ids, urls, bodies, digests, refers = (c.to_pylist() for c in part.columns)
        for i, u, b, d, r in zip(ids, urls, bodies, digests, refers):
            archive = archive or _Archive(folder, dictionary)
            archive.add(record(i, u, b, d, r, date))
            if archive.size >= ARCHIVE_BYTES:
                done.append(archive.close())
                archive = None
    if archive:
        done.append(archive.close())
    if done:
        yield pa.record_batch([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])


def write(pages: DataFrame, folder: str, dictionary: bytes | None = None, date: str = "2001-08-01T00:00:00Z", **columns: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns path, records and bytes of every archive."""
    dictionary = train(pages, columns.get("html_col", "html")) if dictionary is None else dictionary
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    rows = with_revisits(pages, **columns).select("page_id", "url", "payload", "digest", "refers_to")
    return materialize(rows.mapInArrow(lambda it: _write_batches(it, folder, dictionary, date), "path string, records bigint, bytes bigint"))


# --- reading -----------------------------------------------------------------


class Damaged(ValueError):
    """What is wrong with a frame or record."""


class _Stream:
    """Whole frames of a stream, read in pieces."""

    def __init__(self, source, piece: int = 1 << 20):
        self.source, self.piece, self.data, self.at, self.position = source, piece, b"", 0, 0

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            more = self.source.read(max(self.piece, n - len(self.data) + self.at))
            if not more:
                return False
            self.data, self.at = self.data[self.at:] + more, 0
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise Damaged("the archive ends inside a frame")
        out = self.data[self.at:self.at + n]
        self.at += n
        self.position += n
        return out

    def peek(self, at: int, n: int) -> bytes:
        if not self.need(at + n):
            raise Damaged("the archive ends inside a frame")
        return self.data[self.at + at:self.at + at + n]

    def frame(self) -> bytes:
        """The next frame: its header, blocks up to the last one, and its checksum."""
        start = self.peek(0, 6)
        if struct.unpack("<I", start[:4])[0] != ZSTD_MAGIC:
            raise Damaged("no Zstandard frame where a record should start")
        flags = start[4]
        single = flags >> 5 & 1
        end = 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        while True:
            head = int.from_bytes(self.peek(end, 3), "little")
            kind, size = head >> 1 & 3, head >> 3
            if kind == 3:
                raise Damaged("a block of a reserved kind")
            end += 3 + (1 if kind == 1 else size)
            if head & 1:
                return self.take(end + 4 * (flags >> 2 & 1))


def _leading_dictionary(stream: _Stream) -> bytes:
    if not stream.need(8):
        return b""
    magic, size = struct.unpack("<II", stream.peek(0, 8))
    if magic != SKIPPABLE_MAGIC:
        return b""
    stream.take(8)
    data = stream.take(size)
    if data[:4] == struct.pack("<I", ZSTD_MAGIC):
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def _urn(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("urn:page:") or None


def parsed(data: bytes) -> dict:
    """Fields of one record; raises ``Damaged`` where headers and lengths do not agree."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise Damaged("no WARC version line or end of headers")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise Damaged(f"bad header line {line[:60]!r}")
        fields[name.lower()] = value.strip()
    if missing := [r for r in REQUIRED if r not in fields]:
        raise Damaged(f"without {', '.join(missing)}")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        raise Damaged(f"Content-Length {fields['content-length']} of a block of {len(rest) - 4} bytes")
    out = {
        "record_type": fields["warc-type"], "record_id": _urn(fields["warc-record-id"]), "target_uri": fields.get("warc-target-uri"),
        "refers_to": _urn(fields.get("warc-refers-to")), "content_length": len(rest) - 4, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None}
    block = rest[:-4]
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, body = block.partition(b"\r\n\r\n")
        said = [v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length"]
        if not gap or not http.startswith(b"HTTP/") or len(said) != 1 or not said[0].isdigit():
            raise Damaged("no HTTP head with a Content-Length")
        out["payload_bytes"] = int(said[0])
    else:
        body = block
        out["payload_bytes"] = len(block)
    if out["record_type"] == "revisit":
        if body or out["refers_to"] is None:
            raise Damaged("a revisit with a payload or without a record it refers to")
        return out
    if len(body) != out["payload_bytes"]:
        raise Damaged(f"payload of {len(body)} bytes, {out['payload_bytes']} announced")
    if out["payload_digest"] and hashlib.sha256(body).hexdigest() != out["payload_digest"]:
        raise Damaged("the payload has another digest")
    return out | {"payload": body}


def records(path: str) -> Iterator[dict]:
    """All records of an archive, one frame at a time."""
    system, name = _open(path)
    with system.open_input_stream(name, compression=None) as source:
        stream = _Stream(source)
        position = 0
        try:
            dictionary = _leading_dictionary(stream)
            frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            while stream.need(1):
                position = stream.position
                frame = stream.frame()
                inner = frames.decompressobj()
                data = inner.decompress(frame)
                if not inner.eof:
                    raise Damaged("an unfinished frame")
                try:
                    yield {"position": position} | parsed(data)
                except Damaged as wrong:
                    yield {"position": position, "error": str(wrong)}
        except (Damaged, zstandard.ZstdError) as wrong:
            yield {"position": position, "error": f"{wrong}; the rest of the archive is not read"}


def _read_batches(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column(0).to_pylist():
            rows, size = [], 0
            for r in records(path):
                rows.append({"path": path} | r)
                size += len(r.get("payload") or b"")
                if size > 4 << 20 or len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read(archives: DataFrame) -> DataFrame:
    """The records of the archives named in column ``path``, in ``READ_SCHEMA``."""
    names = [c.split() for c in READ_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in names])
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("path").repartition(n, "path").mapInArrow(lambda it: _read_batches(it, schema), READ_SCHEMA)


def checked(rows: DataFrame) -> DataFrame:
    """The records; the job fails at the first one that is damaged."""
    why = F.concat_ws(" ", "path", F.col("position").cast("string"), "error")
    return rows.withColumn("record_type", F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(why).cast("string")))


def remove(folder: str) -> None:
    system, path = _open(folder)
    system.delete_dir(path)


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages``, read the archives back, and drop them: the records without their payloads."""
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = checked(read(write(pages, folder)))
    kind = pages.schema["page_id"].dataType
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    out = materialize(rows.select(
        F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "target_uri"))
    remove(folder)
    return out
