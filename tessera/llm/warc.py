"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame a record."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from urllib.parse import quote, urlsplit, urlunsplit

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, least_hashed, staged, tidy

SKIPPABLE = 0x184D2A5D  # the skippable frame that holds a dictionary
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes of compressed records after which a task begins another archive.
ROLL_BYTES = 64 << 20
#: Payloads that train the dictionary, its size, and the rows of a broadcast table of duplicates at most.
DICTIONARY_SAMPLES, DICTIONARY_BYTES, BROADCAST_ROWS = 256, 64 << 10, 200_000
#: Bytes read at a time: what follows a frame is copied, so this is kept to a few records.
READ = 1 << 16


class WarcError(ValueError):
    """A record or an archive that breaks the format."""


# -- one archive ------------------------------------------------------------------------------------------------------


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or none where the samples are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if s]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _line(value: object) -> str:
    return "".join(c if c.isprintable() else quote(c) for c in str(value))


def _url(value: str) -> str:
    """A URL in ASCII without spaces or control characters; what is encoded already stays."""
    p = urlsplit(value) if "[" not in value else None
    return urlunsplit((p.scheme, quote(p.netloc, safe=":@%"), *(quote(x, safe="/%:=&?~#+!$,;'@()*[]") for x in p[2:]))) if p else quote(value, safe="/%:=&?~#+!$,;'@()*[]")


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record with an HTTP block, or a revisit record whose block keeps the HTTP headers only."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = {"WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = _url(url)
    if refers_to:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>"}
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {_line(v)}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _headers(data: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in data.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"{what}: a header without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def _length(value: str | None) -> int:
    if value is None or not value.isdecimal():
        raise WarcError("Content-Length is missing or not a number")
    return int(value)


def parse(data: bytes) -> dict:
    """A record's headers and payload, after checks of version, headers, lengths, end and digests."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not found or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("not a WARC record")
    h = _headers(lines, "record")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - h.keys():
        raise WarcError(f"missing headers: {sorted(missing)}")
    n = _length(h["content-length"])
    block = rest[:n]
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {n}, and {len(rest)} bytes follow the headers")
    out = {"record_id": h["warc-record-id"].strip("<>"), "record_type": h["warc-type"], "url": h.get("warc-target-uri"), "refers_to": h["warc-refers-to"].strip("<>") if "warc-refers-to" in h else None, "date": h["warc-date"]}
    if (said := h.get("warc-block-digest", "")).startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise WarcError("the block's digest differs")
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
    payload: bytes | None = block
    size = n
    if h.get("content-type", "").startswith("application/http"):
        http, ended, payload = block.partition(b"\r\n\r\n")
        if not ended:
            raise WarcError("the HTTP headers don't end")
        size = _length(_headers(http.partition(b"\r\n")[2], "HTTP").get("content-length"))
    if h["warc-type"] == "revisit":
        if payload or digest is None or not out["refers_to"]:
            raise WarcError("a revisit needs a digest and a reference, and has no payload")
        payload = None
    else:
        if len(payload) != size:
            raise WarcError(f"the payload has {len(payload)} bytes, its header says {size}")
        own = hashlib.sha256(payload).hexdigest()
        if digest not in (None, own):
            raise WarcError("the payload's digest differs")
        digest = own
    return out | {"payload_bytes": size, "payload_digest": digest, "payload": payload}


def begin(out: BinaryIO, dictionary: bytes) -> zstandard.ZstdCompressor:
    """Write the leading frame (none without a dictionary); the compressor makes a frame of each record."""
    if not dictionary:
        return zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True, write_content_size=True)


def frames(src: BinaryIO) -> Iterator[bytes]:
    """The content of each frame of an archive, read as a stream."""
    data = src.read(8)
    made = zstandard.ZstdDecompressor()
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        n = struct.unpack("<I", data[4:])[0]
        body = src.read(n)
        if len(body) != n:
            raise WarcError("the dictionary is cut short")
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=64 << 20)
        made, data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)), b""
    frame, parts = None, []
    while True:
        if not data:
            data = src.read(READ)
            if not data:
                break
        frame = frame or made.decompressobj()
        try:
            parts.append(frame.decompress(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"a damaged frame: {e}") from e
        data = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame, parts = None, []
    if frame is not None:
        raise WarcError("the last frame is cut short")


# -- tables -----------------------------------------------------------------------------------------------------------

_MANIFEST = "path string, records long, bytes long"


def write_warc(rows: DataFrame, where: str, dictionary: bytes, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archives of rows (record_id, url, payload, refers_to) under `where`; a row (path, records, bytes) for each.

    A null or empty payload is a record without one, however long a payload is it is one record, repeated rows are
    records each, other columns are ignored, and without rows there is no archive.

    A task writes under a name of its own and renames at the end, so a repeated task replaces what the first left.
    """
    known = rows.sparkSession.sparkContext.broadcast(dictionary)

    @tidy
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(where)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), ctx.taskAttemptId()
        out = compress = None
        done, n, count = [], 0, 0

        def close():
            out.close()
            fs.move(tmp, path)
            done.append((path, count, n))

        for b in batches:
            for rid, url, payload, ref in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None:
                    path = f"{base}/part-{part:06d}-{len(done):04d}.warc.zst"
                    tmp = f"{path}.{attempt}.tmp"
                    out, n, count = fs.open_output_stream(tmp, compression=None), 0, 0
                    compress = begin(out, known.value)
                frame = compress.compress(record(rid, url, (payload or "").encode("utf-8", "surrogatepass"), ref))
                out.write(frame)
                n, count = n + len(frame), count + 1
                if n >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return staged(rows.select("record_id", "url", "payload", "refers_to").mapInArrow(write, _MANIFEST), "warc-manifest")


def read_warc(paths: DataFrame, where: str, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in paths.path, in the file system of the URI `where`.

    Columns: record_id, record_type, url, refers_to, date, payload_bytes, payload_digest, payload (binary; null for
    revisits, or without with_payload). Archives are read as streams, one record in memory at a time; a broken header,
    length, digest or frame ends the read with WarcError.
    """
    fields = [("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]

    @tidy
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(where)
        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(path, compression=None) as src:
                    rows, size = [], 0
                    for data in frames(src):
                        rows.append(parse(data) if with_payload else parse(data) | {"payload": None})
                        size += len(data) if with_payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], names=[k for k, _ in fields])
                            rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], names=[k for k, _ in fields])

    return paths.select("path").repartition(max(1, min(10_000, paths.count()))).mapInArrow(read, "record_id string, record_type string, url string, refers_to string, date string, payload_bytes long, payload_digest string, payload binary")


def archive_pages(pages: DataFrame, least: int = 100, where: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Archives of a table of pages, as (manifest, folder); equal payloads of `least` bytes or more are stored once.

    The row with the smallest id of such a group is the response, the others revisit it; smaller payloads are all
    responses. Null html is an empty payload, a null url leaves the header out. Ids are never null in such a group's
    reference; rows that repeat one id and payload are all responses; a row with a null id revisits its group's
    smallest id. An empty table makes no archive; other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2(F.col("payload").cast("binary"), 256))))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    groups = staged(groups.select("digest", "first"), "warc-groups")
    if groups.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:  # payloads without a digest aren't shuffled, and rows of one digest can be split, as `groups` is a stored table
        alone = rows.where("digest is null").withColumn("first", F.lit(None).cast(groups.schema["first"].dataType))
        rows = rows.where("digest is not null").join(groups, "digest", "left").unionByName(alone)
    rows = rows.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("record_id"), "url", "payload",
        F.when(~F.col("first").eqNullSafe(F.col("id")), F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
    )
    sample = least_hashed(pages.select(F.col(html_col).alias("x")).where(F.octet_length("x").between(1, 64 << 10)), ["x"], DICTIONARY_SAMPLES)
    dictionary = train_dictionary([r[0].encode("utf-8", "surrogatepass") for r in sample.collect()])
    where = where or fresh_path(spark, "warc")
    return write_warc(rows, where, dictionary), where


def page_of(record_id: str):
    return F.when(F.col(record_id) != "urn:page:null", F.substring_index(record_id, ":", -1).cast("long"))
