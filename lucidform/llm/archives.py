"""WARC archives with one Zstandard frame a record and a dictionary trained on the records.

A file opens with a skippable frame that holds the dictionary; a warcinfo record and a frame for each record follow.
Records with a payload that an earlier one has are revisits.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucidform.llm.common import bounded_batches, cut, file_system, make_folder, shared_folder

#: Records that the dictionary is trained on, about; bytes of each of them; bytes of the dictionary.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 32 << 10, 64 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
# fixed values of the format
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGES = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def train(pages: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from about ``sample`` different records; empty if they are too few to train on.

    Records are drawn by a hash of page_id and payload, and equal rows once, so neither a repeated page_id nor copies
    add to what the driver gets.
    """
    share = min(1.0, sample / max(1, pages.count()))
    drawn = pages.withColumn("draw", F.xxhash64("page_id", "html", F.lit(5)))
    chosen = drawn.where(F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["draw"])
    clipped = chosen.select(F.expr(f"substring(encode(html, 'UTF-8'), 1, {SAMPLE_BYTES})").alias("html")).where("html IS NOT NULL AND octet_length(html) > 8")
    parts = sorted(bytes(r["html"]) for r in clipped.collect())
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1, refers_to): refers_to is the smallest page_id with the same payload, if another.

    Null html is an empty payload.  Rows that repeat the smallest page_id are all responses; a null page_id is never
    referred to.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    copied = cut(rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied-payloads")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return rows.join(copied, "sha1", "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _page_record(page_id: int | None, url: str | None, html: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    target = None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", digest), ("WARC-Refers-To", name(refers_to) if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("X-Payload-Length", len(html)), ("Content-Type", "application/http;msgtype=response"),
    ]
    return _record(fields, head if revisit else head + html)


def write_archives(pages: DataFrame, folder: str | None = None, date: str = DATE, level: int = LEVEL) -> DataFrame:
    """Write a record for each page, an archive for each task that has rows: (path, records, bytes).

    Files are named by attempt; only those of committed tasks are listed.  Columns other than page_id, url and html
    are ignored; an empty table makes no archive.
    """
    folder = folder or shared_folder(pages.sparkSession, "archives")
    make_folder(folder)
    dictionary = train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = f"{folder}/{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.zst"
        fs, local = file_system(target)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        out, records = None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = fs.open_output_stream(local)
                if dictionary:
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                out.write(packer.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            cols = [batch.column(c) for c in ("page_id", "url", "sha1", "refers_to")]
            for lo in range(0, batch.num_rows, 256):
                part = [c.slice(lo, 256).to_pylist() for c in cols]
                for (page, url, sha1, refers), html in zip(zip(*part), batch.column("html").slice(lo, 256).cast(pa.binary()).to_pylist()):
                    out.write(packer.compress(_page_record(page, url, html, sha1, refers, date)))
                    records += 1
        if out:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    bounded_batches(pages)
    return cut(with_originals(pages).mapInArrow(run, "path string, records bigint, bytes bigint"), "archive-list")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (by lower-case name) and block of each record of a decompressed archive."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should start")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        block = stream.read(int(fields["content-length"]))
        stream.read(4)
        yield fields, block


def open_archive(file) -> io.BufferedReader:
    """The records of an archive, decompressed with the dictionary that stands before them."""
    head = file.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        dictionary = zstandard.ZstdCompressionDict(file.read(struct.unpack("<II", head)[1]))
        head = b""
    source = io.BufferedReader(_Joined(head, file), 1 << 20) if head else file
    return io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20)


class _Joined(io.RawIOBase):
    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data, self.head = (self.head[: len(buffer)], self.head[len(buffer) :]) if self.head else (self.rest.read(len(buffer)), b"")
        buffer[: len(data)] = data
        return len(data)


def _page(urn: str | None) -> int | None:
    number = (urn or "<urn:page:none>")[10:-1]
    return None if number == "none" else int(number)


def _url(target: str | None) -> str | None:
    return None if target is None else target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def read_archives(listed: DataFrame) -> DataFrame:
    """Pages from archives (path): (page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload).

    Bytes and digest of responses are computed from the payload read and must equal the header's; those of revisits,
    whose payload is null, are the header's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, local = file_system(path)
                with fs.open_input_stream(local) as file:
                    rows, held = [], 0
                    for fields, block in records(open_archive(file)):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        digest, size, payload = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                                raise ValueError(f"{path}: payload of {fields['warc-record-id']} doesn't match its header")
                            held += size
                        rows.append((_page(fields["warc-record-id"]), _url(fields.get("warc-target-uri")), kind, size, digest, _page(fields.get("warc-refers-to")), payload))
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    files = listed.count()
    return listed.select("path").repartition(max(1, files)).mapInArrow(run, PAGES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


#: The digest in base 32: 20 bits of the hexadecimal digest are four characters.
_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {1 + 5 * i}, 5) AS BIGINT) >> {s}) & 31) + 1 AS BIGINT), 1)" for i in range(8) for s in (15, 10, 5, 0))
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_CHARS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
