"""WARC archives compressed by Zstandard: a dictionary in the leading skippable frame, a frame per record.

Every task writes archives of bounded size into the shared folder and tells their paths; a table of
the paths, never the driver's memory, leads to them. The reader loads an archive's dictionary,
decompresses one frame at a time, and checks each record's version, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Skippable frame that holds a dictionary, and the magic numbers of a dictionary and a frame.
DICT_FRAME, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: An archive is closed after so many bytes; its dictionary is trained on so many bytes of its own first records.
ARCHIVE_BYTES, TRAIN_BYTES, DICT_BYTES, LEVEL = 32 << 20, 2 << 20, 64 << 10, 3
#: Payloads of fewer bytes are never revisits; the copies of a payload are dealt over so many parts.
LEAST_BYTES, SALTS = 0, 16


class BadRecord(ValueError):
    """A record or frame that breaks the format."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int, serial: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{serial}')}>"


def build(page: int | None, url: str | None, payload: bytes, refers_to: int | None, *, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit record that names the response and holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c for c in (url or "") if c > " ") or "urn:none"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date), ("WARC-Target-URI", target)]
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Page-ID", "" if page is None else str(page))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload (null in a revisit) of one record, checked."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] != VERSION:
        raise BadRecord(f"no {VERSION} record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name in fields:
            raise BadRecord(f"bad header: {line[:80]!r}")
        fields[name] = value.strip()
    if missing := [n for n in NEEDED if n not in fields]:
        raise BadRecord(f"missing: {missing}")
    length = fields["Content-Length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord(f"Content-Length {length} in a record with {len(rest) - 4} bytes")
    block = rest[:-4]
    if fields.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise BadRecord("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
    if not gap or size is None:
        raise BadRecord("no HTTP header")
    told = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != told):
        raise BadRecord("the payload's length or digest differs")
    if kind == "revisit" and (payload or fields.get("WARC-Profile") != PROFILE or "WARC-Refers-To" not in fields):
        raise BadRecord("a revisit needs a profile and a record it refers to, and no payload")
    if kind not in ("response", "revisit"):
        raise BadRecord(f"unknown type {kind!r}")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("Page-ID"), "record_type": kind, "payload_bytes": size, "payload_digest": told, "refers_to": number("Refers-To-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


def trained(first: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of an archive's first records; none if they are too few or too short to train on."""
    if len(first) < 16 or sum(map(len, first)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, first)) // 8), first)
    except zstandard.ZstdError:
        return None


def leading(dictionary: zstandard.ZstdCompressionDict | None) -> bytes:
    """The skippable frame with the dictionary, itself compressed; empty without one."""
    if dictionary is None:
        return b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
    return struct.pack("<II", DICT_FRAME, len(packed)) + packed


def frames(source: io.RawIOBase, *, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, each decompressed from its own frame, from a stream of which only a part is held."""
    head = source.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICT_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        data = source.read(size)
        if len(data) != size:
            raise BadRecord("the dictionary is cut short")
        if len(data) >= 4 and struct.unpack("<I", data[:4])[0] == FRAME_MAGIC:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
        if len(data) < 4 or struct.unpack("<I", data[:4])[0] != DICT_MAGIC:
            raise BadRecord("the leading frame holds no dictionary")
        dictionary, head = zstandard.ZstdCompressionDict(data), b""
    engine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    rest = head
    while True:
        if not rest:
            rest = source.read(chunk)
            if not rest:
                return
        one, out = engine.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := source.read(chunk)):
                raise BadRecord("a frame is cut short")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)


def revisits(pages: DataFrame, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, _sha and refers_to: of pages with equal payloads of at least least_bytes bytes, all but the largest page_id refer to it. Payloads are compared by SHA-1 and length, which are all that is shuffled; counting by payload is partly done before the shuffle, and the copies of one payload meet their response in SALTS parts."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    told = pages.select("page_id", F.sha1(payload).alias("_sha"), F.length(payload).alias("_len")).filter(F.col("_len") >= least_bytes)
    top = told.groupBy("_sha", "_len").agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).filter(F.col("_n") > 1)
    top = top.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = told.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return told.join(top, ["_sha", "_len", "_salt"]).filter(F.col("page_id") != F.col("_top")).select("page_id", "_sha", F.col("_top").alias("refers_to")).distinct()


def write(pages: DataFrame, *, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Archives of all pages (page_id, url, html; other columns don't matter): a record for each row; returns a written table of the archives: path, n_records, n_bytes. A null html is an empty payload, a null url none. Rows with a null page_id are responses; rows that repeat a page_id and its html are as many records, of one kind; an empty table gives no archive. Only archives of tasks that ended are in the table, so what a lost executor left is never read."""
    spark = common.prepare(pages.sparkSession)
    where = common.new_path(spark, "warc")
    where = where if "://" in where or where.startswith("file:") else "file://" + where
    tagged = pages.select("page_id", "url", "html", F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8")).alias("_sha"))
    of = tagged.join(revisits(pages, least_bytes=least_bytes), ["page_id", "_sha"], "left").select("page_id", "url", "html", "refers_to")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = fs.FileSystem.from_uri(where)
        store.create_dir(base, recursive=True)
        serial = 0

        def closed(records: Iterator[bytes], first: list[bytes]) -> pa.RecordBatch:
            nonlocal serial
            path = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{serial:04d}.warc.zst"
            serial += 1
            dictionary = trained(first)
            engine = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
            n = size = 0
            with store.open_output_stream(path) as out:
                out.write(head := leading(dictionary))
                size += len(head)
                for r in chain(first, records):
                    out.write(packed := engine.compress(r))
                    n, size = n + 1, size + len(packed)
                    if size >= archive_bytes and n >= len(first):
                        break
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n]), pa.array([size])], names=["path", "n_records", "n_bytes"])

        def records() -> Iterator[bytes]:
            for b in batches:
                for lo in range(0, b.num_rows, 64):
                    for page, url, html, refers in zip(*(c.to_pylist() for c in b.slice(lo, 64).columns), strict=True):
                        yield build(page, url, (html or "").encode("utf-8", "surrogatepass"), refers)

        stream = records()
        while True:
            first: list[bytes] = []
            size = 0
            for r in stream:
                first.append(r)
                size += len(r)
                if size >= train_bytes:
                    break
            if not first:
                return
            yield closed(stream, first)

    made = of.mapInArrow(each, "path string, n_records long, n_bytes long")
    return common.materialize(made.withColumn("store", F.lit(where)), "archives")


def read(archives: DataFrame) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, refers_to, url, html of every record of the archives (path, store); html is null in revisits. A record that breaks the format fails the job."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload")
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())

        def told(rows: list[dict]) -> pa.RecordBatch:
            for r in rows:
                r["payload"] = None if r["payload"] is None else r["payload"].decode("utf-8", "surrogatepass")
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names=[*names[:-1], "html"])

        for b in batches:
            for path, where in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, _ = fs.FileSystem.from_uri(where)
                with store.open_input_stream(path) as source:
                    rows, size = [], 0
                    for record in frames(source):
                        rows.append(parse(record))
                        size += len(record)
                        if size >= 4 << 20:
                            yield told(rows)
                            rows, size = [], 0
                    if rows:
                        yield told(rows)

    spread = archives.select("path", "store").repartition(n, "path")
    return spread.mapInArrow(each, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, html string")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    archives = write(common.table(spark, sf_dir, "pages"))
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
