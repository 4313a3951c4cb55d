"""WARC files of individually compressed records with an embedded Zstandard dictionary.

A file starts with a skippable frame (magic 0x184D2A5D, length, the dictionary as a Zstandard frame); after it each
record is a frame of its own, compressed with that dictionary, so that a record can be read by its place alone. The
dictionary is built from a sample of the distinct archived records, by order of a hash of them, of bounded number and
size; the records of the sample are whole. Where they are too few to train one, the dictionary is what they hold
(Zstandard's raw content). Each task writes its partition to one file in the shared folder, under a name of its
attempt, and renames it when it is complete; a task that runs again writes the same file. The index has the place of
every record.

Defined results: a null or empty html gives a record with an empty payload (null reads back as empty); a null url an
empty target; a null page_id stays null in the index and has no id field in the record; each row is a record, repeated
rows as well, and equal ones are told apart by their place; an empty table gives no file and an empty index. Pages
of any length are archived whole; those of more than an eighth of sample_bytes are not used for the dictionary, and
where no record is left for it the frame holds an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import common as C


@dataclass(frozen=True)
class WarcConfig:
    """sample, sample_bytes: records that the dictionary is built from, and their size, at most; level: of compression."""

    sample: int = 1500
    sample_bytes: int = 16 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"


MAGIC = 0x184D2A5D
_NAME = uuid.UUID("6f1d6a52-2f0b-4c8e-9d8f-2b1f0f4f7a11")


def record(page_id: int | None, url: str | None, html: str | None, cfg: WarcConfig) -> bytes:
    """A WARC/1.1 resource record. Its id follows from the content, so that it is the same in each attempt."""
    body = (html or "").encode()
    url = "".join(c for c in url or "" if c not in "\r\n")
    digest = base64.b32encode(hashlib.sha1(body, usedforsecurity=False).digest()).decode()
    rid = uuid.uuid5(_NAME, f"{page_id}|{url}|{digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {cfg.date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.insert(4, f"X-Page-ID: {page_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame with the dictionary."""
    body = zstd.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", MAGIC, len(body)) + body


def dictionary_of(start: bytes) -> tuple[bytes, int]:
    """(dictionary, length of the leading frame) from a file's first bytes, all of that frame among them."""
    magic, n = struct.unpack("<II", start[:8])
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start")
    return zstd.ZstdDecompressor().decompress(start[8 : 8 + n]), 8 + n


def _dict(data: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(data) if data else None


def _decompressor(data: bytes) -> zstd.ZstdDecompressor:
    return zstd.ZstdDecompressor(dict_data=_dict(data)) if data else zstd.ZstdDecompressor()


def build_dictionary(pages: DataFrame, cfg: WarcConfig) -> bytes:
    """A dictionary of a bounded sample of the distinct records; empty without any."""
    h, n = F.xxhash64("page_id", "url", "html"), F.coalesce(F.octet_length("html"), F.lit(0))
    keys = pages.select(h.alias("h"), n.alias("n")).where(F.col("n") <= cfg.sample_bytes // 8).groupBy("h").agg(F.max("n").alias("n"))
    chosen, left = [], cfg.sample_bytes
    for r in keys.orderBy("h").limit(cfg.sample).collect():
        left -= r["n"]
        if left >= 0:
            chosen.append(r["h"])
    if not chosen:
        return b""
    some = pages.select(h.alias("h"), F.struct("page_id", "url", "html").alias("r")).where(F.col("h").isin(chosen))
    rows = some.groupBy("h").agg(F.first("r").alias("r")).select("h", "r.*").orderBy("h").collect()
    samples = [record(r.page_id, r.url, r.html, cfg) for r in rows]
    try:
        if len(samples) >= 8:
            return zstd.train_dictionary(cfg.dictionary_bytes, samples, k=512, d=8, level=cfg.level).as_bytes()
    except zstd.ZstdError:  # too little to train on
        pass
    return b"".join(samples)[-cfg.dictionary_bytes :]


def write(pages: DataFrame, folder: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes pages to files of folder; (page_id, url, file, at, length, digest) of every record."""
    data = build_dictionary(pages, cfg)
    frame = leading_frame(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():05d}.warc.zst"
        trial = f"{base}/.{name}.{task.taskAttemptId()}"
        compressor = zstd.ZstdCompressor(level=cfg.level, dict_data=_dict(data), write_content_size=True, write_checksum=True) if data else zstd.ZstdCompressor(level=cfg.level, write_checksum=True)
        out, at = None, 0
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                places, lengths, digests = [], [], []
                for p, u, h in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(trial, compression=None)
                        out.write(frame)
                        at = len(frame)
                    raw = record(p, u, h, cfg)
                    z = compressor.compress(raw)
                    out.write(z)
                    places.append(at)
                    lengths.append(len(z))
                    digests.append(raw.partition(b"WARC-Payload-Digest: ")[2].partition(b"\r\n")[0].decode())
                    at += len(z)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([name] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "url", "file", "at", "length", "digest"])
        if out is not None:
            out.close()
            fs.move(trial, f"{base}/{name}")

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, file string, at long, length long, digest string")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, html, file, at) of every record of the files in folder, one after another in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(p, compression=None) as f:
                    data, _ = dictionary_of((h := f.read(8)) + f.read(struct.unpack("<II", h)[1]))
                    d, rest, rows, at = _decompressor(data), b"", [], 8 + struct.unpack("<II", h)[1]
                    while True:
                        obj, parts = d.decompressobj(), []
                        while not obj.eof:
                            block = rest or f.read(1 << 20)
                            if not block:
                                break
                            parts.append(obj.decompress(block))
                            rest = obj.unused_data if obj.eof else b""
                            at += len(block) - len(rest)
                        if not obj.eof and not parts:
                            break
                        fields, body = parse(b"".join(parts))
                        rows.append((int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None, fields["WARC-Target-URI"], body.decode(), path.rpartition("/")[2], at))
                        if len(rows) >= 512:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")  # the content isn't read here
    files = files.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"))
    return files.mapInArrow(run, "page_id long, url string, html string, file string, until long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "html", "file", "until"])


def fetch(folder: str, file: str, at: int, length: int) -> tuple[dict[str, str], bytes]:
    """(fields, payload) of one record by its place."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{file}") as f:
        h = f.read(8)
        data, _ = dictionary_of(h + f.read(struct.unpack("<II", h)[1]))
        f.seek(at)
        return parse(_decompressor(data).decompress(f.read(length)))


def archive(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """The index of pages written to a new folder of the shared one. It is written once: the index is a table."""
    spark = pages.sparkSession
    folder = f"{C.scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    return C.durable(write(pages, folder, cfg), "index").withColumn("folder", F.lit(folder))
