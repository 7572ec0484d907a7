"""WARC files: records as gzip members of their own, written and read with their byte offsets."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
RECORDS = "file string, ordinal bigint, offset bigint, length bigint, record_id string, url string, date string, payload binary, digest string"


def record_bytes(record_id: str, url: str | None, date: str, payload: bytes) -> bytes:
    """One resource record as a gzip member; the same input gives the same bytes."""
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}\r\n" + (f"WARC-Target-URI: {url}\r\n" if url is not None else "") + f"Content-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + payload + b"\r\n\r\n") + packer.flush()


def write(records: DataFrame, folder: str, file_col: str = "file", id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None) -> None:
    """A file ``<file>.warc.gz`` for each value of ``file_col``, its records in the order of their ids, in ``folder``, which all executors share.

    A null page is an empty payload and a null url leaves its header out.  A file holds what one task can write; choose ``file_col`` so.
    """
    date = F.lit("1970-01-01T00:00:00Z") if date is None else date
    rows = records.select(F.col(file_col).cast("string").alias("file"), F.concat(F.lit("urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("id"), F.col(url_col).alias("url"), date.alias("date"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"), F.col(id_col).alias("at"))
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, None
        for batch in batches:
            for file, record_id, url, date, payload in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if file != name:
                    if out:
                        out.close()
                        os.replace(out.name, f"{folder}/{name}.warc.gz")
                    name, out = file, open(f"{folder}/.{file}.{os.getpid()}", "wb")  # noqa: SIM115
                out.write(record_bytes(record_id, url, date, payload))
        if out:
            out.close()
            os.replace(out.name, f"{folder}/{name}.warc.gz")
        yield pa.RecordBatch.from_pydict({"done": pa.array([], pa.int32())})

    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "id", "url", "date", "payload").mapInArrow(run, "done int").count()


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, end) of the gzip member at an offset."""
    unpacker, out, end = zlib.decompressobj(31), [], at
    while not unpacker.eof:
        if end >= len(data):
            raise zlib.error("truncated")
        piece = data[end : end + (1 << 16)]
        out.append(unpacker.decompress(piece))
        end += len(piece)
    return b"".join(out), end - len(unpacker.unused_data)


def _readable(data: bytes, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data[at : at + 4096], 5) == b"WARC/"
    except zlib.error:
        return False


def members(data: bytes) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, content) of a file's gzip members; None for a stretch that can't be read, up to the next readable member."""
    at = 0
    while at < len(data):
        try:
            content, end = _member(data, at)
        except zlib.error:
            content, end = None, data.find(MAGIC, at + 1)
            while end >= 0 and not _readable(data, end):
                end = data.find(MAGIC, end + 1)
            end = end if end >= 0 else len(data)
        yield at, end - at, content
        at = end


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, payload) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    return headers, rest[: int(size)] if size.isdigit() else rest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ordinal, offset, length, record_id, url, date, payload, digest) of the files in a folder; ``digest`` is that of the bytes as they are stored.

    Of a stretch that can't be read only place and digest are known.  An empty file has no records.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                for ordinal, (offset, length, content) in enumerate(members(raw)):
                    headers, payload = parsed(content) if content is not None else ({}, None)
                    row = [file, ordinal, offset, length, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date"), payload, hashlib.sha256(raw[offset : offset + length]).hexdigest()]
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["file", "ordinal", "offset", "length", "record_id", "url", "date", "payload", "digest"])

    return files.mapInArrow(run, RECORDS)
