"""WARC archives: write with an index first, read back by coalesced ranges.

Writing: every task streams its pages into archives of its own in a shared
folder, one gzip member per record, and returns an index row per record: file,
offset, length, URL and payload digest.  Of pages with equal payloads the one
with the smallest page_id is a ``response``, the others are ``revisit``
records that refer to it.  The index is a Parquet table; archives of failed
attempts are not in it and are never read.

Reading: the index rows of the wanted records are range-partitioned and sorted
by file and offset; a task joins ranges that lie close together into one read,
then takes the records out of it and checks their digests.

Archives are opened through ``pyarrow.fs``, so the folder may be on any store
that all executors reach.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.session import shared_path

#: Payloads of at least this many bytes are written once.
LEAST_BYTES = 0
ARCHIVE_BYTES = 1 << 30
#: Ranges this close are read at once, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Records read by a task, in bytes of archive.
TASK_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"

INDEX = ("page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, "
         "file string, offset long, length long")
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder.removeprefix("file:")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    url = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> dict:
    """Fields of one gzip member written by ``record``; checks lengths and digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body = rest[:int(field["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.decode().rsplit("Content-Length: ", 1)[1].split("\r\n")[0])
    sha1 = field["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = field["WARC-Type"]
    if version != "WARC/1.1" or rest[len(body):] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"damaged record {field.get('WARC-Record-ID')}")
    return {"page_id": _page(field["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": sha1, "record_type": kind,
            "refers_to": _page(field.get("WARC-Refers-To")), "url": field["WARC-Target-URI"], "payload": payload}


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


def _write_task(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, (fs, base) = TaskContext.get(), store(folder)
        out, name, at, number = None, "", 0, 0
        try:
            for b in batches:
                rows = []
                for page, url, html, keep in zip(*(c.to_pylist() for c in b.columns)):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out:
                            out.close()
                        name, at = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number}.warc.gz", 0
                        out, number = fs.open_output_stream(f"{base}/{name}", compression=None), number + 1
                    payload = (html or "").encode()
                    revisit = keep is not None and keep != page
                    data = record(page, url, payload, keep, revisit)
                    out.write(data)
                    rows.append((page, url, digest(payload), len(payload), "revisit" if revisit else "response",
                                 keep if revisit else None, name, at, len(data)))
                    at += len(data)
                yield _columns(rows, INDEX)
        finally:
            if out:
                out.close()
    return run


def write(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, str]:
    """Write a record per row of ``pages`` (page_id, url, html); (index, folder).

    A null html is an empty payload.  Rows that repeat the page_id of their
    group's response are responses too.  A row without a page_id revisits the
    group's response, or is a response if no row of the group has an id.
    """
    spark = pages.sparkSession
    C.bounded_batches(spark)
    folder = folder or shared_path(spark, "warc")
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("d", F.when(F.octet_length("html") >= least_bytes, F.unhex(F.sha2("html", 256))))
    groups = pages.where("d IS NOT NULL").groupBy("d").agg(F.min("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    groups = C.small_side(C.staged(groups.select("d", "keep"), "payloads"), 80)
    told = pages.join(groups, "d", "left").select("page_id", "url", "html", "keep")
    return C.staged(told.mapInArrow(_write_task(folder), INDEX), "warc-index"), folder


def _read_task(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        for b in batches:
            todo = list(zip(*(c.to_pylist() for c in b.columns)))
            rows, i = [], 0
            while i < len(todo):
                name, start, size = todo[i]
                j, end = i + 1, start + size
                while j < len(todo) and todo[j][0] == name and todo[j][1] <= end + GAP_BYTES and todo[j][1] + todo[j][2] - start <= READ_BYTES:
                    end = max(end, todo[j][1] + todo[j][2])
                    j += 1
                with fs.open_input_file(f"{base}/{name}") as f:
                    data = f.read_at(end - start, start)
                for _, at, n in todo[i:j]:
                    r = parse(data[at - start:at - start + n])
                    rows.append(tuple(r[k.split()[0]] for k in PAGES.split(", ")))
                i = j
            yield _columns(rows, PAGES)
    return run


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows name: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url."""
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = C.parts_for(size, 1, TASK_BYTES)
    wanted = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return wanted.mapInArrow(_read_task(folder), PAGES)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    index, folder = write(pages)
    return read(index, folder)
