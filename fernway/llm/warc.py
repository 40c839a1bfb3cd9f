"""WARC archives with an index: one gzip member per record, byte-range reads of the records selected.

Writing: each task appends its pages to an archive of its own and yields an index row per record: archive, offset, length, URL and
digest. Equal payloads of at least 100 bytes are stored once, as the response of the smallest page_id; the others are
revisits of it. The index is written as Parquet before anything is read.

Reading: the selected index rows, dealt by stretches of archives and sorted by offset, are read in ranges that take in gaps of up to
``GAP`` bytes and are at most ``RANGE`` long, or one record. Each response's digest is verified.

A lost task writes a new archive under another name; the index has only the records of tasks that ended.

Defined results: null html is an empty payload; a null url has no URL header; control characters in URLs are percent-encoded;
rows that repeat the smallest page_id of a payload are responses too; rows without page_id can't be referred to and are
responses if no row with equal payload has one; an empty table gives no archives and no rows; other columns are ignored. Page ids
must be numbers or texts of numbers. The folder must be of a kind that Arrow's file systems open (local, HDFS, S3 or GCS).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernway.llm.common import slices
from fernway.operators.rounds import shared_path, written

LEAST_SHARED = 100
GAP, RANGE, STRETCH = 64 << 10, 8 << 20, 32 << 20
#: Payloads with copies that are broadcast at most, each a digest and an id; with more, the rows of each digest go to ``SALTS`` tasks.
MAX_BROADCAST, SALTS = 50_000, 16
#: The records hold no crawl time of their own.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"
RECORDS = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record as one gzip member. A revisit keeps the HTTP head, with the length of the full payload, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """A record from its gzip member, verified as far as it carries a payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")

    def page(name: str) -> int | None:
        number = fields.get(name, "<urn:page:>")[len("<urn:page:") : -1]
        return int(number) if number else None

    return {
        "page_id": page("WARC-Record-ID"),
        "record_type": fields["WARC-Type"],
        "refers_to": page("WARC-Refers-To"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def with_copies(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every row; payloads are shuffled only if many have copies."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("_d"), "first")
    shared = written(shared, "payloads")
    few = shared.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    if few:
        joined = rows.join(F.broadcast(shared), F.col("digest") == F.col("_d"), "left")
    else:
        salted = shared.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, (F.col("digest") == F.col("_d")) & (F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)) == F.col("_s")), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page (page_id, url, html) to archives in ``folder``; the index, as Parquet beside them."""
    names = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive = f"{folder}/pages-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        out, offset = None, 0
        for whole in batches:
            for batch in slices(whole, "payload"):
                rows = []
                for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    if out is None:
                        store, path = _filesystem(archive)
                        store.create_dir(path.rpartition("/")[0], recursive=True)
                        out = store.open_output_stream(path, compression=None)
                    record = record_bytes(page, url, payload, digest, refers)
                    out.write(record)
                    rows.append((page, archive, offset, len(record), url, digest, "response" if refers is None else "revisit"))
                    offset += len(record)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if out is not None:
            out.close()

    return written(with_copies(pages).mapInArrow(write, INDEX), "warc-index")


def ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = RANGE) -> list[list[int]]:
    """Sorted (offset, length) places as ranges [first place, past the last, offset, end]."""
    out: list[list[int]] = []
    for i, (offset, length) in enumerate(places):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            out[-1][1], out[-1][3] = i + 1, max(out[-1][3], offset + length)
        else:
            out.append([i, i + 1, offset, offset + length])
    return out


def read_records(index: DataFrame, *, payload: bool = True) -> DataFrame:
    """The records of the index rows given, read in sorted ranges; without ``payload`` the payloads are verified and dropped."""
    bytes_ = index.agg(F.sum("length")).first()[0] or 0
    # The index is tiny beside what it stands for, so that the number of tasks comes from the bytes to read.
    tasks = max(-(-bytes_ // STRETCH), index.sparkSession.sparkContext.defaultParallelism)
    dealt = index.select("archive", "offset", "length", F.floor(F.col("offset") / F.lit(STRETCH)).alias("stretch")).repartition(tasks, "archive", "stretch")
    sorted_index = dealt.sortWithinPartitions("archive", "offset").drop("stretch")
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archives = batch.column(0).to_pylist()
            places = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            start = 0
            while start < len(archives):
                end = start
                while end < len(archives) and archives[end] == archives[start]:
                    end += 1
                store, path = _filesystem(archives[start])
                with store.open_input_file(path) as source:
                    for a, b, low, high in ranges(places[start:end]):
                        data = source.read_at(high - low, low)
                        rows = [parse_record(data[o - low : o - low + n]) for o, n in places[start + a : start + b]]
                        columns = [[None if name == "payload" and not payload else r[name] for r in rows] for name in names]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                start = end

    return sorted_index.mapInArrow(read, RECORDS)


def archive_folder(spark) -> str:
    """A fresh folder for archives in the shared folder."""
    return shared_path(spark, "warc")
