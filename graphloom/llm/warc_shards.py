"""Deterministic sharded WARC writer, and the reader for its archives.

Records are range-sorted by page id: a shard is a fixed range of ``span`` ids, so which records it holds and
how its bytes come out depend on the table alone, not on partitions or retries. A shard's records go one
gzip member each into files that roll over by compressed size. Headers are made anew: record ids are name
UUIDs, dates are a parameter, digests and lengths are those of the payload written.

Of records with the same payload of at least ``least`` bytes, that of the largest page id is written as a
response and the others as revisits that name it; shorter payloads are always responses.

A file is written under a temporary name that no other attempt uses and renamed when complete; the rename is
the commit, and a repeated attempt replaces a file by the same bytes. The manifest, one row per file with its
records, size and digest, is a table that Spark commits when all shards are done; readers go by it, so files
of a failed run are never read.

Defined results: null html is the empty payload; a null page id makes a shard of its own and a record
without id header; rows with the same page id are separate records, of which, payloads being equal, one is
the response; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path

NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "graphloom/warc")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 16 << 20  # of archives, for one reading task
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def marked_pages(pages: DataFrame, key: str = "page_id", least: int = 0) -> DataFrame:
    """(key, digest, keeper): per payload of at least ``least`` bytes that occurs more than once, its response.

    Only digests are shuffled, and they are counted before, so a payload on a third of all pages costs no more.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select(key, F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size")).filter(F.col("size") >= least)
    return seen.groupBy("digest").agg(F.max(key).alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("digest", "keeper")


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}/{digest}/{copy}')}>"


def record_bytes(page: int | None, url: str | None, body: bytes, digest: str, keeper: int | None, copy: int, date: str) -> bytes:
    """One WARC record. ``keeper`` is the page id of the response that a revisit refers to."""
    revisit = keeper is not None
    block = HTTP if revisit else HTTP + body
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest, copy)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {(url or '').replace(chr(13), '').replace(chr(10), '')}",
        f"WARC-Payload-Digest: sha1:{_base32(digest)}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(body)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(keeper, digest, 0)}", f"X-Refers-To-Page: {keeper}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """The files of one shard."""

    def __init__(self, target: str, shard: str, limit: int, level: int):
        self.store, self.folder = fs.FileSystem.from_uri(target)
        self.store.create_dir(self.folder, recursive=True)
        self.shard, self.limit, self.level, self.number, self.done = shard, limit, level, 0, []
        self._open()

    def _open(self) -> None:
        self.data, self.records = io.BytesIO(), 0

    def add(self, record: bytes) -> None:
        member = gzip.compress(record, self.level, mtime=0)
        if self.records and self.data.tell() + len(member) > self.limit:
            self.commit()
        self.data.write(member)
        self.records += 1

    def commit(self) -> None:
        if not self.records:
            return
        name = f"{self.shard}-{self.number:05d}.warc.gz"
        raw, part = self.data.getvalue(), f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(part, compression=None) as out:
            out.write(raw)
        self.store.move(part, f"{self.folder}/{name}")
        self.done.append((name, self.records, len(raw), hashlib.sha1(raw).hexdigest()))
        self.number += 1
        self._open()


def write_archives(pages: DataFrame, target: str, key: str = "page_id", least: int = 0, span: int = 1 << 9,
                   file_bytes: int = 64 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives below ``target`` (a folder that all executors reach) and return the manifest
    (file, records, bytes, sha1)."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col("url").cast("string").alias("url"), html.alias("body"), F.sha1(html).alias("digest"))
    keepers = marked_pages(pages, key, least)
    # The keeper of each repeated payload joins small rows only; bodies travel once, to their shard.
    ids = pages.select(F.col(key).cast("long").alias("page"), F.sha1(html).alias("digest"))
    marks = ids.join(keepers, "digest").groupBy("page", "digest").agg(F.max("keeper").cast("long").alias("keeper"))
    none = F.lit(None)
    notes = marks.select("page", none.cast("string").alias("url"), none.cast("binary").alias("body"), "digest", F.struct("keeper").alias("note"))
    number = F.floor(F.col("page") / F.lit(span))
    shard = F.coalesce(F.format_string("pages-%012d", number), F.lit("pages-none"))
    both = rows.withColumn("note", F.lit(None).cast("struct<keeper:long>")).unionByName(notes).withColumn("shard", shard)
    both = both.repartition(F.col("shard")).sortWithinPartitions("shard", "page", "digest", F.col("note").isNull(), "url")
    manifest = f"{target}/_manifest"
    both.select("shard", "page", "url", "body", "digest", F.col("note.keeper").alias("keeper"), F.col("note").isNotNull().alias("is_note")).mapInArrow(
        _writer(target, file_bytes, level, date), "file string, records long, bytes long, sha1 string").write.parquet(manifest)
    return pages.sparkSession.read.schema("file string, records long, bytes long, sha1 string").parquet(manifest)


def _writer(target: str, file_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done, last, keeper, copy = None, [], None, None, 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                shard, page, url, body, digest, note, is_note = (c[i].as_py() for c in columns)
                if roll is None or roll.shard != shard:
                    if roll:
                        roll.commit()
                        done += roll.done
                    roll = _Roll(target, shard, file_bytes, level)
                if (page, digest) != last:
                    last, keeper, copy = (page, digest), None, 0
                if is_note:
                    keeper = note
                    continue
                response = keeper is None or (page == keeper and copy == 0)
                roll.add(record_bytes(page, url, body, digest, None if response else keeper, copy, date))
                copy += 1
        if roll:
            roll.commit()
            done += roll.done
        cols = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["file", "records", "bytes", "sha1"])

    return run


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    data, at = gzip.decompress(raw), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        at = end + 4
        block = data[at:at + int(head["Content-Length"])]
        at += len(block) + 4
        yield head, block


def read_archives(target: str, manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, file, url) of every record in the manifest's files.

    Lengths and digests of responses are those of the payload read; a file whose digest differs from the
    manifest's is an error, as is a response whose payload does not match its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, sha1 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    raw = f.read()
                if hashlib.sha1(raw).hexdigest() != sha1:
                    raise ValueError(f"{name} differs from the manifest")
                out = []
                for head, block in parse_records(raw):
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"])
                    if head["WARC-Type"] == "response" and (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()) != (size, digest):
                        raise ValueError(f"{name}: payload of {head['WARC-Record-ID']} does not match its header")
                    page, refers = head.get("X-Page-Id"), head.get("X-Refers-To-Page")
                    out.append((None if page is None else int(page), size, digest, head["WARC-Type"], None if refers is None else int(refers),
                                name, head.get("WARC-Target-URI")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)],
                                                 names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "url"])

    # The manifest is tiny, so adaptive execution would read all archives in one task: the bytes behind it decide.
    total, count = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    parts = max(-(-total // READ_BYTES), min(count, manifest.sparkSession.sparkContext.defaultParallelism), 1)
    return manifest.select("file", "sha1").repartition(parts, "file").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, url string")


def qualified(spark, path: str) -> str:
    """``path`` with the scheme of the file system Spark finds it in, so that all executors mean the same place."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return full if "://" in full else full.replace(":/", ":///", 1)


def round_trip(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write ``pages`` below the cluster's shared folder and read the archives back."""
    target = qualified(pages.sparkSession, scratch_path(pages.sparkSession, "warc"))
    manifest = write_archives(pages, target, key)
    return read_archives(target, manifest).drop("file", "url").withColumnRenamed("page_id", key)
