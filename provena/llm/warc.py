"""Deterministic sharded WARC writer and reader.

* Which record of equal payloads is the response is decided on a slim
  projection (id, SHA-1); payloads are shuffled once, for the sort.
* Shards are ranges of the id whose bounds follow from exact byte counts, not
  from samples, so the same rows always give the same shards: the slim
  projection is sorted, and an id's shard is the number of bytes before it over
  the size of a shard.  There are at most MAX_SHARDS (beyond that shards grow),
  so their bounds are a list of bounded size.  A task writes one shard in id
  order, rolling to a new file once the compressed size reaches
  ``max_file_bytes``; record ids, dates, headers, digests and gzip members
  depend on the rows alone.
* A file is written under a temporary name and renamed when complete; the
  manifest (one row a file) is a table written after all files, and its
  ``_COMMITTED`` marker appears last.  Readers use only files a committed
  manifest names, so leftovers of lost tasks are ignored, and a task that runs
  again replaces a file by the same bytes.

Edge cases: null html is an empty payload; a row with a null id is a response
of its own; rows repeated under the id that is kept are all responses; null
urls become an empty target; white space and control characters of a url are
percent-encoded in its header, and come back so; payloads of any length are one
record; further columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, map_arrow, materialise

#: Bytes of payload a shard holds about, and compressed bytes at which a file is rolled.
SHARD_BYTES = 8 << 20
MAX_FILE_BYTES = 4 << 20
MAX_SHARDS = 1 << 16
#: Files that one task reads at most, where there are more tasks than shuffle partitions.
FILES_PER_TASK = 16
RECORD_DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID(int=0x5EED)
_UNSAFE = re.compile(r"[\x00-\x20\x7f\x85\u2028\u2029]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_value(text: str) -> str:
    """A value that cannot end its header line."""
    return _UNSAFE.sub(lambda m: quote(m[0], safe=""), text)


def record_urn(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page} {digest}')}>"


def make_record(page: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member; a revisit keeps the HTTP head, with the length of the full payload, and no body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(page, digest)}", f"WARC-Date: {RECORD_DATE}"]
    lines += [f"WARC-Target-URI: {header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Page-Id: {page}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_urn(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The gzip members of a file that comes in chunks."""
    inflate, out = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            out.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(out)
                inflate, out = zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("a file ends inside a record")


def parse_record(raw: bytes) -> dict:
    """Headers and payload of a record, with its digests verified."""
    top, rest = raw.split(b"\r\n\r\n", 1)
    headers = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError(f"damaged record {headers.get('WARC-Record-ID')}")
    head, payload = block.split(b"\r\n\r\n", 1)
    length = int(head.rsplit(b"Content-Length: ", 1)[1])
    if headers["WARC-Type"] == "response" and (length != len(payload) or headers["WARC-Payload-Digest"] != "sha1:" + base32_sha1(payload)):
        raise ValueError(f"damaged payload {headers.get('WARC-Record-ID')}")
    return {"headers": headers, "payload": payload, "payload_bytes": length}


def shard_bounds(sizes: DataFrame, target: int) -> list[int]:
    """Lower bounds (ascending) of id ranges of about ``target`` bytes; ``sizes`` has ``_id`` and ``_bytes``.

    Three jobs, whatever the size: the ids are sorted, with the bytes before
    each in its part of the order; the parts are summed up; the least id of each
    shard is collected.  Where Spark cuts the order into parts does not matter,
    as only the bytes before an id count.
    """
    spark = sizes.sparkSession
    by_id = sizes.where("_id is not null").groupBy("_id").agg(F.sum("_bytes").alias("_bytes"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = materialise(by_id.repartitionByRange(parts, "_id").withColumn("part", F.spark_partition_id()), "ids")
    totals = sorted(ordered.groupBy("part").agg(F.min("_id").alias("low"), F.sum("_bytes").alias("bytes")).collect(), key=lambda r: r["low"])  # a row a part
    if not totals:
        return []
    before, total = [], 0
    for r in totals:
        before.append((r["part"], total))
        total += r["bytes"]
    target = max(target, -(-total // MAX_SHARDS))
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before bigint"))
    running = F.sum("_bytes").over(Window.partitionBy("part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1))
    shard = F.floor((F.col("before") + F.coalesce(running, F.lit(0))) / F.lit(target))
    firsts = ordered.join(offsets, "part").select("_id", shard.alias("shard")).groupBy("shard").agg(F.min("_id").alias("low"))
    return sorted(r["low"] for r in firsts.select("low").collect())  # at most MAX_SHARDS numbers


def shard_of(key: Column, bounds: Broadcast) -> Column:
    """Number of the last bound that is not above the id, by binary search; 0 for a null id."""

    @F.pandas_udf("int")
    def find(ids: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(bounds.value, ids.to_numpy(np.int64), side="right") - 1, 0).astype(np.int32))

    return find(F.coalesce(key, F.lit(-(1 << 63))))


def _writer(base: str, max_file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        out = temporary = None
        shard = number = size = records = None
        done: list[tuple] = []
        keeper: tuple | None = None
        sha = None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                name = f"part-{shard:06d}-{number:05d}.warc.gz"
                store.move(temporary, f"{root}/{name}")
                done.append((name, shard, number, records, size, sha.hexdigest()))
                out = None

        def emit():
            rows, done[:] = list(done), []
            return pa.RecordBatch.from_pydict(
                {k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate([("file", pa.string()), ("shard", pa.int32()), ("number", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])}
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "_id", "_sha", "tag", "keep", "url", "payload")), strict=True):
                at, key, digest, tag, keep, url, payload = row
                if tag == 0:
                    keeper = (key, digest, keep)
                    continue
                if shard is not None and (at != shard or (out is not None and size >= max_file_bytes)):
                    close()
                if shard is None or at != shard:
                    shard, number = at, -1
                if out is None:
                    number, size, records, sha = number + 1, 0, 0, hashlib.sha256()
                    temporary = f"{root}/_temporary/{shard}-{number}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                refers = keeper[2] if keeper and keeper[:2] == (key, digest) else None
                page = "" if key is None else str(key)
                data = make_record(page, url or "", payload, base32_sha1(payload), None if refers is None or refers == key else str(refers))
                out.write(data)
                sha.update(data)
                size += len(data)
                records += 1
            if len(done) >= 64:
                yield emit()
        close()
        yield emit()

    return run


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write the archive under ``path`` and return its manifest: file, shard, number, records, bytes, sha256."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("_id"), F.unhex(F.sha1(payload)).alias("_sha"), F.col(url).alias("url"), payload.alias("payload"))
    slim = materialise(rows.select("_id", "_sha", F.octet_length("payload").cast("long").alias("_bytes")), "warc-digests")
    bounds = shard_bounds(slim.select("_id", (F.col("_bytes") + 512).alias("_bytes")), shard_bytes)
    best = slim.where(f"_id is not null and _bytes >= {int(min_revisit_bytes)}").groupBy("_sha", "_bytes").agg(F.max("_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    decided = slim.where("_id is not null").join(best, ["_sha", "_bytes"]).where("_id <> keep").select("_id", "_sha", "keep").distinct()
    tagged = rows.select("_id", "_sha", F.lit(1).alias("tag"), F.lit(None).cast("long").alias("keep"), "url", "payload").unionByName(
        decided.select("_id", "_sha", F.lit(0).alias("tag"), "keep", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    known = spark.sparkContext.broadcast(np.array(bounds, np.int64))
    dealt = tagged.withColumn("shard", shard_of(F.col("_id"), known)).repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", "_id", "_sha", "tag", "url")
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(f"{root}/_temporary", recursive=True)
    manifest = map_arrow(dealt, _writer(path, max_file_bytes), "file string, shard int, number int, records bigint, bytes bigint, sha256 string")
    manifest.write.json(f"{path}/_manifest", mode="overwrite")
    store.delete_dir(f"{root}/_temporary")
    with store.open_output_stream(f"{root}/_COMMITTED.tmp") as f:
        f.write(b"1\n")
    store.move(f"{root}/_COMMITTED.tmp", f"{root}/_COMMITTED")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/_COMMITTED").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{path} has no committed manifest")
    return spark.read.schema("file string, shard int, number int, records bigint, bytes bigint, sha256 string").json(f"{path}/_manifest")


RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class Checked:
    """A file's bytes from a stream, with their digest so far."""

    def __init__(self, source):
        self.source, self.sha = source, hashlib.sha256()

    def chunks(self, size: int = 1 << 20) -> Iterator[bytes]:
        while data := self.source.read(size):
            self.sha.update(data)
            yield data


def _read(base: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)

        def batch_of(rows):
            cols = [
                ("page_id", [int(h["X-Page-Id"]) if h["X-Page-Id"] else None for h, *_ in rows], pa.int64()),
                ("url", [h["WARC-Target-URI"] for h, *_ in rows], pa.string()),
                ("payload_bytes", [n for _, n, _ in rows], pa.int64()),
                ("payload_digest", [h["WARC-Payload-Digest"].removeprefix("sha1:") for h, *_ in rows], pa.string()),
                ("record_type", [h["WARC-Type"] for h, *_ in rows], pa.string()),
                ("refers_to", [int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None for h, *_ in rows], pa.int64()),
            ]
            if with_payload:
                cols.append(("payload", [p for *_, p in rows], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in cols], [n for n, *_ in cols])

        for batch in batches:
            for name, sha in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    source = Checked(f)
                    rows, size = [], 0
                    for raw in members(source.chunks()):
                        r = parse_record(raw)
                        rows.append((r["headers"], r["payload_bytes"], r["payload"] if with_payload else None))
                        size += len(raw) * with_payload
                        if len(rows) >= 512 or size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)
                if source.sha.hexdigest() != sha:
                    raise ValueError(f"{name} differs from its manifest")

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the files that the committed manifest names: tasks open them by name, and stream them."""
    manifest = read_manifest(spark, path).select("file", "sha256")
    schema = RECORD + (", payload binary" if with_payload else "")
    files = manifest.count()
    if not files:
        return spark.createDataFrame([], schema)
    tasks = min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-files // FILES_PER_TASK)))
    dealt = manifest.select("file", "sha256", F.pmod(F.xxhash64("file"), F.lit(tasks)).cast("int").alias("task")).repartitionById(tasks, F.col("task"))
    return map_arrow(dealt.select("file", "sha256"), _read(path, with_payload), schema)


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    path = path or fresh_dir(pages.sparkSession, "warc")
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession, path)
