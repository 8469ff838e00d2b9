"""WARC: deterministic sharded writer and reader.

Records are range-sorted by id into shards of about equal payload, each shard
is written by one task as a row of gzip-per-record files that roll by
compressed size, and a manifest lists the files. A file is written under a
temporary name and renamed when complete; a retried or repeated task writes the
same bytes to the same name. Only files in the manifest count.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hot_join, write_table

REVISIT_BYTES = 100            # equal payloads of at least this size are stored once
SHARD_BYTES = 16 << 20         # payload bytes of a shard, or more:
MAX_SHARDS = 100_000           # bounds the table of shard limits that every task gets
ROLL_BYTES = 8 << 20           # a file that has grown to this compressed size is closed
DATE = "2024-01-01T00:00:00Z"  # headers are regenerated, so reruns give the same bytes
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space of URLs

READ_BYTES = 128 << 20  # compressed bytes that a task reads back
MANIFEST = "shard long, file string, records long, payload_bytes long, compressed_bytes long, sha256 string"
RECORDS = ("page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
           "refers_to long, file string, offset long, valid boolean")


def filesystem(uri: str):
    """(file system, path) of a folder in the shared store: file, hdfs, s3, gs or abfs."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}/{copy}')}>"


def _record(page_id, url, payload: bytes, digest: str, copy: int, refers_to, revisit: bool) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:record:none"
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", _record_id(page_id, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", _record_id(refers_to, digest, 0))]
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", str(refers_to)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class _Shard:
    """The open file of one shard; close() commits it and gives its manifest row."""

    def __init__(self, store, folder: str, shard: int):
        self.store, self.folder, self.shard, self.no, self.out = store, folder, shard, 0, None

    def add(self, record: bytes, payload: int) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{self.no:05d}.warc.gz"
            self.tmp = f"{self.folder}/tmp-{uuid.uuid4().hex}"
            self.out, self.sha, self.size, self.records, self.payload = self.store.open_output_stream(self.tmp, compression=None), hashlib.sha256(), 0, 0, 0
        data = gzip.compress(record, 6, mtime=0)
        self.out.write(data)
        self.sha.update(data)
        self.size, self.records, self.payload = self.size + len(data), self.records + 1, self.payload + payload
        if self.size >= ROLL_BYTES:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.tmp, f"{self.folder}/{self.name}")
        self.out, self.no = None, self.no + 1
        return self.shard, self.name, self.records, self.payload, self.size, self.sha.hexdigest()


def _shard_limits(light: DataFrame) -> list:
    """The first page_id of each shard after the first, in order; at most MAX_SHARDS.

    Offsets of payload bytes in the order of page_id do not depend on how the
    rows lie in partitions, so neither do the shards.
    """
    at = write_table(light.groupBy("page_id").agg(F.sum("payload_bytes").alias("n"))
                     .repartitionByRange("page_id").withColumn("part", F.spark_partition_id()), "warc_sizes")
    parts = at.groupBy("part").agg(F.sum("n").alias("n"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    size = max(SHARD_BYTES, -(-total // MAX_SHARDS))
    base = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = W.partitionBy("part").orderBy("page_id").rowsBetween(W.unboundedPreceding, -1)
    shard = F.floor((F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))) / size)
    first = at.join(F.broadcast(base), "part").select("page_id", shard.alias("shard")).groupBy("shard").agg(F.min("page_id").alias("page_id"))
    return sorted(r.page_id for r in first.collect() if r.page_id is not None)[1:]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as WARC files under ``folder`` and return the manifest (also kept in ``folder``/manifest).

    Of records with equal payloads of at least REVISIT_BYTES the one with the
    smallest id is a response and the others revisit it; all others are
    responses. Null html is an empty payload; null url a fixed urn. A null id
    owns a shared payload only if all ids of that payload are null. Repeated
    rows (same id, same payload): the first is the response, the others
    revisit the same id. An empty table gives an empty manifest.
    Payloads are shuffled once; decisions travel as rows without a payload.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    light = write_table(rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                    F.sha2("payload", 256).alias("digest")), "warc_light")
    limits = np.array(_shard_limits(light), dtype=np.int64)

    @F.pandas_udf("long")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, ids.to_numpy("int64"), "right"))

    big = light.filter(F.col("payload_bytes") >= REVISIT_BYTES)
    owners = (big.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n"))
              .filter("n > 1").withColumn("shared", F.lit(True)))
    shared = (hot_join(big, owners, ["digest"], "n", light.count()).filter("shared")
              .select("page_id", "digest", "owner").distinct())

    none = F.lit(None)
    bodies = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.lit(1).alias("kind"), "url", "payload", none.cast("long").alias("owner"))
    notes = shared.select("page_id", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "owner")
    n = max(len(limits) + 1, 1)
    sorted_rows = (bodies.unionByName(notes).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(-(1 << 63)))).cast("int")).repartitionById(n, F.col("shard"))
                   .sortWithinPartitions("shard", "page_id", "digest", "kind", "url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        store.create_dir(at, recursive=True)
        open_: _Shard | None = None
        done: list[tuple] = []
        key, copy, note = None, 0, None
        for batch in batches:
            for page_id, digest, kind, url, body, owner, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (page_id, digest):
                    key, copy, note = (page_id, digest), 0, None
                if kind == 0:
                    note = (owner,)
                    continue
                if open_ is None or open_.shard != shard:
                    if open_ and open_.out:
                        done.append(open_.close())
                    open_ = _Shard(store, at, shard)
                revisit = note is not None and (page_id != note[0] or copy > 0)
                done += open_.add(_record(page_id, url, body, digest, copy, note[0] if revisit else None, revisit), len(body))
                copy += 1
            if done:
                yield _batch(done, MANIFEST)
                done = []
        if open_ and open_.out:
            yield _batch([open_.close()], MANIFEST)

    sorted_rows.select("page_id", "digest", "kind", "url", "payload", "owner", "shard").mapInArrow(write, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; one member is held at a time."""
    offset, data, at = 0, b"", 0
    while True:
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at == len(data):
                data, at = stream.read(1 << 20), 0
                if not data:
                    if out:
                        raise EOFError("truncated WARC member")
                    return
            before = len(data) - at
            out.append(d.decompress(data[at:] if at else data))
            at = len(data) - len(d.unused_data)
            offset += before - len(d.unused_data)
        content = b"".join(out)
        yield offset, content


def parse(content: bytes) -> dict:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return {"version": lines[0], "headers": headers, "block": rest[:int(headers["content-length"])]}


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the manifest's files: RECORDS. ``valid``: payload and block match their digests."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, held = [], 0
                with store.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for offset, content in _members(stream):
                        r = parse(content)
                        h, revisit = r["headers"], r["headers"]["warc-type"] == "revisit"
                        body = None if revisit else r["block"].partition(b"\r\n\r\n")[2]
                        digest = h["warc-payload-digest"].removeprefix("sha256:")
                        size = int(h["x-payload-length"])
                        ok = h["warc-block-digest"] == f"sha256:{hashlib.sha256(r['block']).hexdigest()}"
                        ok = ok and (revisit or len(body) == size and hashlib.sha256(body).hexdigest() == digest)
                        page, to = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        out.append((page and int(page), h["warc-target-uri"], h["warc-type"], body, size, digest, to and int(to), name, offset, ok))
                        held += len(content)
                        if held > 8 << 20:
                            yield _batch(out, RECORDS)
                            out, held = [], 0
                if out:
                    yield _batch(out, RECORDS)

    manifest = read_manifest(spark, folder)
    size = manifest.agg(F.count("*").alias("files"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("bytes")).first()
    # Files are of about equal size: as many to a task as make READ_BYTES, while there are tasks for all cores.
    tasks = min(size["files"], max(-(-size["bytes"] // READ_BYTES), spark.sparkContext.defaultParallelism))
    return manifest.select("file").repartition(max(tasks, 1), "file").mapInArrow(read, RECORDS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.record_batch([pa.array(col, types[t]) for col, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
