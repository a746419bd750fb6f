"""A deterministic, sharded WARC writer and its reader.

Writing: one scan notes id, size and SHA-1 of every payload. Records whose payload occurred under a smaller id become
revisits; the assignment is a join of small rows, and only revisits get a row of it. Records stand in the order of (id, digest);
a running sum of payload bytes over that order cuts it into shards of about equal payload, so shards depend on the rows alone and
far-off, null or repeated ids do no harm. Records are dealt by shard and sorted; a task writes a shard's records, each as a gzip
member with regenerated headers, dates and digests, and begins another file when the compressed size reaches ``ROLL_BYTES``.

Files are written under temporary names with a random part, so a lost or repeated task leaves only orphans. The rows that the
successful tasks return are the manifest. The files in it are renamed to their final names (harmless to repeat), then it is
written to the archive's ``manifest`` folder, and what is left under temporary names is removed. A reader needs the archive's
folder alone and trusts what its manifest lists.

Reading: files of the manifest are dealt to tasks by their order, which read member by member, and check each payload against
its digest.

Defined results: a null html is an empty payload; of equal rows (same id, same payload) the first is the response and
the others revisit it (they are written by one task, the copies without payload); a null page_id sorts first and becomes a response
only if no other row has its payload; an empty table writes no file; columns but page_id, url and html are not written.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import UUID, uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, materialise, shared_dir, table, with_workers

#: A shard holds about a 256th of the payload, within these bounds.
SHARDS, LEAST_SHARD, MOST_SHARD = 256, 4 << 20, 1 << 30
ROLL_BYTES = 128 << 20
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_LEAST = -(1 << 63)

MANIFEST = "shard int, seq int, temp string, file string, records long, bytes long, sha1 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, hex_digest: str) -> str:
    """A URN that holds the page id in its lower half and a part of the digest in its upper half; of a null id the digest only."""
    if page_id is None:
        return f"<urn:sha1:{base32(hex_digest)}>"
    return f"<urn:uuid:{UUID(int=int(hex_digest[:16], 16) << 64 | page_id & (1 << 64) - 1)}>"


def page_of(record: str) -> int | None:
    name = record.strip("<>")
    if not name.startswith("urn:uuid:"):
        return None
    low = UUID(name.removeprefix("urn:uuid:")).int & (1 << 64) - 1
    return low - (low >> 63 << 64)


def record(page_id: int | None, url: str | None, payload: bytes, hex_digest: str, size: int, refers_to: tuple | None) -> bytes:
    """A response, or a revisit of the page in ``refers_to`` that holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    uri = "".join(c for c in (url or "") if c > " ") or "about:blank"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, hex_digest)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32(hex_digest)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if refers_to:
        lines += [f"WARC-Refers-To: {record_id(refers_to[0], hex_digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Roller:
    """The files of one shard."""

    def __init__(self, out: str, roll: int):
        self.fs, self.root = fs.FileSystem.from_uri(out)
        self.roll, self.shard, self.seq, self.sink = roll, None, 0, None

    def add(self, shard: int, data: bytes) -> Iterator[tuple]:
        if self.sink and (shard != self.shard or self.size >= self.roll):
            yield self.close()
        if not self.sink:
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha1()
            self.name = f"part-{shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"_temporary_warc/{self.name}.{uuid4().hex}"
            self.fs.create_dir(f"{self.root}/_temporary_warc", recursive=True)
            self.sink = self.fs.open_output_stream(f"{self.root}/{self.temp}", compression=None)
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.sink.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple:
        self.sink.close()
        self.sink = None
        return self.shard, self.seq, self.temp, self.name, self.records, self.size, self.sha.hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _writer(out: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = _Roller(out, roll), []
        at, refers = (), None
        for batch in batches:
            for shard, page, kind, url, html, digest, first in zip(*(c for c in batch.columns), strict=True):
                shard, page = shard.as_py(), page.as_py()
                digest = digest.as_py()
                if at != (shard, page, digest):
                    at, refers = (shard, page, digest), None
                if kind.as_py() == 0:  # a revisit's assignment; it comes before the rows of this page and digest
                    refers = (first.as_py(),)
                    continue
                payload = (html.as_py() or "").encode()
                sha = hashlib.sha1(payload).hexdigest()
                done += files.add(shard, record(page, url.as_py(), payload, sha, len(payload), refers))
                refers = refers or (page,)
        if files.sink:
            done.append(files.close())
        yield _batch(done, _MANIFEST)

    return run


def _renamer(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for temp, name in zip(batch.column("temp").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if store.get_file_info(f"{root}/{temp}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{temp}", f"{root}/{name}")
            yield batch

    return run


def _order(page_id: Column, digest: Column) -> Column:
    """A string that sorts as (page_id, digest) does, nulls first."""
    unsigned = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(_LEAST))), 16, "0")
    return F.concat(F.coalesce(unsigned, F.lit("")), F.lit("/"), digest)


def shard_cuts(narrow: DataFrame, shard_bytes: int) -> list[str]:
    """The first place (``_order``) of every shard but the first: a row for about ``shard_bytes`` of payload."""
    places = narrow.groupBy(_order(F.col("page_id"), F.col("digest")).alias("place")).agg(F.sum("size").alias("size"))
    # ranges differ from run to run, the running sum does not
    ranged = materialise(places.repartitionByRange("place").withColumn("part", F.spark_partition_id()))
    up = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("size").alias("s")).select("part", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("before"))  # a row a task
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(sums), "part")
    shard = F.floor((F.col("at") + F.col("before")) / shard_bytes)
    cuts = [r["cut"] for r in here.groupBy(shard.alias("shard")).agg(F.min("place").alias("cut")).collect()]
    forget(ranged)
    return sorted(cuts)[1:]


def _dealt(manifest: DataFrame) -> DataFrame:
    """Files in order, in so many partitions that each core has some; AQE does not merge them."""
    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    n = max(1, min(files, max(2 * manifest.sparkSession.sparkContext.defaultParallelism, size // (32 << 20))))
    return manifest.repartitionByRange(n, "shard", "seq")


def write_warc(pages: DataFrame, out: str, shard_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages`` below the URI ``out``, a folder that all executors share; returns the manifest."""
    spark = with_workers(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha1(F.encode(payload, "UTF-8"))
    narrow = materialise(pages.select("page_id", F.octet_length(payload).cast("long").alias("size"), digest.alias("digest")))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    cuts = spark.sparkContext.broadcast(np.array(shard_cuts(narrow, shard_bytes or min(MOST_SHARD, max(LEAST_SHARD, total // SHARDS))), dtype="U57"))

    @F.pandas_udf("int")
    def shard_of(places: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, places.to_numpy(dtype="U57"), side="right").astype(np.int32))

    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = narrow.join(firsts, "digest").where("not (page_id <=> first)").select("page_id", "digest", "first").distinct()
    nothing = F.lit(None).cast("string")
    rows = pages.select("page_id", F.lit(1).alias("kind"), F.col("url").cast("string"), "html", digest.alias("digest"), F.lit(None).cast("long").alias("first")).unionByName(
        again.select("page_id", F.lit(0).alias("kind"), nothing.alias("url"), nothing.alias("html"), "digest", "first")
    )
    rows = rows.select(shard_of(_order(F.col("page_id"), F.col("digest"))).alias("shard"), "page_id", "kind", "url", "html", "digest", "first")
    dealt = rows.repartitionByRange(len(cuts.value) + 1, "shard")
    written = materialise(dealt.sortWithinPartitions("shard", "page_id", "digest", "kind", "url").mapInArrow(_writer(out, roll_bytes), MANIFEST))
    committed = _dealt(written).mapInArrow(_renamer(out), MANIFEST)
    committed.write.mode("overwrite").parquet(f"{out}/manifest")
    store, root = fs.FileSystem.from_uri(out)
    if store.get_file_info(f"{root}/_temporary_warc").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary_warc")
    forget(narrow, written)
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def _records(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    with store.open_input_stream(path, compression=None) as source:
        z, parts, data = zlib.decompressobj(31), [], source.read(1 << 20)
        while data:
            parts.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
            data = data or source.read(1 << 20)


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, its digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length")))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"broken record {fields['WARC-Record-ID']}")
    return page_of(fields["WARC-Record-ID"]), size, digest, kind, page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """A row for each record of the archive ``out``."""
    with_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows = []
                for raw in _records(store, f"{root}/{name}"):
                    rows.append(parse(raw))
                    if len(rows) == 5000:
                        yield _batch(rows, _RECORDS)
                        rows = []
                yield _batch(rows, _RECORDS)

    return _dealt(spark.read.schema(MANIFEST).parquet(f"{out}/manifest")).mapInArrow(run, RECORDS)


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out)
