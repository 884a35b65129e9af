"""WARC archives with a two-level capture index.

Archives hold one gzip member a record. The index has a line for each record, sorted by the reversed-host key of its url:
lines lie in compressed blocks, blocks in shards, and a sparse directory keeps only each block's first key. A lookup
searches the shards' first keys, then the shard's directory, by bisection; then it reads a block's and a record's bytes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._base import Workspace, rows_of, table

BLOCK_LINES = 300
#: Lines of a shard as wished, and shards at most (their first keys are sent to the executors).
SHARD_LINES, MOST_SHARDS = 5_000, 4_096
#: Bytes of an archive that one reading task takes together, and the gap that it reads over.
SPAN, GAP = 32 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
PLACES = "key string, page_id long, file string, offset long, length long"


def reversed_host_key(url: str | None) -> str:
    """com,example,www)/path?query of http://www.example.com/path?query; scheme, port and fragment dropped, host in lower case, null as empty."""
    if url is None:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min([i for c in "/?" if (i := rest.find(c)) >= 0], default=len(rest))
    host = rest[:cut].rsplit("@", 1)[-1].lower()
    host, _, port = host.partition(":") if not host.startswith("[") else (host, "", "")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit (identical payload digest) whose HTTP header still gives the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url or "", safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header (names in lower case) and payload of one record."""

    def header(x: bytes) -> tuple[dict[str, str], bytes]:
        top, rest = x.split(b"\r\n\r\n", 1)
        lines = [line.partition(":") for line in top.decode().split("\r\n")[1:]]
        return {k.lower(): v.strip() for k, _, v in lines}, rest

    warc, rest = header(raw)
    http, payload = header(rest[: int(warc["content-length"])])
    return warc, http, payload


def gz(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


class Files:
    """Files of the shared folder, by Arrow's file systems (local, HDFS, object stores)."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.open: dict[str, object] = {}

    def writer(self, kind: str):
        """A new file of this task attempt; a repeated attempt writes another one, and only names that were committed are read."""
        self.fs.create_dir(self.root, recursive=True)
        ctx = TaskContext.get()
        name = f"{kind}-{ctx.partitionId() if ctx else 0:05d}-{uuid.uuid4().hex}"
        return name, self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 32:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.fs.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)


def with_duplicates(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to: of equal payloads of at least `least` bytes, the smallest page_id for all other rows.

    Only digests that occur twice are kept on the other side of the join; a digest that a third of all rows have is one
    row there, and Spark splits the skewed side.
    """
    d = pages.withColumn("digest", F.sha1("payload"))
    same = d.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return d.join(same, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write(pages: DataFrame, root: str) -> DataFrame:
    """Archives under root, one for each task, from page_id, url, payload (binary) and refers_to; returns each record's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at = Files(root), None, 0
        for b in batches:
            rows = []
            for page_id, url, payload, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name, out = files.writer("warc")
                n = out.write(data := gz(record(page_id, url, payload, first))) or len(data)
                rows.append((reversed_host_key(url), page_id, name, at, n))
                at += n
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "page_id", "file", "offset", "length"), r, strict=True)) for r in rows], PLACE_SCHEMA)
        if out is not None:
            out.close()

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, PLACES)


PLACE_SCHEMA = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
BLOCKS = "shard string, offset long, length long, first_key string, first_page long, last_key string, last_page long"
BLOCK_SCHEMA = pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in BLOCKS.split(", "))])


def index(places: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Index shards under root, sorted by key and page_id; returns the directory of their blocks."""
    n = min(MOST_SHARDS, max(1, -(-places.count() // SHARD_LINES)))
    ordered = places.withColumn("page_id", F.coalesce("page_id", F.lit(-(1 << 63)))).repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, at, held = Files(root), None, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal out, name, at, held
            if out is None:
                name, out = files.writer("cdx")
            data = gz("\n".join(json.dumps(r) for r in held).encode())
            out.write(data)
            row = dict(zip(BLOCK_SCHEMA.names, (name, at, len(data), *held[0][:2], *held[-1][:2]), strict=True))
            at, held = at + len(data), []
            return pa.RecordBatch.from_pylist([row], BLOCK_SCHEMA)

        name = ""
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in PLACE_SCHEMA.names), strict=True):
                held.append(r)
                if len(held) == block_lines:
                    yield flush()
        if held:
            yield flush()
        if out is not None:
            out.close()

    return ordered.mapInArrow(run, BLOCKS)


def lookup(wanted: DataFrame, directory: DataFrame, root: str) -> DataFrame:
    """The places of captures: wanted has url and page_id, and gets a row for each index line of that key and page_id.

    Each wanted key is sent to the shard that may hold it (a shard's last key may go on in the next: both are searched).
    """
    spark = wanted.sparkSession
    tops = directory.withColumn("path", F.input_file_name()).groupBy("shard").agg(F.min(F.struct("first_key", "first_page")).alias("lo"), F.max(F.struct("last_key", "last_page")).alias("hi"), F.first("path").alias("path"))
    tops = tops.orderBy("lo", "hi").collect()
    shards = spark.sparkContext.broadcast([(t.shard, tuple(t.lo), tuple(t.hi), t.path) for t in tops])  # MOST_SHARDS at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = [s[1] for s in shards.value]
        for b in batches:
            rows = []
            for url, page in zip(b.column("url").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                k = (reversed_host_key(url), -(1 << 63) if page is None else page)
                i = bisect.bisect_right(lows, k) - 1
                while i >= 0 and shards.value[i][2] >= k:
                    rows.append({"shard": shards.value[i][0], "key": k[0], "page_id": k[1]})
                    i -= 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.string()), ("key", pa.string()), ("page_id", pa.int64())]))

    routed = wanted.select("url", "page_id").mapInArrow(route, "shard string, key string, page_id long")
    routed = routed.distinct().repartition(max(1, len(tops)), "shard").sortWithinPartitions("shard", "key", "page_id")
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, shard, block, lines = Files(root), None, None, []
        paths = {s[0]: s[3] for s in shards.value}
        for b in batches:
            rows = []
            for s, key, page in zip(*(b.column(c).to_pylist() for c in ("shard", "key", "page_id")), strict=True):
                if s != shard:
                    shard, block, blocks = s, None, shard_directory(paths[s])
                    firsts = [x[2] for x in blocks]
                i = bisect.bisect_right(firsts, (key, page)) - 1
                while i >= 0 and blocks[i][3] >= (key, page):
                    if block != i:
                        block, lines = i, [json.loads(x) for x in gunzip(files.read(s, *blocks[i][:2])).decode().split("\n")]
                        keys = [(x[0], x[1]) for x in lines]
                    for j in range(bisect.bisect_left(keys, (key, page)), bisect.bisect_right(keys, (key, page))):
                        rows.append(lines[j])
                    i -= 1
            yield pa.RecordBatch.from_pylist([dict(zip(PLACE_SCHEMA.names, r, strict=True)) for r in rows], PLACE_SCHEMA)

    return routed.mapInArrow(search, PLACES)


def shard_directory(path: str) -> list[tuple]:
    """offset, length, first and last key of each block of a shard, in order: one file, since one task writes a shard."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    source, name = fs.FileSystem.from_uri(path)
    t = pq.read_table(name, filesystem=source).sort_by("offset").to_pylist()
    return [(r["offset"], r["length"], (r["first_key"], r["first_page"]), (r["last_key"], r["last_page"])) for r in t]


def read(places: DataFrame, root: str) -> DataFrame:
    """The records at places: page_id, target uri, record type, payload digest, payload length, refers_to and payload (null for revisits).

    Places near each other in an archive are read together, SPAN bytes of it by one task; every digest is checked.
    """
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.withColumn("span", F.floor(F.col("offset") / SPAN)).repartition(n, "file", "span").sortWithinPartitions("file", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def ident(x: str | None) -> int | None:
        return int(x[10:-1]) if x and len(x) > 11 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for b in batches:
            ranges = list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            i = 0
            while i < len(ranges):
                name, start, length = ranges[i]
                end, j = start + length, i + 1
                while j < len(ranges) and ranges[j][0] == name and ranges[j][1] <= end + GAP and ranges[j][1] + ranges[j][2] - start <= 4 << 20:
                    end, j = max(end, ranges[j][1] + ranges[j][2]), j + 1
                data, rows = files.read(name, start, end - start), []
                for _, at, size in ranges[i:j]:
                    warc, http, payload = parse(gunzip(data[at - start : at - start + size]))
                    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{name} at {at}: the payload does not have its digest")
                    rows.append({"page_id": ident(warc["warc-record-id"]), "uri": warc["warc-target-uri"], "record_type": kind, "payload_digest": digest, "payload_bytes": int(http["content-length"]), "refers_to": ident(warc.get("warc-refers-to")), "payload": payload if kind == "response" else None})
                yield pa.RecordBatch.from_pylist(rows, schema)
                i = j

    return near.mapInArrow(run, "page_id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", to: str | None = None) -> tuple[str, DataFrame]:
    """Write a record for each row of pages, and the index: the folder of both, and the directory.

    Null html is an empty payload, null urls have an empty key. Repeated rows and rows with a null page_id get a record
    each; of a repeated page_id that is the smallest of its payload all rows are responses. An empty table gives an empty
    directory. Other columns are ignored. With `to`, a new folder that all executors see, archives, index and the directory
    (as Parquet, in its folder `directory`) stay there; else they go when the application ends.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    root = f"{(to or ws.path).rstrip('/')}/archive"
    rows = rows_of(pages, page_id=key, url=url, html=html).select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    places = ws.save(write(with_duplicates(rows), root), "places")
    if to is None:
        return root, ws.save(index(places, root), "directory")
    index(places, root).write.parquet(f"{to.rstrip('/')}/directory")
    return root, spark.read.schema(BLOCKS).parquet(f"{to.rstrip('/')}/directory")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, looked up by its url in the index, and read back."""
    pages = table(spark, sf_dir, "pages")
    root, directory = archive(pages)
    return read(lookup(pages, directory, root), root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
           ((instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 1 AS INT), 1)) - 1) * 16
            + instr('0123456789abcdef', substr(hex, CAST(5 * i // 4 + 2 AS INT), 1)) - 1) >> CAST(3 - 5 * i % 4 AS INT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
