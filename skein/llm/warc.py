"""WARC archives as a Python data source, and writing pages to archives with revisit records.

Reading: a partition is a file, or a run of records of one where an index (``.idx``, written beside it) gives the record
offsets. Equality and IN filters on ``record_type`` and header columns are pushed down; a record's headers are parsed
first, and where they fail the filters, or ``payload`` is ``false``, its payload isn't decoded; with an index the
compressed record isn't even read. Writing: each task writes a file of one gzip member a record under a temporary name;
the commit renames the files of the tasks that succeeded.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ._chunks import open_uri
from ._common import MAX_BROADCAST_IDS, read, scratch, table

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, http_length bigint, payload binary"
HEADER = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
BATCH, SPLIT = 200, 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PREFIX = "urn:x-page:"
SALTS = 16


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    end: int | None = None

    def __init__(self, path, start=0, end=None):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


@dataclass
class Done(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    """Options: path; payload (``false``: leave payloads undecoded and null)."""

    @classmethod
    def name(cls):
        return "skein_warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], overwrite)


def headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in HEADER:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self):
        fs, path = open_uri(self.path)
        files = [f for f in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path[len(path) :]]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.size > SPLIT and (marks := index(fs, f.path)):
                cuts = [0]
                for m in marks:
                    if m["at"] - cuts[-1] >= SPLIT:
                        cuts.append(m["at"])
                out += [Part(f.path, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
            else:
                out.append(Part(f.path))
        return out or [Part("")]

    def fits(self, row: dict) -> bool:
        return all(row[k] in v for k, v in self.wanted.items())

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n == "http_length" else pa.binary() if n == "payload" else pa.string()) for n in [x.split()[0] for x in SCHEMA.split(", ")]])
        if not part.path:
            yield pa.RecordBatch.from_pylist([], schema)
            return
        fs, _ = open_uri(self.path)
        rows = []
        for row in self.records(fs, part):
            rows.append(row)
            if len(rows) >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, fs, part: Part) -> Iterator[dict]:
        marks = index(fs, part.path)
        with fs.open_input_file(part.path) as f:
            if marks:
                for m in marks:
                    if m["at"] < part.start or part.end is not None and m["at"] >= part.end:
                        continue
                    if all(m.get(k) in v for k, v in self.wanted.items() if k in m):
                        f.seek(m["at"])
                        yield from self.parse(Stream(f, True, m["n"]))
            else:
                yield from self.parse(Stream(f, part.path.endswith(".gz"), None))

    def parse(self, s: Stream) -> Iterator[dict]:
        """A record's payload is what its block holds after the blank line that ends the HTTP headers; a block without
        one has an empty payload. Where the Content-Length is no number, the row has a null payload, and reading goes on
        at the next line that begins a record. A record that the file breaks off has what there is of it."""
        while (head := s.until(b"\r\n\r\n")) is not None:
            h = headers(head.lstrip(b"\r\n"))
            length = h.get("content-length", "")
            left = int(length) if length.isascii() and length.isdigit() else None
            row = {k: h.get(v.lower()) for k, v in HEADER.items()}
            row |= {k: row[k].strip("<>") for k in ("record_id", "refers_to") if row[k]}
            row |= {"http_length": None, "payload": None}
            fits = self.fits(row)
            if left is None:
                s.resume()
            elif not fits:
                s.skip(left + 4)
            else:
                if h.get("content-type", "").startswith("application/http"):
                    http, used = s.within(b"\r\n\r\n", left)
                    left -= used
                    n = headers(http).get("content-length", "")
                    row["http_length"] = int(n) if n.isascii() and n.isdigit() else None
                if self.payload and row["record_type"] != "revisit":
                    row["payload"] = s.take(left)
                else:
                    s.skip(left)
                s.skip(4)
            if fits:
                yield row


class Stream:
    """Bytes of a file, members of gzip decompressed as they are needed."""

    def __init__(self, f, gz: bool, size: int | None):
        self.f, self.gz, self.left, self.buf = f, gz, size, b""
        self.z, self.raw = (zlib.decompressobj(31) if gz else None), b""

    def more(self, least: int = 1 << 16) -> bool:
        data = self.raw or self.f.read(1 << 16 if self.left is None else min(1 << 20, self.left))
        if self.left is not None and not self.raw:
            self.left -= len(data)
        self.raw = b""
        if not data:
            return False
        if not self.gz:
            self.buf += data
            return True
        self.buf += self.z.decompress(data)
        if self.z.eof:
            self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
        return True

    def within(self, mark: bytes, n: int) -> tuple[bytes, int]:
        """(bytes before ``mark``, bytes used) of the next ``n`` bytes, all of them where the mark isn't in them."""
        while (k := self.buf.find(mark, 0, n)) < 0 and len(self.buf) < n and self.more():
            pass
        if k < 0:
            out = self.take(n)
            return out, n
        out, self.buf = self.buf[:k], self.buf[k + len(mark) :]
        return out, k + len(mark)

    def resume(self) -> None:
        """To the next line that begins a record."""
        mark = b"\r\nWARC/"
        if self.until(mark) is not None:
            self.buf = mark[2:] + self.buf

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.buf.find(mark)) < 0:
            if not self.more():
                return None
        out, self.buf = self.buf[:k], self.buf[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buf], len(self.buf)
        while have < n:
            self.buf = b""
            if not self.more():
                break
            parts.append(self.buf)
            have += len(self.buf)
        data = b"".join(parts)
        self.buf = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        while len(self.buf) < n:
            n -= len(self.buf)
            self.buf = b""
            if not self.more():
                return
        self.buf = self.buf[n:]


def index(fs, path: str) -> list[dict]:
    if fs.get_file_info(path + ".idx").type == pa.fs.FileType.NotFound:
        return []
    with fs.open_input_stream(path + ".idx") as f:
        return [json.loads(x) for x in f.read().splitlines()]


class WarcWriter(DataSourceArrowWriter):
    """Rows: page_id, url, body, digest, refers_to (page_id of the response, or null)."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_uri(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        fs.create_dir(f"{root}/_tmp")
        at, marks = 0, []
        with fs.open_output_stream(f"{root}/_tmp/{name}", compression=None) as f:
            for b in batches:
                for r in b.to_pylist():
                    rec = record(r)
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    rec = z.compress(rec) + z.flush()
                    f.write(rec)
                    marks.append(json.dumps({"at": at, "n": len(rec), "record_type": "response" if r["refers_to"] is None else "revisit", "target_uri": uri(r["url"])}))
                    at += len(rec)
        with fs.open_output_stream(f"{root}/_tmp/{name}.idx", compression=None) as f:
            f.write("\n".join(marks).encode())
        return Done([name] if marks else [])

    def commit(self, messages):
        fs, root = open_uri(self.path)
        old = [f.path for f in fs.get_file_info(pa.fs.FileSelector(root, allow_not_found=True)) if f.type == pa.fs.FileType.File] if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/_tmp/{name}.idx", f"{root}/{name}.idx")
                fs.move(f"{root}/_tmp/{name}", f"{root}/{name}")
        for p in old:
            fs.delete_file(p)
        fs.delete_dir(f"{root}/_tmp")

    def abort(self, messages):
        fs, root = open_uri(self.path)
        if fs.get_file_info(f"{root}/_tmp").type != pa.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_tmp")


def uri(url: str | None) -> str | None:
    """As a header can hold it: runs of white space become a space."""
    return None if url is None else " ".join(url.split())


def record(r: dict) -> bytes:
    body, ref = (r["body"] or "").encode(), r["refers_to"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if ref is not None else http + body
    h = ["WARC/1.1", f"WARC-Type: {'response' if ref is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{r['page_id']}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{r['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if r["url"] is not None:
        h.append(f"WARC-Target-URI: {uri(r['url'])}")
    if ref is not None:
        h += [f"WARC-Refers-To: <{PREFIX}{ref}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(h).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least: int = 100) -> None:
    """A record for each row. Of equal payloads of ``least`` bytes or more, the one with the smallest page_id is a
    response, the others are revisits of it. A null html counts as empty; a null url leaves the header out. Repeated rows
    give a record each, of the same id, and are all alike response or revisit. An empty table gives no file. Other columns
    are ignored."""
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce("html", F.lit(""))
    p = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n"))
    many = p.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    many = table(many, scratch(spark), "copies")
    if many.count() <= MAX_BROADCAST_IDS // 4:
        p = p.join(F.broadcast(many), "digest", "left")
    else:  # salted, as one payload may be a third of all rows
        salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    ref = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    p.select("page_id", "url", "body", "digest", ref.alias("refers_to")).write.format("skein_warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("skein_warc").option("payload", str(payload)).load(path)


def op1_warc(spark, sf_dir):
    path = scratch(spark)
    write_pages(read(spark, sf_dir, "pages"), path)
    page = lambda c: F.substring_index(F.col(c), ":", -1).cast("long")
    r = read_archive(spark, path)
    again = F.col("record_type") == "revisit"
    n = F.when(again, F.col("http_length")).otherwise(F.octet_length("payload")).cast("long")
    digest = F.when(again, F.substring_index("payload_digest", ":", -1)).otherwise(F.sha2("payload", 256))
    return r.select(page("record_id").alias("page_id"), n.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "target_uri")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, url, strlen(h) AS n, sha256(h) AS s FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY s) ELSE page_id END AS f FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to, url AS target_uri FROM f
"""
QUERIES = {"op1_warc": op1_warc}
ORACLES = {"op1_warc": SQL}
