"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id into shards that are the same on every run, and files are rolled once their
compressed size passes a bound; each record is a gzip member of its own. Headers and digests are made anew. Files are
written under temporary names; when all tasks have succeeded, a manifest is written and the files named in it get their
final names, so a failed or repeated task leaves no part of an archive. Files that attempts left behind are deleted.

Of equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest page id is a ``response``; the others are
``revisit`` records, which have the response's headers and no payload.

Null html is an empty payload, a null url is left out of the headers. Null page ids come first; among equal payloads
they are revisits of a page that has an id. Rows that repeat a page id are in the order of a hash of url and payload (equal
rows lie in one shard, which is streamed); those that repeat the largest page id are all responses. An empty table gives
an empty archive. Further columns are not written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import by_shard, commit, filesystem, fresh_path, layout, placed, runs_of

MIN_REVISIT = 1000
MAX_FILE_BYTES = 64 << 20
ROWS_PER_SHARD = 2048
#: Regenerated headers carry one fixed date, as a clock would make files differ between runs.
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return gzip.compress(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "Content-Type": "application/http;msgtype=response",
        "WARC-Payload-Digest": f"sha1:{b32(digest)}",
        "WARC-Block-Digest": f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    }
    if page_id is not None:
        headers["X-Page-ID"] = str(page_id)
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    return record(headers, block)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive, one gzip member at a time."""
    left = b""
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        member, raw = zlib.decompressobj(31), bytearray()
        while not member.eof:
            if not left:
                left = stream.read(1 << 20)
                if not left:
                    raise ValueError("the archive ends within a record")
            raw += member.decompress(left)
            left = member.unused_data if member.eof else b""
        head, _, rest = bytes(raw).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def refers(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, _tie, digest, refers_to) of the pages that are revisits."""
    rows = pages.select("page_id", "_tie", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_revisit)
    last = rows.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and refers_to is not null").drop("copies")
    return rows.join(last, ["digest", "n"]).where("page_id is null or page_id < refers_to").select("page_id", "_tie", "digest", "refers_to")


class _Roller:
    """Writes a shard's records into files of bounded compressed size."""

    def __init__(self, out: str, shard: int, max_bytes: int):
        self.fs, self.base = filesystem(out)
        self.fs.create_dir(self.base, recursive=True)
        self.shard, self.max_bytes, self.k, self.sink = shard, max_bytes, 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.sink is not None and self.size >= self.max_bytes:
            yield self.close()
        if self.sink is None:
            self.name = f"pages-{self.shard:07d}-{self.k:05d}.warc.gz"
            self.temporary = f".{self.name}-{uuid.uuid4().hex}"
            self.sink = self.fs.open_output_stream(f"{self.base}/{self.temporary}")
            self.size = self.n = 0
            self.sha = hashlib.sha1()
            self._write(record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None, self.name), "WARC-Date": DATE, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.n += 1

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.sink.close()
        self.sink = None
        self.k += 1
        return self.temporary, self.name, self.n, self.size, self.sha.hexdigest()


_MANIFEST = "temporary string, name string, records long, bytes long, sha1 string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[x.split()[0] for x in _MANIFEST.split(", ")])


def write_archives(pages: DataFrame, out: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", max_file_bytes: int = MAX_FILE_BYTES, rows_per_shard: int = ROWS_PER_SHARD, min_revisit: int = MIN_REVISIT) -> tuple[str, DataFrame]:
    """Writes the archive; returns its folder and manifest (name, records, bytes, sha1)."""
    spark = pages.sparkSession
    out = out or fresh_path(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_tie", F.xxhash64("url", "payload"))
    opens = layout(rows, "page_id", "_tie", rows_per_shard)
    # what is known of a page goes where the page goes, and comes before it
    facts = refers(rows, min_revisit).select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "_tie", "digest", "refers_to")
    both = facts.unionByName(rows.select("*", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to")))
    both = placed(both.withColumn("_page", F.col("payload").isNotNull()), "page_id", "_tie", opens)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, at, known = None, None, {}
        for s, part in runs_of(batches, "_shard"):
            if roller is None or s != roller.shard:
                if roller is not None and roller.sink is not None:
                    yield _batch([roller.close()])
                roller, at, known = _Roller(out, s, max_file_bytes), None, {}
            for pid, tie, u, payload, digest, to in zip(*(part[c].to_pylist() for c in ("page_id", "_tie", "url", "payload", "digest", "refers_to")), strict=True):
                if (pid, tie) != at:
                    at, known = (pid, tie), {}
                if payload is None:
                    known[digest] = to
                    continue
                found = hashlib.sha1(payload).hexdigest()
                for row in roller.add(page_record(pid, u, payload, found, known.get(found))):
                    yield _batch([row])
        if roller is not None and roller.sink is not None:
            yield _batch([roller.close()])

    manifest = f"{out}/_manifest"
    by_shard(both, len(opens), "page_id", "_tie", "_page", "url", "payload").mapInArrow(write, _MANIFEST).write.parquet(manifest)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(out)
        for batch in batches:
            for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist(), strict=True):
                if fs.get_file_info(f"{base}/{temporary}").type.name != "NotFound":  # a repeated task finds it done
                    commit(fs, f"{base}/{temporary}", f"{base}/{name}")
            yield batch.select(["name"])

    files = spark.read.schema(_MANIFEST).parquet(manifest)
    files.mapInArrow(rename, "name string").agg(F.count("name")).collect()
    fs, base = filesystem(out)
    from pyarrow.fs import FileSelector

    for left in fs.get_file_info(FileSelector(base, allow_not_found=True)):
        if left.base_name.startswith(".pages-") and left.is_file:
            fs.delete_file(left.path)
    return out, files.drop("temporary")


def read_archives(spark: SparkSession, out: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to of each page, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(out)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in records(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        if headers["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{name}: the digest of {headers['WARC-Record-ID']} is wrong")
                        n = int(head.rpartition(b"Content-Length: ")[2])
                        number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                        rows.append((number("X-Page-ID"), headers.get("WARC-Target-URI"), n, digest, headers["WARC-Type"], number("X-Refers-To-Page-ID")))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, min(manifest.count(), 4096))
    return manifest.select("name").repartition(n, "name").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
