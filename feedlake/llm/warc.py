"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salt_of, salted, scratch_path, written

# Fixed values of the seekable format: a skippable frame holds the seek table.
TABLE_MAGIC, FOOTER_MAGIC, LEVEL = 0x184D2A5E, 0x8F92EAB1, 3
DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long"
PLACE = "path string, record_id string, page_id string, record_type string, frame int, frame_at long, frame_bytes long, offset long, length long"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, salts: int = 16) -> DataFrame:
    """What to write: page_id, url, record_type, refers_to, digest, n_bytes and html (null for revisits).

    Of equal payloads of at least ``least_bytes`` the smallest (id, url) is the response. Only it carries its text through
    a shuffle: copies meet in a partial minimum in the task that read them, and revisits are narrow rows joined, salted, to their response.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("n_bytes"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    order = (F.col("page_id").isNull().alias("no"), F.col("page_id"), F.col("url"))
    single = rows.where(F.col("n_bytes") < least_bytes).select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest", "n_bytes", "html")
    large = rows.where(F.col("n_bytes") >= least_bytes)
    heads = large.groupBy("digest", "n_bytes").agg(F.min(F.struct(*order, "html")).alias("r"))
    responses = heads.select("r.page_id", "r.url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest", "n_bytes", "r.html")
    first = large.groupBy("digest").agg(F.min(F.struct(*order)).alias("r")).select("digest", F.col("r.page_id").alias("head"), F.col("r.url").alias("head_url"))
    copies = large.groupBy("digest", "n_bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("n"))
    copies = copies.withColumn("_salt", salt_of(salts, "page_id", "url")).join(salted(first, salts).hint("merge"), ["digest", "_salt"])
    others = F.col("n") - (F.col("page_id").eqNullSafe(F.col("head")) & F.col("url").eqNullSafe(F.col("head_url"))).cast("long")
    revisits = copies.where(others > 0).withColumn("k", F.explode(F.sequence(F.lit(1), others))).select(
        "page_id", "url", F.lit("revisit").alias("record_type"), F.col("head").alias("refers_to"), "digest", "n_bytes", F.lit(None).cast("string").alias("html")
    )
    return single.unionByName(responses).unionByName(revisits)


def _line(name: str, value: object) -> str:
    text = "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value))
    return f"{name}: {text}\r\n"


def record_bytes(record_id: str, page_id: str | None, url: str | None, kind: str, refers_to: str | None, digest: str, n_bytes: int, html: str | None) -> bytes:
    """One WARC record. A revisit has the HTTP header only, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (html or "").encode("utf-8", "replace") if kind == "response" else http
    head = "WARC/1.1\r\n" + _line("WARC-Type", kind) + _line("WARC-Record-ID", f"<urn:uuid:{record_id}>") + _line("WARC-Date", DATE)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    head += _line("WARC-Payload-Digest", f"sha256:{digest}") + _line("Content-Type", "application/http; msgtype=response")
    if page_id is not None:
        head += _line("X-Page-Id", page_id)
    if kind == "revisit":
        head += _line("WARC-Profile", PROFILE) + (_line("X-Refers-To-Page", refers_to) if refers_to is not None else "")
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple]:
    """(page_id, url, type, refers_to, digest, payload length, payload or None) of each record of a frame's bytes."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        n = int(head["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        response = head["WARC-Type"] == "response"
        yield head.get("X-Page-Id"), head.get("WARC-Target-URI"), head["WARC-Type"], head.get("X-Refers-To-Page"), head["WARC-Payload-Digest"].removeprefix("sha256:"), size, payload if response else None
        at = end + 4 + n + 4


class Bundle:
    """Frames of one file under way; finish() gives the file's bytes: independent frames, then the seek table."""

    def __init__(self, name: str, frame_bytes: int):
        self.name, self.frame_bytes, self.parts, self.held, self.sizes, self.places = name, frame_bytes, [], [], [], []
        self.open_bytes = self.total = 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, page_id: str | None, url: str | None, kind: str, *rest: object) -> None:
        """A record under an identifier of its own, made of the file's name and the record's number."""
        record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{self.name}#{len(self.places)}"))
        record = record_bytes(record_id, page_id, url, kind, *rest)
        if self.held and self.open_bytes + len(record) > self.frame_bytes:
            self.close_frame()
        self.places.append([record_id, page_id, kind, len(self.parts), None, None, self.open_bytes, len(record)])
        self.held.append(record)
        self.open_bytes += len(record)

    def close_frame(self) -> None:
        frame = self.zip.compress(b"".join(self.held))
        for p in self.places[-len(self.held) :]:
            p[4:6] = self.total, len(frame)
        self.sizes.append((len(frame), self.open_bytes))
        self.parts.append(frame)
        self.total += len(frame)
        self.held, self.open_bytes = [], 0

    def finish(self) -> bytes:
        if self.held:
            self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, FOOTER_MAGIC)
        return b"".join(self.parts) + struct.pack("<II", TABLE_MAGIC, len(table)) + table


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame from a file's last bytes, which must hold the whole table."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != FOOTER_MAGIC:
        raise ValueError("no seek table")
    sizes, at, out = struct.unpack(f"<{2 * n}I", tail[-9 - 8 * n : -9]), 0, []
    for a, b in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, a, b))
        at += a
    return out


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 262_144, bundle_bytes: int = 16_777_216) -> DataFrame:
    """Writes the planned records to bundles in ``folder`` (a URI all executors reach) and returns the record index.

    The index maps each record's WARC-Record-ID and page to file, frame and place in the frame. Each task writes its own files, named by task attempt; the index is a written table, so only files of
    attempts that Spark committed are in it and a lost executor leaves at most unlisted files. A task holds one bundle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, names = TaskContext.get(), PLACE.split(", ")
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        new = lambda number: Bundle(f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{number:04d}.warc.zst", frame_bytes)
        bundle, number = new(0), 0

        def flush(bundle: Bundle) -> pd.DataFrame:
            data, name = bundle.finish(), bundle.name
            with store.open_output_stream(f"{base}/{name}.tmp") as out:
                out.write(data)
            store.move(f"{base}/{name}.tmp", f"{base}/{name}")
            rows = [(f"{folder}/{name}", *p) for p in bundle.places]
            return pd.DataFrame(rows, columns=[x.split()[0] for x in names])

        for batch in batches:
            for row in batch.itertuples(index=False):
                bundle.add(*row)
                if bundle.total + bundle.open_bytes >= bundle_bytes:
                    yield flush(bundle)
                    bundle, number = new(number + 1), number + 1
        if bundle.places:
            yield flush(bundle)

    rows = records.select(F.col("page_id").cast("string"), "url", "record_type", F.col("refers_to").cast("string"), "digest", "n_bytes", "html")
    return written(rows.mapInPandas(run, PLACE), "warc-index")


def _typed(records: DataFrame) -> DataFrame:
    """Ids as longs; they travel as strings, because pandas would read longs with nulls as floats."""
    return records.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def _rows(found: list[tuple], with_payload: bool) -> pd.DataFrame:
    out = []
    for page_id, url, kind, refers_to, digest, size, payload in found:
        if payload is not None:
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        out.append((page_id, url, kind, refers_to, digest, size) + ((payload,) if with_payload else ()))
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    return pd.DataFrame(out, columns=names)


def read_bundles(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the bundles that the index lists, frame by frame through each file's seek table.

    Digest and length of a response are those of the payload read back, of a revisit those its headers tell.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch["path"]:
                store, path = _store(uri)
                with store.open_input_file(path) as f:
                    size = f.size()
                    n = struct.unpack("<IBI", f.read_at(9, size - 9))[0]
                    frames = seek_table(f.read_at(min(size, 9 + 8 * n), size - min(size, 9 + 8 * n)))
                    for at, packed, plain in frames:
                        yield _rows(list(parse_records(unzip.decompress(f.read_at(packed, at), max_output_size=plain))), with_payload)

    paths = index.select("path").distinct()
    # The rows are tiny, so their number would not spread the files: a fixed number of partitions does.
    paths = paths.repartition(max(1, min(paths.count(), 8192)))
    return _typed(paths.mapInPandas(run, RECORD + ", payload binary" * with_payload))


def fetch_records(index: DataFrame) -> DataFrame:
    """Only the records that the given index rows name: one frame each is read and cut at the frame-relative offset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, rows in batch.groupby("path"):
                store, path = _store(uri)
                with store.open_input_file(path) as f:
                    for (at, size), some in rows.groupby(["frame_at", "frame_bytes"]):
                        data = unzip.decompress(f.read_at(int(size), int(at)))
                        yield _rows([x for a, n in zip(some["offset"], some["length"], strict=True) for x in parse_records(data[a : a + n])], True)

    return _typed(index.mapInPandas(run, RECORD + ", payload binary"))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Writes every page to bundles in the shared folder and reads the archives back: one row for each page.

    A null html is an empty payload; a null id sorts last, so it is a response only if all copies have null ids, and
    has no header; repeated rows are one response and revisits; an empty table writes no file. Extra columns are not used.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(plan_records(pages, id_col, url_col, html_col, least_bytes), folder))


def op8(spark, sf_dir: str) -> DataFrame:
    """op8_warc over the whole pages table."""
    out = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), h AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM h
"""
