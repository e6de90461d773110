"""WARC records in seekable Zstandard bundles, with an index of record positions.

A bundle is a row of independent Zstandard frames and a closing skippable frame, the seek table of the public
seekable format: compressed and decompressed size of every frame, their number and a magic number. Any Zstandard
reader can unpack the whole file; a reader of the table unpacks only the frame that holds a record.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelflight.llm.shared import scratch, ship, stored

# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX_SCHEMA = "page_id bigint, bundle string, record_id string, frame bigint, start bigint, size bigint"
WRITTEN_SCHEMA = INDEX_SCHEMA + ", digest string"
RECORD_SCHEMA = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, url string, payload binary"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Bundle:
    """Collects records into frames of about `frame_bytes` and remembers where each one lies."""

    def __init__(self, frame_bytes: int, level: int = 3) -> None:
        self.frame_bytes, self.packer = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.done, self.open, self.table, self.places = io.BytesIO(), bytearray(), [], []

    def add(self, name: tuple, record: bytes) -> None:
        self.places.append((*name, len(self.table), len(self.open), len(record)))
        self.open += record
        if len(self.open) >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.table.append((len(packed), len(self.open)))
        self.done.write(packed)
        self.open = bytearray()

    def size(self) -> int:
        return self.done.tell() + len(self.open)

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.table)
        tail = entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        return self.done.getvalue() + struct.pack("<II", SKIPPABLE_MAGIC, len(tail)) + tail


def seek_table(source: io.IOBase, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame of a bundle of `size` bytes."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x7F:
        raise ValueError("not a bundle with a plain seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - count * width)
    table, start = [], 0
    for _ in range(count):
        packed, plain = struct.unpack("<II", source.read(width)[:8])
        table.append((start, packed, plain))
        start += packed
    return table


def read_record(path: str, frame: int, start: int, size: int) -> bytes:
    """One record by its place in the index: reads the seek table and one frame, nothing else."""
    store, name = store_of(path)
    with store.open_input_file(name) as source:
        at, packed, _ = seek_table(source, source.size())[frame]
        source.seek(at)
        return zstandard.ZstdDecompressor().decompress(source.read(packed))[start : start + size]


def clean_header(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def warc_record(kind: str, record_id: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit that holds headers only, of a payload of `size` bytes."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean_header(url)}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def page_of(record_id: str) -> int | None:
    name = record_id.strip("<>").split(":")[2]
    return None if name == "none" else int(name)


def mark_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """A row for each page whose payload an other page has: page_id, url, digest, payload size, and that page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    digests = stored(pages.select("page_id", "url", F.sha1(html).alias("digest"), F.octet_length(html).cast("bigint").alias("n")), "page-digests")
    groups = digests.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("times"))
    repeated = stored(groups.where("times > 1").drop("times"), "page-groups")
    found = digests.join(repeated, ["digest", "n"]).where("page_id < first")
    return stored(found.select("page_id", "url", "digest", "n", F.col("first").alias("refers_to")), "revisits")


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 1000, frame_bytes: int = 1 << 18, bundle_bytes: int = 1 << 25
) -> DataFrame:
    """Write a WARC record for every row of `pages` into bundles below `folder`; return the index of records.

    Of equal payloads of at least `least_bytes`, the row with the largest page_id is a response and the others
    revisit it; smaller payloads are responses. Only digests and urls are grouped. Responses are written first, so that
    a revisit names the record of its response (of equal rows, the one with the smallest record_id). Every task writes its bundles under a
    hidden name and then renames them, so what a lost executor leaves behind is never read, and returns the
    places of its records; that index is stored in the folder as well. `folder` may be in any store that pyarrow
    and Spark both know by its URI.

    Returns page_id, bundle (file), record_id, frame, start and size (in the unpacked frame). Null html is an
    empty payload; a null url gives a record without one; a row without page_id is a response of its own, and of
    rows that share page_id and payload each is a record. No rows write no bundle. Other columns are not looked at.
    """
    ship(pages.sparkSession)
    revisits = mark_revisits(pages, least_bytes)
    html = F.coalesce(F.col("html"), F.lit(""))
    target = f"{folder.rstrip('/')}/bundles"
    index = f"{folder.rstrip('/')}/index"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = store_of(target)
        store.create_dir(place, recursive=True)
        run, bundle, serial = uuid.uuid4().hex, Bundle(frame_bytes), 0

        def close() -> pa.RecordBatch:
            name = f"{run}-{serial:05d}.warc.zst"
            with store.open_output_stream(f"{place}/_{name}.part") as out:
                out.write(bundle.finish())
            store.move(f"{place}/_{name}.part", f"{place}/{name}")
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            page, record, digests, frame, start, size = [pa.array(x, t) for x, t in zip(zip(*bundle.places, strict=True), kinds, strict=True)]
            file = pa.array([f"{target}/{name}"] * len(page), pa.string())
            return pa.RecordBatch.from_arrays([page, file, record, frame, start, size, digests], names=["page_id", "bundle", "record_id", "frame", "start", "size", "digest"])

        for batch in batches:
            columns = [batch.column(name) for name in ("page_id", "url", "html", "n", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, html, n, digest, refers_to = (c[i].as_py() for c in columns)
                record_id = f"urn:page:{'none' if page is None else page}:{run}-{serial}-{len(bundle.places)}"
                kind = "response" if refers_to is None else "revisit"
                bundle.add((page, record_id, digest), warc_record(kind, record_id, url, html.encode(), n, digest, refers_to))
                if bundle.size() >= bundle_bytes:
                    yield close()
                    bundle, serial = Bundle(frame_bytes), serial + 1
        if bundle.places:
            yield close()

    def add(rows: DataFrame) -> None:
        rows.select("page_id", "url", "html", "n", "digest", "refers_to").mapInArrow(write, WRITTEN_SCHEMA).write.mode("append").parquet(index)

    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("bigint").alias("n"))
    responses = rows.join(revisits.select("page_id", "digest").distinct(), ["page_id", "digest"], "left_anti")
    add(responses.withColumn("refers_to", F.lit(None).cast("string")))
    wanted = revisits.select(F.col("refers_to").alias("page_id"), "digest").distinct()
    written = pages.sparkSession.read.schema(WRITTEN_SCHEMA).parquet(index).join(wanted, ["page_id", "digest"], "left_semi")
    names = stored(written.groupBy(F.col("page_id").alias("refers_to"), "digest").agg(F.min("record_id").alias("name")), "response-names")
    add(revisits.join(names, ["refers_to", "digest"]).select("page_id", "url", F.lit("").alias("html"), "n", "digest", F.col("name").alias("refers_to")))
    return pages.sparkSession.read.schema(INDEX_SCHEMA).parquet(index)


def read_archives(index: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every record of the index, read from the bundles through their seek tables.

    A task opens the bundles of its rows and unpacks each frame once. Payload size and digest are those of the
    full payload: counted from the bytes of a response and checked against its header, stated by a revisit.
    Returns page_id, record_type, refers_to, payload_bytes, payload_digest, url, payload (null for revisits).
    """
    ship(index.sparkSession)
    wanted = columns or [name.split()[0] for name in RECORD_SCHEMA.split(", ")]
    schema = ", ".join(part for part in RECORD_SCHEMA.split(", ") if part.split()[0] in wanted)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, table, number, plain = None, None, [], None, b""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if opened != row["bundle"]:
                    if source is not None:
                        source.close()
                    store, name = store_of(row["bundle"])
                    source, opened, number = store.open_input_file(name), row["bundle"], None
                    table = seek_table(source, source.size())
                if number != row["frame"]:
                    at, packed, _ = table[row["frame"]]
                    source.seek(at)
                    number, plain = row["frame"], zstandard.ZstdDecompressor().decompress(source.read(packed))
                headers, payload = parse_record(plain[row["start"] : row["start"] + row["size"]])
                digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"])
                if headers["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"damaged record {row['record_id']} in {row['bundle']}")
                refers = headers.get("warc-refers-to")
                out.append({
                    "page_id": page_of(headers["warc-record-id"]), "record_type": headers["warc-type"],
                    "refers_to": None if refers is None else page_of(refers), "payload_bytes": size, "payload_digest": digest,
                    "url": headers.get("warc-target-uri"), "payload": payload if headers["warc-type"] == "response" else None,
                })
            kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
            arrays = [pa.array([r[c] for r in out], kinds.get(c, pa.string())) for c in wanted]
            yield pa.RecordBatch.from_arrays(arrays, names=wanted)
        if source is not None:
            source.close()

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = index.repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "start")
    return ordered.mapInArrow(read, schema)


def archive_folder(spark) -> str:
    """A new folder for archives, below the shared folder."""
    return scratch(spark, "archives")
