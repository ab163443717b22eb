"""WARC archives compressed record by record with a Zstandard dictionary of their own.

A writer task buffers its first records, trains a dictionary on them, and starts the archive with
a skippable frame (magic 0x184D2A5D) that holds it; after that every record is one Zstandard frame,
so that any record can be read alone. A task starts a new archive after ``roll_bytes``. If there is
too little to train on, the archive has no dictionary frame and plain frames.

Records with equal payloads of at least ``least`` bytes: the one with the smallest id is a response,
the others are revisits that name it and carry no payload, only its digest and length. The archives
go to a folder that the whole cluster shares, under names that no two attempts share; a manifest
written by Spark lists the archives of the attempts that counted, and only these are read.

Defined results: a null payload is empty; a null url becomes ``urn:relspark:page:<id>``, a line
break in a url a space; rows with a null id are written as responses of their own, and repeated rows
as often as they occur (of rows that share the smallest id each is a response). An empty table writes no
archive and reads as an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep, shared_dir

MAGIC = 0x184D2A5D
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
RECORD_COLUMNS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record with its two closing line breaks."""
    url = (url or f"urn:relspark:page:{page_id}").replace("\r", " ").replace("\n", " ")
    block = _HTTP % (0 if refers_to is not None else size) + (b"" if refers_to is not None else payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest and length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    payload = block.partition(b"\r\n\r\n")[2]
    digest, size = field["WARC-Payload-Digest"].removeprefix("sha256:"), int(field["X-Payload-Length"])
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(field[name]) if name in field else None
    return {"page_id": number("X-Page-ID"), "url": field["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": None if revisit else payload}


class Archive:
    """Writes records to a binary file object."""

    def __init__(self, sink, samples: list[bytes], dictionary_bytes: int, level: int):
        self.sink, self.written = sink, 0
        trained = None
        if len(samples) >= 16:
            try:
                trained = zstandard.train_dictionary(min(dictionary_bytes, max(1024, sum(map(len, samples)) // 8)), samples)
            except zstandard.ZstdError:  # too little or too uniform to train on
                trained = None
        if trained is not None:
            body = trained.as_bytes()
            self._put(struct.pack("<II", MAGIC, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.written += len(raw)

    def add(self, raw: bytes) -> None:
        self._put(self.compressor.compress(raw))


def read_archive(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, one frame after the other, with bounded memory."""
    head = source.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
        dictionary, head = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1])), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    pending = head
    while True:
        pending = pending or source.read(chunk)
        if not pending:
            return
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if not pending and not (pending := source.read(chunk)):
                raise ValueError("an archive ends inside a record")
            part, pending = pending[: 1 << 14], pending[1 << 14 :]
            out.append(frame.decompress(part))
            if frame.eof:
                pending = frame.unused_data + pending
            # else all of the part was consumed
        yield b"".join(out)


def _open(path: str, write: bool):
    """A stream of a file in any store that pyarrow knows by its URI."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    # the name ends in .zst, but the frames are ours: no compression on top
    return store.open_output_stream(inner, compression=None) if write else store.open_input_stream(inner, compression=None)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, roll_bytes: int = 64 << 20, sample_bytes: int = 4 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives into ``folder``; returns the kept manifest (path, records, bytes)."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    # groups of equal payloads, summed where they are before they are shuffled; only true groups are joined
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = rows.where(F.col("size") >= least).select("page_id", "digest").join(first, "digest").where("page_id > first").select("page_id", F.col("digest").alias("d"), "first").distinct()
    later = keep(later, "revisits", folder)
    rows = rows.join(later.withColumnRenamed("page_id", "p"), (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = rows.select("page_id", "url", "html", "size", "digest", F.col("first").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = sink = path = None
        held, held_bytes, records = [], 0, 0
        done = []

        def start() -> None:
            nonlocal archive, sink, path, held, held_bytes, records
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            sink = _open(path, write=True)
            archive = Archive(sink, held, dictionary_bytes, level)
            for raw in held:
                archive.add(raw)
            records, held, held_bytes = len(held), [], 0

        def stop() -> None:
            nonlocal archive, sink
            sink.close()
            done.append((path, records, archive.written))
            archive = sink = None

        for batch in batches:
            for r in batch.to_pylist():
                raw = record(r["page_id"], r["url"], r["html"].encode(), r["size"], r["digest"], r["refers_to"], date)
                if archive is None:
                    held.append(raw)
                    held_bytes += len(raw)
                    if held_bytes >= sample_bytes:
                        start()
                else:
                    archive.add(raw)
                    records += 1
                    if archive.written >= roll_bytes:
                        stop()
        if held:
            start()
        if archive is not None:
            stop()
        yield pa.record_batch([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return keep(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest", folder)


def read_archives(manifest: DataFrame, *, with_payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """Every record of the archives whose ``path`` the manifest lists."""
    columns = RECORD_COLUMNS if with_payload else RECORD_COLUMNS.removesuffix(", payload binary")
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path, write=False) as source:
                    for raw in read_archive(source):
                        rows.append({k: v for k, v in parse(raw).items() if k in names})
                        held += len(raw)
                        if held >= batch_bytes or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    spread = manifest.select("path").repartition(max(1, min(10_000, manifest.count())), "path")
    return spread.mapInArrow(run, columns)


def warc_query(spark, sf_dir: str) -> DataFrame:
    """Write all pages as records, read the archives back, and return what they say of each page."""
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark))
    found = read_archives(manifest, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON d = payload_digest AND payload_bytes >= 100
"""
