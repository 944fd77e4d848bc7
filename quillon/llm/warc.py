"""WARC archives, compressed with a dictionary that each archive brings along.

An archive is a ``.warc.zst`` file: a leading skippable frame (magic 0x184D2A5D) holds a
Zstandard dictionary, itself compressed, and every record behind it is a frame of its own,
compressed with that dictionary. The dictionary is built from the archive's first records
(at most :data:`SAMPLE_BYTES` of them are held back, or one longer record). Archives
with too few records to build one from have no such frame, as the format allows.

Payloads are stored once. Of records with equal payloads (by SHA-256) of at least ``least``
bytes, the one with the smallest key is a response, the others are revisit records of
it; they have its HTTP head, which says the payload's length, and no payload.

1. Digests are counted without the payloads; of texts that occur twice the smallest key
   is found, and stored. Copies are combined in each task before that shuffle.
2. The :data:`HOT` most frequent digests are broadcast (a bounded list), and pages
   that have them are spread; each other digest is at most one in :data:`HOT` of all rows
   and is met by a join. Payloads of revisits go no further.
3. Each task writes archives of its own name in the shared folder and returns a row of the
   manifest for each, which Spark commits. Only named archives count: what a lost or
   repeated task left behind is in no manifest. Memory is the sample and one record.
4. The archives of a manifest are read back in tasks, record by record, and
   every payload is held against its digest, their number against the manifest.

Defined results: a null payload is empty; a null key comes last and is read back as null;
of repeated smallest keys the one with the smallest address is the response (null last),
of wholly repeated rows one; a null address is ``about:blank``, and controls and blanks in
one are percent-encoded; very long payloads are records like any other, whole; an
empty table makes no archive and no rows. Columns beside key, address and payload are
not read, whatever their names.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, delete_at_exit, hadoop_path, lean, shared_dir, table

# Fixed values of the formats.
DICTIONARY_FRAME, ZSTD_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, LEVEL = 4 << 20, 112_640, 1 << 30, 3
#: So many of the most frequent payloads are known to all tasks.
HOT = 1000
MANIFEST = "file string, records long, stored_bytes long, dictionary_bytes long"
RECORDS = "file string, key string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _address(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page: dict, own_id: uuid.UUID, date: str) -> bytes:
    """The record of one page: ``first`` is set for a revisit, and holds its response."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['size']}\r\n\r\n".encode()
    first = page["first"]
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{own_id if first or not page['shared'] else uuid.UUID(bytes=page['digest'][:16], version=5)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _address(page["url"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32(page['sha1'])}"),
        ("Page-Key", page["key"]),
    ]
    if first:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(bytes=page['digest'][:16], version=5)}>"), ("WARC-Refers-To-Target-URI", _address(first["url"])), ("WARC-Refers-To-Date", date), ("Refers-To-Page-Key", first["key"])]
    return record(fields, head if first else head + (page["html"] or "").encode())


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most a tenth of the samples, none if they are too few."""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples) if size >= 256 and len(samples) >= 8 else None
    except zstandard.ZstdError:  # nothing that the samples share
        return None


class Archive:
    """One archive while it is written."""

    def __init__(self, folder: str, date: str, sample: int):
        self.name, self.date, self.sample = uuid.uuid4(), date, sample
        self.file = f"{folder}/{self.name}.warc.zst"
        self.records, self.stored, self.size_of_dictionary = 0, 0, 0
        self.held: list[bytes] | None = []
        self.held_bytes, self.press, self.out = 0, None, None

    def add(self, page: dict) -> None:
        data = page_record(page, uuid.uuid5(self.name, str(self.records)), self.date)
        self.records += 1
        if self.held is None:
            self._write(self.press.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= self.sample:
            self._start()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.stored += len(data)

    def _start(self) -> None:
        files, path = located(self.file)
        self.out = files.open_output_stream(path, compression=None)
        made = dictionary(self.held)
        if made is not None:
            content = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
            self.size_of_dictionary = len(content)
            self._write(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{self.name}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"software: quillon\r\nformat: WARC File Format 1.1\r\n")
        for data in [info, *self.held]:
            self._write(self.press.compress(data))
        self.held = None

    def close(self) -> pa.RecordBatch:
        if self.held is not None:
            self._start()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.file]), pa.array([self.records]), pa.array([self.stored]), pa.array([self.size_of_dictionary])], ["file", "records", "stored_bytes", "dictionary_bytes"])

    def abandon(self) -> None:
        if self.out is not None:
            self.out.close()
            files, path = located(self.file)
            files.delete_file(path)


def _written(folder: str, date: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive = None
    try:
        for batch in batches:
            for page in (row for part in range(0, len(batch), 64) for row in batch.slice(part, 64).to_pylist()):
                archive = archive or Archive(folder, date, min(SAMPLE_BYTES, most))
                archive.add(page)
                if archive.stored >= most:
                    done, archive = archive, None
                    yield done.close()
        if archive is not None:
            done, archive = archive, None
            yield done.close()
    finally:
        if archive is not None:
            archive.abandon()


def typed(pages: DataFrame, shelf: Shelf, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """key, url, html (null for revisits), size, sha1, digest, shared, first (its response's
    key and url, of a revisit) of every page."""
    html = F.coalesce(pages[payload], F.lit(""))
    known = F.struct(pages[key].isNull().alias("no_key"), pages[key].alias("order"), pages[url].isNull().alias("no_url"), pages[url].alias("url"))
    rows = pages.select(known.alias("who"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.unhex(F.sha2(html, 256)).alias("digest"))
    each = rows.filter(F.col("size") >= least).groupBy("digest", "who").agg(F.count(F.lit(1)).alias("n"))
    twice = each.groupBy("digest").agg(F.sum("n").alias("n"), F.min(F.struct("who", "n")).alias("first")).filter("n > 1")
    twice = shelf.put("twice", twice.select("digest", "n", F.col("first.who").alias("first"), F.col("first.n").alias("same")))
    hot = F.broadcast(twice.orderBy(F.desc("n"), "digest").limit(HOT))
    rest = twice.join(hot.select("digest"), "digest", "left_anti")
    side = lambda df, name: df.select(F.col("digest").alias(f"{name}_digest"), F.struct("first", "same").alias(name))
    met = rows.join(F.broadcast(side(hot, "hot")), F.col("digest") == F.col("hot_digest"), "left")
    # what a hot digest has answered meets no other one, and is spread by its key
    met = met.withColumn("_k", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2(F.to_json("who"), 224))))
    met = met.join(side(rest, "rest"), F.col("_k") == F.col("rest_digest"), "left")
    met = met.withColumn("f", F.when(F.col("size") >= least, F.coalesce("hot", "rest")))
    first = F.col("f.first").eqNullSafe(F.col("who"))
    answer = F.when(F.col("f").isNotNull() & ~first, F.struct(F.col("f.first.order").cast("string").alias("key"), F.col("f.first.url").alias("url")))
    out = met.withColumn("answer", answer)
    shape = lambda df: df.select(F.col("who.order").cast("string").alias("key"), F.col("who.url").alias("url"), F.when(F.col("answer").isNull(), F.col("html")).alias("html"), "size", "sha1", "digest", F.col("f").isNotNull().alias("shared"), F.col("answer").alias("first"))
    if twice.filter("same > 1").isEmpty():
        return shape(out)
    # wholly repeated rows that come first: one is the response, as many others revisit it
    again = F.col("f").isNotNull() & first & (F.col("f.same") > 1)
    one = out.filter(again).groupBy("digest", "who", "size", "sha1", "f").agg(F.max("html").alias("html"))
    one = one.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("f.same"))))
    one = one.withColumn("answer", F.when(F.col("i") > 1, F.struct(F.col("who.order").cast("string").alias("key"), F.col("who.url").alias("url"))))
    return shape(out.filter(~again)).unionByName(shape(one))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, most: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes archives of about ``most`` bytes into a shared folder; the manifest: file, records,
    stored_bytes, dictionary_bytes."""
    spark = pages.sparkSession
    files, place = hadoop_path(spark, folder)
    files.mkdirs(place)
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    shelf = Shelf(spark)

    def run(batches):
        return _written(folder, date, most, batches)

    manifest = shelf.put("manifest", typed(pages, shelf, key, url, payload, least).mapInArrow(lean(run), MANIFEST))
    shelf.clear("manifest")
    return manifest


def records(file: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive, one in memory at a time."""
    files, path = located(file)
    with files.open_input_stream(path, compression=None) as source:
        head = source.read(8)
        made = None
        if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
            content = source.read(struct.unpack("<II", head)[1])
            if content[:4] == struct.pack("<I", ZSTD_MAGIC):
                content = zstandard.ZstdDecompressor().decompress(content)
            made, head = zstandard.ZstdCompressionDict(content), b""
        unpack = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
        plain = io.BufferedReader(unpack.stream_reader(_Joined(head, source), read_across_frames=True), 1 << 20)
        while line := plain.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{file}: no record where one should begin")
            fields = {}
            while (line := plain.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(":")
                fields[name.strip().lower()] = value.strip()
            block = plain.read(int(fields["content-length"]))
            if len(block) != int(fields["content-length"]) or plain.read(4) != b"\r\n\r\n":
                raise ValueError(f"{file}: a record ends too soon")
            yield fields, block


class _Joined(io.RawIOBase):
    """A stream with bytes put back in front."""

    def __init__(self, head: bytes, source):
        self.head, self.source = head, source

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        if self.head:
            head, self.head = self.head, b""
            return head
        return self.source.read(size if size >= 0 else None)


def _page(file: str, fields: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """One row of :data:`RECORDS`; a payload that is not what its digest says raises."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)", head)[1])
    if fields["warc-type"] == "response" and (base32(hashlib.sha1(payload).digest()) != said or len(payload) != size):
        raise ValueError(f"{file}: the payload of {fields['warc-record-id']} is not what was archived")
    return file, fields.get("page-key"), fields["warc-target-uri"], payload if payloads and fields["warc-type"] == "response" else None, size, said, fields["warc-type"], fields.get("refers-to-page-key")


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of a manifest's archives (:data:`RECORDS`); payloads of revisits are
    null, as is every payload without ``payloads``."""
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in RECORDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                for fields, block in records(file):
                    if fields["warc-type"] in ("response", "revisit"):
                        rows.append(_page(file, fields, block, payloads))
                        held += len(block) if payloads else 100
                        n += 1
                    if held >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
                if n != said:
                    raise ValueError(f"{file}: {n} records of {said}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return manifest.select("file", "records").repartition(max(1, manifest.count())).mapInArrow(lean(run), RECORDS)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    manifest = write(table(spark, sf_dir, "pages"), folder)
    delete_at_exit(spark, folder)
    kind = "bigint"
    return read(manifest, payloads=False).select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


_V = "CAST('0x' || substr(h, {0}, 5) AS BIGINT)"
_CHAR = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({0} >> {1}) & 31 AS INTEGER) + 1, 1)"
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS r,
  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST) AS first FROM pages),
d AS (SELECT *, sha1(t) AS h FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {" || ".join(_CHAR.format(_V.format(i * 5 + 1), s) for i in range(8) for s in (15, 10, 5, 0))} AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to
FROM d
"""
