"""Web archives: WARC records in dictionary-compressed Zstandard files, and back.

Method: dictionary-compressed writer.  Each task buffers the first ``TRAIN_BYTES`` of its archive's records, trains a
Zstandard dictionary on them and embeds it in a leading skippable frame; every record is then a frame of its own,
compressed with that dictionary, so a reader may start at any record once it has the first frame.  A payload that an
earlier record holds is not stored again: a revisit record names the record that has it.

Archives are written by the tasks through ``pyarrow.fs``, so the shared folder may be any store it opens (a mounted folder,
hdfs, s3, gs).  Each attempt of a task takes new file names and reports them as rows; only what Spark has committed of these
rows, the manifest, is read, so a lost executor or a task that ran twice leaves at most files that nobody names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import ORACLES, blocks, parted, register, released, table, tasks
from folio.session import materialise, scratch_path

TRAIN_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 4_000_000
READ_BYTES = 1 << 17
LEVEL = 3
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the archive formats: the frame that holds a dictionary, the first of the skippable frames, a revisit's profile.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = 0x184D2A50
ZSTD_FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "archive string, records bigint, raw_bytes bigint, stored_bytes bigint, dictionary_bytes bigint"


def record(kind: str, record_id: str, fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record; fields without a value are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in head if v is not None], "\r\n"]).encode() + block + b"\r\n\r\n"


def page_record(record_id: str, url: str | None, digest: str, size: int, refers: str | None, payload: bytes) -> bytes:
    """A response with its payload, or a revisit of record ``refers``, which has only the head of the answer."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    target = ("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else None)
    known = ("WARC-Payload-Digest", f"sha256:{digest}")
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers is None:
        return record("response", record_id, [target, known, kind], http + payload)
    return record("revisit", record_id, [target, known, ("WARC-Refers-To", f"<{refers}>"), ("WARC-Profile", PROFILE), kind], http)


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the records ``samples``; where they are too few or too short to train one, their own bytes are it."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=1024, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One file: a skippable frame with the dictionary, then a frame a record."""

    def __init__(self, place: str, samples: list[bytes]):
        fs, folder = pa.fs.FileSystem.from_uri(place)
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.uri, self.records, self.raw = f"{place}/{name}", 0, 0
        dictionary = trained(samples)
        self.dictionary_bytes = len(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        dictionary.precompute_compress(level=LEVEL)
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        self.out = fs.open_output_stream(f"{folder}/{name}", compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        info = b"software: folio\r\nformat: WARC File Format 1.1\r\n"
        self.out.write(self.compressor.compress(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", [("Content-Type", "application/warc-fields")], info)))
        for s in samples:
            self.add(s)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))
        self.records += 1
        self.raw += len(data)

    def close(self) -> pa.RecordBatch:
        stored = self.out.tell()
        self.out.close()
        row = [self.uri, self.records, self.raw, stored, self.dictionary_bytes]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["archive", "records", "raw_bytes", "stored_bytes", "dictionary_bytes"])


def archived(pages: DataFrame, *, train_bytes: int = TRAIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and return their manifest, a written table.

    Manifest: archive, records, raw_bytes, stored_bytes, dictionary_bytes.  Every row becomes one record, its payload the html
    in UTF-8, null as empty.  Of payloads that are equal (by SHA-256) and have ``least`` bytes or more, the row with the smallest
    ``page_id`` is the response and the others revisit it; a null ``page_id`` comes last, and of rows with one ``page_id``
    any one, exactly one, is the response.  A record's identifier is ``urn:page:<page_id>:<number of the row>``, without the
    page for a null one.  A null or empty url has no field; other characters than visible ASCII are percent-encoded.  Other
    columns play no part.  An empty table writes no archive.
    """
    spark = pages.sparkSession
    place = f"{scratch_path(spark)}/warc"
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = materialise(pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("locator")))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "locator")).alias("first")
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1")
    number = lambda page, at: F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), at.cast("string"))
    refers = number(F.col("first.page_id"), F.col("first.locator")).alias("refers")
    revisits = materialise(rows.select("digest", "locator").join(repeated, "digest").where("locator <> first.locator").select("locator", refers))
    again, once = parted(rows, "locator", revisits)
    again = again.join(revisits, "locator", "left").withColumn("payload", F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    told = again.unionByName(once.withColumn("refers", F.lit(None).cast("string"))).select(
        number(F.col("page_id"), F.col("locator")).alias("record_id"), "url", "digest", "size", "refers", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(place)
        fs.create_dir(folder, recursive=True)
        archive, held, size = None, [], 0
        for b in blocks(batches, "payload", BLOCK_BYTES):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = page_record(*row)
                if archive is not None:
                    archive.add(data)
                else:
                    held.append(data)
                    size += len(data)
                    if size >= train_bytes:
                        archive, held, size = Archive(place, held), [], 0
                if archive is not None and archive.raw >= archive_bytes:
                    yield archive.close()
                    archive = None
        if held:
            archive = Archive(place, held)
        if archive is not None:
            yield archive.close()

    return materialise(told.mapInArrow(lambda b: released(run(b)), MANIFEST))


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(magic number, content) of every frame of a stream: records decompressed, skippable frames as they stand.

    The dictionary in a leading skippable frame, itself compressed or not, is used for all that follows.  An archive that
    ends within a frame is an error.
    """
    context = zstandard.ZstdDecompressor()
    buf = stream.read(READ_BYTES)

    def filled(buf: bytes, n: int) -> bytes:
        while len(buf) < n:
            more = stream.read(max(READ_BYTES, n - len(buf)))
            if not more:
                raise ValueError("an archive ends within a frame")
            buf += more
        return buf

    while buf := buf or stream.read(READ_BYTES):
        buf = filled(buf, 4)
        magic = struct.unpack_from("<I", buf)[0]
        if SKIPPABLE <= magic < SKIPPABLE + 16:
            size = struct.unpack_from("<I", filled(buf, 8), 4)[0]
            buf = filled(buf, 8 + size)
            content, buf = buf[8 : 8 + size], buf[8 + size :]
            if magic == DICTIONARY_FRAME:
                packed = len(content) > 4 and struct.unpack_from("<I", content)[0] == ZSTD_FRAME
                content = zstandard.ZstdDecompressor().decompress(content) if packed else content
                context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            yield magic, content
            continue
        frame = context.decompressobj()
        parts = [frame.decompress(buf)]
        while not frame.eof:
            parts.append(frame.decompress(filled(b"", 1)))
        buf = frame.unused_data
        yield magic, b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


RECORDS = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def _entry(archive: str, data: bytes, payloads: bool) -> tuple:
    fields, block = parsed(data)
    kind = fields["warc-type"]
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    said = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    http, _, body = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if kind == "revisit":
        sizes = [int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        return archive, bare("warc-record-id"), kind, fields.get("warc-target-uri"), bare("warc-refers-to"), said, sizes[0] if sizes else None, True, None
    found = hashlib.sha256(body).hexdigest()
    return (archive, bare("warc-record-id"), kind, fields.get("warc-target-uri"), bare("warc-refers-to"), found, len(body), said in (None, found), body if payloads else None)


def read(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of ``archives`` (archive: a place ``pyarrow.fs`` opens), one row each, streamed frame by frame.

    archive, record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, intact, payload.  Digest and size of a
    response are taken from the payload as read, and ``intact`` tells whether the digest is the one the record names; a revisit
    has those of the payload it refers to, as it names them, and no payload.  Without ``payloads`` that column is null.
    No archives give no rows; other columns of ``archives`` play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("archive").to_pylist():
                fs, path = pa.fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as stream:
                    for magic, data in frames(stream):
                        if SKIPPABLE <= magic < SKIPPABLE + 16:
                            continue
                        rows.append(_entry(uri, data, payloads))
                        size += 200 + (len(data) if payloads else 0)
                        if size >= BLOCK_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    schema = ", ".join(f"{f.name} {'bigint' if f.type == pa.int64() else 'boolean' if f.type == pa.bool_() else f.type}" for f in RECORDS)
    spread = archives.where(F.col("archive").isNotNull()).select("archive").repartition(tasks(archives.sparkSession))
    return spread.mapInArrow(lambda b: released(run(b)), schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORDS, strict=True)], schema=RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` of :func:`read` with the payload of every revisit, taken from the response it refers to."""
    had = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload").alias("_had"))
    return records.join(had, "refers_to", "left").withColumn("payload", F.coalesce("payload", "_had")).select(records.columns)


def page_of(record_id) -> F.Column:
    """The page an identifier of :func:`archived` names."""
    found = F.regexp_extract(record_id, r"^urn:page:(-?\d+):", 1)
    return F.when(found != "", found).cast("bigint")


def index(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page) of the page records of :func:`archived`."""
    return records.where(F.col("record_type").isin("response", "revisit")).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


@register
def op11_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives, and what the archives say of it when read back."""
    return index(read(archived(table(spark, sf, "pages")), payloads=False))


ORACLES["op11_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS n,
         first(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN strlen(html) >= 100 AND n > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 100 AND n > 1 THEN first_id END AS refers_to
FROM p
"""
