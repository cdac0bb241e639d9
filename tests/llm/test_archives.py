"""Web archives: round trips against brute force, archive format, odd tables."""

import hashlib

import pyarrow.fs
import zstandard

from folio.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string, digest int, size string, locator string, refers int"
BIG = "".join(f"<p>{i} {i * 7919 % 1013}</p>" for i in range(60_000))
SAME = "<html>" + "the same page " * 20 + "</html>"


def rows():
    pages = [
        (5, "http://a/5", SAME), (3, "http://a/3", SAME), (9, None, SAME), (9, None, SAME), (None, "http://n", SAME), (1, "http://a/1", "short"),
        (2, "http://a/2", "short"), (4, "", None), (6, "http://a/x y\r\nWARC-Type: evil", ""), (7, "http://a/7", BIG), (8, "http://a/8", BIG),
        (None, None, "n" * 120), (None, None, "n" * 120), (10, "http://ü/ß", "\r\n\r\nWARC/1.1\r\n\r\n ünï 😀" * 9), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "x" * 100), (14, "u", "x" * 100),
    ]
    return [(i, u, h, "p", n, "s", "l", n) for n, (i, u, h) in enumerate(pages)]


def told(pages):
    """The index by brute force: (page_id, bytes, digest, type, refers_to), sorted."""
    first, out = {}, []
    for i, _, h, *_ in sorted(pages, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        again = len(body) >= 100 and body in first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
        first.setdefault(body, i)
    return sorted(map(repr, out))


def test_round_trip_over_odd_pages(spark):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    manifest = warc.archived(pages, train_bytes=2000, archive_bytes=50_000)
    records = warc.read(manifest).cache()
    assert sorted(repr(tuple(r)) for r in warc.index(records).collect()) == told(rows())
    assert records.where("not intact").count() == 0
    full = warc.resolved(records).where("record_type in ('response', 'revisit')").collect()
    assert sorted(bytes(r.payload) for r in full) == sorted((r[2] or "").encode() for r in rows())
    ids = [r.record_id for r in full]
    assert len(set(ids)) == len(ids) == len(rows())
    assert sum(r.records for r in manifest.collect()) == len(rows())
    assert {r.target_uri for r in full} >= {"http://a/x%20y%0D%0AWARC-Type:%20evil", "http://%C3%BC/%C3%9F", None}
    assert warc.index(warc.read(manifest, payloads=False)).count() == len(rows())


def test_every_record_is_a_frame_of_its_own(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>page number {i * 37 % 1009} of many, with words that repeat</p>" * 9) for i in range(400)], "page_id bigint, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    [row] = warc.archived(spark.read.parquet(f"{tmp_path}/pages")).collect()
    fs, path = pyarrow.fs.FileSystem.from_uri(row.archive)
    data = fs.open_input_file(path).read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    words = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert words[:4] == bytes.fromhex("37a430ec") and row.dictionary_bytes == len(words)  # a trained dictionary
    context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest, seen = data[8 + size :], 0
    while rest:
        frame = context.decompressobj()
        text = frame.decompress(rest)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and text.count(b"WARC-Record-ID") == 1
        rest, seen = frame.unused_data, seen + 1
    assert seen == row.records + 1 == 401 and len(data) == row.stored_bytes
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(warc.page_record("urn:page:1:1", "http://a/1", "0" * 64, 9, None, b"<p>page number 1 of many, with words that repeat</p>" * 9))) for _ in range(401))
    assert len(data) - size < plain  # the dictionary shortens short records


def test_reader_takes_archives_of_others_and_tells_damage(spark, tmp_path):
    good = warc.page_record("urn:x:1", "http://a", hashlib.sha256(b"body").hexdigest(), 4, None, b"body")
    bad = warc.page_record("urn:x:2", "http://a", hashlib.sha256(b"body").hexdigest(), 4, None, b"bogy")
    squeeze = zstandard.ZstdCompressor().compress
    skip = (0x184D2A51).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    (tmp_path / "a.warc.zst").write_bytes(squeeze(good) + skip + squeeze(bad) + squeeze(warc.record("metadata", "urn:x:3", [], b"free")))
    got = warc.read(spark.createDataFrame([(f"file://{tmp_path}/a.warc.zst",), (None,)], "archive string")).orderBy("record_id").collect()
    assert [(r.record_type, bytes(r.payload), r.intact) for r in got] == [("response", b"body", True), ("response", b"bogy", False), ("metadata", b"free", True)]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.archived(none).count() == 0 and warc.index(warc.read(warc.archived(none))).count() == 0
