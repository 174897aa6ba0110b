import base64
import hashlib
import io
import struct

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from linkloom.llm import queries, warc
from linkloom.llm.arrow import storage
from tests.llm.helpers import SF, clashing, table

PAGES = "page_id long, url string, html string"


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def want_of(pages):
    best = {}
    for p in pages:
        if p[0] is not None:
            best[p[2] or ""] = max(best.get(p[2] or "", p[0]), p[0])
    out = []
    for i, _, h in pages:
        keep = best.get(h or "", i)
        out.append((i, len((h or "").encode()), b32(h), "response" if i == keep else "revisit", None if i == keep else keep))
    return sorted(out, key=str)


def through_query(spark, pages, tmp_path):
    spark.createDataFrame(pages, PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op4_warc"](spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_whole_table(spark):
    pages = [(r.page_id, r.url, r.html) for r in table(spark, "pages").collect()]
    got = queries.QUERIES["op4_warc"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r) for r in got.collect()], key=str) == want_of(pages)


def test_awkward_pages(spark, tmp_path):
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://a/\r\nX: y", None), (4, "u", ""), (None, "u", "x"), (5, "ü", "é\r\n\r\nWARC/1.1\r\n" * 3), (6, "u", "y" * 3_000_000),
             (7, "u", "z"), (7, "u", "z"), (8, "u", "z" * 5), (9, "v", "z" * 5)]
    assert through_query(spark, pages, tmp_path) == want_of(pages)


def test_empty_table(spark, tmp_path):
    assert through_query(spark, [], tmp_path) == []


def test_written_files_begin_with_the_dictionary(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(40)], PAGES)
    for r in warc.write_archives(pages, f"file://{tmp_path}/w").collect():
        assert (tmp_path / "w" / r.archive.rpartition("/")[2]).read_bytes()[:4] == struct.pack("<I", 0x184D2A5D)


def test_null_ids_only_and_clashing_columns(spark):
    pages = clashing(spark.createDataFrame([(None, "u", "x"), (None, "u", "x")], PAGES)).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1))
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert [r.record_type for r in got] == ["response"] * 2 and {bytes(r.payload) for r in got} == {b"x"}


def test_least_revisit_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long"), (4, "u", "long")], PAGES)
    got = warc.read_archives(warc.write_archives(pages, least_revisit_bytes=3)).collect()
    assert sorted((r.record_id[-1], r.record_type) for r in got) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]


@pytest.fixture(scope="module")
def records():
    return [warc.page_record(i, f"http://h/{i}", b"<p>text %d</p>" % i * 40, "response", None) for i in range(50)]


@pytest.mark.parametrize("compressed", [True, False])
def test_archive_layout(records, compressed):
    data = warc.archive(records, compressed)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    raw = data[8 : 8 + size]
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw) if compressed else raw
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    got, rest = [], data[8 + size :]
    while rest:
        frame = d.decompressobj()
        got.append(frame.decompress(rest))
        rest = frame.unused_data
    assert got == records
    for chunk in (1, 7, 1000, 1 << 20):
        seen = list(warc.frames(io.BytesIO(data), chunk))
        assert [b for _, b, _ in seen] == records and all(e is None for *_, e in seen)
        for offset, b, _ in seen[::10]:
            frame = d.decompressobj()
            assert frame.decompress(data[offset:]) == b


def test_broken_archives(records):
    data = warc.archive(records)
    ends = lambda x: [e for *_, e in warc.frames(io.BytesIO(x))]
    assert ends(b"") == ["no dictionary frame at the start"] and "cut off" in ends(data[:20])[0]
    cut = ends(data[:-3])
    assert cut[:-1] == [None] * 49 and "cut off" in cut[-1]
    bad = bytearray(data)
    bad[-40] ^= 255
    assert ends(bytes(bad))[:-1] == [None] * 49 and ends(bytes(bad))[-1]


@pytest.mark.parametrize(("change", "error"), [
    (lambda r: r.replace(b"WARC/1.1", b"WARC/9"), "no WARC header"), (lambda r: r.replace(b"WARC-Date", b"X-Date"), "missing warc-date"),
    (lambda r: r + b"x", "length"), (lambda r: r[:-9] + r[-8:], "length"), (lambda r: r.replace(b"text 3", b"text 4", 1), "block digest"),
    (lambda r: r.replace(b"WARC-Block", b"X-Block").replace(b"text 3", b"text 4", 1), "payload digest"), (lambda r: b"", "no WARC header"),
    (lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "), "colon"),
])
def test_faulty_records(records, change, error):
    assert warc.parse_record(records[3])["error"] is None
    assert error in warc.parse_record(change(records[3]))["error"]


def test_reading_a_folder(spark, records, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.warc.zst").write_bytes(warc.archive(records[k * 10 : k * 10 + 10]))
    (tmp_path / "bad.warc.zst").write_bytes(b"nothing of the kind")
    got = warc.read_archives(warc.list_archives(spark, str(tmp_path))).collect()
    assert sorted(r.record_id for r in got if not r.error) == sorted(f"urn:linkloom:page:{i}" for i in range(30))
    assert len([r for r in got if r.error]) == 1


def test_storage_takes_uris(tmp_path):
    fs, path = storage(f"file://{tmp_path}")
    assert fs.get_file_info(path).type == pa.fs.FileType.Directory
