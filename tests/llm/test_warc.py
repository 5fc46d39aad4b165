import hashlib
import struct

import pytest
import zstandard

from marketloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, payload string"


def expected(rows):
    body = {i: (h or "").encode() for i, (_, _, h, _) in enumerate(rows)}
    out = []
    for k, (i, *_) in enumerate(rows):
        same = [rows[j][0] for j in body if body[j] == body[k] and rows[j][0] is not None]
        first = min(same, default=None)
        revisit = len(body[k]) >= 100 and first is not None and first != i
        out.append((str(i), len(body[k]), hashlib.sha256(body[k]).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_give_back_every_page(spark):
    rows = [(1, None, None, "x"), (2, "http://a b\r\nWARC-Type: x", "é" * 60, "x"), (3, None, "é" * 60, "x"), (None, "u", "é" * 60, "x"), (3, "z", "é" * 60, "x"), (2, "q", "é" * 60, "x")]
    rows += [(5, "v", "short", "x"), (6, "v", "short", "x"), (7, "v", "\r\n\r\n" * 40, "x"), (8, "v", "long " * 500_000, "x"), (9, "v", "n" * 99, "x"), (10, "v", "n" * 99, "x"), (11, "v", "n" * 100, "x"), (12, "v", "n" * 100, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = warc.archived(df).collect()
    assert sorted([(str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=str) == expected(rows)
    assert [r.target_uri for r in out if r.page_id == 2 and "WARC" in (r.target_uri or "")] == ["http://a%20b%0D%0AWARC-Type:%20x"]
    assert warc.archived(df.limit(0)).count() == 0


@pytest.fixture()
def archive(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>page {i} of many words and {i * i}</p>" * 20, "x") for i in range(300)]
    paths = [r.path for r in warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{tmp_path}/w").collect()]
    assert len(paths) == 1
    return paths[0].removeprefix("file://")


def test_the_dictionary_leads_and_each_record_has_a_frame(archive):
    data = open(archive, "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE_MAGIC
    words = zstandard.ZstdDecompressor().decompressobj().decompress(data[8:8 + size])
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    at, n = 8 + size, 0
    while at < len(data):
        inner = frames.decompressobj()
        assert inner.decompress(data[at:]).startswith(b"WARC/1.1\r\n") and inner.eof
        at, n = len(data) - len(inner.unused_data), n + 1
    assert n == 300 == len(list(warc.records(archive)))


def test_damage_is_reported(spark, archive, tmp_path):
    data = open(archive, "rb").read()
    cut = tmp_path / "cut.warc.zst"
    cut.write_bytes(data[:-7])
    found = list(warc.records(str(cut)))
    assert len(found) == 300 and "ends inside a frame" in found[-1]["error"] and all("error" not in r for r in found[:-1])
    wrong = tmp_path / "wrong.warc.zst"
    flipped = bytearray(data)
    flipped[-20] ^= 1
    wrong.write_bytes(flipped)
    assert "error" in list(warc.records(str(wrong)))[-1]
    with pytest.raises(Exception, match="ends inside a frame"):
        warc.checked(warc.read(spark.createDataFrame([(str(cut),)], "path string"))).select("record_type").collect()


@pytest.mark.parametrize("change, why", [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), "version"), (lambda r: r.replace(b"WARC-Date: d\r\n", b""), "without warc-date"),
    (lambda r: r[:-5] + r[-4:], "Content-Length"), (lambda r: r.replace(b"body", b"bodx"), "digest"),
    (lambda r: r.replace(b"WARC-Type", b"WARC Type\r\nx"), "bad header"), (lambda r: r.replace(b"Content-Length: 4\r\n\r\nbody", b"Content-Length: 5\r\n\r\nbody"), "announced")])
def test_headers_and_lengths_are_validated(change, why):
    record = warc.record(1, "u", b"body", hashlib.sha256(b"body").hexdigest(), None, "d")
    assert warc.parsed(record)["payload"] == b"body"
    with pytest.raises(warc.Damaged, match=why):
        warc.parsed(change(record))
