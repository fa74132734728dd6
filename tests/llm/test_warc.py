from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F
from tools import rows

from docfacts.llm import warc

PAGES = "page_id long, url string, html string"


def record(page: int, payload: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_round_trip(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\x1f"
    data = [(1, "http://a/ b\r\nX: y", "same"), (5, None, "same"), (3, "u", "same"), (2, "u", None), (9, "u", ""), (4, "u", tricky), (6, "u", "é" * 50_000), (None, "u", "same"), (7, "u", "one"), (7, "u", "one")]
    frame = spark.createDataFrame(data, PAGES).withColumn("digest", F.lit("clash")).withColumn("bytes", F.lit(1))
    expected = []
    for i, _, html in data:
        raw = (html or "").encode()
        top = max((j for j, _, h in data if j is not None and (h or "") == (html or "")), default=None)
        revisit = i is not None and i < top
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert rows(warc.round_trip(frame)) == sorted(expected, key=repr)
    assert warc.round_trip(frame.where("false")).count() == 0


def test_small_payloads_are_all_responses(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    found = rows(warc.round_trip(frame, min_bytes=3), "page_id", "record_type", "refers_to")
    assert found == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_payloads_come_back(spark, tmp_path):
    frame = spark.createDataFrame([(k, "u", f"text {k}" * k) for k in range(30)], PAGES)
    folder = str(tmp_path / "archives")
    warc.write_archives(frame, folder, records=4)
    back = warc.read_archives(spark, folder)
    assert back.where("gap is not null").count() == 0
    assert rows(back, "page_id", "payload") == sorted(((k, bytearray(f"text {k}".encode() * k)) for k in range(30)), key=repr)
    assert back.select("archive").distinct().count() >= 8


def kept(data: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    found = list(warc.salvage(data))
    return [f["page_id"] for _, _, f in found if isinstance(f, dict)], [(a, b) for a, b, f in found if isinstance(f, str)]


def test_salvage_of_plain_records():
    parts = [record(k, f"payload {k}".encode() * 5) for k in range(5)]
    whole = b"".join(parts)
    assert kept(whole) == ([0, 1, 2, 3, 4], [])
    at = len(parts[0])
    broken = bytearray(whole)
    broken[at + len(parts[1]) - 8] ^= 1  # a byte of the payload: the digest fails
    assert kept(bytes(broken)) == ([0, 2, 3, 4], [(at, at + len(parts[1]))])
    assert kept(whole[:at] + b"junk" + whole[at:]) == ([0, 1, 2, 3, 4], [(at, at + 4)])
    assert kept(whole[: at + 30]) == ([0], [(at, at + 30)])
    assert kept(b"") == ([], [])
    assert kept(b"\x1f\x8b\x08 no archive") == ([], [(0, 14)])


def test_salvage_of_members():
    parts = [gzip.compress(record(k, f"payload {k}".encode() * 50)) for k in range(4)]
    whole = b"".join(parts)
    assert kept(whole) == ([0, 1, 2, 3], [])
    broken = bytearray(whole)
    broken[len(parts[0]) + 20] ^= 0xFF
    assert kept(bytes(broken)) == ([0, 2, 3], [(len(parts[0]), len(parts[0]) + len(parts[1]))])
    mixed = parts[0] + record(9, b"plain") + parts[1][:-5] + parts[2]
    start = len(parts[0] + record(9, b"plain"))
    # The trailer of a member is cut: its record could still be inflated.
    assert kept(mixed) == ([0, 9, 1, 2], [(start, start + len(parts[1]) - 5)])


def test_salvage_inside_a_member():
    """One damaged record of six in one member costs that record alone."""
    parts = [record(k, f"payload {k}".encode() * 60) for k in range(6)]
    content = bytearray(b"".join(parts))
    content[len(parts[0]) + len(parts[1]) - 9] ^= 1
    member = gzip.compress(bytes(content))
    found = list(warc.salvage(member))
    assert [f["page_id"] for _, _, f in found if isinstance(f, dict)] == [0, 2, 3, 4, 5]
    gaps = [(a, b, f) for a, b, f in found if isinstance(f, str)]
    assert gaps == [(0, len(member), f"digest in member, {len(parts[0])} to {len(parts[0]) + len(parts[1])}")]
    # Bytes of the trailer, or of the stream, are cut or changed: what came before is kept, and reading goes on after it.
    whole = gzip.compress(b"".join(parts))
    for cut in (4, 1, 9):
        assert kept(whole[:-cut] + parts[0])[0][:5] == [0, 1, 2, 3, 4] and kept(whole[:-cut] + parts[0])[0][-1] == 0
    changed = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:]
    assert kept(changed + record(7, b"after")) == ([0, 1, 2, 3, 4, 5, 7], [(0, len(whole))])


def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 60_000)
    frame = spark.createDataFrame([(k, "u", "x" * 10_000 + str(k)) for k in range(20)], PAGES).coalesce(1)
    warc.write_archives(frame, str(tmp_path / "a"))
    sizes = [p.stat().st_size for p in (tmp_path / "a").glob("part-*")]
    assert len(sizes) >= 5 and max(sizes) <= 60_000
    assert rows(warc.read_archives(spark, str(tmp_path / "a")), "page_id") == [(k,) for k in sorted(range(20), key=lambda k: repr((k,)))]


def test_a_gap_fails_the_round_trip(spark, monkeypatch):
    original = warc.write_archives

    def damaged(pages, folder, *rest):
        original(pages, folder, *rest)
        spark.range(1).select(F.lit("WARC/1.1 cut").alias("value")).write.mode("append").text(folder)

    monkeypatch.setattr(warc, "write_archives", damaged)
    with pytest.raises(Exception, match="gap in"):
        warc.round_trip(spark.createDataFrame([(1, "u", "a")], PAGES)).collect()
