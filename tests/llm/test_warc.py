"""Archives: an exact round trip, and records read by a plain parser of the format."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pricemill.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_records(folder):
    """(headers, block) of every record, by Content-Length alone."""
    for path in sorted(Path(folder).glob("part-*")):
        data, at = gzip.decompress(path.read_bytes()), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode().split("\r\n")[1:]
            headers = dict(line.split(": ", 1) for line in lines)
            size = int(headers["Content-Length"])
            block = data[end + 4:end + 4 + size]
            at = end + 4 + size
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
            yield headers, block


@pytest.fixture
def rows():
    rng = random.Random(8)
    long_text = "".join(rng.choice("añ😀 \r\n<>") for _ in range(5000))
    odd = ["", None, "\r\n", "\r", "\n", "x\r", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
           "HTTP/1.1 200 OK\r\nContent-Length: 7\r\n\r\n", "é", "a" * 64, "a" * 65, "a" * 128, long_text]
    found = [(i, f"http://h/{i}", text) for i, text in enumerate(odd)]
    found += [(100 + i, None, "same page") for i in range(40)] + [(None, "u", "same page")]
    found += [(7, "a\r\nX: 1", "twice"), (7, "b", "twice"), (None, "n", "only null"), (None, "m", "only null")]
    return found


@pytest.fixture
def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("record", F.lit("clash")).withColumn(
        "digest", F.lit(0)).repartition(3)


@pytest.mark.parametrize("chunk_bytes", [64, 1 << 16])
def test_round_trip(spark, tmp_path, pages, rows, chunk_bytes):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk_bytes=chunk_bytes)
    chunks = warc.read_archives(spark, path, chunk_bytes=chunk_bytes).collect()
    payloads, whole = {}, {}
    for r in sorted(chunks, key=lambda r: (r["record"], r["chunk"])):
        assert len(r["data"]) <= max(chunk_bytes, 4)
        so_far = payloads[r["record"]] = payloads.get(r["record"], b"") + bytes(r["data"])
        if r["record_type"] == "response":
            assert r["bytes"] == len(so_far) and r["digest"] == digest(so_far)
        if r["last"]:
            whole[r["record"]] = r
    assert len(whole) == len(rows)
    got = sorted(
        ((r["page_id"], r["bytes"], r["digest"]) for r in whole.values()), key=str
    )
    data = [(p, (t or "").encode()) for p, _, t in rows]
    assert got == sorted(((p, len(b), digest(b)) for p, b in data), key=str)
    responses = {bytes(payloads[k]): r for k, r in whole.items() if r["record_type"] == "response"}
    assert set(responses) == {b for _, b in data}
    assert all(r["intact"] for r in responses.values())
    for payload, r in responses.items():
        known = [p for p, b in data if b == payload and p is not None]
        assert r["page_id"] == (max(known) if known else None)
    for r in whole.values():
        if r["record_type"] == "revisit":
            original = next(o for o in responses.values() if o["digest"] == r["digest"])
            assert r["refers_to"] == original["page_id"] and r["intact"] is None


def test_a_plain_parser_reads_the_files(spark, tmp_path, pages, rows):
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, chunk_bytes=64)
    open_record, payloads = None, {}
    for headers, block in plain_records(path):
        kind = headers["WARC-Type"]
        if kind == "continuation":
            assert headers["WARC-Segment-Origin-ID"] == open_record[0]
            assert int(headers["WARC-Segment-Number"]) == open_record[1] + 1
            open_record = (open_record[0], open_record[1] + 1)
            payloads[open_record[0]] += block
            if "WARC-Segment-Total-Length" in headers:
                assert int(headers["WARC-Segment-Total-Length"]) == len(payloads[open_record[0]])
            continue
        open_record = (headers["WARC-Record-ID"], int(headers.get("WARC-Segment-Number", 1)))
        payloads[open_record[0]] = block
        if kind == "revisit":
            assert headers["WARC-Refers-To"].startswith("<urn:page-record:")
    bodies = [b.split(b"\r\n\r\n", 1)[1] for b in payloads.values()]
    assert len(bodies) == len(rows)
    assert {b for b in bodies if b} == {t.encode() for _, _, t in rows if t}


def test_small_payloads_may_be_left_alone(spark, pages, rows):
    found = warc.archived(pages, least_bytes=9).collect()
    kinds = {(r["payload_bytes"], r["record_type"]) for r in found}
    assert (5, "revisit") not in kinds and (9, "revisit") in kinds
    assert sum(r["record_type"] == "response" for r in found if r["payload_bytes"] == 5) == 2


def test_foreign_and_broken_records(spark, tmp_path):
    def record(kind, block, *headers, length=None):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}>", *headers,
                 f"Content-Length: {len(block) if length is None else length}", "", ""]
        return "\r\n".join(lines).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"
    kind = "Content-Type: application/http; msgtype=response"
    good = record("warcinfo", b"software: x\r\n") + record("request", http) + record(
        "response", http, kind, f"WARC-Payload-Digest: sha1:{digest(b'ok')}", "warc-target-uri: u"
    )
    wrong = record("response", http, kind, f"WARC-Payload-Digest: sha1:{digest(b'no')}")
    short = record("response", http, kind, length=500)
    (tmp_path / "w").mkdir()
    for name, data in (("a", good), ("b", wrong), ("c", short)):
        (tmp_path / "w" / f"{name}.warc.gz").write_bytes(gzip.compress(data))
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(
        ((bytes(r["data"])[:2], r["url"], r["intact"]) for r in found if r["last"]), key=str
    ) == [(b"ok", "u", True), (b"ok", None, False), (b"ok", None, False)]


def test_empty(spark, pages):
    found = warc.archived(pages.limit(0))
    assert found.count() == 0


def test_pieces_end_between_characters():
    data = ("é😀" * 50).encode()
    pieces = [p for p, _ in warc.cut(data, 7)]
    assert b"".join(pieces) == data and all(p.decode() for p in pieces)
    assert [last for _, last in warc.cut(b"", 7)] == [True]
