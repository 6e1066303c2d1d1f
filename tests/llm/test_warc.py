"""WARC bundles: exact round trips, single frames, and which records are revisits."""

import base64
import hashlib
import random

import zstandard

from palimpsest.llm import warc

SCHEMA = "page_id bigint, url string, html string"
ROWS = [
    (1, "http://a.example/", "<p>same</p>"), (2, "http://b.example/x y\r\nEvil: 1", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c.example/é", None), (4, "", ""),
    (5, "http://d.example/", "WARC/1.1\r\n\r\n🙂"), (6, "http://e.example/", "x" * 300_000), (6, "http://e.example/", "x" * 300_000), (None, "http://f.example/", "alone"), (None, "http://g.example/", "<p>same</p>"),
]


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        kept = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None) if len(data) >= least else None
        revisit = kept is not None and page != kept
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def result(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], SCHEMA + ", digest string, kept int")
    for least in (0, 12, 1_000_000):
        records = warc.read(warc.write(pages, least))
        assert result(records) == expected(ROWS, least)
        wanted = {r[0]: (r[2] or "").encode() for r in ROWS}
        assert all(bytes(r.payload) == wanted[r.page_id] for r in records.collect() if r.record_type == "response" and r.page_id is not None)


def test_bundles_are_plain_zstd_and_frames_open_alone(spark):
    r = random.Random(1)
    rows = [(i, f"http://x.example/{i}", "".join(r.choice("abcdef ") for _ in range(r.randrange(4000)))) for i in range(300)]
    bundles = warc.write(spark.createDataFrame(rows, SCHEMA), frame_bytes=5000, bundle_bytes=60_000).collect()
    assert len(bundles) > 4
    seen = set()
    for b in bundles:
        data = bytes(b.data)
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        frames = [warc.read_frame(data, k) for k in range(len(warc.seek_table(data)))]
        assert len(frames) > 1 and b"".join(frames) == plain
        for entry in b["index"]:
            fields, payload = warc.read_record(data, entry.frame, entry.offset)
            assert fields["WARC-Record-ID"] == f"<{entry.record_id}>"
            page = int(fields["X-Page-Id"])
            assert payload.decode() == rows[page][2] or fields["WARC-Type"] == "revisit"
            seen.add(page)
    assert seen == set(range(300))


def test_empty_table_and_damage(spark):
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA))).collect() == []
    out = warc.BundleWriter()
    out.add("a", warc.encode_record(1, "u", b"body", "X", None, False, 4))
    broken = out.finish()[:-1] + b"\x00"
    try:
        warc.seek_table(broken)
    except ValueError:
        return
    raise AssertionError("a broken footer was read")


def test_repeated_payloads_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_BROADCAST_ROWS", 0)
    assert result(warc.read(warc.write(spark.createDataFrame(ROWS, SCHEMA)))) == expected(ROWS)
