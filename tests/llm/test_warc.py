import random

import pytest

from gradloom.llm import warc
from gradloom.session import shared_path

PAYLOADS = [None, "", "plain", "a\r\nb\r\n", "\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "\r", "x\r" * 40000, "é" * 50000, "\n", "plain", "plain"]


def round_trip(spark, rows, revisit_bytes=0, **options):
    folder = shared_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_warc(warc.label_revisits(pages, revisit_bytes), folder, **options)
    return folder, [r.asDict() for r in warc.read_warc(spark, folder).withColumn("page_id", warc.page_number("record_id"))
                    .withColumn("of", warc.page_number("refers_to")).collect()]


@pytest.mark.parametrize("segment_bytes", [1, 7, 4096, 1 << 20])
def test_payloads_survive(spark, segment_bytes):
    some = PAYLOADS if segment_bytes > 7 else [p for p in PAYLOADS if len(p or "") < 100]
    rows = [(i, None if i == 2 else f"http://x/{i} é\nb", p, "clash") for i, p in enumerate(some)]
    _, found = round_trip(spark, rows, segment_bytes=segment_bytes)
    assert len(found) == len(rows)
    winner = {}
    for i, _, p, _ in rows:
        winner[p or ""] = max(i, winner.get(p or "", -1))
    for r in found:
        text = rows[r["page_id"]][2] or ""
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == warc.digest(text.encode())
        if winner[text] == r["page_id"]:
            assert r["record_type"] == "response" and bytes(r["payload"]) == text.encode() and r["of"] is None
        else:
            assert r["record_type"] == "revisit" and r["payload"] is None and r["of"] == winner[text]


def test_small_payloads_are_no_revisits(spark):
    rows = [(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")]
    _, found = round_trip(spark, rows, revisit_bytes=3)
    assert {(r["page_id"], r["record_type"], r["of"]) for r in found} == {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)}


def test_null_and_repeated_ids(spark):
    rows = [(None, "u", "a", ""), (5, "u", "a", ""), (5, "u", "a", ""), (None, None, "b", "")]
    _, found = round_trip(spark, rows)
    assert sorted((str(r["page_id"]), r["record_type"], str(r["of"])) for r in found) == [
        ("5", "response", "None"), ("5", "response", "None"), ("None", "response", "None"), ("None", "revisit", "5")]


def test_empty_table(spark):
    folder, found = round_trip(spark, [])
    assert found == []


def segments(spark, rows):
    return spark.createDataFrame(rows, warc.SEGMENTS)


def test_damage_is_seen(spark):
    block = warc.HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + warc._chunked(b"hello world")
    cut = [(f"<o{i}>", k, n, t, None, None, None, bytearray(b)) for i, parts in enumerate((
        [("response", 1, None, block[:9]), ("continuation", 2, None, block[9:40]), ("continuation", 2, None, block[9:40]), ("continuation", 3, len(block), block[40:])],
        [("response", 1, None, block[:9]), ("continuation", 3, len(block), block[40:])],
        [("response", 1, None, block[:9]), ("continuation", 2, len(block) + 1, block[9:])],
        [("response", 1, None, block[:9]), ("continuation", 2, len(block) - 2, block[9:-2])],
        [("response", 1, None, block[:9])])) for k, n, t, b in parts]
    opened = warc.reassemble(segments(spark, cut)).mapInArrow(warc._open("keep"), warc.OPENED)
    found = {r["record_id"]: r for r in opened.collect()}
    assert bytes(found["<o0>"]["payload"]) == b"hello world" and found["<o0>"]["damage"] is None
    assert all(found[f"<o{i}>"]["damage"] and found[f"<o{i}>"]["payload"] is None for i in range(1, 5))
    with pytest.raises(Exception, match="segment is missing"):
        warc.reassemble(segments(spark, cut[4:6])).mapInArrow(warc._open("error"), warc.OPENED).collect()


def test_dechunk():
    rng = random.Random(1)
    for n in (0, 1, 8191, 8192, 8193, 30000):
        body = bytes(rng.randrange(256) for _ in range(n))
        assert warc.dechunk(warc._chunked(body)) == body
    assert warc.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunk(b"3\r\nabcd\r\n0\r\n\r\n")
