import base64
import hashlib
import random

import pytest

from veriledge.llm import warc


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string")
    return make


ROWS = [(1, "http://a/", "same"), (7, "http://b/", "same"), (3, None, "same"), (4, "http://c/é\nx", None),
        (5, "http://d/", ""), (6, "http://e/", "ü" * 70_000), (None, "http://f/", "null id"),
        (8, "http://g/", "twice"), (8, "http://g/", "twice"), (9, "http://h/", "same\r\n\r\nWARC/1.1")]


def brute(rows, least=0):
    best = {}
    for p, u, h in rows:
        key = h or ""
        best[key] = max(best.get(key, (-1, "")), (-1 if p is None else p, u or ""))
    seen, out = set(), []
    for p, u, h in rows:
        raw = (h or "").encode()
        first = (-1 if p is None else p, u or "") == best[h or ""] and (h or "") not in seen
        if first:
            seen.add(h or "")
        kind = "response" if first or len(raw) < least else "revisit"
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind,
                    best[h or ""][0] if kind == "revisit" else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,split", [(0, 64 << 20), (0, 50), (5, 700)])
def test_round_trip(pages, least, split):
    got = warc.archive_pages(pages(ROWS).repartition(3), least, split).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type",
                                         "refers_to")) for r in got), key=repr) == brute(ROWS, least)


def test_every_split_size_reads_each_record_once(pages):
    rows = [(i, f"http://x/{i}", "p" * (i * 13 % 400)) for i in range(60)]
    files = warc.write_warc(warc.plan_revisits(pages(rows)), level=0, file_bytes=5_000)
    assert files.count() > 1
    for split in (17, 301, 4096):
        got = warc.read_warc(files, split, with_payload=True).collect()
        assert sorted(r["page_id"] for r in got) == list(range(60))
        assert {bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"} == \
            {h for _, _, h in rows}


def test_long_urls_are_read_wherever_a_split_starts(pages):
    rng = random.Random(5)
    long = "http://x/" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000))
    for rows in ([(1, long, "alone")],
                 [(i, f"http://x/{i}" if i % 3 else f"{long}{i}", f"page {i}") for i in range(9)]):
        files = warc.write_warc(warc.plan_revisits(pages(rows).coalesce(1)))
        for split in (64 << 20, 70_000, 3_001):
            got = warc.read_warc(files, split).collect()
            assert sorted((r["page_id"], r["url"]) for r in got) == [(i, u) for i, u, _ in rows]


def test_magic_bytes_inside_a_payload_are_no_records(spark, pages):
    # Level 0 stores payloads as they are: the text below has gzip magic in its UTF-8 bytes.
    rows = [(1, "u", "\x1f\u008b\x08 \x1f\x8b\x08WARC/1.1" * 50), (2, "v", "b")]
    files = warc.write_warc(warc.plan_revisits(pages(rows)), level=0)
    assert sorted(r["page_id"] for r in warc.read_warc(files, 40).collect()) == [1, 2]


def test_empty_table_and_clashing_columns(spark, pages):
    assert warc.archive_pages(pages([])).collect() == []
    odd = spark.sql("SELECT 1L AS page_id, 'u' AS url, 'h' AS html, 'q' AS sha, 2 AS n, 3 AS keep, 4 AS place")
    assert warc.archive_pages(odd).first()["payload_bytes"] == 1
