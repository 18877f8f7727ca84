"""Archives: written, read back, and read against payloads that look like records."""

import base64
import gzip
import hashlib

import numpy as np
import pytest

from cases import sorted_rows
from orderloom.llm import warc

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
EMBEDDED = "x\r\n\r\n" + RECORD + "y\r\n\r\n" + RECORD
SCHEMA = "page_id long, url string, html string, digest string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    first = {}
    for i, _, page, _ in rows:
        if i is not None:
            first[page or ""] = min(i, first.get(page or "", i))
    out = []
    for i, _, page, _ in rows:
        page = page or ""
        head = first.get(page) if len(page.encode()) >= min_bytes else None
        revisit = head is not None and i != head
        out.append((i, len(page.encode()), digest(page), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "u", "<p>ñ</p>", "c"), (2, None, None, "c"), (3, "u", "", "c"), (4, "u\r\nX: y", EMBEDDED, "c"),
    (5, "u", EMBEDDED, "c"), (5, "u", EMBEDDED, "c"), (None, "u", "q", "c"), (None, "u", "q", "c"),
    (6, "u", "q", "c"), (7, "u", "z" * 300_000, "c"), (8, "u", RECORD, "c"), (9, "u", "WARC/1.1\r\n", "c"),
]


@pytest.mark.parametrize("options", [{}, {"per_archive": 2}, {"min_bytes": 2}])
def test_round_trip(spark, options, monkeypatch):
    pages = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    assert sorted_rows(warc.round_trip(pages, **options)) == expected(ROWS, options.get("min_bytes", 0))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted_rows(warc.round_trip(pages, **options)) == expected(ROWS, options.get("min_bytes", 0))


def test_nothing_to_write(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame(ROWS, SCHEMA), folder)
    rows = warc.read_archives(spark, folder, with_payload=True, glob="part-*").collect()
    found = {r.record_id: bytes(r.payload).decode() for r in rows if r.record_type == "response"}
    assert found["<urn:page:4>"] == EMBEDDED and found["<urn:page:7>"] == "z" * 300_000
    urls = {r.url for r in rows}
    assert "u%0D%0AX: y" in urls


def test_only_the_chain_counts():
    data = (RECORD + RECORD).encode()
    found = warc.candidates(data)
    assert warc.reachable(found).tolist() == [True, True]
    odd = data + b"junk\r\n\r\n" + RECORD.encode()  # after a break no record is believed
    assert warc.reachable(warc.candidates(odd)).tolist() == [True, True, False]
    assert warc.reachable(warc.candidates(b"no archive")).tolist() == []
    assert warc.reachable(warc.candidates(b"x" + data)).sum() == 0
    assert warc.reachable(warc.candidates(data[:-4])).tolist() == [True, False]  # cut short


def test_jumps_reach_as_far_as_steps():
    rng = np.random.default_rng(4)
    for _ in range(50):
        offsets = np.unique(rng.integers(1, 500, 40))
        offsets = np.concatenate([[0], offsets])
        successors = np.array([rng.choice(np.append(offsets[offsets > o], 999)) for o in offsets])
        got = warc.reachable(warc.Candidates(offsets, offsets, successors))
        at, want = 0, np.zeros(len(offsets), bool)
        while at in offsets:
            k = int(np.searchsorted(offsets, at))
            want[k], at = True, successors[k]
        assert got.tolist() == want.tolist()


def test_gzipped_archive(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(RECORD.encode()) + gzip.compress(RECORD.encode()))
    assert warc.read_archives(spark, str(tmp_path)).count() == 2
