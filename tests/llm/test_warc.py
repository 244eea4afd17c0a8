import base64
import hashlib
import zlib

import pytest

from tidepool.llm import warc
from tidepool.session import scratch_folder

from ..conftest import SF_SMALL
from .helpers import with_clashes

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [(5, "http://a/x y\r\nz", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "c", None), (2, "d", ""), (None, "e", "same"), (7, "f", FAKE),
        (8, "g", FAKE * 2), (6, "h", "é漢\r\n\r\n😀\n"), (3, "http://b", "same"), (11, "i", "y" * 300_000), (None, None, None)]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    first = {}
    for page, _, text in rows:
        if page is not None:
            first[text or ""] = min(page, first.get(text or "", page))
    out = []
    for page, _, text in rows:
        n, original = len((text or "").encode()), first.get(text or "")
        revisit = n >= min_bytes and original is not None and page != original
        out.append((page, n, digest(text), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


def table(spark, rows):
    return with_clashes(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3))


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip_of_awkward_pages(spark, min_bytes):
    path = scratch_folder(spark) + "/archives"
    warc.write_archives(table(spark, ROWS), path, min_bytes=min_bytes, archive_bytes=20_000)
    back = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(ROWS, min_bytes)
    payloads = {r.payload for r in back if r.record_type == "response"}
    assert {text or "" for _, _, text in ROWS} == payloads
    assert all(r.payload is None for r in back if r.record_type == "revisit")
    assert {r.url for r in back} >= {"http://a/x%20y%0D%0Az", "http://b", None}


def test_rows_of_one_page_and_payload_are_dealt_to_several_archives(spark):
    rows = [(7, f"u{i}", "z" * 1000) for i in range(600)] + [(None, None, "z" * 1000)] * 300 + [(i, "v", "other") for i in range(300)]
    path = scratch_folder(spark) + "/archives"
    warc.write_archives(table(spark, rows), path, archive_bytes=64_000)
    back = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == expected(rows)
    held = [len(zlib.decompress(r.content, wbits=31)) for r in spark.read.format("binaryFile").load(path).select("content").collect() if r.content]
    assert max(held) < 5 * 64_000 < sum(held) / 2


def test_empty_table(spark):
    path = scratch_folder(spark) + "/archives"
    warc.write_archives(table(spark, ROWS).limit(0), path)
    assert warc.read_archives(spark, path).collect() == []


def test_torn_and_altered_records_are_errors():
    head = warc._header_lines(1, "u", 3, digest("abc"), "response", None, "1970-01-01T00:00:00Z")
    good = f"WARC/1.1\r\n{head}\r\n\r\nabc\r\n\r\n".encode()
    assert [r[0] for r in warc.parse_archive(good * 2)] == [1, 1]
    for bad in (good[:-1], good.replace(b"\r\nabc\r\n", b"\r\nabd\r\n"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op9_warc(spark, SF_SMALL).collect()), key=str) == expected(rows)
