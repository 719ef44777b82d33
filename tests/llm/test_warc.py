from hashlib import sha1

import pytest

from evalloom.llm import warc
from evalloom.llm.common import scratch_path

PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    big = "line\r\n\r\nWARC/1.1\r\né🙂" * 9000
    data = [(1, "http://a b\r\n", big), (2, None, None), (3, "u", "é" * 499), (4, "u", "é" * 499), (5, "u", "é" * 500), (7, "u", "é" * 500), (7, "u", "é" * 500), (6, "u", "é" * 500), (None, "u", "é" * 500), (8, "u", "0\r\n\r\n"), (9, "u", big + "x")]
    found = warc.archive_round_trip(spark.createDataFrame(data, PAGES)).collect()
    assert len(found) == len(data)
    for r in found:
        html = next((h for p, _, h in data if p == r.page_id), None) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), sha1(html.encode()).hexdigest())
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in found)
    assert [k for k in kinds if k[1] == "revisit"] == [(0, "revisit", 7), (5, "revisit", 7), (6, "revisit", 7)]


def test_empty_table(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_chunks_and_segments():
    for text in ("", "a", "é" * 5000, "🙂" * 9000):
        assert warc.unchunk(warc.chunked(text).encode()) == text.encode()
        parts = warc.segments(text, 1000)
        assert "".join(parts) == text and all(len(p.encode()) <= 1000 for p in parts)


def test_missing_segment_is_an_error(spark):
    records = warc.page_records(1, "u", "é" * 40000, sha1(("é" * 40000).encode()).hexdigest(), None, 0)
    assert len(records) > 2
    for gone in (1, len(records) - 1):
        path = scratch_path(spark, "broken")
        spark.createDataFrame([(r,) for k, r in enumerate(records) if k != gone], "value string").coalesce(1).write.option("lineSep", warc.BREAK).text(path)
        with pytest.raises(Exception, match="not a whole record"):
            warc.read_archives(spark, path).collect()
