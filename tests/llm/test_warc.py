import base64
import hashlib
import io
from pathlib import Path

import pytest
import zstandard
from pyspark.sql import functions as F

from quizloom.llm import warc

ROWS = [
    (1, "http://a/x", "<p>one</p>"), (2, "http://b\r\n/", "<p>one</p>"), (3, None, None), (4, "http://c", ""),
    (5, "http://d", "é" * 40_000), (5, "http://d", "é" * 40_000), (None, "http://e", "<p>one</p>"),
    (None, "http://f", "only here"), (9, "http://g", "x\r\n\r\nWARC/1.1\r\n\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows, least=0):
    out = []
    for number, _, text in rows:
        size = len((text or "").encode())
        same = [i for i, _, t in rows if (t or "") == (text or "") and i is not None]
        keep = max(same) if same and size >= least else None
        revisit = keep is not None and keep != number
        out.append((number, size, digest(text), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return df.withColumns({"id": F.lit("clash"), "_digest": F.lit("clash"), "payload": F.lit(7)})


@pytest.mark.parametrize("options", [{}, {"frame_bytes": 1, "bundle_bytes": 1}, {"min_bytes": 11}])
def test_round_trip(spark, pages, new_path, options):
    folder = "file://" + new_path("warc")
    index = warc.archive(spark, pages, folder, "page_id", "url", "html", **options)
    assert index.count() == len(ROWS)
    records = warc.read_bundles(index, f"{folder}/bundles")
    got = warc.resolve_revisits(records).collect()
    found = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    assert found == brute(ROWS, options.get("min_bytes", 0))
    bodies = {i: (t or "").encode() for i, _, t in ROWS if i is not None}
    for r in records.where("record_type = 'response' and id is not null").collect():
        assert bytes(r.payload) == bodies[r.id]
    urls = {r.id: r.url for r in records.collect() if r.id}
    assert urls[2] == "http://b%0D%0A/" and urls[3] is None


def test_frames_are_read_one_by_one(spark, pages, new_path):
    folder = "file://" + new_path("warc")
    index = warc.archive(spark, pages, folder, "page_id", "url", "html", frame_bytes=1)
    wanted = spark.createDataFrame([(9,), (5,), (77,), (None,)], "id long")
    got = warc.read_records(wanted, index, f"{folder}/bundles").collect()
    assert sorted(r.id for r in got) == [5, 5, 9]
    place = index.where("id = 9").first()
    reader = warc.BundleReader(f"{folder}/bundles", place.bundle)
    record, _ = warc.parse_record(reader.frame(place.frame), place.offset)
    assert record["id"] == 9 and len(reader) >= 1


def test_every_frame_is_plain_zstandard(spark, pages, new_path):
    """A reader that knows no seek table reads the bundle from end to end."""
    path = new_path("warc")
    warc.archive(spark, pages, "file://" + path, "page_id", "url", "html", frame_bytes=100)
    text = b""
    for file in Path(path, "bundles").glob("*.zst"):
        text += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read_bytes()), read_across_frames=True).read()
    assert text.count(b"WARC-Record-ID: ") == len(ROWS)


def test_empty_table(spark, pages, new_path):
    folder = "file://" + new_path("none")
    index = warc.archive(spark, pages.limit(0), folder, "page_id", "url", "html")
    assert warc.resolve_revisits(warc.read_bundles(index, f"{folder}/bundles")).count() == 0
