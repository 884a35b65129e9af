import base64
import hashlib

import pyarrow.fs as fs
import pytest

from helpers import clashing
from millrace.llm import warc
from millrace.llm._base import Workspace

PAGES = "page_id long, url string, html string"


def roundtrip(spark, pages):
    root, directory = warc.archive(pages)
    return warc.read(warc.lookup(pages, directory, root), root).collect()


ROWS = [
    (5, "http://www.b.com/x", "<p>é</p>"), (2, "http://a.com/", "<p>é</p>"), (9, "http://www.b.com/x", "other\r\n\r\nWARC/1.1\r\n"), (4, None, None), (1, None, ""), (7, "http://x y/\nInjected: 1", "zz"), (8, "", "x" * 2_000_000),
]


def test_round_trip(spark):
    got = {r.page_id: r for r in roundtrip(spark, clashing(spark.createDataFrame(ROWS, PAGES)))}
    assert len(got) == len(ROWS)
    for page, _, html in ROWS:
        raw = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "")]
        r = got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if page == min(same) else ("revisit", min(same)))
        assert r.payload == (raw if page == min(same) else None)


def test_many_shards_and_blocks_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_LINES", 60)
    rows = [(i, "http://hot.com/" if i % 3 == 0 else f"https://{'abc'[i % 3]}.h{i % 17}.org/p{i % 40}", f"text {i % 50}") for i in range(1000)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    ws = Workspace(spark, "test")
    root = f"{ws.path}/archive"
    data = pages.selectExpr("page_id", "url", "cast(html AS binary) AS payload")
    places = ws.save(warc.write(warc.with_duplicates(data), root), "places")
    directory = ws.save(warc.index(places, root, block_lines=7), "directory")
    assert directory.select("shard").distinct().count() > 5
    got = warc.read(warc.lookup(pages, directory, root), root).collect()
    assert sorted(r.page_id for r in got) == list(range(1000))
    assert all(r.refers_to == (None if r.page_id < 50 else r.page_id % 50) for r in got)
    assert warc.lookup(pages.limit(1).selectExpr("'http://absent.example/' AS url", "page_id"), directory, root).count() == 0
    files = [f.base_name for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(root.removeprefix("file://")))]
    assert any(f.startswith("warc") for f in files) and any(f.startswith("cdx") for f in files)


def test_archives_stay_where_they_are_written_to(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, PAGES)
    root, _ = warc.archive(pages, to=f"file://{tmp_path}/kept")
    again = spark.read.parquet(f"{tmp_path}/kept/directory")
    assert root == f"file://{tmp_path}/kept/archive" and warc.read(warc.lookup(pages, again, root), root).count() == len(ROWS)


def test_archives_are_standard_gzip(spark):
    import gzip

    root, _ = warc.archive(spark.createDataFrame(ROWS[:3], PAGES).coalesce(1))
    local = fs.LocalFileSystem()
    name = next(f.path for f in local.get_file_info(fs.FileSelector(root.removeprefix("file://"))) if f.base_name.startswith("warc"))
    data = gzip.decompress(open(name, "rb").read())
    assert data.startswith(b"WARC/1.1\r\n") and data.count(b"WARC-Type: ") == 3


def test_null_ids_repeats_and_empty_tables(spark):
    rows = [(None, "http://a/", "x"), (3, "http://a/", "x"), (3, "http://a/", "x"), (None, None, None)]
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in roundtrip(spark, spark.createDataFrame(rows, PAGES)))
    assert got == [(-1, "response", -1), (-1, "revisit", 3), (3, "response", -1), (3, "response", -1)]
    assert roundtrip(spark, spark.createDataFrame([], PAGES)) == []


@pytest.mark.parametrize(("url", "key"), [(None, ""), ("http://WWW.A.com:80/x?y#z", "com,a,www)/x?y"), ("https://a.com", "com,a)/"), ("plain", "plain)/"), ("http://u@a.b/?q", "b,a)/?q")])
def test_keys(url, key):
    assert warc.reversed_host_key(url) == key
