"""WARC archives: a round trip, reads through the index, odd rows."""

import gzip
import hashlib

import pytest

from compare import of_duck, of_spark
from conftest import DATA
from docmill.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, row int"


def test_against_sql(spark, duck):
    assert of_spark(warc.op13_warc(spark, DATA)) == of_duck(duck, warc.OP13_SQL)


def odd_pages():
    long = "x\r\n\r\ny" * 40
    rows = [(5, "http://a/ b\n", long), (3, "http://é", long), (3, "http://a", long), (3, "http://a", long), (None, None, long), (9, "u", "é" * 50), (8, "u", "é" * 50)]
    rows += [(20, "u", "y" * 99), (21, "u", "y" * 99), (1, None, None), (2, "u", ""), (None, "u", "z" * 3_000_000), (40, "v", "WARC/1.1\r\n\r\n" * 20)]
    return [(i, u, h, "extra", 7) for i, u, h in rows]


@pytest.mark.parametrize("parts", [1, 4])
def test_odd_pages(spark, parts):
    path = warc.shared_path(spark, "test-warc")
    pages = spark.createDataFrame(odd_pages(), SCHEMA).repartition(parts)
    index = warc.write_archive(pages, path)
    found = warc.read_archive(spark, path).collect()
    assert len(found) == len(odd_pages()) == index.count()
    given = sorted((i if i is not None else -1, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h, *_ in odd_pages())
    assert sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest) for r in found) == given
    by_kind = lambda x: (x[0], x[1], x[2] or 0)
    kinds = [(1, "response", None), (2, "response", None), (3, "response", None), (3, "revisit", 3), (3, "revisit", 3), (5, "revisit", 3)]
    kinds += [(8, "response", None), (9, "revisit", 8), (20, "response", None), (21, "response", None), (40, "response", None)]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in found if r.page_id is not None), key=by_kind) == kinds
    for r in found:
        assert len(r.payload) == (r.payload_bytes if r.record_type == "response" else 0)
    first = next(r for r in found if r.page_id == 3 and r.record_type == "response")
    assert first.url == "http://a"  # of rows that share the id, the least URL


def test_index_reads_single_records(spark):
    path = warc.shared_path(spark, "test-warc")
    pages = spark.createDataFrame([(i, f"http://h/{i % 5}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string")
    index = warc.write_archive(pages, path).collect()
    system, root = warc.file_system(f"{path}/records")
    for r in index[::37]:
        whole = system.open_input_file(f"{root}/{r.file}").read()
        assert warc.parse(whole[r.offset : r.offset + r.length])["page_id"] == r.page_id
        assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == sum(x.file == r.file for x in index)
    chosen = warc.read_archive(spark, path, "url = 'http://h/3' AND page_id > 100").collect()
    assert sorted(r.page_id for r in chosen) == [i for i in range(101, 200) if i % 5 == 3]
    assert all(bytes(r.payload).decode() == f"page {r.page_id} " * 50 for r in chosen)


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP_BYTES, 5), ("a", 30 + 3 * warc.GAP_BYTES, 5), ("b", 0, warc.READ_BYTES), ("b", warc.READ_BYTES, 1)]
    assert [(f, b, len(h)) for f, b, _, h in warc.ranges(rows)] == [("a", 0, 3), ("a", 30 + 3 * warc.GAP_BYTES, 1), ("b", 0, 1), ("b", warc.READ_BYTES, 1)]


def test_empty_and_damaged(spark):
    path = warc.shared_path(spark, "test-warc")
    assert warc.write_archive(spark.createDataFrame([], SCHEMA), path).count() == 0 and warc.read_archive(spark, path).count() == 0
    page = {"page_id": 1, "url": "u", "html": "abc", "digest": "0" * 64, "row": 0, "first_id": None, "first_row": None}
    with pytest.raises(ValueError):
        warc.parse(gzip.compress(warc.record(page, "2000-01-01T00:00:00Z")))
