"""The streams: a batch touches its own buckets, a batch that failed is run again, completed reviews rebuild chunks once."""

import tempfile

import pytest
from pyspark.sql import functions as F

from docmill.operators import lifecycle
from docmill.streaming import ingest
from docmill.streaming.buckets import BucketTable


def rows_of(table):
    return {(r.document_id, r.text, r.text_version) for r in table.rows().collect()}


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_stream_changes_only_what_is_due(spark, root):
    table = ingest.chunk_table(spark, f"{root}/chunks", 8)
    put = lambda rows: spark.createDataFrame(rows, ingest.DOCUMENT).coalesce(1).write.mode("append").parquet(f"{root}/in")
    go = lambda: ingest.run(spark, f"{root}/in", table.path, f"{root}/state", buckets=8).awaitTermination()
    put([(1, "first text of one", 1), (2, "text of two", 1), (3, "text of three", 2), (4, " \n", 1)])
    go()
    first = {(1, "first text of one", 1), (2, "text of two", 1), (3, "text of three", 2)}
    assert rows_of(table) == first
    put([(1, "second text of one", 2), (2, "text of two", 1), (3, "late text of three", 1)])
    before = table.holders()
    go()
    assert rows_of(table) == first - {(1, "first text of one", 1)} | {(1, "second text of one", 2)}
    own = table.touched(spark.createDataFrame([(1,)], "document_id long"))
    assert {b for b, n in table.holders().items() if n != before.get(b)} == set(own)
    put([(1, "　\n ", 3)])  # blank: its chunks go
    go()
    assert rows_of(table) == {(2, "text of two", 1), (3, "text of three", 2)}
    held = table.holders()
    put([(2, "text of two", 1)])
    go()
    assert table.holders() == held


def test_a_batch_that_failed_is_run_again(spark, root, monkeypatch):
    table = ingest.chunk_table(spark, f"{root}/chunks", 4)
    batch = lambda rows, n: ingest.ingest_batch(table, spark.createDataFrame(rows, ingest.DOCUMENT), n, "m")
    batch([(i, f"text {i}", 1) for i in range(10)], 0)
    before = rows_of(table)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            batch([(1, "new 1", 2), (7, "new 7", 2)], 1)
    assert rows_of(table) == before  # data without a commit isn't seen
    for _ in range(2):
        batch([(1, "new 1", 2), (7, "new 7", 2)], 1)
        assert rows_of(table) == {x for x in before if x[0] not in (1, 7)} | {(1, "new 1", 2), (7, "new 7", 2)}


def test_completed_reviews_rebuild_chunks_once(spark, root):
    given = [(1, 0, "kept line", False), (1, 1, "line that goes", True), (2, 0, "only line", False)]
    rows = spark.createDataFrame([(d, i, text, 1, out, False) for d, i, text, out in given], "document_id long, reading_order long, text string, version int, is_excluded boolean, is_deleted boolean")
    placed, texts = lifecycle.start_review(rows)
    names = "document_id long, reading_order long, text string, version int, is_excluded boolean, is_deleted boolean, content_start long, content_end long, is_in_content boolean"
    elements = BucketTable(spark, f"{root}/elements", names, buckets=4)
    contents = BucketTable(spark, f"{root}/contents", "document_id long, content string, char_count int, text_version int", buckets=4)
    elements.replace(-1, placed.select(*[c.split()[0] for c in names.split(", ")]), [0, 1, 2, 3])
    contents.replace(-1, texts, [0, 1, 2, 3])
    table = ingest.chunk_table(spark, f"{root}/chunks", 4)
    ingest.ingest_batch(table, texts.select("document_id", "content", "text_version"), -1, "hash")
    assert {x[1] for x in rows_of(table)} == {"kept line\nline that goes", "only line"}
    for _ in range(2):
        spark.createDataFrame([(1,), (2,)], "document_id long").coalesce(1).write.mode("append").parquet(f"{root}/requests")
        ingest.run_reviews(elements, contents, f"{root}/requests", f"{root}/feed", f"{root}/s1").awaitTermination()
        ingest.run(spark, f"{root}/feed", table.path, f"{root}/s2", buckets=4).awaitTermination()
        held = {b: n for b, n in table.holders().items() if n >= 0}
        assert len(held) == 1 and set(held.values()) == {0}  # document 1's bucket, by the first batch alone
    assert rows_of(table) == {(1, "kept line", 2), (2, "only line", 1)}
    assert contents.rows().where(F.col("document_id") == 1).first().content == "kept line\n"
