"""Stored rows on small fixtures: errors, nulls, empty tables, and the explain path."""

import tempfile

import pytest
from pyspark.sql import functions as F

from docmill.operators import access, checks, lifecycle, reports, search, uploads

FILES = "upload_id long, project_id int, uploaded_by int, path string, content string, strategy string, document_type string"
KNOWN = "project_id int, content_hash string"


def test_uploads_first_rule_first(spark):
    rows = [
        (1, 1, 1, "a/b/one.PDF", "same", None, None), (2, 1, 1, "two.pdf", "same", "auto", "report"), (3, 2, 1, "three.pdf", "same", "AUTO", " Report "),
        (4, 1, 1, "..", "x", None, None), (5, 1, 1, "noending", "x", None, None), (6, 1, 1, "x.txt", "", None, None), (7, 1, 1, "x.docx", None, None, None),
        (8, 1, 1, "x.docx", "123456", None, None), (9, 1, 1, "x.png", "y", "TEXT_ONLY", None), (10, 1, 1, "x.pdf", "y", "fast", None), (11, 1, 1, "x.pdf", "z", None, "novel"),
        (12, 1, 1, "x.pdf", "known", None, None), (13, 1, 1, None, "q", None, None), (14, 1, 1, "x.pdf", "same", "fast", None), (15, 1, 1, "x.jpg", "y", "auto", ""),
    ]
    known = spark.createDataFrame([(1, None), (1, "0" * 64)], KNOWN).unionByName(spark.range(1).select(F.lit(1).alias("project_id"), F.sha2(F.lit("known").cast("binary"), 256).alias("content_hash")))
    files = spark.createDataFrame(rows, FILES).withColumn("__extra", F.lit(1))
    judged = uploads.judged_uploads(files, known, ("REPORT",), 5)
    errors = {r.upload_id: r.error for r in judged.collect()}
    assert errors == {
        1: None, 2: "DUPLICATE_DOCUMENT", 3: None, 4: "INVALID_FILE_TYPE", 5: "INVALID_FILE_TYPE", 6: "INVALID_FILE_TYPE", 7: "EXTRACTION_FAILED", 8: "FILE_TOO_LARGE",
        9: "INVALID_EXTRACTION_STRATEGY", 10: "INVALID_EXTRACTION_STRATEGY", 11: "INVALID_DOCUMENT_TYPE", 12: "DUPLICATE_DOCUMENT", 13: "INVALID_FILE_TYPE", 14: "INVALID_EXTRACTION_STRATEGY", 15: None,
    }
    pending = uploads.pending_documents(judged, "/s/")
    found = {r.upload_id: r for r in pending.collect()}
    assert set(found) == {1, 3, 15} and found[3].document_type == "REPORT" and found[3].document_type_source == "USER" and found[1].document_type_source is None
    assert len({r.storage_path for r in found.values()}) == 3 and all(len(r.storage_path) == 3 + 32 + 4 for r in found.values())
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    uploads.store(files, pending, path)
    kept = {r.storage_path: r.content for r in spark.read.parquet(path).collect()}
    assert kept == {found[1].storage_path: "same", found[3].storage_path: "same", found[15].storage_path: "y"}
    assert uploads.judged_uploads(spark.createDataFrame([], FILES), known, ("REPORT",)).count() == 0


def test_block_lines_without_boxes_and_nulls(spark):
    schema = "block_id int, bbox array<double>, lines array<struct<bbox: array<double>, spans: array<string>>>"
    rows = [(1, None, [(None, [" a　", None, "", "b c "]), (None, None), ([1.0, 2.0, 3.0, 4.0], [" "])]), (2, [1.0, 1.0, 2.0, 2.0], None), (3, [1.0, 1.0, 2.0, 2.0], [(None, ["x"])])]
    found = [(r.block_id, r.line, r.content, r.x, r.y2) for r in uploads.block_lines(spark.createDataFrame(rows, schema)).orderBy("block_id").collect()]
    assert found == [(1, 0, "a b c", 0.0, 0.0), (3, 0, "x", 1.0, 2.0)]


def test_repeated_keys_are_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "id int, text string")
    with pytest.raises(Exception, match="DUPLICATE_ID"):
        checks.require_unique(rows, "id").collect()
    assert checks.require_unique(rows.where("text < 'c'"), "id").count() == 2
    assert checks.require_unique(rows.where("false"), "id").count() == 0


def test_explain(spark):
    vectors = spark.createDataFrame([(1, 1, 3, "base", [0.1] * 40)], "chunk_id long, document_id long, project_id int, embedding_model string, embedding array<double>")
    assert search.explain_search(vectors, [0.1], "base", []) == search.EMPTY_SCOPE
    assert search.explain_search(vectors, [], "base", [3]) == search.EMPTY_QUERY
    plan = search.explain_search(vectors, [0.123456789] * 40, "base", [3], 5)
    assert "TakeOrdered" in plan and "0.123456789,0.123456789" not in plan.replace(" ", "")
    assert len(search.explain_search(vectors, [0.123456789] * 40, "base", [3], 5, whole=True)) >= len(plan)
    for nothing in (search.vector_topk(vectors, [0.1] * 40, "base", []), search.vector_topk(vectors, [], "base", [3])):
        assert nothing.count() == 0 and nothing.columns == ["chunk_id", "document_id", "project_id", "similarity"]


def test_invited_again(spark):
    stored = spark.createDataFrame(
        [(1, 1, 5, 9, "EDITOR", "DECLINED", 10, 11), (2, 1, 6, 9, "EDITOR", "PENDING", 10, None), (3, 1, 7, 9, "EDITOR", "ACCEPTED", 10, 12)],
        "id long, project_id int, invitee_id int, invited_by int, role string, status string, created_at long, responded_at long",
    )
    members = spark.createDataFrame([(1, 7, "EDITOR")], "project_id int, user_id int, role string")
    asked = spark.createDataFrame(
        [(1, 5, 2, "VIEWER", 21), (1, 5, 3, "EDITOR", 20), (1, 5, 4, "OWNER", 19), (1, 6, 2, "VIEWER", 20), (1, 7, 2, "VIEWER", 20), (1, 8, 8, "VIEWER", 20), (1, 9, 2, "VIEWER", 20), (1, 9, 1, "EDITOR", 20)],
        "project_id int, invitee_id int, inviter_id int, role string, at long",
    )
    found = sorted(tuple(r) for r in access.invited(stored, members, asked).collect() if r.id) + [tuple(r) for r in access.invited(stored, members, asked).where("id IS NULL").collect()]
    assert found == [(1, 1, 5, 3, "EDITOR", "PENDING", 20, None), (2, 1, 6, 9, "EDITOR", "PENDING", 10, None), (3, 1, 7, 9, "EDITOR", "ACCEPTED", 10, 12), (None, 1, 9, 1, "EDITOR", "PENDING", 20, None)]


def test_completed_without_a_text(spark):
    elements, contents = lifecycle.start_review(spark.createDataFrame([(1, 0, "ab", 1, True, False), (1, 1, "cd", 1, False, False), (2, 0, "x", 1, True, False)], "document_id int, reading_order int, text string, version int, is_excluded boolean, is_deleted boolean"))
    contents = contents.selectExpr("*", "0L AS ocr_char_count", "false AS is_confirmed", "CAST(NULL AS int) AS confirmed_by", "CAST(NULL AS int) AS confirmed_at")
    documents = spark.createDataFrame([(1, "IN_PROGRESS", None, None), (2, "PENDING", None, None), (3, "PENDING", None, None)], "id int, review_status string, reviewed_by int, reviewed_at int")
    done = spark.createDataFrame([(1, 7, 50), (3, 8, 60), (99, 1, 1)], "document_id int, user_id int, at int")
    stored, texts, after = lifecycle.completed_reviews(documents, contents, elements, done)
    assert sorted(tuple(r) for r in stored.collect()) == [(1, "COMPLETED", 7, 50), (2, "PENDING", None, None), (3, "COMPLETED", 8, 60)]
    by = {r.document_id: r for r in texts.collect()}
    assert (by[1].content, by[1].ocr_char_count, by[1].text_version, by[1].is_confirmed, by[1].confirmed_by) == ("\ncd", 2, 2, True, 7)
    assert (by[2].content, by[2].is_confirmed) == ("x", False)
    assert {(r.document_id, r.reading_order): r.is_in_content for r in after.collect()} == {(1, 0): False, (1, 1): True, (2, 0): True}


def test_previews_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    tables = (
        empty("project_id int, created_at timestamp"), empty("project_id int, status string, decision string, decided_on date"),
        spark.createDataFrame([(2, None, None, "PENDING")], "project_id int, starts_on date, ends_on date, decision string"), empty("project_id int, uploaded_on date, decision string"),
    )
    found = {r.project_id: r for r in reports.report_previews(spark.range(1, 3), *tables, "DECISION_LOG").collect()}
    assert found[1].blocked_reason == reports.NOTHING["DECISION_LOG"] and "1" in found[2].blocked_reason and not found[2].can_generate
    assert reports.report_preview(*tables, 77, "PROJECT_STATUS").first().can_generate is False
    for kind, error in (("WEEKLY_REPORT", "PERIOD_REQUIRED"), ("OTHER", "INVALID_DOCUMENT_TYPE")):
        with pytest.raises(ValueError, match=error):
            reports.report_previews(spark.range(1), *tables, kind)


def test_stamps_of_now(spark):
    before = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string").selectExpr("*", "TIMESTAMP '2020-01-01' AS created_at", "TIMESTAMP '2020-01-02' AS updated_at")
    rows = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "id int, text string")
    found = {r.id: r for r in uploads.stamped(rows, before, "id").collect()}
    assert found[1].created_at.year == 2020 and found[1].updated_at.year > 2020
    assert found[2].updated_at.year == 2020 and found[3].created_at == found[3].updated_at
