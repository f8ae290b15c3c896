"""Structural edits of a review: what fails leaves the document alone, what is undone comes back."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import structure

ELEMENTS = """document_id bigint, element_id bigint, page_id bigint, reading_order bigint, text string, x double, y double, width double, height double, confidence double, source string,
    element_type string, element_type_source string, is_paragraph_start boolean, version int, is_deleted boolean, is_excluded boolean, is_in_content boolean, content_start bigint, content_end bigint"""
CONTENTS = "document_id bigint, content string, char_count int, ocr_char_count bigint, text_version int, is_confirmed boolean"


@pytest.fixture(scope="module")
def opened(spark):
    """A way to open a review of documents given as lists of texts."""

    def build(documents, status="COMPLETED", **own):
        rows, contents = [], []
        for d, texts in documents.items():
            at = 0
            for i, text in enumerate(texts):
                row = {"y": 0.1 * i, "height": 0.08, "is_deleted": False, "is_excluded": False, "kind": "PARAGRAPH", "page": 1} | own.get(f"e{d}_{i}", {})
                rows.append((d, i, row["page"], i, text, 0.1, row["y"], 0.5, row["height"], 0.9 - 0.1 * i, "OCR", row["kind"], "DETECTED", i == 0, 1, row["is_deleted"], row["is_excluded"], True, at, at + len(text)))
                at += len(text) + 1
            content = "\n".join(texts)
            contents.append((d, content, len(content), sum(map(len, texts)), 4, True))
        documents = [(d, status, 3) for d in documents]
        return structure.opened(spark.createDataFrame(rows, ELEMENTS), spark.createDataFrame(contents, CONTENTS), spark.createDataFrame(documents, "document_id bigint, review_status string, ocr_revision int"))

    return build


def ranges(review, document=1):
    rows = review.elements.where((F.col("document_id") == document) & ~F.col("is_deleted")).orderBy("content_start", "reading_order").collect()
    return [(r.element_id, r.text, r.content_start, r.content_end) for r in rows]


def content(review, document=1):
    return review.contents.where(F.col("document_id") == document).first()


def errors(outcomes):
    return {r.document_id: r.error for r in outcomes.collect()}


def test_a_batch_moves_what_follows_and_counts_once(spark, opened):
    review = opened({1: ["first", "second", "third"]})
    changes = spark.createDataFrame([(1, 0, 1, "FIRST"), (1, 1, 1, "second expanded")], "document_id long, element_id long, version int, text string")
    after, outcomes = structure.edit_batch(review, changes, 7)
    found = content(after)
    assert (found.content, found.text_version, found.is_confirmed, found.ocr_char_count) == ("FIRST\nsecond expanded\nthird", 5, False, 25)
    assert ranges(after) == [(0, "FIRST", 0, 5), (1, "second expanded", 6, 21), (2, "third", 22, 27)]
    assert errors(outcomes) == {1: None} and after.revisions.count() == 2
    assert after.documents.first()[1:] == ("IN_PROGRESS", 4)


WRONG = [
    ({"version": 2}, "OCR_EDIT_CONFLICT"),
    ({"element_id": 9}, "OCR_ELEMENT_NOT_FOUND"),
    ({"x": 0.9}, "OCR_INVALID_STRUCTURE"),
    ({"height": 0.0}, "OCR_INVALID_STRUCTURE"),
    ({"element_type": "TABLE_HEADER", "is_paragraph_start": True}, "OCR_INVALID_STRUCTURE"),
    ({"element_id": 0}, "OCR_ELEMENT_NOT_FOUND"),  # asked for twice
    ({"element_id": 9, "version": 2, "x": 0.9}, "OCR_ELEMENT_NOT_FOUND"),  # the first of several
]


def test_one_wrong_change_leaves_the_whole_document(spark, opened):
    review = opened({d: ["a", "b"] for d in range(len(WRONG) + 1)})
    schema = "document_id long, element_id long, version int, text string, x double, height double, element_type string, is_paragraph_start boolean"
    row = lambda d, i, **more: tuple(({"document_id": d, "element_id": i, "version": 1, "text": None, "x": None, "height": None, "element_type": None, "is_paragraph_start": None} | more).values())
    rows = [row(d, 0, text="new") for d in range(len(WRONG) + 1)] + [row(d, 1, **change) for d, (change, _) in enumerate(WRONG)] + [row(99, 0)]
    after, outcomes = structure.edit_batch(review, spark.createDataFrame(rows, schema), 7)
    assert errors(outcomes) == {**{d: e for d, (_, e) in enumerate(WRONG)}, len(WRONG): None, 99: "DOCUMENT_NOT_FOUND"}
    assert {r.document_id: r.content for r in after.contents.collect()} == {**{d: "a\nb" for d in range(len(WRONG))}, len(WRONG): "new\nb"}
    assert after.revisions.count() == 1 and {r.document_id: r.ocr_revision for r in after.documents.collect()} == {d: 3 + (d == len(WRONG)) for d in range(len(WRONG) + 1)}


def test_boxes_and_exclusions_keep_the_text_version(spark, opened):
    review = opened({1: ["box", "b"], 2: ["h", "b"]})
    schema = "document_id long, element_id long, version int, x double, is_excluded boolean, element_type string, re_ocr_applied boolean, re_ocr_confidence double"
    after, _ = structure.edit_batch(review, spark.createDataFrame([(1, 0, 1, 0.2, None, None, True, 0.5), (1, 1, 1, None, True, None, None, None), (2, 0, 1, None, None, "HEADING", None, None)], schema), 7)
    assert content(after).text_version == 4 and content(after).ocr_char_count == 3 and content(after, 2).text_version == 5
    row = after.elements.where("document_id = 1 AND element_id = 0").first()
    assert (row.x, row.version, row.source, row.confidence) == (0.2, 2, "RE_OCR", 0.5)


def test_a_range_that_holds_another_text_is_a_conflict(spark, opened):
    review = opened({1: ["ab", "cd"]})
    broken = structure.replace(review, contents=review.contents.withColumn("content", F.lit("ab cX")))
    changes = spark.createDataFrame([(1, 1, 1, "new")], "document_id long, element_id long, version int, text string")
    after, outcomes = structure.edit_batch(broken, changes, 7)
    assert errors(outcomes) == {1: "OCR_CONTENT_MAPPING_CONFLICT"} and content(after).content == "ab cX"


GROUPS = "document_id long, step long, element_id long, version int"


def test_merge_makes_an_element_and_tombstones(spark, opened):
    after, outcomes = structure.merge_groups(opened({1: ["a", "b", "c", "", "e"]}), spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 3, 1), (1, 1, 4, 1)], GROUPS), 7)
    assert errors(outcomes) == {1: None} and content(after).content == "a b\n\nc\ne\n" and content(after).text_version == 6
    assert ranges(after) == [(5, "a b", 0, 3), (2, "c", 5, 6), (6, "e", 7, 8)]
    new = after.elements.where("element_id = 5").first()
    assert (new.y, round(new.height, 6), new.confidence, new.source, new.version) == (0.0, 0.18, 0.8, "USER", 1)
    assert after.operations.count() == 2 and after.events.count() == 2 and after.revisions.count() == 4


REFUSED = [
    ([(0, 0, 1), (0, 2, 1)], {}, "OCR_INVALID_STRUCTURE"),
    ([(0, 0, 1), (0, 1, 2)], {}, "OCR_EDIT_CONFLICT"),
    ([(0, 0, 1), (0, 9, 1)], {}, "OCR_ELEMENT_NOT_FOUND"),
    ([(0, 0, 1), (0, 1, 1), (1, 1, 1), (1, 2, 1)], {}, "OCR_ELEMENT_NOT_FOUND"),  # the first group took it
    ([(0, 0, 1), (0, 1, 1)], {"is_excluded": True}, "OCR_INVALID_STRUCTURE"),
    ([(0, 0, 1), (0, 1, 1)], {"page": 2}, "OCR_INVALID_STRUCTURE"),
    ([(0, 0, 1), (0, 1, 1)], {"y": 0.7}, "OCR_MERGE_TOO_FAR"),
    ([(0, 0, 1), (0, 1, 1), (1, 2, 5)], {"y": 0.7}, "OCR_MERGE_TOO_FAR"),  # the first group's error
]


def test_merges_that_are_refused(spark, opened):
    review = opened({d: ["a", "b", "c"] for d in range(len(REFUSED))}, **{f"e{d}_1": own for d, (_, own, _) in enumerate(REFUSED)})
    groups = spark.createDataFrame([(d, *r) for d, (rows, _, _) in enumerate(REFUSED) for r in rows], GROUPS)
    after, outcomes = structure.merge_groups(review, groups, 7)
    assert errors(outcomes) == {d: e for d, (*_, e) in enumerate(REFUSED)}
    assert {r.content for r in after.contents.collect()} == {"a\nb\nc"} and after.operations.count() == 0 == after.elements.where("is_deleted").count()


@pytest.fixture(scope="module")
def nested(spark, opened):
    review = opened({1: ["a", "b", "c", "d"], 2: ["a", "b", "c", "d"]})
    both = [(d, 0, i, 1) for d in (1, 2) for i in (0, 1)]
    review = structure.merge_groups(review, spark.createDataFrame(both, GROUPS), 7)[0].settled()
    return structure.merge_groups(review, spark.createDataFrame([(d, 0, i, 1) for d in (1, 2) for i in (4, 2)], GROUPS), 7)[0].settled()


def test_nested_merges_come_back(spark, nested):
    review = nested
    assert content(review).content == "a b c\n\n\nd" and ranges(review) == [(5, "a b c", 0, 5), (3, "d", 8, 9)]
    # document 2's merged element has changed since, so nothing of it is undone
    review = structure.edit_batch(review, spark.createDataFrame([(2, 5, 1, "new")], "document_id long, element_id long, version int, text string"), 7)[0].settled()
    after, outcomes = structure.undo_to_originals(review, spark.createDataFrame([(1, 5), (2, 5)], "document_id long, operation_id long"), 7)
    assert errors(outcomes) == {1: None, 2: "OCR_MERGE_UNDO_UNAVAILABLE"}
    assert [x[:2] for x in ranges(after)] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    text = content(after).content
    assert all(text[a:b] == t for _, t, a, b in ranges(after)) and text.split("\n\n")[0] == "a\nb"
    assert [x[:2] for x in ranges(after, 2)] == [(5, "new"), (3, "d")] and content(after, 2).content == "new\n\n\nd"
    assert after.operations.where("undone").groupBy("document_id").count().collect()[0][:] == (1, 2)


def test_undo_one_level_and_only_once(spark, nested):
    chosen = spark.createDataFrame([(1, 5)], "document_id long, operation_id long")
    review, outcomes, restored = structure.undo_merges(nested, chosen, 7)
    assert errors(outcomes) == {1: None} and {r.element_id for r in restored.collect()} == {4, 2}
    assert [x[:2] for x in ranges(review)] == [(4, "a b"), (2, "c"), (3, "d")]
    assert review.operations.where("document_id = 1 AND operation_id = 4").first().merged_version == 3  # follows the restored element
    _, again, _ = structure.undo_merges(review.settled(), chosen, 7)
    assert errors(again) == {1: "OCR_MERGE_UNDO_UNAVAILABLE"}


SPLITS = "document_id long, element_id long, version int, orientation string, ratio double, first_text string, second_text string"


def test_split(spark, opened):
    review = opened({1: ["a", "left right", "c"], 2: ["x y"]})
    after, outcomes = structure.split_elements(review, spark.createDataFrame([(1, 1, 1, "VERTICAL", 0.25, "left", "right"), (2, 0, 1, "VERTICAL", 0.95, "x", "y")], SPLITS), 7)
    assert errors(outcomes) == {1: None, 2: "OCR_INVALID_STRUCTURE"}
    assert content(after).content == "a\nleft\nright\nc" and ranges(after) == [(0, "a", 0, 1), (3, "left", 2, 6), (4, "right", 7, 12), (2, "c", 13, 14)]
    rows = {r.element_id: r for r in after.elements.where("document_id = 1").collect()}
    assert [rows[i].reading_order for i in (0, 3, 4, 2)] == [0, 1, 2, 3] and rows[1].is_deleted
    assert (round(rows[4].x, 6), round(rows[4].width, 6), rows[4].is_paragraph_start) == (0.225, 0.375, False)


def test_empty_ranges_move_only_behind_the_edit(spark, opened):
    review = opened({1: ["aa", "bb"]})
    twin = review.elements.where("element_id = 1").withColumns({"element_id": F.lit(7).cast("long"), "reading_order": F.lit(7).cast("long"), "text": F.lit(""), "content_start": F.lit(0).cast("long"), "content_end": F.lit(0).cast("long")})
    review = structure.replace(review, elements=review.elements.unionByName(twin))
    after, _ = structure.edit_batch(review, spark.createDataFrame([(1, 0, 1, "longer")], "document_id long, element_id long, version int, text string"), 7)
    assert sorted(ranges(after)) == [(0, "longer", 0, 6), (1, "bb", 7, 9), (7, "", 0, 0)]  # the empty one stands where the edit begins


def test_settled_tables_lie_in_buckets_and_are_written_once(spark, opened):
    review = opened({1: ["a", "b"], 2: ["c"]}).settled()
    assert review.settled().elements is review.elements
    numbered = review.elements.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("element_id")))
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.document_id, r.text, r.n) for r in numbered.collect()) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
