"""The life of a review: elements and the text they stand in, changed together.

Elements have document_id, reading_order, text, version, is_excluded, is_deleted, is_in_content,
content_start, content_end; contents have document_id, content, char_count, text_version. A request
names elements by document_id and reading_order with the version it has seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["document_id", "reading_order"]


def _error(name: str) -> Column:
    return F.raise_error(F.lit(name))


def start_review(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with their ranges in the text that joins them by newlines, and these texts."""
    order = Window.partitionBy("document_id").orderBy("reading_order").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(order), F.lit(0)).cast("long")
    placed = elements.withColumn("content_start", start).withColumn("content_end", F.col("content_start") + F.length("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda p: p["text"])
    contents = elements.groupBy("document_id").agg(F.array_join(parts, "\n").alias("content"))
    contents = contents.withColumns({"char_count": F.length("content"), "text_version": F.lit(1)})
    return placed.withColumn("is_in_content", F.lit(True)), contents


def splice(contents: DataFrame, edits: DataFrame) -> DataFrame:
    """Contents after all edits (document_id, place, start, end, expected, replacement) of a document.

    A range that doesn't hold what is expected raises OCR_CONTENT_MAPPING_CONFLICT. Edits go in from
    right to left, so that none moves another; text_version rises by one if the text changes.
    """
    listed = edits.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", "expected", "replacement")), asc=False).alias("edits"))
    joined = contents.join(listed, "document_id", "left")

    def put(text: Column, edit: Column) -> Column:
        there = F.substring(text, edit["start"].cast("int") + 1, (edit["end"] - edit["start"]).cast("int"))
        fits = edit["start"].isNotNull() & edit["end"].isNotNull() & (edit["start"] <= edit["end"]) & (edit["end"] <= F.length(text))
        cut = F.concat(F.substring(text, F.lit(1), edit["start"].cast("int")), edit["replacement"], F.substring(text, edit["end"].cast("int") + 1, F.length(text)))
        return F.when(fits & (there == edit["expected"]), cut).otherwise(_error("OCR_CONTENT_MAPPING_CONFLICT"))

    spliced = joined.withColumn("was", F.col("content")).withColumn(
        "content", F.when(F.col("edits").isNull(), F.col("content")).otherwise(F.aggregate("edits", F.col("content"), put))
    )
    version = F.col("text_version") + (F.col("content") != F.col("was")).cast("int")
    return spliced.withColumns({"char_count": F.length("content"), "text_version": version}).drop("edits", "was")


def replace_in_content(elements: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put each element's ``replacement`` (null: leave it) into the text and move the ranges behind it."""
    expected = F.when(F.col("is_in_content"), F.col("text")).otherwise("")
    edits = elements.where("replacement IS NOT NULL").select(
        "document_id", F.col("reading_order").alias("place"), F.col("content_start").alias("start"), F.col("content_end").alias("end"), expected.alias("expected"), "replacement"
    )
    delta = F.coalesce(F.length("replacement") - (F.col("content_end") - F.col("content_start")), F.lit(0))
    before = Window.partitionBy("document_id").orderBy("content_start", "reading_order").rowsBetween(Window.unboundedPreceding, -1)
    moved = elements.withColumn("delta", delta).withColumn("shift", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    moved = moved.withColumns({"content_start": F.col("content_start") + F.col("shift"), "content_end": F.col("content_end") + F.col("shift") + F.col("delta")})
    return moved.drop("delta", "shift", "replacement"), splice(contents, edits)


def _asked(elements: DataFrame, requests: DataFrame) -> DataFrame:
    """Elements with ``asked``; OCR_EDIT_CONFLICT if a request has seen another version."""
    joined = elements.join(requests.withColumnRenamed("version", "seen"), KEY, "left").withColumn("asked", F.col("seen").isNotNull())
    checked = F.when(F.col("asked") & (F.col("seen") != F.col("version")), _error("OCR_EDIT_CONFLICT").cast("int")).otherwise(F.col("version"))
    return joined.withColumn("version", checked).drop("seen")


def set_exclusion(elements: DataFrame, requests: DataFrame) -> DataFrame:
    """Exclude or include elements (requests have ``exclude``); the text changes when the review is completed."""
    joined = _asked(elements, requests)
    changed = {"is_excluded": F.when(F.col("asked"), F.col("exclude")).otherwise(F.col("is_excluded")), "version": F.col("version") + F.col("asked").cast("int")}
    return joined.withColumns(changed).select(*elements.columns)


def set_deletion(elements: DataFrame, contents: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete or restore elements (requests have ``delete``), in the text too; what is so already stays."""
    joined = _asked(elements, requests).withColumn("asked", F.col("asked") & (F.col("delete") != F.col("is_deleted")))
    out = F.col("asked") & F.col("delete") & F.col("is_in_content")
    back = F.col("asked") & ~F.col("delete") & ~F.col("is_excluded") & ~F.col("is_in_content")
    joined = joined.withColumn("replacement", F.when(out, "").when(back, F.col("text")))
    moved, contents = replace_in_content(joined, contents)
    flags = {
        "is_in_content": F.when(out, False).when(back, True).otherwise(F.col("is_in_content")),
        "is_deleted": F.when(F.col("asked"), F.col("delete")).otherwise(F.col("is_deleted")),
        "version": F.col("version") + F.col("asked").cast("int"),
    }
    return moved.withColumns(flags).select(*elements.columns), contents


def create_elements(elements: DataFrame, contents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append new elements (document_id, text), one for a document, behind the last one and to the text."""
    last = elements.groupBy("document_id").agg((F.max("reading_order") + 1).alias("reading_order"))
    rows = new.join(contents, "document_id").join(last, "document_id", "left")
    gap = F.when(F.length("content") > 0, "\n").otherwise("")
    start = (F.length("content") + F.length(gap)).cast("long")
    own = {
        "reading_order": F.coalesce("reading_order", F.lit(0)),
        "version": F.lit(1),
        "is_excluded": F.lit(False),
        "is_deleted": F.lit(False),
        "is_in_content": F.lit(True),
        "content_start": start,
        "content_end": start + F.length("text"),
    }
    made = rows.withColumns(own)
    columns = [F.col(c).alias(c) if c in made.columns else F.lit(None).cast(elements.schema[c].dataType).alias(c) for c in elements.columns]
    grown = contents.join(new.select("document_id", F.col("text").alias("added")), "document_id", "left")
    text = F.when(F.col("added").isNull(), F.col("content")).otherwise(F.concat("content", gap, "added"))
    grown = grown.withColumns({"content": text, "text_version": F.col("text_version") + F.col("added").isNotNull().cast("int")})
    return elements.unionByName(made.select(*columns)), grown.withColumn("char_count", F.length("content")).drop("added")


def complete_review(elements: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take excluded elements out of the text and put included ones back; deleted ones stay as they are."""
    live = ~F.col("is_deleted")
    out, back = live & F.col("is_excluded") & F.col("is_in_content"), live & ~F.col("is_excluded") & ~F.col("is_in_content")
    moved, contents = replace_in_content(elements.withColumn("replacement", F.when(out, "").when(back, F.col("text"))), contents)
    return moved.withColumn("is_in_content", F.when(out, False).when(back, True).otherwise(F.col("is_in_content"))).select(*elements.columns), contents


def completed_reviews(documents: DataFrame, contents: DataFrame, elements: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, contents and elements as stored after reviews are completed (document_id, user_id, at), one row each.

    Documents (id, review_status, reviewed_by, reviewed_at) are COMPLETED; contents (with ocr_char_count, is_confirmed,
    confirmed_by, confirmed_at) have their excluded elements taken out and are confirmed. Other documents stay as
    they are; an unknown document_id changes nothing, a document without a text is completed all the same.
    """
    mark = done.select("document_id", "user_id", "at")
    one = documents.join(mark.withColumnRenamed("document_id", "id"), "id", "left")
    reviewed = F.col("at").isNotNull()
    put = lambda c, value: F.when(reviewed, value).otherwise(F.col(c))
    own = {"review_status": put("review_status", F.lit("COMPLETED")), "reviewed_by": put("reviewed_by", F.col("user_id")), "reviewed_at": put("reviewed_at", F.col("at"))}
    stored = one.select(*[own.get(c, F.col(c)).alias(c) for c in documents.columns])
    ids = mark.select("document_id")
    plain = ["document_id", "content", "char_count", "text_version"]
    moved, texts = complete_review(elements.join(ids, "document_id", "left_semi"), contents.join(ids, "document_id", "left_semi").select(*plain))
    after = texts.join(kept_chars(moved), "document_id", "left").select(*plain, F.coalesce("ocr_char_count", F.lit(0)).cast("long").alias("ocr_char_count"))
    after = after.join(mark, "document_id").withColumns({"is_confirmed": F.lit(True), "confirmed_by": F.col("user_id"), "confirmed_at": F.col("at")})
    rest = contents.join(ids, "document_id", "left_anti").unionByName(after.select(*contents.columns))
    return stored, rest, elements.join(ids, "document_id", "left_anti").unionByName(moved.select(*elements.columns))


def kept_chars(elements: DataFrame) -> DataFrame:
    """document_id, ocr_char_count: characters of live elements that aren't excluded."""
    return elements.where("NOT is_deleted AND NOT is_excluded").groupBy("document_id").agg(F.sum(F.length("text")).alias("ocr_char_count"))


def mark_in_progress(documents: DataFrame, touched: DataFrame) -> DataFrame:
    """Documents (id, review_status, ocr_revision) after changes (document_id, one row each)."""
    counts = touched.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("changes"))
    joined = documents.join(counts, "id", "left")
    again = F.col("changes").isNotNull() & F.col("review_status").isin("PENDING", "COMPLETED")
    return joined.withColumns(
        {
            "review_status": F.when(again, "IN_PROGRESS").otherwise(F.col("review_status")),
            "ocr_revision": F.col("ocr_revision") + F.coalesce("changes", F.lit(0)),
        }
    ).drop("changes")


def undoable_merges(operations: DataFrame, elements: DataFrame, documents: DataFrame) -> DataFrame:
    """Merges that can still be undone, newest first: id, document_id, survivor, selected.

    ``snapshot_json`` lists ``selected_ids``; the survivor is alive and hasn't changed since.
    """
    alive = elements.where("NOT is_deleted").select("document_id", F.col("reading_order").alias("survivor"), F.col("version").alias("merged_version"))
    selected = F.coalesce(F.json_array_length(F.get_json_object("snapshot_json", "$.selected_ids")), F.lit(0))
    found = operations.where("undone_at IS NULL").join(alive, ["document_id", "survivor", "merged_version"])
    found = found.join(documents.select(F.col("id").alias("document_id"), "project_id"), "document_id")
    return found.select("id", "project_id", "document_id", "survivor", selected.alias("selected"), "created_at").orderBy(F.desc("created_at"), F.desc("id"))


def latest_events(events: DataFrame, documents: DataFrame, project_id: int, limit: int = 50) -> DataFrame:
    """The newest events (id, document_id, created_at) of a project's documents."""
    own = documents.where(F.col("project_id") == project_id).select(F.col("id").alias("document_id"))
    return events.join(own, "document_id", "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def revisions_with_editors(revisions: DataFrame, elements: DataFrame, pages: DataFrame, documents: DataFrame, users: DataFrame) -> DataFrame:
    """Revisions of elements, each with its document and its editor's name, null if the editor is gone."""
    scoped = scoped_elements(elements, pages, documents).select("element_id", "document_id", "project_id")
    editors = users.select(F.col("id").alias("changed_by"), F.col("name").alias("editor"))
    return revisions.join(scoped, "element_id").join(editors, "changed_by", "left")


def scoped_elements(elements: DataFrame, pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements (element_id, page_id) with the page, document and project that they belong to."""
    owned = pages.join(documents.select(F.col("id").alias("document_id"), "project_id"), "document_id")
    return elements.join(owned, "page_id")


def pages_with_elements(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Each page with its elements in reading order, an empty list if it has none."""
    fields = [c for c in elements.columns if c != "page_id"]
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", *[c for c in fields if c != "reading_order"])))
    lists = elements.groupBy("page_id").agg(ordered.alias("elements"))
    return pages.join(lists, "page_id", "left").withColumn("elements", F.coalesce("elements", F.array()))


def reading_places(elements: DataFrame) -> DataFrame:
    """Elements with their place in the document: by page number, page, and order on the page."""
    order = Window.partitionBy("document_id").orderBy("page_number", "page_id", "reading_order")
    return elements.withColumn("place", F.row_number().over(order))


def change_sets(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each changed row: the key, and of each field the new value or null; ``changed`` names the fields."""
    old = before.select(F.col(key), *[F.col(f).alias(f"__{f}") for f in fields])
    differs = {f: ~F.col(f).eqNullSafe(F.col(f"__{f}")) for f in fields}
    joined = after.join(old, key).withColumn("changed", F.array_compact(F.array(*[F.when(d, F.lit(f)) for f, d in differs.items()])))
    return joined.where(F.size("changed") > 0).select(key, *[F.when(d, F.col(f)).alias(f) for f, d in differs.items()], "changed")
