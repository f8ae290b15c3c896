"""Review of recognised elements: content with offsets, range shifts, groups, progress, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import running_offset


def live(elements: DataFrame) -> DataFrame:
    return elements.where("NOT is_deleted AND NOT is_excluded")


def content_ranges(elements: DataFrame) -> DataFrame:
    """Where each live element stands in the content that joins them by newlines."""
    placed = live(elements).withColumn("content_start", running_offset("document_id", "reading_order", "text"))
    return placed.withColumn("content_end", F.col("content_start") + F.length("text"))


def assembled(elements: DataFrame) -> DataFrame:
    """The content of each document."""
    parts = F.array_sort(F.collect_list(F.struct("reading_order", "text")))
    return live(elements).groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("content"))


def shifted_ranges(ranges: DataFrame, edits: DataFrame) -> DataFrame:
    """Ranges after simultaneous edits (document_id, reading_order, new_text), from the original ranges.

    An element moves by what all edits before it in place and order add.
    """
    joined = ranges.join(edits, ["document_id", "reading_order"], "left")
    delta = F.coalesce(F.length("new_text") - (F.col("content_end") - F.col("content_start")), F.lit(0))
    before = Window.partitionBy("document_id").orderBy("content_start", "reading_order").rowsBetween(Window.unboundedPreceding, -1)
    moved = joined.withColumn("delta", delta).withColumn("shift", F.coalesce(F.sum("delta").over(before), F.lit(0)))
    start = F.col("content_start") + F.col("shift")
    end = F.col("content_end") + F.col("shift") + F.col("delta")
    return moved.select("document_id", "reading_order", start.alias("content_start"), end.alias("content_end"))


def apply_edits(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Elements after edits (document_id, reading_order, expected_version, new_text).

    An edit of an older version raises OCR_EDIT_CONFLICT; an edited element's version rises by one.
    """
    joined = elements.join(edits, ["document_id", "reading_order"], "left")
    edited = F.col("expected_version").isNotNull()
    conflict = F.raise_error(F.lit("OCR_EDIT_CONFLICT")).cast("int")
    version = F.when(edited & (F.col("expected_version") != F.col("version")), conflict).when(edited, F.col("version") + 1).otherwise(F.col("version"))
    text = F.coalesce("new_text", "text")
    return joined.withColumns({"text": text, "version": version}).select(*elements.columns)


def paragraph_groups(rows: DataFrame) -> DataFrame:
    """Rows (document_id, place, is_start) with the number of their paragraph."""
    order = Window.partitionBy("document_id").orderBy("place")
    return rows.withColumn("paragraph", F.sum(F.col("is_start").cast("int")).over(order).cast("int"))


def merge_candidates(elements: DataFrame, breaks: str = "is_deleted OR is_excluded") -> DataFrame:
    """Runs of two or more neighbours that nothing breaks: document_id, first, last, n."""
    order = Window.partitionBy("document_id").orderBy("reading_order")
    marked = elements.withColumn("broken", F.expr(breaks)).withColumn("run", F.sum(F.expr("CAST(broken AS INT)")).over(order))
    runs = marked.where("NOT broken").groupBy("document_id", "run")
    return runs.agg(F.min("reading_order").alias("first"), F.max("reading_order").alias("last"), F.count("*").alias("n")).where("n > 1").drop("run")


def in_content(elements: DataFrame) -> DataFrame:
    """Elements whose text counts: in the content, not deleted and not excluded."""
    return elements.where("is_in_content AND NOT is_deleted AND NOT is_excluded")


def confidence_buckets(elements: DataFrame) -> DataFrame:
    level = F.when(F.col("confidence").isNull() | (F.col("confidence") < 0.65), "low").when(F.col("confidence") < 0.85, "medium").otherwise("high")
    return elements.groupBy("document_id", level.alias("level")).agg(F.count("*").alias("n"))


def progress(elements: DataFrame) -> DataFrame:
    """Live elements, changed ones, and characters of each document."""
    kept = elements.where("NOT is_deleted")
    changed = (F.col("version") > 1) | F.col("is_excluded")
    size = F.when(~F.col("is_excluded"), F.length("text")).otherwise(0)
    return kept.groupBy("document_id").agg(
        F.count("*").alias("elements"), F.sum(changed.cast("int")).alias("changed"), F.sum(size).alias("chars"), F.avg("confidence").alias("mean_confidence")
    )


def paragraph_starts(boxes: DataFrame) -> DataFrame:
    """Boxes that seem to begin a paragraph: indented, or well below the one before."""
    order = Window.partitionBy("page").orderBy("box")
    x, y, height = (F.lag(c).over(order) for c in ("x", "y", "height"))
    below = F.col("y") - (y + height) >= 0.8 * F.greatest(height, F.col("height"), F.lit(0.01))
    return boxes.withColumn("suggested", F.coalesce((F.col("x") - x >= 0.025) | below, F.lit(False)))


def joined_boxes(boxes: DataFrame) -> DataFrame:
    """The text of each line of boxes (page, line, box, x, width, height, text): no blank where the gap
    to the box before is small, the more so between single characters."""
    order = Window.partitionBy("page", "line").orderBy("x", "box")
    before, end, height = F.lag("text").over(order), F.lag(F.col("x") + F.col("width")).over(order), F.lag("height").over(order)
    mean = (F.greatest(height, F.lit(1.0)) + F.greatest(F.col("height"), F.lit(1.0))) / 2
    single = (F.length(before) == 1) & (F.length("text") == 1) & (F.col("x") - end <= mean * 0.6)
    joint = F.when(before.isNull() | single | (F.col("x") - end <= mean * 0.15), "").otherwise(" ")
    parts = F.array_sort(F.collect_list(F.struct("x", "box", "part")))
    glued = boxes.withColumn("part", F.concat(joint, F.col("text")))
    return glued.groupBy("page", "line").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))
