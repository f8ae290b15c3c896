"""Layout of pages: boxes in cells, ranges that overlap, bands of repeated lines, rows of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions.text import repeat_key

# The band at the top and bottom of a page, and what counts as repetition.
BAND, MIN_PAGES, MIN_RATIO = 0.12, 3, 0.5
# Fixed value: the share of the smaller height by which a box overlaps the line it belongs to.
LINE_OVERLAP = 0.45


def cell_of_box(boxes: DataFrame, cells: DataFrame, step: float = 0.05) -> DataFrame:
    """The first cell (page, cell, x, y, width, height) that holds each box's centre; page by page.

    A centre meets only the cells that reach into its band of the page, ``step`` high.
    """
    band = lambda y: F.floor(y / F.lit(step))
    cell = cells.select("page", "cell", *[F.col(c).alias(f"c_{c}") for c in ("x", "y", "width", "height")])
    cell = cell.withColumn("band", F.explode(F.sequence(band(F.col("c_y")), band(F.col("c_y") + F.greatest("c_height", F.lit(0.0))))))
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    inside = cx.between(F.col("c_x"), F.col("c_x") + F.col("c_width")) & cy.between(F.col("c_y"), F.col("c_y") + F.col("c_height"))
    return boxes.withColumn("band", band(cy)).join(cell, ["page", "band"]).where(inside).groupBy("page", "box").agg(F.min("cell").alias("cell"))


def table_rows(cells: DataFrame) -> DataFrame:
    """Rows of tables from cells (page, table, row, column, text, confidence, x, y, width, height)."""
    parts = F.array_sort(F.collect_list(F.struct("column", "text")))
    return cells.groupBy("page", "table", "row").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " | ").alias("text"),
        (F.col("row") == 0).alias("is_header"),
        F.avg("confidence").alias("confidence"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("x2"),
        F.max(F.col("y") + F.col("height")).alias("y2"),
    )


def overlapping(a: DataFrame, b: DataFrame, width: int = 1024) -> DataFrame:
    """Pairs of ranges (document_id, id, start, end) of one document that overlap.

    Ranges meet in the stretches of ``width`` that they reach into, and a pair counts in the first one that both have.
    """

    def cut(df: DataFrame, first: str) -> DataFrame:
        stretch = lambda x: F.floor(x / F.lit(width))
        last = F.greatest(stretch(F.col("start")), stretch(F.col("end") - 1))
        return df.withColumn(first, stretch(F.col("start"))).withColumn("stretch", F.explode(F.sequence(F.col(first), last)))

    left = cut(a.select("document_id", "id", "start", "end"), "f1")
    right = cut(b.select("document_id", "id", "start", "end"), "f2").select("document_id", "stretch", F.col("id").alias("other"), F.col("start").alias("s"), F.col("end").alias("e"), "f2")
    both = left.join(right, ["document_id", "stretch"]).where("start < e AND s < end AND stretch = greatest(f1, f2)")
    return both.select("document_id", "id", "other")


def headers_and_footers(lines: DataFrame, ratio: float = MIN_RATIO) -> DataFrame:
    """Lines (document_id, page, text, y) in the bands that enough pages of their document repeat."""
    banded = lines.where((F.col("y") <= BAND) | (F.col("y") >= 1 - BAND)).withColumn("key", repeat_key(F.col("text")))
    repeats = banded.groupBy("document_id", "key").agg(F.count_distinct("page").alias("on"))
    pages = lines.groupBy("document_id").agg(F.count_distinct("page").alias("pages"))
    enough = F.greatest(F.lit(MIN_PAGES), F.floor(F.col("pages") * ratio + 0.5))
    keys = repeats.join(pages, "document_id").where(F.col("on") >= enough).select("document_id", "key")
    return banded.join(keys, ["document_id", "key"], "left_semi").drop("key")


def text_lines(boxes: DataFrame, least_height: float = 0.0) -> DataFrame:
    """Boxes (page, box, x, y, width, height, text) joined to lines.

    By their middles, each box joins the first line whose extent it overlaps by ``LINE_OVERLAP`` of the smaller height,
    and the line grows by it. Heights count ``least_height`` at least, which is 1 for boxes in pixels. A page is one fold.
    """
    box = F.struct((F.col("y") + F.col("height") / 2).alias("middle"), "x", "box", "y", (F.col("y") + F.col("height")).alias("y2"), "text")
    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    line = "struct<y:double,y2:double,members:array<struct<x:double,box:bigint,text:string>>>"
    tall = lambda h: F.greatest(h, F.lit(least_height))

    def step(lines: Column, b: Column) -> Column:
        def fits(at: Column) -> Column:
            shared = F.greatest(F.lit(0.0), F.least(b["y2"], at["y2"]) - F.greatest(b["y"], at["y"]))
            return shared / F.nullif(F.least(tall(b["y2"] - b["y"]), tall(at["y2"] - at["y"])), F.lit(0.0)) >= LINE_OVERLAP

        first = F.array_position(F.transform(lines, lambda at: F.coalesce(fits(at), F.lit(False))), F.lit(True))
        member = F.array(F.struct(b["x"].cast("double").alias("x"), b["box"].cast("bigint").alias("box"), b["text"].alias("text")))
        new = F.array(F.struct(b["y"].cast("double").alias("y"), b["y2"].cast("double").alias("y2"), member.alias("members")))
        grown = lambda at: F.struct(F.least(at["y"], b["y"]).alias("y"), F.greatest(at["y2"], b["y2"]).alias("y2"), F.concat(at["members"], member).alias("members"))
        return F.when(first == 0, F.concat(lines, new)).otherwise(F.transform(lines, lambda at, i: F.when(i + 1 == first, grown(at)).otherwise(at)))

    lines = pages.select("page", F.posexplode(F.aggregate("boxes", F.array().cast(f"array<{line}>"), step)).alias("line", "l"))
    parts = F.transform(F.array_sort("l.members"), lambda p: p["text"])
    return lines.select("page", (F.col("line") + 1).alias("line"), F.array_join(parts, " ").alias("text"))


def overlap_ratio(x: Column, y: Column, width: Column, height: Column, x2: Column, y2: Column, width2: Column, height2: Column) -> Column:
    """Intersection over union of two boxes."""
    across = F.greatest(F.least(x + width, x2 + width2) - F.greatest(x, x2), F.lit(0.0))
    down = F.greatest(F.least(y + height, y2 + height2) - F.greatest(y, y2), F.lit(0.0))
    shared = across * down
    return shared / (width * height + width2 * height2 - shared)


def clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
