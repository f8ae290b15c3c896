"""Boxes on pages: overlays, scaling, gaps, and which boxes may be merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Shares of overlap that put two boxes in one column or line, and gaps in heights.
SAME_COLUMN, SAME_LINE, FARTHEST = 0.35, 0.5, 3
# Fixed value: centres of text inside an image that make it the background of a text layer.
OVERLAY_TEXTS = 2


def images_without_overlay(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Images (page, image, x, y, x2, y2) but those that lie behind a text layer (page, x, y, x2, y2)."""
    centres = texts.select("page", ((F.col("x") + F.coalesce("x2", "x")) / 2).alias("cx"), ((F.col("y") + F.coalesce("y2", "y")) / 2).alias("cy"))
    inside = F.col("cx").between(F.col("x"), F.col("x2")) & F.col("cy").between(F.col("y"), F.col("y2"))
    behind = images.join(centres, "page").where(inside).groupBy("page", "image").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OVERLAY_TEXTS)
    return images.join(behind, ["page", "image"], "left_anti")


def to_page(boxes: DataFrame) -> DataFrame:
    """Boxes in image pixels (x, y, x2, y2, text, image_width, image_height) in the image's rectangle on
    its page (page_x, page_y, page_x2, page_y2); blank ones and those of flat images go."""
    width, height = F.col("page_x2") - F.col("page_x"), F.col("page_y2") - F.col("page_y")
    across, down = width / F.greatest(F.col("image_width"), F.lit(1.0)), height / F.greatest(F.col("image_height"), F.lit(1.0))
    clamp = lambda low, value, high: F.greatest(low, F.least(high, value))
    x2, y2 = F.coalesce("x2", "x"), F.coalesce("y2", "y")
    zero = F.lit(0.0)
    left = clamp(zero, F.least("x", x2), F.col("image_width"))
    top = clamp(zero, F.least("y", y2), F.col("image_height"))
    right, bottom = clamp(left, F.greatest("x", x2), F.col("image_width")), clamp(top, F.greatest("y", y2), F.col("image_height"))
    placed = {
        "x": F.col("page_x") + left * across,
        "y": F.col("page_y") + top * down,
        "x2": F.col("page_x") + right * across,
        "y2": F.col("page_y") + bottom * down,
        "text": F.trim("text"),
    }
    return boxes.where((width > 0) & (height > 0) & (F.trim("text") != "")).withColumns(placed)


def gaps(intervals: DataFrame) -> DataFrame:
    """Stretches of a page that no interval (page, start, end) covers, between the first and the last one."""
    order = Window.partitionBy("page").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = intervals.withColumn("reached", F.max("end").over(order))
    return reached.where(F.col("start") > F.col("reached")).select("page", F.col("reached").alias("gap_start"), F.col("start").alias("gap_end"))


def mergeable(boxes: DataFrame) -> DataFrame:
    """Boxes (page, box, x, y, width, height) with ``joins``: whether they may be merged with the box before.

    They share a column or a line and lie no farther apart than three heights; the first of a page has null.
    """
    order = Window.partitionBy("page").orderBy("box")
    was = {c: F.lag(c).over(order) for c in ("x", "y", "width", "height")}

    def along(at: str, size: str):
        least_end = F.least(F.col(at) + F.col(size), was[at] + was[size])
        most_start = F.greatest(F.col(at), was[at])
        shared = F.greatest(F.lit(0.0), least_end - most_start) / F.greatest(F.least(F.col(size), was[size]), F.lit(0.001))
        return shared, F.greatest(F.lit(0.0), most_start - least_end)

    column, across = along("x", "width")
    line, down = along("y", "height")
    most = F.greatest(F.col("height"), was["height"]) * FARTHEST
    joins = ((column >= SAME_COLUMN) & (down <= most)) | ((line >= SAME_LINE) & (across <= most))
    return boxes.withColumn("joins", F.when(was["x"].isNotNull(), joins))


def cell_text(lines: DataFrame) -> DataFrame:
    """Text of each cell from its lines (cell, line, text): single characters are glued, others are parted by blanks."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: F.trim(p["text"])), lambda t: t != "")
    cells = lines.groupBy("cell").agg(texts.alias("parts"))
    single = (F.size("parts") > 0) & F.forall("parts", lambda t: F.length(t) == 1)
    return cells.select("cell", F.when(single, F.array_join("parts", "")).otherwise(F.array_join("parts", " ")).alias("text"))


def block_order(boxes: DataFrame) -> DataFrame:
    """Boxes (page, box, y, x, block, inner) in reading order: an image's block stands where its first box
    stands, and its boxes keep their own order; ``block`` is null outside images."""
    own = Window.partitionBy("page", "unit")
    placed = boxes.withColumn("unit", F.coalesce(F.concat(F.lit("b"), F.col("block").cast("string")), F.concat(F.lit("t"), F.col("box").cast("string"))))
    placed = placed.withColumns({"unit_y": F.min("y").over(own), "unit_x": F.min("x").over(own)})
    order = Window.partitionBy("page").orderBy("unit_y", "unit_x", "unit", F.coalesce("inner", F.lit(0)), "box")
    return placed.withColumn("place", F.row_number().over(order)).select("page", "box", "place")


def scalars(boxes: DataFrame) -> DataFrame:
    """Boxes (x, y, x2, y2) with centres and sizes."""
    return boxes.withColumns(
        {
            "center_x": (F.col("x") + F.col("x2")) / 2,
            "center_y": (F.col("y") + F.col("y2")) / 2,
            "box_width": F.greatest(F.col("x2") - F.col("x"), F.lit(0.0)),
            "box_height": F.greatest(F.col("y2") - F.col("y"), F.lit(0.0)),
        }
    )


def median_heights(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page").agg(F.percentile("height", F.lit(0.5)).alias("median_height"))


# Limits of an image's measures, the steps in the order in which they run, and why each is chosen.
NARROW, NARROW_UNREAD, SMALL_TEXT, LOW_COLOR, LOW_CONTRAST, POOR_CONTRAST, NOISY, CALM, UNEVEN_LIGHT, BLURRED, SKEWED = 1000, 700, 18, 0.02, 70, 55, 10, 6, 18, 45, 0.12
STEPS = ("to_grayscale", "upscale", "adjust_contrast", "denoise", "invert", "binarize", "adaptive_binarize", "sharpen")
WHY = (
    "글자 또는 이미지 크기가 작아 확대", "어두운 배경과 밝은 글자가 감지되어 반전", "흑백 문서의 대비가 낮아 CLAHE 적용", "점 형태의 노이즈가 많아 제거",
    "조명이 불균일해 적응형 이진화", "조명이 균일한 저대비 문서라 Otsu 이진화", "약한 흐림이 감지되어 글자 경계 강조", "품질이 충분해 원본 RGB 사용",
)


def preprocess_plans(images: DataFrame) -> DataFrame:
    """Images with the steps to prepare them, the reasons, and what else to switch on, by their measures alone.

    Measures are width, text_height (null: unknown), color_ratio, contrast, noise_score, illumination_score, blur_score,
    perspective_score, dark_background, rotation_suspected.
    """
    c = F.col
    known = c("text_height").isNotNull()
    gray_like = c("color_ratio") < LOW_COLOR
    upscale = F.when(known, (c("width") < NARROW) & (c("text_height") < SMALL_TEXT)).otherwise(c("width") < NARROW_UNREAD)
    invert = c("dark_background")
    contrast = ~invert & gray_like & (c("contrast") < LOW_CONTRAST)
    denoise = gray_like & (c("noise_score") > NOISY)
    poor = gray_like & (c("contrast") < POOR_CONTRAST)
    adaptive, plain = poor & (c("illumination_score") >= UNEVEN_LIGHT), poor & (c("illumination_score") < UNEVEN_LIGHT)
    sharpen = known & (c("blur_score") < BLURRED) & (c("noise_score") < CALM) & ~poor
    gray = invert | contrast | denoise | poor | sharpen
    pick = lambda names, tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(names, tests)]))
    reasons = pick(WHY, (upscale, invert, contrast, denoise, adaptive, plain, sharpen))
    return images.withColumns(
        {
            "steps": pick(STEPS, (gray, upscale, contrast, denoise, invert, plain, adaptive, sharpen)),
            "reasons": F.when(F.size(reasons) == 0, F.array(F.lit(WHY[-1]))).otherwise(reasons),
            "use_doc_orientation_classify": c("rotation_suspected"),
            "use_doc_unwarping": c("perspective_score") >= SKEWED,
            "use_textline_orientation": c("rotation_suspected"),
        }
    )
