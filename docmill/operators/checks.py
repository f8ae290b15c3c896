"""Guards and small relational helpers: requests, limits, duplicates, cascades, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: characters of an extracted text file at most.
MAX_EXTRACTED_CHARS = 45_000
IMAGES = ("png", "jpg", "jpeg")


def repeated_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that come more than once, with their counts."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(rows: DataFrame, *key: str) -> DataFrame:
    """``rows``; a repeated key raises DUPLICATE_ID when they are read."""
    most = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n").alias("__n"))
    checked = F.when(F.coalesce("__n", F.lit(0)) > 1, F.raise_error(F.lit("DUPLICATE_ID")).cast("boolean")).otherwise(True)
    return rows.join(F.broadcast(most.select(checked.alias("__fine"))), F.col("__fine")).drop("__fine")  # one row


def missing(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys, each once and sorted, that aren't known."""
    return asked.select(key).distinct().join(known, key, "left_anti").orderBy(key)


def extraction_error(file_type: Column, content: Column, pages: Column, max_pages: int, max_chars: int = MAX_EXTRACTED_CHARS) -> Column:
    """Why an extraction is refused, or null."""
    blank = content.isNull() | ~F.regexp_like(content, F.lit(r"(?U)\S"))
    return (
        F.when(blank, "EXTRACTION_FAILED")
        .when((file_type == "pdf") & (pages > max_pages), "TOO_MANY_PAGES")
        .when(file_type.isin("docx", "hwpx") & (F.length(content) > max_chars), "CONTENT_TOO_LARGE")
    )


def strategy(file_type: Column, value: Column, known: tuple[str, ...]) -> Column:
    """A strategy in upper case; unknown ones, and others than AUTO for images, are INVALID_EXTRACTION_STRATEGY."""
    upper = F.upper(value)
    wrong = upper.isNull() | ~upper.isin(*known) | (file_type.isin(*IMAGES) & (upper != "AUTO"))
    return F.when(wrong, "INVALID_EXTRACTION_STRATEGY").otherwise(upper)


def document_type(value: Column, known: tuple[str, ...]) -> Column:
    """A type in upper case, null if blank; an unknown one is INVALID_DOCUMENT_TYPE."""
    upper = F.upper(F.trim(value))
    return F.when(value.isNull() | (F.trim(value) == ""), None).when(upper.isin(*known), upper).otherwise("INVALID_DOCUMENT_TYPE")


def box_error(x: Column, y: Column, width: Column, height: Column) -> Column:
    """INVALID_BOX for a box that isn't inside the unit page."""
    inside = (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= 1) & (y + height <= 1)
    return F.when(~F.coalesce(inside, F.lit(False)), "INVALID_BOX")


def without_document(tables: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of deleted documents (document_id); ``documents`` is keyed by id."""
    gone = document_ids.select("document_id").distinct()
    by_id = gone.withColumnRenamed("document_id", "id")
    return {name: df.join(by_id, "id", "left_anti") if name == "documents" else df.join(gone, "document_id", "left_anti") for name, df in tables.items()}


def counts_of(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """One row for each key, with a count for each value; values that don't occur have 0."""
    each = rows.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    maps = each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias("counts"))
    return maps.select(key, *[F.coalesce(F.try_element_at("counts", F.lit(v)), F.lit(0)).alias(v.lower()) for v in values])


def zipped(rows: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """One row for each pair of two lists; lists of different lengths raise LENGTH_MISMATCH."""
    wrong = F.size(left) != F.size(right)
    lists = F.when(wrong, F.raise_error(F.lit("LENGTH_MISMATCH")).cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(left) - 1))
    return rows.withColumn(out, F.explode(F.when(F.size(left) == 0, F.array().cast("array<int>")).otherwise(lists)))


def latest_by_type(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each document and type, by time alone."""
    newest = F.max_by(F.struct("id", "result_json"), "created_at")
    return analyses.groupBy("document_id", "analyzer_type").agg(newest.alias("newest"), F.max("created_at").alias("created_at")).select("document_id", "analyzer_type", "newest.*", "created_at")


# The lines of a summary report.
RULE, THIN = "=" * 46, "-" * 46
REPORT = ("문서 요약 보고서", "파일명      : ", "문서 유형   : ", "업로드 일시 : ", "분석 일시   : ", "[카테고리]", "(분류 근거: ", ")", "[요약]", "생성: ")


def date_text(value: Column) -> Column:
    """Time to the second, or a dash."""
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def summary_report(documents: DataFrame, analyses: DataFrame, summary: str = "SUMMARY", category: str = "CATEGORY", maker: str = "docmill") -> DataFrame:
    """document_id, filename, content of a text report for each document that has a summary or a category; ``maker`` signs it."""
    newest = latest_by_type(analyses.where(F.col("analyzer_type").isin(summary, category)))
    field = lambda kind, name: F.max(F.when(F.col("analyzer_type") == kind, F.get_json_object("result_json", f"$.{name}")))
    at = lambda kind: F.max(F.when(F.col("analyzer_type") == kind, F.col("created_at")))
    found = newest.groupBy("document_id").agg(
        field(summary, "summary").alias("summary"), field(category, "category").alias("category"), field(category, "reason").alias("reason"),
        F.coalesce(at(summary), at(category)).alias("analyzed_at"),
    )
    joined = documents.join(found.withColumnRenamed("document_id", "id"), "id")
    dash = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "-").otherwise(F.col(c))
    title, file_, kind, uploaded, analyzed, category_, because, close, summary_, end = REPORT
    lines = [
        F.lit(RULE), F.lit(title), F.lit(RULE), F.concat(F.lit(file_), "filename"), F.concat(F.lit(kind), F.coalesce("document_type", F.lit("None"))),
        F.concat(F.lit(uploaded), date_text(F.col("created_at"))), F.concat(F.lit(analyzed), date_text(F.col("analyzed_at"))), F.lit(THIN),
        F.lit(category_), dash("category"), F.concat(F.lit(because), dash("reason"), F.lit(close)), F.lit(""), F.lit(summary_), dash("summary"), F.lit(THIN), F.lit(end + maker),
    ]
    base = F.regexp_replace("filename", r"\.[^.]*$", "")
    return joined.select(F.col("id").alias("document_id"), F.concat(base, F.lit("_요약.txt")).alias("filename"), F.array_join(F.array(*lines), "\n").alias("content"))


#: Words of which a line of a Spark plan must hold one to be kept.
PLAN_LINES = ("Scan", "Filter", "Join", "Exchange", "Sort", "Limit", "Aggregate", "Window", "Project", "TakeOrdered")


def plan_summary(df: DataFrame, whole: bool = False) -> str:
    """Spark's plan, long lists of numbers masked and, unless ``whole``, only the lines that tell how rows are found."""
    import re

    plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    masked = re.sub(r"\[[-0-9eE.,\s]{60,}\]", "[...]", plan)
    if whole:
        return masked
    kept = [line for line in masked.splitlines() if any(word in line for word in PLAN_LINES)]
    return "\n".join(kept) or masked
