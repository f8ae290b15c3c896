"""Documents of a project: search, pages, latest analyses, freshness, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_analyses(analyses: DataFrame) -> DataFrame:
    """The newest analysis of each document and type, ties to the larger id."""
    newest = Window.partitionBy("document_id", "analyzer_type").orderBy(F.desc("created_at"), F.desc("id"))
    return analyses.withColumn("place", F.row_number().over(newest)).where("place = 1").drop("place")


def analysis_history(analyses: DataFrame, document_id: int) -> DataFrame:
    """All analyses of a document; the newest of each type is marked."""
    newest = Window.partitionBy("analyzer_type").orderBy(F.desc("created_at"), F.desc("id"))
    own = analyses.where(F.col("document_id") == document_id)
    return own.withColumn("is_latest", F.row_number().over(newest) == 1)


def ignoring_white_space(text: Column, term: str) -> Column:
    """Whether a text holds the term, white space and case aside; % and _ in the term are wild."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return F.ilike(bare(text), F.concat(F.lit("%"), bare(F.lit(term)), F.lit("%")))


def search_documents(
    documents: DataFrame, texts: DataFrame, analyses: DataFrame, project_id: int,
    term: str | None = None, document_type: str | None = None, category: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Documents of a project by a term in the filename or the text, a type, or a field of any analysis.

    ``category`` is (analyzer type, JSON path, value). Blank conditions are skipped.
    """
    found = documents.where(F.col("project_id") == project_id)
    if document_type:
        found = found.where(F.col("document_type") == document_type)
    if term and term.strip():
        holding = texts.where(ignoring_white_space(F.col("content"), term)).select(F.col("document_id").alias("id"), F.lit(True).alias("held"))
        found = found.join(holding, "id", "left")
        found = found.where(F.col("held").isNotNull() | ignoring_white_space(F.col("filename"), term)).drop("held")
    if category:
        kind, path, value = category
        judged = analyses.where((F.col("analyzer_type") == kind) & (F.get_json_object("result_json", path) == value))
        found = found.join(judged.select(F.col("document_id").alias("id")), "id", "left_semi")
    return found


def page(documents: DataFrame, number: int, size: int) -> DataFrame:
    """One page, newest first."""
    return documents.orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def page_count(documents: DataFrame, size: int) -> DataFrame:
    return documents.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size).cast("int"))


def document_list(documents: DataFrame, texts: DataFrame, analyses: DataFrame, types: tuple[str, str], preview: int = 100) -> DataFrame:
    """Documents with a preview of their text and two of their latest analyses."""
    latest = latest_analyses(analyses.where(F.col("analyzer_type").isin(*types)))
    wide = latest.groupBy("document_id").agg(*[F.max(F.when(F.col("analyzer_type") == t, F.col("result_json"))).alias(t) for t in types])
    joined = documents.join(texts.select(F.col("document_id").alias("id"), "content", "char_count"), "id", "left")
    joined = joined.join(wide.withColumnRenamed("document_id", "id"), "id", "left")
    return joined.select("id", "filename", F.substring("content", 1, preview).alias("preview"), F.coalesce("char_count", F.lit(0)).alias("char_count"), *types)


def stale_documents(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with a chunk of an older text version than the text."""
    joined = chunks.join(texts.select("document_id", F.col("text_version").alias("now")), "document_id")
    return joined.where(F.col("text_version") < F.col("now")).groupBy("document_id").agg(F.count("*").alias("stale_chunks"))


def freshness(chunks: DataFrame, texts: DataFrame, model: str) -> DataFrame:
    """Whether all chunks of a document have its present text version and the model."""
    pairs = chunks.groupBy("document_id").agg(
        F.count_distinct("text_version", "embedding_model").alias("pairs"), F.max("text_version").alias("version"), F.max("embedding_model").alias("model")
    )
    joined = texts.select("document_id", "text_version").join(pairs, "document_id", "left")
    fresh = (F.col("pairs") == 1) & (F.col("version") == F.col("text_version")) & (F.col("model") == model)
    return joined.select("document_id", F.coalesce(fresh, F.lit(False)).alias("is_fresh"))


def duplicates(documents: DataFrame) -> DataFrame:
    """Documents of a project whose content an earlier one of it has."""
    first = Window.partitionBy("project_id", "content_hash")
    return documents.withColumn("original_id", F.min("id").over(first)).where("id <> original_id").select("id", "project_id", "original_id")


def replace_chunks(current: DataFrame, fresh: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks after a rebuild: those of rebuilt documents (of one model only, if given) are replaced."""
    rebuilt = fresh.select("document_id").distinct().withColumn("rebuilt", F.lit(True))
    joined = current.join(rebuilt, "document_id", "left")
    gone = F.col("rebuilt").isNotNull()
    if model is not None:
        gone &= F.col("embedding_model") == model
    return joined.where(~gone).drop("rebuilt").unionByName(fresh)


def primary_action(status: Column, review: Column) -> Column:
    """What a reader should do next with a document."""
    return (
        F.when(status == "FAILED", "SHOW_ERROR")
        .when(status.isin("PENDING", "EXTRACTING", "ANALYZING"), "SHOW_PROGRESS")
        .when(review.isin("PENDING", "IN_PROGRESS"), "REVIEW")
        .when(review == "COMPLETED", "REVIEW_AGAIN")
        .otherwise("OPEN")
    )


def judged_category(raw: Column, known: list[str], fallback: str) -> tuple[Column, Column]:
    """Category and reason of a model's answer in JSON; broken or unknown answers fall back."""
    parsed = F.from_json(raw, "category string, reason string")
    broken = parsed.isNull() | parsed["category"].isNull()
    category = F.when(~broken & parsed["category"].isin(*known), parsed["category"]).otherwise(fallback)
    return category, F.when(broken, raw).otherwise(F.coalesce(parsed["reason"], F.lit("")))


def top_chunks(hits: DataFrame, n: int = 2) -> DataFrame:
    """The first hits of each document by rank."""
    order = Window.partitionBy("document_id").orderBy("rank")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def next_status(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents after events (id, event): only a failed one is retried, an extracted one stays."""
    joined = documents.join(events, "id", "left")
    event, status = F.col("event"), F.col("status")
    moved = (
        F.when((event == "start") & (status == "PENDING"), "EXTRACTING")
        .when((event == "done") & (status == "EXTRACTING"), "EXTRACTED")
        .when((event == "fail") & status.isin("PENDING", "EXTRACTING"), "FAILED")
        .when((event == "retry") & (status == "FAILED"), "PENDING")
        .otherwise(status)
    )
    return joined.withColumn("status", moved).select(*documents.columns)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


def chunks_of(chunks: DataFrame, document_id: int) -> DataFrame:
    """Chunks of a document in their order."""
    return chunks.where(F.col("document_id") == document_id).orderBy("seq")


def chunk_units(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """What a document is chunked from: its live elements if it has any, else the lines of its text."""
    own = elements.withColumn("source", F.lit("elements"))
    rest = lines.join(elements.select("document_id").distinct(), "document_id", "left_anti")
    return own.unionByName(rest.withColumn("source", F.lit("text")))


def repaired_units(units: DataFrame) -> DataFrame:
    """Units (document_id, place, text, element_type, is_paragraph_start) with structure.

    A document of which any unit has a type or begins a paragraph is left as it is. In others strong
    headings become headings, and these and list items begin paragraphs.
    """
    from docmill.functions.text import is_list_item, is_strong_heading

    whole = Window.partitionBy("document_id")
    marked = F.max((F.col("element_type") != "TEXT_LINE") | F.col("is_paragraph_start")).over(whole)
    strong, listed = is_strong_heading(F.col("text")), is_list_item(F.col("text"))
    held = units.withColumn("marked", marked)
    own = {
        "element_type": F.when(~F.col("marked") & strong, "HEADING").otherwise(F.col("element_type")),
        "is_paragraph_start": F.when(~F.col("marked"), strong | listed).otherwise(F.col("is_paragraph_start")),
    }
    return held.withColumns(own).drop("marked")
