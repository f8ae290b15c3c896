"""Uploads as rows: what is refused and why, pending documents with stored names, first texts, and chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.operators import checks
from docmill.sources.files import MAX_BYTES, TYPES, file_name

# How a document is to be read, and what a fake extractor says before a path.
STRATEGIES = ("AUTO", "TEXT_ONLY", "TEXT_WITH_IMAGE_OCR")
FAKE_TEXT, FAKE_METHOD = "fake_extracted_text_for : ", "FAKE"


def judged_uploads(uploads: DataFrame, documents: DataFrame, types: tuple[str, ...], max_bytes: int = MAX_BYTES) -> DataFrame:
    """Uploads (upload_id, project_id, uploaded_by, path, content, strategy, document_type) with what was found out and ``error``.

    The first rule that an upload breaks is its error: INVALID_FILE_TYPE (no usable name, or another type),
    FILE_TOO_LARGE, EXTRACTION_FAILED (nothing in it, or null), INVALID_EXTRACTION_STRATEGY, INVALID_DOCUMENT_TYPE,
    DUPLICATE_DOCUMENT (the project has the content already, in a document or in an upload before that was
    taken). Uploads come in order of upload_id; a null strategy is AUTO.
    """
    name = file_name(F.col("path"))
    found = uploads.withColumns(
        {
            "filename": name,
            "file_type": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)),
            "file_size": F.coalesce(F.octet_length("content"), F.lit(0)),
            "content_hash": F.sha2(F.col("content").cast("binary"), 256),
            "kind": checks.document_type(F.col("document_type"), types),
        }
    )
    found = found.withColumn("way", checks.strategy(F.col("file_type"), F.coalesce("strategy", F.lit("AUTO")), STRATEGIES))
    broken = (
        F.when(F.col("filename").isNull() | ~F.col("file_type").isin(*TYPES), "INVALID_FILE_TYPE")
        .when(F.col("file_size") > max_bytes, "FILE_TOO_LARGE")
        .when(F.col("file_size") == 0, "EXTRACTION_FAILED")
        .when(F.startswith("way", F.lit("INVALID")), F.col("way"))
        .when(F.startswith("kind", F.lit("INVALID_")), F.col("kind"))
    )
    found = found.withColumn("error", broken)
    # one row for each content of a project, made before the join: whoever uploads the same thing over and over
    first = found.where("error IS NULL").groupBy("project_id", "content_hash").agg(F.min("upload_id").alias("__first"))
    known = documents.select("project_id", "content_hash", F.lit(True).alias("__known")).distinct()
    joined = found.join(first.join(known, ["project_id", "content_hash"], "left"), ["project_id", "content_hash"], "left")
    again = F.coalesce(F.col("__known"), F.lit(False)) | (F.col("__first") < F.col("upload_id"))
    return joined.withColumn("error", F.when(F.col("error").isNull() & again, "DUPLICATE_DOCUMENT").otherwise(F.col("error"))).drop("__first", "__known")


def stored_name(upload_id: Column, content_hash: Column, file_type: Column) -> Column:
    """A name of 32 hex digits that nobody can guess from the file's, the same again when a task is tried again."""
    return F.concat(F.substring(F.sha2(F.concat_ws(":", content_hash, upload_id.cast("string")), 256), 1, 32), F.lit("."), file_type)


def pending_documents(judged: DataFrame, folder: str) -> DataFrame:
    """The rows of documents that the uploads without an error become, waiting to be read."""
    path = F.concat(F.lit(folder.rstrip("/") + "/"), stored_name(F.col("upload_id"), F.col("content_hash"), F.col("file_type")))
    return judged.where("error IS NULL").select(
        "upload_id", "project_id", "uploaded_by", "filename", path.alias("storage_path"), "file_type", "file_size", "content_hash", F.col("kind").alias("document_type"),
        F.when(F.col("kind").isNotNull(), "USER").alias("document_type_source"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("processing_error"),
        F.col("way").alias("extraction_strategy"), F.lit("NORMAL").alias("processing_mode"), F.lit("NOT_REQUIRED").alias("review_status"),
    )


def store(uploads: DataFrame, pending: DataFrame, path: str) -> None:
    """Append the contents of pending documents to the table at ``path``: project_id (a folder each), storage_path, content."""
    rows = pending.select("upload_id", "project_id", "storage_path").join(uploads.select("upload_id", "content"), "upload_id")
    rows.drop("upload_id").write.mode("append").partitionBy("project_id").parquet(path)


def fake_extraction(path: Column) -> Column:
    """What a fake extractor reads from a path: content, page_count, char counts and its method."""
    content = F.concat(F.lit(FAKE_TEXT), path)
    n = F.length(content)
    return F.struct(content.alias("content"), F.lit(1).alias("page_count"), n.alias("char_count"), n.alias("text_char_count"), F.lit(0).alias("ocr_char_count"), F.lit(FAKE_METHOD).alias("extract_method"))


def block_lines(blocks: DataFrame) -> DataFrame:
    """Lines of text blocks (block_id, bbox, lines of (bbox, spans)), in their order: block_id, line, content, x, y, x2, y2, source.

    Spans lose the white space around them, empty ones go, the rest is joined by blanks; a line without any goes. A line
    without a box takes its block's, and zeros if that has none either.
    """
    each = blocks.select("block_id", "bbox", F.posexplode("lines").alias("line", "of"))
    spans = F.transform(F.coalesce(F.col("of.spans"), F.array().cast("array<string>")), lambda s: F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)^\s+|\s+$", ""))
    box = F.coalesce(F.col("of.bbox"), F.col("bbox"), F.array(*[F.lit(0.0)] * 4))
    shown = each.select("block_id", "line", F.array_join(F.filter(spans, lambda s: s != ""), " ").alias("content"), box.alias("box")).where("content <> ''")
    return shown.select("block_id", "line", "content", *[F.col("box")[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "x2", "y2"))], F.lit("text").alias("source"))


def chunk_rows(chunks: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """Chunks (document_id, seq, page_number, text, token_count, content_start, content_end, embedding, text_version) as they are stored.

    Each carries its document's project, so that a search filters one table; chunks without a document go.
    """
    owned = chunks.join(documents.select(F.col("id").alias("document_id"), "project_id"), "document_id")
    return owned.select(
        "document_id", "project_id", "seq", "page_number", "text", F.length("text").alias("char_count"), "token_count", "content_start", "content_end", "embedding",
        F.lit(model).alias("embedding_model"), F.size("embedding").alias("embedding_dim"), "text_version",
    )


def stamped(rows: DataFrame, before: DataFrame, key: str, at: Column | None = None) -> DataFrame:
    """``rows`` with created_at and updated_at, by what is stored (``before``, with both times).

    New rows get the time now, or ``at``, in both; changed ones keep when they were made; equal ones keep both.
    """
    at = F.current_timestamp() if at is None else at
    values = [c for c in rows.columns if c != key]
    old = before.select(key, F.struct(*values).alias("__old"), F.col("created_at").alias("__made"), F.col("updated_at").alias("__changed"))
    same = F.struct(*values).eqNullSafe(F.col("__old"))
    return rows.join(old, key, "left").select(*rows.columns, F.coalesce("__made", at).alias("created_at"), F.when(F.col("__made").isNotNull() & same, F.col("__changed")).otherwise(at).alias("updated_at"))

