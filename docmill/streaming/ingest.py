"""Incremental ingest: documents that arrive become chunks, once for each text version and model.

A batch reads and rewrites only the buckets of documents that are due. Completed reviews write a feed of changed
texts, from which a second stream rebuilds their chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.text import running_offset
from docmill.operators.chunking import chunk_documents
from docmill.operators.documents import freshness
from docmill.operators.lifecycle import complete_review
from docmill.streaming.buckets import BucketTable

DOCUMENT = "document_id long, content string, text_version int"
CHUNK = "document_id long, seq long, text string, token_count int, page_number int, content_start long, content_end long, heading string, text_version int, embedding_model string"


def lines(documents: DataFrame) -> DataFrame:
    """Lines of documents (document_id, content) with their offsets; those of Unicode white space alone go."""
    parts = documents.select("document_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    placed = parts.withColumn("content_start", running_offset("document_id", "line_no", "line"))
    return placed.where(F.col("line").rlike(r"[^\s\p{Z}\x{85}\x1c-\x1f]")).withColumn("content_end", F.col("content_start") + F.length("line"))


def newest(arrived: DataFrame) -> DataFrame:
    """The last text version of each document that arrived."""
    last = arrived.groupBy("document_id").agg(F.max_by(F.struct("content", "text_version"), "text_version").alias("d"))
    return last.select("document_id", "d.content", "d.text_version")


def due(current: DataFrame, arrived: DataFrame, model: str) -> DataFrame:
    """Documents whose chunks are missing or older than their text; a blank one only if it has chunks to lose."""
    blank = ~F.col("content").rlike(r"[^\s\p{Z}\x{85}\x1c-\x1f]") | F.col("content").isNull()
    last = newest(arrived)
    stale = freshness(current, last, model).where("NOT is_fresh").select("document_id")
    held = current.select("document_id").distinct().withColumn("held", F.lit(True))
    late = current.groupBy("document_id").agg(F.max("text_version").alias("known"))
    found = last.join(stale, "document_id", "left_semi").join(held, "document_id", "left").join(late, "document_id", "left")
    return found.where(~blank | F.col("held")).where(F.coalesce("known", F.lit(-1)) <= F.col("text_version")).select(*last.columns)


def made(documents: DataFrame, model: str) -> DataFrame:
    """Chunks of documents, with the text version and the model they are made for."""
    chunks = chunk_documents(lines(documents)).join(documents.select("document_id", "text_version"), "document_id")
    names = [c.split()[0] for c in CHUNK.split(", ")]
    return chunks.withColumn("embedding_model", F.lit(model)).select(*names)


def chunk_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    return BucketTable(spark, path, CHUNK, buckets=buckets)


def ingest_batch(table: BucketTable, arrived: DataFrame, number: int, model: str) -> None:
    """One batch of documents. Late or repeated ones change nothing, and a batch that is run again does the same."""
    arrived = newest(arrived)
    current = table.rows(number, table.touched(arrived))
    changed = due(current, arrived, model)
    touched = table.touched(changed)
    if not touched:
        return
    kept = table.rows(number, touched).join(changed.select("document_id"), "document_id", "left_anti")
    table.replace(number, kept.unionByName(made(changed, model)), touched)
    table.vacuum()


def run(spark: SparkSession, source: str, chunks: str, checkpoint: str, model: str = "hash", buckets: int = 64, **trigger):
    """A streaming query from a folder of Parquet documents (``DOCUMENT``) to a chunk table."""
    table = chunk_table(spark, chunks, buckets)
    # every folder level below the source is read, so a feed of batches can be the source
    stream = spark.readStream.schema(DOCUMENT).option("recursiveFileLookup", "true").parquet(source)
    work = stream.writeStream.foreachBatch(lambda arrived, number: ingest_batch(table, arrived, number, model))
    return work.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def complete_batch(elements: BucketTable, contents: BucketTable, requests: DataFrame, number: int, feed: str) -> None:
    """Complete the reviews of the requested documents, and put their texts into the feed; the same again if it is run again."""
    asked = requests.select("document_id").distinct()
    touched = elements.touched(asked)
    rows, texts = elements.rows(number, touched), contents.rows(number, touched)
    done, after = complete_review(rows.join(asked, "document_id", "left_semi"), texts.join(asked, "document_id", "left_semi"))
    after.select("document_id", "content", F.col("text_version").cast("int").alias("text_version")).write.mode("overwrite").parquet(f"{feed}/batch={number}")
    elements.replace(number, rows.join(asked, "document_id", "left_anti").unionByName(done.select(*rows.columns)), touched)
    contents.replace(number, texts.join(asked, "document_id", "left_anti").unionByName(after.select(*texts.columns)), touched)


def run_reviews(elements: BucketTable, contents: BucketTable, source: str, feed: str, checkpoint: str, **trigger):
    """A streaming query from a folder of requests (document_id) to the feed of completed texts.

    ``run`` over the feed rebuilds the chunks of each changed text once; a review that changes nothing rebuilds nothing.
    """
    stream = elements.spark.readStream.schema("document_id long").parquet(source)
    work = stream.writeStream.foreachBatch(lambda requests, number: complete_batch(elements, contents, requests, number, feed))
    return work.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
