"""Token ids in Parquet: list columns, dictionary and delta encoding, row groups and page indexes.

Rows are written in ascending order of their id. A file's row groups are small and its pages hold
few rows, and readers find the pages of an id range by the page index, so a run of documents or the
metadata columns alone can be read without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import SLICE_BYTES, deal_by_id, frugal, parts_for, shared_path, table, text_slices, tidy_shuffles
from docmill.llm.tokens import encoder

SCHEMA = "doc_id bigint, part int, start_in_part bigint, n_tokens bigint, token_ids array<int>"

#: Ids repeat, so they go by dictionary; the metadata columns rise slowly, so they go by delta.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}


def encode_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    spaced: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Token ids in ascending order of the id, nulls first: one row per document.

    Texts are dealt by ranges of the id before they are encoded, as they are smaller than their ids.
    A null or empty text gives the end id alone. Repeated rows stay. Other columns are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, limit=SLICE_BYTES // 2):
            ids, offsets = encoder(tokenizer_path, spaced).encode(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, part), pa.int32()),
                    pa.array(offsets[:-1] + before),
                    pa.array(np.diff(offsets)),
                    lists,
                ],
                names=["doc_id", "part", "start_in_part", "n_tokens", "token_ids"],
            )
            before += int(offsets[-1])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = parts_for(chosen)
    ordered = deal_by_id(chosen, n).sortWithinPartitions("doc_id")
    return ordered.mapInArrow(frugal(encode, keep=True), SCHEMA)


def write_tokens(encoded: DataFrame, path: str) -> None:
    """Write one file for each range, so files and rows ascend by id."""
    with tidy_shuffles(encoded.sparkSession):
        encoded.write.options(**WRITE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, token_ids.

    ``start`` adds what earlier files hold, one number for each file, to the place in the file.
    """
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(parts), "part").select(  # a row for each file
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "token_ids"
    )


def digest(tokens: DataFrame) -> DataFrame:
    """crc32 of each list of ids, taken as little-endian unsigned 32-bit values."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("token_ids")
            data = memoryview(pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype("<i4").tobytes())
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    return tokens.mapInArrow(frugal(crc), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_tokens(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    return digest(read_tokens(spark, path))
