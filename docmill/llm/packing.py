"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two, the longest first. A piece is a
sequence by itself, so no sequence crosses documents and none is padded. Sequences of equal length
form a bucket: a folder of their files, and a run of consecutive sequence ids, from which batches of
one length are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import SLICE_BYTES, deal_by_id, frugal, parts_for, shared_path, table, text_slices, tidy_shuffles
from docmill.llm.tokens import encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, part int, place bigint"


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as a sum of ``longest`` and then falling powers of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def cut_documents(
    docs: DataFrame,
    tokenizer_path: str,
    longest: int = 2048,
    end_id: int = 1,
    spaced: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids, part, place.

    ``ids`` holds little-endian unsigned 32-bit ids. ``longest`` must be a power of two. A null or
    empty text gives one piece that holds the end id. A null id stays null and comes first; repeated
    rows are packed as often as they come. Other columns are left out, so none can clash. An empty
    table gives none. ``part`` is a range of ids, ``place`` counts its pieces of one length in
    ascending order, so neither depends on how the input was split.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), np.zeros(longest.bit_length(), np.int64)
        for batch in text_slices(batches, limit=SLICE_BYTES // 2):
            ids, offsets = encoder(tokenizer_path, spaced).encode(batch.column("text"), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            row, start, length = [], [], []
            for i, n in enumerate(np.diff(offsets).tolist()):
                at = 0
                for size in binary_lengths(n, longest):
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    at += size
            row_at, starts, lengths = (np.array(x, np.int64) for x in (row, start, length))
            place, power = np.zeros(len(lengths), np.int64), np.log2(lengths).astype(np.int64)
            for p in np.unique(power):
                own = np.flatnonzero(power == p)
                place[own] = held[p] + np.arange(len(own))
                held[p] += len(own)
            ends = np.concatenate([[0], np.cumsum(lengths)]) * 4
            column = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row_at)),
                    pa.array(starts),
                    pa.array(lengths),
                    pa.array(np.diff(offsets)[row_at]),
                    column.cast(pa.binary()),
                    pa.array(np.full(len(row), part), pa.int32()),
                    pa.array(place),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = deal_by_id(chosen, parts_for(chosen)).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(frugal(pieces, keep=True), SCHEMA)


#: Writers that a task holds open; a length's folder needs one, so that pieces aren't sorted for them.
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces in one folder for each length, so a batch reads equal lengths only."""
    conf = pieces.sparkSession.conf
    before = conf.get(_WRITERS, None)
    conf.set(_WRITERS, "64")
    try:
        with tidy_shuffles(pieces.sparkSession):
            pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    finally:
        conf.set(_WRITERS, before) if before is not None else conf.unset(_WRITERS)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """Sequences of all buckets: doc_id, start, length, doc_tokens, ids, bucket, sequence_id, offset.

    Sequence ids run from 0 through the longest bucket, then through the next one, without gaps.
    """
    rows = spark.read.schema(f"{SCHEMA}, bucket bigint").parquet(path)
    parts = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("held"))  # a row for each file
    before = Window.orderBy(F.desc("bucket"), "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("bucket", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    numbered = rows.join(F.broadcast(parts), ["bucket", "part"])
    sequence = (F.col("base") + F.col("place")).alias("sequence_id")
    return numbered.select("doc_id", "start", "length", "doc_tokens", "ids", "bucket", sequence, F.lit(0).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Cut documents (see ``cut_documents``), write the buckets to the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "packing")
    write_buckets(cut_documents(docs, tokenizer_path, **options), path)
    return read_buckets(docs.sparkSession, path)


def digest(packed: DataFrame) -> DataFrame:
    """The columns of the query, derived from the packed ids."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
