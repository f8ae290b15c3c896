"""Shared helpers of the training-data operators: shared storage, inputs, Arrow slices."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests on
    one machine) a temporary folder is set.
    """
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = where.get() if where.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="docmill-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the JVM may have gone before Python ends
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/docmill/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as it is written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    options = {"compression": "zstd"} | options
    with tidy_shuffles(df.sparkSession):
        df.write.options(**options).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.kept_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    for df in tables:
        if hasattr(df, "kept_at"):
            _delete(df.sparkSession, df.kept_at)


#: What ``frugal`` calls at the end of a partition, beside giving memory back.
_at_end: list[Callable[[], None]] = []


def at_partition_end(drop: Callable[[], None]) -> Callable[[], None]:
    """Register ``drop``, which empties a cache of a Python worker."""
    _at_end.append(drop)
    return drop


def _give_back(keep: bool) -> None:
    for drop in () if keep else _at_end:
        drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Bytes that a worker keeps at the top of its memory, so that arrays that come and go take the same pages again.
_KEPT = 16 << 20


def _keep_pages() -> None:
    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, _KEPT)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, _KEPT)  # M_TRIM_THRESHOLD


def frugal(work: Callable[[Iterator], Iterator], keep: bool = False) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a partition, after which the worker gives its memory back.

    Spark uses a Python worker for one task after another, of all stages of a session. With ``keep`` its
    caches, which are bounded in bytes, stay for the next partition; the first one of other work drops them.
    """

    def run(batches: Iterator) -> Iterator:
        _keep_pages()
        if not keep:
            for drop in _at_end:
                drop()
        try:
            yield from work(batches)
        finally:
            _give_back(keep)

    return run


#: Rows of a batch that goes to a Python worker; whole texts can be long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Batches for Python are kept short from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null id, before all others.
LEAST_ID = -(1 << 63)


#: Repeated ids that are gathered and broadcast at most.
REPEATED_IDS = 100_000


def with_row_key(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with ``row``, which tells different texts of one id apart.

    It is 0 where the id occurs once, so that it costs nothing in shuffles, else a hash of the text.
    With very many repeated ids it is the hash everywhere. Equal rows have equal keys.
    """
    again = rows.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(REPEATED_IDS + 1).collect()
    own = F.xxhash64("text")
    if not again:
        return rows.withColumn("row", F.lit(0).cast("long"))
    if len(again) > REPEATED_IDS:
        return rows.withColumn("row", own)
    ids = rows.sparkSession.createDataFrame([(r["doc_id"], True) for r in again], "doc_id long, again boolean")
    keyed = rows.join(F.broadcast(ids), "doc_id", "left")
    return keyed.withColumn("row", F.when(F.col("again"), own).otherwise(F.lit(0).cast("long"))).drop("again")


def numbered_twins(rows: DataFrame) -> DataFrame:
    """``rows`` with ``twin``: 0 for the first of the rows that share doc_id and row, more for others."""
    return rows.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("row")) - 1)


#: Bytes of input, as Spark estimates them, for a partition of a shuffle of texts.
PART_BYTES = 64 << 20


def parts_for(df: DataFrame, size: int = PART_BYTES, least: int = 0) -> int:
    """Partitions of ``size`` bytes for a shuffle that moves ``df``, and no fewer than ``least`` or the session's."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return own if held > 1 << 60 else max(least or own, -(-held // size))  # Spark doesn't know the size of an RDD


def id_buckets(docs: DataFrame, buckets: int) -> Column:
    """A column that numbers ranges of the key column ``doc_id``, about evenly; nulls come first.

    The bounds are quantiles of the ids alone, so no text is read for them.
    """
    key = F.coalesce("doc_id", F.lit(LEAST_ID))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = docs.select(F.percentile_approx(key, shares, 100 * buckets)).first()[0]
    bounds = np.unique(np.array(bounds or [], np.int64))[: buckets - 1]

    # numbers of equal ranges: a binary search in a literal array
    edges = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) <= 64 else None
    if edges is not None:
        return F.size(F.filter(edges, lambda b: b < key)).cast("int")

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left"))

    return bucket_of(key)


def deal_by_id(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in partitions that are ascending ranges of doc_id."""
    bucket = id_buckets(docs, parts)
    return docs.withColumn("__bucket", bucket).repartitionById(parts, F.col("__bucket")).drop("__bucket")


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes.astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def utf8_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column without nulls (nulls count as empty)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the finalizer of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random unsigned 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def places(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each of the ranges, one after the other."""
    first = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(first - begin, count)
