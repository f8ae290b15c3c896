"""Cutting the lineage of loops in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and Spark is one process."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        known = context._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the JVM may have gone before Python ends
        pass


#: Unset, a join by more columns than that of the buckets would shuffle both sides.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def checkpointed(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read from there; the table is deleted when the driver ends.

    With ``by`` it lies in buckets of that column, as many as the session's partitions of a shuffle, so that joins and
    windows by it move no rows. What was written in such buckets isn't written again.
    """
    spark = df.sparkSession
    if by and getattr(df, "kept_by", None) == by:
        return df
    name = f"state-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/docmill/{name}"
    atexit.register(_delete, spark, path)
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), name.replace("-", "_")
    before = spark.conf.get(_ALL_KEYS, None)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        df.repartition(buckets, by).write.bucketBy(buckets, by).option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(_ALL_KEYS, before) if before is not None else spark.conf.unset(_ALL_KEYS)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and only ``found`` knows them
    found.kept_by = by
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/docmill/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path
