"""A table in hash buckets that streams change bucket by bucket, one commit for each batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BucketTable:
    """Rows by a key, in ``buckets`` buckets under ``path``.

    ``data/batch=N/bucket=B`` holds what batch N made of bucket B; ``log/batch=N`` says for every bucket which batch holds
    it, and is written last. A batch that is run again reads only what earlier ones committed, and writes the same.
    """

    spark: SparkSession
    path: str
    schema: str
    key: str = "document_id"
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def holders(self, before: int | None = None) -> dict[int, int]:
        """The batch that holds each bucket, as committed by the last batch (before one); ``buckets`` numbers at most."""
        if not self._exists(f"{self.path}/log"):
            return {}
        log = self.spark.read.schema("bucket int, holder long, batch long").option("basePath", f"{self.path}/log").parquet(f"{self.path}/log")
        log = log if before is None else log.where(F.col("batch") < before)
        last = log.agg(F.max("batch")).first()[0]
        return {} if last is None else {r["bucket"]: r["holder"] for r in log.where(F.col("batch") == last).collect()}

    def rows(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some, as committed (before a batch)."""
        held = {b: n for b, n in self.holders(before).items() if only is None or b in only}
        paths = [p for b, n in held.items() if self._exists(p := f"{self.path}/data/batch={n}/bucket={b}")]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of some keys; ``buckets`` numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def replace(self, number: int, rows: DataFrame, touched: list[int]) -> None:
        """Commit batch ``number``: ``rows`` are all that the touched buckets hold from now on; others aren't read or written."""
        placed = rows.withColumn("bucket", self.bucket()).repartition(max(len(touched), 1), "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        self.commit(number, self.holders(number) | dict.fromkeys(touched, number))

    def commit(self, number: int, holders: dict[int, int]) -> None:
        log = self.spark.createDataFrame(sorted(holders.items()), "bucket int, holder long")
        log.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` commits holds."""
        if not self._exists(f"{self.path}/log"):
            return
        log = self.spark.read.parquet(f"{self.path}/log")
        batches = sorted((r[0] for r in log.select("batch").distinct().collect()), reverse=True)
        held = {tuple(r) for r in log.where(F.col("batch").isin(batches[:keep])).select("holder", "bucket").distinct().collect()}
        for number in {r[0] for r in log.select("holder").distinct().collect()} | set(batches):
            for bucket in range(self.buckets):
                if (number, bucket) not in held:
                    self._delete(f"{self.path}/data/batch={number}/bucket={bucket}")
        for number in batches[keep:]:
            self._delete(f"{self.path}/log/batch={number}")

    def _hadoop(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        where, system = self._hadoop(path)
        return system.exists(where)

    def _delete(self, path: str) -> None:
        where, system = self._hadoop(path)
        system.delete(where, True)
