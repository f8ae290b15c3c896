"""Nearest vectors under filters, exactly, from inverted lists with bounds.

Vectors are put on the unit sphere and each goes to the list of its nearest centre, with its distance
to that. A query reads the lists nearest to it first. No vector of a list lies nearer to the query
than the gap between the query's distance to the centre and the distances that the list holds, so
reading stops once no list left can hold anything nearer than the hits found so far. Filters may leave
out what they like: the answer is always that of a scan of everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.operators.search import cosine_similarity

#: Lists of an index unless asked otherwise, and at most: the centres are held by the driver and each task.
LISTS, MOST_LISTS = 64, 4096
#: What rounding may add to a distance between unit vectors.
SLACK = 1e-6
#: Vectors compared with the centres at a time.
ROWS = 1024
#: A search first reads lists with so many rows for each hit that is wanted, and more in each further round.
FIRST_ROWS, GROWTH = 16, 4


@dataclass
class Lists:
    """An index of one model's vectors: rows with ``list`` and ``distance``, centres, and what each list holds."""

    members: DataFrame
    centres: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray


@dataclass
class Reading:
    """What a search read: lists and rows of them, of how many, in how many rounds."""

    lists: int
    rows: int
    all_lists: int
    all_rows: int
    rounds: int


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _usable(embedding: Column, size: int | None = None) -> Column:
    """Vectors that have a direction: no null or non-finite component, not all zero, of the right size."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = finite & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(good if size is None else good & (F.size(embedding) == size), F.lit(False))


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vectors`` with ``list`` (the nearest centre, ties to the smaller number) and ``distance``."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                own = _unit(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                products = own @ centres.T
                place = products.argmax(axis=1)
                distance = np.sqrt(np.maximum(2 - 2 * products[np.arange(len(place)), place], 0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(place.astype(np.int32)), pa.array(distance)], names=[*part.schema.names, "list", "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(nearest, f"{schema}, list int, distance double")


def build_lists(vectors: DataFrame, model: str, path: str, lists: int = LISTS, rows_per_file: int = 200_000) -> Lists:
    """Write an index of one model's vectors (chunk_id, embedding_model, embedding, and what filters need) to ``path``.

    Centres are the vectors whose ids have the smallest hashes, as many as ``lists``. Vectors that are null, zero, hold
    null or non-finite components or differ in size from the first centre take no part. A list of very many vectors is cut
    into files by distance, so no task holds more than its share.
    """
    if not 0 < lists <= MOST_LISTS:
        raise ValueError("LISTS_OUT_OF_RANGE")
    own = vectors.where((F.col("embedding_model") == model) & _usable(F.col("embedding"))).withColumn("embedding", F.col("embedding").cast("array<double>"))
    hashed = F.sha2(F.col("chunk_id").cast("string"), 256)
    chosen = [r["embedding"] for r in own.orderBy(hashed, "chunk_id").limit(lists).select("embedding").collect()]  # as many as there are lists
    size = len(chosen[0]) if chosen else 0
    centres = _unit(np.array([c for c in chosen if len(c) == size], np.float64).reshape(-1, size)) if chosen else np.zeros((0, 0))
    spark = vectors.sparkSession
    placed = assign(own.where(_usable(F.col("embedding"), size)), centres) if chosen else own.limit(0).withColumns({"list": F.lit(0), "distance": F.lit(0.0)})
    placed.repartitionByRange("list", "distance").sortWithinPartitions("list", "distance").write.option("maxRecordsPerFile", rows_per_file).mode("errorifexists").parquet(f"{path}/members")
    held = spark.read.schema(placed.schema).parquet(f"{path}/members").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    known.join(held, "list", "left").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centres")
    return load_lists(spark, path)


def load_lists(spark: SparkSession, path: str) -> Lists:
    """An index that ``build_lists`` wrote."""
    found = spark.read.parquet(f"{path}/centres").orderBy("list").collect()  # a row for each list
    number = lambda c, none: np.array([none if r[c] is None else r[c] for r in found])
    return Lists(spark.read.parquet(f"{path}/members"), np.array([r["centre"] for r in found], np.float64), number("n", 0), number("least", 0.0), number("most", 0.0))


def nearest(index: Lists, query: list[float], k: int, keep: Column | None = None) -> tuple[DataFrame, Reading]:
    """The ``k`` vectors of the index that are most like ``query`` among those that ``keep`` lets through, with ``score``
    (the cosine, 1 at most), best first and then by chunk_id; and what was read for them.

    An empty query, a zero one or one of another size finds nothing, as does an empty index.
    """
    n, spark = len(index.centres), index.members.sparkSession
    asked = np.array(query, np.float64)
    able = n and k > 0 and len(asked) == index.centres.shape[1] and np.isfinite(asked).all() and asked.any()
    columns = [c for c in index.members.columns if c not in ("list", "distance", "embedding", "embedding_model")]
    similarity = F.least(cosine_similarity(F.col("embedding"), F.array(*map(F.lit, asked.tolist())).cast("array<double>")), F.lit(1.0))
    rows = (index.members if keep is None else index.members.where(keep)).select("list", "distance", *columns, similarity.alias("score"))
    schema = rows.drop("list", "distance").schema
    if not able:
        return spark.createDataFrame([], schema), Reading(0, 0, n, int(index.rows.sum()), 0)
    away = np.sqrt(np.maximum(2 - 2 * index.centres @ _unit(asked[None])[0], 0))
    bound = np.maximum(np.maximum(away - index.most, index.least - away), 0)
    order = np.lexsort((away, bound))
    order = order[index.rows[order] > 0]
    hits: list = []
    limit, at, rounds, want, read = np.inf, 0, 0, FIRST_ROWS * k, 0
    while at < len(order) and bound[order[at]] <= limit + SLACK:
        end = at + int(np.searchsorted(np.cumsum(index.rows[order[at:]]), want)) + 1
        now = [i for i in order[at:end] if bound[i] <= limit + SLACK]
        part = rows.where(F.col("list").isin([int(i) for i in now]))
        if np.isfinite(limit):  # a vector's own distance bounds it as the list's does
            part = part.where(F.col("distance").between(float(away[now].min() - limit - SLACK), float(away[now].max() + limit + SLACK)))
        found = part.drop("list", "distance").orderBy(F.desc("score"), "chunk_id").limit(k).collect()  # k rows
        hits = sorted([*hits, *found], key=lambda r: (-r["score"], r["chunk_id"]))[:k]
        if len(hits) == k:
            limit = float(np.sqrt(max(2 - 2 * hits[-1]["score"], 0)))
        read += int(index.rows[now].sum())
        at, rounds, want = at + len(now), rounds + 1, want * GROWTH
    return spark.createDataFrame(hits, schema), Reading(at, read, n, int(index.rows.sum()), rounds)
