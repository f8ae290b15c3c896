"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components of a vector are its terms. Queries are dealt to groups, candidates to parts, and every
group meets every part in a partition of its own: the group's queries come first and stay, as postings
of strips, then the candidates stream by, as postings of blocks, ascending by id. The weights that a
strip and a block have for a term are multiplied into a dense table of scores, one term after the
other; what is above a query's least score so far is merged into its best. A window merges the parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.llm.common import frugal, table

#: Queries of a strip and candidates of a block.
STRIP_ROWS, BLOCK_ROWS = 64, 1024
#: Components and places of results that a group of queries holds in a worker, about.
GROUP_CELLS = 1 << 20
#: Candidates of a part at least, while there are partitions without one, and pairs of a partition, about.
PART_ROWS, PART_PAIRS = 4096, 1 << 25
#: Copies of queries that a task makes, about.
COPIES = 1 << 16


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and floor(scale * x) of each component; vectors with nulls or non-finite values go."""
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(finite)
    return rows.select("id", F.transform("x", lambda v: F.floor(v * F.lit(scale))).alias("x"))


class Postings(NamedTuple):
    """Rows and weights by term, from ``begins`` on, without weights of zero."""

    ids: np.ndarray
    terms: np.ndarray
    begins: np.ndarray
    rows: np.ndarray
    weights: np.ndarray

    def largest(self) -> int:
        return max(int(self.weights.max()), -int(self.weights.min())) if len(self.weights) else 0

    def of(self, at: int, kind: type) -> tuple[np.ndarray | slice, np.ndarray]:
        """Rows and weights of a term; one that a quarter of the rows has gives all rows, with zeros."""
        part = slice(self.begins[at], self.begins[at + 1])
        rows, weights = self.rows[part], self.weights[part].astype(kind)
        if 4 * len(rows) < len(self.ids):
            return rows, weights
        dense = np.zeros(len(self.ids), kind)
        dense[rows] = weights
        return slice(None), dense


def _postings(batch: pa.RecordBatch) -> Postings:
    lists = batch.column("x")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    weights = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(weights)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    full = np.flatnonzero(weights)
    full = full[np.argsort(terms[full], kind="stable")]
    found, begins = np.unique(terms[full], return_index=True)
    return Postings(batch.column("id").to_numpy(zero_copy_only=False), found, np.append(begins, len(full)), rows[full], weights[full])


def _scores(strip: Postings, block: Postings, columns: list, kind: type) -> np.ndarray:
    """Inner products of a strip's rows and a block's; ``columns``: the block's rows and weights by term."""
    scores = np.zeros((len(strip.ids), len(block.ids)), kind)
    _, own, other = np.intersect1d(strip.terms, block.terms, assume_unique=True, return_indices=True)
    for i, j in zip(own.tolist(), other.tolist()):
        (rows, weights), (places, others) = strip.of(i, kind), columns[j]
        if not isinstance(rows, slice) and not isinstance(places, slice):
            rows = rows[:, None]
        scores[rows, places] += np.multiply.outer(weights, others)
    return scores


class Best(NamedTuple):
    """A strip's best so far, by row and then from the highest score on, and each row's least if it has k."""

    rows: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    least: np.ndarray


def _nothing(rows: int) -> Best:
    return Best(*(np.zeros(0, np.int64) for _ in range(3)), np.full(rows, np.iinfo(np.int64).min))


def _merged(best: Best, scores: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """``best`` with what is higher in a block whose ids are no smaller than those before: ties don't matter any more."""
    held, (count, width) = np.iinfo(scores.dtype), scores.shape
    over = scores > np.clip(best.least, held.min, held.max).astype(scores.dtype)[:, None]
    if width > k and np.count_nonzero(over) > 4 * k * count:
        over &= scores >= np.partition(scores, width - k, axis=1)[:, [width - k]]
    rows, places = np.nonzero(over)
    if not len(rows):
        return best
    found = [best.rows, rows], [best.ids, ids[places]], [best.scores, scores[rows, places].astype(np.int64)]
    rows, ids, scores = map(np.concatenate, found)
    order = np.lexsort((ids, -scores, rows))
    begins = np.searchsorted(rows[order], np.arange(count))
    order = order[np.arange(len(order)) - begins[rows[order]] < k]
    rows, ids, scores = rows[order], ids[order], scores[order]
    ends, least = np.searchsorted(rows, np.arange(count), side="right"), best.least.copy()
    whole = np.bincount(rows, minlength=count) == k
    least[whole] = scores[ends[whole] - 1]
    return Best(rows, ids, scores, least)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Slices of one slot that hold queries alone or candidates alone."""
    for batch in batches:
        slots, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "asks"))
        cuts = np.flatnonzero((np.diff(slots) != 0) | (asks[1:] != asks[:-1])) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            rows = STRIP_ROWS if asks[begin] else BLOCK_ROWS
            for at in range(begin, end, rows):
                yield int(slots[at]), bool(asks[at]), batch.slice(at, min(rows, end - at))


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, strips, best, most = None, [], [], 0

        def told() -> pa.RecordBatch:
            asked = [s.ids[b.rows] for s, b in zip(strips, best)]
            cells = [np.concatenate(x) for x in (asked, [b.ids for b in best], [b.scores for b in best])]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["query_id", "vec_id", "score"])

        for at, asks, part in _runs(batches):
            if at != slot:
                if strips:
                    yield told()
                slot, strips, best, most = at, [], [], 0
            block = _postings(part)
            if asks:
                strips.append(block)
                best.append(_nothing(len(block.ids)))
                most = max(most, block.largest())
                continue
            kind = np.int32 if most * block.largest() * len(block.terms) < np.iinfo(np.int32).max else np.int64
            columns = [block.of(i, kind) for i in range(len(block.terms))]
            for i, strip in enumerate(strips):
                scores = _scores(strip, block, columns, kind)
                begins, ends = (np.searchsorted(block.ids, strip.ids, side=s) for s in ("left", "right"))
                for own in np.flatnonzero(ends > begins).tolist():
                    scores[own, begins[own] : ends[own]] = np.iinfo(kind).min
                best[i] = _merged(best[i], scores, block.ids, k)
        if strips:
            yield told()

    return search


def _grid(candidates: int, queries: int, cells: int, k: int, slots: int) -> tuple[int, int]:
    """Groups of queries, which workers can hold, and parts of candidates.

    There are as many parts as give a partition ``PART_PAIRS``, but copies of queries, one for each
    part, stay about as few as those of candidates, one for each group.
    """
    groups = max(1, -(-(cells + 2 * k * queries) // GROUP_CELLS))
    least = min(slots, -(-candidates // PART_ROWS))
    wanted = min(-(-candidates * queries // (PART_PAIRS * groups)), -(-groups * candidates // max(1, queries)))
    return groups, max(1, least, wanted)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query.

    Candidates are all rows of ``vectors`` but those with the query's id; ties go to the smaller id.
    Rows with a null id or vector, or with null or non-finite components, take no part. A repeated
    candidate row counts each time, a repeated query id is asked once with its least vector. Vectors
    of different lengths are compared on the components they share. Empty tables give no rows.
    Both tables are counted first, to deal them.
    """
    slots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = queries.agg(F.count(F.lit(1)), F.sum(F.greatest(F.size(vector_col), F.lit(0)).cast("long"))).first()
    groups, parts = _grid(vectors.count(), held[0], held[1] or 0, k, slots)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slot = (F.col("group") * parts + F.col("part")).cast("int").alias("slot")
    asked = integer_vectors(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("x").alias("x"))
    asked = asked.repartition(max(1, -(-held[0] * parts // COPIES)), F.xxhash64("id"))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn("part", every(parts))
    rows = integer_vectors(vectors, id_col, vector_col, scale)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.lit(parts))).withColumn("group", every(groups))
    pairs = asked.select(slot, F.lit(True).alias("asks"), "id", "x").union(rows.select(slot, F.lit(False).alias("asks"), "id", "x"))
    pairs = pairs.repartitionById(groups * parts, F.col("slot")).sortWithinPartitions("slot", F.desc("asks"), "id")
    found = pairs.mapInArrow(frugal(_search(k)), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
