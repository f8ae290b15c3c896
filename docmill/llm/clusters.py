"""Lloyd's clustering by two trees: a cover tree over each block of vectors and one over the centroids of a round.

A pair of nodes is dropped where its least possible distance exceeds what some other centroid guarantees for the
whole node of vectors; a node with one centroid left is assigned at once, by the sums that its tree holds.
Leaves that keep several centroids are compared exactly, in integers, ties to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import discard, frugal, materialize, places, table

#: Vectors of a tree, and of a leaf at most.
BLOCK_ROWS, LEAF_ROWS = 1024, 16
#: A child's radius is the node's, divided by this.
SHRINK = 1.3
#: Components stay below this, so that squared distances of up to 1024 of them are exact in 64 bits.
LARGEST = 1 << 26
#: Room for the rounding of square roots in bounds.
SLACK = 1e-9
BLOCK_SCHEMA = "ids array<bigint>, dims int, points binary, begin binary, end binary, child binary, children binary, radius binary"


@dataclass
class Tree:
    """Points in tree order. A node's points are ``begin`` to ``end``, its centre is the first of them."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def cover_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
    """A cover tree of the rows of ``x`` (int64), and the order in which it holds them.

    A node's points lie within its radius of its centre. Its children's centres are more than their common
    covering radius apart, and each point goes to the first child that covers it. A node ends with ``leaf`` points
    or where all its points are equal.
    """
    order = np.arange(len(x))
    begin, end, child, children, radius = [0], [len(x)], [], [], []
    at = 0
    while at < len(begin):
        a, b = begin[at], end[at]
        members = order[a:b]
        far = squared(x[members], x[members[:1]])
        radius.append(float(np.sqrt(far.max(initial=0))) * (1 + SLACK))
        child.append(len(begin))
        if len(members) <= leaf or leaf > 1 and far.max() == 0:
            children.append(0)
        else:
            cover, groups = far.max() / SHRINK**2, []
            while len(members):
                near = far <= cover if far.max() else np.arange(len(members)) == 0  # equal points part one by one
                groups.append(members[near])
                members = members[~near]
                if len(members):
                    far = squared(x[members], x[members[:1]])
            order[a:b] = np.concatenate(groups)
            ends = a + np.cumsum([len(g) for g in groups])
            begin += [a, *ends[:-1].tolist()]
            end += ends.tolist()
            children.append(len(groups))
        at += 1
    ints = [np.array(v, np.int32) for v in (begin, end, child, children)]
    return Tree(x[order], *ints, np.array(radius)), order


def nearest(tree: Tree, centres: Tree, numbers: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
    """For each point the number of its nearest centroid; runs (begin, end, number) settled as whole nodes; pairs compared.

    ``centres`` is a tree of single centroids, ``numbers`` their numbers in its order.
    """
    found, runs, compared = np.full(len(tree.points), -1), [], 0
    nodes, cents = np.zeros(1, np.int64), np.zeros(1, np.int64)
    if not len(tree.points):
        return found, runs, compared
    while len(nodes):
        compared += len(nodes)
        far = np.sqrt(squared(tree.points[tree.begin[nodes]], centres.points[centres.begin[cents]]))
        wide, c_wide = tree.radius[nodes], centres.radius[cents]
        best = np.full(len(tree.begin), np.inf)
        np.minimum.at(best, nodes, far + wide)
        keep = (far - wide - c_wide) * (1 - SLACK) <= best[nodes] * (1 + SLACK) + SLACK
        nodes, cents = nodes[keep], cents[keep]
        # all pairs of a node move on together
        inner = centres.children[cents] > 0
        open_c = np.zeros(len(tree.begin), bool)
        open_c[nodes[inner]] = True
        rest = np.bincount(nodes, minlength=len(tree.begin))
        done = (rest[nodes] == 1) & ~inner
        for node, cent in zip(nodes[done].tolist(), cents[done].tolist()):
            runs.append((int(tree.begin[node]), int(tree.end[node]), int(numbers[centres.begin[cent]])))
            found[runs[-1][0] : runs[-1][1]] = runs[-1][2]
        nodes, cents, inner = nodes[~done], cents[~done], inner[~done]
        widest = np.zeros(len(tree.begin))
        np.maximum.at(widest, nodes, centres.radius[cents])
        leaf = tree.children[nodes] == 0
        by_c = open_c[nodes] & (leaf | (widest[nodes] >= tree.radius[nodes]))
        exact = leaf & ~open_c[nodes]
        if exact.any():
            size = (tree.end - tree.begin)[nodes[exact]]
            place, cent = places(tree.begin[nodes[exact]], size), np.repeat(centres.begin[cents[exact]], size)
            compared += len(place)
            gap = squared(tree.points[place], centres.points[cent])
            order = np.lexsort((numbers[cent], gap, place))
            place, cent = place[order], cent[order]
            first = np.r_[True, place[1:] != place[:-1]]
            found[place[first]] = numbers[cent[first]]
        split_c, stay = by_c & inner, by_c & ~inner
        split_x = ~by_c & ~exact
        n_c, n_x = centres.children[cents[split_c]], tree.children[nodes[split_x]]
        nodes, cents = (
            np.concatenate([nodes[stay], np.repeat(nodes[split_c], n_c), places(tree.child[nodes[split_x]], n_x)]),
            np.concatenate([cents[stay], places(centres.child[cents[split_c]], n_c), np.repeat(cents[split_x], n_x)]),
        )
    return found, runs, compared


def sums_of(tree: Tree, found: np.ndarray, runs: list[tuple[int, int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and componentwise sums of each centroid; whole nodes add what the running sums hold."""
    sums, count, alone = np.zeros((k, tree.points.shape[1]), np.int64), np.bincount(found, minlength=k), np.ones(len(found), bool)
    held = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, axis=0)])
    for a, b, number in runs:
        sums[number] += held[b] - held[a]
        alone[a:b] = False
    np.add.at(sums, found[alone], tree.points[alone])
    return count, sums


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """id and floor(scale * x) of each component of the vectors with ``dims`` finite components."""
    finite = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(F.size("x") == dims).where(finite).select("id", F.transform("x", lambda v: F.floor(v * F.lit(scale))).alias("x"))


def _plant(dims: int):
    def block(ids: list[int | None], rows: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(rows).reshape(-1, dims)
        if np.abs(x).max(initial=0) >= LARGEST:
            raise ValueError(f"a component is {LARGEST} or more, so squared distances could exceed 64 bits")
        tree, order = cover_tree(x)
        cells = [tree.points.astype("<i4"), *(v.astype("<i4") for v in (tree.begin, tree.end, tree.child, tree.children)), tree.radius.astype("<f8")]
        columns = [pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([dims], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS // 4):
                part = batch.slice(at, BLOCK_ROWS // 4)
                ids += part.column("id").to_pylist()
                rows.append(part.column("x").flatten().to_numpy(zero_copy_only=False))
                if len(ids) >= BLOCK_ROWS:
                    yield block(ids, rows)
                    ids, rows = [], []
        if ids:
            yield block(ids, rows)

    return plant


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], Tree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            cell = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)
            points = cell("points", "<i4").astype(np.int64).reshape(-1, batch.column("dims")[r].as_py())
            yield batch.column("ids")[r].as_py(), Tree(points, *(cell(c, "<i4") for c in ("begin", "end", "child", "children")), cell("radius", "<f8"))


def _sum_up(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, order = cover_tree(centroids, 1)
        count, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for _, tree in _trees(batches):
            found, runs, _ = nearest(tree, centres, order)
            more = sums_of(tree, found, runs, len(centroids))
            count, sums = count + more[0], sums + more[1]
        if count.any():
            full = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(count[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return work


def _assign(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, order = cover_tree(centroids, 1)
        for ids, tree in _trees(batches):
            found, _, _ = nearest(tree, centres, order)
            gap = squared(tree.points, centroids[found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int32()), pa.array(gap)], names=["vec_id", "cluster", "distance"])

    return work


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose sha256 of ``seed:id`` is least, ascending; of rows that share the id the least vector, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return np.array([r["x"] for r in kept.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()], np.int64)


RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of each kept vector.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; each repeated row counts, and so
    do rows with a null id. Fewer than ``k`` vectors give as many centroids, equal centroids stay apart by
    their numbers, an empty table gives no rows; columns beside the two are left out. A scaled component of 2 ** 26 or
    more raises an error, as distances may not fit. The driver holds ``k`` centroids and their sums, nothing
    that grows with the table; trees are planted once, in the shared folder.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dims, scale)
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    blocks = materialize(kept.mapInArrow(frugal(_plant(dims)), BLOCK_SCHEMA), "cover-trees")
    for _ in range(rounds):
        parts = blocks.mapInArrow(frugal(_sum_up(centroids)), "cluster int, n bigint, sums array<bigint>")
        cells = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        for r in cells.groupBy("cluster", "at").agg(exact("n"), exact("part")).collect():  # k * dims rows
            centroids[r["cluster"], r["at"]] = int(r["part"]) // int(r["n"])
    assigned = materialize(blocks.mapInArrow(frugal(_assign(centroids)), "vec_id bigint, cluster int, distance bigint"), "clusters")
    discard(blocks)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    about = [(c, s, sum(sums.values()), digest(centroids[c])) for c, s in sums.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(*[x.split()[0] for x in RESULT.split(", ")])  # k rows are broadcast


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


_NEAREST = """
a{i} AS MATERIALIZED (
  SELECT vec_id, x, (arg_min(struct_pack(c := c, d := d), (d::HUGEINT) * 1000 + c)).c AS c, min(d) AS d
  FROM (SELECT v.row, v.vec_id, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, m{i} m)
  GROUP BY row, vec_id, x
)"""
_MOVED = """
s{j} AS MATERIALIZED (
  SELECT c, spot, sum(x[spot])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, 65) r(spot) GROUP BY c, spot
),
m{j} AS MATERIALIZED (
  SELECT m.c, coalesce(new.x, m.x) AS x FROM m{i} m
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY spot) AS x FROM s{j} GROUP BY c) new USING (c)
)"""

OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
m0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1)::INT AS c, x FROM v ORDER BY sha256('1:' || vec_id), x LIMIT 16
),
{",".join(_NEAREST.format(i=i) + "," + _MOVED.format(i=i, j=i + 1) for i in range(3))},
{_NEAREST.format(i=3)}
SELECT a.vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a3 a JOIN m3 m USING (c)
"""
