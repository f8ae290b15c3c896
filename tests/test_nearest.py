"""Nearest vectors from lists against a scan of everything."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from docmill.operators import nearest, search

SCHEMA = "chunk_id long, document_id long, project_id int, embedding_model string, embedding array<double>"


def clustered(n=3000, size=12, seed=5):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(size)] for _ in range(20)]
    rows = []
    for i in range(n):
        middle = middles[0 if i % 3 == 0 else r.randrange(20)]  # one cluster holds more than a third
        rows.append((i, i % 40, i % 5, "base" if i % 7 else "alt", [x + r.gauss(0, 0.1) for x in middle]))
    rows += [(n + i, 1, 1, "base", list(rows[1][4])) for i in range(30)]  # ties
    return rows


@pytest.fixture(scope="module")
def built(spark):
    rows = clustered()
    odd = [(9001, 1, 1, "base", None), (9002, 1, 1, "base", []), (9003, 1, 1, "base", [0.0] * 12), (9004, 1, 1, "base", [1.0] * 11 + [None]), (9005, 1, 1, "base", [float("nan")] * 12), (9006, 1, 1, None, [1.0] * 12)]
    vectors = spark.createDataFrame(rows + odd, SCHEMA)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/lists"
    return rows, vectors.where("chunk_id < 9000"), nearest.build_lists(vectors, "base", path, 32), path


def test_equal_to_a_scan(spark, built):
    rows, plain, index, path = built
    assert sum(index.rows) == sum(r[3] == "base" for r in rows)
    less = False
    for place, k, projects, document in [(1, 10, [0, 1, 2, 3, 4], None), (2, 40, [3], None), (5, 500, [1, 2], None), (8, 3, [2], 17), (11, 5, [], None), (20, 5000, [0, 1], None)]:
        query = [x + 0.01 for x in rows[place][4]]
        keep = F.col("project_id").isin(*projects)
        found, reading = nearest.nearest(nearest.load_lists(spark, path), query, k, keep if document is None else keep & (F.col("document_id") == document))
        wanted = search.vector_topk(plain, query, "base", projects, k, document_id=document)
        assert [r.chunk_id for r in found.collect()] == [r.chunk_id for r in wanted.collect()], (place, k)
        less |= reading.lists < reading.all_lists / 2
        assert reading.rows <= reading.all_rows and reading.lists <= 32
    assert less


def test_far_query_and_no_answer(spark, built):
    rows, plain, index, _ = built
    query = [-x for x in rows[3][4]]
    found, _ = nearest.nearest(index, query, 7)
    assert [r.chunk_id for r in found.collect()] == [r.chunk_id for r in search.vector_topk(plain, query, "base", [0, 1, 2, 3, 4], 7).collect()]
    for nothing in ([], [0.0] * 12, [1.0] * 3, [float("inf")] * 12):
        assert nearest.nearest(index, nothing, 7)[0].count() == 0
    assert nearest.nearest(index, rows[3][4], 0)[0].count() == 0


def test_empty_index(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/lists"
    index = nearest.build_lists(spark.createDataFrame([], SCHEMA), "base", path)
    found, reading = nearest.nearest(index, [1.0, 2.0], 3)
    assert found.count() == 0 and reading.all_lists == 0
    with pytest.raises(ValueError):
        nearest.build_lists(spark.createDataFrame([], SCHEMA), "base", path, 0)
