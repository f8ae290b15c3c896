"""Pairs that the parts of the hash range rule out, and later places of lines."""

import numpy as np
from pyspark.sql import functions as F

from docmill.llm import lines

BASE = "".join(chr(97 + (i * i + i // 3) % 26) for i in range(400))


def test_no_link_is_ruled_out_by_the_parts_of_the_hash_range():
    texts = [BASE[:n] + other for n in (10, 60, 200, 390) for other in ("", "x", "quite another end", BASE[::-1][:n])]
    owner, shingle = lines.Shingles(texts).sets(54)
    sets = [set(shingle[owner == i].tolist()) for i in range(len(texts))]
    bits = lines._occupied(owner, shingle, len(texts)).view(np.uint64)
    out = 0
    for i, u in enumerate(sets):
        for j, v in enumerate(sets):
            lacks = [int(np.bitwise_count(x & ~y).sum()) for x, y in ((bits[i], bits[j]), (bits[j], bits[i]))]
            most = min(len(u) - lacks[0], len(v) - lacks[1])
            assert len(u & v) <= most
            out += 180 * most < 80 * (len(u) + len(v))
    assert out > len(texts)


def test_later_places_of_equal_and_linked_lines(spark):
    near = BASE[:300] + "z"
    rows = [(3, BASE[:300]), (1, f"once\n{near}"), (2, f"{near}\ntwice\ntwice"), (4, "alone"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("row", F.lit(0).cast("long"))
    found = lines.repeated_lines(docs).select("doc_id", "line").distinct().collect()
    assert sorted(map(tuple, found)) == [(2, 0), (2, 2), (3, 0), (5, 0)]
