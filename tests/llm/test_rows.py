"""Rows that share an id, or have none, in operators that take out what repeats."""

import collections
import random

import pytest

from docmill.llm import lines, repeats

SCHEMA = "doc_id long, text string"


def passage(seed, words=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(words))


def rows():
    a, b, c, d, e = map(passage, range(5))
    given = [(1, a), (1, a), (2, a), (None, b), (None, c), (None, f"{d}\n{b}"), (None, c), (3, e), (3, f"{passage(9)}\n{d}"), (4, e), (5, None), (5, None)]
    # of equal rows one keeps its text, a null id's row loses only what it repeats itself
    kept = {1: [a, ""], 2: [""], None: [b, c, "", d], 3: [e, passage(9)], 4: [""]}
    return given, kept


def test_repeats_keep_rows_apart(spark):
    given, kept = rows()
    found = collections.defaultdict(list)
    for r in repeats.remove_repeats(spark.createDataFrame(given, SCHEMA)).collect():
        found[r.doc_id].append(bytes(r.kept).decode().strip("\n"))
    assert {k: sorted(found[k]) for k in kept} == {k: sorted(v) for k, v in kept.items()}


@pytest.mark.parametrize("count", [1, 3])
def test_lines_keep_rows_apart(spark, count):
    given, kept = rows()
    found = collections.defaultdict(list)
    docs = spark.createDataFrame(given, SCHEMA).repartition(count)
    for r in lines.deduplicate_lines(docs).collect():
        found[r.doc_id].append(r.text)
    assert {k: sorted(found[k]) for k in kept} == {k: sorted(v) for k, v in kept.items()}
    assert found[5] == [None, None]
