"""Stages of the pipeline on odd tables, and what each one takes out of a table whose answer is known."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, component string"


def run(spark, docs, upto):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialize(stage(spark, docs, ""), name)
        if name != "packing":
            assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        if name == upto:
            break
    return docs


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 8))) for _ in range(n))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, "x")


def test_empty(spark):
    assert run(spark, spark.createDataFrame([], SCHEMA), "packing").count() == 0


def test_known_answer(spark):
    words = prose(2, 120).split(" ")
    changed = [*words]
    changed[60] = "zzzzz"  # 5 of 116 shingles differ
    rows = [row(i, f"{prose(100 + i, 40)}\n{prose(200 + i, 30)}") for i in range(30)]
    rows += [row(50, "\n".join([prose(7, 30), prose(8, 30)])), row(51, "\n".join([prose(7, 30), prose(9, 30)]))]  # a line twice
    rows += [row(60, " ".join(words)), row(61, f"{' '.join(changed[:30])}\n{' '.join(changed[30:])}")]  # near copies in other lines
    rows += [row(70, prose(70, 50)), row(71, prose(70, 50)), row(72, "  123 456 !!"), row(73, None), row(74, "")]
    rows += [row(None, prose(80, 50), None, None), row(None, None, None, None), row(90, "q" * 300_000, "en"), row(91, prose(91, 40)), row(91, prose(91, 40))]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
    kept = [*range(30), 50, 51, 60, 61, 70, 71, 90, 91, 91, None]
    language = run(spark, docs, "language")
    assert [i for i in ids(language) if i != 90] == [i for i in kept if i != 90]
    lines = run(spark, docs, "lines")
    found = {r.doc_id: r.text for r in lines.where("doc_id IS NOT NULL").collect()}
    assert 71 not in found and found[51] == prose(9, 30) and found[50] == f"{prose(7, 30)}\n{prose(8, 30)}"
    assert all(r.n_chars == len(r.text) for r in lines.collect()) and ids(lines).count(91) == 1
    near = run(spark, docs, "near")
    assert 60 in ids(near) and 61 not in ids(near) and set(range(30)) | {None, 50, 51, 70} <= set(ids(near))
    packed = run(spark, docs, "packing")
    assert packed.where("length & (length - 1) <> 0 OR offset <> 0 OR length > 2048").count() == 0
    whole = packed.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n"))  # each copy of a document is whole
    assert whole.where("n % doc_tokens <> 0").count() == 0 and whole.count() > 10
