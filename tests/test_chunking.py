"""Chunks, context, embeddings and the stream: invariants of what comes out."""

import random
import unicodedata

import numpy as np
import plain_chunks
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from docmill.functions import embedding, text
from docmill.operators import chunking
from docmill.plans.views import Views


def test_chunks_keep_the_rules(spark):
    views = Views(spark, DATA)
    chunks = chunking.chunk_documents(views.units).toPandas()
    contents = {r.document_id: r.content for r in views.texts.collect()}
    for document, own in chunks.groupby("document_id"):
        assert sorted(own["seq"]) == list(range(len(own)))
        # parts are counted one by one, so what joins them comes on top
        assert (own["token_count"] - own["text"].str.count(r"\s") / 1.89 <= chunking.MAX_TOKENS + 5).all()
        for row in own.itertuples():
            if row.content_start == row.content_start:
                first = contents[document][int(row.content_start) : int(row.content_end)].split("\n")[0]
                assert first.strip() in row.text
    # no word is lost
    held = chunks.groupby("document_id")["text"].agg(" ".join)
    for document, content in contents.items():
        assert set(content.split()) <= set(held[document].split())


def test_headings_repeat_in_later_chunks(spark):
    rows = [(1, 0, "1. Scope"), *[(1, i, f"Line {i} " + "word " * 40 + "ends.") for i in range(1, 20)], (1, 20, "2. Terms"), (1, 21, "x" * 3000)]
    units = spark.createDataFrame(rows, "document_id long, line_no int, line string")
    units = units.withColumn("content_start", F.col("line_no").cast("long")).withColumn("content_end", F.col("line_no").cast("long") + 1)
    texts = [r.text for r in chunking.chunk_documents(units).orderBy("seq").collect()]
    assert texts[0].startswith("1. Scope") and all(x.startswith("1. Scope") for x in texts[1:4])
    assert "".join(texts).count("x") >= 3000 and len(texts) > 5


UNITS = "document_id long, n int, text string, page_number int, element_type string, is_paragraph_start boolean, table_id int, content_start long, content_end long"


def mixed_units(document, seed):
    """Units of all kinds in any order: headings, list items, tables with and without ids, noise, very long units."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg가다함") for _ in range(r.randint(1, 7))) for _ in range(60)]
    sentence = lambda k: " ".join(r.choice(words) for _ in range(k)) + r.choice([".", "다", "!", ""])
    rows, at = [], 0
    for n in range(r.randint(1, 45)):
        kind, table = r.choice(["TEXT_LINE"] * 5 + ["HEADING", "TABLE_ROW", "TABLE_ROW", "TABLE_HEADER", "HEADER_FOOTER"]), None
        text = " ".join(sentence(r.randint(1, 14)) for _ in range(r.choice([1, 1, 2, 3])))
        if kind.startswith("TABLE"):
            table = r.choice([1, 1, 1, 2, None])
            text = " | ".join(r.choice(words) for _ in range(4))
        text = r.choice([text] * 12 + [f"가. {text}", f" {text}  ", " ", "x" * r.randint(900, 2500), " ".join(words * 12), " ".join(sentence(9) for _ in range(60)), unicodedata.normalize("NFD", text)])
        rows.append((document, n, text, r.choice([None, 1, 2]), kind, r.random() < 0.2, table, at, at + len(text)))
        at += len(text) + 1
    return rows


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 40, "min_tokens": 8, "overlap_tokens": 10}, {"max_tokens": 12, "min_tokens": 3, "overlap_tokens": 0}])
def test_chunks_equal_a_plain_fold(spark, limits):
    rows = [x for d in range(30) for x in mixed_units(d, d)]
    units = spark.createDataFrame(rows, UNITS).withColumn("text", text.nfc(F.col("text")))
    found = {}
    for r in chunking.chunk_units(units, **limits).orderBy("document_id", "seq").collect():
        assert r.char_count == len(r.text) and r.token_count == plain_chunks.estimate(r.text)
        found.setdefault(r.document_id, []).append((r.text, r.page_number, r.content_start, r.content_end, r.heading))
    names = dict(zip(("max_tokens", "min_tokens", "overlap_tokens"), ("most", "least", "overlap")))
    for d in range(30):
        units = [dict(zip(("text", "page", "kind", "start", "table", "a", "b"), x[2:])) for x in rows if x[0] == d]
        assert found.get(d, []) == plain_chunks.chunks(units, **{names[k]: v for k, v in limits.items()}), d


def test_structure_is_found_only_where_there_is_none(spark):
    rows = [(1, i, text, 1, "TEXT_LINE", False, None, None, None) for i, text in enumerate(["1. Scope", "body", "가. item", "나. item"])]
    rows += [(2, i, text, 1, kind, False, None, None, None) for i, (text, kind) in enumerate([("1. Scope", "TEXT_LINE"), ("row", "TABLE_ROW")])]
    found = chunking.repaired(spark.createDataFrame(rows, UNITS)).orderBy("document_id", "n").collect()
    assert [(r.element_type, r.is_paragraph_start) for r in found] == [("HEADING", True), ("TEXT_LINE", False), ("TEXT_LINE", True), ("TEXT_LINE", True), ("TEXT_LINE", False), ("TABLE_ROW", False)]


def test_noise_is_what_most_groups_repeat(spark):
    rows = [(1, p * 10 + i, text, p, kind, False, None, None, None) for p in range(10) for i, (text, kind) in enumerate([("1. Scope", "HEADING"), ("Confidential", "TEXT_LINE"), (f"Body {p}", "TEXT_LINE"), ("z" * 90, "TEXT_LINE"), ("Confidential ", "TEXT_LINE")])]
    rows += [(1, 200, "Rare", 3, "TEXT_LINE", False, None, None, None)]
    units = spark.createDataFrame(rows, UNITS)
    noise = lambda **more: {r.text.strip() for r in chunking.marked_noise(units, ["document_id"], ["page_number"], **more).where("element_type = 'HEADER_FOOTER'").collect()}
    assert noise() == {"Confidential"} and noise(max_chars=None) == {"Confidential", "z" * 90}
    assert noise(mask_digits=True) == {"Confidential", *(f"Body {p}" for p in range(10))} and noise(least=11) == set()
    report = chunking.noise_report(units, ["document_id"], ["page_number"], ["n"], max_chars=None).collect()
    assert [(r.key, r.groups, r.sample) for r in report] == [("Confidential", 10, "Confidential"), ("z" * 90, 10, "z" * 90)]
    everywhere = chunking.marked_noise(units.withColumn("document_id", F.col("page_number").cast("long")), [], ["document_id"])
    assert everywhere.where("element_type = 'HEADER_FOOTER'").count() == 20


def test_chunks_by_a_tokenizer_stay_within_the_limit(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [x for d in range(12) for x in mixed_units(d, 100 + d)]
    units = spark.createDataFrame(rows, UNITS).withColumn("text", text.nfc(F.col("text")))
    found = chunking.chunk_units(units, chunking.by_tokenizer(path), keep_heading=False).collect()
    counts = [len(tokenizer.encode(r.text, add_special_tokens=False).ids) for r in found]
    assert counts == [r.token_count for r in found] and max(counts) <= chunking.MAX_TOKENS
    held = {d: "".join(r.text for r in found if r.document_id == d) for d in range(12)}
    assert all(word in held[x[0]] for x in rows if x[4] != "HEADER_FOOTER" and len(x[2]) < 150 for word in unicodedata.normalize("NFC", x[2]).split())


def test_context_stays_in_budget(spark):
    rows = [(1, i, i, "f", i, " ".join(f"Sentence {j} of it." for j in range(i, i + 8))) for i in range(10)]
    hits = spark.createDataFrame(rows, "query_id long, rank long, chunk_id long, filename string, seq long, text string")
    for budget in (1, 10, 50, 100, 300, 1000):
        found = chunking.assemble_context(hits, budget).collect()
        assert sum(r.tokens for r in found) <= budget
    bodies = [s for r in found for s in r.evidence.split("\n", 1)[1].split(". ")]
    assert len(bodies) == len(set(bodies))


def test_hash_embedding(spark):
    a, b = embedding.hash_embedding("text", 100), embedding.hash_embedding("other", 100)
    assert abs(np.linalg.norm(a) - 1) < 1e-9 and not np.allclose(a, b)
    df = spark.createDataFrame([("text",), (None,)], "x string")
    assert np.allclose(df.select(embedding.hashed(F.col("x"), 100)).first()[0], a)


def test_hash_embeddings_are_made_of_digests(spark):
    texts = ["", "text", "제3조 목적", "x" * 5000, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for dimension in (1, 32, 64, 100):
        found = [r[0] for r in df.orderBy("i").select(embedding.hashed(F.col("x"), dimension)).collect()]
        assert found == [embedding.hash_embedding(x or "", dimension).tolist() for x in texts]
    column = embedding.hashed(F.col("x"))
    plan = df.select(column)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan  # what goes to Python is short, however long a text is
