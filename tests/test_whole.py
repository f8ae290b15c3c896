"""Queries over whole tables, with ids that the smallest data doesn't have."""

import duckdb
import pytest

from compare import of_duck, of_spark
from conftest import DATA, TABLES
from docmill.operators import chunking
from docmill.plans import queries as plans
from docmill.plans.views import Views

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{LARGER}/{name}.parquet'")
    return con


def test_rrf_hybrid_searches_all_texts(spark, larger):
    whole = plans.oracle_sql()["rrf_hybrid"]
    assert of_spark(plans.queries()["rrf_hybrid"](spark, LARGER)) == of_duck(larger, whole)


def test_context_assembly_takes_all_chunks(spark):
    chunks = chunking.chunk_documents(Views(spark, DATA).units).collect()
    wanted = []
    for query in sorted({c.document_id % 50 for c in chunks}):
        seen, used, index = set(), 0, 0
        for c in sorted((c for c in chunks if c.document_id % 50 == query), key=lambda c: (c.document_id, c.seq)):
            fresh = {}
            for s in chunking.SENTENCE.split(c.text):
                if s.strip() and " ".join(s.split()) not in seen:
                    fresh.setdefault(" ".join(s.split()), s.strip())
            header, body = f"[{index + 1}] doc-{c.document_id} #{c.seq + 1}\n", " ".join(fresh.values())
            if fresh and used + chunking.tokens(header + body) <= 1000:
                seen, used, index = seen | set(fresh), used + chunking.tokens(header + body), index + 1
                wanted.append((query, index, header + body))
    found = plans.queries()["context_assembly"](spark, DATA).collect()
    assert sorted((r.query_id, r["index"], r.evidence) for r in found) == sorted(wanted)
    assert len({r.query_id for r in found}) == 50 and any("#6\n" in r.evidence for r in found)
    assert len({r.chunk_id for r in found}) == len(found)


def test_elements_behind_chunks_of_all_documents(spark, tmp_path):
    con = duckdb.connect()
    for name, key in (("documents", "doc_id"), ("conversations", "conv_id")):
        moved = f"SELECT * REPLACE ({key} + 60 AS {key}) FROM '{LARGER}/{name}.parquet' WHERE {key} < 100"
        con.execute(f"COPY ({moved}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    whole = plans.oracle_sql()["elements_behind_chunks"]
    assert of_spark(plans.queries()["elements_behind_chunks"](spark, str(tmp_path))) == of_duck(con, whole)
