"""Every query of the library over the virtual tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import embedding
from docmill.functions import text as t
from docmill.operators import access, amounts, chunking, documents, layout, reports, review, search
from docmill.plans import pages, records, structure, workflow  # noqa: F401  register their queries
from docmill.plans.registry import PROJECT, QUERIES, SINCE, TERM, UNTIL, USER, query
from docmill.plans.views import Views, with_views

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in QUERIES.items() if sql is not None}


# Dashboard


@query(f"SELECT status, count(*) AS n FROM v_documents WHERE project_id = {PROJECT} GROUP BY status")
def doc_status_counts(v: Views) -> DataFrame:
    return reports.counts_by(v.documents, PROJECT, "status")


@query(f"SELECT review_status, count(*) AS n FROM v_documents WHERE project_id = {PROJECT} GROUP BY review_status")
def doc_review_counts(v: Views) -> DataFrame:
    return reports.counts_by(v.documents, PROJECT, "review_status")


@query(f"""SELECT document_type, n, n / sum(n) OVER () AS share, n / max(n) OVER () AS bar FROM
    (SELECT document_type, count(*) AS n FROM v_documents WHERE project_id = {PROJECT} GROUP BY document_type)""")
def doc_type_counts(v: Views) -> DataFrame:
    return reports.type_distribution(v.documents, PROJECT)


@query(f"""SELECT count(*) AS total, count(*) FILTER (status IN ('PENDING','EXTRACTING','ANALYZING')) AS processing,
    count(*) FILTER (status = 'EXTRACTED') AS extracted, count(*) FILTER (status = 'COMPLETED') AS completed,
    count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (review_status IN ('PENDING','IN_PROGRESS')) AS review_pending,
    count(*) FILTER (review_status = 'COMPLETED') AS review_completed FROM v_documents WHERE project_id = {PROJECT}""")
def doc_status_rollup(v: Views) -> DataFrame:
    return reports.status_rollup(v.documents, PROJECT)


@query(f"SELECT id, filename, status FROM v_documents WHERE project_id = {PROJECT} ORDER BY created_at DESC, id DESC LIMIT 10")
def recent_documents(v: Views) -> DataFrame:
    return reports.recent(v.documents, PROJECT, 10).select("id", "filename", "status")


@query(f"""SELECT id, filename, status FROM v_documents WHERE project_id = {PROJECT} ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 5""")
def document_page(v: Views) -> DataFrame:
    return documents.page(v.documents.where(F.col("project_id") == PROJECT), 2, 5).select("id", "filename", "status")


@query(f"SELECT count(*) AS total, ceil(count(*) / 20)::INT AS total_pages FROM v_documents WHERE project_id = {PROJECT}")
def document_page_count(v: Views) -> DataFrame:
    return documents.page_count(v.documents.where(F.col("project_id") == PROJECT), 20)


# Documents


@query(f"""SELECT d.id, filename FROM v_documents d JOIN v_texts x ON d.id = x.document_id WHERE project_id = {PROJECT}
    AND (regexp_replace(content, '\\s+', '', 'g') ILIKE '%thean%' OR regexp_replace(filename, '\\s+', '', 'g') ILIKE '%thean%')""")
def document_search_ws_insensitive(v: Views) -> DataFrame:
    return documents.search_documents(v.documents, v.texts, v.analyses, PROJECT, term="the an").select("id", "filename")


@query("""SELECT id FROM v_documents WHERE project_id = 3 AND id IN
    (SELECT document_id FROM v_analyses WHERE analyzer_type = 'view' AND length(json_extract_string(result_json, '$.k')) = 1)""")
def document_category_filter(v: Views) -> DataFrame:
    digits = v.analyses.withColumn("result_json", F.to_json(F.struct(F.length(F.get_json_object("result_json", "$.k")).alias("digits"))))
    return documents.search_documents(v.documents, v.texts, digits, PROJECT, category=("view", "$.digits", "1")).select("id")


@query("""SELECT id, document_id, analyzer_type, result_json FROM v_analyses
    QUALIFY row_number() OVER (PARTITION BY document_id, analyzer_type ORDER BY created_at DESC, id DESC) = 1""")
def latest_analysis_per_type(v: Views) -> DataFrame:
    return documents.latest_analyses(v.analyses).select("id", "document_id", "analyzer_type", "result_json")


@query("""SELECT id, analyzer_type, row_number() OVER (PARTITION BY analyzer_type ORDER BY created_at DESC, id DESC) = 1 AS is_latest
    FROM v_analyses WHERE document_id = 8""")
def analysis_history(v: Views) -> DataFrame:
    return documents.analysis_history(v.analyses, 8).select("id", "analyzer_type", "is_latest")


@query(f"""WITH latest AS (SELECT document_id, analyzer_type, result_json FROM v_analyses WHERE analyzer_type IN ('view','click')
      QUALIFY row_number() OVER (PARTITION BY document_id, analyzer_type ORDER BY created_at DESC, id DESC) = 1)
    SELECT d.id, filename, substr(content, 1, 100) AS preview, coalesce(char_count, 0) AS char_count, a.result_json AS view, b.result_json AS click
    FROM v_documents d LEFT JOIN v_texts x ON d.id = x.document_id LEFT JOIN latest a ON a.document_id = d.id AND a.analyzer_type = 'view'
    LEFT JOIN latest b ON b.document_id = d.id AND b.analyzer_type = 'click' WHERE project_id = {PROJECT}""")
def document_list_enriched(v: Views) -> DataFrame:
    return documents.document_list(v.documents.where(F.col("project_id") == PROJECT), v.texts, v.analyses, ("view", "click"))


@query("""WITH c AS (SELECT document_id, line_no AS seq, 1 + (document_id % 2) AS text_version FROM v_units)
    SELECT c.document_id, count(*) AS stale_chunks FROM c JOIN v_texts x ON c.document_id = x.document_id
    WHERE c.text_version < x.text_version GROUP BY c.document_id""")
def stale_documents(v: Views) -> DataFrame:
    chunks = v.units.select("document_id", (1 + F.col("document_id") % 2).alias("text_version"))
    return documents.stale_documents(chunks, v.texts)


@query("""WITH c AS (SELECT document_id, 1 + (document_id % 2) AS text_version, CASE WHEN line_no = 0 AND document_id % 10 = 0 THEN 'alt' ELSE 'base' END
      AS model FROM v_units), p AS (SELECT document_id, count(DISTINCT (text_version, model)) AS n, max(text_version) AS tv, max(model) AS m FROM c GROUP BY 1)
    SELECT x.document_id, coalesce(n = 1 AND tv = text_version AND m = 'base', false) AS is_fresh FROM v_texts x LEFT JOIN p USING (document_id)""")
def chunk_freshness(v: Views) -> DataFrame:
    model = F.when((F.col("line_no") == 0) & (F.col("document_id") % 10 == 0), "alt").otherwise("base")
    chunks = v.units.select("document_id", (1 + F.col("document_id") % 2).alias("text_version"), model.alias("embedding_model"))
    return documents.freshness(chunks, v.texts, "base")


@query("""SELECT id, project_id, original_id FROM (SELECT id, project_id, min(id) OVER (PARTITION BY project_id, content_hash) AS original_id
    FROM v_documents) WHERE id <> original_id""")
def duplicate_documents(v: Views) -> DataFrame:
    return documents.duplicates(v.documents)


@query("""WITH c AS (SELECT document_id, line_no, 'old' AS state FROM v_units), f AS (SELECT DISTINCT document_id FROM v_units WHERE document_id % 3 = 0)
    SELECT state, count(*) AS n FROM (SELECT document_id, state FROM c WHERE document_id NOT IN (FROM f) UNION ALL
    SELECT document_id, 'new' FROM v_units WHERE document_id % 3 = 0) GROUP BY state""")
def chunk_rebuild(v: Views) -> DataFrame:
    current = v.units.select("document_id", "line_no", F.lit("old").alias("state"))
    fresh = v.units.where("document_id % 3 = 0").select("document_id", "line_no", F.lit("new").alias("state"))
    return documents.replace_chunks(current, fresh).groupBy("state").agg(F.count("*").alias("n"))


# Scope and search


@query(f"SELECT project_id FROM v_members WHERE user_id = {USER}")
def scope_resolution(v: Views) -> DataFrame:
    return search.resolve_scope(v.members, USER)


@query(f"SELECT project_id FROM v_members WHERE user_id = {USER} EXCEPT SELECT {PROJECT}")
def other_project_scope(v: Views) -> DataFrame:
    return search.other_projects(v.members, USER, PROJECT)


def _query_vector(v: Views) -> list[float]:
    return list(v.vectors.where("chunk_id = 1").select("embedding").first()[0])


_VECTOR_SQL = """SELECT chunk_id, document_id, project_id, round(least(list_cosine_similarity(embedding,
    (SELECT embedding FROM v_vectors WHERE chunk_id = 1)), 1.0), 6) AS similarity FROM v_vectors WHERE embedding_model = 'base' AND project_id IN ({})
    ORDER BY least(list_cosine_similarity(embedding, (SELECT embedding FROM v_vectors WHERE chunk_id = 1)), 1.0) DESC, chunk_id LIMIT 20"""


@query(_VECTOR_SQL.format("0,1,2,3,4,5,6,7,8,9"))
def vector_topk(v: Views) -> DataFrame:
    return search.vector_topk(v.vectors, _query_vector(v), "base", list(range(10)), 20)


@query(f"SELECT * FROM ({_VECTOR_SQL.format('3')}) WHERE similarity >= 0.0")
def vector_topk_scoped(v: Views) -> DataFrame:
    return search.vector_topk(v.vectors, _query_vector(v), "base", [3], 20, minimum=0.0)


def _chunks(v: Views) -> DataFrame:
    return v.units.select((F.col("document_id") * 100_000 + F.col("line_no")).alias("chunk_id"), "document_id", F.col("line_no").alias("seq"), F.col("line").alias("text"))


_HITS = f"((length(line) - length(replace(lower(line), '{TERM}', ''))) // {len(TERM)})::INT"


@query(f"""SELECT document_id, line_no AS seq, {_HITS} AS hits FROM v_units WHERE line ILIKE '%{TERM}%'
    ORDER BY hits DESC, document_id, seq LIMIT 30""")
def keyword_topk(v: Views) -> DataFrame:
    return search.keyword_topk(_chunks(v), TERM, by_count=True).select("document_id", "seq", "hits")


@query(f"SELECT document_id, line_no AS seq, {_HITS} AS hits FROM v_units WHERE line ILIKE '%{TERM}%'")
def keyword_hits(v: Views) -> DataFrame:
    return search.keyword_hits(_chunks(v), TERM).select("document_id", "seq", "hits")


def _word_similarity_sql(rows: str, term: str) -> str:
    """document_id, seq, score of rows (document_id, seq, text): the best share of the term's trigrams in any stretch of the text."""
    wanted = search.trigrams(term)
    listed, n = ", ".join(f"'{g}'" for g in dict.fromkeys(wanted)), len(set(wanted))
    return f"""ws_words AS (SELECT document_id, seq, words, unnest(words) AS word, unnest(range(len(words))) AS wi FROM (SELECT document_id, seq, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM ({rows}))),
    ws_grams AS MATERIALIZED (SELECT document_id, seq, row_number() OVER (PARTITION BY document_id, seq ORDER BY wi, i) AS p, gram, gram IN ({listed}) AS hit FROM (
      SELECT document_id, seq, wi, i, substr('  ' || word || ' ', i, 3) AS gram FROM (SELECT *, unnest(range(1, length(word) + 2)) AS i FROM ws_words WHERE NOT list_contains(words, '{term}')))),
    ws_score AS (SELECT document_id, seq, max(c / ({n}::DOUBLE + t - c)) AS score FROM (
        SELECT a.document_id, a.seq, count(DISTINCT s.gram) AS t, count(DISTINCT s.gram) FILTER (s.hit) AS c FROM ws_grams a JOIN ws_grams b ON a.document_id = b.document_id AND a.seq = b.seq AND a.hit AND b.hit AND a.p <= b.p
          JOIN ws_grams s ON s.document_id = a.document_id AND s.seq = a.seq AND s.p BETWEEN a.p AND b.p GROUP BY a.document_id, a.seq, a.p, b.p) GROUP BY document_id, seq
      UNION ALL SELECT DISTINCT document_id, seq, 1.0::DOUBLE FROM ws_words WHERE list_contains(words, '{term}'))"""


@query(f"""WITH {_word_similarity_sql("SELECT document_id, line_no AS seq, line AS text FROM v_units WHERE line ILIKE '%ation%'", "ation")}
    SELECT document_id, seq, round(score, 6) AS score FROM ws_score ORDER BY ws_score.score DESC, document_id, seq LIMIT 30""")
def word_similarity_topk(v: Views) -> DataFrame:
    return search.keyword_topk(_chunks(v), "ation").select("document_id", "seq", F.round("score", 6).alias("score"))


_CHUNK_VECTORS = """SELECT chunk_id, document_id, chunk_id AS seq,
    least(list_cosine_similarity(embedding, (SELECT embedding FROM v_vectors WHERE chunk_id = 1)), 1.0) AS score FROM v_vectors WHERE embedding_model = 'base'"""


_SCOPED = f"""SELECT chunk_id, chunk_id % 50 AS document_id, chunk_id AS seq, content AS text, embedding FROM v_vectors v JOIN v_texts t ON t.document_id = chunk_id
    WHERE embedding_model = 'base' AND v.project_id IN (SELECT project_id FROM v_members WHERE user_id = {USER})"""


def _whole_chunks(v: Views) -> DataFrame:
    """Texts with vectors as chunks of their own."""
    texts = v.texts.select(F.col("document_id").alias("chunk_id"), F.col("content").alias("text"))
    return v.vectors.join(texts, "chunk_id").withColumn("seq", F.col("chunk_id"))


@query(f"""WITH s AS ({_SCOPED}), {_word_similarity_sql(f"SELECT document_id, seq, text FROM s WHERE text ILIKE '%{TERM}%'", TERM)},
    a AS (SELECT chunk_id, document_id, seq, least(list_cosine_similarity(embedding, (SELECT embedding FROM v_vectors WHERE chunk_id = 1)), 1.0) AS score FROM s),
    n AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM a QUALIFY rank <= 30),
    c AS (SELECT *, seq AS chunk_id, row_number() OVER (ORDER BY score DESC, document_id, seq) AS rank FROM ws_score QUALIFY rank <= 30)
    SELECT coalesce(n.chunk_id, c.chunk_id) AS chunk_id, round(coalesce(1 / (60.0 + n.rank), 0) + coalesce(1 / (60.0 + c.rank), 0), 8) AS fused,
      CASE WHEN c.rank IS NULL THEN 'vector' WHEN n.rank IS NULL THEN 'keyword' ELSE 'both' END AS match_kind
    FROM n FULL JOIN c ON n.chunk_id = c.chunk_id
    ORDER BY coalesce(1 / (60.0::DOUBLE + n.rank), 0) + coalesce(1 / (60.0::DOUBLE + c.rank), 0) DESC,
      coalesce(n.document_id, c.document_id), coalesce(n.seq, c.seq) LIMIT 20""")
def rrf_hybrid(v: Views) -> DataFrame:
    projects = [r[0] for r in search.resolve_scope(v.members, USER).collect()]  # the projects of one user
    found = search.hybrid_search(_whole_chunks(v), _query_vector(v), TERM, "base", projects)
    return found.select("chunk_id", F.round("fused", 8).alias("fused"), "match_kind")



@query("""WITH h AS (SELECT document_id, row_number() OVER (ORDER BY chunk_id) AS rank, chunk_id / 7.0::DOUBLE AS similarity FROM v_vectors)
    SELECT document_id, min(rank) AS best_rank, max(similarity) AS best_similarity, count(*) AS hits FROM h GROUP BY document_id""")
def hits_grouped_by_document(v: Views) -> DataFrame:
    ranked = v.vectors.select("document_id", (F.col("chunk_id") + 1).alias("rank"), (F.col("chunk_id") / F.lit(7.0)).alias("similarity"))
    return search.group_hits(ranked)


# Amounts


_PRECEDENTS = """SELECT document_id, project_id, item_name, quantity, unit_price, amount, item_name = 'small ring' AS is_exact FROM v_amount_items
    WHERE decision IN ('APPROVED','EDITED') AND project_id IN (1,2,4) AND (item_name = 'small ring' OR item_name ILIKE '%small ring%')
    ORDER BY is_exact DESC, unit_price DESC, document_id, item_name, quantity, amount LIMIT 20"""


@query(_PRECEDENTS)
def amount_precedents(v: Views) -> DataFrame:
    return amounts.precedents(v.amount_items, "small ring", [1, 2, 4])


@query(f"""SELECT count(*) AS n, min(unit_price) AS min_price, median(unit_price::DECIMAL(18,4))::DECIMAL(18,4) AS median_price,
    max(unit_price) AS max_price FROM ({_PRECEDENTS})""")
def precedent_summary(v: Views) -> DataFrame:
    return amounts.precedent_summary(amounts.precedents(v.amount_items, "small ring", [1, 2, 4]))


@query("SELECT coalesce(category, 'OTHER') AS category, sum(amount)::DECIMAL(28,2) AS amount FROM v_amount_items GROUP BY 1")
def amount_by_category(v: Views) -> DataFrame:
    return amounts.by_category(v.amount_items)


_CHECK = """SELECT document_id, coalesce(sum(amount) FILTER (category IS DISTINCT FROM 'VAT'), 0)::DECIMAL(28,2) AS item_total,
    coalesce(sum(amount) FILTER (category = 'VAT'), 0)::DECIMAL(28,2) AS vat_total FROM v_amount_items GROUP BY document_id"""


@query(f"""WITH s AS ({_CHECK}), o AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS stated_total FROM orders)
    SELECT document_id, item_total, vat_total, stated_total, (item_total - stated_total)::DECIMAL(29,2) AS difference,
    coalesce(item_total = stated_total, false) AS matches FROM s LEFT JOIN o USING (document_id)""")
def amount_total_check(v: Views) -> DataFrame:
    stated = v.table("orders").select(
        F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("decimal(18,2)")).alias("stated_total")
    )
    return amounts.total_check(v.amount_items, stated)


@query("""SELECT document_id, item_name, quantity, unit_price, amount, round(quantity * unit_price, 0)::DECIMAL(38,0) AS computed,
    round(quantity * unit_price, 0) = amount AS matches FROM v_amount_items""")
def amount_line_check(v: Views) -> DataFrame:
    return amounts.line_check(v.amount_items)


@query("""SELECT project_id, count(DISTINCT document_id) AS documents, 'KRW' AS currency,
    (sum(amount) FILTER (category IS DISTINCT FROM 'VAT'))::DECIMAL(28,2) AS item_total, (sum(amount) FILTER (category = 'VAT'))::DECIMAL(28,2) AS vat_total
    FROM v_amount_items GROUP BY project_id""")
def amount_project_rollup(v: Views) -> DataFrame:
    return amounts.project_rollup(v.amount_items)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE (o_orderkey * 1000)::BIGINT END AS money FROM orders""")
def money_parse(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.concat(F.format_number(key * 1000, 0), F.lit("원"))).when(key % 3 == 1, F.lit("약 1억")).otherwise(
        F.concat(F.lit(" "), (key * 1000).cast("string"), F.lit(" KRW"))
    )
    return v.table("orders").select(key.alias("id"), t.parse_money(raw).cast("long").alias("money"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (o_orderkey + 0.5)::DECIMAL(18,4) END AS quantity FROM orders""")
def quantity_parse(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    number = F.concat(F.format_number(key, 0), F.lit(".5"))
    raw = F.when(key % 4 == 3, F.concat(F.lit("-"), number)).otherwise(F.concat(number, F.lit(" M/M")))
    return v.table("orders").select(key.alias("id"), t.parse_quantity(raw).alias("quantity"))


# Reports


@query(f"""SELECT (SELECT count(*) FROM v_amount_items WHERE project_id = {PROJECT} AND decision = 'PENDING')
    + (SELECT count(*) FROM v_decisions WHERE project_id = {PROJECT} AND decision = 'PENDING')
    + (SELECT count(*) FROM v_schedule WHERE project_id = {PROJECT} AND decision = 'PENDING') AS pending_suggestions""")
def pending_suggestions(v: Views) -> DataFrame:
    return reports.pending_suggestions(v.amount_items, v.decisions, v.schedule, PROJECT)


def _preview_sql(kind: str, everything: bool, period: bool, only: str = "") -> str:
    held = lambda column: f"AND {column} BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'" if period else ""
    ends = f"AND (starts_on BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' OR ends_on BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}')" if period else ""
    count = lambda view, more: f"(SELECT count(*) FROM {view} WHERE project_id = {PROJECT} {more})"
    none = "" if everything else "AND false"
    waiting = "AND decision = 'PENDING'"
    return f"""SELECT *, documents + decisions + schedule_items + amount_items > 0 AS can_generate FROM (SELECT '{kind}' AS kind,
        {count('v_documents', none + ' ' + held('created_at::DATE'))} AS documents, {count('v_decisions', held('decided_on') + only)} AS decisions,
        {count('v_schedule', none + ' ' + ends)} AS schedule_items, {count('v_amount_items', none + ' ' + held('uploaded_on'))} AS amount_items,
        {count('v_amount_items', waiting)} + {count('v_decisions', waiting)} + {count('v_schedule', waiting)} AS pending_suggestions)"""


def _preview(v: Views, kind: str) -> DataFrame:
    return reports.report_preview(v.documents, v.decisions, v.schedule, v.amount_items, PROJECT, kind, SINCE, UNTIL)


@query(_preview_sql("WEEKLY_REPORT", True, True))
def report_preview_weekly(v: Views) -> DataFrame:
    return _preview(v, "WEEKLY_REPORT")


@query(_preview_sql("DECISION_LOG", False, False))
def report_preview_log(v: Views) -> DataFrame:
    return _preview(v, "DECISION_LOG")


@query(_preview_sql("MEETING_AGENDA", False, False, "AND status = 'PENDING'"))
def report_preview_agenda(v: Views) -> DataFrame:
    return _preview(v, "MEETING_AGENDA")


@query(_preview_sql("PROJECT_STATUS", True, False))
def report_preview_status(v: Views) -> DataFrame:
    return _preview(v, "PROJECT_STATUS")


@query(f"""SELECT id, kind, starts_on BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' OR coalesce(ends_on BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}', false) AS listed,
    starts_on <= DATE '{UNTIL}' AND coalesce(ends_on, starts_on) >= DATE '{SINCE}' AS overlaps FROM v_schedule""")
def schedule_in_window(v: Views) -> DataFrame:
    start, end = F.col("starts_on"), F.col("ends_on")
    listed = reports.endpoint_in_period(start, end, SINCE, UNTIL)
    return v.schedule.select("id", "kind", listed.alias("listed"), reports.overlaps_period(start, end, SINCE, UNTIL).alias("overlaps"))


@query("SELECT id, CASE WHEN kind IN ('MILESTONE','MEETING') THEN starts_on ELSE coalesce(ends_on, starts_on) END AS due FROM v_schedule")
def effective_due_date(v: Views) -> DataFrame:
    return v.schedule.select("id", reports.effective_due(F.col("kind"), F.col("starts_on"), F.col("ends_on")).alias("due"))


@query(f"SELECT id, status, decided_on FROM v_decisions WHERE project_id = {PROJECT} AND status = 'PENDING' AND superseded_by IS NULL")
def open_decisions(v: Views) -> DataFrame:
    return v.decisions.where((F.col("project_id") == PROJECT) & (F.col("status") == "PENDING") & F.col("superseded_by").isNull()).select("id", "status", "decided_on")


@query("""WITH RECURSIVE chain AS (SELECT id, superseded_by AS last, 1 AS steps FROM v_decisions WHERE superseded_by IS NOT NULL
      UNION ALL SELECT c.id, d.superseded_by, c.steps + 1 FROM chain c JOIN v_decisions d ON c.last = d.id WHERE d.superseded_by IS NOT NULL)
    SELECT id, arg_max(last, steps) AS last, max(steps) AS steps FROM chain GROUP BY id""")
def decision_supersede_chain(v: Views) -> DataFrame:
    return reports.open_chain(v.decisions)


@query("""WITH m AS (SELECT c_nationkey AS project_id, count(*) FILTER (o_orderdate < DATE '1998-01-01') AS a, count(*) AS b FROM orders
      JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT project_id, CASE WHEN b > a THEN b - a END AS grown FROM m""")
def report_growth(v: Views) -> DataFrame:
    joined = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    early = F.sum((F.col("o_orderdate") < F.lit(date(1998, 1, 1))).cast("long"))
    maps = joined.groupBy(F.col("c_nationkey").alias("project_id")).agg(
        F.create_map(F.lit("decisions"), early).alias("a"), F.create_map(F.lit("decisions"), F.count("*")).alias("b")
    )
    return maps.select("project_id", F.element_at(reports.growth(F.col("a"), F.col("b")), "decisions").alias("grown"))


# Text


@query("SELECT document_id, line_no, line, content_start, content_end FROM v_units")
def text_line_units(v: Views) -> DataFrame:
    return v.units.select("document_id", "line_no", "line", "content_start", "content_end")


@query("""SELECT p_partkey AS id, p_partkey % 8 IN (0, 1, 2, 4) AS is_heading FROM part""")
def heading_lines(v: Views) -> DataFrame:
    name = F.col("p_name")
    lines = [
        F.concat(F.lit("1.2 ) "), name),  # numbered
        F.concat(F.lit("## "), name, F.lit(".")),  # markdown, whatever its end
        F.concat(F.lit("제 3 조("), name, F.lit(")")),  # a clause
        F.concat(F.lit("3. "), name, F.lit("? (note)")),  # a sentence behind its parenthesis
        F.concat(F.lit("  IV. "), name, F.lit("\u3000")),  # Roman, wide white space around
        F.lit("12.5%"),
        name,
        F.concat(F.lit("1. "), F.repeat(name, 20)),  # too long
    ]
    line = F.element_at(F.array(*lines), (F.col("p_partkey") % 8 + 1).cast("int"))
    return v.table("part").select(F.col("p_partkey").alias("id"), t.is_heading(line).alias("is_heading"))


@query("""SELECT key, count(DISTINCT document_id) AS documents, min(line) AS sample FROM (SELECT document_id, line,
      regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '\\d+', '#', 'g') AS key FROM v_units) GROUP BY key HAVING count(DISTINCT document_id) >= 3""")
def repeated_lines(v: Views) -> DataFrame:
    keyed = v.units.select("document_id", "line", t.repeat_key(F.col("line")).alias("key"))
    counted = keyed.groupBy("key").agg(F.count_distinct("document_id").alias("documents"), F.min("line").alias("sample"))
    return counted.where("documents >= 3")


@query("""SELECT document_id, CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, floor(length(content) / 1.89::DOUBLE + 0.999::DOUBLE))::INT END AS tokens FROM v_texts""")
def token_estimate(v: Views) -> DataFrame:
    return v.texts.select("document_id", t.token_estimate(F.col("content")).alias("tokens"))


_FLAT = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"


@query(f"""SELECT document_id, CASE WHEN length(flat) <= 220 THEN flat ELSE (CASE WHEN 220 - strpos(reverse(substr(flat, 1, 220)), ' ') > 154
      AND strpos(reverse(substr(flat, 1, 220)), ' ') > 0 THEN substr(flat, 1, 220 - strpos(reverse(substr(flat, 1, 220)), ' ')) ELSE substr(flat, 1, 220) END) || '…' END
    AS snippet FROM (SELECT document_id, {_FLAT} AS flat FROM v_texts)""")
def snippet_head(v: Views) -> DataFrame:
    return v.texts.select("document_id", t.semantic_snippet(F.col("content")).alias("snippet"))


@query(f"""WITH f AS (SELECT document_id, {_FLAT} AS flat FROM v_texts), p AS (SELECT *, strpos(lower(flat), '{TERM}') - 1 AS pos, length(flat) AS n FROM f),
    q AS (SELECT *, greatest(least(greatest(pos - 78, 0) + 160, n) - 160, 0) AS s FROM p)
    SELECT document_id, CASE WHEN pos < 0 THEN (CASE WHEN n > 160 THEN substr(flat, 1, 160) || '…' ELSE flat END) WHEN n <= 160 THEN flat
      ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END) || substr(flat, s + 1, least(greatest(pos - 78, 0) + 160, n) - s) ||
      (CASE WHEN least(greatest(pos - 78, 0) + 160, n) < n THEN '…' ELSE '' END) END AS snippet,
      CASE WHEN pos >= 0 THEN (CASE WHEN n <= 160 THEN pos ELSE pos - s + (s > 0)::INT END)::INT END AS hit_offset FROM q""")
def snippet_keyword(v: Views) -> DataFrame:
    snippet, offset = t.keyword_snippet(F.col("content"), TERM)
    return v.texts.select("document_id", snippet.alias("snippet"), offset.alias("hit_offset"))


# Review


@query("""SELECT document_id, string_agg(text, chr(10) ORDER BY reading_order) AS content FROM v_elements WHERE NOT is_excluded AND NOT is_deleted GROUP BY document_id""")
def content_assembly(v: Views) -> DataFrame:
    return review.assembled(v.elements)


@query("""WITH r AS (SELECT document_id, reading_order, text, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS a FROM v_elements
      WHERE NOT is_excluded AND NOT is_deleted WINDOW w AS (PARTITION BY document_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, a + length(text) AS b, CASE WHEN reading_order % 3 = 0 THEN 6 - length(text) ELSE 0 END AS d FROM r),
    s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY document_id ORDER BY a, reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e)
    SELECT document_id, reading_order, (a + k)::BIGINT AS content_start, (b + k + d)::BIGINT AS content_end FROM s""")
def content_range_shift(v: Views) -> DataFrame:
    edits = v.elements.where("reading_order % 3 = 0").select("document_id", "reading_order", F.lit("edited").alias("new_text"))
    return review.shifted_ranges(review.content_ranges(v.elements), edits)


@query("""SELECT document_id, line_no AS place, (sum((length(line) > 100)::INT) OVER (PARTITION BY document_id ORDER BY line_no))::INT AS paragraph FROM v_units""")
def paragraph_groups(v: Views) -> DataFrame:
    rows = v.units.select("document_id", F.col("line_no").alias("place"), (F.length("line") > 100).alias("is_start"))
    return review.paragraph_groups(rows).select("document_id", "place", "paragraph")


@query("""SELECT document_id, min(reading_order) AS first, max(reading_order) AS last, count(*) AS n FROM (SELECT *, sum(broken::INT) OVER
      (PARTITION BY document_id ORDER BY reading_order) AS run FROM (SELECT *, is_excluded OR reading_order % 4 = 3 AS broken FROM v_elements))
    WHERE NOT broken GROUP BY document_id, run HAVING count(*) > 1""")
def merge_candidates(v: Views) -> DataFrame:
    return review.merge_candidates(v.elements, "is_excluded OR reading_order % 4 = 3")


@query("""SELECT document_id, CASE WHEN confidence IS NULL OR confidence < 0.65 THEN 'low' WHEN confidence < 0.85 THEN 'medium' ELSE 'high' END AS level,
    count(*) AS n FROM v_elements GROUP BY 1, 2""")
def confidence_buckets(v: Views) -> DataFrame:
    return review.confidence_buckets(v.elements)


@query("""SELECT document_id, count(*) AS elements, sum((version > 1 OR is_excluded)::INT)::BIGINT AS changed,
    sum(CASE WHEN is_excluded THEN 0 ELSE length(text) END)::BIGINT AS chars, avg(confidence) AS mean_confidence FROM v_elements GROUP BY document_id""")
def review_progress(v: Views) -> DataFrame:
    return review.progress(v.elements)


@query("""SELECT document_id, reading_order, CASE WHEN reading_order % 2 = 0 THEN 'new ' || document_id ELSE text END AS text,
    (version + (reading_order % 2 = 0)::INT)::INT AS version FROM v_elements""")
def review_batch_edit(v: Views) -> DataFrame:
    edits = v.elements.where("reading_order % 2 = 0").select(
        "document_id", "reading_order", F.col("version").alias("expected_version"), F.concat(F.lit("new "), F.col("document_id").cast("string")).alias("new_text")
    )
    return review.apply_edits(v.elements, edits).select("document_id", "reading_order", "text", "version")



# Chunks


def _chunk_units(v: Views) -> DataFrame:
    """Lines as units: tables with and without ids, paragraph starts and footers by the number of the line."""
    n, i = F.col("n"), F.col("document_id")
    kind = F.when(n % 9 == 8, "HEADER_FOOTER").when((n % 13).isin(5, 6, 7), F.when(n % 13 == 5, "TABLE_HEADER").otherwise("TABLE_ROW")).when(n % 11 == 3, "HEADING").otherwise("TEXT_LINE")
    text = F.when((n + i) % 7 == 2, F.concat(F.lit("가. "), F.col("text"))).otherwise(F.col("text"))
    table = F.when((n % 13).isin(5, 6, 7) & (i % 3 != 0), F.floor((n + i % 2) / 7).cast("int"))
    return chunking.units_of_lines(v.units).withColumns({"element_type": kind, "text": text, "table_id": table, "is_paragraph_start": n % 4 == 1})


@query("""WITH u AS (
      SELECT document_id, line_no AS n, (line_no + document_id) % 7 = 2 AS listed, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare, line_no % 13 IN (5, 6, 7) AND line_no % 9 <> 8 AS tab, line_no % 11 = 3 AND line_no % 13 NOT IN (5, 6, 7) AS head,
        CASE WHEN line_no % 13 IN (5, 6, 7) AND document_id % 3 <> 0 THEN ((line_no + document_id % 2) // 7)::INT END AS tid, line_no % 4 = 1 AS para FROM v_units WHERE line_no % 9 <> 8),
    w AS (SELECT *, CASE WHEN listed THEN '가. ' || bare ELSE bare END AS text, head AND NOT listed AS title, lag(tab) OVER o AS was, lag(CASE WHEN tab THEN tid END) OVER o AS was_in FROM u WINDOW o AS (PARTITION BY document_id ORDER BY n)),
    g AS (SELECT *, sum((title OR was IS NULL OR CASE WHEN tab THEN CASE WHEN was_in IS NULL THEN NOT was ELSE was_in IS DISTINCT FROM tid END ELSE was_in IS NOT NULL OR para AND NOT listed END)::INT) OVER o AS "group",
        last_value(CASE WHEN title THEN text END IGNORE NULLS) OVER o AS heading FROM w WINDOW o AS (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING))
    SELECT document_id, "group"::INT AS "group", any_value(heading) AS heading, nullif(arg_max(CASE WHEN tab THEN coalesce(tid, -2) ELSE -1 END, n), -2) AS table_id, min(n) AS first, max(n) AS last, count(*) AS units FROM g GROUP BY 1, 2""")
def chunk_groups(v: Views) -> DataFrame:
    found = chunking.chunk_groups(_chunk_units(v))
    last = _chunk_units(v).select("document_id", F.col("n").alias("last"), F.col("element_type").isin(*chunking.TABLE_KINDS).alias("tab"))
    found = found.join(last, ["document_id", "last"])
    return found.select("document_id", "group", "heading", F.when(F.col("tab"), F.col("table_id")).otherwise(-1).alias("table_id"), "first", "last", "units")


@query("""WITH k AS (SELECT document_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS key FROM v_units),
    t AS (SELECT key, count(DISTINCT document_id) AS n FROM k WHERE length(key) <= 80 AND key <> '' GROUP BY key HAVING count(DISTINCT document_id) >= greatest(3, floor((SELECT count(DISTINCT document_id) FROM v_units) * 0.02::DOUBLE + 0.5)))
    SELECT key, n AS groups, (SELECT regexp_replace(arg_min(line, (u.document_id, u.line_no)), '^\\s+|\\s+$', '', 'g') FROM v_units u JOIN k USING (document_id, line_no) WHERE k.key = t.key) AS sample FROM t""")
def noise_report(v: Views) -> DataFrame:
    units = chunking.units_of_lines(v.units).withColumn("element_type", F.lit(chunking.LINE))
    return chunking.noise_report(units, [], ["document_id"], ["document_id", "n"], ratio=0.02)


@query(None)
def chunk_documents(v: Views) -> DataFrame:
    return chunking.chunk_documents(v.units)


@query(None)
def context_assembly(v: Views) -> DataFrame:
    place = F.shiftleft("document_id", 32) + F.col("seq")
    hits = chunking.chunk_documents(v.units).select(
        (F.col("document_id") % 50).alias("query_id"), place.alias("rank"), place.alias("chunk_id"),
        F.concat(F.lit("doc-"), F.col("document_id").cast("string")).alias("filename"), "seq", "text",
    )
    return chunking.assemble_context(hits, 1000)


@query(None)
def hash_embedding(v: Views) -> DataFrame:
    return v.texts.select("document_id", embedding.hashed(F.col("content")).alias("embedding"))


# Layout and access


@query("""SELECT a.document_id, a.line_no AS id, b.reading_order::BIGINT AS other FROM v_units a JOIN (SELECT document_id,
      reading_order, sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY reading_order) - length(text) - 1 AS s,
      sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY reading_order) - 1 AS e FROM v_elements) b
    ON a.document_id = b.document_id AND a.content_start < b.e AND b.s < a.content_end""")
def elements_behind_chunks(v: Views) -> DataFrame:
    chunks = v.units.select("document_id", F.col("line_no").alias("id"), F.col("content_start").alias("start"), F.col("content_end").alias("end"))
    ranges = v.elements.withColumn("s", t.running_offset("document_id", "reading_order", "text"))
    parts = ranges.select("document_id", F.col("reading_order").alias("id"), F.col("s").alias("start"), (F.col("s") + F.length("text")).alias("end"))
    return layout.overlapping(chunks, parts)


_BOX = """SELECT document_id AS page, reading_order AS box, (reading_order % 4) * 0.2::DOUBLE AS x, (reading_order // 4) * 0.1::DOUBLE AS y, 0.15::DOUBLE AS width,
    0.08::DOUBLE AS height, text FROM v_elements"""


def _boxes(v: Views) -> DataFrame:
    place = F.col("reading_order")
    return v.elements.select(
        F.col("document_id").alias("page"), place.alias("box"), ((place % 4) * F.lit(0.2)).alias("x"), (F.floor(place / 4) * F.lit(0.1)).alias("y"),
        F.lit(0.15).alias("width"), F.lit(0.08).alias("height"), "text",
    )


@query(f"""WITH b AS ({_BOX}), c AS (SELECT page, box AS cell, x, y, 0.5::DOUBLE AS width, height FROM b WHERE box % 2 = 0)
    SELECT b.page, box, min(cell) AS cell FROM b JOIN c ON b.page = c.page AND b.x + b.width / 2 BETWEEN c.x AND c.x + c.width
      AND b.y + b.height / 2 BETWEEN c.y AND c.y + c.height GROUP BY 1, 2""")
def boxes_in_cells(v: Views) -> DataFrame:
    cells = _boxes(v).where("box % 2 = 0").select("page", F.col("box").alias("cell"), "x", "y", F.lit(0.5).alias("width"), "height")
    return layout.cell_of_box(_boxes(v), cells)


@query(f"""WITH b AS ({_BOX}) SELECT page, (1 + box // 4)::INT AS line, string_agg(text, ' ' ORDER BY x, box) AS text FROM b GROUP BY 1, 2""")
def box_lines(v: Views) -> DataFrame:
    return layout.text_lines(_boxes(v))


@query(f"""WITH b AS ({_BOX}) SELECT page, (1 + box // 4)::INT AS line, string_agg(text, ' ' ORDER BY x, box) AS text FROM b GROUP BY 1, 2""")
def box_lines_mixed(v: Views) -> DataFrame:
    """Tall boxes and small ones, of which two of a line don't overlap each other."""
    place = F.col("box") % 4
    small = place.isin(1, 2)
    boxes = _boxes(v).withColumns({"y": F.col("y") + F.when(place == 2, 0.055).otherwise(0.0), "height": F.when(small, 0.03).otherwise(0.09)})
    return layout.text_lines(boxes)


@query(f"""WITH b AS ({_BOX}) SELECT page, box // 4 AS "row", string_agg(text, ' | ' ORDER BY box % 4) AS text, min(box) < 4 AS is_header, min(x) AS x, max(x + width) AS x2
    FROM b GROUP BY page, box // 4""")
def layout_table_rows(v: Views) -> DataFrame:
    cells = _boxes(v).withColumns(
        {"table": F.lit(0), "row": F.floor(F.col("box") / 4), "column": F.col("box") % 4, "confidence": F.lit(1.0)}
    )
    return layout.table_rows(cells).select("page", "row", "text", "is_header", "x", "x2")


@query("""WITH l AS (SELECT document_id % 5 AS document_id, document_id AS page, line AS text, line_no, line_no / 10.0::DOUBLE AS y FROM v_units),
    k AS (SELECT *, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\d+', '#', 'g') AS key FROM l WHERE y <= 0.12 OR y >= 0.88),
    p AS (SELECT document_id, count(DISTINCT page) AS pages FROM l GROUP BY 1)
    SELECT document_id, page, line_no FROM k WHERE (document_id, key) IN (SELECT (k.document_id, key) FROM k JOIN p ON k.document_id = p.document_id
      GROUP BY k.document_id, key, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.02 + 0.5)))""")
def header_footer_lines(v: Views) -> DataFrame:
    lines = v.units.select(
        (F.col("document_id") % 5).alias("document_id"), F.col("document_id").alias("page"), F.col("line").alias("text"), "line_no", (F.col("line_no") / F.lit(10.0)).alias("y")
    )
    return layout.headers_and_footers(lines, ratio=0.02).select("document_id", "page", "line_no")


@query(f"""SELECT row_number() OVER (ORDER BY status, created_at DESC) AS place, id, name, status, role, role IN ('OWNER','EDITOR') AS may_edit, role = 'OWNER' AS may_invite FROM v_projects p
    JOIN v_members m ON p.id = m.project_id WHERE user_id = {USER}""")
def project_list(v: Views) -> DataFrame:
    found = access.project_list(v.members, v.projects, USER)
    return found.select("place", "id", "name", "status", "role", access.may(F.col("role"), "edit").alias("may_edit"), access.may(F.col("role"), "invite").alias("may_invite"))


@query("""SELECT invitee_id, id FROM (SELECT event_id AS id, user_id AS invitee_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place
    FROM events WHERE event_type = 'signup' AND event_id % 7 = 3) WHERE place = 1 ORDER BY ts DESC, id DESC LIMIT 10""")
def recent_invitees(v: Views) -> DataFrame:
    events = v.table("events").where("event_type = 'signup'")
    sent = events.select(F.col("event_id").alias("id"), (F.col("event_id") % 7).alias("inviter_id"), F.col("user_id").alias("invitee_id"), F.col("ts").alias("created_at"))
    return access.recent_invitees(sent, 3).select("invitee_id", "id")


@query("""SELECT id, CASE WHEN status = 'FAILED' THEN 'SHOW_ERROR' WHEN status IN ('PENDING','EXTRACTING','ANALYZING') THEN 'SHOW_PROGRESS'
    WHEN review_status IN ('PENDING','IN_PROGRESS') THEN 'REVIEW' WHEN review_status = 'COMPLETED' THEN 'REVIEW_AGAIN' ELSE 'OPEN' END AS action FROM v_documents""")
def primary_action(v: Views) -> DataFrame:
    return v.documents.select("id", documents.primary_action(F.col("status"), F.col("review_status")).alias("action"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_type IN ('view','click') THEN event_type ELSE 'other' END AS category,
    CASE event_id % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'not json ' || event_id ELSE '{"reason":"x"}' END AS reason FROM events""")
def analysis_category(v: Views) -> DataFrame:
    i = F.col("event_id")
    answer = F.when(i % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("category"), F.lit("r").alias("reason")))).when(
        i % 3 == 1, F.concat(F.lit("not json "), i.cast("string"))
    ).otherwise('{"reason":"x"}')
    category, reason = documents.judged_category(F.col("answer"), ["view", "click"], "other")
    return v.table("events").withColumn("answer", answer).select(i.alias("id"), category.alias("category"), reason.alias("reason"))


@query("""SELECT document_id, chunk_id, place FROM (SELECT document_id, chunk_id, (row_number() OVER (PARTITION BY document_id ORDER BY chunk_id))::INT AS place
    FROM v_vectors) WHERE place <= 2""")
def top_chunks_per_document(v: Views) -> DataFrame:
    return documents.top_chunks(v.vectors.withColumn("rank", F.col("chunk_id"))).select("document_id", "chunk_id", "place")


@query("""SELECT id, CASE WHEN id % 2 = 0 AND status = 'PENDING' THEN 'EXTRACTING' WHEN id % 2 = 1 AND status = 'FAILED' THEN 'PENDING' ELSE status END AS status
    FROM v_documents""")
def status_transitions(v: Views) -> DataFrame:
    events = v.documents.select("id", F.when(F.col("id") % 2 == 0, "start").otherwise("retry").alias("event"))
    return documents.next_status(v.documents, events).select("id", "status")



@query(f"""WITH b AS ({_BOX}) SELECT page, box, coalesce(x - lag(x) OVER w >= 0.025 OR y - (lag(y) OVER w + lag(height) OVER w) >=
      0.8::DOUBLE * greatest(lag(height) OVER w, height, 0.01), false) AS suggested FROM b WINDOW w AS (PARTITION BY page ORDER BY box)""")
def paragraph_starts(v: Views) -> DataFrame:
    return review.paragraph_starts(_boxes(v)).select("page", "box", "suggested")



@query(f"""WITH b AS (SELECT *, (box // 4)::INT AS line FROM ({_BOX})) SELECT page, line, string_agg(text, '' ORDER BY x, box) AS text FROM b GROUP BY page, line""")
def box_line_join(v: Views) -> DataFrame:
    return review.joined_boxes(_boxes(v).withColumn("line", F.floor(F.col("box") / 4).cast("int")))
