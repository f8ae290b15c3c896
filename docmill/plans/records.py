"""Queries of stored rows (uploads, chunks, invitations, completed reviews, previews) and of vector lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.operators import access, checks, lifecycle, nearest, reports, uploads
from docmill.operators.storage import scratch
from docmill.plans.registry import SINCE, UNTIL, query
from docmill.plans.views import Views

# Vectors in lists

LISTS = 16
_BASE = "SELECT chunk_id, document_id, project_id, embedding FROM v_vectors WHERE embedding_model = 'base'"


def _lists(v: Views) -> nearest.Lists:
    return nearest.build_lists(v.vectors, "base", scratch(v.spark, "lists"), LISTS)


@query(f"""WITH b AS ({_BASE}), c AS (SELECT row_number() OVER (ORDER BY sha256(chunk_id::VARCHAR), chunk_id) - 1 AS list, embedding AS centre FROM b QUALIFY list < {LISTS}),
    p AS (SELECT list, list_cosine_similarity(embedding, centre) AS s, row_number() OVER (PARTITION BY chunk_id ORDER BY list_cosine_similarity(embedding, centre) DESC, list) AS place FROM b, c)
    SELECT list::INT AS list, count(*) AS n, round(sqrt(greatest(2 - 2 * max(s), 0)), 4) AS least, round(sqrt(greatest(2 - 2 * min(s), 0)), 4) AS most FROM p WHERE place = 1 GROUP BY list""")
def vector_lists(v: Views) -> DataFrame:
    held = _lists(v).members.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("least"), F.max("distance").alias("most"))
    return held.select("list", "n", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"))


_SCORE = "least(list_cosine_similarity(embedding, (SELECT embedding FROM v_vectors WHERE chunk_id = 1)), 1.0)"


@query(f"""SELECT chunk_id, document_id, project_id, round({_SCORE}, 6) AS similarity FROM ({_BASE}) WHERE project_id IN (1, 3, 5) AND document_id < 40 ORDER BY {_SCORE} DESC, chunk_id LIMIT 20""")
def nearest_in_lists(v: Views) -> DataFrame:
    asked = list(v.vectors.where("chunk_id = 1").select("embedding").first()[0])
    hits, _ = nearest.nearest(_lists(v), asked, 20, F.col("project_id").isin(1, 3, 5) & (F.col("document_id") < 40))
    return hits.select("chunk_id", "document_id", "project_id", F.round("score", 6).alias("similarity"))


# Uploads: each page is a file of some type in one of five projects, which have every tenth page already

TYPES, FOLDER, MAX_BYTES = ("REPORT", "CONTRACT", "MINUTES"), "/store", 3000
_UPLOADS = """SELECT page_id AS upload_id, page_id % 5 AS project_id, page_id % 11 AS uploaded_by, 'page-' || page_id || ['.pdf', '.DOCX', '.png', '.txt', '.jpg', '.hwpx'][(page_id % 6 + 1)::INT] AS filename,
    CASE WHEN page_id % 13 <> 0 THEN html ELSE '' END AS content, ['AUTO', 'AUTO', 'text_only', NULL, 'bogus'][(page_id % 5 + 1)::INT] AS strategy,
    [NULL, ' report ', 'Minutes', 'novel', '', NULL, NULL][(page_id % 7 + 1)::INT] AS document_type FROM pages"""
_JUDGED = f"""u AS (SELECT *, lower(split_part(filename, '.', 2)) AS file_type, strlen(content) AS file_size, sha256(content) AS content_hash, upper(coalesce(strategy, 'AUTO')) AS way, nullif(upper(trim(document_type)), '') AS kind FROM ({_UPLOADS})),
    e AS (SELECT *, CASE WHEN file_type = 'txt' THEN 'INVALID_FILE_TYPE' WHEN file_size > {MAX_BYTES} THEN 'FILE_TOO_LARGE' WHEN file_size = 0 THEN 'EXTRACTION_FAILED'
        WHEN way = 'BOGUS' OR (file_type IN ('png', 'jpg') AND way <> 'AUTO') THEN 'INVALID_EXTRACTION_STRATEGY' WHEN kind = 'NOVEL' THEN 'INVALID_DOCUMENT_TYPE' END AS broken FROM u),
    k AS (SELECT DISTINCT page_id % 5 AS project_id, sha256(html) AS content_hash, true AS known FROM pages WHERE page_id % 10 = 0),
    j AS (SELECT e.*, CASE WHEN broken IS NOT NULL THEN broken WHEN known OR upload_id > min(upload_id) FILTER (broken IS NULL) OVER (PARTITION BY e.project_id, e.content_hash) THEN 'DUPLICATE_DOCUMENT' END AS error
        FROM e LEFT JOIN k ON k.project_id = e.project_id AND k.content_hash = e.content_hash)"""


def _judged(v: Views) -> DataFrame:
    i, pages = F.col("page_id"), v.table("pages")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(x) for x in values]), (i % n + 1).cast("int"))
    files = pages.select(
        i.alias("upload_id"), (i % 5).alias("project_id"), (i % 11).alias("uploaded_by"),
        F.concat(F.lit("C:\\files\\page-"), i.cast("string"), pick(6, ".pdf", ".DOCX", ".png", ".txt", ".jpg", ".hwpx")).alias("path"),
        F.when(i % 13 != 0, F.col("html")).otherwise("").alias("content"), pick(5, "AUTO", "AUTO", "text_only", None, "bogus").alias("strategy"),
        pick(7, None, " report ", "Minutes", "novel", "", None, None).alias("document_type"),
    )
    known = pages.where(i % 10 == 0).select((i % 5).alias("project_id"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))
    return uploads.judged_uploads(files, known, TYPES, MAX_BYTES)


@query(f"WITH {_JUDGED} SELECT upload_id, filename, error FROM j")
def upload_errors(v: Views) -> DataFrame:
    return _judged(v).select("upload_id", "filename", "error")


@query(f"""WITH {_JUDGED} SELECT upload_id, project_id, uploaded_by, filename, '{FOLDER}/' || substr(sha256(content_hash || ':' || upload_id), 1, 32) || '.' || file_type AS storage_path, file_type, file_size::BIGINT AS file_size,
    content_hash, kind AS document_type, CASE WHEN kind IS NOT NULL THEN 'USER' END AS document_type_source, 'PENDING' AS status, way AS extraction_strategy, 'NOT_REQUIRED' AS review_status FROM j WHERE error IS NULL""")
def upload_rows(v: Views) -> DataFrame:
    found = uploads.pending_documents(_judged(v), FOLDER).drop("processing_error", "processing_mode")
    return found.withColumn("file_size", F.col("file_size").cast("long"))


@query(f"""SELECT page_id, '{uploads.FAKE_TEXT}' || url AS content, 1 AS page_count, length('{uploads.FAKE_TEXT}' || url)::INT AS char_count, 0 AS ocr_char_count, '{uploads.FAKE_METHOD}' AS extract_method FROM pages""")
def fake_extractions(v: Views) -> DataFrame:
    found = v.table("pages").select("page_id", uploads.fake_extraction(F.col("url")).alias("of"))
    return found.select("page_id", "of.content", "of.page_count", "of.char_count", "of.ocr_char_count", "of.extract_method")


@query("""SELECT * FROM (SELECT document_id AS block_id, i::INT AS line, array_to_string(list_filter(list_transform(string_split(parts[i + 1], ' '), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), ' ') AS content,
      CASE WHEN i % 2 = 0 THEN i ELSE 5 END::DOUBLE AS x, CASE WHEN i % 2 = 0 THEN i + 10 ELSE 7 END::DOUBLE AS y2, 'text' AS source
    FROM (SELECT document_id, parts, unnest(range(len(parts))) AS i FROM (SELECT document_id, string_split(content, chr(10)) AS parts FROM v_texts))) WHERE content <> ''""")
def block_lines(v: Views) -> DataFrame:
    box = lambda i: F.when(i % 2 == 0, F.array(*[x.cast("double") for x in (i, i, i + 10, i + 10)]))
    lines = F.transform(F.split("content", "\n"), lambda line, i: F.struct(box(i).alias("bbox"), F.transform(F.split(line, " "), lambda s: F.concat(F.lit("\t"), s, F.lit(" "))).alias("spans")))
    blocks = v.texts.select(F.col("document_id").alias("block_id"), F.array(*[F.lit(x) for x in (5.0, 5.0, 6.0, 7.0)]).alias("bbox"), lines.alias("lines"))
    return uploads.block_lines(blocks).select("block_id", "line", "content", "x", "y2", "source")


@query("""SELECT u.document_id, project_id, line_no AS seq, length(line)::INT AS char_count, content_start, content_end, 'base' AS embedding_model, (line_no % 3 + 1)::INT AS embedding_dim, (1 + u.document_id % 3)::INT AS text_version
    FROM v_units u JOIN v_documents d ON d.id = u.document_id""")
def chunk_rows(v: Views) -> DataFrame:
    n = F.col("line_no")
    chunks = v.units.select(
        "document_id", n.alias("seq"), F.lit(1).alias("page_number"), F.col("line").alias("text"), F.lit(1).alias("token_count"), "content_start", "content_end",
        F.array_repeat(F.lit(0.5), (n % 3 + 1).cast("int")).alias("embedding"), (1 + F.col("document_id") % 3).cast("int").alias("text_version"),
    )
    return uploads.chunk_rows(chunks, v.documents, "base").drop("page_number", "text", "token_count", "embedding")


@query("""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
    CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-02-01' END AS updated_at FROM customer""")
def stamped_rows(v: Views) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    k, rows = F.col("c_custkey"), v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    before = v.table("customer").where(k % 3 != 0).select(k.alias("id"), F.when(k % 4 != 0, F.col("c_name")).alias("name"), at("2024-01-01").alias("created_at"), at("2024-02-01").alias("updated_at"))
    return uploads.stamped(rows, before, "id", at("2024-05-01"))


# Requests, invitations, reviews


@query("SELECT document_id, reading_order, text FROM v_elements")
def unique_elements(v: Views) -> DataFrame:
    return checks.require_unique(v.elements.select("document_id", "reading_order", "text"), "document_id", "reading_order")


_HELD = """SELECT project_id, invitee_id, arg_min(id, id) AS id, min_by(status, id) AS status FROM (SELECT event_id AS id, event_id % 25 AS project_id, user_id AS invitee_id,
    ['PENDING','ACCEPTED','DECLINED'][event_id % 3 + 1] AS status FROM events WHERE event_type = 'signup') GROUP BY 1, 2"""


@query(f"""WITH h AS ({_HELD}), a AS (SELECT project_id, invitee_id, id, CASE WHEN invitee_id % 6 = 0 THEN 'OWNER' ELSE 'VIEWER' END AS role, CASE WHEN id % 5 = 0 THEN invitee_id ELSE 0 END AS inviter FROM h WHERE id % 2 = 0
      UNION ALL SELECT (project_id + 7) % 25, invitee_id, id, 'EDITOR', 0 FROM h WHERE id % 4 = 1),
    g AS (SELECT a.project_id, a.invitee_id, min(a.id) AS at, arg_min(a.role, a.id) AS role, arg_min(inviter, a.id) AS inviter FROM a LEFT JOIN h ON h.project_id = a.project_id AND h.invitee_id = a.invitee_id
      LEFT JOIN v_members m ON m.project_id = a.project_id AND m.user_id = a.invitee_id WHERE inviter <> a.invitee_id AND m.user_id IS NULL AND a.role <> 'OWNER' AND h.status IS DISTINCT FROM 'PENDING' GROUP BY 1, 2)
    SELECT h.id, coalesce(h.project_id, g.project_id) AS project_id, coalesce(h.invitee_id, g.invitee_id) AS invitee_id, CASE WHEN g.at IS NOT NULL THEN inviter ELSE 99 END::BIGINT AS invited_by, coalesce(g.role, 'EDITOR') AS role,
      CASE WHEN g.at IS NOT NULL THEN 'PENDING' ELSE status END AS status, coalesce(g.at, h.id) AS created_at, CASE WHEN g.at IS NULL AND status <> 'PENDING' THEN h.id + 1 END AS responded_at
    FROM h FULL JOIN g ON g.project_id = h.project_id AND g.invitee_id = h.invitee_id""")
def invitations_stored(v: Views) -> DataFrame:
    i = F.col("event_id")
    states = F.array(*map(F.lit, ("PENDING", "ACCEPTED", "DECLINED")))
    every = v.table("events").where("event_type = 'signup'").select(i.alias("id"), (i % 25).alias("project_id"), F.col("user_id").alias("invitee_id"), F.element_at(states, (i % 3 + 1).cast("int")).alias("status"))
    held = every.groupBy("project_id", "invitee_id").agg(F.min("id").alias("id"), F.min_by("status", "id").alias("status"))
    stored = held.select("id", "project_id", "invitee_id", F.lit(99).cast("long").alias("invited_by"), F.lit("EDITOR").alias("role"), "status", F.col("id").alias("created_at"), F.when(F.col("status") != "PENDING", F.col("id") + 1).alias("responded_at"))
    who = F.col("invitee_id")
    one = held.where("id % 2 = 0").select("project_id", "invitee_id", F.when(F.col("id") % 5 == 0, who).otherwise(0).cast("long").alias("inviter_id"), F.when(who % 6 == 0, "OWNER").otherwise("VIEWER").alias("role"), F.col("id").alias("at"))
    two = held.where("id % 4 = 1").select(((F.col("project_id") + 7) % 25).alias("project_id"), "invitee_id", F.lit(0).cast("long").alias("inviter_id"), F.lit("EDITOR").alias("role"), F.col("id").alias("at"))
    return access.invited(stored, v.members, one.unionByName(two))


def _completed(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviews of even documents are completed; every fourth element was left out before."""
    columns = ("document_id", "reading_order", "text", "version", "is_excluded", "is_deleted")
    elements, contents = lifecycle.start_review(v.elements.select(*columns).withColumn("is_excluded", F.col("reading_order") % 4 == 2))
    long = lambda: F.lit(None).cast("long")
    contents = contents.withColumns({"ocr_char_count": F.lit(0).cast("long"), "is_confirmed": F.lit(False), "confirmed_by": long(), "confirmed_at": long()})
    documents = v.documents.select("id", "review_status", long().alias("reviewed_by"), long().alias("reviewed_at"))
    done = v.documents.where("id % 2 = 0").select(F.col("id").alias("document_id"), (F.col("id") % 9).alias("user_id"), (F.col("id") * 10).alias("at"))
    return lifecycle.completed_reviews(documents, contents, elements, done)


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN 'COMPLETED' ELSE review_status END AS review_status, CASE WHEN id % 2 = 0 THEN id % 9 END AS reviewed_by, CASE WHEN id % 2 = 0 THEN id * 10 END AS reviewed_at FROM v_documents""")
def reviews_completed(v: Views) -> DataFrame:
    return _completed(v)[0]


@query("""WITH x AS (SELECT document_id, string_agg(text, chr(10) ORDER BY reading_order) AS whole, string_agg(CASE WHEN reading_order % 4 = 2 THEN '' ELSE text END, chr(10) ORDER BY reading_order) AS part,
      sum(length(text)) FILTER (reading_order % 4 <> 2)::BIGINT AS n FROM v_elements GROUP BY document_id)
    SELECT document_id, CASE WHEN d.id IS NOT NULL THEN part ELSE whole END AS content, CASE WHEN d.id IS NOT NULL AND part <> whole THEN 2 ELSE 1 END AS text_version, CASE WHEN d.id IS NOT NULL THEN n ELSE 0 END AS ocr_char_count,
      d.id IS NOT NULL AS is_confirmed, d.id % 9 AS confirmed_by, d.id * 10 AS confirmed_at FROM x LEFT JOIN (SELECT id FROM v_documents WHERE id % 2 = 0) d ON d.id = document_id""")
def reviews_completed_texts(v: Views) -> DataFrame:
    return _completed(v)[1].drop("char_count")


# Previews of all projects


def _previews_sql(kind: str) -> str:
    everything, period = kind in ("WEEKLY_REPORT", "PROJECT_STATUS"), kind in reports.NEEDS_PERIOD
    within = lambda c: f"{c} BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'" if period else "true"
    n = lambda view, cond: f"(SELECT count(*) FROM {view} x WHERE x.project_id = p.id AND ({cond}))"
    rest = lambda cond: cond if everything else "false"
    ends = f"{within('starts_on')} OR coalesce({within('ends_on')}, false)" if period else "true"
    bounds = (f"DATE '{SINCE}'", f"DATE '{UNTIL}'") if period else ("NULL::DATE", "NULL::DATE")
    agenda = " AND status = 'PENDING'" if kind == "MEETING_AGENDA" else ""
    waiting = " + ".join(n(view, "decision = 'PENDING'") for view in ("v_amount_items", "v_decisions", "v_schedule"))
    return f"""SELECT p.id AS project_id, '{kind}' AS kind, {bounds[0]} AS period_from, {bounds[1]} AS period_to, {n("v_documents", rest(within("created_at::DATE")))} AS documents, {n("v_decisions", within("decided_on") + agenda)} AS decisions,
      {n("v_schedule", rest(ends))} AS schedule_items, {n("v_amount_items", rest(within("uploaded_on")))} AS amount_items, {waiting} AS pending_suggestions, {str(period).lower()} AS needs_period, '{reports.NOTHING[kind]}' AS nothing
      FROM (SELECT id FROM v_projects UNION ALL SELECT 1000 UNION ALL SELECT 1001) p"""


@query(f"""SELECT project_id, kind, period_from, period_to, documents, decisions, schedule_items, amount_items, pending_suggestions, documents + decisions + schedule_items + amount_items > 0 AS can_generate,
    CASE WHEN documents + decisions + schedule_items + amount_items = 0 THEN CASE WHEN pending_suggestions > 0 THEN '{reports.WAITING[0]}' || pending_suggestions || '{reports.WAITING[1]}' ELSE nothing END END AS blocked_reason,
    needs_period, 'completed_tasks' AS uncountable FROM ({" UNION ALL ".join(map(_previews_sql, reports.REPORT_KINDS))})""")
def report_previews(v: Views) -> DataFrame:
    """All kinds for all projects, and for two that have nothing."""
    projects = v.projects.select("id").unionByName(v.spark.range(1000, 1002))
    found = None
    for kind in reports.REPORT_KINDS:
        rows = reports.report_previews(projects, v.documents, v.decisions, v.schedule, v.amount_items, kind, SINCE, UNTIL)
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("uncountable", F.array_join("uncountable", ","))
