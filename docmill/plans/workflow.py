"""Queries of the review life cycle, members, geometry and small checks, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.functions import formats
from docmill.functions import text as t
from docmill.operators import access, analysis, checks, documents, geometry, lifecycle, review, search
from docmill.plans.registry import PROJECT, USER, query
from docmill.plans.views import Views

# The review life cycle: every element is in its document's text at first, joined by newlines

STATE = ("document_id", "reading_order", "text", "version", "is_excluded", "is_deleted")


def _review(v: Views) -> tuple[DataFrame, DataFrame]:
    return lifecycle.start_review(v.elements.select(*STATE).withColumn("is_excluded", F.lit(False)))


def _requests(v: Views, rest: int, **flag: bool) -> DataFrame:
    asked = v.elements.where(F.col("reading_order") % 4 == rest).select("document_id", "reading_order", "version")
    return asked.withColumns({k: F.lit(x) for k, x in flag.items()})


@query("SELECT document_id, reading_order, reading_order % 4 = 1 AS is_excluded, version + (reading_order % 4 = 1)::INT AS version FROM v_elements")
def review_exclusion(v: Views) -> DataFrame:
    elements, _ = _review(v)
    return lifecycle.set_exclusion(elements, _requests(v, 1, exclude=True)).select("document_id", "reading_order", "is_excluded", "version")


_WITHOUT = """SELECT document_id, string_agg(CASE WHEN reading_order % 4 = {0} THEN '' ELSE text END, chr(10) ORDER BY reading_order) AS content FROM v_elements GROUP BY document_id"""


@query(f"""SELECT document_id, content, length(content)::INT AS char_count, (1 + (content <> whole)::INT)::INT AS text_version FROM ({_WITHOUT.format(1)})
    JOIN (SELECT document_id, string_agg(text, chr(10) ORDER BY reading_order) AS whole FROM v_elements GROUP BY document_id) USING (document_id)""")
def review_deletion(v: Views) -> DataFrame:
    _, contents = lifecycle.set_deletion(*_review(v), _requests(v, 1, delete=True))
    return contents


_MOVED = """SELECT document_id, reading_order, (a - coalesce(sum(CASE WHEN gone THEN n ELSE 0 END) OVER w, 0))::BIGINT AS content_start,
    CASE WHEN gone THEN 0 ELSE n END AS n, gone FROM (SELECT document_id, reading_order, length(text) AS n, reading_order % 4 = 1 AS gone,
      coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM v_elements)
    WINDOW w AS (PARTITION BY document_id ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"SELECT document_id, reading_order, content_start, (content_start + n)::BIGINT AS content_end, NOT gone AS is_in_content, gone AS is_deleted FROM ({_MOVED})")
def review_deletion_ranges(v: Views) -> DataFrame:
    elements, _ = lifecycle.set_deletion(*_review(v), _requests(v, 1, delete=True))
    return elements.select("document_id", "reading_order", "content_start", "content_end", "is_in_content", "is_deleted")


@query("""SELECT document_id, string_agg(text, chr(10) ORDER BY reading_order) AS content, (1 + 2 * max((reading_order % 4 = 1 AND text <> '')::INT))::INT AS text_version
    FROM v_elements GROUP BY document_id""")
def review_restore(v: Views) -> DataFrame:
    elements, contents = lifecycle.set_deletion(*_review(v), _requests(v, 1, delete=True))
    again = elements.where("is_deleted").select("document_id", "reading_order", "version", F.lit(False).alias("delete"))
    _, contents = lifecycle.set_deletion(elements, contents, again)
    return contents.select("document_id", "content", "text_version")


@query("""SELECT document_id, concat(string_agg(text, chr(10) ORDER BY reading_order), chr(10), 'added ', document_id) AS content, max(reading_order) + 1 AS place,
    sum(length(text) + 1)::BIGINT AS content_start FROM v_elements GROUP BY document_id""")
def review_create(v: Views) -> DataFrame:
    elements, contents = _review(v)
    new = contents.select("document_id", F.concat(F.lit("added "), F.col("document_id").cast("string")).alias("text"))
    grown, texts = lifecycle.create_elements(elements, contents, new)
    last = grown.where(F.startswith("text", F.lit("added "))).select("document_id", F.col("reading_order").alias("place"), "content_start")
    return texts.select("document_id", "content").join(last, "document_id")


@query(f"""SELECT document_id, content, coalesce(kept, 0)::BIGINT AS ocr_char_count FROM ({_WITHOUT.format(2)}) LEFT JOIN
    (SELECT document_id, sum(length(text)) AS kept FROM v_elements WHERE reading_order % 4 <> 2 GROUP BY document_id) USING (document_id)""")
def review_complete(v: Views) -> DataFrame:
    elements, contents = _review(v)
    elements, contents = lifecycle.complete_review(lifecycle.set_exclusion(elements, _requests(v, 2, exclude=True)), contents)
    kept = contents.join(lifecycle.kept_chars(elements), "document_id", "left")
    return kept.select("document_id", "content", F.coalesce("ocr_char_count", F.lit(0)).cast("long").alias("ocr_char_count"))


@query("""SELECT id, CASE WHEN n > 0 AND review_status IN ('PENDING','COMPLETED') THEN 'IN_PROGRESS' ELSE review_status END AS review_status,
    (ocr_revision + coalesce(n, 0))::BIGINT AS ocr_revision FROM v_documents LEFT JOIN
    (SELECT document_id AS id, count(*) AS n FROM v_elements WHERE reading_order % 4 = 1 GROUP BY 1) USING (id)""")
def review_in_progress(v: Views) -> DataFrame:
    return lifecycle.mark_in_progress(v.documents, _requests(v, 1)).select("id", "review_status", "ocr_revision")


@query("""SELECT document_id, reading_order, text, is_in_content FROM (SELECT document_id, reading_order, text, reading_order % 4 <> 2 AS is_in_content, is_excluded FROM v_elements)
    WHERE NOT is_excluded AND is_in_content""")
def elements_in_content(v: Views) -> DataFrame:
    elements = v.elements.withColumn("is_in_content", F.col("reading_order") % 4 != 2)
    return review.in_content(elements).select("document_id", "reading_order", "text", "is_in_content")


_OPERATIONS = """SELECT document_id * 100 + reading_order AS id, document_id, reading_order AS survivor, (1 + reading_order % 2)::INT AS merged_version,
    reading_order + 1 AS selected, reading_order % 5 = 4 AS undone FROM v_elements WHERE reading_order < 8"""


@query(f"""SELECT o.id, project_id, o.document_id, survivor, selected::INT AS selected FROM ({_OPERATIONS}) o
    JOIN v_elements e ON e.document_id = o.document_id AND e.reading_order = survivor AND e.version = merged_version JOIN v_documents d ON d.id = o.document_id WHERE NOT undone""")
def undoable_merges(v: Views) -> DataFrame:
    place = F.col("reading_order")
    ids = F.to_json(F.struct(F.sequence(F.lit(0), place.cast("int")).alias("selected_ids")))
    at = F.timestamp_seconds(F.col("document_id") * 100 + place)
    operations = v.elements.where("reading_order < 8").select(
        (F.col("document_id") * 100 + place).alias("id"), "document_id", place.alias("survivor"), (1 + place % 2).cast("int").alias("merged_version"),
        ids.alias("snapshot_json"), at.alias("created_at"), F.when(place % 5 == 4, at).alias("undone_at"),
    )
    return lifecycle.undoable_merges(operations, v.elements, v.documents).drop("created_at")


@query(f"""SELECT a.id, a.document_id FROM v_analyses a JOIN v_documents d ON d.id = a.document_id WHERE project_id = {PROJECT} ORDER BY a.created_at DESC, a.id DESC LIMIT 50""")
def latest_structure_events(v: Views) -> DataFrame:
    return lifecycle.latest_events(v.analyses, v.documents, PROJECT).select("id", "document_id")


def _paged(v: Views) -> tuple[DataFrame, DataFrame]:
    """Pages of ten elements each, and elements by their page."""
    page = F.col("document_id") * 1000 + F.floor(F.col("reading_order") / 10)
    elements = v.elements.select((F.col("document_id") * 100_000 + F.col("reading_order")).alias("element_id"), page.alias("page_id"), "reading_order", "text", "version")
    pages = v.elements.select(page.alias("page_id"), "document_id", F.floor(F.col("reading_order") / 10).alias("page_number")).distinct()
    return pages, elements


@query("""SELECT document_id * 100000 + reading_order AS element_id, document_id, project_id, c_name AS editor FROM v_elements e JOIN v_documents d ON d.id = document_id
    LEFT JOIN customer ON c_custkey = document_id * 3 WHERE e.version > 1""")
def revisions_with_editors(v: Views) -> DataFrame:
    pages, elements = _paged(v)
    revisions = elements.where("version > 1").select("element_id", (F.floor(F.col("element_id") / 100_000) * 3).alias("changed_by"))
    users = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return lifecycle.revisions_with_editors(revisions, elements, pages, v.documents, users).select("element_id", "document_id", "project_id", "editor")


@query(f"""SELECT document_id * 100000 + reading_order AS element_id, document_id * 1000 + reading_order // 10 AS page_id FROM v_elements
    JOIN v_documents d ON d.id = document_id WHERE project_id = {PROJECT}""")
def scoped_elements(v: Views) -> DataFrame:
    pages, elements = _paged(v)
    return lifecycle.scoped_elements(elements, pages, v.documents.where(F.col("project_id") == PROJECT)).select("element_id", "page_id")


@query("""SELECT document_id * 1000 + reading_order // 10 AS page_id, count(*)::INT AS n, string_agg(text, '|' ORDER BY reading_order) AS texts FROM v_elements GROUP BY 1""")
def pages_with_elements(v: Views) -> DataFrame:
    found = lifecycle.pages_with_elements(*_paged(v))
    return found.select("page_id", F.size("elements").alias("n"), F.array_join(F.transform("elements", lambda e: e["text"]), "|").alias("texts"))


@query("""SELECT document_id, reading_order, (row_number() OVER (PARTITION BY document_id ORDER BY -(reading_order // 10), reading_order))::INT AS place FROM v_elements""")
def reading_places(v: Views) -> DataFrame:
    number = -F.floor(F.col("reading_order") / 10)
    rows = v.elements.select("document_id", "reading_order", number.alias("page_number"), number.alias("page_id"))
    return lifecycle.reading_places(rows).select("document_id", "reading_order", "place")


@query("""SELECT document_id * 100000 + reading_order AS id, CASE WHEN reading_order % 3 = 0 THEN text || '!' END AS text, CASE WHEN reading_order % 2 = 0 THEN version + 1 END AS version,
    (CASE WHEN reading_order % 3 = 0 AND text || '!' <> text THEN 1 ELSE 0 END + (reading_order % 2 = 0)::INT)::INT AS n FROM v_elements
    WHERE reading_order % 2 = 0 OR (reading_order % 3 = 0 AND text || '!' <> text)""")
def change_sets(v: Views) -> DataFrame:
    place = F.col("reading_order")
    before = v.elements.select((F.col("document_id") * 100_000 + place).alias("id"), place, "text", "version")
    after = before.select("id", F.when(place % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), (F.col("version") + F.when(place % 2 == 0, 1).otherwise(0)).alias("version"))
    return lifecycle.change_sets(before.drop("reading_order"), after, "id", ["text", "version"]).select("id", "text", "version", F.size("changed").alias("n"))


# Members and invitations: events of sign-up stand for invitations


def _invitations(v: Views) -> DataFrame:
    states = F.array(*map(F.lit, ("PENDING", "ACCEPTED", "DECLINED")))
    return v.table("events").where("event_type = 'signup'").select(
        F.col("event_id").alias("id"), (F.col("event_id") % 25).cast("int").alias("project_id"), F.col("user_id").alias("invitee_id"),
        F.element_at(states, (F.col("event_id") % 3 + 1).cast("int")).alias("status"), F.lit("EDITOR").alias("role"), F.col("ts").alias("created_at"),
    )


_INVITATIONS = """SELECT event_id AS id, event_id % 25 AS project_id, user_id AS invitee_id, ['PENDING','ACCEPTED','DECLINED'][event_id % 3 + 1] AS status, ts AS created_at
    FROM events WHERE event_type = 'signup'"""


@query(f"""SELECT i.id, invitee_id, p.name AS project_name FROM ({_INVITATIONS}) i JOIN v_projects p ON p.id = project_id
    WHERE i.status = 'PENDING' AND p.status = 'ACTIVE' AND invitee_id = 8""")
def pending_invitations(v: Views) -> DataFrame:
    return access.pending_invitations(_invitations(v), v.projects, 8).select("id", "invitee_id", "project_name")


@query(f"SELECT user_id, c_name AS name, role FROM v_members JOIN customer ON c_custkey = user_id WHERE project_id = {PROJECT}")
def project_members(v: Views) -> DataFrame:
    users = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return access.project_members(v.members.withColumn("invited_at", F.col("user_id") % 5), users, PROJECT).select("user_id", "name", "role")


@query(f"""WITH i AS (SELECT project_id, invitee_id, min(status) AS was FROM ({_INVITATIONS}) GROUP BY 1, 2),
    a AS (SELECT c_custkey AS invitee_id, c_nationkey AS project_id, CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE 0 END AS inviter_id,
      CASE WHEN c_custkey % 7 = 0 THEN 'OWNER' ELSE 'EDITOR' END AS role FROM customer)
    SELECT a.project_id, a.invitee_id, CASE WHEN inviter_id = a.invitee_id OR m.user_id IS NOT NULL THEN 'DUPLICATE_MEMBER' WHEN a.role = 'OWNER' THEN 'OWNER_ROLE_RESERVED'
      WHEN was = 'PENDING' THEN 'DUPLICATE_INVITATION' WHEN was IS NOT NULL THEN 'RESET' ELSE 'NEW' END AS outcome
    FROM a LEFT JOIN v_members m ON m.project_id = a.project_id AND m.user_id = a.invitee_id LEFT JOIN i ON i.project_id = a.project_id AND i.invitee_id = a.invitee_id""")
def invitation_outcomes(v: Views) -> DataFrame:
    held = _invitations(v).groupBy("project_id", "invitee_id").agg(F.min("status").alias("status"))
    key = F.col("c_custkey")
    asked = v.table("customer").select(
        F.col("c_nationkey").alias("project_id"), key.alias("invitee_id"), F.when(key % 10 == 0, key).otherwise(0).alias("inviter_id"),
        F.when(key % 7 == 0, "OWNER").otherwise("EDITOR").alias("role"),
    )
    return access.invite(held, v.members, asked).select("project_id", "invitee_id", "outcome")


@query(f"""SELECT id, CASE WHEN status = 'PENDING' AND id % 2 = 0 THEN 'ACCEPTED' WHEN status = 'PENDING' THEN 'CANCELED' ELSE status END AS status FROM ({_INVITATIONS})""")
def invitation_answers(v: Views) -> DataFrame:
    held = _invitations(v)
    answers = held.where("status = 'PENDING'").select("id", F.when(F.col("id") % 2 == 0, "ACCEPTED").otherwise("CANCELED").alias("answer"))
    return access.answer(held, answers).select("id", "status")


@query(f"""WITH x AS (SELECT DISTINCT project_id, invitee_id AS user_id FROM ({_INVITATIONS}) WHERE status = 'ACCEPTED')
    SELECT project_id, user_id, role FROM v_members UNION ALL SELECT project_id, user_id, 'EDITOR' FROM x WHERE (project_id, user_id) NOT IN (SELECT (project_id, user_id) FROM v_members)""")
def accepted_members(v: Views) -> DataFrame:
    return access.accepted_members(v.members, _invitations(v).dropDuplicates(["project_id", "invitee_id", "status"]))


@query("""WITH o AS (SELECT project_id, min(user_id) AS owner_id FROM v_members GROUP BY 1)
    SELECT project_id, user_id, CASE WHEN user_id % 11 = 1 AND user_id <> owner_id THEN 'VIEWER' ELSE role END AS role FROM v_members JOIN o USING (project_id)
    WHERE NOT (user_id % 11 = 0 AND user_id <> owner_id)""")
def changed_members(v: Views) -> DataFrame:
    owners = v.members.groupBy("project_id").agg(F.min("user_id").alias("user_id"))
    rest = F.col("user_id") % 11
    changes = v.members.where(rest <= 2).select("project_id", "user_id", F.when(rest == 1, "VIEWER").when(rest == 2, "OWNER").alias("new_role"))
    return access.change_member(v.members, owners, changes)


# Search with the names of what is found


@query("""WITH s AS (SELECT chunk_id, document_id, project_id, least(list_cosine_similarity(embedding, (SELECT embedding FROM v_vectors WHERE chunk_id = 1)), 1.0) AS score
      FROM v_vectors WHERE embedding_model = 'base' AND document_id = 7)
    SELECT chunk_id, filename, p.name AS project_name, round(score, 6) AS similarity FROM s JOIN v_documents d ON d.id = document_id JOIN v_projects p ON p.id = s.project_id
    WHERE score >= 0.0 ORDER BY score DESC, chunk_id LIMIT 20""")
def vector_search_named(v: Views) -> DataFrame:
    query_vector = list(v.vectors.where("chunk_id = 1").select("embedding").first()[0])
    found = search.vector_topk(v.vectors, query_vector, "base", list(range(25)), 20, minimum=0.0, document_id=7)
    return search.with_names(found, v.documents, v.projects).select("chunk_id", "filename", "project_name", "similarity")


@query(f"SELECT i::INT AS project_id FROM generate_series(0, 40) AS g(i) WHERE i % 2 = 0 AND i NOT IN (SELECT project_id FROM v_members WHERE user_id = {USER})")
def missing_projects(v: Views) -> DataFrame:
    asked = v.spark.range(0, 41, 2).select(F.col("id").cast("int").alias("project_id"))
    return checks.missing(asked.unionByName(asked), search.resolve_scope(v.members, USER), "project_id")


# Geometry

_WIDE = """SELECT document_id AS page, reading_order AS box, (reading_order % 5) * 0.25::DOUBLE AS x, (reading_order // 3) * 0.5::DOUBLE AS y,
    0.125::DOUBLE * (1 + reading_order % 2) AS width, 0.0625::DOUBLE * (1 + document_id % 3) AS height, text FROM v_elements"""


def _wide(v: Views) -> DataFrame:
    place = F.col("reading_order")
    return v.elements.select(
        F.col("document_id").alias("page"), place.alias("box"), ((place % 5) * F.lit(0.25)).alias("x"), (F.floor(place / 3) * F.lit(0.5)).alias("y"),
        (F.lit(0.125) * (1 + place % 2)).alias("width"), (F.lit(0.0625) * (1 + F.col("document_id") % 3)).alias("height"), "text",
    )


@query(f"""WITH b AS ({_WIDE}), i AS (SELECT page, box AS image, x, y, x + 0.5 AS x2, y + 0.25 * (box % 4) AS y2 FROM b WHERE box % 2 = 0)
    SELECT page, image FROM i WHERE (SELECT count(*) FROM b WHERE b.page = i.page AND (b.x + (b.x + b.width)) / 2 BETWEEN i.x AND i.x2 AND (b.y + (b.y + b.height)) / 2 BETWEEN i.y AND i.y2) < 2""")
def images_without_overlay(v: Views) -> DataFrame:
    boxes = _wide(v)
    images = boxes.where("box % 2 = 0").select("page", F.col("box").alias("image"), "x", "y", (F.col("x") + 0.5).alias("x2"), (F.col("y") + 0.25 * (F.col("box") % 4)).alias("y2"))
    texts = boxes.select("page", "x", "y", (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("height")).alias("y2"))
    return geometry.images_without_overlay(images, texts).select("page", "image")


@query(f"""WITH b AS ({_WIDE}), p AS (SELECT page, box, greatest(0.0, least(x * 64, 40.0)) AS l, greatest(0.0, least(y * 64, 30.0)) AS t, (x + width) * 64 AS r, (y + height) * 64 AS d FROM b WHERE trim(text) <> '')
    SELECT page, box, 8 + l * 2.0 AS x, 16 + t * 4.0 AS y, 8 + greatest(l, least(r, 40.0)) * 2.0 AS x2, 16 + greatest(t, least(d, 30.0)) * 4.0 AS y2 FROM p""")
def boxes_on_page(v: Views) -> DataFrame:
    size = {"image_width": 40.0, "image_height": 30.0, "page_x": 8.0, "page_y": 16.0, "page_x2": 88.0, "page_y2": 136.0}
    pixels = _wide(v).select(
        "page", "box", "text", (F.col("x") * 64).alias("x"), (F.col("y") * 64).alias("y"),
        ((F.col("x") + F.col("width")) * 64).alias("x2"), ((F.col("y") + F.col("height")) * 64).alias("y2"),
    )
    return geometry.to_page(pixels.withColumns({k: F.lit(x) for k, x in size.items()})).select("page", "box", "x", "y", "x2", "y2")


@query(f"""WITH b AS ({_WIDE}) SELECT page, reached AS gap_start, y AS gap_end FROM (SELECT page, y, max(y + height) OVER (PARTITION BY page ORDER BY y, y + height, box
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM b) WHERE y > reached""")
def projection_gaps(v: Views) -> DataFrame:
    return geometry.gaps(_wide(v).select("page", F.col("y").alias("start"), (F.col("y") + F.col("height")).alias("end")))


@query(f"""WITH b AS ({_WIDE}), p AS (SELECT page, box, x, y, width w, height h, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(width) OVER o AS pw, lag(height) OVER o AS ph FROM b
      WINDOW o AS (PARTITION BY page ORDER BY box))
    SELECT page, box, CASE WHEN px IS NOT NULL THEN (greatest(0, least(x + w, px + pw) - greatest(x, px)) / greatest(least(w, pw), 0.001) >= 0.35
        AND greatest(0, greatest(y, py) - least(y + h, py + ph)) <= greatest(h, ph) * 3) OR (greatest(0, least(y + h, py + ph) - greatest(y, py)) / greatest(least(h, ph), 0.001) >= 0.5
        AND greatest(0, greatest(x, px) - least(x + w, px + pw)) <= greatest(h, ph) * 3) END AS joins FROM p""")
def mergeable_boxes(v: Views) -> DataFrame:
    return geometry.mergeable(_wide(v)).select("page", "box", "joins")


@query("""WITH w AS (SELECT document_id AS cell, line_no AS line, CASE WHEN document_id % 2 = 0 THEN line[1] ELSE line END AS text FROM v_units)
    SELECT cell, CASE WHEN max(length(trim(text))) = 1 THEN string_agg(trim(text), '' ORDER BY line) ELSE string_agg(trim(text), ' ' ORDER BY line) END AS text
    FROM w WHERE trim(text) <> '' GROUP BY cell""")
def cell_texts(v: Views) -> DataFrame:
    text = F.when(F.col("document_id") % 2 == 0, F.substring("line", 1, 1)).otherwise(F.col("line"))
    return geometry.cell_text(v.units.select(F.col("document_id").alias("cell"), F.col("line_no").alias("line"), text.alias("text"))).where("text <> ''")


@query(f"""WITH b AS (SELECT *, CASE WHEN box % 3 = 0 THEN box % 2 END AS block FROM ({_WIDE})), u AS (SELECT *, coalesce('b' || block, 't' || box) AS unit FROM b),
    m AS (SELECT *, min(y) OVER k AS uy, min(x) OVER k AS ux FROM u WINDOW k AS (PARTITION BY page, unit))
    SELECT page, box, (row_number() OVER (PARTITION BY page ORDER BY uy, ux, unit, box))::INT AS place FROM m""")
def block_order(v: Views) -> DataFrame:
    boxes = _wide(v).withColumns({"block": F.when(F.col("box") % 3 == 0, F.col("box") % 2), "inner": F.col("box")})
    return geometry.block_order(boxes)


@query(f"SELECT page, median(height) AS median_height FROM (SELECT page, height * (1 + box % 3) AS height FROM ({_WIDE})) GROUP BY page")
def median_heights(v: Views) -> DataFrame:
    return geometry.median_heights(_wide(v).withColumn("height", F.col("height") * (1 + F.col("box") % 3)))


@query(f"""SELECT page, box, (x + (x + width)) / 2 AS center_x, (y + (y + height)) / 2 AS center_y, greatest((x + width) - x, 0.0::DOUBLE) AS box_width,
    greatest((y + height) - y, 0.0::DOUBLE) AS box_height FROM ({_WIDE})""")
def box_scalars(v: Views) -> DataFrame:
    boxes = _wide(v).withColumns({"x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height")})
    return geometry.scalars(boxes).select("page", "box", "center_x", "center_y", "box_width", "box_height")


# Checks, reports and formats


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_ids(v: Views) -> DataFrame:
    return checks.repeated_keys(v.table("lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'EXTRACTION_FAILED' WHEN doc_id % 3 = 0 AND doc_id % 50 > 30 THEN 'TOO_MANY_PAGES'
    WHEN doc_id % 3 = 1 AND length(text) > 3000 THEN 'CONTENT_TOO_LARGE' END AS error FROM documents""")
def extraction_limits(v: Views) -> DataFrame:
    i = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("pdf"), F.lit("docx"), F.lit("png")), (i % 3 + 1).cast("int"))
    return v.table("documents").select("doc_id", checks.extraction_error(kind, F.col("text"), i % 50, 30, 3000).alias("error"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 OR (doc_id % 3 = 2 AND doc_id % 4 <> 0) THEN 'INVALID_EXTRACTION_STRATEGY' ELSE ['AUTO','TEXT_ONLY','TEXT_WITH_IMAGE_OCR'][doc_id % 4 + 1] END AS strategy,
    CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'RFP' WHEN 2 THEN 'REPORT' WHEN 3 THEN NULL ELSE 'INVALID_DOCUMENT_TYPE' END AS document_type FROM documents""")
def normalized_requests(v: Views) -> DataFrame:
    i = F.col("doc_id")
    pick = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (i % n + 1).cast("int"))
    strategy = checks.strategy(pick(3, "pdf", "docx", "png"), pick(4, "auto", "Text_Only", "TEXT_WITH_IMAGE_OCR", "other"), ("AUTO", "TEXT_ONLY", "TEXT_WITH_IMAGE_OCR"))
    kind = checks.document_type(F.when(i % 5 != 0, pick(5, "", "rfp", " report ", "  ", "poem")), ("RFP", "PROPOSAL", "CONTRACT", "REPORT"))
    return v.table("documents").select("doc_id", strategy.alias("strategy"), kind.alias("document_type"))


@query(f"SELECT page, box, CASE WHEN NOT (x + width <= 1 AND y + height <= 1) THEN 'INVALID_BOX' END AS error FROM ({_WIDE})")
def box_errors(v: Views) -> DataFrame:
    error = checks.box_error(*(F.col(c) for c in ("x", "y", "width", "height")))
    return _wide(v).select("page", "box", error.alias("error"))


@query("""SELECT 'documents' AS name, count(*) AS n FROM v_documents WHERE id % 3 <> 0 UNION ALL SELECT 'texts', count(*) FROM v_texts WHERE document_id % 3 <> 0
    UNION ALL SELECT 'elements', count(*) FROM v_elements WHERE document_id % 3 <> 0""")
def deleted_with_cascade(v: Views) -> DataFrame:
    gone = v.documents.where("id % 3 = 0").select(F.col("id").alias("document_id"))
    # every document that an element names may be gone too
    gone = gone.unionByName(v.elements.where("document_id % 3 = 0").select("document_id"))
    left = checks.without_document({"documents": v.documents, "texts": v.texts, "elements": v.elements}, gone)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT project_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'FAILED') AS failed, 0::BIGINT AS unknown FROM v_documents
    GROUP BY project_id""")
def status_vector(v: Views) -> DataFrame:
    return checks.counts_of(v.documents, "project_id", "status", ["PENDING", "FAILED", "UNKNOWN"])


@query("""SELECT document_id, analyzer_type, arg_max(id, created_at) AS id, max(created_at) AS created_at FROM v_analyses GROUP BY 1, 2""")
def latest_by_type(v: Views) -> DataFrame:
    return checks.latest_by_type(v.analyses).select("document_id", "analyzer_type", "id", "created_at")


@query("""WITH n AS (SELECT document_id, arg_max(json_extract_string(result_json, '$.k'), created_at) FILTER (analyzer_type = 'view') AS s,
      arg_max(json_extract_string(result_json, '$.k'), created_at) FILTER (analyzer_type = 'click') AS c,
      coalesce(max(created_at) FILTER (analyzer_type = 'view'), max(created_at)) AS analyzed FROM v_analyses WHERE analyzer_type IN ('view','click') GROUP BY 1)
    SELECT document_id, regexp_replace(filename, '\\.[^.]*$', '') || '_요약.txt' AS filename, concat_ws(chr(10), repeat('=', 46), '문서 요약 보고서', repeat('=', 46),
      '파일명      : ' || filename, '문서 유형   : ' || coalesce(document_type, 'None'), '업로드 일시 : ' || strftime(created_at, '%Y-%m-%d %H:%M:%S'),
      '분석 일시   : ' || strftime(analyzed, '%Y-%m-%d %H:%M:%S'), repeat('-', 46), '[카테고리]', coalesce(c, '-'), '(분류 근거: -)', '', '[요약]', coalesce(s, '-'), repeat('-', 46), '생성: docmill') AS content
    FROM v_documents d JOIN n ON d.id = document_id""")
def summary_reports(v: Views) -> DataFrame:
    value = F.get_json_object("result_json", "$.k")
    named = v.analyses.withColumn("result_json", F.to_json(F.struct(value.alias("summary"), value.alias("category"))))
    return checks.summary_report(v.documents, named, "view", "click")


@query("""SELECT filename AS path FROM v_documents WHERE project_id = 3 UNION ALL SELECT DISTINCT 'review/' || (document_id * 1000 + reading_order // 10) || '.png'
    FROM v_elements JOIN v_documents d ON d.id = document_id WHERE project_id = 3""")
def storage_paths(v: Views) -> DataFrame:
    own = v.documents.where(F.col("project_id") == PROJECT)
    pages, _ = _paged(v)
    images = pages.join(own.select(F.col("id").alias("document_id")), "document_id").select(F.concat(F.lit("review/"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return own.select(F.col("filename").alias("path")).unionByName(images)


@query("SELECT id, filename, status FROM v_documents WHERE project_id = 3 AND status <> 'COMPLETED' ORDER BY created_at, id LIMIT 4")
def open_tasks(v: Views) -> DataFrame:
    own = v.documents.where((F.col("project_id") == PROJECT) & (F.col("status") != "COMPLETED"))
    return own.orderBy("created_at", "id").limit(4).select("id", "filename", "status")


@query("SELECT document_id, count(*) AS chunks FROM v_units GROUP BY document_id")
def chunk_counts(v: Views) -> DataFrame:
    return documents.chunk_counts(v.units)


@query("SELECT line_no AS seq, line AS text FROM v_units WHERE document_id = 5")
def chunks_of_document(v: Views) -> DataFrame:
    return documents.chunks_of(v.units.withColumnRenamed("line_no", "seq"), 5).select("seq", F.col("line").alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, format('{:,}', floor(l_extendedprice)::BIGINT) AS whole,
    format('{:,}', floor(l_extendedprice)::BIGINT) || CASE WHEN l_extendedprice::DECIMAL(18,2) % 1 = 0 THEN '' ELSE '.' || rtrim(right(l_extendedprice::DECIMAL(18,2)::VARCHAR, 2), '0') END AS money,
    CASE WHEN l_orderkey % 2000 < 1000 THEN (l_orderkey % 2000) || 'ms' ELSE ((l_orderkey % 2000) // 100 / 10.0)::DECIMAL(3,1) || '초' END AS latency FROM lineitem""")
def shown_amounts(v: Views) -> DataFrame:
    price = F.col("l_extendedprice")
    ms = F.col("l_orderkey") % 2000
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", formats.number(F.floor(price)).alias("whole"), formats.money(price.cast("decimal(18,2)")).alias("money"),
        formats.latency(F.when(ms < 1000, ms).otherwise(F.floor(ms / 100) * 100)).alias("latency"),
    )


@query("""SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS shown, strftime(created_at, '%m-%d %H:%M') AS short, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS exact,
    created_at < TIMESTAMP '2024-01-01 12:00:00' AS expired FROM v_documents""")
def shown_times(v: Views) -> DataFrame:
    at = F.col("created_at")
    return v.documents.select("id", formats.minutes(at).alias("shown"), formats.minutes_short(at).alias("short"), checks.date_text(at).alias("exact"), (at < F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).alias("expired"))


@query("""SELECT project_id, round(count(*) FILTER (status = 'COMPLETED') / count(*) * 100)::INT AS percent FROM v_documents GROUP BY project_id""")
def completed_percent(v: Views) -> DataFrame:
    counts = v.documents.groupBy("project_id").agg(F.sum((F.col("status") == "COMPLETED").cast("int")).alias("done"), F.count(F.lit(1)).alias("n"))
    return counts.select("project_id", formats.percent(F.col("done"), F.col("n")).alias("percent"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 200) || chr(10) || '...(이하 생략)' END AS prompt FROM documents""")
def prompt_texts(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", formats.truncated(F.col("text"), 200).alias("prompt"))


@query("""SELECT c_custkey, lower(trim(' ' || c_name || ' ')) AS login FROM customer""")
def login_keys(v: Views) -> DataFrame:
    return v.table("customer").select("c_custkey", formats.name_key(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("login"))


@query("""SELECT doc_id, ((length(text) - length(replace(lower(text), 'the', ''))) // 3)::INT AS matches, sum(length(text)) OVER (PARTITION BY doc_id)::BIGINT AS chars FROM documents""")
def keyword_pieces(v: Views) -> DataFrame:
    pieces = F.col("pieces")
    size = F.aggregate(pieces, F.lit(0).cast("long"), lambda s, p: s + F.length(p["text"]))
    cut = v.table("documents").select("doc_id", formats.split_by(F.col("text"), "the").alias("pieces"))
    return cut.select("doc_id", F.size(F.filter(pieces, lambda p: p["match"])).alias("matches"), size.alias("chars"))


@query("""SELECT doc_id, substr(text, (doc_id % 50 + 1)::INT, 20) AS inside, substr(text, 1, (doc_id % 50)::INT) AS before, substr(text, (doc_id % 50 + 21)::INT) AS behind
    FROM documents WHERE doc_id % 50 + 20 <= length(text)""")
def highlighted_ranges(v: Views) -> DataFrame:
    begin = F.col("doc_id") % 50
    cut = v.table("documents").select("doc_id", formats.range_parts(F.col("text"), begin, begin + 20).alias("p")).where("p IS NOT NULL")
    return cut.select("doc_id", "p.before", "p.inside", "p.behind")


@query("""SELECT document_id, line_no, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) >= 30 AS kept FROM v_units""")
def lettered_lines(v: Views) -> DataFrame:
    return v.units.select("document_id", "line_no", formats.has_letters(F.col("line"), 30).alias("kept"))


@query("""SELECT doc_id, i::INT AS place FROM documents, generate_series(0, (doc_id % 4)::INT - 1) AS g(i)""")
def zipped_vectors(v: Views) -> DataFrame:
    n = (F.col("doc_id") % 4).cast("int")
    lists = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return checks.zipped(v.table("documents").select("doc_id", lists.alias("chunks"), lists.alias("vectors")), "chunks", "vectors", "place").select("doc_id", "place")


@query("""SELECT doc_id, 'fake_response_for : ' || CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || chr(10) || '...(이하 생략)' END AS answer, 'fake-model' AS model_name, 'other' AS category FROM documents""")
def fake_analyses(v: Views) -> DataFrame:
    found = analysis.analyze(v.table("documents"), "doc_id", "text", analysis.FakeClient, ["news"], "other", max_chars=300)
    return found.select("doc_id", "answer", "model_name", "category")


@query("""SELECT document_id, line_no, strip_accents(line) = line AS plain, nfc_normalize(line) AS line FROM v_units""")
def normalized_lines(v: Views) -> DataFrame:
    line = t.nfc(F.col("line"))
    return v.units.select("document_id", "line_no", (t.plain_letters(F.col("line")) == F.col("line")).alias("plain"), line.alias("line"))


@query("""WITH e AS (SELECT DISTINCT document_id FROM v_elements WHERE NOT is_excluded) SELECT document_id, 'elements' AS source, count(*) AS n FROM v_elements WHERE NOT is_excluded GROUP BY 1
    UNION ALL SELECT document_id, 'text', count(*) FROM v_units WHERE document_id NOT IN (FROM e) GROUP BY 1""")
def unit_sources(v: Views) -> DataFrame:
    elements = review.in_content(v.elements.withColumn("is_in_content", F.lit(True))).select("document_id", F.col("reading_order").alias("place"), "text")
    lines = v.units.select("document_id", F.col("line_no").alias("place"), F.col("line").alias("text"))
    return documents.chunk_units(elements, lines).groupBy("document_id", "source").agg(F.count(F.lit(1)).alias("n"))
