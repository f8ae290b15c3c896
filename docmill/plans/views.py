"""Virtual tables of the document collection over the driver's Parquet, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Document states in the order in which the fixture deals them.
STATUSES = ("PENDING", "EXTRACTING", "EXTRACTED", "ANALYZING", "COMPLETED", "FAILED")


class Views:
    """Each property is a view; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def projects(self) -> DataFrame:
        status = F.when(F.col("n_regionkey") == 0, "ARCHIVED").otherwise("ACTIVE")
        created = F.date_add(F.lit("1992-01-01").cast("date"), F.col("n_nationkey").cast("int"))
        return self.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), status.alias("status"), created.alias("created_at"))

    @property
    def members(self) -> DataFrame:
        joined = (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        )
        pairs = joined.select(F.col("s_nationkey").alias("project_id"), F.col("o_custkey").alias("user_id")).distinct()
        return pairs.withColumn("role", F.element_at(F.array(*map(F.lit, ("OWNER", "EDITOR", "VIEWER"))), (F.col("user_id") % 3 + 1).cast("int")))

    @property
    def documents(self) -> DataFrame:
        labels = self.table("labels")
        review = (
            F.when(F.col("quality").isNull(), "NOT_REQUIRED")
            .when((F.col("quality") == 1) & (F.col("toxic") == 0), "COMPLETED")
            .when(F.col("quality") == 0, "PENDING")
            .otherwise("IN_PROGRESS")
        )
        i = F.col("doc_id")
        return self.table("documents").join(labels, "doc_id", "left").select(
            i.alias("id"),
            (i % 25).cast("int").alias("project_id"),
            F.concat(F.lit("doc-"), i.cast("string"), F.lit("."), F.col("source")).alias("filename"),
            F.when(i % 7 != 0, F.col("source")).alias("document_type"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=i.cast("int"))).alias("created_at"),
            F.sha2("text", 256).alias("content_hash"),
            F.element_at(F.array(*map(F.lit, STATUSES)), (i % 6 + 1).cast("int")).alias("status"),
            review.alias("review_status"),
            (i % 4).cast("int").alias("ocr_revision"),
        )

    @property
    def texts(self) -> DataFrame:
        version = (1 + F.col("doc_id") % 3).cast("int")
        return self.table("documents").select(
            F.col("doc_id").alias("document_id"), F.col("text").alias("content"), F.col("n_chars").alias("char_count"), version.alias("text_version")
        )

    @property
    def analyses(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("document_id"),
            F.col("event_type").alias("analyzer_type"),
            F.col("props").alias("result_json"),
            F.col("value").alias("latency"),
            F.col("ts").alias("created_at"),
        )

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("chunk_id"),
            F.col("label").alias("project_id"),
            (F.col("vec_id") % 50).alias("document_id"),
            F.when(F.col("vec_id") % 5 == 0, "alt").otherwise("base").alias("embedding_model"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )

    @property
    def amount_items(self) -> DataFrame:
        joined = (
            self.table("lineitem")
            .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        )
        flag = F.col("l_returnflag")
        decision = F.when(flag == "A", "APPROVED").when(flag == "N", "PENDING").otherwise("REJECTED")
        return joined.select(
            F.col("l_orderkey").alias("document_id"),
            F.col("c_nationkey").alias("project_id"),
            F.col("p_name").alias("item_name"),
            F.when(F.col("p_size") == 1, "VAT").when(F.col("p_size") > 2, F.col("p_brand")).alias("category"),
            F.col("l_quantity").cast("decimal(18,4)").alias("quantity"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("unit_price"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
            F.lit("KRW").alias("currency"),
            decision.alias("decision"),
            F.to_date("o_orderdate").alias("uploaded_on"),
        )

    @property
    def decisions(self) -> DataFrame:
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        state, rank = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1)
        return joined.select(
            F.col("o_orderkey").alias("id"),
            F.col("c_nationkey").alias("project_id"),
            F.when(state == "F", "DECIDED").when(state == "O", "PENDING").otherwise("REVERSED").alias("status"),
            F.when(rank == "1", "APPROVED").when(rank == "2", "EDITED").when(rank == "3", "PENDING").otherwise("REJECTED").alias("decision"),
            F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("decided_on"),
            F.when((state == "P") & (F.col("o_orderkey") % 4 != 3), F.col("o_orderkey") + 1).alias("superseded_by"),
        )

    @property
    def schedule(self) -> DataFrame:
        joined = (
            self.table("lineitem")
            .join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        )
        grouped = joined.groupBy("o_orderkey", "c_nationkey", "o_orderdate").agg(F.max("l_shipdate").alias("shipped"))
        start, end = F.to_date("o_orderdate"), F.to_date("shipped")
        kinds = F.array(*map(F.lit, ("MILESTONE", "DEADLINE", "MEETING", "PERIOD")))
        return grouped.select(
            F.col("o_orderkey").alias("id"),
            F.col("c_nationkey").alias("project_id"),
            F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("kind"),
            F.least(start, end).alias("starts_on"),
            F.when(F.col("o_orderkey") % 9 != 0, F.greatest(start, end)).alias("ends_on"),
            F.when(F.col("o_orderkey") % 3 == 0, "PENDING").otherwise("APPROVED").alias("decision"),
        )

    @property
    def elements(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("document_id"),
            F.col("turn").alias("reading_order"),
            "text",
            (F.col("role") == "system").alias("is_excluded"),
            F.lit(False).alias("is_deleted"),
            (1 + F.col("turn") % 3).cast("int").alias("version"),
            F.when(F.col("turn") % 5 != 0, (F.length("text") % 100) / F.lit(100.0)).alias("confidence"),
        )

    @property
    def units(self) -> DataFrame:
        """Lines of each text with their offsets; blank ones go."""
        lines = self.texts.select("document_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
        from docmill.functions.text import running_offset

        placed = lines.withColumn("content_start", running_offset("document_id", "line_no", "line"))
        return placed.where(F.trim("line") != "").withColumn("content_end", F.col("content_start") + F.length("line"))


#: The same views in SQL, in an order in which each uses only earlier ones.
SQL = {
    "v_projects": "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'ARCHIVED' ELSE 'ACTIVE' END AS status, DATE '1992-01-01' + n_nationkey::INTEGER AS created_at FROM nation",
    "v_members": """SELECT DISTINCT s_nationkey AS project_id, o_custkey AS user_id, ['OWNER','EDITOR','VIEWER'][o_custkey % 3 + 1] AS role
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""",
    "v_documents": """SELECT d.doc_id AS id, (d.doc_id % 25)::INT AS project_id, concat('doc-', d.doc_id, '.', source) AS filename,
        CASE WHEN d.doc_id % 7 <> 0 THEN source END AS document_type, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at,
        sha256(text) AS content_hash, ['PENDING','EXTRACTING','EXTRACTED','ANALYZING','COMPLETED','FAILED'][d.doc_id % 6 + 1] AS status,
        CASE WHEN quality IS NULL THEN 'NOT_REQUIRED' WHEN quality = 1 AND toxic = 0 THEN 'COMPLETED' WHEN quality = 0 THEN 'PENDING'
             ELSE 'IN_PROGRESS' END AS review_status, (d.doc_id % 4)::INT AS ocr_revision
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "v_texts": "SELECT doc_id AS document_id, text AS content, n_chars AS char_count, (1 + doc_id % 3)::INT AS text_version FROM documents",
    "v_analyses": """SELECT event_id AS id, user_id AS document_id, event_type AS analyzer_type, props AS result_json, value AS latency, ts AS created_at
        FROM events""",
    "v_vectors": """SELECT vec_id AS chunk_id, label AS project_id, vec_id % 50 AS document_id,
        CASE WHEN vec_id % 5 = 0 THEN 'alt' ELSE 'base' END AS embedding_model, embedding::DOUBLE[] AS embedding FROM embeddings""",
    "v_amount_items": """SELECT l_orderkey AS document_id, c_nationkey AS project_id, p_name AS item_name,
        CASE WHEN p_size = 1 THEN 'VAT' WHEN p_size > 2 THEN p_brand END AS category, l_quantity::DECIMAL(18,4) AS quantity,
        p_retailprice::DECIMAL(18,2) AS unit_price, l_extendedprice::DECIMAL(18,2) AS amount, 'KRW' AS currency,
        CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'N' THEN 'PENDING' ELSE 'REJECTED' END AS decision, o_orderdate::DATE AS uploaded_on
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "v_decisions": """SELECT o_orderkey AS id, c_nationkey AS project_id,
        CASE o_orderstatus WHEN 'F' THEN 'DECIDED' WHEN 'O' THEN 'PENDING' ELSE 'REVERSED' END AS status,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'APPROVED' WHEN '2' THEN 'EDITED' WHEN '3' THEN 'PENDING' ELSE 'REJECTED' END AS decision,
        CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE END AS decided_on,
        CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 3 THEN o_orderkey + 1 END AS superseded_by
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_schedule": """SELECT id, project_id, kind, least(a, b) AS starts_on, CASE WHEN id % 9 <> 0 THEN greatest(a, b) END AS ends_on,
        CASE WHEN id % 3 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS decision FROM (
        SELECT o_orderkey AS id, c_nationkey AS project_id, ['MILESTONE','DEADLINE','MEETING','PERIOD'][o_orderkey % 4 + 1] AS kind,
        o_orderdate::DATE AS a, max(l_shipdate)::DATE AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey GROUP BY o_orderkey, c_nationkey, o_orderdate)""",
    "v_elements": """SELECT conv_id AS document_id, turn AS reading_order, text, role = 'system' AS is_excluded, false AS is_deleted,
        (1 + turn % 3)::INT AS version, CASE WHEN turn % 5 <> 0 THEN (length(text) % 100) / 100.0::DOUBLE END AS confidence FROM conversations""",
    "v_units": """SELECT document_id, line_no, line, content_start, content_start + length(line) AS content_end FROM (
        SELECT document_id, line_no, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY line_no
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS content_start
        FROM (SELECT document_id, unnest(range(len(parts)))::INT AS line_no, unnest(parts) AS line
              FROM (SELECT document_id, string_split(content, chr(10)) AS parts FROM v_texts))) WHERE trim(line) <> ''""",
}


def with_views(sql: str) -> str:
    """Put the views that a query uses before it."""
    used: set[str] = set()

    def use(text: str) -> None:
        for name in set(re.findall(r"\bv_[a-z_]+\b", text)) & SQL.keys() - used:
            used.add(name)
            use(SQL[name])

    use(sql)
    parts = [f"{name} AS ({SQL[name]})" for name in SQL if name in used]
    if not parts:
        return sql
    body = sql.strip()
    if (more := re.match(r"WITH\s+(RECURSIVE\s+)?", body)) is not None:
        return f"WITH {more[1] or ''}{', '.join(parts)}, {body[more.end() :]}"
    return f"WITH {', '.join(parts)} {body}"
