"""Dashboard counts and report previews of a project."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators.storage import checkpointed

# States that count as being processed, as waiting for review, and report kinds.
PROCESSING = ("PENDING", "EXTRACTING", "ANALYZING")
REVIEWING = ("PENDING", "IN_PROGRESS")
REPORT_KINDS = ("WEEKLY_REPORT", "DECISION_LOG", "MEETING_AGENDA", "PROJECT_STATUS")
NEEDS_PERIOD = ("WEEKLY_REPORT",)


def counts_by(documents: DataFrame, project_id: int, column: str) -> DataFrame:
    """Documents by a column; nulls are a group."""
    return documents.where(F.col("project_id") == project_id).groupBy(column).agg(F.count("*").alias("n"))


def type_distribution(documents: DataFrame, project_id: int) -> DataFrame:
    """Documents by type with shares, untyped ones last, then by count and name."""
    counted = counts_by(documents, project_id, "document_type")
    every = Window.partitionBy()  # a row for each type
    shares = counted.select(
        "document_type", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.col("n") / F.max("n").over(every)).alias("bar")
    )
    return shares.orderBy(F.col("document_type").isNull(), F.desc("n"), "document_type")


def status_rollup(documents: DataFrame, project_id: int) -> DataFrame:
    """All documents, and those in work, done, failed and waiting for review, in one pass."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    status, review = F.col("status"), F.col("review_status")
    return documents.where(F.col("project_id") == project_id).agg(
        F.count("*").alias("total"),
        n(status.isin(*PROCESSING)).alias("processing"),
        n(status == "EXTRACTED").alias("extracted"),
        n(status == "COMPLETED").alias("completed"),
        n(status == "FAILED").alias("failed"),
        n(review.isin(*REVIEWING)).alias("review_pending"),
        n(review == "COMPLETED").alias("review_completed"),
    )


def recent(documents: DataFrame, project_id: int, limit: int) -> DataFrame:
    return documents.where(F.col("project_id") == project_id).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def in_period(day: Column, since: date | None, until: date | None) -> Column:
    """Within both bounds that are given; a null day is only left out by a bound."""
    held = F.lit(True)
    if since is not None:
        held &= day >= F.lit(since)
    if until is not None:
        held &= day <= F.lit(until)
    return held


def endpoint_in_period(start: Column, end: Column, since: date | None, until: date | None) -> Column:
    """Whether the start or the end lies in the period; what spans all of it doesn't count."""
    return F.coalesce(in_period(start, since, until), F.lit(False)) | F.coalesce(in_period(end, since, until), F.lit(False))


def overlaps_period(start: Column, end: Column, since: date, until: date) -> Column:
    return (start <= F.lit(until)) & (F.coalesce(end, start) >= F.lit(since))


def effective_due(kind: Column, start: Column, end: Column) -> Column:
    """Milestones and meetings fall due at their start, the rest at the end if there is one."""
    return F.when(kind.isin("MILESTONE", "MEETING"), start).otherwise(F.coalesce(end, start))


def pending_suggestions(amounts: DataFrame, decisions: DataFrame, schedule: DataFrame, project_id: int) -> DataFrame:
    """Suggestions of any kind that nobody has judged."""
    waiting = (F.col("project_id") == project_id) & (F.col("decision") == "PENDING")
    parts = [df.where(waiting).select(F.lit(1).alias("one")) for df in (amounts, decisions, schedule)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(F.count("one").alias("pending_suggestions"))


# What can't be counted, and why a report can't be made, by kind.
UNCOUNTABLE = ("completed_tasks",)
WAITING = ("담을 내용이 없습니다. 승인 대기 중인 제안이 ", "건 있습니다 — 승인하면 담깁니다.")
NOTHING = {
    "MEETING_AGENDA": "미결 상태인 결정사항이 없습니다. 안건으로 낼 것이 없습니다.",
    "DECISION_LOG": "기록된 결정사항이 없습니다.",
    "WEEKLY_REPORT": "선택한 기간에 문서·결정·일정·금액 변동이 없습니다.",
    "PROJECT_STATUS": "프로젝트에 담을 내용이 아직 없습니다.",
}
COUNTED = ("documents", "decisions", "schedule_items", "amount_items")


def _checked_period(kind: str, since: date | None, until: date | None) -> tuple[date | None, date | None]:
    """The period that a kind looks at, none for most."""
    if kind not in REPORT_KINDS:
        raise ValueError("INVALID_DOCUMENT_TYPE")
    if kind not in NEEDS_PERIOD:
        return None, None
    if since is None or until is None:
        raise ValueError("PERIOD_REQUIRED")
    if since > until:
        raise ValueError("INVALID_PROJECT_DATES")
    return since, until


def material(documents: DataFrame, decisions: DataFrame, schedule: DataFrame, amounts: DataFrame, kind: str, since: date | None, until: date | None) -> DataFrame:
    """project_id and counts of what a report of a kind would hold, and of suggestions that wait; each table is read once."""
    since, until = _checked_period(kind, since, until)
    everything = F.lit(kind in ("WEEKLY_REPORT", "PROJECT_STATUS"))
    waits = F.col("decision") == "PENDING"
    own = {
        "documents": (documents, everything & in_period(F.to_date("created_at"), since, until), F.lit(False)),
        "decisions": (decisions, in_period(F.col("decided_on"), since, until) & (F.lit(kind != "MEETING_AGENDA") | (F.col("status") == "PENDING")), waits),
        "schedule_items": (schedule, everything & (endpoint_in_period(F.col("starts_on"), F.col("ends_on"), since, until) if since else F.lit(True)), waits),
        "amount_items": (amounts, everything & in_period(F.col("uploaded_on"), since, until), waits),
    }
    parts = None
    for name, (df, counts, pending) in own.items():
        n = lambda c: F.count(F.when(c, 1))
        row = df.groupBy("project_id").agg(n(counts).alias("held"), n(pending).alias("pending"))
        row = row.select("project_id", *[(F.col("held") if c == name else F.lit(0).cast("long")).alias(c) for c in COUNTED], "pending")
        parts = row if parts is None else parts.unionByName(row)
    return parts.groupBy("project_id").agg(*[F.sum(c).alias(c) for c in COUNTED], F.sum("pending").alias("pending_suggestions"))


def report_previews(
    projects: DataFrame, documents: DataFrame, decisions: DataFrame, schedule: DataFrame, amounts: DataFrame,
    kind: str, since: date | None = None, until: date | None = None,
) -> DataFrame:
    """What a report of each project (id) would hold, whether it can be made, and if not why; projects without anything have zeros.

    Only a weekly report looks at the period; other kinds show none. Suggestions that wait don't count towards
    making it, but are named as the reason. ``uncountable`` lists what isn't counted at all.
    """
    since, until = _checked_period(kind, since, until)
    found = projects.select(F.col("id").alias("project_id")).join(material(documents, decisions, schedule, amounts, kind, since, until), "project_id", "left")
    found = found.select("project_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in (*COUNTED, "pending_suggestions")])
    can = sum((F.col(c) for c in COUNTED[1:]), F.col(COUNTED[0])) > 0
    why = F.when(F.col("pending_suggestions") > 0, F.concat(F.lit(WAITING[0]), F.col("pending_suggestions").cast("string"), F.lit(WAITING[1]))).otherwise(NOTHING[kind])
    return found.select(
        "project_id", F.lit(kind).alias("kind"), F.lit(since).cast("date").alias("period_from"), F.lit(until).cast("date").alias("period_to"), *COUNTED, "pending_suggestions",
        can.alias("can_generate"), F.when(~can, why).alias("blocked_reason"), F.lit(kind in NEEDS_PERIOD).alias("needs_period"), F.array(*map(F.lit, UNCOUNTABLE)).alias("uncountable"),
    )


def report_preview(
    documents: DataFrame, decisions: DataFrame, schedule: DataFrame, amounts: DataFrame,
    project_id: int, kind: str, since: date | None = None, until: date | None = None,
) -> DataFrame:
    """The preview of one project: one row of counts, and whether the report can be made."""
    own = lambda df: df.where(F.col("project_id") == project_id)
    one = documents.sparkSession.range(project_id, project_id + 1)
    found = report_previews(one, own(documents), own(decisions), own(schedule), own(amounts), kind, since, until)
    return found.select("kind", *COUNTED, "pending_suggestions", "can_generate")


def growth(before: Column, now: Column) -> Column:
    """What rose between two maps of counts; a missing key is 0."""
    zero = lambda v: F.coalesce(v, F.lit(0))
    return F.map_filter(F.map_zip_with(before, now, lambda k, a, b: zero(b) - zero(a)), lambda k, v: v > 0)


def open_chain(decisions: DataFrame, rounds: int = 40) -> DataFrame:
    """Each superseded decision (id) with the one that holds in the end (last), and the steps to it.

    Pointers double: each round joins what decisions point at with what that points at, so rounds grow
    with the logarithm of the longest chain. A circle is an error. Nulls point at nothing.
    """
    links = decisions.where("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("last"), F.lit(1).alias("steps"))
    for _ in range(rounds):
        links = checkpointed(links)
        further = links.select(F.col("id").alias("last"), F.col("last").alias("further"), F.col("steps").alias("more"))
        longer = links.join(further, "last", "left")
        if longer.where("further IS NOT NULL").isEmpty():
            return links
        links = longer.select("id", F.coalesce("further", "last").alias("last"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    raise ValueError("DECISION_CIRCLE")
