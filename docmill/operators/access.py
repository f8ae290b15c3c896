"""Members, invitations and what a role may do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Actions that each role may take.
VIEW = ("read", "search", "download")
EDIT = ("upload", "edit", "analyze", "delete_document")
OWN = ("invite", "remove_member", "update_project", "delete_project")


def may(role: Column, action: str) -> Column:
    """Whether a role may take an action; nobody without a role may."""
    roles = ("OWNER", "EDITOR", "VIEWER") if action in VIEW else ("OWNER", "EDITOR") if action in EDIT else ("OWNER",)
    return F.coalesce(role.isin(*roles), F.lit(False))


def project_list(members: DataFrame, projects: DataFrame, user_id: int) -> DataFrame:
    """A user's projects with their places in the list: active ones first, of these the newest."""
    own = members.where(F.col("user_id") == user_id).select(F.col("project_id").alias("id"), "role")
    order = Window.orderBy("status", F.desc("created_at"), "id")  # one user's projects are few
    return projects.join(own, "id").withColumn("place", F.row_number().over(order)).orderBy("place")


def recent_invitees(invitations: DataFrame, inviter_id: int, limit: int = 10) -> DataFrame:
    """The last people a user invited (inviter_id, invitee_id, id, created_at), each once."""
    newest = Window.partitionBy("invitee_id").orderBy(F.desc("created_at"), F.desc("id"))
    own = invitations.where(F.col("inviter_id") == inviter_id).withColumn("place", F.row_number().over(newest)).where("place = 1")
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(limit).drop("place")


def pending_invitations(invitations: DataFrame, projects: DataFrame, user_id: int) -> DataFrame:
    """A user's open invitations to active projects, newest first."""
    active = projects.where("status = 'ACTIVE'").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    own = invitations.where((F.col("invitee_id") == user_id) & (F.col("status") == "PENDING"))
    return own.join(active, "project_id").orderBy(F.desc("created_at"), F.desc("id"))


def project_members(members: DataFrame, users: DataFrame, project_id: int) -> DataFrame:
    """Members of a project with their names, in the order in which they came."""
    own = members.where(F.col("project_id") == project_id)
    return own.join(users.select(F.col("id").alias("user_id"), "name"), "user_id").orderBy("invited_at", "user_id")


def invite(invitations: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """What becomes of requests (project_id, invitee_id, inviter_id, role, at), one for a project and person.

    ``outcome`` is DUPLICATE_MEMBER for members and for oneself, OWNER_ROLE_RESERVED, DUPLICATE_INVITATION
    while one is open, RESET where an answered one is opened again, or NEW.
    """
    own = members.select("project_id", F.col("user_id").alias("invitee_id"), F.lit(True).alias("is_member")).distinct()
    before = invitations.select("project_id", "invitee_id", F.col("status").alias("was"))
    joined = asked.join(own, ["project_id", "invitee_id"], "left").join(before, ["project_id", "invitee_id"], "left")
    outcome = (
        F.when((F.col("inviter_id") == F.col("invitee_id")) | F.col("is_member"), "DUPLICATE_MEMBER")
        .when(F.col("role") == "OWNER", "OWNER_ROLE_RESERVED")
        .when(F.col("was") == "PENDING", "DUPLICATE_INVITATION")
        .when(F.col("was").isNotNull(), "RESET")
        .otherwise("NEW")
    )
    return joined.select(*asked.columns, outcome.alias("outcome"))


def invited(invitations: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """The stored invitations (id, project_id, invitee_id, invited_by, role, status, created_at, responded_at) after requests.

    One that is opened again keeps its id and takes the request's role, inviter and time; new ones have a null id until
    they are stored. Of several requests for one project and person the earliest counts, then the smallest inviter: the
    others would find it open. Refused requests change nothing.
    """
    key = ["project_id", "invitee_id"]
    judged = invite(invitations, members, asked).where("outcome IN ('RESET', 'NEW')")
    first = judged.groupBy(*key).agg(F.min(F.struct("at", "inviter_id", "role", "outcome")).alias("now"))
    joined = invitations.join(first, key, "full_outer")
    opened = F.col("now").isNotNull()
    own = {
        "invited_by": F.when(opened, F.col("now.inviter_id")).otherwise(F.col("invited_by")),
        "role": F.when(opened, F.col("now.role")).otherwise(F.col("role")),
        "status": F.when(opened, "PENDING").otherwise(F.col("status")),
        "created_at": F.when(opened, F.col("now.at")).otherwise(F.col("created_at")),
        "responded_at": F.when(~opened, F.col("responded_at")),
    }
    return joined.select(*[own.get(c, F.col(c)).alias(c) for c in invitations.columns])


def answer(invitations: DataFrame, answers: DataFrame) -> DataFrame:
    """Invitations after answers (id, answer: ACCEPTED, DECLINED or CANCELED); closed ones raise INVITATION_NOT_PENDING."""
    joined = invitations.join(answers, "id", "left")
    closed = F.col("answer").isNotNull() & (F.col("status") != "PENDING")
    status = F.when(closed, F.raise_error(F.lit("INVITATION_NOT_PENDING"))).otherwise(F.coalesce("answer", "status"))
    return joined.withColumn("status", status).drop("answer")


def accepted_members(members: DataFrame, invitations: DataFrame) -> DataFrame:
    """Members with those whose invitation was accepted and who weren't members before."""
    new = invitations.where("status = 'ACCEPTED'").select("project_id", F.col("invitee_id").alias("user_id"), "role")
    return members.select("project_id", "user_id", "role").unionByName(new.join(members, ["project_id", "user_id"], "left_anti"))


def change_member(members: DataFrame, owners: DataFrame, changes: DataFrame) -> DataFrame:
    """Members after changes (project_id, user_id, new_role; null: remove); an owner's row stays, and no one becomes owner."""
    joined = members.join(owners.select("project_id", F.col("user_id").alias("owner_id")), "project_id", "left")
    joined = joined.join(changes.withColumn("asked", F.lit(True)), ["project_id", "user_id"], "left")
    reserved = F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)) | (F.coalesce("new_role", F.lit("")) == "OWNER")
    acts = F.coalesce("asked", F.lit(False)) & ~reserved
    kept = joined.where(~(acts & F.col("new_role").isNull()))
    return kept.withColumn("role", F.when(acts, F.col("new_role")).otherwise(F.col("role"))).select(*members.columns)
