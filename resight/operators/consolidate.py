"""Consolidation of proven duplicates in two steps, by identity and by text, without losing a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NO_COMPANY, squeezed, valid_title
from ..functions.unicode import case_folded, composed
from ..sources.tables import scratch

SHORTEST_TEXT = 200


def picked_text(texts: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """(id, text): the modern extractor's before a legacy one's, then the newest."""
    return texts.groupBy(id_col).agg(F.max_by("text", F.struct("is_modern", "fetched_at", "source_id", "extraction_id")).alias("text"))


def identity_groups(postings: DataFrame) -> DataFrame:
    """(identity, n): how many records share an identity."""
    return postings.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))


def role_keys(postings: DataFrame, *, id_col: str = "job_id", shortest: int = SHORTEST_TEXT) -> DataFrame:
    """postings (id, identity, source, title, company, text, last_seen) with role_key.

    Of each identity the latest record with a valid title speaks, or the latest if none has one: with a text of at least `shortest`
    characters, squeezed, a valid title and a company that names one, the key is (source, company, title, text), else the identity.
    Source, company and title are compared as text_key() folds them, texts as normal_text() leaves them.  A null is as good as an empty value.
    The keys are written once by identity, and read by whoever uses the result more than once.
    """
    speaks = F.struct("source", "title", "company", "text")
    order = F.struct(valid_title(F.col("title")), "last_seen", id_col)
    latest = postings.groupBy("identity").agg(F.max_by(speaks, order).alias("s")).select("identity", "s.*")
    names, blank = ("source", "company", "title"), F.lit("")
    said = latest.select("identity", valid_title(F.col("title")).alias("valid"), *(squeezed(F.coalesce(c, blank)).alias(c) for c in (*names, "text")))
    said = said.select("identity", "valid", *(case_folded(F.col(c)).alias(c) for c in names), composed(F.col("text")).alias("text"))
    proven = F.col("valid") & (F.length("text") >= shortest) & ~F.col("company").isin(NO_COMPANY)
    key = F.sha2(F.concat_ws("\x1f", *names, F.sha2("text", 256)), 256)
    path = scratch(postings.sparkSession, "roles")
    said.select("identity", F.when(proven, key).otherwise(F.col("identity")).alias("role_key")).write.parquet(path)
    return postings.join(postings.sparkSession.read.parquet(path), "identity")


def canonical(keyed: DataFrame, previous: DataFrame, *, id_col: str = "job_id", standard: Column | None = None) -> DataFrame:
    """(id, canonical_job_id, reason) of the records of groups of two and more.

    The root is the smallest by (invalid title, no root before, no modern text, non-standard id, first seen, id): a root stays one
    while it can.  reason: posting_id where the record shares the root's identity, else description.
    """
    roots = previous.select(F.col("canonical_job_id").alias(id_col)).distinct().withColumn("_was", F.lit(True))
    k = keyed.join(roots, id_col, "left")
    order = F.struct(~valid_title(F.col("title")), F.col("_was").isNull(), ~F.coalesce("is_modern", F.lit(False)), ~(F.lit(True) if standard is None else standard), F.col("first_seen"), F.col(id_col))
    groups = k.groupBy("role_key").agg(F.min_by(F.struct(F.col(id_col).alias("id"), "identity"), order).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = keyed.select(id_col, "role_key", "identity").join(groups, "role_key")
    return out.select(id_col, F.col("r.id").alias("canonical_job_id"), F.when(F.col("identity") == F.col("r.identity"), "posting_id").otherwise("description").alias("reason"))


def memberships(records: DataFrame, members: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """A row for each record: its group's root, or itself."""
    alone = records.select(id_col).join(members.select(id_col), id_col, "left_anti").select(id_col, F.col(id_col).alias("canonical_job_id"))
    return members.select(id_col, "canonical_job_id").unionByName(alone)


def changed_groups(new: DataFrame, old: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """Roots of new groups with a member whose root changed."""
    both = new.join(old.select(id_col, F.col("canonical_job_id").alias("_old")), id_col, "left")
    changed = F.coalesce("_old", id_col) != F.col("canonical_job_id")
    return both.groupBy("canonical_job_id").agg(F.bool_or(changed).alias("c")).filter("c").select("canonical_job_id")


def inherited(changed: DataFrame, members: DataFrame, overrides: DataFrame, log: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """Decisions that members of changed groups inherit: the group's latest hand-made one, at its own time, where a member's differs."""
    made = log.filter("decision_source = 'manual' AND decision_action <> 'shadow'")
    made = made.withColumn("intent", F.when(F.col("decision_action") == "archive", "archive").otherwise("keep"))
    group = members.join(changed, "canonical_job_id")
    latest = group.join(made, id_col).groupBy("canonical_job_id").agg(F.max_by(F.struct("intent", "decided_at", F.col(id_col).alias("from_id")), F.struct("decided_at", "decision_id")).alias("d"))
    out = group.join(latest, "canonical_job_id").join(overrides.select(id_col, F.col("action").alias("_own")), id_col, "left")
    return out.filter("_own IS NULL OR _own <> d.intent").select(id_col, F.col("d.intent").alias("decision_action"), F.col("d.decided_at").alias("decided_at"), F.col("d.from_id").alias("inherited_from"))


def role_groups(postings: DataFrame, membership: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """(canonical_job_id, n, first_seen, last_seen, locations, is_favorite, notes, flagged_at, active, members) of each role.

    postings: (id, location, first_seen, last_seen, is_favorite, flag_reason, flagged_at, archived_at).  locations and notes are different and
    sorted; members are all ids with whether they are active, sorted.
    """
    active = F.col("archived_at").isNull()
    return postings.join(membership, id_col).groupBy("canonical_job_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_set("location")).alias("locations"),
        F.bool_or("is_favorite").alias("is_favorite"),
        F.array_sort(F.collect_set(F.when(F.trim("flag_reason") != "", F.col("flag_reason")))).alias("notes"),
        F.max("flagged_at").alias("flagged_at"),
        F.count_if(active).alias("active"),
        F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), active.alias("active")))).alias("members"),
    )


def review(postings: DataFrame, membership: DataFrame, seen: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """One row for each group: aggregates over its members, and the member that is shown.

    The shown one has a valid title, is active, was seen last.  A group is archived only if no member is active.  Its count is of
    different runs, or seconds where a sighting has no run.
    """
    m = postings.join(membership, id_col)
    shown = F.struct("title", "company", "location", "archived_at")
    order = F.struct(valid_title(F.col("title")), F.col("archived_at").isNull(), F.col("last_seen"), F.col(id_col))
    when = F.coalesce(F.concat(F.lit("run:"), "run_id"), F.concat(F.lit("time:"), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")))
    counts = seen.join(membership, id_col).groupBy("canonical_job_id").agg(F.count_distinct(when).alias("seen_count"))
    groups = m.groupBy("canonical_job_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.collect_set("location")).alias("locations"),
        F.bool_or("is_favorite").alias("is_favorite"),
        F.count_if(F.col("archived_at").isNull()).alias("active_members"),
        F.max_by(shown, order).alias("s"),
        F.max_by(id_col, order).alias("shown_id"),
    )
    out = groups.join(counts, "canonical_job_id", "left")
    return out.select("canonical_job_id", "shown_id", "s.title", "s.company", "s.location", "members", "active_members", "first_seen", "last_seen", "locations", "is_favorite", (F.col("active_members") == 0).alias("is_archived"), F.coalesce("seen_count", F.lit(0)).alias("seen_count"))
