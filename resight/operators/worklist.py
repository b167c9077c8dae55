"""Which rows to work on next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Outcomes of records that are not worked on.
SETTLED = ["excluded", "unrelated", "manual_archive", "auto_archived"]


def processable(records: DataFrame, membership: DataFrame, id_col: str = "job_id") -> DataFrame:
    """records (id, archived_at, outcome) of roles that are active, with an outcome that is not settled."""
    of = records.join(membership.select(id_col, "canonical_job_id"), id_col)
    active = of.filter("archived_at IS NULL").select("canonical_job_id").distinct()
    open_ = of.filter(~F.coalesce("outcome", F.lit("")).isin(SETTLED)).join(active, "canonical_job_id", "left_semi")
    return open_.select(*records.columns)


def newest_work(work: DataFrame, postings: DataFrame, n: int = 20, id_col: str = "job_id") -> DataFrame:
    """The newest n rows of work with the title of their record."""
    top = work.orderBy(F.desc("work_id")).limit(n)
    return postings.select(id_col, "title").join(F.broadcast(top), id_col).orderBy(F.desc("work_id"))  # n rows


def latest_attempt(attempts: DataFrame, id_col: str = "job_id") -> DataFrame:
    a = attempts.groupBy(id_col).agg(F.max_by(F.struct("status", "refresh", "attempt_id"), "attempt_id").alias("a"))
    return a.select(id_col, "a.*")


def unfetched(postings: DataFrame, attempts: DataFrame, saved: DataFrame, absorbed: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Active records never attempted, without a saved text, not absorbed by another; favourites first, then newest."""
    out = postings.filter("archived_at IS NULL")
    for other in (attempts, saved, absorbed):
        out = out.join(other.select(id_col), id_col, "left_anti")
    return out.orderBy(F.desc("is_favorite"), F.desc("last_seen"), id_col)


def failed(postings: DataFrame, attempts: DataFrame, saved: DataFrame, n: int | None = None, id_col: str = "job_id") -> DataFrame:
    """Active records whose newest attempt failed or broke off, to be refreshed or without a saved text."""
    last = latest_attempt(attempts, id_col).filter("status IN ('failed', 'interrupted')")
    has = saved.select(id_col).distinct().withColumn("_saved", F.lit(True))
    out = postings.filter("archived_at IS NULL").join(last, id_col).join(has, id_col, "left").filter("refresh OR _saved IS NULL").orderBy(F.desc("attempt_id"), id_col)
    return out.drop("_saved") if n is None else out.drop("_saved").limit(n)


def enqueue(requested: DataFrame, postings: DataFrame, saved: DataFrame, pending: DataFrame, refresh: bool = False, id_col: str = "job_id") -> DataFrame:
    """Requested ids that are active, not pending and, but for a refresh, without a saved text.  An unknown id fails the job."""
    p = postings.select(id_col, F.lit(True).alias("_known"), F.col("archived_at").alias("_archived"))
    out = requested.select(id_col).distinct().join(p, id_col, "left")
    out = out.filter(F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown id "), F.col(id_col).cast("string"))).cast("boolean")).otherwise(F.col("_archived").isNull()))
    for other in [pending] if refresh else [pending, saved]:
        out = out.join(other.select(id_col), id_col, "left_anti")
    return out.select(id_col, F.lit(refresh).alias("refresh"))


def resolved_pending(attempts: DataFrame, postings: DataFrame, saved: DataFrame, id_col: str = "job_id") -> DataFrame:
    """attempts with pending ones interrupted where the record is archived, unchanged where its text is saved already."""
    p = postings.filter("archived_at IS NOT NULL").select(id_col, F.lit(True).alias("_archived"))
    s = saved.select(id_col).distinct().withColumn("_saved", F.lit(True))
    status = F.when((F.col("status") == "pending") & F.col("_archived"), "interrupted").when((F.col("status") == "pending") & F.col("_saved") & ~F.col("refresh"), "unchanged").otherwise(F.col("status"))
    return attempts.join(p, id_col, "left").join(s, id_col, "left").select(*(status.alias(c) if c == "status" else F.col(c) for c in attempts.columns))


def extract_batch(roles: DataFrame, texts: DataFrame, done: DataFrame, n: int = 100, id_col: str = "job_id") -> DataFrame:
    """At most n roles with a saved text and an unknown fingerprint, favourites and newest first."""
    return roles.join(texts.select(id_col, "fingerprint"), id_col).join(done.select("fingerprint"), "fingerprint", "left_anti").orderBy(F.desc("is_favorite"), F.desc("last_seen"), id_col).limit(n)


def retry_batch(work: DataFrame, processable: DataFrame, n: int = 100, id_col: str = "job_id") -> DataFrame:
    """Latest work of processable records that failed or broke off."""
    last = work.groupBy(id_col).agg(F.max("work_id").alias("work_id"), F.max_by("status", "work_id").alias("status"))
    return last.filter("status IN ('failed', 'interrupted')").join(processable.select(id_col), id_col, "left_semi").orderBy("work_id").limit(n)
