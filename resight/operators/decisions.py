"""An append-only decision log and the state that follows from it.  Hand-made decisions outrank rules, the newest wins, shadows never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(c: str, default: str | None = None) -> Column:
    """Trimmed text; blank is the default."""
    return F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(default))


def validated(batch: DataFrame, at: Column, *, id_col: str = "job_id") -> DataFrame:
    """The rows of a batch that can be recorded, with their defaults.

    Rows without id, filter name or reason are passed over.  A blank source is a rule, a blank action archives, a blank value is null,
    a confidence that is no number is null, details are {} if blank, and a decision without a time is made at `at`.  Columns that batch doesn't have count as blank.
    """
    for c in ("decision_source", "decision_action", "matched_value", "confidence", "details"):
        if c not in batch.columns:
            batch = batch.withColumn(c, F.lit(None).cast("string"))
    when = F.coalesce("decided_at", at) if "decided_at" in batch.columns else at
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    some = batch.filter(~blank(id_col) & ~blank("filter_name") & ~blank("reason"))
    return some.withColumns({
        "decision_source": _said("decision_source", "rule"), "decision_action": _said("decision_action", "archive"), "filter_name": _said("filter_name"), "reason": _said("reason"),
        "matched_value": _said("matched_value"), "confidence": F.expr("try_cast(trim(confidence) AS double)"), "details": _said("details", "{}"), "decided_at": when,
    })


def recorded(batch: DataFrame, log: DataFrame, at: Column, *, id_col: str = "job_id") -> DataFrame:
    """Rows of a batch, as validated() leaves them, that the log does not have yet for (id, filter, action, batch); rows without a batch are always new,
    and of rows with the same decision_id one is taken."""
    ok = validated(batch, at, id_col=id_col)
    keys = [id_col, "filter_name", "decision_action", "batch_id"]
    if "decision_id" in ok.columns:
        ok = ok.filter("decision_id IS NOT NULL").dropDuplicates(["decision_id"]).unionByName(ok.filter("decision_id IS NULL"))
    return ok.join(log.select(*keys).distinct(), keys, "left_anti")


def manual_overrides(log: DataFrame, notes: DataFrame | None = None, *, id_col: str = "job_id") -> DataFrame:
    """(id, action): the latest hand-made intent, from decisions and from notes (interesting, rejected); ties favour decisions."""
    made = log.filter("decision_source = 'manual' AND decision_action IN ('keep', 'restore', 'archive')")
    made = made.select(id_col, F.when(F.col("decision_action") == "archive", "archive").otherwise("keep").alias("action"), F.col("decided_at").alias("at"), F.lit(1).alias("rank"), "decision_id")
    if notes is not None:
        said = notes.filter("status IN ('interesting', 'rejected')")
        made = made.unionByName(said.select(id_col, F.when(F.col("status") == "interesting", "keep").otherwise("archive").alias("action"), F.col("noted_at").alias("at"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("decision_id")))
    return made.groupBy(id_col).agg(F.max_by("action", F.struct("at", "rank", "decision_id")).alias("action"))


def current(log: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """The newest decision of each id that is no shadow."""
    best = log.filter("decision_action <> 'shadow'").groupBy(id_col).agg(F.max_by(F.struct("decision_source", "decision_action", "filter_name", "decided_at"), F.struct("decided_at", "decision_id")).alias("d"))
    return best.select(id_col, "d.*")


def auto_archived(state: DataFrame, log: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """Archived rows without a hand-made outcome whose current decision is a rule's archive."""
    by_rule = current(log, id_col=id_col).filter("decision_source = 'rule' AND decision_action = 'archive'").select(id_col)
    return state.filter("archived_at IS NOT NULL AND NOT coalesce(outcome, '') IN ('manual_keep', 'manual_archive')").join(by_rule, id_col, "left_semi")


def archived(state: DataFrame, chosen: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """state with the active rows of chosen (id, reason, at, manual) archived; rows archived before keep what they have."""
    c = chosen.select(id_col, F.struct("reason", "at", "manual").alias("_c"))
    now = F.col("archived_at").isNull() & F.col("_c").isNotNull()
    return state.join(c, id_col, "left").select(
        *(x for x in state.columns if x not in ("archived_at", "archived_reason", "outcome")),
        F.when(now, F.col("_c.at")).otherwise(F.col("archived_at")).alias("archived_at"),
        F.when(now, F.col("_c.reason")).otherwise(F.col("archived_reason")).alias("archived_reason"),
        F.when(now & F.col("_c.manual"), "manual_archive").otherwise(F.col("outcome")).alias("outcome"),
    )


def members_of(ids: DataFrame, membership: DataFrame, *, id_col: str = "job_id", root: str = "canonical_job_id") -> DataFrame:
    """All members of the groups that the ids belong to; membership holds a row for each record, itself included."""
    roots = ids.select(id_col).join(membership, id_col).select(root).distinct()
    return membership.join(roots, root).select(id_col).distinct()


def _put(state: DataFrame, **values: Column) -> DataFrame:
    """state with the values in the columns of these names that it has."""
    return state.withColumns({c: v for c, v in values.items() if c in state.columns})


def archived_with_decisions(state: DataFrame, batch: DataFrame, at: Column, *, default_reason: str = "Archived by filter", order: str = "decision_id", id_col: str = "job_id") -> dict[str, DataFrame]:
    """state after a batch of decisions, and the decisions to append to the log (both or neither are to be written).

    Active rows with a decision to archive, or without an action, are archived for the first reason in the batch's order, default_reason if that is blank,
    even if the decision itself can't be recorded.  Rows with a hand-made one get that outcome, also if they were archived before, its last reason, and no role family.
    counts: rows archived and decisions recorded.
    """
    said = batch.select(id_col, F.lower(_said("decision_action", "archive")).alias("action"), F.lower(_said("decision_source", "")).alias("source"), F.lower(F.coalesce("decision_action", F.lit(""))).alias("given"), F.trim("reason").alias("reason"), F.col(order).alias("nth"))
    said = said.filter(F.col(id_col).isNotNull() & (F.col("action") == "archive"))
    by_hand = (F.col("source") == "manual") & (F.col("given") == "archive")
    acts = said.groupBy(id_col).agg(
        F.min_by(F.coalesce(F.nullif("reason", F.lit("")), F.lit(default_reason)), "nth").alias("_reason"),
        F.bool_or(by_hand).alias("_hand"),
        F.max_by(F.coalesce(F.nullif("reason", F.lit("")), F.lit("Archived manually")), F.when(by_hand, F.col("nth"))).alias("_why"),
    )
    both = state.join(acts, id_col, "left").withColumn("_now", F.col("archived_at").isNull() & F.col("_reason").isNotNull()).withColumn("_hand", F.coalesce("_hand", F.lit(False)))
    now, hand = F.col("_now"), F.col("_hand")
    pick = lambda when, value, c: F.when(when, value).otherwise(F.col(c))
    out = _put(
        both, archived_at=pick(now, at, "archived_at"), archived_reason=pick(now, F.col("_reason"), "archived_reason"), outcome=pick(hand, F.lit("manual_archive"), "outcome"),
        role_family=F.when(~hand, F.col("role_family")), reason=pick(hand, F.col("_why"), "reason"), evaluated_at=pick(hand, at, "evaluated_at"),
    )
    made = validated(batch, at, id_col=id_col)
    counts = both.agg(F.count_if("_now").alias("archived")).crossJoin(F.broadcast(made.agg(F.count(F.lit(1)).alias("recorded"))))  # one row each
    return {"state": out.select(*state.columns), "decisions": made, "counts": counts}


def _for_members(ids: DataFrame, membership: DataFrame, action: str, name: str, reason: str, at: Column, source: str, id_col: str) -> DataFrame:
    """A decision for each member of the ids' groups."""
    m = members_of(ids, membership, id_col=id_col)
    return m.select(id_col, F.lit(source).alias("decision_source"), F.lit(action).alias("decision_action"), F.lit(name).alias("filter_name"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("matched_value"), F.lit(None).cast("double").alias("confidence"), F.lit("{}").alias("details"), at.alias("decided_at"))


def manually_archived(state: DataFrame, ids: DataFrame, membership: DataFrame, at: Column, *, reason: str = "Archived manually", id_col: str = "job_id") -> dict[str, DataFrame]:
    """state with all members of the ids' groups archived by hand, one decision for each of them, and counts, as archived_with_decisions() gives them.
    Where counts say that none was archived, all were before."""
    batch = _for_members(ids, membership, "archive", "manual_archive", reason, at, "manual", id_col)
    return archived_with_decisions(state, batch, at, default_reason=reason, order=id_col, id_col=id_col)


def restored(state: DataFrame, ids: DataFrame, membership: DataFrame, at: Column, *, reason: str = "Restored for reconsideration", source: str = "manual", id_col: str = "job_id") -> dict[str, DataFrame]:
    """state with all members of the ids' groups active again, kept by hand and without a role family, and one decision for each of them."""
    made = _for_members(ids.join(state.select(id_col), id_col, "left_semi"), membership, "restore", "manual_restore", reason, at, source, id_col)
    both = state.join(made.select(id_col, F.lit(True).alias("_m")), id_col, "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    hit = F.col("_m")
    clear = lambda c: F.when(~hit, F.col(c))
    pick = lambda value, c: F.when(hit, value).otherwise(F.col(c))
    out = _put(both, archived_at=clear("archived_at"), archived_reason=clear("archived_reason"), role_family=clear("role_family"), outcome=pick(F.lit("manual_keep"), "outcome"), reason=pick(F.lit(reason), "reason"), evaluated_at=pick(at, "evaluated_at"))
    return {"state": out.select(*state.columns), "decisions": made}


def flagged(state: DataFrame, ids: DataFrame, membership: DataFrame, at: Column, *, on: bool = True, id_col: str = "job_id") -> DataFrame:
    """state with the groups' members flagged: the first flag time and an old reason stay; unflagging clears both."""
    wanted = ids.select(id_col, "reason").join(membership, id_col).groupBy("canonical_job_id").agg(F.max("reason").alias("reason"))
    m = membership.join(wanted, "canonical_job_id").select(id_col, F.struct(F.col("reason")).alias("_m"))
    hit = F.col("_m").isNotNull()
    time = F.when(hit, F.coalesce("flagged_at", at) if on else F.lit(None)).otherwise(F.col("flagged_at"))
    why = F.when(hit, F.coalesce("_m.reason", "flag_reason") if on else F.lit(None)).otherwise(F.col("flag_reason"))
    return state.join(m, id_col, "left").select(*(x for x in state.columns if x not in ("flagged_at", "flag_reason")), time.alias("flagged_at"), why.alias("flag_reason"))


def overlaid(state: DataFrame, change: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Upsert by key: columns of change that are not null replace those of state, new keys are added."""
    c = change.select(*keys, F.struct(*columns).alias("_c"))
    return state.join(c, keys, "full_outer").select(*keys, *(F.coalesce(F.col(f"_c.{x}"), F.col(x)).alias(x) for x in columns), *(x for x in state.columns if x not in (*keys, *columns)))
