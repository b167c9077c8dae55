"""Sightings of records: resolution to one identity, the upsert of a batch into the state, rollups and data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_value


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def keep_first(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row of each key, the first to arrive."""
    return latest_per_key(df, keys, F.col(arrival).asc())


def rollup(sightings: DataFrame, id_col: str = "job_id", time_col: str = "observed_at") -> DataFrame:
    """(id, first_seen, last_seen, seen_count)"""
    return sightings.groupBy(id_col).agg(F.min(time_col).alias("first_seen"), F.max(time_col).alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))


def distinct_sightings(sightings: DataFrame, id_col: str = "job_id") -> DataFrame:
    """(id, n): different runs, or seconds where a sighting has no run."""
    when = F.coalesce(F.concat(F.lit("run:"), "run_id"), F.concat(F.lit("time:"), F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")))
    return sightings.groupBy(id_col).agg(F.count_distinct(when).alias("n"))


def backfilled(postings: DataFrame, sightings: DataFrame, id_col: str = "job_id", time_col: str = "observed_at", start_col: str = "scraped_at") -> DataFrame:
    """Sightings with one more for each posting that has none, at its start."""
    missing = postings.join(sightings.select(id_col).distinct(), id_col, "left_anti").select(id_col, F.col(start_col).alias(time_col))
    return sightings.select(id_col, time_col).unionByName(missing)


def resolve(batch: DataFrame, stored: DataFrame, *, row: str = "arrival", stored_id: str = "job_id") -> DataFrame:
    """(row, job_id) of the stored record that shares the batch row's first alias that any shares; `names` is the array of aliases on both sides.

    The stored side is brought to one id an alias, the smallest, so that no alias meets itself many times; Spark splits a hot one
    of the batch.  The smallest (place of the alias, stored id) of a row is kept by a pre-aggregated minimum.
    """
    left = batch.select(row, F.posexplode("names").alias("at", "name"))
    right = stored.select(stored_id, F.explode("names").alias("name")).groupBy("name").agg(F.min(stored_id).alias(stored_id))
    best = left.join(right.hint("merge"), "name").groupBy(row).agg(F.min(F.struct("at", stored_id)).alias("m"))
    return best.select(row, F.col(f"m.{stored_id}").alias(stored_id))


# Salaries that say nothing.
UNSPECIFIED = ["", "not specified", "not available", "n/a", "na", "unknown"]


def valid_records(cards: DataFrame, *, default_salary: str = "Not specified") -> tuple[DataFrame, DataFrame]:
    """cards (title, source, company, salary, ...) that have a title, a source and a company, values cleaned and the salary filled in; and the others
    with a reason: which of the three is missing first."""
    clean = {c: clean_value(F.col(c)) for c in ("title", "source", "company")}
    reason = F.coalesce(*(F.when(v == "", F.lit(f"missing {c}")) for c, v in clean.items()))
    out = cards.withColumn("_why", reason)
    good = out.filter("_why IS NULL").select(*(clean_value(F.col(c), default_salary).alias(c) if c == "salary" else clean[c].alias(c) if c in clean else F.col(c) for c in cards.columns))
    return good, out.filter("_why IS NOT NULL").withColumnRenamed("_why", "reason")


def fresh(batch: DataFrame, runs: DataFrame, times: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """The rows of a batch that count: neither their (id, run) nor their (id, time) was seen, before or earlier in the batch."""
    by_run = keep_first(keep_first(batch, [id_col, "run_id"], "arrival"), [id_col, "observed_at"], "arrival")
    return by_run.join(runs.select(id_col, "run_id"), [id_col, "run_id"], "left_anti").join(times.select(id_col, "observed_at"), [id_col, "observed_at"], "left_anti")


def merged(state: DataFrame, batch: DataFrame, counted: DataFrame, attributes: list[str], *, id_col: str = "job_id", keep_old: tuple[str, ...] = ("salary",)) -> DataFrame:
    """The state after a batch of which the rows `counted` (id, observed_at) count; see upsert()."""
    last = batch.groupBy(id_col).agg(F.max_by(F.struct(*attributes), "arrival").alias("_new"), F.min("observed_at").alias("_low"))
    delta = counted.groupBy(id_col).agg(F.max("observed_at").alias("_high"), F.count(F.lit(1)).alias("_n"))
    change = last.join(delta, id_col, "left")
    blank = lambda c: F.lower(F.trim(c.cast("string"))).isin(UNSPECIFIED)
    says = lambda a: F.when(~blank(F.col(f"_new.{a}")), F.col(f"_new.{a}")) if a in keep_old else F.col(f"_new.{a}")
    return state.join(change, id_col, "full_outer").select(
        id_col,
        *(F.coalesce(says(a), F.col(a), F.col(f"_new.{a}")).alias(a) for a in attributes),
        F.least("first_seen", "_low").alias("first_seen"),
        F.greatest("last_seen", "_high").alias("last_seen"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("bigint").alias("seen_count"),
    )


def upsert(state: DataFrame, seen: DataFrame, batch: DataFrame, attributes: list[str], *, id_col: str = "job_id", keep_old: tuple[str, ...] = ("salary",)) -> tuple[DataFrame, DataFrame]:
    """New state and new sightings after a batch (id, run_id, observed_at, arrival, attributes).

    A row of the batch counts unless its (id, run) or (id, time) was seen, before or earlier in the batch.  Attributes are those of the
    last arrival; first and last seen are minimum and maximum, the count grows by the sightings that count.  Applying a batch twice
    changes nothing more.  Of the attributes in keep_old the stored one stays where the incoming one says nothing (UNSPECIFIED).
    """
    counted = fresh(batch, seen, seen, id_col=id_col)
    known = state.select(id_col, F.lit(True).alias("_known"))
    new = counted.select(id_col, "run_id", "observed_at").join(known, id_col, "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")
    return merged(state, batch, counted, attributes, id_col=id_col, keep_old=keep_old), new


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def not_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def readiness(tables: dict[str, DataFrame | None], required: dict[str, Column]) -> DataFrame:
    """(name, present, total, active) of each required table: its rows, and those that its condition calls active.  Nothing is written."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    out = spark.createDataFrame([], "name string, present boolean, total bigint, active bigint")
    for name, active in required.items():
        df = tables.get(name)
        if df is None:
            row = spark.createDataFrame([(name, False, None, None)], out.schema)
        else:
            row = df.agg(F.lit(name).alias("name"), F.lit(True).alias("present"), F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"))
        out = out.unionByName(row)
    return out


def label_agreement(labels: DataFrame, outcomes: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """(label, outcome, n): how often a stored label (id, label) meets an outcome (id, outcome); unlabelled ids are left out, and labels without
    an outcome count under none."""
    j = labels.select(id_col, "label").join(outcomes.select(id_col, "outcome"), id_col, "left")
    return j.groupBy("label", F.coalesce("outcome", F.lit("none")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def active_new(first: DataFrame, active: DataFrame, *, id_col: str = "job_id", worthwhile: int = 5) -> DataFrame:
    """(run_id, active_new, worthwhile) from the run in which each id came first (id, run_id): how many of them are active, and whether that pays."""
    a = active.select(id_col).withColumn("_a", F.lit(True))
    out = first.join(a, id_col, "left").groupBy("run_id").agg(F.count_if("_a").alias("active_new"))
    return out.withColumn("worthwhile", F.col("active_new") >= worthwhile)
