"""Registry of queries, and the tables in the roles that the operators ask for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with SQL for the same rows if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def moment(c) -> F.Column:
    """A time at whole seconds, as text: the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# Customers in the role of postings, their orders in that of sightings.
POSTINGS_SQL = """postings AS (SELECT c_custkey AS job_id, c_mktsegment AS title, 'Employer ' || (c_custkey % 40)::VARCHAR AS company, n_name || ', ' || r_name AS location,
  CASE WHEN c_custkey % 5 = 0 THEN 'board' ELSE 'feed' END AS source, c_acctbal AS salary, c_custkey % 7 = 0 AS is_favorite
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SIGHTINGS_SQL = """sightings AS (SELECT o_custkey AS job_id, strftime(o_orderdate, '%Y-%m') AS run_id, o_orderdate AS observed_at, o_orderkey AS arrival, o_orderpriority AS title, o_orderstatus AS status FROM orders)"""
ROLLUP_SQL = "rollup_ AS (SELECT job_id, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS seen_count FROM sightings GROUP BY job_id)"


def postings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(
        F.col("c_custkey").alias("job_id"),
        F.col("c_mktsegment").alias("title"),
        F.concat(F.lit("Employer "), (F.col("c_custkey") % 40).cast("string")).alias("company"),
        F.concat_ws(", ", "n_name", "r_name").alias("location"),
        F.when(F.col("c_custkey") % 5 == 0, "board").otherwise("feed").alias("source"),
        F.col("c_acctbal").alias("salary"),
        (F.col("c_custkey") % 7 == 0).alias("is_favorite"),
    )


def sightings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("job_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
        F.col("o_orderdate").alias("observed_at"),
        F.col("o_orderkey").alias("arrival"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderstatus").alias("status"),
    )


# Events in the role of a decision log.
DECISIONS_SQL = """decisions AS (SELECT event_id AS decision_id, user_id AS job_id, date_trunc('second', ts) AS decided_at,
  CASE event_type WHEN 'purchase' THEN 'manual' WHEN 'signup' THEN 'manual' ELSE 'rule' END AS decision_source,
  CASE event_type WHEN 'purchase' THEN 'keep' WHEN 'signup' THEN 'archive' WHEN 'error' THEN 'archive' WHEN 'click' THEN 'shadow' ELSE 'keep' END AS decision_action,
  CASE WHEN value < 10 THEN 'title_keyword' WHEN value < 30 THEN 'company' ELSE 'relevance' END AS filter_name, strftime(ts, '%Y-%m-%d') AS batch_id FROM events)"""


def decisions(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("decision_id"),
        F.col("user_id").alias("job_id"),
        F.date_trunc("second", "ts").alias("decided_at"),
        F.when(kind.isin("purchase", "signup"), "manual").otherwise("rule").alias("decision_source"),
        F.when(kind == "purchase", "keep").when(kind.isin("signup", "error"), "archive").when(kind == "click", "shadow").otherwise("keep").alias("decision_action"),
        F.when(F.col("value") < 10, "title_keyword").when(F.col("value") < 30, "company").otherwise("relevance").alias("filter_name"),
        day(F.col("ts")).alias("batch_id"),
    )


# Shipments in the role of matches between searches (suppliers by nation and region) and records (parts).
MATCHES_SQL = """matches AS (SELECT l_partkey AS job_id, s_suppkey AS query_id, s_name AS query_text, n_name AS location, r_name AS query_group, strftime(l_shipdate, '%Y-%m') AS run_id,
  l_shipdate AS observed_at, l_linenumber AS page_offset FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def matches(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, d, "lineitem")
        .join(q, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_partkey").alias("job_id"),
            F.col("s_suppkey").alias("query_id"),
            F.col("s_name").alias("query_text"),
            F.col("n_name").alias("location"),
            F.col("r_name").alias("query_group"),
            F.date_format("l_shipdate", "yyyy-MM").alias("run_id"),
            F.col("l_shipdate").alias("observed_at"),
            F.col("l_linenumber").alias("page_offset"),
        )
    )
