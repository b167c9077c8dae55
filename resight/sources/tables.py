"""Typed reads, idempotent imports, append-only logs and versioned snapshots on plain Parquet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where it is unset: in a temporary one if driver and executors are one process (tests), else an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def conformed(df: DataFrame, schema: str, defaults: dict) -> DataFrame:
    """df with the schema's columns first: missing ones with their default, null where there is none; other columns stay."""
    want = T.StructType.fromDDL(schema)
    have = set(df.columns)
    cols = []
    for f in want.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        cols.append((F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name))
    names = {f.name for f in want.fields}
    return df.select(*cols, *(c for c in df.columns if c not in names))


def read_typed(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    return conformed(spark.read.parquet(path), schema, defaults or {})


def records_to_frame(records: DataFrame, column: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """JSON records as typed rows."""
    return conformed(records.select(F.from_json(column, schema).alias("r")).select("r.*"), schema, defaults or {})


def latest_snapshots(pages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, content_sha256) of each key's newest page that is no plain text."""
    p = pages.filter("NOT content_type LIKE 'text/plain%'")
    out = p.groupBy(key).agg(F.max_by(F.struct(order, F.sha2("body", 256).alias("content_sha256")), order).alias("s"))
    return out.select(key, "s.*")


def import_text(df: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content_sha256) of texts to add: not blank, no failure marker, not known by content, each content once."""
    t = df.filter((F.trim(text_col) != "") & (F.col(text_col) != "FETCH_FAILED")).select(id_col, F.sha2(F.encode(text_col, "utf-8"), 256).alias("content_sha256"))
    return t.groupBy("content_sha256").agg(F.min(id_col).alias(id_col)).join(known.select("content_sha256"), "content_sha256", "left_anti").select(id_col, "content_sha256")


def save_versions(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append by version key; an old version with other content fails the job."""
    o = old.select(*keys, F.col("sha256").alias("_old"))
    same = F.when(F.col("_old").isNotNull() & (F.col("_old") != F.col("sha256")), F.raise_error(F.lit("a version's content changed")).cast("boolean")).otherwise(F.col("_old").isNull())
    return new.join(o, keys, "left").filter(same).drop("_old")


def backfill_refresh(attempts: DataFrame, texts: DataFrame) -> DataFrame:
    """attempts with refresh: pending ones whose text was there when they were requested."""
    first = texts.groupBy("job_id").agg(F.min("extracted_at").alias("_first"))
    out = attempts.join(first, "job_id", "left")
    return out.withColumn("refresh", F.coalesce((F.col("status") == "pending") & (F.col("_first") <= F.col("requested_at")), F.lit(False))).drop("_first")


def append_log(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def write_snapshot(df: DataFrame, root: str) -> str:
    """A new version of a state table beside the old ones, then the pointer to it: readers never see half a table."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/v-{version}")
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/pointer")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", "at")).first()[0]
    return spark.read.parquet(f"{root}/v-{version}")
