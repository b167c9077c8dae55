"""What the operators share on Spark's side: tables, cut lineage, row order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is named: a temporary one if driver and executors are one process (tests), else an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it again, whatever executors are lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered(docs: DataFrame, id_col: str, *keep: str) -> tuple[DataFrame, bool]:
    """docs with a unique bigint `_ord` that sorts as id_col does (null first; equal ids in any fixed order).

    Where the ids are unique whole numbers, they are the order, and nothing is shuffled but the ids; the second
    result tells whether that is so.  Ids of other types, null or repeated ones are put in their own order, by ranges that Spark draws
    anew in each call: two calls number the rows differently.  The table that is returned is written and stays as it is, so
    whoever needs rows and numbers twice must use it twice.
    """
    docs = docs.select(id_col, *keep)
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("ids")).first()
    if whole and n["n"] == n["ids"] and not docs.groupBy(id_col).count().filter("count > 1").limit(1).count():
        return docs.withColumn("_ord", F.col(id_col).cast("bigint")), True
    rest = [c for c in keep if c in docs.columns]
    ranged = docs.repartitionByRange(F.col(id_col).asc_nulls_first(), *rest).sortWithinPartitions(F.col(id_col).asc_nulls_first(), *rest)
    return written(ranged.withColumn("_ord", F.monotonically_increasing_id()), "ordered"), False


def schema_of(fields: list[T.StructField], more: str) -> T.StructType:
    """The fields with those of a DDL string after them."""
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])
