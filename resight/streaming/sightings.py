"""Sightings as a stream: the same upsert for each micro-batch, or running figures kept by Spark's state store.

No watermark is set: late sightings are accepted, as first and last seen are a minimum and a maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.sightings import fresh, merged
from .parts import PART_ROWS, PartTables


def _tables(spark: SparkSession, root: str, schema: T.StructType, attributes: list[str], id_col: str, part_rows: int = PART_ROWS) -> PartTables:
    """The state by id; which (id, run) and which (id, time) were seen, each by its own key, so that an id seen very often is spread too."""
    kind = {f.name: f.dataType.simpleString() for f in schema.fields}
    ddl = lambda cols: ", ".join(f"`{c}` {t}" for c, t in cols.items())
    time = kind["observed_at"]
    figures = {c: kind[c] for c in (id_col, *attributes)} | {"first_seen": time, "last_seen": time, "seen_count": "bigint"}
    keyed = lambda c: ([id_col, c], ddl({id_col: kind[id_col], c: kind[c]}))
    return PartTables(spark, root, {"state": ([id_col], ddl(figures)), "runs": keyed("run_id"), "times": keyed("observed_at")}, part_rows)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The state after the newest batch that was finished; empty where none was."""
    last = spark.read.schema("batches bigint, schema string, attributes array<string>, id_col string").parquet(f"{root}/done").orderBy(F.desc("batches")).first()
    tables = _tables(spark, root, T._parse_datatype_json_string(last["schema"]), last["attributes"], last["id_col"])
    return tables.read("state", last["batches"])


def start_ingest(stream: DataFrame, root: str, attributes: list[str], checkpoint: str, *, id_col: str = "job_id", part_rows: int = PART_ROWS) -> StreamingQuery:
    """Upserts each micro-batch (id, run_id, observed_at, arrival, attributes) into the state under root, and adds its sightings (id, run_id,
    observed_at, is_new) as root/sightings/batch=<number>.

    A batch reads and writes the parts that its keys fall into (see PartTables): its cost follows its own size, not the history's.  One
    that is run again, after a loss at any point, writes the same again.  Null runs are never the same run; rows
    without an id are passed over.
    """
    spark = stream.sparkSession
    tables = _tables(spark, root, stream.schema, attributes, id_col, part_rows)
    columns = [id_col, "run_id", "observed_at", "arrival", *attributes]

    def apply(batch: DataFrame, number: int) -> None:
        path = f"{root}/incoming/batch-{number}"
        batch = batch.filter(F.col(id_col).isNotNull()).select(*columns)
        batch.write.mode("overwrite").parquet(path)
        batch = spark.read.schema(batch.schema).parquet(path)
        held = tables.fetch(batch, number)
        known = held["state"].rows.select(id_col, F.lit(True).alias("_known"))
        new = fresh(batch, held["runs"].rows, held["times"].rows, id_col=id_col).join(known, id_col, "left")
        new = new.select(id_col, "run_id", "observed_at", F.col("_known").isNull().alias("is_new"))
        sightings = f"{root}/sightings/batch={number}"
        new.write.mode("overwrite").parquet(sightings)
        new = spark.read.schema(new.schema).parquet(sightings)
        state = merged(held["state"].rows, batch, new, attributes, id_col=id_col)
        rows = {"state": state} | {t: held[t].rows.unionByName(new.select(id_col, c).filter(F.col(c).isNotNull())) for t, c in (("runs", "run_id"), ("times", "observed_at"))}
        tables.put(held, rows, number)
        done = [(number + 1, stream.schema.json(), attributes, id_col)]
        spark.createDataFrame(done, "batches bigint, schema string, attributes array<string>, id_col string").coalesce(1).write.mode("append").parquet(f"{root}/done")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_rollup(stream: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """(id, run_id, first_seen, last_seen) of each id and run so far, for update mode: a row of fixed size for each in Spark's state."""
    return stream.groupBy(id_col, "run_id").agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def rolled_up(updates: DataFrame, *, id_col: str = "job_id") -> DataFrame:
    """(id, first_seen, last_seen, runs) from all updates of running_rollup() that were written: later ones only widen earlier ones."""
    per_run = updates.groupBy(id_col, "run_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return per_run.groupBy(id_col).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("runs"))
