"""Tables of rows by key on plain Parquet, in parts that split as they grow: a batch reads and writes only the parts that its keys fall into."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a part should hold.  What a batch of k keys reads and writes is at most k parts, however long the history is.
PART_ROWS = 500_000
#: Every so many batches the list of parts is written whole, in between what changed.
FULL_EVERY = 64
_DEEPEST = 40
_LIST = "name string, depth int, part bigint, batch bigint, rows bigint, at bigint"


def _slot(keys: list[str]) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << _DEEPEST))


def _part(keys: list[str], depth: int) -> F.Column:
    return _slot(keys) % F.lit(1 << depth)


@dataclass
class Held:
    """What a batch got of one table: rows of the parts that its keys fall into, and where it will put them."""

    depth: int
    rows: DataFrame
    parts: list[tuple[int, int]] = field(default_factory=list)  # (depth, part), read and replaced by put()


@dataclass
class PartTables:
    """Tables under root by name: key columns and schema.  Each key has one row in its table, and no nulls.

    The keys are spread by hash over 2^depth parts; the depth follows the table's rows.  Where it has grown, a part of less depth is
    split when a batch next touches it, so that no batch rewrites the whole table.  Every batch writes new versions of the parts
    that it touches, under its number, then the list of what changed.  Readers go by the list, so a batch that is lost or run again, at any
    point, leaves and gives the same tables.  Batches are numbered from 0 without gaps.  Parts that were replaced stay on disk.
    For a batch the driver holds the parts that it touches; read() lists all of a table.
    """

    spark: SparkSession
    root: str
    tables: dict[str, tuple[list[str], str]]
    part_rows: int = PART_ROWS

    def _list(self, before: int) -> DataFrame:
        """The living parts, as the batches before this number left them."""
        if before <= 0:
            return self.spark.createDataFrame([], _LIST)
        full = (before - 1) // FULL_EVERY * FULL_EVERY
        changes = self.spark.read.schema(_LIST).parquet(*(f"{self.root}/parts/batch-{n}" for n in range(full, before)))
        last = changes.groupBy("name", "depth", "part").agg(F.max_by(F.struct("batch", "rows"), "at").alias("x"))
        return last.select("name", "depth", "part", "x.*").filter("batch IS NOT NULL")

    def _read(self, name: str, parts: list[tuple[int, int, int]]) -> DataFrame:
        """Rows of parts (batch, depth, part)."""
        schema = self.tables[name][1]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/batch-{b}/depth={d}/part={p}" for b, d, p in sorted(parts)))

    def fetch(self, batch: DataFrame, number: int) -> dict[str, Held]:
        """For each table the rows of all parts that keys of the batch fall into, as the batches before it left them."""
        living = self._list(number)
        now = {r["name"]: r for r in living.groupBy("name").agg(F.sum("rows").alias("rows"), F.collect_set("depth").alias("depths")).collect()}  # a row a table
        # all keys of the batch may be new; an estimate will do, as it only says how finely a table is cut
        new = batch.agg(*(F.approx_count_distinct(F.xxhash64(*keys)).alias(name) for name, (keys, _) in self.tables.items())).first()
        depth = {}
        for name in self.tables:
            have = now.get(name)
            wanted = max(0, -(-((have["rows"] if have else 0) + new[name]) // self.part_rows) - 1).bit_length()
            depth[name] = max([min(wanted, _DEEPEST), *(have["depths"] if have else [])])
        asked = None
        for name, (keys, _) in self.tables.items():
            if name in now:
                depths = F.array(*(F.lit(d) for d in sorted(now[name]["depths"])))
                one = batch.select(_part(keys, depth[name]).alias("_p")).distinct().select(F.lit(name).alias("name"), "_p", F.explode(depths).alias("depth"))
                one = one.select("name", "depth", F.expr("_p % shiftleft(1L, depth)").alias("part")).distinct()
                asked = one if asked is None else asked.unionByName(one)
        touched = living.join(asked.hint("merge"), ["name", "depth", "part"], "left_semi").collect() if asked is not None else []  # at most one for each key and depth
        out = {}
        for name in self.tables:
            mine = [(r["batch"], r["depth"], r["part"]) for r in touched if r["name"] == name]
            out[name] = Held(depth[name], self._read(name, mine), [(d, p) for _, d, p in mine])
        return out

    def put(self, held: dict[str, Held], rows: dict[str, DataFrame], number: int) -> None:
        """Writes rows, all of what held[name] had and what is new, in the place of the parts that were fetched."""
        changes = self.spark.createDataFrame([(n, d, p, None, None, number) for n, h in held.items() for d, p in h.parts], _LIST)
        for name, df in rows.items():
            keys, schema = self.tables[name]
            cut = _part(keys, held[name].depth)
            path = f"{self.root}/{name}/batch-{number}"
            df.withColumn("depth", F.lit(held[name].depth)).withColumn("part", cut).repartition("part").sortWithinPartitions("part", *keys).write.mode("overwrite").partitionBy("depth", "part").parquet(path)
            count = self.spark.read.schema(f"{schema}, depth int, part bigint").parquet(path).groupBy("depth", "part").agg(F.count(F.lit(1)).alias("rows"))
            changes = changes.unionByName(count.select(F.lit(name).alias("name"), "depth", "part", F.lit(number).cast("bigint").alias("batch"), "rows", F.lit(number).cast("bigint").alias("at")))
        # a part that is written again under its own number is replaced, not gone
        changes = changes.groupBy("name", "depth", "part").agg(F.max("batch").alias("batch"), F.max("rows").alias("rows"), F.max("at").alias("at"))
        if number % FULL_EVERY == 0 and number:
            rest = self._list(number).join(changes.select("name", "depth", "part"), ["name", "depth", "part"], "left_anti").withColumn("at", F.lit(number).cast("bigint"))
            changes = changes.unionByName(rest)
        changes.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/parts/batch-{number}")

    def read(self, name: str, batches: int) -> DataFrame:
        """The whole table after so many batches."""
        parts = self._list(batches).filter(F.col("name") == name).collect()
        return self._read(name, [(r["batch"], r["depth"], r["part"]) for r in parts])
