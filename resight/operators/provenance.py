"""Which searches found what, and how search scopes overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded
from ..functions.values import counter

# Why a search can stop without a concern.
GOOD_STOPS = ["page_limit", "short_page", "empty_page"]


def scope_of(df: DataFrame, location: str, cities: list[str], countrywide: list[str]) -> DataFrame:
    """df with scope: countrywide, cities or null, by a lookup that ignores case and accents."""
    spark = df.sparkSession
    names = [(n, "cities") for n in cities] + [(n, "countrywide") for n in countrywide]
    known = spark.createDataFrame(names, "name string, scope string").select(folded(F.col("name")).alias("_k"), "scope")
    return df.withColumn("_k", folded(F.col(location))).join(F.broadcast(known), "_k", "left").drop("_k")


def collected(matches: DataFrame, id_col: str = "job_id") -> DataFrame:
    """(id, provenance): the different (group, text, location) that found it, sorted."""
    one = matches.select(id_col, "query_group", "query_text", "location").distinct()
    return one.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("query_group", "query_text", "location"))).alias("provenance"))


def detail(matches: DataFrame, id_col: str = "job_id", n: int | None = None) -> DataFrame:
    """For each id and search: smallest page offset, newest sighting, runs; nth is its place, newest first.  With n only the first n of an id."""
    out = matches.groupBy(id_col, "query_group", "query_text", "location").agg(F.min("page_offset").alias("page_offset"), F.max("observed_at").alias("last_observed"), F.count_distinct("run_id").alias("runs"))
    newest = Window.partitionBy(id_col).orderBy(F.desc("last_observed"), "query_text", "location", "query_group")
    out = out.withColumn("nth", F.row_number().over(newest).cast("bigint"))
    return out if n is None else out.filter(F.col("nth") <= n)


def record_queries(known: DataFrame, reports: DataFrame, columns: list[str], order: str) -> DataFrame:
    """known searches (query_id, run_id, query_text, location, columns) after a run's reports: the last report of a search replaces what
    is known of it, blank searches are passed over, new ones get an id that follows from run, text and location."""
    keys = ["run_id", "query_text", "location"]
    some = reports.filter((F.trim("query_text") != "") & F.col("run_id").isNotNull())
    last = some.groupBy("run_id", F.trim("query_text").alias("query_text"), F.trim(F.coalesce("location", F.lit(""))).alias("location")).agg(F.max_by(F.struct(*columns), order).alias("_new"))
    out = known.join(last, keys, "full_outer")
    return out.select(F.coalesce("query_id", F.xxhash64(*keys)).alias("query_id"), *keys, *(F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c) for c in columns))


def record_matches(bridge: DataFrame, matches: DataFrame, resolved: DataFrame, queries: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Rows (id, query_id) to append to the bridge: matches (name, run_id, query_text, location) whose name resolves to an id and whose search is known,
    each once and not there yet."""
    found = matches.join(resolved.select("name", id_col), "name").join(queries.select("run_id", "query_text", "location", "query_id"), ["run_id", "query_text", "location"])
    return found.select(id_col, "query_id").distinct().join(bridge.select(id_col, "query_id"), [id_col, "query_id"], "left_anti")


def query_coverage(reports: DataFrame, order: str) -> DataFrame:
    """Normalised diagnostics of a run's searches in query order: offsets from JSON, counts never negative, why it stopped."""
    counts = [c for c in ("pages_attempted", "pages_completed", "raw_cards", "valid_jobs", "duplicate_cards", "request_attempts") if c in reports.columns]
    offsets = F.array_sort(F.coalesce(F.from_json("page_offsets", "array<bigint>"), F.expr("cast(array() AS array<bigint>)")))
    rest = [c for c in reports.columns if c not in (*counts, "page_offsets", "stop_reason")]
    return reports.select(*rest, *(counter(F.col(c)).alias(c) for c in counts), offsets.alias("page_offsets"), F.coalesce(F.nullif(F.trim("stop_reason"), F.lit("")), F.lit("unknown")).alias("stop_reason")).orderBy(order)


def coverage(reports: DataFrame, failures: list[str]) -> DataFrame:
    """Totals over query reports; incomplete ones stopped for one of the failures."""
    sums = ["pages_attempted", "pages_completed", "raw_cards", "valid_jobs", "duplicate_cards", "request_attempts", "request_failures", "rate_limit_responses"]
    return reports.agg(F.count(F.lit(1)).alias("queries"), *(F.sum(c).alias(c) for c in sums), F.count_if(F.col("stop_reason").isin(failures)).alias("incomplete"))


def concerns(reports: DataFrame) -> DataFrame:
    """reports with concern: failures, no jobs, no or unfinished pages, or a stop that is no good one."""
    bad = (F.col("failures") > 0) | (F.col("valid_jobs") == 0) | (F.col("pages_attempted") == 0) | (F.col("pages_completed") < F.col("pages_attempted")) | ~F.coalesce(F.col("stop_reason"), F.lit("")).isin(GOOD_STOPS)
    return reports.withColumn("concern", bad)


def overlap(matches: DataFrame, id_col: str = "job_id", scope_col: str = "scope", first: str = "countrywide", second: str = "cities") -> DataFrame:
    """One row of how two scopes overlap: ids of each, shared, only in one, and the share of the second's that the first covers.

    No row unless both scopes found something.
    """
    flags = matches.groupBy(id_col).agg(F.bool_or(F.col(scope_col) == first).alias("a"), F.bool_or(F.col(scope_col) == second).alias("b"))
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    out = flags.agg(F.count_if(a).alias("first_ids"), F.count_if(b).alias("second_ids"), F.count_if(a & b).alias("shared"), F.count_if(a & ~b).alias("first_only"), F.count_if(b & ~a).alias("second_only"))
    return out.filter("first_ids > 0 AND second_ids > 0").withColumn("second_covered", F.bround(100.0 * F.col("shared") / F.col("second_ids"), 1))


def comparisons(queries: DataFrame, matches: DataFrame, by: str = "run_id", *, id_col: str = "job_id", first: str = "countrywide", second: str = "cities") -> DataFrame:
    """(by, comparison) of each run in which both scopes were searched: for `first` and `second` queries, pages attempted and completed, failed requests,
    different ids and completion in percent; ids shared, only in one, the share of the second's that the first covers; and `places`, sorted,
    with ids, those shared and only there.

    queries: (by, scope, pages_attempted, pages_completed, failures, and location if places without a match are wanted); matches: (by, id, scope,
    location).  The matches are read once for all runs: the scopes of an id are merged as bits.  Places are the locations of the second scope; null
    ones, and null ids, count for none; null figures are 0.
    """
    scopes = [first, second]
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    q = queries.filter(F.col("scope").isin(scopes))
    figures = {"queries": F.lit(1), "pages_attempted": zero("pages_attempted"), "pages_completed": zero("pages_completed"), "failures": zero("failures")}
    ran = q.groupBy(by).agg(*(F.sum(F.when(F.col("scope") == s, c).otherwise(0)).alias(f"{s}_{n}") for s in scopes for n, c in figures.items())).filter(" AND ".join(f"`{s}_queries` > 0" for s in scopes))
    bit = F.when(F.col("scope") == first, 1).otherwise(2)
    place = F.when(F.col("scope") == second, F.col("location"))
    ids = matches.filter(F.col("scope").isin(scopes) & F.col(id_col).isNotNull()).groupBy(by, id_col).agg(F.bit_or(bit).alias("bits"), F.collect_set(place).alias("at"))  # an entry for each place searched
    spot = lambda c: F.struct(c.isNull().alias("all"), c.alias("location"))
    spread = ids.select(by, "bits", F.explode(F.concat(F.array(spot(F.lit(None).cast("string"))), F.transform("at", lambda c: spot(c)))).alias("x"))
    counts = spread.groupBy(by, "x.all", "x.location").agg(F.count_if(F.col("bits") != 2).alias("a"), F.count_if(F.col("bits") != 1).alias("b"), F.count_if(F.col("bits") == 3).alias("both"))
    places = counts.filter("NOT all").select(by, "location", F.col("b").alias("ids"), F.col("both").alias("shared"))
    if "location" in queries.columns:
        places = q.filter((F.col("scope") == second) & F.col("location").isNotNull()).select(by, "location").distinct().join(places, [by, "location"], "left")
    item = F.struct("location", F.coalesce("ids", F.lit(0)).alias("ids"), F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce(F.col("ids") - F.col("shared"), F.lit(0)).alias("only"))
    places = places.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("places"))
    out = ran.join(counts.filter("all"), by, "left").join(places, by, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    percent = lambda x, of: F.when(of > 0, F.bround(100.0 * x / of, 1)).otherwise(0.0)
    scope = lambda s, ids: F.struct(*(F.col(f"{s}_{f}").alias(f) for f in figures), ids.alias("ids"), percent(F.col(f"{s}_pages_completed"), F.col(f"{s}_pages_attempted")).alias("completion"))
    none = F.expr("cast(array() AS array<struct<location:string,ids:bigint,shared:bigint,only:bigint>>)")
    parts = [scope(first, n("a")).alias("first"), scope(second, n("b")).alias("second"), n("both").alias("shared"), (n("a") - n("both")).alias("first_only"), (n("b") - n("both")).alias("second_only"), percent(n("both"), n("b")).alias("second_covered"), F.coalesce("places", none).alias("places")]
    return out.select(by, F.struct(*parts).alias("comparison"))


def comparison(queries: DataFrame, matches: DataFrame, *, id_col: str = "job_id", first: str = "countrywide", second: str = "cities") -> DataFrame:
    """(section, name, value) of how two search scopes compare: comparisons() of all searches taken as one run, a figure a row.

    Sections are the two scopes, overlap, and `city <location>` for each place.  No row unless both scopes were searched.
    """
    one = lambda df: df.withColumn("_run", F.lit(1))
    c = comparisons(one(queries), one(matches), "_run", id_col=id_col, first=first, second=second).select("comparison.*")
    value = lambda section, name, x: F.named_struct(F.lit("section"), section, F.lit("name"), F.lit(name), F.lit("value"), x.cast("double"))
    names = {"queries": "queries", "pages": "pages_attempted", "completed": "pages_completed", "failures": "failures", "completion": "completion", "ids": "ids"}
    items = [value(F.lit(s), n, F.col(f"{side}.{f}")) for s, side in ((first, "first"), (second, "second")) for n, f in names.items()]
    items += [value(F.lit("overlap"), n, F.col(n)) for n in ("shared", "first_only", "second_only", "second_covered")]
    city = F.flatten(F.transform("places", lambda p: F.array(*(value(F.concat(F.lit("city "), p["location"]), k, p[k]) for k in ("ids", "shared", "only")))))
    return c.select(F.explode(F.concat(F.array(*items), city)).alias("x")).select("x.*")


def capped(rows: DataFrame, per_query: int, overall: int) -> DataFrame:
    """At most per_query rows of each query, and of them at most overall, in query order."""
    nth = F.row_number().over(Window.partitionBy("query_pos").orderBy("seq"))
    return rows.withColumn("_n", nth).filter(F.col("_n") <= per_query).drop("_n").orderBy("query_pos", "seq").limit(overall)
