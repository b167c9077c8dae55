"""List queries and windowed summaries whose counts match their drill-downs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_contains, primary_location
from ..functions.values import active_days
from ..sources.tables import scratch
from .decisions import auto_archived
from .provenance import comparisons, detail


def predicates(
    *, archived: str = "exclude", favorite: bool | None = None, flagged: bool | None = None, search: str | None = None, scope: str | None = None, source: str | None = None, company: str | None = None, company_exact: bool = False,
    family: str | None = None, seen_since=None, date_from=None, date_to=None, repeated: bool | None = None, outcome: str | None = None, seen: Column | None = None, collected: Column | None = None,
) -> Column:
    """One condition from the named filters that look at a role's own columns; Catalyst pushes its parts down.

    Searches fold A-Z and take % and _ as they are; scope folds the source, source doesn't.  A company is matched by a part of its name, or exactly, where a blank
    one is called Unknown.  The family unclassified is none.  Bounds of time hold for whole seconds: seen_since for `seen` (last_seen by
    default), date_from and date_to for `collected` (first_seen by default).
    """
    c: list[Column] = [F.lit(True)]
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    seconds = lambda x: F.date_trunc("second", x)
    if archived != "include":
        c.append(F.col("is_archived") if archived == "only" else ~F.col("is_archived"))
    if favorite is not None:
        c.append(F.col("is_favorite") == favorite)
    if flagged is not None:
        c.append(F.col("flagged_at").isNotNull() == flagged)
    if search:
        c.append(reduce(lambda a, b: a | b, (ascii_contains(F.col(x), F.lit(search)) for x in ("title", "company", "location"))))
    if scope:
        c.append(F.lower("source") == scope.lower())
    if source:
        c.append(F.col("source") == source)
    if company:
        c.append(F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown")) == company if company_exact else ascii_contains(F.col("company"), F.lit(company)))
    if family:
        c.append(F.coalesce("role_family", F.lit("")) == ("" if family == "unclassified" else family))
    if seen_since is not None:
        c.append(seconds(F.col("last_seen") if seen is None else seen) >= at(seen_since))
    for bound, after in ((date_from, True), (date_to, False)):
        if bound is not None:
            when = seconds(F.col("first_seen") if collected is None else collected)
            c.append(when >= at(bound) if after else when <= at(bound))
    if repeated:
        c.append(F.coalesce("seen_count", F.lit(1)) > 1)
    if outcome:
        c.append(F.col("outcome") == outcome)
    return reduce(lambda a, b: a & b, c)


def filtered(
    roles: DataFrame, *, membership: DataFrame | None = None, postings: DataFrame | None = None, matches: DataFrame | None = None, log: DataFrame | None = None, location: str | None = None, location_primary: bool = False,
    query_group: str | None = None, outcome: str | None = None, aliases: dict[str, str] | None = None, id_col: str = "job_id", **filters,
) -> DataFrame:
    """The roles that meet all filters: conditions on their own columns, then a semi join for each filter that asks whether something else exists.

    location: some member of the role (membership: id, canonical_job_id; postings: id, location) holds it, or with location_primary has the
    same primary one.  query_group: some member was found by a search of that group (matches: id, query_group).  outcome auto_archived: the role
    stands archived by a rule (log: decisions), whatever `archived` says.  Each side is cut to the ids asked for before it is joined; a role is given once however many members meet
    a filter.  Without membership each role is its own only member.  Nulls meet no filter; no filter at all leaves all active roles.
    """
    root = "canonical_job_id"
    own = roles.select(id_col, F.col(id_col).alias(root)) if membership is None else membership.select(id_col, root)
    if outcome == "auto_archived":
        out = auto_archived(roles.filter(predicates(**{**filters, "archived": "include"})), log, id_col=id_col)
    else:
        out = roles.filter(predicates(outcome=outcome, **filters))
    asked: list[DataFrame] = []
    if location:
        place = F.col("location")
        same = primary_location(place, aliases) == primary_location(F.lit(location), aliases) if location_primary else ascii_contains(place, F.lit(location))
        asked.append((roles if postings is None else postings).filter(same).select(id_col))
    if query_group:
        asked.append(matches.filter(F.col("query_group") == query_group).select(id_col))
    for ids in asked:
        out = out.join(ids.join(own, id_col).select(F.col(root).alias(id_col)), id_col, "left_semi")
    return out


def sort_orders(id_col: str = "job_id") -> dict[str, list[Column]]:
    """Named orders; the id makes each of them total."""
    i = F.col(id_col).asc()
    return {
        "newest": [F.col("last_seen").desc(), i],
        "oldest": [F.col("last_seen").asc(), i],
        "first_seen": [F.col("first_seen").desc(), i],
        "title": [F.lower("title").asc(), i],
        "company": [F.lower("company").asc(), F.lower("title").asc(), i],
        "location": [F.lower("location").asc(), i],
        "seen": [F.col("seen_count").desc(), F.col("last_seen").desc(), i],
        "favorite": [F.col("is_favorite").desc(), F.col("last_seen").desc(), i],
    }


def page(df: DataFrame, order: str = "newest", limit: int = 50, offset: int = 0, id_col: str = "job_id") -> DataFrame:
    """A page of 1 to 200 rows in a named order (unknown names mean newest)."""
    orders = sort_orders(id_col)
    return df.orderBy(*orders.get(order, orders["newest"])).offset(max(0, offset)).limit(min(max(limit, 1), 200))


def page_with_total(df: DataFrame, order: str = "newest", limit: int = 50, offset: int = 0, id_col: str = "job_id") -> DataFrame:
    """page(), with `total`, the number of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page(df, order, limit, offset, id_col).crossJoin(F.broadcast(total))  # one row


def observation() -> Column:
    """How long and how often a record was seen."""
    days = active_days(F.col("first_seen"), F.col("last_seen")).cast("bigint")
    return F.struct("first_seen", "last_seen", "seen_count", days.alias("active_days")).alias("observation")


def job_list(roles: DataFrame, matches: DataFrame, *, order: str = "newest", limit: int = 50, offset: int = 0, id_col: str = "job_id", **filters) -> DataFrame:
    """A page of the rows that meet the filters of filtered(), with total, query_groups (sorted) and observation."""
    top = page_with_total(filtered(roles, matches=matches, id_col=id_col, **filters), order, limit, offset, id_col)
    groups = matches.join(F.broadcast(top.select(id_col)), id_col, "left_semi").groupBy(id_col).agg(F.array_sort(F.collect_set("query_group")).alias("query_groups"))  # 200 ids at most
    orders = sort_orders(id_col)
    out = top.join(groups, id_col, "left").withColumn("query_groups", F.coalesce("query_groups", F.expr("cast(array() AS array<string>)")))
    return out.select("*", observation()).orderBy(*orders.get(order, orders["newest"]))


def job_details(ids: DataFrame, roles: DataFrame, membership: DataFrame, matches: DataFrame, *, id_col: str = "job_id", n: int = 50) -> DataFrame:
    """(id, role columns, observation, provenance) of the roles that ids belong to, by any member: provenance has the newest n searches of all members."""
    root = "canonical_job_id"
    asked = ids.select(id_col).join(membership, id_col).select(F.col(id_col).alias("asked"), root)
    found = matches.join(membership, id_col).drop(id_col).withColumnRenamed(root, id_col)
    top = detail(found, id_col, n).groupBy(F.col(id_col).alias(root)).agg(F.array_sort(F.collect_list(F.struct("nth", "query_group", "query_text", "location", "page_offset", "last_observed", "runs"))).alias("provenance"))
    rest = [c for c in roles.columns if c != root]
    out = asked.join(roles.select(root, *rest), root).join(top, root, "left")
    return out.select(F.col("asked").alias(id_col), root, *(c for c in rest if c != id_col), observation(), "provenance")


def description_details(membership: DataFrame, texts: DataFrame, attempts: DataFrame, snapshots: DataFrame, *, id_col: str = "job_id", n: int = 8) -> DataFrame:
    """(canonical_job_id, text_sha256, saved_at, versions, attempts, reparsable) of each role, over all its members: the newest saved text, how
    many different ones, the newest n attempts, and whether a page is stored to parse again.

    texts: (id, text, saved_at); attempts: (id, attempt_id, status); snapshots: (id).
    """
    root, of = "canonical_job_id", lambda df: df.join(membership, id_col)
    newest = of(texts).groupBy(root).agg(F.max_by(F.sha2("text", 256), F.struct("saved_at", id_col)).alias("text_sha256"), F.max("saved_at").alias("saved_at"), F.count_distinct(F.sha2("text", 256)).alias("versions"))
    nth = F.row_number().over(Window.partitionBy(root).orderBy(F.desc("attempt_id"), id_col))
    tried = of(attempts).withColumn("_n", nth).filter(F.col("_n") <= n).groupBy(root).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "attempt_id", "status"))), lambda x: F.struct(x["attempt_id"].alias("attempt_id"), x["status"].alias("status"))).alias("attempts"))
    stored = of(snapshots).select(root).distinct().withColumn("reparsable", F.lit(True))
    out = membership.select(root).distinct().join(newest, root, "left").join(tried, root, "left").join(stored, root, "left")
    none = F.expr("cast(array() AS array<struct<attempt_id:bigint,status:string>>)")
    return out.select(root, "text_sha256", "saved_at", F.coalesce("versions", F.lit(0)).alias("versions"), F.coalesce("attempts", none).alias("attempts"), F.coalesce("reparsable", F.lit(False)).alias("reparsable"))


def key_sums(df: DataFrame, by: str, json_col: str) -> DataFrame:
    """(by, key, total): sums of JSON objects of numbers, key by key; bad JSON counts for nothing."""
    return df.select(by, F.explode(F.from_json(json_col, "map<string,bigint>")).alias("key", "value")).groupBy(by, "key").agg(F.sum("value").alias("total"))


def coverage_sums(df: DataFrame, by: str, json_col: str, fields: list[str]) -> DataFrame:
    """(by, entries, fields): sums over JSON arrays of objects; no row where an array has no entry."""
    kind = "array<struct<" + ", ".join(f"{f}: bigint" for f in fields) + ">>"
    return df.select(by, F.explode(F.from_json(json_col, kind)).alias("x")).groupBy(by).agg(F.count(F.lit(1)).alias("entries"), *(F.sum(f"x.{f}").alias(f) for f in fields))


def run_list(runs: DataFrame, metrics: DataFrame, reports: DataFrame, n: int = 20, failures: list[str] | None = None, *, queries: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """The newest n runs (run_id, ...) with their metrics as a map, the coverage of their searches, and with queries and matches (see
    comparisons()) how their search scopes compare; null where a run has none.

    metrics: (run_id, key, total); reports: (run_id, pages_attempted, pages_completed, valid_jobs, stop_reason).
    """
    top = runs.orderBy(F.desc("run_id")).limit(n)
    newest = F.broadcast(top.select("run_id"))  # n ids
    m = metrics.join(newest, "run_id", "left_semi").groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "total")))).alias("metrics"))
    sums = [F.sum(c).alias(c) for c in ("pages_attempted", "pages_completed", "valid_jobs")]
    c = reports.join(newest, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("queries"), *sums, F.count_if(F.col("stop_reason").isin(failures or [])).alias("incomplete"))
    c = c.select("run_id", F.struct(*(x for x in c.columns if x != "run_id")).alias("coverage"))
    out = top.join(m, "run_id", "left").join(c, "run_id", "left")
    if queries is not None:
        asked, found = (df.join(newest, "run_id", "left_semi") for df in (queries, matches))
        out = out.join(comparisons(asked, found), "run_id", "left")
    return out.orderBy(F.desc("run_id"))


def options(roles: DataFrame, matches: DataFrame, n: int = 200) -> DataFrame:
    """(kind, value): what a list can be filtered by: the first n companies by name, all families and query groups."""
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), F.col(c).alias("value")).filter("value IS NOT NULL").distinct()
    return kind(roles, "company", "company").orderBy(F.lower("value"), "value").limit(n).unionByName(kind(roles, "family", "role_family")).unionByName(kind(matches, "query_group", "query_group"))


def first_of_groups(df: DataFrame, by: str, item: str, n: int = 10) -> DataFrame:
    """(by, items, total): the first n items of each group in order, and how many rows it has.

    No task holds a group: the number is summed before the shuffle, and all but the first n of each task are dropped there too.  Null items count and are not listed.
    """
    totals = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.col(item).asc_nulls_last()))
    top = df.select(by, item).withColumn("_n", nth).filter(F.col("_n") <= n).groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return totals.join(top, totals[by].eqNullSafe(top[by])).select(totals[by], "items", "total")


def public_report(report: Column, dropped: list[str], listed: str = "conflicts", n: int = 10, total: Column | None = None) -> Column:
    """A report (struct) as JSON without its bulky fields; of the listed field only the first n entries, and their number as <listed>_total: `total`, where the
    field doesn't hold all of them."""
    out = report.dropFields(*dropped) if dropped else report
    return F.to_json(out.withField(f"{listed}_total", F.size(report[listed]) if total is None else total).withField(listed, F.slice(report[listed], 1, n)))


def role_mix(roles: DataFrame, family: str = "role_family") -> DataFrame:
    """(role_family, n, share, recognised): rows of each family, their share in percent of all rows with one, and how many those are."""
    groups = roles.filter(F.col(family).isNotNull()).groupBy(F.col(family).alias("role_family")).agg(F.count(F.lit(1)).alias("n"))
    total = roles.agg(F.count(family).alias("recognised"))
    return groups.crossJoin(F.broadcast(total)).select("role_family", "n", F.bround(100.0 * F.col("n") / F.col("recognised"), 1).alias("share"), "recognised")


def totals_by_state(df: DataFrame, active: Column) -> DataFrame:
    """One row: all rows, active and archived ones; a null condition counts as archived."""
    a = F.coalesce(active, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(a).alias("active"), F.count_if(~a).alias("archived"))


def by_query_group(matches: DataFrame, id_col: str = "job_id") -> DataFrame:
    """(query_group, roles): a record counts once in each group that found it."""
    return matches.select(id_col, "query_group").distinct().groupBy("query_group").agg(F.count(F.lit(1)).alias("roles"))


def new_and_repeated(roles: DataFrame, by: str, since: Column) -> DataFrame:
    """(by, new, repeated): rows first seen since then, and rows seen more than once."""
    return roles.groupBy(by).agg(F.count_if(F.col("first_seen") >= since).alias("new"), F.count_if(F.col("seen_count") > 1).alias("repeated"))


def top_counts(df: DataFrame, name: str, n: int = 8) -> DataFrame:
    """The n largest groups with their share of all rows in percent."""
    groups = df.groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return groups.orderBy(F.desc("count"), F.lower("name"), "name").limit(n).crossJoin(F.broadcast(total)).withColumn("share", F.bround(100.0 * F.col("count") / F.col("total"), 1)).drop("total")


def recurring(df: DataFrame, n: int = 5, id_col: str = "job_id") -> DataFrame:
    """The n records seen most often, more than once."""
    return df.filter("seen_count > 1").orderBy(F.desc("seen_count"), F.desc("last_seen"), id_col).limit(n)


def _age(newest: Column, as_of: Column, stale_after: int = 7) -> tuple[Column, Column]:
    """Age in days, never negative, and what it is called."""
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(newest.cast("timestamp"))) / 86400.0)
    age = F.when(newest.isNotNull(), age)
    return age, F.when(newest.isNull(), "empty").when(age <= min(2, stale_after), "fresh").when(age <= stale_after, "aging").otherwise("stale")


def freshness(seen: DataFrame, as_of: Column, stale_after: int = 7, time_col: str = "observed_at", *, roles: DataFrame | None = None) -> DataFrame:
    """One row: newest sighting, its age in whole days, empty, fresh, aging or stale, and the source of the figure.

    Without any sighting the newest active role counts, by its last_seen, first_seen or created_at (those of them that roles has): source is observation, record, or null where
    nothing tells.
    """
    newest = seen.agg(F.max(time_col).cast("timestamp_ntz").alias("newest"), F.max(F.when(F.col(time_col).isNotNull(), "observation")).alias("source"))
    if roles is not None:
        when = F.coalesce(*(F.col(c).cast("timestamp_ntz") for c in ("last_seen", "first_seen", "created_at") if c in roles.columns))
        other = roles.filter("NOT is_archived").agg(F.max(when).alias("_role"))
        newest = newest.crossJoin(F.broadcast(other)).select(F.coalesce("newest", "_role").alias("newest"), F.coalesce("source", F.when(F.col("_role").isNotNull(), "record")).alias("source"))  # one row each
    age, status = _age(F.col("newest"), as_of, stale_after)
    return newest.select("newest", F.floor(age).alias("age_days"), status.alias("status"), "source")


_SECTIONS = ["source", "company", "location", "role_family"]
_STATE = ["seen_count", "first_seen"]


def _items(as_of: Column) -> list[Column]:
    """(section, name) of all that a role counts for in a summary; null where it doesn't."""
    kinds = [("source", F.col("source")), ("company", F.col("company")), ("place", primary_location(F.col("location"))), ("family", F.coalesce("role_family", F.lit("unclassified")))]
    state = [("total", F.lit(True)), ("repeated", F.col("seen_count") > 1), ("new", F.col("first_seen") >= as_of - F.expr("INTERVAL 7 DAYS"))]
    pair = lambda section, name: F.named_struct(F.lit("section"), F.lit(section), F.lit("name"), name)
    return [pair(k, c) for k, c in kinds] + [F.when(c, pair("totals", F.lit(k))) for k, c in state]


def summary(roles: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """(section, name, count): totals, sources, companies, places and families of the roles seen in the window."""
    r = roles if days is None else roles.filter(F.col("last_seen") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    items = F.filter(F.array(*_items(as_of)), lambda x: x.isNotNull())
    return r.select(F.explode(items).alias("x")).groupBy("x.section", "x.name").agg(F.count(F.lit(1)).alias("count"))


def status_counts(work: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Of each id's latest work: items, tokens and cost by status."""
    latest = work.groupBy(id_col).agg(F.max_by(F.struct("status", "tokens", "cost"), "work_id").alias("w"))
    return latest.groupBy("w.status").agg(F.count(F.lit(1)).alias("n"), F.sum("w.tokens").alias("tokens"), F.sum("w.cost").alias("cost"))


def skill_distribution(claims: DataFrame, membership: DataFrame, id_col: str = "job_id") -> DataFrame:
    """(category, term, roles): each role counts once for a term, whatever its members repeat."""
    return claims.join(membership, id_col).groupBy("category", "term").agg(F.count_distinct("canonical_job_id").alias("roles"))


WINDOWS = {"all": None, "7d": 7, "30d": 30}


def summaries(roles: DataFrame, matches: DataFrame, as_of: Column, windows: dict[str, int | None] | None = None, *, id_col: str = "job_id") -> DataFrame:
    """(window, section, name, count) of each window: what summary() tells, roles by query group, the five seen most often, and review counts
    (active and archived rows, favourites, rows by outcome) of the roles in it; freshness is the age in days of the newest one.

    Roles and matches are read once: each role, with its query groups, is written with the windows that it falls into, and gives
    one row for each of its windows and section names to one aggregate.  A window without active roles has its freshness row alone.
    """
    spans = WINDOWS if windows is None else windows
    within = [F.lit(True) if days is None else F.coalesce(F.col("last_seen") >= as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False)) for days in spans.values()]
    names = F.filter(F.array(*(F.when(w, F.lit(n)) for n, w in zip(spans, within, strict=True))), lambda x: x.isNotNull())
    found = matches.groupBy(id_col).agg(F.collect_set("query_group").alias("_groups"))  # one entry for each query group
    path = scratch(roles.sparkSession, "summaries")
    cut = roles.select(id_col, *_SECTIONS, *_STATE, "last_seen", "is_archived", "is_favorite", "outcome", names.alias("_windows")).filter(F.size("_windows") > 0)
    cut.join(found, id_col, "left").write.parquet(path)
    r = roles.sparkSession.read.parquet(path)
    item = lambda section, name: F.named_struct(F.lit("section"), F.lit(section), F.lit("name"), name.cast("string"))
    review = [item("review", F.when(~F.col("is_archived"), "active").otherwise("archived")), F.when(F.col("is_favorite"), item("review", F.lit("favorite"))), F.when(F.col("outcome").isNotNull(), item("review", F.concat(F.lit("outcome "), "outcome")))]
    none = F.expr("cast(array() AS array<struct<section:string,name:string>>)")
    groups = F.transform(F.coalesce("_groups", F.expr("cast(array() AS array<string>)")), lambda g: item("query_group", g))
    of_active = F.concat(F.array(item("freshness", F.lit(None)), *_items(as_of)), groups)
    items = F.filter(F.concat(F.array(*review), F.when(~F.col("is_archived"), of_active).otherwise(none)), lambda x: x.isNotNull())
    counted = r.select(F.explode("_windows").alias("window"), items.alias("_items"), "last_seen").select("window", F.explode("_items").alias("x"), F.when(F.col("x.section") == "freshness", F.col("last_seen")).alias("at"))
    seed = roles.sparkSession.createDataFrame([(n,) for n in spans], "window string").select("window", F.struct(F.lit("freshness").alias("section"), F.lit(None).cast("string").alias("name")).alias("x"), F.lit(None).cast(r.schema["last_seen"].dataType).alias("at"))
    sums = counted.unionByName(seed).groupBy("window", "x.section", "x.name").agg(F.count(F.lit(1)).alias("count"), F.max("at").alias("at"))
    age, status = _age(F.col("at"), as_of)
    fresh = F.col("section") == "freshness"
    sums = sums.select("window", "section", F.when(fresh, status).otherwise(F.col("name")).alias("name"), F.when(fresh, F.floor(age)).otherwise(F.col("count")).alias("count"))
    again = r.filter("NOT is_archived AND seen_count > 1").select(F.explode("_windows").alias("window"), id_col, "seen_count", "last_seen")
    nth = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("seen_count"), F.desc("last_seen"), id_col))
    top = again.withColumn("_n", nth).filter("_n <= 5").select("window", F.lit("recurring").alias("section"), F.col(id_col).cast("string").alias("name"), F.col("seen_count").alias("count"))
    return sums.unionByName(top)
