"""Queries of sightings, state, decisions and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import sightings as S
from .base import DECISIONS_SQL, POSTINGS_SQL, ROLLUP_SQL, SIGHTINGS_SQL, decisions, moment, postings, query, sightings, table

_T = "'%Y-%m-%d %H:%M:%S'"
_CUT = "TIMESTAMP '1998-01-01'"


def _split(spark, d):
    s = sightings(spark, d).withColumn("company", F.col("status"))
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return s.filter(F.col("observed_at") < cut), s.filter(F.col("observed_at") >= cut)


@query("src_typed_tables", "SELECT p_partkey, p_name, 'unknown' AS location, 0::BIGINT AS seen_count FROM part")
def _(spark, d):
    from ..sources.tables import read_typed

    return read_typed(spark, f"{d}/part.parquet", "p_partkey bigint, p_name string, location string, seen_count bigint", {"location": "unknown", "seen_count": 0}).select("p_partkey", "p_name", "location", "seen_count")


@query("src_records_to_frame", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '' AS query_text, 0::BIGINT AS query_page_offset FROM events")
def _(spark, d):
    from ..sources.tables import records_to_frame

    e = table(spark, d, "events").select(F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))).alias("record"))
    return records_to_frame(e, "record", "event_id bigint, k bigint, query_text string, query_page_offset bigint", {"query_text": "", "query_page_offset": 0})


@query("src_page_snapshots", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, max(page_id) AS page_id, sha256(arg_max(html, page_id)) AS content_sha256 FROM pages GROUP BY 1")
def _(spark, d):
    from ..sources.tables import latest_snapshots

    p = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), "page_id", F.encode("html", "utf-8").alias("body"), F.lit("text/html").alias("content_type"))
    return latest_snapshots(p, "host", "page_id")


@query(
    "src_import_text_column",
    """WITH t AS (SELECT doc_id, sha256(text) AS h, text FROM documents WHERE trim(text) <> '') SELECT min(doc_id) AS doc_id, h AS content_sha256 FROM t WHERE doc_id % 10 <> 0 AND h NOT IN (SELECT h FROM t WHERE doc_id % 10 = 0) GROUP BY h""",
)
def _(spark, d):
    from ..sources.tables import import_text

    docs = table(spark, d, "documents")
    old = docs.filter("doc_id % 10 = 0").select(F.sha2(F.encode("text", "utf-8"), 256).alias("content_sha256"))
    return import_text(docs.filter("doc_id % 10 <> 0"), old, "doc_id", "text")


@query("src_backfill_refresh", "SELECT event_id, (event_type = 'click' AND EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'purchase' AND s.user_id = e.user_id AND s.ts <= e.ts)) AS refresh FROM events e")
def _(spark, d):
    from ..sources.tables import backfill_refresh

    e = table(spark, d, "events")
    attempts = e.select("event_id", F.col("user_id").alias("job_id"), F.col("ts").alias("requested_at"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"))
    texts = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("job_id"), F.col("ts").alias("extracted_at"))
    return backfill_refresh(attempts, texts).select("event_id", "refresh")


@query("src_backfill_sightings", f"WITH {POSTINGS_SQL}, {SIGHTINGS_SQL} SELECT job_id, count(*) AS seen_count, strftime(min(o), '%Y-%m-%d') AS first_seen FROM (SELECT job_id, observed_at AS o FROM sightings UNION ALL SELECT job_id, TIMESTAMP '2000-01-01' FROM postings WHERE job_id NOT IN (SELECT job_id FROM sightings)) GROUP BY job_id")
def _(spark, d):
    p = postings(spark, d).withColumn("scraped_at", F.lit("2000-01-01").cast("timestamp_ntz"))
    r = S.rollup(S.backfilled(p, sightings(spark, d)))
    return r.select("job_id", "seen_count", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query("agg_sighting_rollup", f"WITH {SIGHTINGS_SQL}, {ROLLUP_SQL} SELECT job_id, strftime(first_seen, {_T}) AS first_seen, strftime(last_seen, {_T}) AS last_seen, seen_count FROM rollup_")
def _(spark, d):
    return S.rollup(sightings(spark, d)).select("job_id", moment("first_seen").alias("first_seen"), moment("last_seen").alias("last_seen"), "seen_count")


_UPSERT = f"""WITH {SIGHTINGS_SQL}, old AS (SELECT * FROM sightings WHERE observed_at < {_CUT}), batch AS (SELECT * FROM sightings WHERE observed_at >= {_CUT}),
 old1 AS (SELECT * FROM old), seen AS (SELECT job_id, run_id, observed_at FROM old1),
 state AS (SELECT job_id, arg_max(title, arrival) AS title, arg_max(status, arrival) AS company, min(observed_at) AS first_seen, max(observed_at) AS last_seen, count(*) AS seen_count FROM old1 GROUP BY job_id),
 b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, run_id ORDER BY arrival) AS n FROM batch) WHERE n = 1),
 b2 AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY job_id, observed_at ORDER BY arrival) AS n FROM b1) WHERE n = 1),
 fresh AS (SELECT * FROM b2 WHERE (job_id, run_id) NOT IN (SELECT (job_id, run_id) FROM seen) AND (job_id, observed_at) NOT IN (SELECT (job_id, observed_at) FROM seen)),
 lastb AS (SELECT job_id, arg_max(title, arrival) AS title, arg_max(status, arrival) AS company, min(observed_at) AS low FROM batch GROUP BY job_id),
 delta AS (SELECT job_id, max(observed_at) AS high, count(*) AS n FROM fresh GROUP BY job_id)"""


@query(
    "dml_upsert_sightings",
    f"""{_UPSERT}, pay AS (SELECT job_id, arg_max(CASE WHEN arrival % 3 = 0 THEN 'Not specified' ELSE arrival::VARCHAR END, arrival) AS salary FROM batch GROUP BY job_id), old_pay AS (SELECT job_id, max(arrival)::VARCHAR AS salary FROM old1 GROUP BY job_id)
    SELECT coalesce(s.job_id, l.job_id) AS job_id, coalesce(l.title, s.title) AS title, coalesce(l.company, s.company) AS company, coalesce(nullif(p.salary, 'Not specified'), o.salary, p.salary) AS salary, strftime(least(s.first_seen, l.low), {_T}) AS first_seen,
    strftime(greatest(s.last_seen, d.high), {_T}) AS last_seen, (coalesce(s.seen_count, 0) + coalesce(d.n, 0))::BIGINT AS seen_count
    FROM state s FULL JOIN lastb l ON s.job_id = l.job_id LEFT JOIN delta d ON d.job_id = l.job_id LEFT JOIN pay p ON p.job_id = l.job_id LEFT JOIN old_pay o ON o.job_id = s.job_id""",
)
def _(spark, d):
    old, batch = _split(spark, d)
    batch = batch.withColumn("salary", F.when(F.col("arrival") % 3 == 0, "Not specified").otherwise(F.col("arrival").cast("string")))
    state = old.groupBy("job_id").agg(F.max_by("title", "arrival").alias("title"), F.max_by("company", "arrival").alias("company"), F.max("arrival").cast("string").alias("salary"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count"))
    out, _ = S.upsert(state, old, batch, ["title", "company", "salary"])
    return out.withColumn("first_seen", moment("first_seen")).withColumn("last_seen", moment("last_seen"))


@query("dml_upsert_new_sightings", f"{_UPSERT} SELECT job_id, run_id, job_id NOT IN (SELECT job_id FROM state) AS is_new FROM fresh")
def _(spark, d):
    old, batch = _split(spark, d)
    _, new = S.upsert(old.groupBy("job_id").agg(F.max("title").alias("title"), F.max("company").alias("company"), F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("seen_count")), old, batch, ["title", "company"])
    return new.select("job_id", "run_id", "is_new")


@query("join_identity_resolution", "SELECT o_orderkey AS arrival, o_custkey % 100 AS job_id FROM orders WHERE o_custkey % 100 < 60 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey % 100)")
def _(spark, d):
    batch = table(spark, d, "orders").select(F.col("o_orderkey").alias("arrival"), F.array(F.concat(F.lit("x"), F.col("o_custkey").cast("string")), F.concat(F.lit("key"), (F.col("o_custkey") % 100).cast("string"))).alias("names"))
    stored = table(spark, d, "customer").filter("c_custkey < 60").select(F.col("c_custkey").alias("job_id"), F.array(F.concat(F.lit("key"), F.col("c_custkey").cast("string")), F.concat(F.lit("id"), F.col("c_custkey").cast("string"))).alias("names"))
    return S.resolve(batch, stored)


@query("set_dedupe_keep_first", "SELECT l_partkey, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    li = table(spark, d, "lineitem").withColumn("arrival", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return S.latest_per_key(li, ["l_partkey"], F.col("arrival"), F.col("l_suppkey")).select("l_partkey", "l_orderkey")


@query("set_dedupe_observed", f"WITH {SIGHTINGS_SQL} SELECT run_id, count(DISTINCT job_id) AS found, count(DISTINCT CASE WHEN job_id % 3 = 0 THEN job_id END) AS known FROM sightings GROUP BY run_id")
def _(spark, d):
    s = S.keep_first(sightings(spark, d), ["run_id", "job_id"], "arrival")
    known = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job_id"), F.lit(True).alias("known"))
    return s.join(known, "job_id", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("known").alias("known"))


@query("set_union_all_membership", "SELECT doc_id, CASE WHEN n > 1 THEN root ELSE doc_id END AS root FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS root, count(*) OVER (PARTITION BY text) AS n FROM documents)")
def _(spark, d):
    from ..operators.consolidate import memberships

    docs = table(spark, d, "documents")
    groups = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("canonical_job_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = docs.withColumn("h", F.sha2("text", 256)).join(groups, "h").select(F.col("doc_id").alias("job_id"), "canonical_job_id")
    return memberships(docs.select(F.col("doc_id").alias("job_id")), members).select(F.col("job_id").alias("doc_id"), F.col("canonical_job_id").alias("root"))


@query(
    "set_intersect_except",
    """WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT 'both' AS part, k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'second', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)""",
)
def _(spark, d):
    a, b = (table(spark, d, "lineitem").filter(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    part = lambda df, n: df.select(F.lit(n).alias("part"), "k")
    return part(a.intersect(b), "both").unionByName(part(a.subtract(b), "first")).unionByName(part(b.subtract(a), "second"))


# A batch as it comes in: blank sources, actions, filters and reasons, confidences that are no numbers.
_INCOMING = {
    "decision_source": "CASE WHEN decision_id % 3 = 0 THEN ' ' ELSE decision_source END", "decision_action": "CASE WHEN decision_id % 5 = 0 THEN NULL ELSE decision_action END", "filter_name": "CASE WHEN decision_id % 7 = 0 THEN '  ' ELSE filter_name END",
    "reason": "CASE WHEN decision_id % 11 = 0 THEN NULL ELSE concat(' because of ', filter_name) END", "confidence": "CASE decision_id % 4 WHEN 1 THEN '0.5' WHEN 2 THEN '' ELSE 'high' END",
}
_INCOMING_SQL = "SELECT decision_id, job_id, decided_at, batch_id, " + ", ".join(f"{sql} AS {c}" for c, sql in _INCOMING.items()) + " FROM decisions"
_VALID_SQL = f"""incoming AS ({_INCOMING_SQL}), valid AS (SELECT decision_id, job_id, decided_at, batch_id, coalesce(nullif(trim(decision_source), ''), 'rule') AS decision_source, coalesce(nullif(trim(decision_action), ''), 'archive') AS decision_action, trim(filter_name) AS filter_name, trim(reason) AS reason,
 TRY_CAST(confidence AS DOUBLE) AS confidence FROM incoming WHERE coalesce(trim(filter_name), '') <> '' AND coalesce(trim(reason), '') <> '')"""


def _incoming(spark, d):
    return decisions(spark, d).select("decision_id", "job_id", "decided_at", "batch_id", *(F.expr(sql).alias(c) for c, sql in _INCOMING.items()))


@query(
    "dml_record_decisions",
    f"""WITH {DECISIONS_SQL}, {_VALID_SQL} SELECT decision_id, decision_source, decision_action, filter_name, reason, confidence FROM valid WHERE decision_id % 2 = 1
    AND (job_id, filter_name, decision_action, batch_id) NOT IN (SELECT (job_id, filter_name, decision_action, batch_id) FROM decisions WHERE decision_id % 2 = 0)""",
)
def _(spark, d):
    new = D.recorded(_incoming(spark, d).filter("decision_id % 2 = 1"), decisions(spark, d).filter("decision_id % 2 = 0"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return new.select("decision_id", "decision_source", "decision_action", "filter_name", "reason", "confidence")


_OVERRIDES = f"""{DECISIONS_SQL}, overrides AS (SELECT job_id, arg_max(CASE WHEN decision_action = 'archive' THEN 'archive' ELSE 'keep' END, (decided_at, decision_id)) AS action FROM decisions WHERE decision_source = 'manual' GROUP BY job_id)"""


@query("dml_manual_overrides", f"WITH {_OVERRIDES} SELECT job_id, action FROM overrides")
def _(spark, d):
    return D.manual_overrides(decisions(spark, d))


_CURRENT = f"""{DECISIONS_SQL}, cur AS (SELECT job_id, arg_max(decision_id, (decided_at, decision_id)) AS decision_id FROM decisions WHERE decision_action <> 'shadow' GROUP BY job_id)"""


@query("join_correlated_latest", f"WITH {_CURRENT} SELECT job_id, decision_source, decision_action, filter_name, strftime(decided_at, {_T}) AS decided_at FROM decisions JOIN cur USING (job_id, decision_id)")
def _(spark, d):
    return D.current(decisions(spark, d)).withColumn("decided_at", moment("decided_at"))


def _state(spark, d):
    """Users: every second archived, every fifth by hand."""
    u = table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("last"))
    arch = F.col("job_id") % 2 == 0
    return u.select("job_id", F.when(arch, F.lit("2024-01-15").cast("timestamp_ntz")).alias("archived_at"), F.when(arch, "rule").alias("archived_reason"), F.when(F.col("job_id") % 5 == 0, "manual_archive").otherwise("unmatched").alias("outcome"))


@query("flt_auto_archived", f"WITH {_CURRENT} SELECT job_id FROM decisions JOIN cur USING (job_id, decision_id) WHERE decision_source = 'rule' AND decision_action = 'archive' AND job_id % 2 = 0 AND job_id % 5 <> 0")
def _(spark, d):
    return D.auto_archived(_state(spark, d), decisions(spark, d)).select("job_id")


@query(
    "dml_archive",
    """SELECT DISTINCT user_id AS job_id, CASE WHEN user_id % 2 = 0 THEN 'rule' WHEN user_id % 3 = 0 THEN 'new' END AS archived_reason,
    CASE WHEN user_id % 2 = 1 AND user_id % 3 = 0 AND user_id % 9 = 0 THEN 'manual_archive' WHEN user_id % 5 = 0 THEN 'manual_archive' ELSE 'unmatched' END AS outcome FROM events""",
)
def _(spark, d):
    s = _state(spark, d)
    chosen = s.filter("job_id % 3 = 0").select("job_id", F.lit("new").alias("reason"), F.lit("2024-02-01").cast("timestamp_ntz").alias("at"), (F.col("job_id") % 9 == 0).alias("manual"))
    return D.archived(s, chosen).select("job_id", "archived_reason", "outcome")


_STATE_SQL = "state AS (SELECT DISTINCT user_id AS job_id, user_id % 2 = 0 AS archived, CASE WHEN user_id % 2 = 0 THEN 'rule' END AS archived_reason, CASE WHEN user_id % 5 = 0 THEN 'manual_archive' ELSE 'unmatched' END AS outcome, 'family ' || (user_id % 3)::VARCHAR AS role_family FROM events)"


def _with_family(spark, d):
    return _state(spark, d).withColumn("role_family", F.concat(F.lit("family "), (F.col("job_id") % 3).cast("string")))


def _both(result):
    """State and decisions of a change as one table."""
    state = result["state"].select(F.lit("state").alias("part"), "job_id", F.col("archived_at").isNotNull().cast("string").alias("a"), F.col("archived_reason").alias("b"), F.concat_ws(" ", "outcome", F.coalesce("role_family", F.lit("-"))).alias("c"))
    made = result["decisions"].select(F.lit("decision").alias("part"), "job_id", F.concat_ws(" ", "decision_source", "decision_action").alias("a"), F.col("filter_name").alias("b"), F.col("reason").alias("c"))
    return state.unionByName(made)


@query(
    "dml_archive_with_decisions",
    f"""WITH {DECISIONS_SQL}, {_STATE_SQL}, {_VALID_SQL},
    acts AS (SELECT job_id, arg_min(coalesce(nullif(trim(reason), ''), 'Archived by filter'), decision_id) AS why, bool_or(lower(trim(coalesce(decision_source, ''))) = 'manual' AND lower(coalesce(decision_action, '')) = 'archive') AS hand FROM incoming WHERE lower(coalesce(nullif(trim(decision_action), ''), 'archive')) = 'archive' GROUP BY job_id)
    SELECT 'state' AS part, job_id, (archived OR why IS NOT NULL)::VARCHAR AS a, CASE WHEN archived THEN archived_reason ELSE why END AS b, CASE WHEN hand THEN 'manual_archive -' ELSE outcome || ' ' || role_family END AS c FROM state LEFT JOIN acts USING (job_id)
    UNION ALL SELECT 'decision', job_id, decision_source || ' ' || decision_action, filter_name, reason FROM valid""",
)
def _(spark, d):
    return _both(D.archived_with_decisions(_with_family(spark, d), _incoming(spark, d), F.lit("2024-02-01").cast("timestamp_ntz")))


def _groups(spark, d):
    """Users in groups of four."""
    return _state(spark, d).select("job_id", (F.col("job_id") - F.col("job_id") % 4).alias("canonical_job_id"))


_ASKED_SQL = "asked AS (SELECT DISTINCT job_id - job_id % 4 AS root FROM state WHERE job_id % 8 = 3), members AS (SELECT job_id, job_id - job_id % 4 IN (SELECT root FROM asked) AS hit FROM state)"


@query(
    "dml_restore",
    f"""WITH {_STATE_SQL}, {_ASKED_SQL} SELECT 'state' AS part, job_id, (archived AND NOT hit)::VARCHAR AS a, CASE WHEN NOT hit THEN archived_reason END AS b, CASE WHEN hit THEN 'manual_keep -' ELSE outcome || ' ' || role_family END AS c FROM state JOIN members USING (job_id)
    UNION ALL SELECT 'decision', job_id, 'manual restore', 'manual_restore', 'Restored for reconsideration' FROM members WHERE hit""",
)
def _(spark, d):
    s = _with_family(spark, d)
    return _both(D.restored(s, s.filter("job_id % 8 = 3").select("job_id"), _groups(spark, d), F.lit("2024-02-01").cast("timestamp_ntz")))


@query(
    "dml_manual_archive",
    f"""WITH {_STATE_SQL}, {_ASKED_SQL} SELECT 'state' AS part, job_id, (archived OR hit)::VARCHAR AS a, CASE WHEN NOT archived AND hit THEN 'Archived manually' ELSE archived_reason END AS b, CASE WHEN hit THEN 'manual_archive -' ELSE outcome || ' ' || role_family END AS c FROM state JOIN members USING (job_id)
    UNION ALL SELECT 'decision', job_id, 'manual archive', 'manual_archive', 'Archived manually' FROM members WHERE hit""",
)
def _(spark, d):
    s = _with_family(spark, d)
    return _both(D.manually_archived(s, s.filter("job_id % 8 = 3").select("job_id"), _groups(spark, d), F.lit("2024-02-01").cast("timestamp_ntz")))


@query("dml_flag", "SELECT DISTINCT user_id AS job_id, CASE WHEN user_id - user_id % 4 IN (SELECT user_id - user_id % 4 FROM events WHERE user_id % 8 = 3) THEN 'odd' END AS flag_reason FROM events")
def _(spark, d):
    s = _state(spark, d).withColumn("flagged_at", F.lit(None).cast("timestamp_ntz")).withColumn("flag_reason", F.lit(None).cast("string"))
    ids = s.filter("job_id % 8 = 3").select("job_id", F.lit("odd").alias("reason"))
    return D.flagged(s, ids, _groups(spark, d), F.lit("2024-02-01").cast("timestamp_ntz")).select("job_id", "flag_reason")


@query("dml_favorite", "SELECT DISTINCT user_id AS job_id, user_id - user_id % 4 IN (SELECT user_id - user_id % 4 FROM events WHERE user_id % 16 = 5) AS is_favorite FROM events")
def _(spark, d):
    s = _state(spark, d)
    m = D.members_of(s.filter("job_id % 16 = 5").select("job_id"), _groups(spark, d)).withColumn("f", F.lit(True))
    return s.join(m, "job_id", "left").select("job_id", F.coalesce("f", F.lit(False)).alias("is_favorite"))


@query("dml_save_labels", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels")
def _(spark, d):
    old = table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))
    new = old.filter("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality")).withColumn("quality", F.when(F.col("quality").isin(0, 1), F.col("quality")).otherwise(F.raise_error(F.lit("bad label")).cast("bigint")))
    return D.overlaid(old, new, ["doc_id"], ["quality", "toxic"])


@query("dml_save_evaluations", "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 'target' ELSE c_mktsegment END AS outcome FROM customer")
def _(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").alias("outcome"))
    return D.overlaid(s, s.filter("job_id % 3 = 0").withColumn("outcome", F.lit("target")), ["job_id"], ["outcome"])


@query("dml_finish_run", f"WITH {SIGHTINGS_SQL} SELECT run_id, count(*) AS inserted, CASE WHEN run_id < '1997' THEN NULL ELSE count(DISTINCT job_id) END AS jobs FROM sightings GROUP BY run_id")
def _(spark, d):
    s = sightings(spark, d)
    runs = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("inserted"), F.lit(None).cast("bigint").alias("jobs"))
    return D.overlaid(runs, s.filter("run_id >= '1997'").groupBy("run_id").agg(F.lit(None).cast("bigint").alias("inserted"), F.count_distinct("job_id").alias("jobs")), ["run_id"], ["inserted", "jobs"])


@query("dml_save_snapshot", "SELECT min(page_id) AS page_id, sha256(html) AS content_sha256 FROM pages GROUP BY html")
def _(spark, d):
    from ..sources.tables import import_text

    none = spark.createDataFrame([], "content_sha256 string")
    return import_text(table(spark, d, "pages"), none, "page_id", "html")


@query("dml_save_extraction", "SELECT doc_id, 'v2' AS version FROM documents WHERE doc_id % 4 <> 0")
def _(spark, d):
    from ..sources.tables import save_versions

    docs = table(spark, d, "documents").select("doc_id", F.lit("v2").alias("version"), F.sha2("text", 256).alias("sha256"))
    return save_versions(docs, docs.filter("doc_id % 4 = 0"), ["doc_id", "version"]).select("doc_id", "version")


@query("dq_orphans", "SELECT 'labels' AS child, count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0)")
def _(spark, d):
    a = S.orphans(table(spark, d, "labels"), table(spark, d, "documents").filter("doc_id % 3 <> 0"), "doc_id")
    b = S.orphans(table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, d, "customer").filter("c_custkey % 5 <> 0"), "c_custkey")
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(c).alias("child"), "orphans")
    return n(a, "labels").unionByName(n(b, "orders"))


@query("dq_unique", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return S.not_unique(table(spark, d, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")), ["l_orderkey", "l_linenumber"])


@query("dq_readiness", "SELECT 'orders' AS name, true AS present, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS active FROM orders UNION ALL SELECT 'part', true, count(*), count(*) FROM part UNION ALL SELECT 'attempts', false, NULL, NULL")
def _(spark, d):
    have = {n: table(spark, d, n) for n in ("orders", "part")}
    return S.readiness(have, {"orders": F.col("o_orderstatus") == "O", "part": F.lit(True), "attempts": F.lit(True)})


@query(
    "dq_label_agreement",
    """WITH o AS (SELECT p_partkey AS doc_id, CASE WHEN regexp_matches(p_name, 'anvil') THEN 'unrelated' WHEN regexp_matches(p_name, 'bolt|gear') THEN 'target' ELSE 'unmatched' END AS outcome FROM part)
    SELECT quality::VARCHAR AS label, coalesce(outcome, 'none') AS outcome, count(*) AS n FROM labels LEFT JOIN o USING (doc_id) GROUP BY 1, 2""",
)
def _(spark, d):
    from ..operators.rules import RuleSets, classify

    sets = RuleSets(target=[("t", "t", [r"\bbolt\b", r"\bgear\b"])], unrelated=[("u", "u", [r"\banvil\b"])])
    found = classify(table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"), F.lit("").alias("company")), sets)
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("job_id"), F.col("quality").cast("string").alias("label"))
    return S.label_agreement(lab, found)


@query("agg_totals_by_state", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus = 'F') AS archived FROM orders")
def _(spark, d):
    from ..operators.reports import totals_by_state

    return totals_by_state(table(spark, d, "orders"), F.col("o_orderstatus") != "F")


@query("agg_active_new", f"WITH {SIGHTINGS_SQL}, f AS (SELECT job_id, min(run_id) AS run_id FROM sightings GROUP BY 1) SELECT run_id, count(*) FILTER (job_id % 3 <> 0) AS active_new, count(*) FILTER (job_id % 3 <> 0) >= 5 AS worthwhile FROM f GROUP BY run_id")
def _(spark, d):
    f = sightings(spark, d).groupBy("job_id").agg(F.min("run_id").alias("run_id"))
    return S.active_new(f, table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("job_id")))


@query("win_latest_per_key", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return S.latest_per_key(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("sink_append_log", f"WITH {DECISIONS_SQL} SELECT batch_id, count(*) AS n FROM decisions GROUP BY batch_id")
def _(spark, d):
    from ..sources.tables import append_log, scratch

    path = scratch(spark, "log")
    log = decisions(spark, d)
    append_log(log.filter("decision_id % 2 = 0"), path, "batch_id")
    append_log(log.filter("decision_id % 2 = 1"), path, "batch_id")
    return spark.read.parquet(path).groupBy(F.col("batch_id").cast("string").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"))


@query("sink_state_snapshot", "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer")
def _(spark, d):
    from ..sources.tables import read_snapshot, scratch, write_snapshot

    root = scratch(spark, "state")
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    write_snapshot(c, root)
    write_snapshot(read_snapshot(spark, root).withColumn("c_acctbal", F.col("c_acctbal") + 1), root)
    return read_snapshot(spark, root)


@query(
    "sink_json_report",
    """SELECT c_mktsegment AS segment, json_object('segment', c_mktsegment, 'total', count(*), 'conflicts', list(c_custkey ORDER BY c_custkey)[1:10], 'conflicts_total', count(*))::VARCHAR AS report FROM customer GROUP BY c_mktsegment""",
)
def _(spark, d):
    from ..operators.reports import first_of_groups, public_report

    c = first_of_groups(table(spark, d, "customer"), "c_mktsegment", "c_custkey")
    report = F.struct(F.col("c_mktsegment").alias("segment"), "total", F.col("items").alias("evaluations"), F.col("items").alias("conflicts"))
    return c.select(F.col("c_mktsegment").alias("segment"), public_report(report, ["evaluations"], total=F.col("total")).alias("report"))
