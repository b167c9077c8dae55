"""Queries of column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as T
from ..functions import values as V
from .base import moment, query, table

SITE = I.UrlRules("page", "example\\.(com|net|org)", ("^/[a-z]{2}/([0-9]+)(?:[./]|$)",), ("page",))
_SITE_SQL = """u AS (SELECT page_id, url, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
 v AS (SELECT page_id, url, lower(regexp_extract(bare, '^([^/?#]*)', 1)) AS host, regexp_extract(bare, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(bare, '^[^?#]*\\?([^#]*)', 1) AS query FROM u),
 w AS (SELECT *, coalesce(nullif(regexp_extract(path, '^/[a-z]{2}/([0-9]+)(?:[./]|$)', 1), ''), nullif(regexp_extract(query, '(?i)(?:^|&)page=([0-9]+)(?:&|$)', 1), '')) AS id FROM v),
 x AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)example\\.(com|net|org)$') AND id IS NOT NULL THEN 'page:' || id ELSE host || regexp_replace(path, '/+$', '') END AS identity FROM w)"""


@query("fn_clean_value", "SELECT doc_id, md5(coalesce(nullif(trim(text, E' \\t\\r\\n'), ''), 'none')) AS cleaned FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_value(F.concat(F.lit(" \t"), "text", F.lit("\n ")), "none")).alias("cleaned"))


@query("fn_clean_identity", "SELECT event_id, CASE WHEN event_type IN ('nan', 'none', 'null', 'nat', '<na>') OR event_id % 7 = 0 THEN '' ELSE event_type END AS identity FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.clean_identity(F.when(F.col("event_id") % 7 == 0, F.lit(" NaN ")).otherwise(F.concat(F.lit(" "), "event_type"))).alias("identity"))


@query("fn_url_identity", f"WITH {_SITE_SQL} SELECT page_id, identity FROM x")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", I.url_identity(F.col("url"), SITE).alias("identity"))


@query("fn_normalized_key", f"WITH {_SITE_SQL} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'feed|' || lower(split_part(host, '.', 1)) || '|' ELSE identity END AS key FROM x")
def _(spark, d):
    url = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    title = F.split_part(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("."), F.lit(1))
    return table(spark, d, "pages").select("page_id", I.normalized_key(url, F.lit("Feed"), F.upper(title), F.lit(None).cast("string"), SITE).alias("key"))


@query(
    "fn_identity_aliases",
    f"""WITH {_SITE_SQL}, a AS (SELECT page_id, list_distinct(list_filter([identity, 'id' || (page_id % 50)::VARCHAR, identity], lambda y: y <> '')) AS l, identity FROM x)
    SELECT page_id, len(l)::BIGINT AS n, identity AS first FROM a""",
)
def _(spark, d):
    p = table(spark, d, "pages").withColumn("i", I.url_identity(F.col("url"), SITE))
    p = p.withColumn("l", I.aliases(F.col("i"), F.concat(F.lit("id"), (F.col("page_id") % 50).cast("string")), F.col("i"), F.lit(None).cast("string")))
    return p.select("page_id", F.size("l").cast("bigint").alias("n"), F.get("l", F.lit(0)).alias("first"))


@query(
    "fn_canonical_url",
    f"""WITH {_SITE_SQL} SELECT page_id, CASE WHEN identity LIKE 'page:%' THEN 'https://site/view/' || substr(identity, 6) ELSE regexp_replace(url, '[?#].*$', '') END AS canonical FROM x""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", I.canonical_url(F.col("url"), "https://site", SITE).alias("canonical"))


@query(
    "fn_normalize_text",
    r"""SELECT doc_id, md5(trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(text, '\s+', ' ', 'g')), '[^\x00-\x7F]', '', 'g')), ' +', ' ', 'g'))) AS folded FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.folded(F.col("text"))).alias("folded"))


@query("fn_squeeze_ws", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.squeezed(F.col("text"))).alias("squeezed"))


@query("fn_text_key", r"SELECT doc_id, md5(replace(lower(nfc_normalize(trim(regexp_replace(text, '\s+', ' ', 'g')))), 'ß', 'ss')) AS key FROM documents")
def _(spark, d):
    from ..functions.unicode import text_key

    return table(spark, d, "documents").select("doc_id", F.md5(text_key(F.col("text"))).alias("key"))


_TITLES = "CASE p_partkey % 8 WHEN 0 THEN 'Jobs in ' || p_name WHEN 1 THEN 'unknown' WHEN 2 THEN p_name || ' - Archived / placeholder' WHEN 3 THEN '  ' WHEN 4 THEN 'n/a' WHEN 5 THEN 'all jobs NEAR ' || p_name WHEN 6 THEN 'jobs inside ' || p_name ELSE p_name END"


@query("fn_valid_title", f"SELECT p_partkey, trim(t) <> '' AND NOT regexp_matches(t, '(?i)archived[\\s/-]+placeholder|\\bjobs (in|near)\\b') AS valid FROM (SELECT p_partkey, {_TITLES} AS t FROM part)")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_TITLES).alias("t")).select("p_partkey", T.valid_title(F.col("t")).alias("valid"))


@query("fn_primary_location", "SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'Unknown' WHEN n_name = 'NATION_3' THEN 'Zurich' ELSE n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_suppkey") % 9 == 0, F.lit(" , x")).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" , region")))
    return s.select("s_suppkey", T.primary_location(name, {"nation_3": "Zurich"}).alias("place"))


@query("fn_location_alias", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN 'geo-1' WHEN n_nationkey = 5 THEN 'geo-5' END AS parameter FROM nation")
def _(spark, d):
    known = spark.createDataFrame([("nation_1", "geo-1"), ("nation_2", "geo-1"), ("nation_5", "geo-5")], "key string, parameter string")
    n = table(spark, d, "nation").withColumn("key", T.folded(F.col("n_name")))
    return n.join(F.broadcast(known), "key", "left").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "parameter")


@query("fn_scope_of", "SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'cities' WHEN c_nationkey = 7 THEN 'countrywide' END AS scope FROM customer")
def _(spark, d):
    from ..operators.provenance import scope_of

    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return scope_of(c, "n_name", [f"Nation_{i}" for i in range(5)], ["NATION_7"]).select("c_custkey", "scope")


@query(
    "fn_query_spec",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\bbolt\\b') THEN 'fasteners' WHEN regexp_matches(p_name, 'gear|gizmo') THEN 'machines' ELSE 'custom_' || replace(p_name, ' ', '_') END AS key,
    CASE WHEN regexp_matches(p_name, '\\bbolt\\b') THEN 'Fasteners' WHEN regexp_matches(p_name, 'gear|gizmo') THEN 'Machines' ELSE p_name END AS name FROM part""",
)
def _(spark, d):
    spec = T.query_key(F.col("p_name"), [("\\bbolt\\b", "fasteners", "Fasteners"), ("gear|gizmo", "machines", "Machines")])
    return table(spark, d, "part").select("p_partkey", spec.alias("s")).select("p_partkey", "s.key", "s.name")


@query("fn_normalize_list", "SELECT n_nationkey::BIGINT AS n_nationkey, lower(n_name) || '|' || lower(n_name) || ' eo' AS tokens FROM nation")
def _(spark, d):
    c = F.concat("n_name", F.lit(", ,"), "n_name", F.lit("  Éö,"))
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.array_join(T.name_list(c), "|").alias("tokens"))


@query(
    "fn_to_utc",
    """SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN (strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')::TIMESTAMP AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC'
      WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 2 THEN date_trunc('second', ts) END, '%Y-%m-%d %H:%M:%S') AS at FROM events""",
)
def _(spark, d):
    plain = moment(F.col("ts"))
    n = F.col("event_id") % 4
    written = F.when(n == 0, plain).when(n == 1, F.concat(plain, F.lit("+02:00"))).when(n == 2, F.concat(F.replace(plain, F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", moment(V.to_utc(written)).alias("at"))


@query("fn_pick_earliest", "SELECT l_orderkey, l_linenumber::BIGINT AS line, strftime(least(l_shipdate, o_orderdate), '%Y-%m-%d') AS earliest FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), F.date_format(V.earliest(F.col("l_shipdate"), F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz")), "yyyy-MM-dd").alias("earliest"))


@query("fn_pick_latest", "SELECT l_orderkey, l_linenumber::BIGINT AS line, strftime(greatest(l_shipdate, o_orderdate), '%Y-%m-%d') AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), F.date_format(V.latest(F.col("l_shipdate"), F.col("o_orderdate")), "yyyy-MM-dd").alias("latest"))


@query("fn_active_days", "SELECT o_custkey, (greatest(0, date_diff('day', min(o_orderdate), max(o_orderdate))) + 1)::BIGINT AS days FROM orders GROUP BY o_custkey")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return g.select("o_custkey", V.active_days(F.col("a"), F.col("b")).cast("bigint").alias("days"))


@query("fn_digest", """SELECT n_nationkey::BIGINT AS n_nationkey, sha256('{"name":"' || n_name || '","region":' || n_regionkey::VARCHAR || '}') AS digest FROM nation""")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), V.digest(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("digest"))


@query("fn_serialize_list", """SELECT n_nationkey::BIGINT AS n_nationkey, '["' || n_name || '","x"]' AS listed FROM nation""")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), V.text_list(F.array(F.concat(F.lit(" "), "n_name"), F.lit("  "), F.lit("x"))).alias("listed"))


@query("fn_safe_counter", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN greatest(0, event_id - 50) ELSE event_id END AS n FROM events")
def _(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", V.counter(F.when(e % 3 == 0, F.lit("many")).when(e % 3 == 1, (e - 50).cast("string")).otherwise(e.cast("string"))).alias("n"))


@query("fn_request_cost", "SELECT l_orderkey, l_linenumber::BIGINT AS line, ((l_quantity * 1000 - l_quantity) * 0.375 + l_quantity * 0.0375 + l_extendedprice * 2.25) / 1e6 AS usd FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), V.request_cost(q * 1000, q, F.col("l_extendedprice")).alias("usd"))


@query("fn_salary_display", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS shown FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.salary_shown(F.when(F.col("c_custkey") % 3 == 0, F.lit("Not Specified ")).otherwise(F.col("c_mktsegment"))).alias("shown"))


@query(
    "fn_location_display",
    """WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS l FROM orders GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(l[1:2], ', ') || CASE WHEN len(l) > 3 THEN ' +' || (len(l) - 2)::VARCHAR || ' more locations' WHEN len(l) = 3 THEN ' +1 more location' ELSE '' END AS shown FROM g""",
)
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("l"))
    return g.select("o_custkey", T.locations_shown(F.concat("l", "l")).alias("shown"))


@query(
    "fn_experience_text",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'at least ' || p_size::VARCHAR || ' years' WHEN 1 THEN 'up to ' || (p_size + 2)::VARCHAR || ' years'
      WHEN 2 THEN p_size::VARCHAR || ' to ' || (p_size + 2)::VARCHAR || ' years' ELSE p_size::VARCHAR || ' years' END AS words FROM part""",
)
def _(spark, d):
    kind = F.get(F.array(*map(F.lit, ("minimum", "maximum", "range", "exact"))), F.col("p_size") % 4)
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", T.years_shown(kind, size, size + 2).alias("words"))


@query(
    "fn_alternatives_text",
    """WITH g AS (SELECT l_orderkey, l_returnflag, string_agg(l_linenumber::VARCHAR, ' + ' ORDER BY l_linenumber) AS t FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem) GROUP BY 1, 2)
    SELECT l_orderkey, string_agg(t, ' OR ' ORDER BY l_returnflag) AS words FROM g GROUP BY 1""",
)
def _(spark, d):
    from ..operators.extraction import alternatives_text

    return alternatives_text(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")


@query(
    "fn_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid, '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS made FROM events""",
)
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.to_json(F.struct(F.col("event_type").alias("type"), k.alias("k"))).alias("made"))


@query("fn_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second, date_part('epoch', date_trunc('second', ts))::BIGINT AS epoch, date_diff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS days FROM events")
def _(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", moment(V.to_second(F.col("ts"))).alias("second"), F.unix_timestamp(ts).alias("epoch"), F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("bigint").alias("days"))
