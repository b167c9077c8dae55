"""Queries of rules, provenance, consolidation, lists, reports and worklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import consolidate as C
from ..operators import provenance as P
from ..operators import reports as R
from ..operators import rules as U
from ..operators import worklist as W
from .base import DECISIONS_SQL, MATCHES_SQL, POSTINGS_SQL, ROLLUP_SQL, SIGHTINGS_SQL, decisions, matches, moment, postings, query, sightings, table

_T = "'%Y-%m-%d %H:%M:%S'"

# A rule file over the words of part names.
PART_RULES = U.RuleSets(
    target=[("fasteners", "fasteners", [r"\bbolt\b", r"\brod\b"]), ("machines", "machines", [r"\bgizmo\b", r"\bgear\b"])],
    adjacent=[("plates", "sheet", [r"\bplate\b", r"\bsmall\b"])],
    personal=[("no_heat", "heat", [r"\bhot\b"])],
    scope=[("engineering_role", "engineering", [r"\bnew gear\b", r"\bnew plate\b"]), ("no_ice", "ice", [r"\bcold ring\b"])],
    unrelated=[("anvils", "smithy", [r"\banvil\b"]), ("rings", "jewels", [r"\bring\b"])],
    study=[r"\bold rod\b"],
    keywords=["red widget", "blu"],
    stems=("blu",),
    employers=["brand#7"],
    version="parts-1",
)
_CLASS = r"""cls0 AS (SELECT p_partkey AS job_id, p_name AS title, p_brand AS company,
  CASE WHEN p_brand = 'Brand#7' THEN 'employer' WHEN regexp_matches(p_name, 'red widget|blu') THEN 'keyword' WHEN p_name = 'old rod' THEN 'study' WHEN regexp_matches(p_name, '\bhot\b') THEN 'personal'
    WHEN p_name = 'cold ring' THEN 'scope' WHEN p_name = 'new gear' THEN 'engineering' WHEN regexp_matches(p_name, 'bolt|rod|gizmo|gear') THEN 'target' WHEN regexp_matches(p_name, 'plate|small') THEN 'adjacent'
    WHEN regexp_matches(p_name, 'anvil|ring') THEN 'unrelated' ELSE 'none' END AS step,
  CASE WHEN regexp_matches(p_name, 'bolt') THEN 'bolt' WHEN regexp_matches(p_name, 'rod') THEN 'rod' WHEN regexp_matches(p_name, 'gizmo') THEN 'gizmo' WHEN regexp_matches(p_name, 'gear') THEN 'gear' END AS found FROM part),
 cls AS (SELECT job_id, title, company, CASE WHEN step IN ('employer', 'keyword', 'study', 'personal', 'scope', 'engineering') THEN 'excluded' WHEN step IN ('target', 'unrelated') THEN step ELSE 'unmatched' END AS outcome,
  CASE WHEN step = 'target' THEN CASE WHEN found IN ('bolt', 'rod') THEN 'fasteners' ELSE 'machines' END END AS role_family,
  CASE step WHEN 'employer' THEN company WHEN 'keyword' THEN CASE WHEN title LIKE '%red widget%' THEN 'red widget' ELSE 'blu' END WHEN 'study' THEN '\bold rod\b' WHEN 'personal' THEN 'hot' WHEN 'scope' THEN title WHEN 'engineering' THEN title
    WHEN 'target' THEN found WHEN 'adjacent' THEN CASE WHEN title LIKE '%plate%' THEN 'plate' ELSE 'small' END WHEN 'unrelated' THEN CASE WHEN title LIKE '%anvil%' THEN 'smithy' ELSE 'jewels' END END AS matched_value,
  (step = 'personal' AND found IS NOT NULL) OR (step = 'target' AND regexp_matches(title, 'anvil|ring')) AS conflict FROM cls0)"""
# Of stored rows, those with an even id are archived, every third of them as a duplicate; the archive is reconciled.
_DECIDED = _CLASS + """, dec AS (SELECT *, job_id % 2 = 0 AS archived, CASE WHEN outcome = 'excluded' THEN 'archive' WHEN job_id % 2 = 0 AND job_id % 6 = 0 THEN 'shadow' WHEN job_id % 2 = 0 AND outcome IN ('target', 'unmatched') THEN 'restore'
  WHEN outcome = 'unrelated' THEN 'archive' WHEN outcome = 'target' THEN 'keep' ELSE 'shadow' END AS action,
  CASE WHEN outcome = 'excluded' THEN 'scope_exclusion' WHEN job_id % 2 = 0 AND job_id % 6 = 0 THEN 'system_archive_preserved' WHEN job_id % 2 = 0 AND outcome IN ('target', 'unmatched') THEN 'relevance_reconcile'
  WHEN outcome = 'unrelated' THEN 'unrelated_role' WHEN outcome = 'target' THEN 'target_role' ELSE 'no_target_role' END AS filter_name FROM cls)"""


def titles(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"))


def classified(spark, d):
    return U.classify(titles(spark, d), PART_RULES)


def _stored(spark, d):
    """Classified rows with what is stored of them, and the decisions that a reconciling preview makes."""
    even = F.col("job_id") % 2 == 0
    t = titles(spark, d).withColumn("archived", even).withColumn("archived_reason", F.when(F.col("job_id") % 6 == 0, "Duplicate of 1").when(even, "rule"))
    c = U.classify(t, PART_RULES)
    return c, U.preview_decisions(c, reconcile_archive=True, batch_id="b1")


# Titles made of part names, with what the rule files say of them: outcome, first rule, value.
_TITLED = [
    ("{} data scientist", "target", "data_science", "data scientist"), ("Lead {} Data Scientist", "excluded", "data_science", "lead"), ("{} SAP Analytics", "excluded", "analytics_bi", "sap"), ("Analytics Engineer {}", "target", "analytics_bi", "analytics"),
    ("{} Backend Developer", "excluded", "personal_software", "backend"), ("{} developer", "excluded", "engineering_role", "developer"), ("Business Developer {}", "unmatched", None, None), ("{} Masterclass", "excluded", "training_recruitment", "masterclass"),
    ("Sachbearbeiter:in {}", "unrelated", "clerical_processing", "clerical_processing"), ("LKW-Fahrer {}", "unrelated", "driving_delivery", "driving_delivery"), ("{} Payroll Buyer", "unrelated", "purchasing_procurement", "purchasing_procurement"), ("{} Verk\u00e4ufer", "unrelated", "retail_hospitality", "retail_hospitality"),
    ("Snowflake Consultant {}", "excluded", "consulting_implementation", "snowflake"), ("Strategieberater {}", "unrelated", "general_consulting", "general_consulting"), ("Intern {}", "excluded", "study_role", "\\bintern(?:ship)?\\b"), ("{}", "unmatched", None, None),
]


@query("flt_keyword", "SELECT p_partkey AS job_id, CASE WHEN regexp_matches(p_name, '\\bred widget\\b') THEN 'red widget' WHEN contains(p_name, 'blu') THEN 'blu' WHEN regexp_matches(p_name, '\\bgear\\b') THEN 'gear' END AS keyword FROM part")
def _(spark, d):
    return titles(spark, d).select("job_id", U.keyword_match(F.col("title"), ["", "red widget ", " ", "blu", "gear"], ("blu",)).alias("keyword"))


@query("flt_company", "SELECT p_partkey AS job_id, CASE WHEN contains(p_brand, '#1') THEN 'brand#1' WHEN contains(p_brand, '2') THEN '2' END AS token FROM part")
def _(spark, d):
    return titles(spark, d).select("job_id", U.company_match(F.col("company"), ["", "brand#1", " ", "2"]).alias("token"))


@query(
    "flt_study_title",
    """SELECT p_partkey AS job_id, CASE p_partkey % 6 WHEN 0 THEN '\\bintern(?:ship)?\\b' WHEN 1 THEN '\\bpraktik(?:ant|um)?\\b' WHEN 2 THEN '\\bwerks?student\\w*\\b' WHEN 3 THEN '^bachelor(?![\\s-]*absolvent)\\s*[-:]\\s*' END AS pattern FROM part""",
)
def _(spark, d):
    from ..operators.job_rules import STUDY

    k = F.col("p_partkey") % 6
    title = F.when(k == 0, F.concat("p_name", F.lit(" Internship"))).when(k == 1, F.concat(F.lit("Praktikum – "), "p_name")).when(k == 2, F.lit("Werkstudentin (m/w/d)")).when(k == 3, F.lit("Bachelor - Data")).when(k == 4, F.lit("Bachelor-Absolvent - Data")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), U.first_pattern(U.folded(title), STUDY).alias("pattern"))


@query(
    "flt_academic_title",
    """SELECT p_partkey AS job_id, CASE p_partkey % 6 WHEN 0 THEN '\\bprofessor(?:in)?\\b' WHEN 1 THEN CASE WHEN p_size % 4 <> 3 THEN 'academic_company:research_assistant' END WHEN 2 THEN CASE WHEN p_size % 4 <> 3 THEN 'academic_company:research_assistant' END
    WHEN 3 THEN '\\bpost[\\s-]?doc(?:toral)?\\b' END AS pattern FROM part""",
)
def _(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_size") % 4
    title = F.when(k == 0, F.lit("Professorin für Maß")).when(k == 1, F.lit("Research-Associate (m/w)")).when(k == 2, F.lit("research / assistant")).when(k == 3, F.lit("Post-Doc")).when(k == 4, F.lit("Research Lead")).otherwise(F.col("p_name"))
    company = F.when(n == 0, F.lit("Humboldt-Universität zu X")).when(n == 1, F.lit("Leibniz Institute")).when(n == 2, F.lit("Humboldtuniversität")).otherwise("An Institute of Technology")
    return table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), U.academic_match(title, company, U.ACADEMIC).alias("pattern"))


_TITLED_SQL = ", ".join(f"({i}, '{o}', {'NULL' if r is None else repr(r)}, {'NULL' if v is None else repr(v).replace(chr(92) * 2, chr(92))})" for i, (_, o, r, v) in enumerate(_TITLED))


@query("cls_rule_tables", f"SELECT p_partkey AS job_id, outcome, rule, matched_value FROM part JOIN (VALUES {_TITLED_SQL}) t(i, outcome, rule, matched_value) ON i = p_partkey % {len(_TITLED)}")
def _(spark, d):
    from ..operators.job_rules import AT_EMPLOYERS, CONSULTING, EMPLOYERS, IMPLEMENTATION, rules_table

    sets = U.rule_tables(rules_table(spark))
    sets.employers, sets.at_employers, sets.consulting, sets.implementation = EMPLOYERS, AT_EMPLOYERS, CONSULTING, IMPLEMENTATION
    form = F.get(F.array(*(F.lit(t[0]) for t in _TITLED)), (F.col("job_id") % len(_TITLED)).cast("int"))
    c = U.classify(titles(spark, d).withColumn("title", F.replace(form, F.lit("{}"), F.col("title"))), sets)
    return c.select("job_id", "outcome", F.get("matches", F.lit(0)).alias("rule"), "matched_value")


@query("cls_all_matches", "SELECT p_partkey AS job_id, concat_ws('|', CASE WHEN regexp_matches(p_name, 'bolt') THEN 'fasteners:bolt' WHEN regexp_matches(p_name, 'rod') THEN 'fasteners:rod' END, CASE WHEN regexp_matches(p_name, 'plate') THEN 'sheet:plate' WHEN regexp_matches(p_name, 'small') THEN 'sheet:' || p_name END) AS found FROM part")
def _(spark, d):
    m = U.all_matches(U.folded(F.col("title")), [("fasteners", "f", ["\\bbolt\\b", "\\brod\\b"]), ("sheet", "s", ["\\bplate\\b", "\\bsmall \\w+"])])
    return titles(spark, d).select("job_id", F.array_join(F.transform(m, lambda x: F.concat(x["rule"], F.lit(":"), x["text"])), "|").alias("found"))


@query("cls_classify", f"WITH {_CLASS} SELECT job_id, outcome, role_family, matched_value, conflict FROM cls")
def _(spark, d):
    c = classified(spark, d)
    return c.select("job_id", "outcome", "role_family", "matched_value", ((F.size("positive") > 0) & (F.size("negative") > 0)).alias("conflict"))


@query("cls_decision", f"WITH {_CLASS} SELECT job_id, CASE WHEN outcome IN ('excluded', 'unrelated') THEN 'archive' WHEN outcome = 'target' THEN 'keep' ELSE 'shadow' END AS action, CASE outcome WHEN 'excluded' THEN 'scope_exclusion' WHEN 'target' THEN 'target_role' WHEN 'unrelated' THEN 'unrelated_role' ELSE 'no_target_role' END AS filter_name FROM cls")
def _(spark, d):
    return U.decide(classified(spark, d)).select("job_id", "action", "filter_name")


@query(
    "cls_prefilter_decisions",
    """SELECT p_partkey AS job_id, 'title_keyword' AS filter_name FROM part WHERE p_partkey % 5 <> 0 AND regexp_matches(p_name, 'red widget|blu') UNION ALL SELECT p_partkey, 'company' FROM part WHERE p_partkey % 5 <> 0 AND contains(p_brand, '#2')
    UNION ALL SELECT p_partkey, 'study_title' FROM part WHERE p_partkey % 5 <> 0 AND p_name = 'old rod'""",
)
def _(spark, d):
    t = titles(spark, d)
    return U.prefilter_decisions(t, t.filter("job_id % 5 = 0"), PART_RULES, ["brand#2"]).select("job_id", "filter_name")


@query("cls_archive_ids", "SELECT DISTINCT p_partkey AS job_id FROM part WHERE regexp_matches(p_name, 'red widget|blu') OR contains(p_brand, '#2') OR p_name = 'old rod'")
def _(spark, d):
    t = titles(spark, d)
    return U.prefilter_decisions(t, t.limit(0), PART_RULES, ["brand#2"]).filter("action = 'archive'").select("job_id").distinct()


@query("flt_not_archived_batch", "SELECT p_partkey AS job_id FROM part WHERE NOT (regexp_matches(p_name, 'red widget|blu') OR contains(p_brand, '#2') OR p_name = 'old rod')")
def _(spark, d):
    t = titles(spark, d)
    return t.join(U.prefilter_decisions(t, t.limit(0), PART_RULES, ["brand#2"]).select("job_id").distinct().hint("shuffle_hash"), "job_id", "left_anti").select("job_id")


@query(
    "cls_collection_decisions",
    f"""WITH {_CLASS}, {MATCHES_SQL}, o AS (SELECT job_id, job_id % 10 = 0 AS kept, job_id % 10 = 5 AS archived FROM cls), pre AS (SELECT job_id, f.filter_name FROM cls JOIN o USING (job_id),
      (VALUES ('title_keyword'), ('company'), ('study_title')) f(filter_name) WHERE NOT kept AND NOT archived AND CASE f.filter_name WHEN 'title_keyword' THEN regexp_matches(title, 'red widget|blu') WHEN 'company' THEN contains(company, '#2') ELSE title = 'old rod' END),
    d AS (SELECT job_id, filter_name, 'archive' AS action FROM pre UNION ALL SELECT job_id, 'manual_archive_enforced', 'archive' FROM o WHERE archived
      UNION ALL SELECT job_id, CASE outcome WHEN 'excluded' THEN 'scope_exclusion' WHEN 'target' THEN 'target_role' WHEN 'unrelated' THEN 'unrelated_role' ELSE 'no_target_role' END,
        CASE WHEN outcome IN ('excluded', 'unrelated') THEN 'archive' WHEN outcome = 'target' THEN 'keep' ELSE 'shadow' END FROM cls JOIN o USING (job_id) WHERE NOT kept AND NOT archived AND job_id NOT IN (SELECT job_id FROM pre))
    SELECT d.*, m.run_id, searches FROM d JOIN (SELECT job_id, max(run_id) AS run_id, count(DISTINCT query_id) AS searches FROM matches GROUP BY job_id) m USING (job_id)""",
)
def _(spark, d):
    m = matches(spark, d).groupBy("job_id").agg(F.max("run_id").alias("run_id"))
    t = titles(spark, d)
    hand = t.filter("job_id % 5 = 0").select("job_id", F.when(F.col("job_id") % 10 == 0, "keep").otherwise("archive").alias("action"))
    found = U.collection_decisions(t, hand, PART_RULES, ["brand#2"], F.lit(None).cast("string")).drop("run_id")
    prov = P.collected(matches(spark, d)).select("job_id", F.size("provenance").cast("bigint").alias("searches"))
    return found.hint("shuffle_hash").join(m, "job_id").join(prov, "job_id").select("job_id", "filter_name", "action", "run_id", "searches")


@query(
    "cls_run_metrics",
    f"""WITH {_CLASS} SELECT count(*) AS total, count(*) FILTER (outcome = 'target') AS target, count(*) FILTER (outcome = 'excluded') AS excluded, count(*) FILTER (outcome = 'unrelated') AS unrelated, count(*) FILTER (outcome = 'unmatched') AS unmatched,
    count(*) FILTER (conflict) AS conflicts, round_even(100.0 * count(*) FILTER (outcome = 'target') / count(*), 1)::DOUBLE AS target_yield, round_even(100.0 * count(*) FILTER (outcome IN ('excluded', 'unrelated')) / count(*), 1)::DOUBLE AS contamination FROM cls""",
)
def _(spark, d):
    return U.run_metrics(classified(spark, d))


@query("cls_archives_by_filter", f"WITH {_CLASS} SELECT CASE outcome WHEN 'excluded' THEN 'scope_exclusion' ELSE 'unrelated_role' END AS filter_name, count(*) AS archives FROM cls WHERE outcome IN ('excluded', 'unrelated') GROUP BY 1")
def _(spark, d):
    return U.archives_by_filter(U.decide(classified(spark, d)))


@query(
    "cls_preview",
    f"""WITH {_DECIDED}, t AS (SELECT count(*) AS total, count(*) FILTER (NOT archived) AS active, count(*) FILTER (archived) AS archived, count(*) FILTER (NOT archived AND action = 'archive') AS a, count(*) FILTER (archived AND action = 'restore') AS r FROM dec)
    SELECT 'outcome' AS section, outcome AS name, count(*) AS n FROM dec GROUP BY 2 UNION ALL SELECT 'family', role_family, count(*) FROM dec WHERE role_family IS NOT NULL GROUP BY 2 UNION ALL SELECT 'unrelated', matched_value, count(*) FROM dec WHERE outcome = 'unrelated' GROUP BY 2
    UNION ALL SELECT 'totals', x.name, x.n FROM t, unnest([{{name: 'total', n: total}}, {{name: 'active', n: active}}, {{name: 'archived', n: archived}}, {{name: 'would_archive', n: a}}, {{name: 'would_restore', n: r}}, {{name: 'final_active', n: active - a + r}}, {{name: 'final_archived', n: archived + a - r}}]) u(x)""",
)
def _(spark, d):
    p = U.preview(*_stored(spark, d), F.col("job_id"))
    names = ["total", "active", "archived", "would_archive", "would_restore", "final_active", "final_archived"]
    totals = p["totals"].select(F.explode(F.array(*(F.struct(F.lit("totals").alias("section"), F.lit(n).alias("name"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")
    return p["counts"].unionByName(totals)


@query("cls_preview_conflicts", f"WITH {_DECIDED} SELECT job_id, title, outcome AS resolved_as FROM dec WHERE conflict")
def _(spark, d):
    return U.preview(*_stored(spark, d), F.col("job_id"))["conflicts"].select("job_id", "title", "resolved_as")


@query("cls_preview_examples", f"WITH {_DECIDED} SELECT outcome, nth, title, company FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY job_id DESC) AS nth FROM dec) WHERE nth <= 8")
def _(spark, d):
    e = U.preview(*_stored(spark, d), F.desc("job_id"))["examples"]
    return e.withColumn("nth", F.col("nth").cast("bigint"))


@query("win_examples_per_group", f"WITH {_CLASS} SELECT job_id, outcome, nth FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY title, job_id) AS nth FROM cls) WHERE nth <= 8")
def _(spark, d):
    return U.examples(classified(spark, d), "outcome", 8, F.col("title"), F.col("job_id")).select("job_id", "outcome", F.col("nth").cast("bigint").alias("nth"))


@query("cls_reconcile", f"WITH {_DECIDED} SELECT job_id, action, filter_name FROM dec")
def _(spark, d):
    return _stored(spark, d)[1].select("job_id", F.col("decision_action").alias("action"), "filter_name")


def _applied(spark, d):
    c, decisions = _stored(spark, d)
    none = F.lit(None).cast("string")
    state = c.select("job_id", F.when(F.col("archived"), F.lit("2020-01-01").cast("timestamp_ntz")).alias("archived_at"), "archived_reason", none.alias("outcome"), none.alias("role_family"))
    return U.apply(state, decisions.filter("job_id % 4 = 0"), c, decisions, F.lit("2024-01-01").cast("timestamp_ntz"))


@query("cls_apply", f"WITH {_DECIDED} SELECT job_id, outcome, role_family, CASE WHEN NOT archived AND action = 'archive' THEN '2024-01-01 00:00:00' WHEN archived AND action <> 'restore' THEN '2020-01-01 00:00:00' END AS archived_at FROM dec")
def _(spark, d):
    return _applied(spark, d)["state"].select("job_id", "outcome", "role_family", moment("archived_at").alias("archived_at"))


@query("cls_apply_counts", f"WITH {_DECIDED} SELECT count(*) AS evaluated, count(*) FILTER (NOT archived AND action = 'archive') AS archived, count(*) FILTER (archived AND action = 'restore') AS restored, count(*) FILTER (job_id % 4 <> 0) AS recorded FROM dec")
def _(spark, d):
    return _applied(spark, d)["counts"]


# --- provenance


@query("join_inner_equi", "SELECT r_name, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(spark, d):
    q = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "lineitem").join(q, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("join_left_outer", "SELECT c_custkey, coalesce(max(o_orderstatus), 'none') AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 300000").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("s"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("s", F.lit("none")).alias("status"))


@query("join_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def _(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("join_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("join_membership_expand", "WITH c AS (SELECT c_custkey AS job_id, c_custkey - c_custkey % 3 AS root FROM customer) SELECT a.job_id, b.job_id AS member, (SELECT count(*) FROM c x WHERE x.root = a.root) AS members FROM c a JOIN c b ON a.root = b.root")
def _(spark, d):
    # groups of three at most: groups without a bound are given as membership (set_union_all_membership)
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("canonical_job_id"))
    size = m.groupBy("canonical_job_id").agg(F.count(F.lit(1)).alias("members"))
    return m.join(m.select(F.col("job_id").alias("member"), "canonical_job_id"), "canonical_job_id").join(size, "canonical_job_id").select("job_id", "member", "members")


@query("join_theta_semi_anti", "SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events n WHERE n.user_id = e.user_id AND n.event_id > e.event_id)")
def _(spark, d):
    from ..operators.sightings import latest_per_key

    return latest_per_key(table(spark, d, "events"), ["user_id"], F.desc("event_id")).select("event_id")


@query("join_provenance_collect", f"WITH {MATCHES_SQL} SELECT job_id, count(DISTINCT query_text) AS n, min(query_group || '/' || query_text || '/' || location) AS first FROM matches GROUP BY job_id")
def _(spark, d):
    p = P.collected(matches(spark, d))
    f = F.get("provenance", F.lit(0))
    return p.select("job_id", F.size("provenance").cast("bigint").alias("n"), F.concat_ws("/", f["query_group"], f["query_text"], f["location"]).alias("first"))


@query("agg_provenance_detail", f"WITH {MATCHES_SQL}, g AS (SELECT job_id, query_text, location, query_group, min(page_offset)::BIGINT AS page_offset, max(observed_at) AS last, count(DISTINCT run_id) AS runs FROM matches GROUP BY ALL) SELECT job_id, query_text, page_offset, strftime(last, '%Y-%m-%d') AS last_observed, runs, nth FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY last DESC, query_text, location, query_group) AS nth FROM g) WHERE nth <= 50")
def _(spark, d):
    return P.detail(matches(spark, d), n=50).select("job_id", "query_text", F.col("page_offset").cast("bigint").alias("page_offset"), F.date_format("last_observed", "yyyy-MM-dd").alias("last_observed"), "runs", "nth")


def _reports(spark, d):
    """Orders as query reports: lines as pages."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pages_attempted"), F.count_if(F.col("l_linestatus") == "F").alias("pages_completed"), F.sum("l_quantity").cast("bigint").alias("raw_cards"), F.count_if(F.col("l_discount") > 0.05).alias("duplicate_cards"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    stop = F.when(F.col("o_orderstatus") == "F", "page_limit").when(F.col("o_orderstatus") == "O", "blocked").otherwise("short_page")
    return o.select("o_orderkey", "pages_attempted", "pages_completed", "raw_cards", (F.col("raw_cards") - F.col("duplicate_cards")).alias("valid_jobs"), "duplicate_cards", (F.col("pages_attempted") + 1).alias("request_attempts"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("failures"), (F.col("o_orderkey") % 11 == 0).cast("int").alias("request_failures"), (F.col("o_orderkey") % 33 == 0).cast("int").alias("rate_limit_responses"), stop.alias("stop_reason"))


_REPORTS = """reports AS (SELECT o_orderkey, count(*) AS pages_attempted, count(*) FILTER (l_linestatus = 'F') AS pages_completed, sum(l_quantity)::BIGINT AS raw_cards, count(*) FILTER (l_discount > 0.05) AS duplicate_cards,
  any_value(o_orderstatus) AS st FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


@query("agg_run_coverage", f"WITH {_REPORTS} SELECT count(*) AS queries, sum(pages_attempted)::BIGINT AS pages_attempted, sum(pages_completed)::BIGINT AS pages_completed, sum(raw_cards)::BIGINT AS raw_cards, sum(raw_cards - duplicate_cards)::BIGINT AS valid_jobs, sum(duplicate_cards)::BIGINT AS duplicate_cards, sum(pages_attempted + 1)::BIGINT AS request_attempts, count(*) FILTER (o_orderkey % 11 = 0) AS request_failures, count(*) FILTER (o_orderkey % 33 = 0) AS rate_limit_responses, count(*) FILTER (st = 'O') AS incomplete FROM reports")
def _(spark, d):
    return P.coverage(_reports(spark, d), ["blocked", "error"])


@query("flt_query_concerns", f"WITH {_REPORTS} SELECT o_orderkey FROM reports WHERE o_orderkey % 11 = 0 OR raw_cards = duplicate_cards OR pages_completed < pages_attempted OR st = 'O'")
def _(spark, d):
    return P.concerns(_reports(spark, d)).filter("concern").select("o_orderkey")


@query("agg_run_metrics", "SELECT user_id AS run_id, key, sum(json_extract_string(props, '$.' || key)::BIGINT)::BIGINT AS total FROM events, (SELECT unnest(['k']) AS key) WHERE json_valid(props) GROUP BY 1, 2")
def _(spark, d):
    return R.key_sums(table(spark, d, "events").withColumnRenamed("user_id", "run_id"), "run_id", "props")


@query("agg_run_coverage_sums", "SELECT o_custkey AS run_id, count(*) AS entries, sum(l_linenumber)::BIGINT AS pages, sum(l_quantity)::BIGINT AS cards FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    entry = F.struct(F.col("l_linenumber").cast("bigint").alias("pages"), F.col("l_quantity").cast("bigint").alias("cards"), F.lit("x").alias("stop"))
    saved = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(entry)).alias("coverage"))
    runs = table(spark, d, "orders").join(saved, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("run_id"), "coverage")
    return R.coverage_sums(runs, "run_id", "coverage", ["pages", "cards"])


@query("agg_query_coverage", f"WITH {_REPORTS} SELECT o_orderkey, pages_attempted, pages_completed, raw_cards, CASE st WHEN 'F' THEN 'page_limit' WHEN 'O' THEN 'blocked' ELSE 'unknown' END AS stop_reason, (SELECT string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS offsets FROM reports")
def _(spark, d):
    saved = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.collect_list(F.col("l_linenumber"))).alias("page_offsets"))
    r = _reports(spark, d).withColumn("stop_reason", F.when(F.col("stop_reason") == "short_page", " ").otherwise(F.col("stop_reason"))).join(saved, "o_orderkey")
    return P.query_coverage(r, "o_orderkey").select("o_orderkey", "pages_attempted", "pages_completed", "raw_cards", "stop_reason", F.array_join("page_offsets", ",").alias("offsets"))


@query("agg_string_list", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


def _scoped(df, group):
    return df.withColumn("scope", F.when(F.col(group) == "ASIA", "countrywide").when(F.col(group).isin("EUROPE", "AFRICA"), "cities"))


@query(
    "agg_scope_overlap",
    f"""WITH {MATCHES_SQL}, m AS (SELECT *, CASE WHEN query_group = 'ASIA' THEN 'countrywide' WHEN query_group IN ('EUROPE', 'AFRICA') THEN 'cities' END AS scope FROM matches),
    q AS (SELECT CASE WHEN r_name = 'ASIA' THEN 'countrywide' ELSE 'cities' END AS scope, count(*) AS n, sum(s_suppkey % 5 + 1) AS pages, sum(s_suppkey % 5 + 1 - CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END) AS done, count(*) FILTER (s_suppkey % 7 = 0) AS failed
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY 1),
    f AS (SELECT job_id, bool_or(coalesce(scope = 'countrywide', false)) AS a, bool_or(coalesce(scope = 'cities', false)) AS b FROM m GROUP BY job_id),
    o AS (SELECT count(*) FILTER (a) AS fi, count(*) FILTER (b) AS si, count(*) FILTER (a AND b) AS sh, count(*) FILTER (a AND NOT b) AS fo, count(*) FILTER (b AND NOT a) AS so FROM f),
    c AS (SELECT location, count(DISTINCT job_id) AS n, count(DISTINCT CASE WHEN a THEN job_id END) AS sh FROM m JOIN f USING (job_id) WHERE scope = 'cities' GROUP BY location)
    SELECT scope AS section, x.name, x.v::DOUBLE AS value FROM q, unnest([{{name: 'queries', v: n::DOUBLE}}, {{name: 'pages', v: pages}}, {{name: 'completed', v: done}}, {{name: 'failures', v: failed}}, {{name: 'completion', v: round_even(100.0 * done / pages, 1)}}]) u(x)
    UNION ALL SELECT x.s, x.name, x.v::DOUBLE FROM o, unnest([{{s: 'countrywide', name: 'ids', v: fi::DOUBLE}}, {{s: 'cities', name: 'ids', v: si}}, {{s: 'overlap', name: 'shared', v: sh}}, {{s: 'overlap', name: 'first_only', v: fo}}, {{s: 'overlap', name: 'second_only', v: so}}, {{s: 'overlap', name: 'second_covered', v: round_even(100.0 * sh / si, 1)}}]) u(x) WHERE fi > 0 AND si > 0
    UNION ALL SELECT 'city ' || location, x.name, x.v::DOUBLE FROM c, unnest([{{name: 'ids', v: n::DOUBLE}}, {{name: 'shared', v: sh}}, {{name: 'only', v: n - sh}}]) u(x)""",
)
def _(spark, d):
    q = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    q = _scoped(q, "r_name").select("scope", (k % 5 + 1).alias("pages_attempted"), (k % 5 + 1 - (k % 7 == 0).cast("int")).alias("pages_completed"), (k % 7 == 0).cast("int").alias("failures"))
    return P.comparison(q, _scoped(matches(spark, d), "query_group"))


@query("top_cap_per_query", "WITH a AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem) SELECT l_suppkey, l_orderkey FROM (SELECT * FROM a WHERE n <= 5 ORDER BY l_suppkey, l_orderkey * 10 + l_linenumber LIMIT 100)")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_suppkey").alias("query_pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return P.capped(rows, 5, 100).select("l_suppkey", "l_orderkey")


@query(
    "dml_record_queries",
    f"""WITH {MATCHES_SQL}, old AS (SELECT run_id, query_text, location, min(query_id) AS query_id, 0::BIGINT AS cards FROM matches WHERE query_id % 2 = 0 GROUP BY ALL),
    new AS (SELECT run_id, query_text, location, arg_max(page_offset, job_id * 10 + page_offset)::BIGINT AS cards FROM matches WHERE query_id % 3 <> 0 GROUP BY ALL)
    SELECT run_id, query_text, location, coalesce(new.cards, old.cards) AS cards, old.query_id FROM old FULL JOIN new USING (run_id, query_text, location)""",
)
def _(spark, d):
    m = matches(spark, d)
    keys = ["run_id", "query_text", "location"]
    known = m.filter("query_id % 2 = 0").groupBy(*keys).agg(F.min("query_id").alias("query_id"), F.lit(0).cast("bigint").alias("cards"))
    text = F.when(F.col("query_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "query_text"))
    reports = m.select("run_id", text.alias("query_text"), "location", F.col("page_offset").cast("bigint").alias("cards"), (F.col("job_id") * 10 + F.col("page_offset")).alias("seq"))
    out = P.record_queries(known, reports, ["cards"], "seq")
    return out.select(*keys, "cards", F.when(F.col("query_id") != F.xxhash64(*keys), F.col("query_id")).alias("query_id"))


@query("dml_record_matches", f"WITH {MATCHES_SQL} SELECT DISTINCT job_id, query_id FROM matches WHERE page_offset > 3 AND job_id % 5 <> 0 AND query_id % 4 <> 0 AND (job_id, query_id) NOT IN (SELECT (job_id, query_id) FROM matches WHERE page_offset <= 3)")
def _(spark, d):
    m = matches(spark, d).withColumn("name", F.concat(F.lit("key"), "job_id"))
    queries = m.filter("query_id % 4 <> 0").select("run_id", "query_text", "location", "query_id").distinct()
    resolved = m.filter("job_id % 5 <> 0").select("name", "job_id").distinct()
    return P.record_matches(m.filter("page_offset <= 3"), m.filter("page_offset > 3").drop("job_id", "query_id"), resolved, queries)


# --- consolidation: documents as postings


# Companies are named in several ways or not at all, titles differ in case and blanks or are placeholders, texts differ in blanks or are short.
_DOC_COMPANY = "CASE doc_id % 9 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'N/A' WHEN 2 THEN 'Not  specified' WHEN 3 THEN ' Stra\u00dfe  AG' WHEN 4 THEN 'STRASSE AG' ELSE concat('Company ', lang) END"
_DOC_TITLE = "CASE WHEN doc_id % 11 = 5 THEN 'Archived-placeholder' WHEN doc_id % 11 = 7 THEN concat('Jobs in ', lang) WHEN doc_id % 2 = 1 THEN concat('TITLE   ', lang) ELSE concat('Title ', lang) END"
_DOC_TEXT = "CASE WHEN doc_id % 13 = 6 THEN concat('a', repeat(' ', 300)) WHEN doc_id % 4 = 1 THEN concat('  ', replace(text, ' ', '  ')) ELSE text END"


def doc_postings(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("job_id"),
        F.concat(F.lit("id:"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("identity"),
        "source",
        F.expr(_DOC_TITLE).alias("title"),
        F.expr(_DOC_COMPANY).alias("company"),
        F.expr(_DOC_TEXT).alias("text"),
        F.col("doc_id").alias("last_seen"),
        F.col("doc_id").alias("first_seen"),
        (F.col("doc_id") % 3 == 0).alias("is_modern"),
    )


_SQUEEZED = "nfc_normalize(trim(regexp_replace({}, '\\s+', ' ', 'g')))".format
_FOLDED = lambda c: f"replace(lower({_SQUEEZED(c)}), '\u00df', 'ss')"
# Of each identity the latest record with a valid title, else the latest; what it says is a role's key if title, company and text are good enough.
_ROLE = f"""p AS (SELECT doc_id, doc_id - doc_id % 2 AS ident, source, {_DOC_TITLE} AS title, {_DOC_COMPANY} AS company, {_DOC_TEXT} AS text FROM documents),
 v AS (SELECT *, title NOT LIKE 'Archived-placeholder' AND title NOT LIKE 'Jobs in %' AS valid FROM p),
 newest AS (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY valid DESC, doc_id DESC) AS nth FROM v),
 said AS (SELECT ident, valid, {_FOLDED("source")} AS source, {_FOLDED("company")} AS company, {_FOLDED("title")} AS title, {_SQUEEZED("text")} AS text FROM newest WHERE nth = 1),
 keyed AS (SELECT doc_id, v.ident, v.valid, CASE WHEN said.valid AND length(said.text) >= 200 AND said.company NOT IN ('', 'unknown', 'not specified', 'n/a') THEN concat_ws('/', said.source, said.company, said.title, said.text) ELSE 'id:' || v.ident::VARCHAR END AS role FROM v JOIN said ON v.ident = said.ident),
 root AS (SELECT role, arg_min(doc_id, (NOT valid, doc_id % 3 <> 0, doc_id)) AS root, count(*) AS n FROM keyed GROUP BY role),
 members AS (SELECT doc_id, root, ident FROM keyed JOIN root USING (role) WHERE n > 1)"""


def _members(spark, d):
    return C.canonical(C.role_keys(doc_postings(spark, d)), spark.createDataFrame([], "canonical_job_id bigint"))


@query("con_identity_groups", "SELECT doc_id - doc_id % 2 AS identity, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return C.identity_groups(doc_postings(spark, d)).select(F.substring("identity", 4, 20).cast("bigint").alias("identity"), "n")


@query("con_description_pick", "SELECT doc_id // 4 AS job_id, sha256(arg_max(text, (doc_id % 2 = 0, n_chars, doc_id))) AS sha256 FROM documents GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("job_id"), "text", (F.col("doc_id") % 2 == 0).alias("is_modern"), F.col("n_chars").alias("fetched_at"), F.col("doc_id").alias("source_id"), F.lit(0).alias("extraction_id"))
    return C.picked_text(t).select("job_id", F.sha2("text", 256).alias("sha256"))


@query("con_role_key", f"WITH {_ROLE} SELECT doc_id, count(*) OVER (PARTITION BY role) AS size FROM keyed")
def _(spark, d):
    k = C.role_keys(doc_postings(spark, d))
    n = k.groupBy("role_key").agg(F.count(F.lit(1)).alias("size"))
    return k.join(n, "role_key").select(F.col("job_id").alias("doc_id"), "size")


@query("con_canonical", f"WITH {_ROLE} SELECT doc_id, root, CASE WHEN ident = root - root % 2 THEN 'posting_id' ELSE 'description' END AS reason FROM members")
def _(spark, d):
    return _members(spark, d).select(F.col("job_id").alias("doc_id"), F.col("canonical_job_id").alias("root"), "reason")


@query("con_changed_groups", f"WITH {_ROLE} SELECT root FROM members GROUP BY root HAVING bool_or(root <> CASE WHEN doc_id % 10 < 5 THEN root ELSE doc_id END)")
def _(spark, d):
    new = _members(spark, d)
    return C.changed_groups(new, new.filter("job_id % 10 < 5")).select(F.col("canonical_job_id").alias("root"))


@query("con_inherit_manual", f"WITH {_ROLE}, l AS (SELECT root, arg_max(l.quality, (m.doc_id)) AS q, max(m.doc_id) AS from_id FROM members m JOIN labels l USING (doc_id) GROUP BY root) SELECT m.doc_id, CASE WHEN q = 1 THEN 'keep' ELSE 'archive' END AS action FROM members m JOIN l USING (root) LEFT JOIN labels o ON o.doc_id = m.doc_id WHERE o.doc_id IS NULL OR o.quality <> q")
def _(spark, d):
    m = _members(spark, d)
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("job_id"), F.when(F.col("quality") == 1, "keep").otherwise("archive").alias("decision_action"), F.lit("manual").alias("decision_source"), F.col("doc_id").alias("decided_at"), F.col("doc_id").alias("decision_id"))
    own = lab.select("job_id", F.col("decision_action").alias("action"))
    return C.inherited(m.select("canonical_job_id").distinct(), m, own, lab).select(F.col("job_id").alias("doc_id"), F.col("decision_action").alias("action"))


# --- review, lists and reports: customers as postings, orders as sightings


def records(spark, d):
    from ..operators.sightings import rollup

    p = postings(spark, d).join(rollup(sightings(spark, d)), "job_id", "left")
    return p.withColumn("archived_at", F.when(F.col("job_id") % 11 == 0, F.lit("2020-01-01").cast("timestamp_ntz"))).withColumn("role_family", F.when(F.col("job_id") % 3 != 0, F.lower("title")))


_RECORDS = f"""{POSTINGS_SQL}, {SIGHTINGS_SQL}, {ROLLUP_SQL}, records AS (SELECT postings.*, first_seen, last_seen, coalesce(seen_count, 0) AS seen_count, postings.job_id % 11 = 0 AS is_archived, CASE WHEN postings.job_id % 3 <> 0 THEN lower(title) END AS role_family FROM postings LEFT JOIN rollup_ USING (job_id))"""


def roles(spark, d):
    return records(spark, d).withColumn("is_archived", F.col("archived_at").isNotNull()).withColumn("seen_count", F.coalesce("seen_count", F.lit(0)))


_PAIRS = "SELECT *, job_id - job_id % 2 AS root FROM records"


@query("con_review_view", f"WITH {_RECORDS}, m AS ({_PAIRS}) SELECT root, count(*) AS members, count(*) FILTER (NOT is_archived) AS active_members, strftime(max(last_seen), {_T}) AS last_seen, (SELECT count(DISTINCT run_id) FROM sightings s WHERE s.job_id - s.job_id % 2 = root) AS seen_count, arg_max(job_id, (NOT is_archived, coalesce(last_seen, TIMESTAMP '1900-01-01'), job_id)) AS shown_id FROM m GROUP BY root")
def _(spark, d):
    r = records(spark, d)
    member = r.select("job_id", (F.col("job_id") - F.col("job_id") % 2).alias("canonical_job_id"))
    v = C.review(r, member, sightings(spark, d))
    return v.select(F.col("canonical_job_id").alias("root"), "members", "active_members", moment("last_seen").alias("last_seen"), "seen_count", "shown_id")


@query(
    "agg_role_group",
    f"""WITH {_RECORDS}, f AS (SELECT *, CASE WHEN job_id % 4 = 1 THEN 'note ' || (job_id % 3)::VARCHAR END AS note, CASE WHEN job_id % 4 = 1 THEN first_seen END AS flagged FROM records)
    SELECT job_id - job_id % 6 AS root, count(*) AS n, bool_or(is_favorite) AS is_favorite, string_agg(DISTINCT location, '|' ORDER BY location) AS locations, coalesce(string_agg(DISTINCT note, '|' ORDER BY note), '') AS notes,
    strftime(max(flagged), {_T}) AS flagged_at, count(*) FILTER (NOT is_archived) AS active, string_agg(job_id::VARCHAR, ',' ORDER BY job_id) AS members FROM f GROUP BY 1""",
)
def _(spark, d):
    flag = F.col("job_id") % 4 == 1
    r = records(spark, d).withColumn("flag_reason", F.when(flag, F.concat(F.lit("note "), F.col("job_id") % 3))).withColumn("flagged_at", F.when(flag, F.col("first_seen")))
    g = C.role_groups(r, r.select("job_id", (F.col("job_id") - F.col("job_id") % 6).alias("canonical_job_id")))
    return g.select(F.col("canonical_job_id").alias("root"), "n", "is_favorite", F.array_join("locations", "|").alias("locations"), F.array_join("notes", "|").alias("notes"), moment("flagged_at").alias("flagged_at"), "active", F.array_join(F.transform("members", lambda x: x["id"].cast("string")), ",").alias("members"))


@query("agg_distinct_sightings", f"WITH {SIGHTINGS_SQL} SELECT job_id, count(DISTINCT CASE WHEN arrival % 2 = 0 THEN 'run:' || run_id ELSE 'time:' || strftime(observed_at, {_T}) END) AS n FROM sightings GROUP BY job_id")
def _(spark, d):
    from ..operators.sightings import distinct_sightings

    return distinct_sightings(sightings(spark, d).withColumn("run_id", F.when(F.col("arrival") % 2 == 0, F.col("run_id"))))


@query("win_representative", f"WITH {_RECORDS} SELECT company, job_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY is_archived, last_seen DESC NULLS LAST, job_id DESC) AS n FROM records) WHERE n = 1")
def _(spark, d):
    from ..operators.sightings import latest_per_key

    return latest_per_key(roles(spark, d), ["company"], F.col("is_archived"), F.col("last_seen").desc_nulls_last(), F.desc("job_id")).select("company", "job_id")


@query("flt_active_scope", f"WITH {_RECORDS} SELECT job_id FROM records WHERE NOT is_archived AND lower(source) = 'board'")
def _(spark, d):
    return roles(spark, d).filter(R.predicates(scope="Board")).select("job_id")


@query("flt_processable", f"WITH {_RECORDS} SELECT job_id FROM records r WHERE (job_id - job_id % 2) IN (SELECT job_id - job_id % 2 FROM records WHERE NOT is_archived) AND job_id % 5 NOT IN (1, 2, 3)")
def _(spark, d):
    outcome = F.get(F.array(*map(F.lit, ("target", "excluded", "unrelated", "manual_archive", "unmatched"))), F.col("job_id") % 5)
    r = records(spark, d).withColumn("outcome", outcome)
    return W.processable(r, r.select("job_id", (F.col("job_id") - F.col("job_id") % 2).alias("canonical_job_id"))).select("job_id")


# Roles are pairs of records: the first, with what is stored of it.  Each filter is one part of the result.
_LISTED = f"""{_RECORDS}, {MATCHES_SQL}, {DECISIONS_SQL}, cur AS (SELECT job_id, arg_max(decision_source || ' ' || decision_action, (decided_at, decision_id)) AS last FROM decisions WHERE decision_action <> 'shadow' GROUP BY job_id),
 members AS (SELECT job_id, location, job_id - (job_id - 1) % 2 AS root FROM records),
 roles AS (SELECT * REPLACE (CASE WHEN job_id % 10 = 3 THEN '' WHEN job_id % 10 = 7 THEN NULL ELSE company END AS company), job_id % 4 = 1 AS flagged, CASE job_id % 6 WHEN 1 THEN 'target' WHEN 3 THEN 'manual_keep' ELSE 'unmatched' END AS outcome FROM records WHERE job_id % 2 = 1)"""
_FILTERS: dict[str, tuple[dict, str]] = {
    "none": ({}, "NOT is_archived"),
    "archived only": ({"archived": "only"}, "is_archived"),
    "archived too": ({"archived": "include"}, "true"),
    "auto-archived": ({"outcome": "auto_archived"}, "is_archived AND outcome <> 'manual_keep' AND job_id IN (SELECT job_id FROM cur WHERE last = 'rule archive')"),
    "favorite": ({"favorite": True}, "NOT is_archived AND is_favorite"),
    "flagged": ({"flagged": True}, "NOT is_archived AND flagged"),
    "search": ({"search": "MACH"}, "NOT is_archived AND (contains(lower(title), 'mach') OR contains(lower(company), 'mach') OR contains(lower(location), 'mach'))"),
    "location": ({"location": "nation_1, "}, "NOT is_archived AND job_id IN (SELECT root FROM members WHERE contains(lower(location), 'nation_1, '))"),
    "primary location": ({"location": "NATION_3 , elsewhere", "location_primary": True}, "NOT is_archived AND job_id IN (SELECT root FROM members WHERE trim(split_part(location, ',', 1)) = 'NATION_3')"),
    "source": ({"source": "board"}, "NOT is_archived AND source = 'board'"),
    "scope": ({"scope": "BOARD"}, "NOT is_archived AND lower(source) = 'board'"),
    "company": ({"company": "ployer 1"}, "NOT is_archived AND contains(lower(company), 'ployer 1')"),
    "exact company": ({"company": "Unknown", "company_exact": True}, "NOT is_archived AND coalesce(nullif(company, ''), 'Unknown') = 'Unknown'"),
    "family": ({"family": "machinery"}, "NOT is_archived AND role_family = 'machinery'"),
    "no family": ({"family": "unclassified"}, "NOT is_archived AND (role_family IS NULL OR role_family = '')"),
    "seen since": ({"seen_since": "1998-01-01 00:00:00"}, "NOT is_archived AND last_seen >= TIMESTAMP '1998-01-01'"),
    "repeated": ({"repeated": True}, "NOT is_archived AND seen_count > 1"),
    "outcome": ({"outcome": "target"}, "NOT is_archived AND outcome = 'target'"),
    "query group": ({"query_group": "ASIA"}, "NOT is_archived AND job_id IN (SELECT job_id - (job_id - 1) % 2 FROM matches WHERE query_group = 'ASIA')"),
    "dates": ({"date_from": "1992-02-01 00:00:00", "date_to": "1993-06-01 00:00:00"}, "NOT is_archived AND first_seen BETWEEN TIMESTAMP '1992-02-01' AND TIMESTAMP '1993-06-01'"),
    "many": (
        {"archived": "include", "repeated": True, "location": "a", "query_group": "EUROPE", "seen_since": "1996-01-01 00:00:00", "family": "building"},
        "seen_count > 1 AND job_id IN (SELECT root FROM members WHERE contains(lower(location), 'a')) AND job_id IN (SELECT job_id - (job_id - 1) % 2 FROM matches WHERE query_group = 'EUROPE') AND last_seen >= TIMESTAMP '1996-01-01' AND role_family = 'building'",
    ),
}


@query("flt_list_predicates", f"WITH {_LISTED} " + " UNION ALL ".join(f"SELECT '{name}' AS filter, job_id FROM roles WHERE {where}" for name, (_, where) in _FILTERS.items()))
def _(spark, d):
    r, j = roles(spark, d), F.col("job_id")
    members = r.select("job_id", (j - (j - 1) % 2).alias("canonical_job_id"))
    listed = r.filter(j % 2 == 1).withColumns({
        "company": F.when(j % 10 == 3, "").when(j % 10 != 7, F.col("company")), "flagged_at": F.when(j % 4 == 1, F.lit("2000-01-01").cast("timestamp_ntz")),
        "outcome": F.when(j % 6 == 1, "target").when(j % 6 == 3, "manual_keep").otherwise("unmatched"),
    })
    found = [R.filtered(listed, membership=members, postings=r, matches=matches(spark, d), log=decisions(spark, d), **how).select(F.lit(name).alias("filter"), "job_id") for name, (how, _) in _FILTERS.items()]
    return reduce(lambda a, b: a.unionByName(b), found)


_CARDS_SQL = "cards AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_mktsegment END AS title, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'feed' END AS source, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS company, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_acctbal::BIGINT::VARCHAR END AS salary FROM customer)"


def _cards(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("title"), F.when(k % 7 != 0, "feed").alias("source"), F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("company"), F.when(k % 2 == 0, " ").otherwise(F.bround("c_acctbal").cast("bigint").cast("string")).alias("salary"))


@query("flt_record_valid", f"WITH {_CARDS_SQL} SELECT c_custkey, title, source, company, CASE WHEN c_custkey % 2 = 0 THEN 'Not specified' ELSE salary END AS salary FROM cards WHERE trim(title) <> '' AND source IS NOT NULL AND company <> ''")
def _(spark, d):
    from ..operators.sightings import valid_records

    return valid_records(_cards(spark, d))[0]


@query("flt_record_rejects", f"WITH {_CARDS_SQL} SELECT c_custkey, CASE WHEN trim(title) = '' THEN 'missing title' WHEN source IS NULL THEN 'missing source' ELSE 'missing company' END AS reason FROM cards WHERE trim(title) = '' OR source IS NULL OR company = ''")
def _(spark, d):
    from ..operators.sightings import valid_records

    return valid_records(_cards(spark, d))[1].select("c_custkey", "reason")


@query("flt_identity_complete", "SELECT page_id FROM pages WHERE url <> '' AND length(html) > 0 AND page_id % 10 <> 3")
def _(spark, d):
    from ..functions.text import clean_identity

    p = table(spark, d, "pages").withColumn("u", clean_identity(F.when(F.col("page_id") % 10 == 3, F.lit(" None ")).otherwise(F.col("url"))))
    return p.filter("u <> '' AND length(html) > 0").select("page_id")


@query("sort_list", f"WITH {_RECORDS} SELECT job_id, row_number() OVER (ORDER BY lower(company), lower(title), job_id) AS nth FROM records ORDER BY nth LIMIT 200")
def _(spark, d):
    from pyspark.sql import Window

    top = R.page(roles(spark, d), "company", 200)
    return top.withColumn("nth", F.row_number().over(Window.orderBy(*R.sort_orders()["company"])).cast("bigint")).select("job_id", "nth")


@query("page_list", f"WITH {_RECORDS} SELECT job_id, (SELECT count(*) FROM records WHERE NOT is_archived) AS total FROM records WHERE NOT is_archived ORDER BY seen_count DESC, last_seen DESC NULLS LAST, job_id LIMIT 50 OFFSET 100")
def _(spark, d):
    return R.page_with_total(roles(spark, d).filter(R.predicates()), "seen", 50, 100).select("job_id", "total")


@query(
    "list_query",
    f"""WITH {_RECORDS}, {MATCHES_SQL}, g AS (SELECT job_id, string_agg(DISTINCT query_group, ',' ORDER BY query_group) AS query_groups FROM matches GROUP BY job_id)
    SELECT job_id, title, company, coalesce(query_groups, '') AS query_groups, seen_count, date_diff('day', first_seen, last_seen) + 1 AS active_days, (SELECT count(*) FROM records WHERE NOT is_archived AND is_favorite) AS total
    FROM records LEFT JOIN g USING (job_id) WHERE NOT is_archived AND is_favorite ORDER BY last_seen DESC NULLS LAST, job_id LIMIT 50""",
)
def _(spark, d):
    top = R.job_list(roles(spark, d), matches(spark, d), favorite=True)
    return top.select("job_id", "title", "company", F.array_join("query_groups", ",").alias("query_groups"), "observation.seen_count", "observation.active_days", "total")


@query(
    "detail_query",
    f"""WITH {_RECORDS}, {MATCHES_SQL}, m AS (SELECT job_id - job_id % 2 AS root, query_text, location, query_group, max(observed_at) AS last FROM matches GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY last DESC, query_text, location, query_group) AS nth FROM m),
    p AS (SELECT root, count(*) AS searches, max(CASE WHEN nth = 1 THEN query_text END) AS newest FROM top WHERE nth <= 50 GROUP BY root)
    SELECT r.job_id, s.title, s.seen_count, date_diff('day', s.first_seen, s.last_seen) + 1 AS active_days, searches, newest FROM records r JOIN records s ON s.job_id = r.job_id - r.job_id % 2 LEFT JOIN p ON p.root = s.job_id""",
)
def _(spark, d):
    r = roles(spark, d)
    member = matches(spark, d).select("job_id").union(r.select("job_id")).distinct().select("job_id", (F.col("job_id") - F.col("job_id") % 2).alias("canonical_job_id"))
    shown = r.filter("job_id % 2 = 0").withColumnRenamed("job_id", "canonical_job_id")
    out = R.job_details(r, shown, member, matches(spark, d))
    return out.select("job_id", "title", "observation.seen_count", "observation.active_days", F.when(F.col("provenance").isNotNull(), F.size("provenance")).cast("bigint").alias("searches"), F.get("provenance", F.lit(0))["query_text"].alias("newest"))


@query(
    "detail_description",
    """WITH m AS (SELECT doc_id, doc_id - doc_id % 4 AS root FROM documents), t AS (SELECT root, arg_max(sha256(text), doc_id) AS text_sha256, count(DISTINCT text) AS versions FROM documents JOIN m USING (doc_id) GROUP BY root),
    a AS (SELECT root, event_id, event_type, row_number() OVER (PARTITION BY root ORDER BY event_id DESC) AS nth FROM events JOIN m ON user_id = doc_id),
    g AS (SELECT root, string_agg(event_type, ',' ORDER BY event_id DESC) AS attempts FROM a WHERE nth <= 8 GROUP BY root)
    SELECT t.root, text_sha256, versions, coalesce(attempts, '') AS attempts, t.root IN (SELECT root FROM labels JOIN m USING (doc_id)) AS reparsable FROM t LEFT JOIN g USING (root)""",
)
def _(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "job_id")
    member = docs.select("job_id", (F.col("job_id") - F.col("job_id") % 4).alias("canonical_job_id"))
    tried = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("attempt_id"), F.col("event_type").alias("status"))
    out = R.description_details(member, docs.select("job_id", "text", F.col("job_id").alias("saved_at")), tried, table(spark, d, "labels").select(F.col("doc_id").alias("job_id")))
    return out.select(F.col("canonical_job_id").alias("root"), "text_sha256", "versions", F.array_join(F.transform("attempts", lambda x: x["status"]), ",").alias("attempts"), "reparsable")


@query(
    "list_runs",
    f"""WITH {SIGHTINGS_SQL}, {_REPORTS}, r AS (SELECT s.run_id, count(*) AS queries, sum(pages_attempted)::BIGINT AS pages, count(*) FILTER (st = 'O') AS incomplete FROM reports JOIN sightings s ON s.arrival = o_orderkey GROUP BY 1),
    k AS (SELECT run_id, count(*) AS sightings, count(DISTINCT job_id) AS jobs, sum(job_id % 10)::BIGINT AS k FROM sightings GROUP BY run_id),
    {MATCHES_SQL}, m AS (SELECT *, CASE WHEN query_group = 'ASIA' THEN 'a' WHEN query_group IN ('EUROPE', 'AFRICA') THEN 'b' END AS scope FROM matches),
    ran AS (SELECT run_id, count(DISTINCT query_id) FILTER (scope = 'a') AS aq, count(DISTINCT query_id) FILTER (scope = 'b') AS bq FROM m WHERE query_id % 4 = 0 GROUP BY run_id HAVING aq > 0 AND bq > 0),
    fl AS (SELECT run_id, job_id, bool_or(scope = 'a') AS a, bool_or(scope = 'b') AS b FROM m WHERE scope IS NOT NULL GROUP BY ALL),
    ov AS (SELECT run_id, count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM fl GROUP BY run_id),
    pl AS (SELECT run_id, string_agg(location || ':' || n || ':' || sh, ',' ORDER BY location) AS places FROM (SELECT m.run_id, location, count(DISTINCT job_id) AS n, count(DISTINCT CASE WHEN a THEN job_id END) AS sh FROM m JOIN fl USING (run_id, job_id) WHERE scope = 'b'
      AND (run_id, location) IN (SELECT (run_id, location) FROM m WHERE scope = 'b' AND query_id % 4 = 0) GROUP BY ALL) GROUP BY run_id)
    SELECT k.run_id, sightings, jobs, k, queries, pages, incomplete, bq AS second_queries, shared, only_a AS first_only, only_b AS second_only, places
    FROM k LEFT JOIN r USING (run_id) LEFT JOIN (SELECT * FROM ran LEFT JOIN ov USING (run_id) LEFT JOIN pl USING (run_id)) x USING (run_id) ORDER BY run_id DESC LIMIT 20""",
)
def _(spark, d):
    s = sightings(spark, d)
    runs = s.groupBy("run_id").agg(F.count(F.lit(1)).alias("sightings"), F.count_distinct("job_id").alias("jobs"))
    saved = s.select("run_id", F.to_json(F.struct((F.col("job_id") % 10).alias("k"))).alias("metrics"))
    reports = _reports(spark, d).join(s.select("run_id", F.col("arrival").alias("o_orderkey")), "o_orderkey")
    # a run's searches are known by what they found; every fourth supplier's are on record
    m = _scoped(matches(spark, d), "query_group")
    asked = m.filter("query_id % 4 = 0").select("run_id", "query_id", "scope", "location").distinct()
    asked = asked.select("run_id", "scope", "location", F.lit(1).alias("pages_attempted"), F.lit(1).alias("pages_completed"), F.lit(0).alias("failures"))
    out = R.run_list(runs, R.key_sums(saved, "run_id", "metrics"), reports, 20, ["blocked"], queries=asked, matches=m)
    c = F.col("comparison")
    places = F.array_join(F.transform(c["places"], lambda p: F.concat_ws(":", p["location"], p["ids"].cast("string"), p["shared"].cast("string"))), ",")
    compared = [c["second"]["queries"].alias("second_queries"), *(c[x].alias(x) for x in ("shared", "first_only", "second_only")), places.alias("places")]
    return out.select("run_id", "sightings", "jobs", F.col("metrics")["k"].alias("k"), "coverage.queries", F.col("coverage.pages_attempted").alias("pages"), "coverage.incomplete", *compared)


@query("agg_distinct_options", f"WITH {_RECORDS}, {MATCHES_SQL} SELECT 'company' AS kind, company AS value FROM (SELECT DISTINCT company FROM records ORDER BY lower(company), company LIMIT 200) UNION ALL SELECT DISTINCT 'family', role_family FROM records WHERE role_family IS NOT NULL UNION ALL SELECT DISTINCT 'query_group', query_group FROM matches")
def _(spark, d):
    return R.options(roles(spark, d), matches(spark, d))


_AS_OF = "TIMESTAMP '2001-06-01'"


def _as_of():
    return F.lit("2001-06-01").cast("timestamp_ntz")


def _window_sql(name, days):
    w = f"(SELECT *, split_part(location, ',', 1) AS place, CASE WHEN job_id % 4 = 0 THEN 'target' END AS outcome FROM records{'' if days is None else f' WHERE last_seen >= {_AS_OF} - INTERVAL {days} DAY'})"
    a = f"(SELECT * FROM {w} WHERE NOT is_archived)"
    part = lambda section, label, src, rest="": f"SELECT '{name}' AS \"window\", '{section}' AS section, {label} AS name, count(*)::BIGINT AS \"count\" FROM {src} {rest}"
    return " UNION ALL ".join([
        part("source", "source", a, "GROUP BY 3"), part("company", "company", a, "GROUP BY 3"), part("place", "place", a, "GROUP BY 3"), part("family", "coalesce(role_family, 'unclassified')", a, "GROUP BY 3"),
        part("totals", "'total'", a, "HAVING count(*) > 0"), part("totals", "'repeated'", a, "WHERE seen_count > 1 HAVING count(*) > 0"), part("totals", "'new'", a, f"WHERE first_seen >= {_AS_OF} - INTERVAL 7 DAY HAVING count(*) > 0"),
        part("query_group", "query_group", f"(SELECT DISTINCT job_id, query_group FROM matches WHERE job_id IN (SELECT job_id FROM {a}))", "GROUP BY 3"),
        f"SELECT '{name}', 'recurring', job_id::VARCHAR, seen_count FROM (SELECT job_id, seen_count FROM {a} WHERE seen_count > 1 ORDER BY seen_count DESC, last_seen DESC NULLS LAST, job_id LIMIT 5)",
        part("review", "CASE WHEN is_archived THEN 'archived' ELSE 'active' END", w, "GROUP BY 3"), part("review", "'favorite'", w, "WHERE is_favorite HAVING count(*) > 0"), part("review", "'outcome ' || outcome", w, "WHERE outcome IS NOT NULL GROUP BY 3"),
        f"SELECT '{name}', 'freshness', CASE WHEN m IS NULL THEN 'empty' WHEN a <= 2 THEN 'fresh' WHEN a <= 7 THEN 'aging' ELSE 'stale' END, floor(a)::BIGINT FROM (SELECT max(last_seen) AS m, greatest(0, (date_part('epoch', {_AS_OF}) - date_part('epoch', max(last_seen))) / 86400) AS a FROM {a})",
    ])


_SPANS = {"all": None, "900d": 900, "1200d": 1200}


@query("rep_summary", f"WITH {_RECORDS}, {MATCHES_SQL} " + " UNION ALL ".join(_window_sql(n, k) for n, k in _SPANS.items()))
def _(spark, d):
    r = roles(spark, d).withColumn("outcome", F.when(F.col("job_id") % 4 == 0, "target"))
    return R.summaries(r, matches(spark, d), _as_of(), _SPANS)


@query("top_counts", f"WITH {POSTINGS_SQL} SELECT title AS name, count(*) AS \"count\" FROM postings GROUP BY 1 ORDER BY 2 DESC, lower(title), title LIMIT 8")
def _(spark, d):
    return R.top_counts(postings(spark, d), "title").drop("share")


@query("top_recurring", f"WITH {_RECORDS} SELECT job_id, seen_count FROM records WHERE seen_count > 1 ORDER BY seen_count DESC, last_seen DESC, job_id LIMIT 5")
def _(spark, d):
    return R.recurring(roles(spark, d)).select("job_id", "seen_count")


@query("rep_locations", f"WITH {POSTINGS_SQL} SELECT place, count(*) AS roles FROM (SELECT DISTINCT job_id - job_id % 4 AS root, split_part(location, ',', 1) AS place FROM postings) GROUP BY place")
def _(spark, d):
    from ..functions.text import primary_location

    p = postings(spark, d).groupBy((F.col("job_id") - F.col("job_id") % 4).alias("root")).agg(F.collect_set(primary_location(F.col("location"))).alias("places"))
    return p.select("root", F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("roles"))


@query("rep_query_groups", f"WITH {MATCHES_SQL} SELECT query_group, count(DISTINCT job_id) AS roles FROM matches GROUP BY query_group")
def _(spark, d):
    return R.by_query_group(matches(spark, d))


@query("rep_new_vs_repeat", f"WITH {_RECORDS} SELECT company, count(*) FILTER (first_seen >= TIMESTAMP '1997-01-01') AS new, count(*) FILTER (seen_count > 1) AS repeated FROM records GROUP BY company")
def _(spark, d):
    return R.new_and_repeated(roles(spark, d), "company", F.lit("1997-01-01").cast("timestamp_ntz"))


@query("rep_freshness", f"WITH {SIGHTINGS_SQL}, n AS (SELECT max(observed_at) AS m FROM sightings) SELECT strftime(m, {_T}) AS newest, floor(greatest(0, date_part('epoch', {_AS_OF}) - date_part('epoch', m)) / 86400)::BIGINT AS age_days, CASE WHEN m IS NULL THEN 'empty' WHEN greatest(0, date_part('epoch', {_AS_OF}) - date_part('epoch', m)) / 86400 <= 2 THEN 'fresh' WHEN greatest(0, date_part('epoch', {_AS_OF}) - date_part('epoch', m)) / 86400 <= 7 THEN 'aging' ELSE 'stale' END AS status FROM n")
def _(spark, d):
    return R.freshness(sightings(spark, d), _as_of()).select(moment("newest").alias("newest"), "age_days", "status")


@query("rep_drilldown_consistency", f"WITH {_RECORDS} SELECT source AS name, count(*) AS reported, count(*) AS listed FROM records WHERE NOT is_archived AND last_seen IS NOT NULL GROUP BY source")
def _(spark, d):
    r = roles(spark, d).filter("NOT is_archived AND last_seen IS NOT NULL")
    rep = R.summary(r, _as_of()).filter("section = 'source'").select("name", F.col("count").alias("reported"))
    listed = r.filter(R.predicates(source="board")).groupBy(F.lit("board").alias("name")).agg(F.count(F.lit(1)).alias("listed")).unionByName(r.filter(R.predicates(source="feed")).groupBy(F.lit("feed").alias("name")).agg(F.count(F.lit(1)).alias("listed")))
    return rep.join(listed, "name")


@query("rep_role_mix", f"WITH {_RECORDS} SELECT role_family, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(role_family) FROM records), 1)::DOUBLE AS share, (SELECT count(role_family) FROM records) AS recognised FROM records WHERE role_family IS NOT NULL GROUP BY role_family")
def _(spark, d):
    return R.role_mix(roles(spark, d))


@query("rep_skill_distribution", "SELECT p_type AS category, split_part(p_name, ' ', 2) AS term, count(DISTINCT l_orderkey) AS roles FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def _(spark, d):
    claims = table(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.col("p_type").alias("category"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"))
    return R.skill_distribution(claims, table(spark, d, "lineitem").select(F.col("l_partkey").alias("job_id"), F.col("l_orderkey").alias("canonical_job_id")))


# --- worklists: customers as postings, events as attempts


def _attempts(spark, d):
    s = F.col("event_type")
    return table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("attempt_id"), F.when(s == "error", "failed").when(s == "click", "interrupted").when(s == "view", "pending").otherwise("done").alias("status"), (F.col("value") > 20).alias("refresh"))


def _saved(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("job_id"))


_ATT = "att AS (SELECT user_id AS job_id, event_id AS attempt_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'interrupted' WHEN 'view' THEN 'pending' ELSE 'done' END AS status, value > 20 AS refresh FROM events), lasta AS (SELECT job_id, max(attempt_id) AS attempt_id, arg_max(status, attempt_id) AS status, arg_max(refresh, attempt_id) AS refresh FROM att GROUP BY job_id)"


@query("wl_unfetched", f"WITH {_RECORDS} SELECT job_id FROM records WHERE NOT is_archived AND job_id NOT IN (SELECT user_id FROM events) AND job_id NOT IN (SELECT doc_id FROM labels) AND job_id % 4 <> 1")
def _(spark, d):
    r = records(spark, d)
    return W.unfetched(r, _attempts(spark, d), _saved(spark, d), r.filter("job_id % 4 = 1")).select("job_id")


@query("wl_failed", f"WITH {_RECORDS}, {_ATT} SELECT r.job_id, status FROM records r JOIN lasta USING (job_id) WHERE NOT is_archived AND status IN ('failed', 'interrupted') AND (refresh OR r.job_id NOT IN (SELECT doc_id FROM labels))")
def _(spark, d):
    return W.failed(records(spark, d), _attempts(spark, d), _saved(spark, d)).select("job_id", "status")


@query("win_failed_latest", f"WITH {_ATT} SELECT job_id, attempt_id FROM lasta WHERE status IN ('failed', 'interrupted')")
def _(spark, d):
    return W.latest_attempt(_attempts(spark, d)).filter("status IN ('failed', 'interrupted')").select("job_id", "attempt_id")


@query("wl_enqueue", f"WITH {_RECORDS}, {_ATT} SELECT job_id FROM records WHERE job_id % 2 = 0 AND NOT is_archived AND job_id NOT IN (SELECT doc_id FROM labels) AND job_id NOT IN (SELECT job_id FROM att WHERE status = 'pending')")
def _(spark, d):
    r = records(spark, d)
    return W.enqueue(r.filter("job_id % 2 = 0"), r, _saved(spark, d), _attempts(spark, d).filter("status = 'pending'")).select("job_id")


@query("wl_skip_archived", f"WITH {_RECORDS}, {_ATT} SELECT attempt_id, CASE WHEN status = 'pending' AND job_id % 11 = 0 AND job_id IN (SELECT job_id FROM records) THEN 'interrupted' WHEN status = 'pending' AND NOT refresh AND job_id IN (SELECT doc_id FROM labels) THEN 'unchanged' ELSE status END AS status FROM att")
def _(spark, d):
    return W.resolved_pending(_attempts(spark, d), records(spark, d), _saved(spark, d)).select("attempt_id", "status")


@query("wl_reuse_saved", f"WITH {_ATT} SELECT count(*) AS reused FROM att WHERE status = 'pending' AND NOT refresh AND job_id IN (SELECT doc_id FROM labels)")
def _(spark, d):
    none = records(spark, d).filter("1 = 0")
    return W.resolved_pending(_attempts(spark, d), none, _saved(spark, d)).agg(F.count_if(F.col("status") == "unchanged").alias("reused"))


@query("wl_extract_batch", f"WITH {_RECORDS} SELECT r.job_id FROM records r JOIN documents d ON d.doc_id = r.job_id WHERE sha256(d.text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0) ORDER BY is_favorite DESC, last_seen DESC NULLS LAST, r.job_id LIMIT 100")
def _(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), F.sha2("text", 256).alias("fingerprint"))
    return W.extract_batch(records(spark, d), texts, texts.filter("job_id % 5 = 0")).select("job_id")


@query("wl_retry_batch", f"WITH {_RECORDS}, {_ATT} SELECT job_id FROM lasta WHERE status IN ('failed', 'interrupted') AND job_id IN (SELECT job_id FROM records WHERE NOT is_archived) ORDER BY attempt_id LIMIT 100")
def _(spark, d):
    return W.retry_batch(_attempts(spark, d).withColumnRenamed("attempt_id", "work_id"), roles(spark, d).filter("NOT is_archived")).select("job_id")


@query("wl_status_latest", "SELECT event_id, c_mktsegment AS title FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) JOIN customer ON c_custkey = user_id")
def _(spark, d):
    work = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("work_id"))
    return W.newest_work(work, postings(spark, d)).select(F.col("work_id").alias("event_id"), "title")


@query("agg_status_counts", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS tokens FROM events GROUP BY user_id) SELECT status, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM l GROUP BY status")
def _(spark, d):
    w = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("work_id"), F.col("event_type").alias("status"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"), F.col("value").alias("cost"))
    return R.status_counts(w).drop("cost")


@query("agg_fetch_status", f"WITH {_ATT} SELECT (SELECT count(*) FROM att WHERE status = 'pending' AND job_id % 11 <> 0) AS pending, (SELECT count(DISTINCT doc_id) FROM labels) AS saved, (SELECT count(*) FROM lasta WHERE status IN ('failed', 'interrupted')) AS failed")
def _(spark, d):
    a = _attempts(spark, d).agg(F.count_if((F.col("status") == "pending") & (F.col("job_id") % 11 != 0)).alias("pending"))
    s = _saved(spark, d).agg(F.count_distinct("job_id").alias("saved"))
    f = W.latest_attempt(_attempts(spark, d)).agg(F.count_if(F.col("status").isin("failed", "interrupted")).alias("failed"))
    return a.crossJoin(s).crossJoin(f)
