"""Consolidation, recorded decisions and list filters, case by case."""

import pytest
from pyspark.sql import functions as F

from resight.functions.text import valid_title
from resight.operators import consolidate as C
from resight.operators import decisions as D
from resight.operators import reports as R

TEXT = "a text that is long enough to prove that two postings are one role " * 4
POSTING = "job_id string, identity string, source string, title string, company string, text string, last_seen int"


@pytest.mark.parametrize(("title", "valid"), [("Role", True), ("unknown", True), ("n/a", True), ("jobs inside", True), ("Archived placeholder", False), ("An ARCHIVED/-placeholder", False), ("12 Jobs near Bern", False), ("jobs in", False), ("", False), (" \t", False), (None, False)])
def test_titles_that_say_nothing(spark, title, valid):
    assert spark.createDataFrame([(title,)], "t string").select(valid_title(F.col("t"))).first()[0] is valid


def keys(spark, *rows):
    """The role keys of postings (title, company, text), each with an identity of its own."""
    df = spark.createDataFrame([(str(i), f"i{i}", *("s", *r)[-4:], i) for i, r in enumerate(rows)], POSTING)
    return [r.role_key for r in C.role_keys(df).orderBy("job_id").collect()]


@pytest.mark.parametrize("company", ["Unknown", "N/A", " not  Specified ", "", None])
def test_postings_without_a_company_stay_apart(spark, company):
    assert keys(spark, ("Role", company, TEXT), ("Role", company, TEXT)) == ["i0", "i1"]


def test_spellings_of_one_role_are_one(spark):
    same = keys(spark, ("Role", "Acme GmbH", TEXT), ("ROLE ", "Acme  GmbH", TEXT.replace(" ", " \n")), (" role", "ACME GMBH", " " + TEXT))
    assert len(set(same)) == 1 and not same[0].startswith("i")
    german = keys(spark, ("Rolle", "Straße AG", TEXT), ("Rolle", "STRASSE AG", TEXT), ("Rolle", "Straße AG", TEXT + "café"), ("Rolle", "Straße AG", TEXT + "café"))
    assert german[0] == german[1] != german[2] == german[3]
    assert len(set(keys(spark, ("Role", "A", TEXT), ("Role", "B", TEXT), ("Roles", "A", TEXT), ("Role", "A", TEXT + "x"), ("Role", "A", TEXT.upper())))) == 5


def test_short_texts_prove_nothing(spark):
    assert keys(spark, ("Role", "Co", "x" + " " * 300), ("Role", "Co", "x" + " " * 300), ("Role", "Co", None), ("jobs in Bern", "Co", TEXT), ("jobs in Bern", "Co", TEXT)) == ["i0", "i1", "i2", "i3", "i4"]
    assert len(set(keys(spark, ("Role", "Co", "y" * 200), ("Role", "Co", "y" * 200)))) == 1 and len(set(keys(spark, ("Role", "Co", "y" * 199), ("Role", "Co", "y" * 199)))) == 2


def test_the_latest_record_with_a_title_speaks(spark):
    rows = [("a", "x", "s", "Role", "Co", TEXT, 1), ("b", "x", "s", "Archived placeholder", "Co", "", 9), ("c", "y", "s", "role", "CO", TEXT, 1), ("d", "z", "s", "Role", "Co", TEXT, 1), ("e", "z", "s", "Other", "Co", TEXT, 2)]
    k = {r.job_id: r.role_key for r in C.role_keys(spark.createDataFrame(rows, POSTING)).collect()}
    assert k["a"] == k["b"] == k["c"] != k["d"] == k["e"]


AT = "2024-02-01 00:00:00"
BATCH = "decision_id long, job_id string, decision_source string, decision_action string, filter_name string, reason string, confidence string, batch_id string"


def test_decisions_are_validated_and_get_defaults(spark):
    rows = [
        (1, " a ", None, " ", " f ", " why ", "0.5", None), (None, "a", "", None, "f", "why", "many", None), (None, "b", "manual", "keep", "f", "why", "", "b1"),
        (4, "", "rule", "keep", "f", "why", None, None), (5, "a", "rule", "keep", " ", "why", None, None), (6, "a", "rule", "keep", "f", None, None, None), (None, "c", "rule", "restore", "f", "why", None, "b0"), (1, "a", None, None, "f", "why", None, None),
    ]
    log = spark.createDataFrame([("c", "f", "restore", "b0")], "job_id string, filter_name string, decision_action string, batch_id string")
    out = D.recorded(spark.createDataFrame(rows, BATCH), log, F.lit(AT).cast("timestamp_ntz")).collect()
    got = sorted((str(r.decision_id), r.job_id.strip(), r.decision_source, r.decision_action, r.filter_name, r.reason, r.confidence, r.details, str(r.decided_at)) for r in out)
    assert [g[:-3] for g in got] == [("1", "a", "rule", "archive", "f", "why"), ("None", "a", "rule", "archive", "f", "why"), ("None", "b", "manual", "keep", "f", "why")]
    assert [g[-3] for g in got][1:] == [None, None] and {g[-2:] for g in got} == {("{}", AT)}


STATE = "job_id string, archived_at timestamp_ntz, archived_reason string, outcome string, role_family string, reason string, evaluated_at timestamp_ntz"


def state(spark, *rows):
    return spark.createDataFrame([(i, None, why, outcome, "fam", None, None) for i, why, outcome in rows], STATE).withColumn("archived_at", F.when(F.col("archived_reason").isNotNull(), F.lit("2020-01-01").cast("timestamp_ntz")))


def told(df):
    return {r.job_id: (r.archived_reason, r.outcome, r.role_family, r.reason, r.archived_at is not None, None if r.evaluated_at is None else str(r.evaluated_at)) for r in df.collect()}


def test_archiving_with_decisions(spark):
    s = state(spark, ("a", None, "target"), ("b", "old", "x"), ("c", None, "x"), ("d", None, "x"), ("e", None, "x"))
    rows = [(1, "a", None, None, "f", "first", None, None), (2, "a", "rule", "archive", "f", "second", None, None), (3, "b", "Manual", "ARCHIVE", "f", "by hand", None, None), (4, "c", "rule", "keep", "f", "stays", None, None), (5, "d", "rule", "archive", "f", " ", None, None), (6, "nobody", "rule", "archive", "f", "x", None, None)]
    out = D.archived_with_decisions(s, spark.createDataFrame(rows, BATCH), F.lit(AT).cast("timestamp_ntz"))
    assert told(out["state"]) == {
        "a": ("first", "target", "fam", None, True, None), "b": ("old", "manual_archive", None, "by hand", True, AT), "c": (None, "x", "fam", None, False, None), "d": ("Archived by filter", "x", "fam", None, True, None), "e": (None, "x", "fam", None, False, None),
    }
    assert sorted(r.decision_id for r in out["decisions"].collect()) == [1, 2, 3, 4, 6]  # the blank reason can't be recorded
    assert tuple(out["counts"].first()) == (2, 5)
    assert out["state"].columns == s.columns


def test_archiving_and_restoring_by_hand_take_the_whole_role(spark):
    s = state(spark, ("a", None, "target"), ("b", "old", "x"), ("c", None, "x"))
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "job_id string, canonical_job_id string")
    ids = spark.createDataFrame([("b",), ("zzz",)], "job_id string")
    at = F.lit(AT).cast("timestamp_ntz")
    out = D.manually_archived(s, ids, members, at)
    assert told(out["state"]) == {"a": ("Archived manually", "manual_archive", None, "Archived manually", True, AT), "b": ("old", "manual_archive", None, "Archived manually", True, AT), "c": (None, "x", "fam", None, False, None)}
    assert sorted((r.job_id, r.decision_source, r.decision_action, r.filter_name) for r in out["decisions"].collect()) == [("a", "manual", "archive", "manual_archive"), ("b", "manual", "archive", "manual_archive")]
    assert out["counts"].first().archived == 1
    again = D.manually_archived(out["state"], ids, members, at)
    assert again["counts"].first().archived == 0
    back = D.restored(out["state"], ids, members, at)
    assert told(back["state"])["a"] == (None, "manual_keep", None, "Restored for reconsideration", False, AT) == told(back["state"])["b"]
    assert told(back["state"])["c"] == (None, "x", "fam", None, False, None)
    assert sorted((r.job_id, r.decision_action, r.filter_name) for r in back["decisions"].collect()) == [("a", "restore", "manual_restore"), ("b", "restore", "manual_restore")]
    assert D.restored(s, spark.createDataFrame([("zzz",)], "job_id string"), members, at)["decisions"].count() == 0


ROLE = "job_id int, title string, company string, location string, source string, role_family string, outcome string, is_archived boolean, archived_at timestamp_ntz, is_favorite boolean, flagged_at timestamp_ntz, seen_count int, first_seen timestamp_ntz, last_seen timestamp_ntz"


@pytest.fixture(scope="module")
def listed(spark):
    t = lambda s: F.to_timestamp_ntz(F.lit(s))
    rows = [(1, "Data 100%", "Acme", "Bern, CH", "feed", "data", "target"), (3, None, "", "Genf", "Feed", "", "x"), (5, "Clerk", None, None, "board", None, "manual_keep"), (7, "Data", "ACME Two", "Basel", "board", "data", "x")]
    df = spark.createDataFrame(rows, "job_id int, title string, company string, location string, source string, role_family string, outcome string")
    df = df.withColumn("is_archived", F.col("job_id") == 7).withColumn("archived_at", F.when(F.col("job_id") == 7, t("2024-01-01 00:00:00"))).withColumn("is_favorite", F.col("job_id") == 3)
    df = df.withColumn("flagged_at", F.when(F.col("job_id") == 5, t("2024-01-01 00:00:00"))).withColumn("seen_count", F.when(F.col("job_id") == 1, 3))
    df = df.withColumn("first_seen", F.when(F.col("job_id") < 5, t("2024-01-01 10:00:00.9"))).withColumn("last_seen", F.when(F.col("job_id") < 5, t("2024-01-02 10:00:00.9")))
    members = spark.createDataFrame([(1, 1), (2, 1), (20, 1), (3, 3), (5, 5), (7, 7), (8, 7)], "job_id int, canonical_job_id int")
    postings = spark.createDataFrame([(1, "Bern, CH"), (2, " Zurich , ZH"), (20, "Zurich West"), (3, "Genf"), (5, None), (7, "Basel"), (8, "Zurich")], "job_id int, location string")
    matches = spark.createDataFrame([(2, "data"), (20, "data"), (3, "office"), (8, "data"), (5, None)], "job_id int, query_group string")
    log = spark.createDataFrame([(1, 7, "rule", "archive", 5), (2, 1, "rule", "archive", 5)], "decision_id long, job_id int, decision_source string, decision_action string, decided_at int").withColumn("filter_name", F.lit("f"))
    return lambda **how: R.filtered(df, membership=members, postings=postings, matches=matches, log=log, **how)


@pytest.mark.parametrize(
    ("how", "ids"),
    [
        ({}, [1, 3, 5]), ({"archived": "only"}, [7]), ({"archived": "include"}, [1, 3, 5, 7]), ({"outcome": "auto_archived"}, [7]), ({"outcome": "auto_archived", "archived": "exclude"}, [7]), ({"favorite": True}, [3]), ({"flagged": True}, [5]), ({"flagged": False}, [1, 3]),
        ({"search": "100%"}, [1]), ({"search": "gen"}, [3]), ({"location": "ZURICH"}, [1]), ({"location": "zurich", "archived": "include"}, [1, 7]), ({"location": "Zurich, anywhere", "location_primary": True}, [1]), ({"location": "Zurich West", "location_primary": True}, [1]), ({"location": "Zuri", "location_primary": True}, []),
        ({"source": "feed"}, [1]), ({"scope": "FEED"}, [1, 3]), ({"company": "acme"}, [1]), ({"company": "Unknown", "company_exact": True}, [3, 5]), ({"company": "unknown"}, []), ({"family": "data"}, [1]), ({"family": "unclassified"}, [3, 5]), ({"repeated": True}, [1]), ({"outcome": "target"}, [1]),
        ({"query_group": "data"}, [1]), ({"query_group": "office"}, [3]), ({"query_group": "data", "location": "zurich", "archived": "include"}, [1, 7]), ({"seen_since": "2024-01-02 10:00:00"}, [1, 3]), ({"seen_since": "2024-01-02 10:00:01"}, []),
        ({"date_from": "2024-01-01 10:00:00", "date_to": "2024-01-01 10:00:00"}, [1, 3]), ({"date_from": "2024-01-01 10:00:01"}, []), ({"date_to": "2024-01-01 09:59:59"}, []),
    ],
)
def test_list_filters(listed, how, ids):
    assert sorted(r.job_id for r in listed(**how).collect()) == ids


def test_filters_that_ask_for_others_are_semi_joins(listed):
    plan = listed(query_group="data", location="zurich")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2
    assert "Join" not in listed(search="x", family="data")._jdf.queryExecution().optimizedPlan().toString()


def test_roles_without_memberships_are_their_own_members(spark):
    roles = spark.createDataFrame([(1, "Bern"), (2, "Basel")], "job_id int, location string").withColumn("is_archived", F.lit(False))
    assert [r.job_id for r in R.filtered(roles, location="bas").collect()] == [2]


def test_first_of_groups_holds_no_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(30, 0, -1)] + [("b", None), ("b", 2), (None, 5)], "g string, x int")
    out = R.first_of_groups(df, "g", "x", 3)
    assert {r.g: (r["items"], r.total) for r in out.collect()} == {"a": ([1, 2, 3], 30), "b": ([2], 2), None: ([5], 1)}
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2  # before and after the shuffle
