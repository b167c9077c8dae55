"""Corrections by path in nested drafts: the cases of a reviewed plan, and that nothing of it is done in part."""

import hashlib
import json
from copy import deepcopy

import pytest

from resight.operators import corrections as C
from resight.operators.extraction import FIELDS

TEXT = {"title": "Data person", "description.1": "We work with  Python – daily, on “big” data", "description.2": "Deutsch und Englisch sind erwünscht", "description.3": "second paragraph of words"}
WORK = "work_id bigint, job_id bigint, status string, error_kind string, repaired_by string"


def ev(ref, quote):
    return {"source_ref": ref, "quote": quote}


def draft():
    lists = {f: [] for f in C.CLAIMS}
    lists["description_languages"] = [{"code": "de", "evidence": [ev("description.2", "Deutsch und")]}, {"code": "fr", "evidence": [ev("description.2", "Bonjour")]}]
    lists["requirements"] = [{"term": "Python", "category": "skill", "proficiency": None, "strength": "required", "condition": None, "alternative_group": None, "alternative_option": None, "evidence": [ev("description.1", "Java daily"), ev("description.1", 'with python - daily, on "big"')]}]
    return lists | {"states": {f: "stated" if f == "requirements" else "not_stated" for f in FIELDS}}


def normal(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def sha(x):
    return hashlib.sha256(normal(x).encode()).hexdigest()


def item(work, d, **other):
    fix = {"path": ["requirements", "0", "evidence", "0"], "original": ev("description.1", "Java daily"), "replacement": ev("description.1", "Python – daily")}
    cut = {"original": json.dumps(draft()["description_languages"][1], indent=1), "reason": "not there"}
    return {"work_id": work, "attempt_id": work * 10, "output_sha256": sha(d), "corrections": [fix], "removals": [cut]} | other


@pytest.fixture
def tables(spark):
    """Works 1, 2, ... with their newest drafts, of jobs 101, 102, ...; all active."""

    def make(drafts, other=None, more=()):
        n = range(1, len(drafts) + 1)
        work = spark.createDataFrame([(k, k + 100, *(other or {}).get(k, ("failed", "output")), None) for k in n] + list(more), WORK)
        attempts = spark.createDataFrame([(k, a, o) for k in n for a, o in ((k * 10 - 1, "{}"), (k * 10, json.dumps(drafts[k - 1], indent=2)))], "work_id bigint, attempt_id bigint, output string")
        sources = spark.createDataFrame([(k, r, t) for k in n for r, t in TEXT.items()], "work_id bigint, ref string, text string")
        return work, attempts, sources, spark.createDataFrame([(k + 100,) for k in n], "job_id bigint")

    return make


def run(spark, plan, tables):
    return C.reviewed(spark.createDataFrame(plan, C.PLAN), *tables)


def test_drafts_are_edited_by_path_and_nothing_else_changes(spark, tables):
    d = draft()
    t = tables([d] * 2)
    report = run(spark, [item(1, d), item(2, d, removals=None, corrections=None)], t)
    rows = {r.work_id: r for r in report.collect()}
    assert rows[1].status == "ready" and rows[1].problem is None and (rows[1].n_corrections, rows[1].n_removed) == (1, 1)
    # the second still has quotes that are nowhere
    assert rows[2].status == "rejected" and rows[2].problem == "evidence is not in its source" and rows[2].draft is None
    want = deepcopy(d)
    del want["description_languages"][1]
    line = TEXT["description.1"]
    at = lambda ref, q: ev(ref, q) | {"start": TEXT[ref].index(q), "end": TEXT[ref].index(q) + len(q)}
    want["description_languages"][0]["evidence"] = [at("description.2", "Deutsch und")]
    told = line[line.index("with") : line.index(" data")]
    want["requirements"][0]["evidence"] = [at("description.1", "Python – daily"), at("description.1", told) | {"repair": {"method": "typography", "original_source_ref": "description.1", "original_quote": 'with python - daily, on "big"'}}]
    assert rows[1].draft == normal(want)
    assert C.repairs(report).count() == 0


def test_a_plan_is_applied_once(spark, tables):
    d = draft()
    work, *rest = tables([d] * 3)
    plan = [item(1, d), item(3, d)]
    done = C.repairs(run(spark, plan, (work, *rest)))
    assert {(r.work_id, r.attempt_id, r.content_sha256 == hashlib.sha256(r.draft.encode()).hexdigest()) for r in done.collect()} == {(1, 10, True), (3, 30, True)}
    after = C.repaired_work(work, done)
    assert after.columns == work.columns
    assert {(r.work_id, r.status, r.error_kind, r.repaired_by is None) for r in after.collect()} == {(1, "succeeded", None, False), (2, "failed", "output", True), (3, "succeeded", None, False)}
    again = run(spark, plan, (after, *rest))
    assert {r.status for r in again.collect()} == {"already_repaired"} and C.repairs(again).count() == 0
    # another plan for works that have succeeded is none
    other = run(spark, [item(1, d, removals=[])], (after, *rest)).first()
    assert (other.status, other.problem) == ("rejected", "no failed output")


FIX = item(1, draft())["corrections"][0]
CUT = item(1, draft())["removals"][0]
FAULTS = [
    ({"attempt_id": 9}, "changed since review"),
    ({"attempt_id": None}, "changed since review"),
    ({"output_sha256": "0"}, "draft changed since review"),
    ({"work_id": 99}, "no active job"),
    ({"work_id": None}, "no active job"),
    ({"corrections": [FIX | {"path": ["requirements", "1", "evidence", "0"]}]}, "evidence is not as reviewed"),
    ({"corrections": [FIX | {"path": ["requirements", "0", "term"]}]}, "evidence is not as reviewed"),
    ({"corrections": [FIX | {"original": ev("description.1", "Java")}]}, "evidence is not as reviewed"),
    ({"corrections": [FIX, FIX]}, "evidence is corrected twice"),
    ({"corrections": [FIX | {"replacement": ev("description.1", "")}]}, "replacement has no source or words"),
    ({"corrections": [FIX | {"replacement": ev("description.9", "Python")}]}, "replacement is no exact span"),
    ({"corrections": [FIX | {"replacement": ev("description.1", "python - daily")}]}, "replacement is no exact span"),
    ({"corrections": [FIX | {"replacement": ev("description.1", "An invented requirement")}]}, "replacement is no exact span"),
    ({"removals": [CUT | {"reason": " "}]}, "removal has no reason or no such language"),
    ({"removals": [CUT, CUT]}, "removal has no reason or no such language"),
    ({"removals": [CUT | {"original": "no json"}]}, "removal has no reason or no such language"),
    ({"removals": []}, "evidence is not in its source"),
    ({}, None),
]


def test_what_does_not_fit_is_rejected_and_stops_the_plan(spark, tables):
    d = draft()
    plan = [item(k, d) | other for k, (other, _) in enumerate(FAULTS, 1)]
    report = run(spark, plan, tables([d] * len(FAULTS)))
    assert {(r.work_id, r.problem) for r in report.collect()} == {(p["work_id"], problem) for p, (_, problem) in zip(plan, FAULTS, strict=True)}
    assert C.repairs(report).count() == 0


def test_works_that_cannot_be_repaired_and_drafts_that_do_not_pass(spark, tables):
    faults = [
        (lambda d: d["requirements"][0].update(strength="maybe"), "strength is unknown"),
        (lambda d: d.update(more=1), "more is not allowed"),
        (lambda d: d.update(seniority=None), "seniority is no list"),
        (lambda d: d["states"].update(education="stated"), "education is marked without values"),
        (lambda d: d["description_languages"].insert(1, {"code": "de", "evidence": [ev("description.2", "Deutsch")]}), "description_languages duplicate code"),
        (lambda d: d["description_languages"].pop(), "removal has no reason or no such language"),
    ]
    drafts = [draft() for _ in range(5 + len(faults))]
    for d, (change, _) in zip(drafts[5:], faults, strict=True):
        change(d)
    # a newer work of the first job; another error of the second; the third twice in the plan; the fifth of no active job
    work, attempts, sources, active = tables(drafts, {2: ("failed", "network")}, [(70, 101, "pending", None, None)])
    plan = [item(k, d, removals=[CUT]) for k, d in enumerate(drafts, 1)]
    got = run(spark, [*plan, plan[2]], (work, attempts, sources, active.filter("job_id <> 105"))).collect()
    want = [(1, "changed since review"), (2, "no failed output"), (3, "work is in the plan twice"), (3, "work is in the plan twice"), (4, None), (5, "no active job")]
    assert sorted((r.work_id, r.problem) for r in got) == want + [(k, m) for k, (_, m) in enumerate(faults, 6)]
    assert run(spark, [], (work, attempts, sources, active)).count() == 0


def test_edits_reach_every_list_and_leave_other_forms_alone(spark):
    from pyspark.sql import functions as F

    d = {"a": [{"evidence": [1, {"x": None}], "b": 2.5}, 7, None, []], "evidence": {"k": "v"}, "c": None, "d": "é\n\""}
    row = spark.createDataFrame([(json.dumps(d),), ("[1]",), (None,)], "t string")
    v = F.try_parse_json("t")
    got = [r[0] for r in row.select(F.to_json(C.each_evidence(v, lambda p, e: F.to_variant_object(F.array(p))))).collect()]
    want = deepcopy(d)
    want["a"][0]["evidence"] = [["a.0.evidence.0"], ["a.0.evidence.1"]]
    assert got == [normal(want), "[1]", None]
    assert [(x["path"], x["json"]) for x in row.select(C.evidence_of(v)).first()[0]] == [("a.0.evidence.0", "1"), ("a.0.evidence.1", '{"x":null}')]


def test_a_draft_is_parsed_once_and_only_where_it_may_be_repaired(spark, tables):
    from pyspark.sql import functions as F

    assert str(C.check_draft(F.col("some_draft"))).count("try_parse_json(some_draft)") == 1
    # the outputs of works that ids and states reject are not even read
    d = draft()
    work, attempts, sources, active = tables([d] * 4, more=[(70, 102, "pending", None, None)])
    unread = F.when(F.col("work_id") != 1, F.raise_error(F.lit("read")).cast("string")).otherwise(F.col("output"))
    plan = [item(1, d), item(2, d), item(3, d), item(4, d), item(4, d)]
    rows = run(spark, plan, (work, attempts.withColumn("output", unread), sources, active.filter("job_id <> 103"))).collect()
    assert sorted((r.work_id, r.problem) for r in rows) == [(1, None), (2, "changed since review"), (3, "no active job"), (4, "work is in the plan twice"), (4, "work is in the plan twice")]
    assert {(r.work_id, r.job_id, r.status, r.n_corrections, r.n_removed, r.draft is None) for r in rows} == {(k, k + 100, "rejected" if k > 1 else "ready", 1, 1, k > 1) for k in (1, 2, 3, 4)}
