"""Operators on small tables of their own: order of rules, idempotence, ties, empty inputs."""

import pytest
from pyspark.sql import functions as F

from resight.functions import identity as I
from resight.functions import text as T
from resight.functions import values as V
from resight.operators import consolidate as C
from resight.operators import decisions as D
from resight.operators import evidence as E
from resight.operators import extraction as X
from resight.operators import pages as G
from resight.operators import provenance as P
from resight.operators import reports as R
from resight.operators import rules as U
from resight.operators import sightings as S
from resight.operators import worklist as W

LINKS = I.UrlRules("jobsite", "jobsite\\.com", ("/jobs/view/([0-9]+)/?$", "/jobs/view/[^/]*-([0-9]{6,})/?$"), ("currentjobid", "jobid"))


@pytest.mark.parametrize(
    ("url", "found"),
    [
        ("JobSite:42", "jobsite:42"),
        ("https://www.jobsite.com/jobs/view/123/?trk=x", "jobsite:123"),
        ("https://de.jobsite.com/jobs/view/data-scientist-at-x-1234567", "jobsite:1234567"),
        ("https://jobsite.com/jobs/search?CurrentJobId=77&x=1", "jobsite:77"),
        ("https://jobsite.com/jobs/search?jobId=abc", "jobsite.com/jobs/search"),
        ("Example.org/a%20b+c/?q#f", "example.org/a b+c"),
        ("http://EXAMPLE.org/a%20b+c", "example.org/a b+c"),
        (" NaN ", ""),
        (None, ""),
    ],
)
def test_url_identity(spark, url, found):
    assert spark.createDataFrame([(url,)], "u string").select(I.url_identity(F.col("u"), LINKS)).first()[0] == found


@pytest.mark.parametrize(
    ("text", "zone", "found"),
    [
        ("2026-03-29T02:30:00", "Europe/Berlin", "2026-03-29 01:30:00"),
        ("2026-10-25 02:30:00", "Europe/Berlin", "2026-10-25 00:30:00"),
        ("2026-09-05T12:00:00+02:00", "Europe/Berlin", "2026-09-05 10:00:00"),
        ("2026-09-05T12:00:00Z", "Europe/Berlin", "2026-09-05 12:00:00"),
        ("2026-09-05", "UTC", "2026-09-05 00:00:00"),
        ("soon", "UTC", None),
        (None, "UTC", None),
    ],
)
def test_to_utc(spark, text, zone, found):
    assert spark.createDataFrame([(text,)], "t string").select(F.date_format(V.to_utc(F.col("t"), zone), "yyyy-MM-dd HH:mm:ss")).first()[0] == found


def test_folding(spark):
    df = spark.createDataFrame([(" Dipl.‐Ing.  (m/w/d) –  Größe, ÅNGSTRÖM ",), (None,)], "t string").select(T.folded(F.col("t")))
    assert [r[0] for r in df.collect()] == ["dipl.-ing. (m/w/d) - groe, angstrom", ""]


SETS = U.RuleSets(
    target=[("data_science", "data_science", [r"\bdata[\s/-]*scientist\w*\b", r"\bdata[\s/-]+science\b"]), ("analytics", "analytics_bi", [r"\bdata[\s/-]+analyst\w*\b", r"\banalytics\b"])],
    adjacent=[("data_engineering", "data_engineering", [r"\bdata[\s/-]+engineer\w*\b"])],
    personal=[("sap", "SAP", [r"\bsap\b"])],
    scope=[("engineering_role", "engineering", [r"\bengineer\w*\b"]), ("training", "training", [r"\bbootcamp\b"])],
    unrelated=[("drivers", "driving", [r"\bfahrer(?:in)?\b"]), ("cooks", "hospitality", [r"\bkoch\b"])],
    study=[r"\bintern(?:ship)?\b", r"\btrainee\b"],
    keywords=["vertrieb", "call center"],
    stems=("vertrieb",),
    employers=["bad corp"],
    consulting=r"\bconsult\w*\b",
    implementation=r"\bcloud\b",
)


@pytest.mark.parametrize(
    ("title", "company", "outcome", "family"),
    [
        ("Senior Data Scientist (m/w/d)", "A", "target", "data_science"),
        ("Data Scientist", "Bad  Corp", "excluded", None),
        ("Data Analyst Vertriebssteuerung", "A", "excluded", None),
        ("Call-Center Analytics", "A", "excluded", None),
        ("Data Science Internship", "A", "excluded", None),
        ("Lecturer Data Science", "A", "excluded", None),
        ("Research Associate Analytics", "Universität X", "excluded", None),
        ("Research Associate Analytics", "A", "target", "analytics_bi"),
        ("SAP Data Analyst", "A", "excluded", None),
        ("Data Science Bootcamp", "A", "excluded", None),
        ("Cloud Consultant Analytics", "A", "excluded", None),
        ("Engineer Analytics", "A", "excluded", None),
        ("Data Engineer", "A", "unmatched", None),
        ("Fahrer Analytics", "A", "target", "analytics_bi"),
        ("Fahrerin", "A", "unrelated", None),
        ("Gardener", "A", "unmatched", None),
        (None, None, "unmatched", None),
    ],
)
def test_classification_order(spark, title, company, outcome, family):
    df = spark.createDataFrame([(1, title, company)], "job_id int, title string, company string")
    r = U.classify(df, SETS).first()
    assert (r.outcome, r.role_family) == (outcome, family)


def test_what_classification_tells(spark):
    want = {
        "SAP Data Analyst": ("sap", ["analytics", "sap"]),
        "Data Science Bootcamp": ("bootcamp", ["training"]),
        "Cloud Consultant Analytics": ("cloud", ["consulting_implementation"]),
        "Engineer Analytics": ("engineer", ["engineering_role"]),
        "Data Engineer": ("data engineer", ["data_engineering"]),
        "Fahrerin": ("driving", ["drivers"]),
        "Junior Data Scientists": ("data scientists", ["data_science"]),
        "Trainee": (r"\btrainee\b", ["study_role"]),
        "Client Advisor": ("retail", ["advisor"]),
    }
    sets = U.RuleSets(**{**SETS.__dict__, "at_employers": [(["shop ag"], ("advisor", "retail", [r"\bclient[\s/-]+advisor\b"]))]})
    df = spark.createDataFrame([(t, "Shop AG") for t in want] + [("Client Advisor", "Bank")], "title string, company string")
    got = U.classify(df, sets).collect()
    assert {r.title: (r.matched_value, r.matches) for r in got if r.company != "Bank"} == want
    assert [r.outcome for r in got if r.company == "Bank"] == ["unmatched"]


def test_blank_keywords_and_companies_match_nothing(spark):
    r = spark.createDataFrame([("Any title", "Any company")], "t string, c string").select(U.keyword_match(F.col("t"), ["", "  ", " any "]).alias("k"), U.company_match(F.col("c"), ["", " "]).alias("c")).first()
    assert (r.k, r.c) == ("any", None)


def test_apply_twice_records_nothing_new(spark):
    df = spark.createDataFrame([(1, "Fahrerin", "A", False, None), (2, "Data Scientist", "A", True, "rule"), (3, "Koch", "A", True, "Duplicate of 1"), (4, "Data Scientist", "A", True, "rule")], "job_id int, title string, company string, archived boolean, archived_reason string")
    hand = df.withColumn("hand", F.when(F.col("job_id") == 4, "archive"))
    c = U.classify(hand, SETS, manual="hand")
    dec = U.preview_decisions(c, reconcile_archive=True)
    assert {(r.job_id, r.decision_source, r.decision_action) for r in dec.collect()} == {(1, "rule", "archive"), (2, "rule", "restore"), (3, "system", "shadow"), (4, "manual", "archive")}
    state = c.select("job_id", F.when(F.col("archived"), F.lit(5)).alias("archived_at"), "archived_reason", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("role_family"))
    first = U.apply(state, dec.limit(0), c, dec, F.lit(9))
    assert {r.job_id: (r.archived_at, r.outcome) for r in first["state"].collect()} == {1: (9, "unrelated"), 2: (None, "target"), 3: (5, "unrelated"), 4: (5, "manual_archive")}
    assert first["counts"].first().asDict() == {"evaluated": 4, "archived": 1, "restored": 1, "recorded": 4}
    assert U.apply(first["state"], dec, c, dec, F.lit(10))["counts"].first().recorded == 0


def test_manual_outranks_rules_and_negatives_are_reported(spark):
    df = spark.createDataFrame([(1, "Fahrer Analytics", "A", None), (2, "Koch", "A", "keep"), (3, "Data Scientist", "A", "archive")], "job_id int, title string, company string, hand string")
    r = {x.job_id: x for x in U.classify(df, SETS, manual="hand").collect()}
    assert r[1].negative == ["drivers"] and r[1].positive == ["analytics"]
    assert (r[2].outcome, r[3].outcome) == ("manual_keep", "manual_archive")
    assert {x.job_id for x in U.decide(U.classify(df, SETS, manual="hand")).collect()} == {1}
    assert U.decide(U.classify(df, SETS), mode="shadow").filter("action = 'archive'").count() == 0


SEEN = "job_id int, run_id string, observed_at timestamp_ntz, arrival bigint, title string"


def test_upsert_is_idempotent_and_accepts_late_sightings(spark):
    from datetime import datetime as dt

    rows = [(1, "r1", dt(2024, 1, 5), 1, "a"), (1, "r1", dt(2024, 1, 6), 2, "b"), (2, "r1", dt(2024, 1, 5), 3, "c"), (1, "r2", dt(2023, 1, 1), 4, "late")]
    batch = spark.createDataFrame(rows, SEEN)
    state = spark.createDataFrame([], "job_id int, title string, first_seen timestamp_ntz, last_seen timestamp_ntz, seen_count bigint")
    seen = spark.createDataFrame([], "job_id int, run_id string, observed_at timestamp_ntz")
    once, new = S.upsert(state, seen, batch, ["title"])
    want = {(1, "late", dt(2023, 1, 1), dt(2024, 1, 5), 2), (2, "c", dt(2024, 1, 5), dt(2024, 1, 5), 1)}
    assert {tuple(r) for r in once.collect()} == want
    twice, again = S.upsert(once, new.select("job_id", "run_id", "observed_at"), batch, ["title"])
    assert {tuple(r) for r in twice.collect()} == want and again.count() == 0


def test_resolution_prefers_the_first_alias(spark):
    batch = spark.createDataFrame([(1, ["x", "b"]), (2, ["b", "a"]), (3, ["z"])], "arrival int, names array<string>")
    stored = spark.createDataFrame([(10, ["a"]), (20, ["b", "k"]), (15, ["b"])], "job_id int, names array<string>")
    assert {(r.arrival, r.job_id) for r in S.resolve(batch, stored).collect()} == {(1, 15), (2, 15)}


def test_overrides_ties_favour_decisions(spark):
    log = spark.createDataFrame([(1, "manual", "keep", 5, 9), (1, "manual", "archive", 5, 10), (2, "rule", "archive", 9, 11), (3, "manual", "shadow", 9, 12)], "job_id int, decision_source string, decision_action string, decided_at int, decision_id bigint")
    notes = spark.createDataFrame([(1, "interesting", 5), (2, "rejected", 1)], "job_id int, status string, noted_at int")
    assert {tuple(r) for r in D.manual_overrides(log, notes).collect()} == {(1, "archive"), (2, "archive")}


def test_consolidation_keeps_old_roots_and_short_texts_apart(spark):
    text = "long enough text " * 20
    schema = "job_id string, identity string, source string, title string, company string, text string, last_seen int, first_seen int, is_modern boolean"
    rows = [("a", "1", "s", "Role", "Co", text, 5, 5, True), ("b", "2", "s", "Role", "Co", text, 6, 6, True), ("c", "3", "s", "Role", "Co", "short", 1, 1, True), ("d", "3", "s", "Role", "Co", None, 2, 2, False), ("e", "4", "s", "jobs in Berlin", "Co", text, 1, 1, True)]
    keyed = C.role_keys(spark.createDataFrame(rows, schema))
    none = spark.createDataFrame([], "canonical_job_id string")
    first = {r.job_id: (r.canonical_job_id, r.reason) for r in C.canonical(keyed, none).collect()}
    assert first == {"a": ("a", "posting_id"), "b": ("a", "description"), "c": ("c", "posting_id"), "d": ("c", "posting_id")}
    sticky = {r.job_id: r.canonical_job_id for r in C.canonical(keyed, spark.createDataFrame([("b",)], "canonical_job_id string")).collect()}
    assert sticky["a"] == sticky["b"] == "b"


def test_overlap_needs_both_scopes(spark):
    m = spark.createDataFrame([(1, "cities"), (1, "countrywide"), (2, "cities"), (3, "countrywide")], "job_id int, scope string")
    r = P.overlap(m).first()
    assert (r.first_ids, r.second_ids, r.shared, r.first_only, r.second_only, r.second_covered) == (2, 2, 1, 1, 1, 50.0)
    assert P.overlap(m.filter("scope = 'cities'")).count() == 0


@pytest.mark.parametrize(("age", "status"), [(None, "empty"), (1, "fresh"), (2, "fresh"), (5, "aging"), (8, "stale")])
def test_freshness(spark, age, status):
    from datetime import datetime as dt
    from datetime import timedelta

    now = dt(2026, 9, 5, 12)
    seen = spark.createDataFrame([] if age is None else [(now - timedelta(days=age),)], "observed_at timestamp_ntz")
    assert R.freshness(seen, F.lit(now).cast("timestamp_ntz")).first().status == status


def test_search_folds_ascii_only_and_takes_wildcards_as_they_are(spark):
    df = spark.createDataFrame([("100% Remote", "MÜNCHEN", "x")], "title string, company string, location string").withColumn("is_archived", F.lit(False))
    hits = lambda s: df.filter(R.predicates(search=s)).count()
    assert hits("100% remote") == 1 and hits("1%e") == 0 and hits("mÜnchen") == 1 and hits("münchen") == 0


def test_page_sequence_stops(spark):
    cards = [("q", 0, i) for i in range(12)] + [("q", 10, i) for i in range(11, 23)] + [("q", 20, i) for i in range(11, 23)] + [("q", 30, i) for i in range(99)] + [("r", 0, 1), ("s", 0, None)]
    r = {x.query: (x.stop_offset, x.reason) for x in G.page_sequence(spark.createDataFrame(cards, "query string, offset int, id int")).collect()}
    assert r == {"q": (20, "repeated_page"), "r": (0, "short_page"), "s": (0, "empty_page")}


POSTING = """<html><head><title>Sign in</title><link rel="canonical" href="https://www.linkedin.com/jobs/view/data-analyst-{id}/?x=1"></head><body><div data-semaphore-content-urn="urn:li:jobPosting:{urn}"></div>
<h1 class="topcard__title a">Data &amp; BI</h1><section><div class="show-more-less-html__markup b"><p>One<br>two <b>bo</b>ld</p><ul><li>a&amp;b<li>c</ul><script>x("<p>")</script><button>More</button></div></section>
<ul><li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Karrierestufe</h3><span class="description__job-criteria-text"> Entry  level </span></li>
<li class="description__job-criteria-item"><h3 class="description__job-criteria-subheader">Pay</h3><span class="description__job-criteria-text">a lot</span></li></ul><aside>other</aside></body></html>"""
JSON_LD = """<title>Security Verification</title><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "identifier": {"value": "8"}, "description": 5}, {"@type": "JobPosting", "url": "https://x/jobs/view/9", "description": "<p>From JSON</p>"}]}</script>"""


def test_posting_pages(spark):
    pages = [(7, POSTING.format(id=7, urn=7)), (8, POSTING.format(id=7, urn=8)), (6, POSTING.format(id=6, urn=7)), (9, JSON_LD), (8, JSON_LD), (1, None), (2, "<p>x"), (3, "<div class=show-more-less-html__markup>no name"), (4, '<script type="application/ld+json">[1, {"@type": "JobPosting", "identifier": 4, "description": {}}, {broken</script>')]
    r = G.parse_pages(spark.createDataFrame(pages, "page_id bigint, html string"), r"/jobs/view/(?:[^/]*-)?([0-9]+)/?").collect()
    assert [x.error_kind for x in r] == [None, "identity_mismatch", "identity_mismatch", None, "blocked", "parse", "parse", "identity_mismatch", "parse"]
    assert (r[0].title, r[0].text, r[0].locator) == ("Data & BI", "One\ntwo bold\n• a&b\n• c", ".show-more-less-html__markup")
    assert [tuple(c) for c in r[0].criteria] == [("seniority", "Karrierestufe", "Entry level"), ("other", "Pay", "a lot")]
    assert (r[3].text, r[3].locator) == ("From JSON", "JobPosting.description")


def test_text_of_pages_equals_that_of_their_tree(spark):
    pages = ["<title>T</title><!-- a <p> -->A&lt;b&gt; &amp;lt; &#233;&nbsp;x<br/>y<P CLASS='a>b'>z<script>if (a<b) {}</script>q", "a\tb \r\n c<li><li>d", "<div title=\"x>y\">in</div>out<style>p{}", "", "<b>no</b>n-block", "<button>x</button><iframe>y</iframe>z", "1 < 2 and 3 > 2"]
    got = G.html_text(spark.createDataFrame(list(enumerate([*pages, None])), "page_id bigint, html string")).collect()
    assert [r.text for r in got] == [*(G.text_lines(G.tree(p)) for p in pages), None]


def test_result_cards(spark):
    html = """<div class="base-card"><a class="base-card__full-link" href=" /jobs/1 ">l</a><h3 class="base-search-card__title"> Data  Analyst </h3><h4 class="base-search-card__subtitle"><a>ACME</a></h4><span>x</span><span class="job-search-card__location">Zürich</span></div>
    <div class="base-card"><a href="/jobs/2"></a><h3>Other</h3></div>"""
    r = G.result_cards(spark.createDataFrame([(1, html), (2, "<li>no card"), (3, None), (4, "<div class='jobs-search__results-list'><li><h3>A</h3></li><p><li>deep</li></p></div>")], "page_id bigint, html string")).collect()
    assert [tuple(x) for x in r] == [(1, 0, "/jobs/1", "Data Analyst", "ACME", "Zürich"), (1, 1, "/jobs/2", "Other", "", ""), (4, 0, "", "A", "", "")]


def test_claims_against_their_schema(spark):
    import json

    from resight.operators import extraction as X

    ok = [{"source_ref": "description.1", "quote": "x"}]
    claims = {
        "education": [({"qualification": "BSc", "level": "bachelor", "fields_of_study": ["a"], "strength": "required", "condition": None, "alternative_group": None, "alternative_option": None, "evidence": ok}, []), ({"qualification": "", "level": "phd", "fields_of_study": "a", "strength": "required", "condition": 5, "alternative_group": "a", "alternative_option": None, "evidence": []}, ["alternative", "condition", "evidence", "fields_of_study", "level", "qualification"])],
        "language": [({"language": "German", "proficiency": None, "cefr": None, "strength": "mentioned", "condition": None, "alternative_group": None, "alternative_option": None, "evidence": ok}, []), ({"language": 5, "proficiency": None, "cefr": "D1", "strength": None, "condition": None, "alternative_group": None, "alternative_option": None, "evidence": [{"source_ref": "a", "quote": ""}], "x": 1}, ["cefr", "evidence", "language", "strength", "x"])],
        "description_language": [({"code": "de", "evidence": ok}, []), ({"code": "DE", "evidence": ok}, ["code"])],
        "conflict": [({"field": "education", "explanation": "x", "evidence": ok * 2}, []), ({"field": "other", "explanation": "x", "evidence": ok}, ["evidence", "field"])],
        "experience": [({"wording": "x", "years": {"kind": "exact"}, "scope": None, "strength": "unclear", "condition": None, "alternative_group": None, "alternative_option": None, "evidence": ok}, []), ({"wording": "x", "years": 5, "scope": None}, ["alternative_group", "alternative_option", "condition", "evidence", "strength", "years"])],
    }
    for kind, rows in claims.items():
        got = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(rows)], "i int, c string").select("i", X.check_json(F.col("c"), kind).alias("f")).orderBy("i").collect()
        assert [sorted({x.field for x in r.f}) for r in got] == [want for _, want in rows], kind
    assert [x.message for x in spark.createDataFrame([("[1]",)], "c string").select(X.check_json(F.col("c"), "claim").alias("f")).first().f][:1] == ["is no object"]


@pytest.mark.parametrize(
    ("quote", "text", "method", "span"),
    [
        ("Python skills", "🚀 Good Python skills.", "exact", (7, 20)),
        ("good  “python” skills", 'x Good "Python" skills', "typography", (2, 22)),
        ("• Reliable work", "We want reliable work", "typography", (8, 21)),
        ("we look for experianced engineers in Berlin", "x we look for experienced engineers in Berlin", "typo", (2, 45)),
        ("we look for preferred engineers in Berlin", "we look for preferded engineers in Berlin", None, None),
        ("not there", "text", None, None),
    ],
)
def test_evidence(spark, quote, text, method, span):
    q = spark.createDataFrame([(1, "r", quote)], "doc int, ref string, quote string")
    r = E.resolve(q, spark.createDataFrame([(1, "r", text)], "doc int, ref string, text string")).first()
    assert (r.method, (r.start, r.end) if r.method else None) == (method, span)


def test_evidence_in_the_only_other_line_of_the_family(spark):
    lines = [(1, "d.0", "first of all"), (1, "d.1", "The  Quick fox"), (1, "d.2", "twice said"), (1, "d.3", "twice said too"), (1, "e.0", "other kind"), (2, "d.0", "second document")]
    asked = [("d.0", "the quick", ("source_reference", 0, 10, "d.1")), ("d.9", "of all", ("source_reference", 6, 12, "d.0")), ("d.0", "twice said", (None, None, None, None)), ("d.0", "other kind", (None, None, None, None)), ("d.0", "second document", (None, None, None, None)), ("d.2", "twice", ("exact", 0, 5, "d.2"))]
    got = E.resolve(spark.createDataFrame([(1, r, q) for r, q, _ in asked] * 2, "doc int, ref string, quote string"), spark.createDataFrame(lines, "doc int, ref string, text string")).collect()
    assert len(got) == 12
    assert {(r.ref, r.quote): (r.method, r.start, r.end, r.source_ref) for r in got} == {(r, q): x for r, q, x in asked}
    assert {r.error for r in got if r.method is None} == {"not found"}


def test_worklist_fails_on_unknown_ids(spark):
    p = spark.createDataFrame([(1, None)], "job_id int, archived_at timestamp_ntz")
    none = p.select("job_id").limit(0)
    assert W.enqueue(p.select("job_id"), p, none, none).count() == 1
    with pytest.raises(Exception, match="unknown id"):
        W.enqueue(spark.createDataFrame([(5,)], "job_id int"), p, none, none).collect()


def test_versions_may_not_change_content(spark):
    from resight.sources.tables import save_versions

    old = spark.createDataFrame([(1, "v", "x")], "id int, version string, sha256 string")
    assert save_versions(old, old, ["id", "version"]).count() == 0
    with pytest.raises(Exception, match="content changed"):
        save_versions(old.withColumn("sha256", F.lit("y")), old, ["id", "version"]).collect()


@pytest.mark.parametrize(
    ("title", "outcome", "family"),
    [
        ("Werkstudent Data Science", "excluded", None),
        ("Bachelor of Science Data Science", "excluded", None),
        ("Bachelor-Absolvent als Data Analyst", "target", "analytics_bi"),
        ("Pflichtpraktikum Analytics", "excluded", None),
        ("(Senior) Data-Scientist:in", "target", "data_science"),
        ("Biostatistikerin", "target", "data_science"),
        ("Power BI Developer", "target", "analytics_bi"),
        ("Data / Business Analyst", "target", "analytics_bi"),
        ("Datenanalyst", "target", "analytics_bi"),
        ("Data Platform Engineer", "unmatched", None),
        ("AI Solutions Engineer", "unmatched", None),
        ("Analytics Engineer", "target", "analytics_bi"),
        ("Doktorandin Mathematik", "excluded", None),
        ("Gärtner", "unmatched", None),
    ],
)
def test_job_rules(spark, title, outcome, family):
    from resight.operators import job_rules as J

    sets = U.RuleSets(target=J.TARGET, adjacent=J.ADJACENT, study=J.STUDY)
    r = U.classify(spark.createDataFrame([(title, "A")], "title string, company string"), sets).first()
    assert (r.outcome, r.role_family) == (outcome, family)


def test_folding_of_quotes_keeps_places():
    import random
    import unicodedata

    rng = random.Random(9)
    bits = ["a", "B", " ", "  ", "\t", "\x1c", "e\u0301", "é", "ß", "ﬁ", "–", "“", "`", "\u00a0", "x", "-", "'", "东"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        folded, start, end = E.normalized(text)
        assert len(folded) == len(start) == len(end) and "  " not in folded
        for c, a, b in zip(folded, start, end, strict=True):
            piece = unicodedata.normalize("NFKC", text[a:b]).casefold()
            assert c in piece or c == " " and not piece.strip() or c in "-'"


def test_only_what_normal_form_can_change_goes_to_python(spark):
    import re
    import unicodedata

    from resight.functions import unicode as U

    settled = re.compile(f"[{U.SETTLED}]")
    inner = {int(x, 16) for i in range(0x110000) if (d := unicodedata.decomposition(chr(i))) and d[0] != "<" for x in d.split()[1:]}
    inner |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        assert not settled.match(c) or (unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and ord(c) not in inner), ascii(c)
    texts = ["Grüße – „Ну“ 東京", "étÉ ́x ậ", "각 각", "Å ̈́ क़", "İßͅΣς Ꭰ", "T̈ ẗ", "", None, "́"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for got, t in zip(df.select(U.composed(F.col("t")), U.case_folded(F.col("t"))).collect(), texts, strict=True):
        assert tuple(got) == ((None, None) if t is None else (unicodedata.normalize("NFC", t), unicodedata.normalize("NFC", t).casefold()))
    # a long text with one accent of its own: the text stays in Spark
    met = U.replaced(F.concat(F.repeat(F.lit("long \u00fc "), 1000), F.lit("A\u030a.")), f"[{U.SETTLED}]?[^{U.SETTLED}]++", lambda x: f"<{len(x)}>", F.lit(True))
    assert df.limit(1).select(met).first()[0] == "long \u00fc " * 1000 + "<2>."


def test_batches_are_python_objects_by_pieces(spark):
    import pyarrow as pa

    from resight.functions.batches import PIECE, by_rows

    read: list[int] = []
    run = by_rows(lambda i, t: read.append(i) or [(i, len(t))] * (i % 3), ["i"], [("n", pa.int64())])
    batch = pa.RecordBatch.from_pydict({"i": list(range(100)), "t": ["x" * (PIECE // 10)] * 100})
    out = run(iter([batch.slice(0, 0), batch]))
    first = next(out).num_rows
    assert len(read) < 20  # the rest of the batch is not read yet
    assert first + sum(b.num_rows for b in out) == sum(i % 3 for i in range(100)) and len(read) == 100


def test_only_character_references_go_to_python(spark):
    import html

    from resight.functions.unicode import replaced

    texts = ["&amp;&AMP&copy2 a & b &; &#65;&#x42 &#32;&notit; &unknown; &#xD800;&#0;", "&&amp", "none", "", None, "&ThickSpace;|", "&" + "a" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(G._unescaped(F.col("t"))).collect()] == [t and html.unescape(t) for t in texts]
    seen = df.limit(1).select(replaced(F.concat(F.repeat(F.lit("x"), 5000), F.lit("&amp;")), G._REFERENCE, lambda x: str(len(x)), F.lit(True)))
    assert seen.first()[0] == "x" * 5000 + "5"
