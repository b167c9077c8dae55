"""Evidence offsets and typos by brute force; scope comparison by run; pages parsed again; freshness without sightings; summaries."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from resight.operators import evidence as E
from resight.operators import pages as G
from resight.operators import provenance as P
from resight.operators import reports as R

BITS = ["a", "B", " ", "  ", "\t", "é", "é", "ß", "ﬁ", "ﬁ́", "–", "“", "`", " ", "x", "'", "东"]


def test_folded_spans_lead_back_to_the_source(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(14))) for _ in range(150)] + ["", None, "plain text", "two  blanks"]
    s = E.folded_sources(spark.createDataFrame(list(enumerate(texts)), "doc int, text string"))
    ends = F.expr("sequence(0, length(folded) + 1)")
    spans = s.filter("folded IS NOT NULL").select("doc", "offsets", F.explode(ends).alias("a"), ends.alias("e")).select("doc", "offsets", "a", F.explode("e").alias("b"))
    got = {(r.doc, r.a, r.b): r.span and (r.span.start, r.span.end) for r in spans.select("doc", "a", "b", E.source_span(F.col("offsets"), F.col("a"), F.col("b")).alias("span")).collect()}
    assert len(got) > 1000
    for (doc, a, b), span in got.items():
        folded, start, end = E.normalized(texts[doc])
        assert span == ((start[a], end[b - 1]) if a < b <= len(folded) else None), (texts[doc], a, b)
    rows = {r.doc: r for r in s.collect()}
    assert rows[150].folded == "" and rows[150].offsets == [] and rows[151].folded is None and len(rows[152].offsets) == 1


def slow_typo(quote, source):
    """Every place of the text, word by word."""
    q, (folded, start, end) = E.normalized(quote)[0].split(), source
    if len(q) < 5:
        return None
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", folded)]
    found = []
    for i in range(len(words) - len(q) + 1):
        other = [folded[a:b] for a, b in words[i : i + len(q)]]
        odd = [(x, y) for x, y in zip(q, other, strict=True) if x != y]
        if len(odd) == 1 and len(odd[0][0]) >= 7 and not {*odd[0]} & E.QUALIFIERS and E._one_typo(*odd[0]):
            found.append((start[words[i][0]], end[words[i + len(q) - 1][1] - 1]))
    return found[0] if len(found) == 1 else None


def test_typos_are_found_as_by_a_look_at_every_place():
    rng = random.Random(8)
    pool = ["alphabet", "alphabeta", "alpahbet", "building", "buildng", "required", "reqired", "a", "bb", "of", "Straße"]
    hits = 0
    for _ in range(6000):
        text = rng.choice(["", " ", "  "]) + rng.choice([" ", "  "]).join(rng.choices(pool, k=rng.randrange(3, 14))) + rng.choice(["", " "])
        quote = " ".join(rng.choices(pool, k=rng.randrange(4, 7)))
        if rng.random() < 0.7 and len(text.split()) > 6:
            at = rng.randrange(len(text.split()) - 5)
            words = text.split()[at : at + 5]
            words[rng.randrange(5)] = rng.choice(pool)
            quote = " ".join(words)
        source = E.normalized(text)
        want = slow_typo(quote, source)
        hits += want is not None
        assert E._typo_span_in(quote, source) == want, (text, quote)
    assert hits > 50


def test_scopes_compared_by_run(spark):
    q = [("r1", "countrywide", "CH", 4, 3, 1), ("r1", "cities", "Bern", 2, 2, None), ("r1", "cities", "Chur", 0, 0, 0), ("r2", "cities", "Bern", 1, 1, 0), ("r3", "countrywide", "CH", 0, 0, 0), ("r3", "cities", "Bern", 0, 0, 0), (None, "cities", "Bern", 1, 1, 0)]
    queries = spark.createDataFrame(q, "run_id string, scope string, location string, pages_attempted int, pages_completed int, failures int")
    m = [("r1", 1, "countrywide", "CH"), ("r1", 1, "cities", "Bern"), ("r1", 1, "cities", "Bern"), ("r1", 2, "cities", "Bern"), ("r1", 3, "countrywide", "CH"), ("r1", 4, None, "Rom"), ("r1", None, "cities", "Bern"), ("r2", 1, "cities", "Bern")]
    matches = spark.createDataFrame(m, "run_id string, job_id int, scope string, location string")
    got = {r.run_id: r.comparison for r in P.comparisons(queries, matches).collect()}
    assert set(got) == {"r1", "r3"}  # the runs that searched both
    c = got["r1"]
    assert (c.first.queries, c.first.pages_attempted, c.first.failures, c.first.ids, c.first.completion) == (1, 4, 1, 2, 75.0)
    assert (c.second.queries, c.second.failures, c.second.ids, c.shared, c.first_only, c.second_only, c.second_covered) == (2, 0, 2, 1, 1, 1, 50.0)
    assert [tuple(p) for p in c.places] == [("Bern", 2, 1, 1), ("Chur", 0, 0, 0)]
    empty = got["r3"]
    assert (empty.shared, empty.second_covered, empty.first.completion) == (0, 0.0, 0.0) and [tuple(p) for p in empty.places] == [("Bern", 0, 0, 0)]
    runs = spark.createDataFrame([("r1",), ("r2",), ("r0",)], "run_id string")
    metrics = spark.createDataFrame([("r1", "new", 3)], "run_id string, key string, total bigint")
    reports = queries.select("run_id", "pages_attempted", "pages_completed", F.lit(1).alias("valid_jobs"), F.lit("blocked").alias("stop_reason"))
    listed = R.run_list(runs, metrics, reports, 2, ["blocked"], queries=queries, matches=matches).collect()
    assert [(r.run_id, r.comparison is None) for r in listed] == [("r2", True), ("r1", False)]
    assert P.comparisons(queries.limit(0), matches.limit(0)).count() == 0


PAGE = '<link rel="canonical" href="https://x/jobs/{0}"><h1>T</h1><article>{1}</article>'
PLACES = {"content": ["article"], "title": ["h1"]}


def test_pages_are_parsed_again_under_a_version(spark):
    def snapshots(*rows):
        return spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "page_id int, body binary")

    parse = lambda s, saved, v="v1": G.reparse(s, saved, v, r"/jobs/(\d+)", where=PLACES)
    none = spark.createDataFrame([], "page_id int, source_sha256 string, version string, sha256 string")
    body = PAGE.format(1, "one").encode()
    s = snapshots((1, body), (1, body), (1, PAGE.format(1, "two").encode()), (2, PAGE.format(2, "caf").encode() + b"\xff"), (3, None), (4, body))
    first = parse(s, none)
    rows = first.collect()
    assert sorted((r.page_id, r.text, r.error_kind) for r in rows if r.error_kind is None) == [(1, "one", None), (1, "two", None), (2, "caf", None)]
    assert sorted(r.page_id for r in rows if r.error_kind) == [3, 4]
    assert parse(s, first).count() == 0  # again: nothing new
    assert parse(s, first, "v2").count() == len(rows)
    changed = first.withColumn("sha256", F.when(F.col("page_id") == 1, "other").otherwise(F.col("sha256")))
    with pytest.raises(Exception, match="content changed"):
        parse(s, changed).collect()
    assert parse(snapshots(), first).count() == 0


def test_freshness_falls_back_to_active_roles(spark):
    now = F.lit("2024-03-10").cast("timestamp_ntz")
    seen = spark.createDataFrame([(datetime(2024, 3, 9),), (None,)], "observed_at timestamp_ntz")
    roles = spark.createDataFrame([(datetime(2024, 3, 1), None, False), (None, datetime(2024, 3, 4), False), (datetime(2024, 3, 10), None, True)], "last_seen timestamp_ntz, created_at timestamp_ntz, is_archived boolean")
    get = lambda *a, **k: tuple(R.freshness(*a, **k).first())[1:]
    assert get(seen, now, roles=roles) == (1, "fresh", "observation")
    assert get(seen.limit(0), now, roles=roles) == (6, "aging", "record")
    assert get(seen.limit(0), now, roles=roles.filter("is_archived")) == (None, "empty", None)


def test_summaries_read_roles_and_matches_once(spark, tmp_path):
    kind = "job_id int, source string, company string, location string, role_family string, seen_count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz, is_archived boolean, is_favorite boolean, outcome string"
    old, new = datetime(2024, 1, 1), datetime(2024, 3, 9)
    rows = [(1, "s", "A", "Bern, CH", None, 3, old, new, False, True, "target"), (2, "s", None, None, "bi", 1, new, new, False, False, None), (3, "s", "A", "Bern", "bi", 9, old, old, True, False, None), (4, "s", "B", "Bern", "bi", 2, old, None, False, None, None)]
    roles = spark.createDataFrame(rows, kind)
    matches = spark.createDataFrame([(1, "g"), (1, "g"), (1, "h"), (3, "g")], "job_id int, query_group string")
    out = R.summaries(roles, matches, F.lit("2024-03-10").cast("timestamp_ntz"), {"all": None, "7d": 7, "none": 0})
    got = {(r.window, r.section, r.name): r["count"] for r in out.collect()}
    assert got["all", "totals", "total"] == 3 and got["7d", "totals", "total"] == 2 and got["7d", "totals", "new"] == 1
    assert got["all", "review", "archived"] == 1 and got["7d", "review", "favorite"] == 1 and ("7d", "review", "archived") not in got
    assert got["all", "query_group", "g"] == 1 and got["all", "recurring", "1"] == 3 and got["all", "freshness", "fresh"] == 1
    assert [k for k in got if k[0] == "none"] == [("none", "freshness", "empty")] and got["none", "freshness", "empty"] is None
    assert out._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == 2  # both of the frame that was written
