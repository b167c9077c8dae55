"""Rule files, and the index of literals against plain regular expressions."""

import re
import time

import pytest
from pyspark.sql import functions as F

from resight.operators import job_rules as J
from resight.operators import rules as U

SETS = J.job_rules()
RULES = {s: getattr(SETS, s) for s in ("target", "adjacent", "personal", "scope", "unrelated")}
PATTERNS = [p for rules in RULES.values() for _, _, ps in rules for p in ps] + SETS.study + SETS.academic


def test_the_files_hold_all_rules():
    assert {s: (len(r), sum(len(ps) for _, _, ps in r)) for s, r in RULES.items()} == {"target": (2, 24), "adjacent": (3, 11), "personal": (30, 74), "scope": (4, 33), "unrelated": (22, 166)}
    assert all(re.compile(p) for p in PATTERNS)


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\bsap\b", {"sap"}), (r"\b(?:chemistry|chemie\w*)\b", {"chemi"}), (r"\b(?:lab|office)[\s/-]+manager\b", {"manager"}), (r"a?(?:bcd)+", {"bcd"}), (r"(?:abc)?x", set()), (r"[abc]+", set()),
        (r"\b(?:it|cloud)[\s/-]+admin(?:istrator)?\b", {"admin"}), (r"(?<!business )\bdeveloper\w*\b", {"developer"}), (r"\bhr\b", {"hr"}), (r"(?:abc|d)", set()), (r"(?!abc)xyz", {"xyz"}),
    ],
)
def test_literals_that_a_match_must_hold(pattern, want):
    assert U.literals(pattern) == want


def test_every_match_holds_a_literal_of_its_pattern(spark):
    """Texts made from the patterns' own words: whatever a pattern matches, the index lets through."""
    words = sorted({w for p in PATTERNS for w in re.findall(r"[a-z]{2,}", p)})
    texts = [" ".join(x) for x in zip(words, words[1:] + words[:1], words[7:] + words[:7], strict=True)] + [f"{a}-{b}" for a, b in zip(words, words[3:], strict=False)] + words
    hits = 0
    for p in PATTERNS:
        some, rx = U.literals(p), re.compile(p)
        for t in texts:
            if rx.search(t):
                hits += 1
                assert not some or any(x in t for x in some), (p, t)
    assert hits > 800


def test_rules_have_their_first_pattern_only(spark):
    rules = [("a", "f", [r"\bone\b", r"\btwo\b"]), ("b", "g", [r"\w+ee\b", r"three"]), ("none", "n", ["zzz"]), ("c", "h", [r"\d", "one", "ones", "x", "y"])]
    df = spark.createDataFrame([("two one three ones 7",), ("ones",), ("",), (None,)], "t string")
    got = [[(x.rule, x.family, x.pattern, x.text) for x in r[0]] for r in df.select(U.all_matches(F.col("t"), rules)).collect()]
    assert got == [[("a", "f", r"\bone\b", "one"), ("b", "g", r"\w+ee\b", "three"), ("c", "h", r"\d", "7")], [("c", "h", "one", "one")], [], []]


def plain(text, patterns):
    return F.coalesce(*(F.when(text.rlike(p), F.lit(p)) for p in patterns), F.lit(None).cast("string"))


def test_same_patterns_as_one_after_the_other(spark):
    titles = ["Senior Data Scientist", "SAP Consultant", "Lagermitarbeiter", "Key User MES", "Head of Data", "Office-Manager", "admin it-landschaft", "Teamassistenz", "", None, "night audit", "FP & A", "L2 support", "x" * 500]
    df = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("f", U.folded(F.col("t")))
    for patterns in (PATTERNS[:150], PATTERNS[150:]):
        r = df.select(U.first_pattern(F.col("f"), patterns).alias("a"), plain(F.col("f"), patterns).alias("b")).collect()
        assert [x.a for x in r] == [x.b for x in r]


def test_the_index_is_faster(spark):
    """The unrelated set over 60,000 titles, with and without the index, each after a run to warm up."""
    patterns = [p for _, _, ps in SETS.unrelated for p in ps]
    df = spark.range(60_000, numPartitions=4).select(F.concat(F.lit("senior position number "), F.col("id").cast("string"), F.lit(" in the office of a firm")).alias("t")).cache()
    df.count()

    def seconds(found):
        began = time.perf_counter()
        df.select(found(F.col("t"), patterns).alias("x")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(U.first_pattern), seconds(plain)
    fast, slow = seconds(U.first_pattern), seconds(plain)
    print(f"rows a second: {60_000 / slow:.0f} one after the other, {60_000 / fast:.0f} with the index")
    assert fast < slow / 2
    df.unpersist()


@pytest.mark.parametrize(
    ("title", "outcome", "value"),
    [
        ("Chief Data Officer", "excluded", "chief data officer"), ("Data Analyst (VP office)", "target", "data analyst"), ("Principal Office Data Analyst", "target", "data analyst"), ("Pricing Data Analyst", "excluded", "pricing"), ("Machine Learning (NLP) Engineer", "excluded", "machine learning (nlp) engineer"),
        ("Data Engineer", "unmatched", "data engineer"), ("Elektrotechniker", "excluded", "elektrotechniker"), ("Data Analyst, open to former interns only", "excluded", None), ("Archived placeholder", "excluded", "archived placeholder"), ("Talent Pool Data Science", "excluded", "talent pool"),
        ("Mitarbeiter:in Lager", "unrelated", "operational_logistics"), ("Social Media Manager", "unrelated", "marketing_content"), ("Gärtner", "unrelated", "production_trades"), ("Gardener", "unmatched", None),
    ],
)
def test_titles(spark, title, outcome, value):
    r = U.classify(spark.createDataFrame([(title, "Co")], "title string, company string"), SETS).first()
    assert r.outcome == outcome and (value is None or r.matched_value == value)


def test_rules_survive_a_table(spark):
    back = U.rule_tables(J.rules_table(spark))
    assert {s: getattr(back, s) for s in RULES} == RULES and back.study == SETS.study and back.academic == SETS.academic
