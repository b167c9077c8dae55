"""Explainable classification by ordered rule sets.

Rules are data: lists of (rule, family, patterns), or a table of them.  They compile to literal column expressions, in which the first pattern
in order wins whatever its place in the text.  An index of literals, taken from the patterns themselves, says which of them a text can meet at all: only those
are tried as regular expressions.
"""

from __future__ import annotations

import re
import re._parser as parser  # the tree of a pattern
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import folded

Rule = tuple[str, str, list[str]]

# Title patterns of academic posts, and words of employers that make a research title one.
ACADEMIC = [
    r"\bpost[\s-]?doc(?:toral)?\b", r"\bprofessor(?:in)?\b", r"\bjuniorprofessor(?:in)?\b", r"\b(?:junior)?professur\b", r"\blecturer\b", r"\bacademic researcher\b",
    r"\bscientific[\s/-]+employee\b", r"\bresearch fellow\b", r"\bdoktorand(?:in)?\b", r"\bwissenschaftlich\w*(?:[*/:_-]+[a-z]+|\([a-z]+\))?\s+mitarbeiter\w*\b",
    r"\bwiss\.?\s+(?:ma|mitarbeit\w*)\b", r"\bwissenschaftlich\w*\s+(?:position|postition)\w*\b", r"\bforschungsassistenz\w*\b",
]
RESEARCH_TITLE = r"\bresearch[\s/-]+(?:assistant|associate)\b"
UNIVERSITY = r"\b(?:\w*universitat|\w*universitaet|university|hochschule|college|faculty|unsw|leibniz)\b"
RESEARCH_VALUE = "academic_company:research_assistant"
# Filter names of decisions by outcome.
FILTERS = {"excluded": "scope_exclusion", "target": "target_role", "unrelated": "unrelated_role", "unmatched": "no_target_role"}


@dataclass
class RuleSets:
    """What classify() asks in turn."""

    target: list[Rule] = field(default_factory=list)
    adjacent: list[Rule] = field(default_factory=list)
    personal: list[Rule] = field(default_factory=list)
    scope: list[Rule] = field(default_factory=list)
    unrelated: list[Rule] = field(default_factory=list)
    study: list[str] = field(default_factory=list)
    academic: list[str] = field(default_factory=lambda: list(ACADEMIC))
    keywords: list[str] = field(default_factory=list)
    stems: tuple[str, ...] = ()
    employers: list[str] = field(default_factory=list)
    #: Unrelated rules that hold for some employers only: (employers, rule).
    at_employers: list[tuple[list[str], Rule]] = field(default_factory=list)
    consulting: str | None = None
    implementation: str | None = None
    engineering: str = "engineering_role"
    version: str = "1"


def in_table(spark: SparkSession, sets: dict[str, list[Rule]]) -> DataFrame:
    """Rule sets as a table (set, rule_pos, rule, family, pat_pos, pattern), which rule_table() reads back."""
    rows = [(s, i, rule, family, j, p) for s, rules in sets.items() for i, (rule, family, patterns) in enumerate(rules) for j, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "set string, rule_pos int, rule string, family string, pat_pos int, pattern string")


def rule_table(df: DataFrame) -> dict[str, list[Rule]]:
    """Rule sets from a table (set, rule_pos, rule, family, pat_pos, pattern): a rule file is small and comes to the driver."""
    out: dict[str, dict] = {}
    for r in df.orderBy("set", "rule_pos", "pat_pos").collect():
        out.setdefault(r["set"], {}).setdefault((r["rule_pos"], r["rule"], r["family"]), []).append(r["pattern"])
    return {s: [(rule, family, pats) for (_, rule, family), pats in rules.items()] for s, rules in out.items()}


def rule_tables(rules: DataFrame) -> RuleSets:
    """The rule sets that classify() asks, from a table as rule_table() reads it; sets study and academic are lists of patterns."""
    found = rule_table(rules)
    lists = {s: [p for _, _, pats in found[s] for p in pats] for s in ("study", "academic") if s in found}
    return RuleSets(**{s: found[s] for s in ("target", "adjacent", "personal", "scope", "unrelated") if s in found}, **lists)


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


#: Literals of a pattern shorter than that say too little.
SHORTEST_LITERAL = 2
#: Lists of so many patterns and more are asked through the index.
INDEXED = 8


def _best(found: list[frozenset[str]]) -> frozenset[str]:
    """Of several requirements that all hold, the one that says most: its shortest literal is longest."""
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=frozenset())


def _required(items) -> frozenset[str]:
    """Literals of which a match of a parsed sequence holds at least one; empty where nothing is sure."""
    run, found = "", []
    for kind, value in items:
        if kind == parser.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
        run = ""
        if kind == parser.SUBPATTERN:
            inner = _required(value[-1])
        elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            inner = _required(value[2])
        elif kind == parser.BRANCH:
            each = [_required(x) for x in value[1]]
            inner = frozenset().union(*each) if all(each) else frozenset()
        else:
            inner = frozenset()
        if inner:
            found.append(inner)
    return _best([*found, frozenset([run])] if run else found)


@lru_cache(maxsize=4096)
def literals(pattern: str) -> frozenset[str]:
    """Literals of which every match of the pattern holds one; empty if there are none that are worth a look."""
    found = _required(parser.parse(pattern))
    return found if found and min(map(len, found)) >= SHORTEST_LITERAL else frozenset()


def _branches(words: set[str]) -> str:
    """A regular expression for the longest of the words that stands at a place."""
    by: dict[str, set[str]] = {}
    for w in words:
        by.setdefault(w[:1], set()).add(w[1:])
    inner = [re.escape(c) + _branches(rest) for c, rest in sorted(by.items()) if c]
    if not inner or (len(inner) == 1 and "" not in by):
        return "".join(inner)
    return f"(?:{'|'.join(inner)})" + ("?" if "" in by else "")


def candidates(text: Column, patterns: list[str]) -> Column:
    """The numbers of the patterns that a text can meet, in order: one pass looks up, at each place, the literals that stand there.

    The index is a tree of all literals as one expression, and for the longest at a place the patterns that need it or a beginning of it.  Patterns
    that need none are always among the candidates; a null text has none.
    """
    needs = [literals(p) for p in patterns]
    known = set().union(*needs)
    always = F.array(*(F.lit(i) for i, n in enumerate(needs) if not n)).cast("array<int>")
    if not known:
        return F.when(text.isNotNull(), always)
    of = {x: [i for i, n in enumerate(needs) if any(x.startswith(y) for y in n)] for x in sorted(known)}
    index = F.create_map(*(c for x, ids in of.items() for c in (F.lit(x), F.array(*map(F.lit, ids)))))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_branches(known)}))"), F.lit(1)))
    return F.array_sort(F.array_distinct(F.concat(always, F.flatten(F.transform(found, lambda x: F.try_element_at(index, x))))))


def _met(text: Column, patterns: list[str]) -> Column:
    """The numbers of the patterns that a text meets, in order."""
    every = F.array(*map(F.lit, patterns))
    return F.filter(candidates(text, patterns), lambda i: F.rlike(text, F.get(every, i)))


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """The first pattern, in the order of the list, that is found; null if none is."""
    if len(patterns) < INDEXED:
        return F.coalesce(*(F.when(text.rlike(p), F.lit(p)) for p in patterns), _none())
    return F.get(F.array(*map(F.lit, patterns)), F.get(_met(text, patterns), F.lit(0)))


def keyword_pattern(keyword: str, stems: tuple[str, ...] = ()) -> str:
    """Stems by substring, phrases with any separators, single words whole."""
    if keyword in stems:
        return re.escape(keyword)
    words = [re.escape(w) for w in keyword.split()]
    return rf"(?<!\w){r'[\s/-]+'.join(words)}(?!\w)" if len(words) > 1 else rf"\b{''.join(words)}\b"


def keyword_match(title: Column, keywords: list[str], stems: tuple[str, ...] = ()) -> Column:
    """The first configured keyword that a folded title holds; blank ones are passed over."""
    t = folded(title)
    return F.coalesce(*(F.when(t.rlike(keyword_pattern(k, stems)), F.lit(k)) for k in (k.strip() for k in keywords if k) if k), _none())


def company_match(company: Column, tokens: list[str]) -> Column:
    """The first token that a folded company name contains; blank ones are passed over."""
    c = folded(company)
    return F.coalesce(*(F.when(c.contains(t), F.lit(t)) for t in tokens if t and t.strip()), _none())


def academic_match(title: Column, company: Column, patterns: list[str]) -> Column:
    """The first academic pattern, or RESEARCH_VALUE for a research title at a university-like company."""
    t = folded(title)
    return F.coalesce(first_pattern(t, patterns), F.when(t.rlike(RESEARCH_TITLE) & folded(company).rlike(UNIVERSITY), F.lit(RESEARCH_VALUE)))


_MATCH = "struct<rule:string,family:string,pattern:string,text:string>"


def all_matches(text: Column, rules: list[Rule]) -> Column:
    """Array of (rule, family, pattern, text): for each rule that matches, its first pattern and what it found, in rule order."""
    flat = [(rule, family, p, k) for k, (rule, family, patterns) in enumerate(rules) for p in patterns]
    none = F.expr(f"cast(array() AS array<{_MATCH}>)")
    if not flat:
        return none
    if len(flat) < INDEXED:

        def found(rule: str, family: str, patterns: list[str]) -> Column:
            fits = (F.when(text.rlike(p), F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"), F.lit(p).alias("pattern"), F.regexp_extract(text, p, 0).alias("text"))) for p in patterns)
            return F.coalesce(*fits, _none(_MATCH))

        return F.filter(F.array(*(found(*r) for r in rules)), lambda x: x.isNotNull())
    every = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(family).alias("family"), F.lit(p).alias("pattern"), F.lit(k).alias("nth")) for rule, family, p, k in flat))
    met = F.transform(_met(text, [p for _, _, p, _ in flat]), lambda i: F.get(every, i))
    # of a rule's patterns, which stand together, the first
    first = F.aggregate(met, F.slice(every, 1, 0), lambda out, x: F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["nth"] == x["nth"]), out).otherwise(F.concat(out, F.array(x))))
    return F.coalesce(F.transform(first, lambda x: F.struct(x["rule"].alias("rule"), x["family"].alias("family"), x["pattern"].alias("pattern"), F.regexp_extract_all(text, x["pattern"], F.lit(0))[0].alias("text"))), none)


def classify(df: DataFrame, sets: RuleSets, *, title: str = "title", company: str = "company", manual: str | None = None) -> DataFrame:
    """df with outcome, role_family, matched_value, reason, matches, positive, negative and ruleset_version.

    In order: manual keep, manual archive, excluded employer, keyword, study, academic, personal, scope but for engineering,
    consulting that implements and is not adjacent, engineering that is not adjacent, target, adjacent (unmatched, with a reason),
    unrelated (its value is the family), unmatched.  Only targets have a role family.  matched_value is the text that was
    found, matches the names of the rules behind the outcome.  Each different (title, company) is classified once and joined back.
    """
    pair = df.select(F.col(title).alias("_t"), F.col(company).alias("_c")).distinct()
    first = pair.withColumn("t", folded(F.col("_t"))).withColumn("c", folded(F.col("_c")))
    for name in ("target", "adjacent", "personal", "scope", "unrelated"):  # a step each: small generated code
        first = first.withColumn(name, all_matches(F.col("t"), getattr(sets, name)))
    for employers, rule in sets.at_employers:
        first = first.withColumn("unrelated", F.when(F.col("c").isin(employers), F.concat("unrelated", all_matches(F.col("t"), [rule]))).otherwise(F.col("unrelated")))
    first = first.withColumn("keyword", keyword_match(F.col("_t"), sets.keywords, sets.stems))
    first = first.withColumn("study", first_pattern(F.col("t"), sets.study)).withColumn("academic", academic_match(F.col("_t"), F.col("_c"), sets.academic))
    asked = bool(sets.consulting and sets.implementation)
    consults = F.col("t").rlike(sets.consulting) & F.col("t").rlike(sets.implementation) if asked else F.lit(False)
    implements = F.regexp_extract("t", sets.implementation, 0) if asked else _none()
    inside = F.filter("scope", lambda x: x["rule"] == sets.engineering)
    outside = F.filter("scope", lambda x: x["rule"] != sets.engineering)
    names = lambda *c: F.transform(F.concat(*c), lambda x: x["rule"])
    top = lambda c, what: F.get(c, F.lit(0))[what]
    none, label = F.expr("cast(array() AS array<string>)"), lambda x: F.array(F.lit(x))

    def says(outcome: str, value: Column, reason: Column | str, positive: Column = none, negative: Column = none, family: Column | None = None, matches: Column | None = None) -> Column:
        told = F.lit(reason) if isinstance(reason, str) else reason
        every = F.concat(positive, negative) if matches is None else matches
        cols = {"outcome": F.lit(outcome), "role_family": _none() if family is None else family, "matched_value": value, "reason": told, "matches": every, "positive": positive, "negative": negative}
        return F.struct(*(c.alias(n) for n, c in cols.items()))

    def because(words: str, what: Column) -> Column:
        return F.concat(F.lit(words), what)

    shown = lambda c: F.replace(top(c, "family"), F.lit("_"), F.lit(" "))
    personal, target, adjacent, unrelated = (F.col(c) for c in ("personal", "target", "adjacent", "unrelated"))
    chain = [
        (F.col("c").isin(sets.employers or [""]) & (F.col("c") != ""), says("excluded", F.col("_c"), because("excluded employer: ", F.col("_c")), negative=label("personal_academic_employer"))),
        (F.col("keyword").isNotNull(), says("excluded", F.col("keyword"), because("unwanted keyword: ", F.col("keyword")))),
        (F.col("study").isNotNull(), says("excluded", F.col("study"), "study or trainee title", negative=label("study_role"))),
        (F.col("academic").isNotNull(), says("excluded", F.col("academic"), "academic title", negative=label("academic_role"))),
        (F.size(personal) > 0, says("excluded", top(personal, "text"), because("personal exclusion: ", top(personal, "family")), names(target), names(personal))),
        (F.size(outside) > 0, says("excluded", top(outside, "text"), because("outside the scope: ", shown(outside)), negative=names(outside))),
        (consults & (F.size(adjacent) == 0), says("excluded", implements, because("implementation consulting: ", implements), negative=label("consulting_implementation"))),
        ((F.size(inside) > 0) & (F.size(adjacent) == 0), says("excluded", top(inside, "text"), because("engineering: ", top(inside, "text")), negative=names(inside))),
        (F.size(target) > 0, says("target", top(target, "text"), because("kept as ", shown(target)), names(target), names(unrelated), top(target, "family"))),
        (F.size(adjacent) > 0, says("unmatched", top(adjacent, "text"), because("adjacent: ", shown(adjacent)), matches=names(adjacent))),
        (F.size(unrelated) > 0, says("unrelated", top(unrelated, "family"), because("unrelated: ", shown(unrelated)), negative=names(unrelated))),
    ]
    found = says("unmatched", _none(), "no rule")
    for condition, result in reversed(chain):
        found = F.when(condition, result).otherwise(found)
    first = first.select("_t", "_c", found.alias("r"))
    out = df.join(first, df[title].eqNullSafe(first["_t"]) & df[company].eqNullSafe(first["_c"]), "left").drop("_t", "_c")
    if manual:
        hand = F.col(manual)
        out = out.withColumn("r", F.when(hand == "keep", says("manual_keep", F.lit("manual"), "kept by hand")).when(hand == "archive", says("manual_archive", F.lit("manual"), "archived by hand")).otherwise(F.col("r")))
    return out.select(*df.columns, "r.*", F.lit(sets.version).alias("ruleset_version"))


def _details(df: DataFrame) -> Column:
    return F.to_json(F.struct("outcome", "role_family", "ruleset_version", "matches", "positive", "negative"))


def _by_outcome(names: dict[str, str]) -> Column:
    out = _none()
    for outcome, name in names.items():
        out = F.when(F.col("outcome") == outcome, name).otherwise(out)
    return out


def decide(df: DataFrame, *, mode: str = "enforce", include_unmatched: bool = False) -> DataFrame:
    """A decision for each classified row that was not decided by hand: action, filter_name and details as JSON."""
    archive = F.col("outcome").isin("excluded", "unrelated") | (F.lit(include_unmatched) & (F.col("outcome") == "unmatched"))
    action = F.when(F.lit(mode == "enforce") & archive, "archive").when(F.col("outcome") == "target", "keep").otherwise("shadow")
    rest = df.filter(~F.col("outcome").isin("manual_keep", "manual_archive"))
    return rest.withColumn("action", action).withColumn("filter_name", _by_outcome(FILTERS)).withColumn("details", _details(df))


def prefilter_decisions(df: DataFrame, overrides: DataFrame, sets: RuleSets, blocked: list[str], *, id_col: str = "job_id", title: str = "title", company: str = "company") -> DataFrame:
    """Up to three archive decisions a row (keyword, company, study or else academic), none for rows decided by hand."""
    study = first_pattern(folded(F.col(title)), sets.study)
    tries = F.array(
        F.struct(F.lit("title_keyword").alias("filter_name"), keyword_match(F.col(title), sets.keywords, sets.stems).alias("value")),
        F.struct(F.lit("company").alias("filter_name"), company_match(F.col(company), blocked).alias("value")),
        F.struct(F.when(study.isNotNull(), "study_title").otherwise("academic_title").alias("filter_name"), F.coalesce(study, academic_match(F.col(title), F.col(company), sets.academic)).alias("value")),
    )
    rest = df.join(overrides.select(id_col), id_col, "left_anti")
    return rest.select(id_col, F.explode(F.filter(tries, lambda x: x["value"].isNotNull())).alias("d")).select(id_col, "d.filter_name", "d.value", F.lit("archive").alias("action"))


def collection_decisions(df: DataFrame, overrides: DataFrame, sets: RuleSets, blocked: list[str], run_id: Column, *, id_col: str = "job_id", title: str = "title", company: str = "company") -> DataFrame:
    """(id, filter_name, action, run_id) of a collected batch: prefilters' archives; rule decisions of the rows that these leave; and for rows that
    stand archived by hand (overrides: id, action) that archive again."""
    pre = prefilter_decisions(df, overrides, sets, blocked, id_col=id_col, title=title, company=company)
    hand = overrides.select(id_col, F.col("action").alias("_hand"))
    rest = df.join(pre.select(id_col).distinct().hint("shuffle_hash"), id_col, "left_anti").join(hand, id_col, "left")
    found = classify(rest, sets, title=title, company=company, manual="_hand")
    ruled = decide(found).select(id_col, "filter_name", "action")
    standing = found.filter("outcome = 'manual_archive'").select(id_col, F.lit("manual_archive_enforced").alias("filter_name"), F.lit("archive").alias("action"))
    return pre.select(id_col, "filter_name", "action").unionByName(ruled).unionByName(standing).withColumn("run_id", run_id)


def run_metrics(classified: DataFrame) -> DataFrame:
    """Counts by outcome, yield and contamination in percent (half-even), rows with both kinds of matches."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    count = lambda o: F.count_if(F.col("outcome") == o)
    return classified.agg(
        F.count(F.lit(1)).alias("total"),
        *(count(o).alias(o) for o in ("target", "excluded", "unrelated", "unmatched")),
        F.bround(100.0 * count("target") / n, 1).alias("target_yield"),
        F.bround(100.0 * (count("excluded") + count("unrelated")) / n, 1).alias("contamination"),
        F.count_if((F.size("positive") > 0) & (F.size("negative") > 0)).alias("conflicts"),
    )


def archives_by_filter(decided: DataFrame) -> DataFrame:
    """(filter_name, archives)"""
    return decided.filter("action = 'archive'").groupBy("filter_name").agg(F.count(F.lit(1)).alias("archives"))


def examples(classified: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group."""
    from pyspark.sql import Window

    return classified.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("nth") <= n)


def preview_decisions(classified: DataFrame, *, include_unmatched: bool = False, reconcile_archive: bool = False, batch_id: str = "preview") -> DataFrame:
    """Decisions that applying the classification would record, for stored rows (archived, archived_reason, ... as classify() gives them).

    (job columns, decision_source, decision_action, filter_name, matched_value, reason, batch_id).  Excluded rows are archived, hand-made archives are
    enforced.  When the archive is reconciled, archived rows are restored where kept by hand, a target or unmatched; those
    archived as duplicates stay.  All others follow decide(); rows kept by hand have no decision.
    """
    outcome, was = F.col("outcome"), F.col("archived") & F.lit(reconcile_archive)
    archive = outcome.isin("excluded", "unrelated") | (F.lit(include_unmatched) & (outcome == "unmatched"))
    say = lambda source, action, name, value: F.struct(F.lit(source).alias("decision_source"), action.alias("decision_action"), name.alias("filter_name"), value.alias("matched_value"))
    value, plain = F.col("matched_value"), F.when(archive, "archive").when(outcome == "target", "keep").otherwise("shadow")
    chosen = (
        F.when(outcome == "excluded", say("rule", F.lit("archive"), F.lit(FILTERS["excluded"]), value))
        .when(outcome == "manual_archive", say("manual", F.lit("archive"), F.lit("manual_archive_enforced"), F.lit("manual")))
        .when(was & (outcome == "manual_keep"), say("manual", F.lit("restore"), F.lit("manual_keep_enforced"), F.lit("manual_keep")))
        .when(was & F.lower("archived_reason").startswith("duplicate"), say("system", F.lit("shadow"), F.lit("system_archive_preserved"), F.lit("duplicate")))
        .when(was & outcome.isin("target", "unmatched"), say("rule", F.lit("restore"), F.lit("relevance_reconcile"), F.coalesce("role_family", "outcome")))
        .when(outcome != "manual_keep", say("rule", plain, _by_outcome(FILTERS), value))
    )
    out = classified.withColumn("_d", chosen).filter("_d IS NOT NULL")
    return out.select(*classified.columns[: classified.columns.index("outcome")], "_d.*", "reason", F.lit(batch_id).alias("batch_id"))


def preview(classified: DataFrame, decisions: DataFrame, *order: Column, id_col: str = "job_id", title: str = "title", company: str = "company") -> dict[str, DataFrame]:
    """What applying would do, as tables: totals, counts, examples, rule_examples, conflicts and overrides.

    totals: one row of total, active and archived now, would_archive, would_restore, and active and archived then.  counts: (section, name, n)
    by outcome, role family and unrelated family.  examples: the first 8 of each outcome in the order; rule_examples: the first 5 of each rule.
    """
    acts = decisions.groupBy(id_col).agg(F.bool_or(F.col("decision_action") == "archive").alias("_a"), F.bool_or(F.col("decision_action") == "restore").alias("_r"))
    joined = classified.join(acts, id_col, "left")
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    total = joined.agg(
        F.count(F.lit(1)).alias("total"), count(~F.col("archived")).alias("active"), count(F.col("archived")).alias("archived"),
        count(~F.col("archived") & F.col("_a")).alias("would_archive"), count(F.col("archived") & F.col("_r")).alias("would_restore"),
    )
    total = total.withColumn("final_active", F.expr("active - would_archive + would_restore")).withColumn("final_archived", F.expr("archived + would_archive - would_restore"))
    sections = F.array(
        F.struct(F.lit("outcome").alias("section"), F.col("outcome").alias("name")),
        F.struct(F.lit("family").alias("section"), F.col("role_family").alias("name")),
        F.struct(F.lit("unrelated").alias("section"), F.when(F.col("outcome") == "unrelated", F.col("matched_value")).alias("name")),
    )
    counts = classified.select(F.explode(sections).alias("x")).filter("x.name IS NOT NULL").groupBy("x.section", "x.name").agg(F.count(F.lit(1)).alias("n"))
    by_rule = classified.select(*classified.columns, F.explode("matches").alias("rule"))
    both = (F.size("positive") > 0) & (F.size("negative") > 0)
    return {
        "totals": total,
        "counts": counts,
        "examples": examples(classified, "outcome", 8, *order).select("outcome", "nth", title, company),
        "rule_examples": examples(by_rule, "rule", 5, *order).select("rule", "nth", title, company),
        "conflicts": classified.filter(both).select(id_col, title, company, "positive", "negative", F.col("outcome").alias("resolved_as")),
        "overrides": classified.filter(F.col("outcome").startswith("manual_")).select(id_col, title, company, F.substring("outcome", 8, 20).alias("action")),
    }


def apply(state: DataFrame, log: DataFrame, classified: DataFrame, decisions: DataFrame, at: Column, *, id_col: str = "job_id") -> dict[str, DataFrame]:
    """New state and decisions to append after a preview: evaluations saved, decisions that the log has already left out, active rows
    archived, archived ones restored; and counts of the four.

    state has archived_at, archived_reason, outcome, role_family; the log id_col, filter_name, decision_action and batch_id.
    """
    keys = [id_col, "filter_name", "decision_action", "batch_id"]
    new = decisions.dropDuplicates(keys).join(log.select(*keys).distinct(), keys, "left_anti").withColumn("decided_at", at)
    acts = decisions.groupBy(id_col).agg(
        F.max(F.when(F.col("decision_action") == "archive", F.coalesce("reason", "filter_name"))).alias("_reason"), F.bool_or(F.col("decision_action") == "restore").alias("_restore")
    )
    rest = [c for c in state.columns if c not in ("archived_at", "archived_reason", "outcome", "role_family")]
    s = state.join(classified.select(id_col, F.col("outcome").alias("_outcome"), F.col("role_family").alias("_family")), id_col, "left").join(acts, id_col, "left")
    archive = F.col("archived_at").isNull() & F.col("_reason").isNotNull()
    restore = F.col("archived_at").isNotNull() & F.coalesce("_restore", F.lit(False))
    s = s.withColumn("_archive", archive).withColumn("_back", restore)
    put = s.select(
        *rest,
        F.when(F.col("_archive"), at).when(~F.col("_back"), F.col("archived_at")).alias("archived_at"),
        F.when(F.col("_archive"), F.col("_reason")).when(~F.col("_back"), F.col("archived_reason")).alias("archived_reason"),
        F.coalesce("_outcome", "outcome").alias("outcome"),
        F.when(F.col("_outcome").isNotNull(), F.col("_family")).otherwise(F.col("role_family")).alias("role_family"),
    )
    counts = s.agg(F.count("_outcome").alias("evaluated"), F.count_if("_archive").alias("archived"), F.count_if("_back").alias("restored"))
    counts = counts.unionByName(new.agg(F.count(F.lit(1)).alias("recorded")), allowMissingColumns=True)
    counts = counts.agg(*(F.max(c).alias(c) for c in ("evaluated", "archived", "restored", "recorded")))
    return {"state": put, "decisions": new, "counts": counts}
