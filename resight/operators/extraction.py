"""Structured drafts: strict checks, normal terms and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Closed sets of the draft's fields.
STATES = ["stated", "not_stated", "conflicting", "not_assessable"]
STRENGTHS = ["required", "preferred", "mentioned", "not_required", "unclear"]
CATEGORIES = ["skill", "tool", "programming_language", "certification", "clearance", "other"]
LEVELS = ["vocational", "bachelor", "master", "doctorate", "degree_unspecified", "other"]
CEFR = ["A1", "A2", "B1", "B2", "C1", "C2"]
YEARS = ["minimum", "maximum", "target_range", "ambiguous_minimum", "exact"]
MODES = ["remote", "on_site", "hybrid", "remote_possible", "unspecified"]
FIELDS = ["requirements", "education", "languages", "experience", "work_arrangement", "responsibilities", "seniority", "employment_type"]
# Spellings of terms and the category of what they stand for.
ALIASES = {
    "powerbi": "Power BI", "power bi": "Power BI", "python": "Python", "sql": "SQL", "r": "R", "pytorch": "PyTorch", "tensorflow": "TensorFlow", "scikit-learn": "scikit-learn",
    "t-sql": "T-SQL", "transact-sql": "T-SQL", "transact-sql (t-sql)": "T-SQL", "excel": "Excel", "microsoft excel": "Excel", "ms excel": "Excel", "aws": "AWS", "amazon web services": "AWS",
    "azure": "Azure", "microsoft azure": "Azure", "gcp": "GCP", "google cloud platform": "GCP", "java": "Java", "scala": "Scala",
}
LANGUAGES = ["Python", "SQL", "T-SQL", "R", "Java", "Scala"]

_QUALIFIED = {"strength": STRENGTHS, "condition": "text?", "alternative_group": "text?", "alternative_option": "text?", "evidence": 1}
#: Of each kind of claim its keys: a closed set, text (needed, of a length), text? (may be null), a pattern, or how many entries its evidence has at least.
SCHEMAS = {
    "requirement": {"term": "text1", "category": CATEGORIES, "proficiency": "text?", **_QUALIFIED},
    "education": {"qualification": "text1", "level": LEVELS, "fields_of_study": "list", **_QUALIFIED},
    "language": {"language": "text", "proficiency": "text?", "cefr": [*CEFR, None], **_QUALIFIED},
    "description_language": {"code": "^[a-z]{2,3}$", "evidence": 1},
    "experience": {"wording": "text", "years": "object?", "scope": "text?", **_QUALIFIED},
    "work_arrangement": {"mode": MODES, "wording": "text", "office_attendance": "text?", "geographic_restrictions": "text?", "condition": "text?", "evidence": 1},
    "claim": {"value": "text", "evidence": 1},
    "conflict": {"field": FIELDS, "explanation": "text", "evidence": 2},
}


def issue(condition: Column, field: str, message: str) -> Column:
    return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message")))


def issues(*found: Column) -> Column:
    """The issues that there are."""
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def check_json(json: Column, kind: str) -> Column:
    """Issues (field, message) of a claim as JSON against SCHEMAS[kind]: no JSON object, keys that miss or are too many, unknown values, texts that are
    too short or of another form, too little evidence, quotes without words or source, and an alternative without its other half."""
    # an array of one binds what is parsed: each claim is parsed once
    parsed = F.array(F.struct(F.json_object_keys(json).alias("keys"), F.try_parse_json(json).alias("v"), json.alias("json")))
    return F.flatten(F.transform(parsed, lambda x: _checked(x["keys"], x["v"], x["json"], SCHEMAS[kind])))


def _checked(keys: Column, v: Column, json: Column, fields: dict) -> Column:
    at = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    type_of = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    out = [issue(keys.isNull(), "claim", "is no object")]
    for f, rule in fields.items():
        there = F.array_contains(keys, f)
        out.append(issue(~there, f, "is missing"))
        value, no_text = at(f), there & (type_of(f) != "STRING")
        if isinstance(rule, list):
            out.append(issue(there & (~value.isin([r for r in rule if r]) if None not in rule else value.isNotNull() & ~value.isin([r for r in rule if r])) | (there & value.isNull() & F.lit(None not in rule)), f, "is unknown"))
        elif rule == "text1":
            out.append(issue(no_text | (there & (F.coalesce(F.length(F.trim(value)), F.lit(0)) < 1)), f, "is too short"))
        elif rule == "text":
            out.append(issue(no_text, f, "is no text"))
        elif rule == "text?":
            out.append(issue(there & ~type_of(f).isin("STRING", "VOID"), f, "is no text"))
        elif rule == "list":
            out.append(issue(there & F.try_variant_get(v, f"$.{f}", "array<string>").isNull(), f, "is no list"))
        elif rule == "object?":
            out.append(issue(there & ~type_of(f).startswith("OBJECT") & (type_of(f) != "VOID"), f, "is no object"))
        elif isinstance(rule, int):
            quotes = F.from_json(F.get_json_object(json, f"$.{f}"), "array<struct<source_ref:string,quote:string>>")
            out.append(issue(there & (F.coalesce(F.size(quotes), F.lit(-1)) < rule), f, "has too few entries"))
            out.append(issue(F.exists(quotes, lambda q: q["source_ref"].isNull() | (F.coalesce(F.length(q["quote"]), F.lit(0)) < 1)), f, "has a quote without source or words"))
        else:
            out.append(issue(there & ~F.coalesce(value.rlike(rule), F.lit(False)), f, "has another form"))
    if "alternative_group" in fields:
        out.append(issue(at("alternative_group").isNull() != at("alternative_option").isNull(), "alternative", "needs group and option"))
    extra = F.transform(F.array_except(F.coalesce(keys, F.expr("cast(array() AS array<string>)")), F.array(*map(F.lit, fields))), lambda k: F.struct(k.alias("field"), F.lit("is not allowed").alias("message")))
    return F.concat(issues(*out), extra)


def check_years(kind: Column, lower: Column, upper: Column) -> Column:
    """Bounds of experience by kind."""
    ranged = kind.isin("target_range", "ambiguous_minimum", "exact")
    return issues(
        issue((lower < 0) | (upper < 0), "years", "bounds are not negative"),
        issue((kind == "minimum") & (lower.isNull() | upper.isNotNull()), "years", "a minimum has a lower bound only"),
        issue((kind == "maximum") & (upper.isNull() | lower.isNotNull()), "years", "a maximum has an upper bound only"),
        issue(ranged & (lower.isNull() | upper.isNull() | (lower > upper)), "years", "a range has two ordered bounds"),
        issue((kind == "exact") & (lower != upper), "years", "an exact value has equal bounds"),
        issue(~F.coalesce(kind, F.lit("")).isin(YEARS), "years", "kind is unknown"),
    )


def check_coherence(languages: Column, states: dict[str, tuple[Column, Column]], conflicts: Column) -> Column:
    """Issues of a whole draft: description languages (code, evidence) that repeat or have evidence outside the description's text, and fields
    (state, number of values) whose state fits neither their values nor the fields that conflicts name."""
    codes = F.transform(languages, lambda x: x["code"])
    outside = F.exists(F.flatten(F.transform(languages, lambda x: F.transform(x["evidence"], lambda e: e["source_ref"]))), lambda r: ~r.startswith("description."))
    out = [issue(F.size(F.array_distinct(codes)) < F.size(codes), "description_languages", "duplicate code"), issue(outside, "description_languages", "evidence is no description text")]
    for f, (state, n) in states.items():
        out.append(issue((state == "not_stated") & (n > 0), f, "has values but is marked not_stated"))
        out.append(issue(state.isin("stated", "conflicting") & (n == 0), f, "is marked without values"))
        out.append(issue((state == "conflicting") != F.array_contains(conflicts, f), f, "conflicts and state differ"))
        out.append(issue(~F.coalesce(state, F.lit("")).isin(STATES), f, "state is unknown"))
    return issues(*out)


def unknown_keys(json: Column, known: list[str]) -> Column:
    """Keys of a JSON object that are not allowed."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.expr("cast(array() AS array<string>)")), F.array(*map(F.lit, known)))


def alternatives_text(claims: DataFrame, id_col: str, option: str, term: str) -> DataFrame:
    """(id, words): what belongs to one option joined by +, options by OR, both in order; repeated claims count once."""
    one = claims.select(id_col, option, term).distinct().groupBy(id_col, option).agg(F.array_sort(F.collect_list(term)).alias("_l"))
    together = one.select(id_col, F.struct(option, F.array_join(F.transform("_l", lambda x: x.cast("string")), " + ").alias("t")).alias("_s"))
    return together.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["t"]), " OR ").alias("words"))


def term_aliases(spark: SparkSession) -> DataFrame:
    """(alias, name, category) of ALIASES."""
    return spark.createDataFrame([(a, n, "programming_language" if n in LANGUAGES else "tool") for a, n in ALIASES.items()], "alias string, name string, category string")


def language_code(codes: Column) -> Column:
    """The codes of a draft's description languages, joined; und without any."""
    return F.coalesce(F.nullif(F.array_join(codes, "/"), F.lit("")), F.lit("und"))


def normal_terms(claims: DataFrame, aliases: DataFrame, most: int = 100_000) -> DataFrame:
    """claims (term, ...) with the alias's name and category, where the alias table has one; it is broadcast up to `most` rows."""
    a = aliases.select(F.lower("alias").alias("_a"), F.col("name").alias("_n"), F.col("category").alias("_k"))
    small = a.limit(most + 1).count() <= most
    out = claims.withColumn("_t", F.lower(F.trim("term"))).join(F.broadcast(a) if small else a.hint("merge"), F.col("_t") == F.col("_a"), "left")
    return out.withColumn("term", F.coalesce("_n", F.trim("term"))).withColumn("category", F.coalesce("_k", "category")).drop("_a", "_n", "_k", "_t")


def publish(attempts: DataFrame, published: DataFrame, processable: DataFrame, id_col: str = "job_id") -> DataFrame:
    """Results to append: of attempts that are still the newest of their id, of processable ids, not published in that version."""
    newest = attempts.groupBy(id_col).agg(F.max("attempt_id").alias("_newest"))
    ok = attempts.join(newest, id_col).filter("attempt_id = _newest AND status = 'done'").drop("_newest")
    return ok.join(processable.select(id_col), id_col, "left_semi").join(published.select(id_col, "version"), [id_col, "version"], "left_anti")


def best_result(results: DataFrame, current: DataFrame, id_col: str = "job_id") -> DataFrame:
    """(id, result_id, stale): the one with the current fingerprint before any other with data, then the newest.  An id without a
    current fingerprint shows its newest result, as stale."""
    r = results.filter("has_data").join(current.select(id_col, F.col("fingerprint").alias("_now")), id_col, "left")
    fits = F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False))
    return r.groupBy(id_col).agg(F.max_by(F.struct("result_id", (~fits).alias("stale")), F.struct(fits, "result_id")).alias("b")).select(id_col, "b.*")


def legacy_result(old: DataFrame, notes: DataFrame, membership: DataFrame, id_col: str = "job_id") -> DataFrame:
    """(canonical_job_id, payload, created_at, status) of each role: the newest older result (id, payload, created_at) of any member with valid JSON that
    was no dry run, and the status of its newest note (id, status, noted_at)."""
    v = F.try_parse_json("payload")
    dry = F.coalesce(F.try_variant_get(v, "$.dry_run", "string"), F.lit("0")).isin("1", "true")
    good = old.filter(v.isNotNull() & ~dry).join(membership, id_col)
    newest = good.groupBy("canonical_job_id").agg(F.max_by("payload", "created_at").alias("payload"), F.max("created_at").alias("created_at"))
    said = notes.join(membership, id_col).groupBy("canonical_job_id").agg(F.max_by("status", "noted_at").alias("status"))
    return newest.join(said, "canonical_job_id", "left")
