"""Reviewed corrections of saved drafts: edits by path in nested JSON, all of a plan or none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch
from . import evidence as E
from . import extraction as X

#: The lists of a draft, and the kind of their claims in extraction.SCHEMAS.
CLAIMS = {"description_languages": "description_language", "requirements": "requirement", "education": "education", "languages": "language", "experience": "experience", "work_arrangement": "work_arrangement"} | dict.fromkeys(("responsibilities", "seniority", "employment_type"), "claim") | {"conflicts": "conflict"}

_QUOTE = "struct<source_ref:string,quote:string>"
#: What a plan has for each work.
PLAN = f"work_id bigint, attempt_id bigint, output_sha256 string, corrections array<struct<path:array<string>,original:{_QUOTE},replacement:{_QUOTE}>>, removals array<struct<original:string,reason:string>>"
_REPORT = ["work_id", "job_id", "attempt_id", "status", "problem", "n_corrections", "n_removed", "draft", "plan_sha256"]


def normal_json(json: Column) -> Column:
    """JSON with its keys in order and without blanks; null where it is none."""
    return F.to_json(F.try_parse_json(json))


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _list(v: Column) -> Column:
    return v.try_cast("array<variant>")


def _object(v: Column) -> Column:
    return v.try_cast("map<string,variant>")


def each_evidence(draft: Column, change: Callable[[Column, Column], Column]) -> Column:
    """The draft (variant) with change(path, entry) for each entry of the evidence of each claim of its lists; path is like requirements.0.evidence.1.

    What has another form stays as it is.
    """

    def claim(path: Column, c: Column) -> Column:
        entries = lambda v: F.to_variant_object(F.transform(_list(v), lambda e, j: change(F.concat(path, F.lit(".evidence."), j.cast("string")), e)))
        return F.coalesce(F.to_variant_object(F.transform_values(_object(c), lambda k, v: F.when(k == "evidence", F.coalesce(entries(v), v)).otherwise(v))), c)

    claims = lambda k, v: F.to_variant_object(F.transform(_list(v), lambda c, i: claim(F.concat(k, F.lit("."), i.cast("string")), c)))
    return F.coalesce(F.to_variant_object(F.transform_values(_object(draft), lambda k, v: F.coalesce(claims(k, v), v))), draft)


def _evidence(draft: Column) -> Column:
    """(path, entry) of the entries that each_evidence meets."""
    none = F.expr("cast(array() AS array<variant>)")
    claims = F.flatten(F.transform(F.map_entries(_object(draft)), lambda f: F.transform(F.coalesce(_list(f["value"]), none), lambda c, i: F.struct(F.concat(f["key"], F.lit("."), i.cast("string"), F.lit(".evidence.")).alias("path"), F.coalesce(_list(_object(c)["evidence"]), none).alias("entries")))))
    return F.flatten(F.transform(claims, lambda c: F.transform(c["entries"], lambda e, j: F.struct(F.concat(c["path"], j.cast("string")).alias("path"), e.alias("entry")))))


def evidence_of(draft: Column) -> Column:
    """(path, json) of the entries that each_evidence meets."""
    return F.transform(_evidence(draft), lambda x: F.struct(x["path"].alias("path"), F.to_json(x["entry"]).alias("json")))


def _quote_of(entry: Column) -> Column:
    return F.struct(*(F.try_variant_get(entry, f"$.{f}", "string").alias(f) for f in ("source_ref", "quote")))


def check_draft(json: Column) -> Column:
    """Issues (field, message) of a whole draft as JSON: its lists, the claims in them, years of experience, states and conflicts."""
    # the draft is parsed once, and each of its parts taken out once
    part = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    parts = lambda x: F.struct(
        F.transform(X.unknown_keys(x["json"], [*CLAIMS, "states"]), lambda k: F.struct(k.alias("field"), F.lit("is not allowed").alias("message"))).alias("extra"),
        F.struct(*(part(x["v"], f, "array<variant>").alias(f) for f in CLAIMS)).alias("lists"),
        F.struct(*(part(x["v"], f"states.{f}", "string").alias(f) for f in X.FIELDS)).alias("states"),
        part(x["v"], "description_languages", "array<struct<code:string,evidence:array<struct<source_ref:string,quote:string>>>>").alias("languages"),
    )
    return _bound(_bound(F.struct(json.alias("json"), F.try_parse_json(json).alias("v")), parts), _issues)


def _issues(x: Column) -> Column:
    lists = {f: x["lists"][f] for f in CLAIMS}
    found = [x["extra"], X.issues(*(X.issue(c.isNull(), f, "is no list") for f, c in lists.items()))]
    claims = lambda f, kind: F.transform(F.coalesce(lists[f], F.expr("cast(array() AS array<variant>)")), lambda c: _bound(F.to_json(c), lambda t: X.check_json(t, kind)))
    found += [F.flatten(claims(f, kind)) for f, kind in CLAIMS.items()]
    years = F.filter(F.transform(lists["experience"], lambda c: F.try_variant_get(c, "$.years", "struct<kind:string,lower:double,upper:double>")), lambda y: y.isNotNull())
    found.append(F.coalesce(F.flatten(F.transform(years, lambda y: X.check_years(y["kind"], y["lower"], y["upper"]))), F.array().cast("array<struct<field:string,message:string>>")))
    states = {f: (x["states"][f], F.size(lists[f])) for f in X.FIELDS}
    said = F.transform(lists["conflicts"], lambda c: F.try_variant_get(c, "$.field", "string"))
    found.append(_bound(said, lambda fields: X.check_coherence(x["languages"], states, fields)))
    return F.flatten(F.array(*found))


def reviewed(plan: DataFrame, work: DataFrame, attempts: DataFrame, sources: DataFrame, active: DataFrame) -> DataFrame:
    """Each row of the plan (see PLAN) as (work_id, job_id, attempt_id, status, problem, n_corrections, n_removed, draft, plan_sha256).

    work has (work_id, job_id, status, error_kind, repaired_by: the plan_sha256 of the repair that its result comes from), attempts
    (work_id, attempt_id, output: the draft as JSON), sources (work_id, ref, text), active the job_id of jobs that may be processed.

    A row must be the only one of its work, the newest of an active job; name the newest attempt, and the SHA-256 of its draft's normal JSON; and the
    work must have failed by its output.  Each correction must name an entry of evidence by its path, as it is, once, and give a quote that
    its source holds exactly.  Each removal must give a reason and a description language as it is after the corrections; the first such is removed.  The
    draft that comes of it must pass check_draft, and all its quotes must be found (evidence.resolve).  problem is the first of these
    that fails, status then rejected; else ready, or already_repaired where the same row has been applied.

    draft is normal JSON, its evidence as found: source_ref, quote, start and end, and repair where that isn't what the draft had; null unless ready.
    Null corrections and removals are none; rows of null work ids are rejected; an empty plan gives no rows; other columns don't matter.
    Cost follows the plan: drafts and sources of other works are dropped before anything is parsed, and of those in it only rows that pass what ids and
    states tell are parsed.  The wide columns of the plan move once, by work.  The report is a written table.
    """
    spark = plan.sparkSession
    p = plan.select("work_id", "attempt_id", "output_sha256", *(F.coalesce(c, F.array().cast(plan.schema[c].dataType)).alias(c) for c in ("corrections", "removals")))
    p = _written(p.withColumn("plan_sha256", F.sha2(F.to_json(F.struct(*p.columns)), 256)), "plan")
    asked = p.select("work_id").distinct()
    own = work.join(asked, "work_id", "left_semi").select("work_id", "job_id", F.col("status").alias("_status"), "error_kind", "repaired_by")
    newest = work.join(own.select("job_id").distinct(), "job_id", "left_semi").groupBy("job_id").agg(F.max("work_id").alias("_newest"))
    own = own.join(newest, "job_id", "left").join(active.select("job_id", F.lit(True).alias("_active")).distinct(), "job_id", "left")
    last = attempts.join(asked, "work_id", "left_semi").groupBy("work_id").agg(F.max("attempt_id").alias("_attempt"))
    j = p.withColumn("_rows", F.count("*").over(Window.partitionBy("work_id"))).join(own, "work_id", "left").join(last, "work_id", "left")
    is_not = lambda c: ~F.coalesce(c, F.lit(False))
    first = lambda rules: F.coalesce(*(F.when(c, F.lit(m)) for c, m in rules))
    before = [
        (F.col("_rows") > 1, "work is in the plan twice"),
        (is_not(F.col("_active")), "no active job"),
        (is_not((F.col("work_id") == F.col("_newest")) & (F.col("attempt_id") == F.col("_attempt"))), "changed since review"),
    ]
    done = (F.col("_status") == "succeeded") & (F.col("repaired_by") == F.col("plan_sha256"))
    j = j.withColumn("problem", first(before)).withColumn("_done", F.coalesce(done, F.lit(False))).withColumn("_failed", F.coalesce((F.col("_status") == "failed") & (F.col("error_kind") == "output"), F.lit(False)))
    wide = (F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("output_sha256", "corrections", "removals"))
    j = _written(j.select("work_id", "job_id", "attempt_id", "plan_sha256", F.size("corrections").cast("bigint").alias("n_corrections"), F.size("removals").cast("bigint").alias("n_removed"), "problem", "_done", "_failed", *wide), "opened")
    settled = j.filter("problem IS NOT NULL").withColumn("_done", F.lit(False))
    j = j.filter("problem IS NULL")
    output = attempts.join(j.select("work_id", "attempt_id"), ["work_id", "attempt_id"], "left_semi").groupBy("work_id").agg(F.max("output").alias("output"))
    # rows are few for what they cost: Spark would put them in few tasks by their size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    j = _written(_edited(j.repartition(n, "work_id").join(output, "work_id")), "edited")
    j = j.withColumn("_issue", F.when(F.col("_draft").isNotNull(), F.get(check_draft(F.col("_draft")), F.lit(0))))
    j = j.withColumn("problem", F.coalesce("problem", F.concat("_issue.field", F.lit(" "), "_issue.message"))).drop("_issue")
    j = _written(j.withColumn("_draft", F.when(F.col("problem").isNull(), F.col("_draft"))), "checked")
    report = _with_spans(j, sources).unionByName(settled.select(*(F.lit(None).cast("string").alias(c) if c == "draft" else F.lit("rejected").alias(c) if c == "status" else F.col(c) for c in _REPORT)))
    return _written(report, "report")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _edited(j: DataFrame) -> DataFrame:
    """Rows of a plan with their output: problem where they don't fit it, else _draft, what comes of it."""
    key = lambda c: F.array_join(c["path"], ".")
    is_not = lambda c: ~F.coalesce(c, F.lit(False))
    fixes, removals, entries = F.col("corrections"), F.col("removals"), F.col("_entries")
    j = j.withColumn("_json", normal_json(F.col("output")))
    same = F.coalesce(F.sha2("_json", 256) == F.col("output_sha256"), F.lit(False))
    j = j.withColumn("_same", same).withColumn("_v", F.when(F.col("_same") & F.col("_failed") & ~F.col("_done"), F.try_parse_json("_json")))
    put = lambda at, e: F.coalesce(F.to_variant_object(F.get(F.filter(fixes, lambda c: key(c) == at), F.lit(0))["replacement"]), e)
    j = j.withColumn("_entries", _evidence(F.col("_v"))).withColumn("_edited", each_evidence(F.col("_v"), put))
    spoken = F.transform(F.try_variant_get("_edited", "$.description_languages", "array<variant>"), lambda x: F.to_json(x))

    def without(left: Column, r: Column) -> Column:
        cut = lambda at: F.when(at > 0, F.concat(F.slice(left, F.lit(1), at - 1), F.slice(left, at + 1, F.size(left))))
        return _bound(F.array_position(left, normal_json(r["original"])).cast("int"), cut)

    j = j.withColumn("_left", F.aggregate(removals, spoken, without))
    kept = F.to_variant_object(F.transform(F.col("_left"), lambda x: F.try_parse_json(x)))
    final = F.when(F.size(removals) > 0, F.to_variant_object(F.transform_values(_object(F.col("_edited")), lambda k, v: F.when(k == "description_languages", kept).otherwise(v)))).otherwise(F.col("_edited"))
    as_was = lambda c: _bound(F.struct(key(c).alias("path"), F.to_json(F.to_variant_object(c["original"])).alias("json")), lambda o: F.exists(entries, lambda x: (x["path"] == o["path"]) & (F.to_json(x["entry"]) == o["json"])))
    whole = lambda c: c["replacement"]["source_ref"].isNotNull() & (F.coalesce(F.length(c["replacement"]["quote"]), F.lit(0)) > 0)
    rules = [
        (~F.col("_same"), "draft changed since review"),
        (~F.col("_done") & ~F.col("_failed"), "no failed output"),
        (is_not(F.forall(fixes, as_was)), "evidence is not as reviewed"),
        (F.size(F.array_distinct(F.transform(fixes, key))) < F.size(fixes), "evidence is corrected twice"),
        (is_not(F.forall(fixes, whole)), "replacement has no source or words"),
        (is_not(F.forall(removals, lambda r: F.coalesce(F.length(F.trim(r["reason"])), F.lit(0)) > 0)) | ((F.size(removals) > 0) & F.col("_left").isNull()), "removal has no reason or no such language"),
    ]
    found = lambda rules: F.coalesce(*(F.when(c, F.lit(m)) for c, m in rules))
    j = j.withColumn("problem", F.coalesce(found(rules[:2]), F.when(~F.col("_done"), found(rules[2:])))).withColumn("_draft", F.when(F.col("problem").isNull() & ~F.col("_done"), F.to_json(final)))
    return j.select("work_id", "job_id", "attempt_id", "plan_sha256", "corrections", "n_corrections", "n_removed", "problem", "_done", "_draft")


def _with_spans(j: DataFrame, sources: DataFrame) -> DataFrame:
    """Looks for the quotes of the edited drafts, and puts what was found into them."""
    open_ = j.filter("_draft IS NOT NULL")
    quoted = F.transform(_evidence(F.try_parse_json("_draft")), lambda x: _quote_of(x["entry"]))
    asked = open_.select("work_id", F.explode(quoted).alias("q"), F.lit(False).alias("exact"))
    asked = asked.unionByName(open_.select("work_id", F.explode("corrections").alias("c")).select("work_id", F.col("c.replacement").alias("q"), F.lit(True).alias("exact")))
    asked = _written(asked.groupBy(F.col("work_id").alias("doc"), F.col("q.source_ref").alias("ref"), F.col("q.quote").alias("quote")).agg(F.bool_or("exact").alias("exact")), "asked")
    held = _written(sources.select(F.col("work_id").alias("doc"), "ref", "text").join(asked.select("doc").distinct().hint("merge"), "doc", "left_semi"), "held")
    found = E.resolve(asked.select("doc", "ref", "quote"), held).select("doc", "ref", "quote", "start", "end", "method", "source_ref")
    found = found.join(asked.hint("merge"), ["doc", "ref", "quote"]).join(held.select("doc", F.col("ref").alias("source_ref"), "text").hint("merge"), ["doc", "source_ref"], "left")
    words = F.expr("substring(text, cast(start + 1 AS int), cast(end - start AS int))")
    # two or more sources of a work with one ref would give a span each: the first is taken
    one = F.struct("ref", "quote", "source_ref", words.alias("found"), "start", "end", "method")
    spans = found.groupBy("doc").agg(
        F.count_if(F.col("method").isNull()).alias("_lost"),
        F.count_if(F.expr("exact AND coalesce(method, '') <> 'exact'")).alias("_inexact"),
        F.array_sort(F.collect_list(one)).alias("_spans"),
    )
    j = j.join(spans.withColumnRenamed("doc", "work_id").hint("merge"), "work_id", "left")

    def put(s: Column) -> Column:
        at = [s["source_ref"].alias("source_ref"), s["found"].alias("quote"), s["start"].alias("start"), s["end"].alias("end")]
        how = F.struct(s["method"].alias("method"), s["ref"].alias("original_source_ref"), s["quote"].alias("original_quote"))
        return F.when(s["method"] == "exact", F.to_variant_object(F.struct(*at))).otherwise(F.to_variant_object(F.struct(*at, how.alias("repair"))))

    of = lambda q: F.get(F.filter(F.col("_spans"), lambda x: (x["ref"] == q["source_ref"]) & (x["quote"] == q["quote"])), F.lit(0))
    span = lambda _, e: _bound(_bound(_quote_of(e), of), put)
    problem = F.coalesce("problem", F.when(F.col("_inexact") > 0, F.lit("replacement is no exact span")), F.when(F.col("_lost") > 0, F.lit("evidence is not in its source")))
    out = j.withColumn("problem", problem).withColumn("status", F.when(F.col("problem").isNotNull(), "rejected").when(F.col("_done"), "already_repaired").otherwise("ready"))
    draft = F.when(F.col("status") == "ready", F.to_json(each_evidence(F.try_parse_json("_draft"), span)))
    return out.withColumn("draft", draft).select(*_REPORT)


def repairs(report: DataFrame) -> DataFrame:
    """(work_id, job_id, attempt_id, draft, content_sha256, plan_sha256), the results to append after reviewed(): none if any row was rejected.

    report is to be a written table, as reviewed() gives it: it is read for the gate and for the results.
    """
    gate = report.agg(F.count_if(F.col("status") == "rejected").alias("_rejected"))
    ok = report.crossJoin(F.broadcast(gate)).filter("_rejected = 0 AND status = 'ready'")
    return ok.select("work_id", "job_id", "attempt_id", "draft", F.sha2("draft", 256).alias("content_sha256"), "plan_sha256")


def repaired_work(work: DataFrame, results: DataFrame) -> DataFrame:
    """work after repairs(): those works have succeeded, without an error, by that plan; attempts and drafts stay as they are."""
    r = results.select("work_id", F.col("plan_sha256").alias("_plan"))
    put = {"status": F.lit("succeeded"), "error_kind": F.lit(None).cast("string"), "repaired_by": F.col("_plan")}
    fixed = F.col("_plan").isNotNull()
    return work.join(r, "work_id", "left").select(*(F.when(fixed, put[c]).otherwise(F.col(c)).alias(c) if c in put else F.col(c) for c in work.columns))
