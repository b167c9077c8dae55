"""Queries of pages, evidence, drafts and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import extraction as X
from ..operators import pages as G
from .base import SIGHTINGS_SQL, moment, query, sightings, table


def _text_sql(html: str) -> str:
    """The text of pages as the given ones are: their elements, and four character references."""
    t = f"regexp_replace(regexp_replace({html}, '<!--.*?-->', '', 'gs'), '<(script>.*?</script|style>.*?</style|title>.*?</title)>', '', 'gs')"
    t = f"regexp_replace({t}, '<li>', chr(10) || '• ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '</?(p|div|article|footer|ul|li|nav|h1|br)( [^>]*)?>', chr(10), 'g'), '</?[A-Za-z!][^>]*>', '', 'g')"
    for name, c in (("copy", "'©'"), ("middot", "'·'"), ("quot", "chr(34)"), ("amp", "'&'")):  # the semicolon may be missing
        t = f"regexp_replace({t}, '&{name};?', {c}, 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[\\t\\r ]+', ' ', 'g'))), lambda x: x <> '' AND x <> '•'), chr(10))"


@query("ext_html_text", f"SELECT page_id, length(t) AS n_chars, sha256(t) AS sha256 FROM (SELECT page_id, {_text_sql('html')} AS t FROM pages)")
def _(spark, d):
    t = G.html_text(table(spark, d, "pages"))
    return t.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


_PLACES = {"content": ["article"], "title": ["h1"], "item": ["nav li"], "label": ["a"], "value": ["a"]}


@query(
    "ext_page",
    f"""WITH p AS (SELECT *, regexp_extract(url, '/[a-z]{{2}}/([0-9]+)', 1) AS n, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS article FROM pages)
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'identity_mismatch' WHEN n = '' THEN 'identity_mismatch' WHEN n <> page_id::VARCHAR AND page_id % 4 = 1 THEN 'identity_mismatch' END AS error_kind,
    CASE WHEN page_id % 4 = 0 OR n = '' OR (n <> page_id::VARCHAR AND page_id % 4 = 1) THEN NULL ELSE sha256({_text_sql("article")}) END AS sha256 FROM p""",
)
def _(spark, d):
    # a canonical link of the url in each page but every fourth; the name is the page's own id in every fourth, else the number in the url
    p, own = table(spark, d, "pages"), F.col("page_id").cast("string")
    number = F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1)
    link = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit('<link rel="canonical" href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'))).otherwise("")
    p = p.select("page_id", F.when((F.col("page_id") % 4 == 1) | (number == ""), own).otherwise(number).alias("name"), F.concat(link, "html").alias("html"))
    out = G.parse_pages(p, r"/[a-z]{2}/([0-9]+)", name_col="name", where=_PLACES)
    return out.select("page_id", "error_kind", F.sha2("text", 256).alias("sha256"))


@query("ext_result_cards", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1)) AS a, generate_subscripts(regexp_extract_all(html, '<li>(<a href="[^"]*">[^<]*</a>)</li>', 1), 1) - 1 AS pos FROM pages) SELECT page_id, pos::BIGINT AS pos, replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&') AS href, trim(replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&')) AS title FROM l""")
def _(spark, d):
    return G.result_cards(table(spark, d, "pages"), where={"card": ["div.job-search-card", "nav li"], "title": ["h3", "a"], "link": ["a"]}).select("page_id", "pos", "href", "title")


@query("ext_page_sequence", "WITH p AS (SELECT o_custkey AS q, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) SELECT q AS query, max(o) AS stop_offset FROM p WHERE nth <= 4 GROUP BY q")
def _(spark, d):
    cards = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("offset"), F.explode(F.expr("sequence(0, 11)")).alias("i"))
    cards = cards.select("query", "offset", (F.col("offset") * 100 + F.col("i")).alias("id"))
    return G.page_sequence(cards).select("query", "stop_offset")


@query(
    "ext_reparse",
    f"""WITH p AS (SELECT *, regexp_extract(url, '/[a-z]{{2}}/([0-9]+)', 1) AS n, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS article FROM pages)
    SELECT page_id, 'v2' AS version, CASE WHEN n <> '' THEN sha256({_text_sql("article")}) END AS sha256, CASE WHEN n = '' THEN 'identity_mismatch' END AS error_kind FROM p WHERE page_id % 2 = 1""",
)
def _(spark, d):
    # stored bytes of all pages; those with even ids were parsed under this version before
    p = table(spark, d, "pages")
    number = F.regexp_extract("url", "/[a-z]{2}/([0-9]+)", 1)
    link = F.concat(F.lit('<link rel="canonical" href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">'))
    stored = p.select("page_id", F.when(number == "", F.col("page_id").cast("string")).otherwise(number).alias("name"), F.encode(F.concat(link, "html"), "utf-8").alias("body"))
    parse = lambda pages, saved: G.reparse(pages, saved, "v2", r"/[a-z]{2}/([0-9]+)", name_col="name", where=_PLACES)
    saved = parse(stored.filter("page_id % 2 = 0"), spark.createDataFrame([], "page_id bigint, source_sha256 string, version string, sha256 string"))
    return parse(stored, saved).select("page_id", "version", F.sha2("text", 256).alias("sha256"), "error_kind")


def _quotes(spark, d):
    """A quote of each line of over 40 characters: as it is, re-cased and re-spaced, or from nowhere, by the document's id; and the lines."""
    src = E.sources_of(table(spark, d, "documents"))
    n = F.col("doc") % 3
    quote = F.when(n == 0, F.substring("text", 5, 30)).when(n == 1, F.replace(F.upper(F.substring("text", 5, 30)), F.lit(" "), F.lit("  "))).otherwise("no such words anywhere")
    return src.filter("length(text) > 40").select("doc", "ref", quote.alias("quote")), src.select("doc", "ref", "text")


@query(
    "ev_build_sources",
    """WITH k AS (SELECT * FROM documents WHERE length(trim(text, ' ')) >= 80 AND strlen(text) <= 500000), q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'public_page' ELSE 'legacy_completeness_unknown' END AS quality FROM k),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM k)
    SELECT doc_id AS doc, ref, md5(t) AS line, quality FROM (SELECT doc_id, 'title' AS ref, 'Title ' || lang AS t FROM k UNION ALL SELECT doc_id, 'company', source FROM k UNION ALL SELECT doc_id, 'location', '' FROM k
      UNION ALL SELECT doc_id, 'description.' || pos::VARCHAR, t FROM l WHERE trim(t) <> '' UNION ALL SELECT doc_id, 'criteria.0', 'Language: ' || lang FROM k UNION ALL SELECT doc_id, 'criteria.1', 'Size: ' || n_chars::VARCHAR FROM k) JOIN q USING (doc_id)""",
)
def _(spark, d):
    label = lambda name, c: F.struct(F.lit(name).alias("label"), F.col(c).cast("string").alias("value"))
    docs = table(spark, d, "documents").withColumn("title", F.concat(F.lit("Title "), "lang")).withColumn("criteria", F.array(label("Language", "lang"), label("Size", "n_chars"))).withColumn("legacy", F.col("doc_id") % 2 == 1)
    return E.sources_of(docs, title="title", company="source", criteria="criteria", legacy="legacy").select("doc", "ref", F.md5("text").alias("line"), "quality")


@query("ev_fingerprint", "SELECT doc_id, sha256('{\"contract\":\"c1\",\"lang\":\"' || lang || '\"}') AS fingerprint FROM documents")
def _(spark, d):
    from ..functions.values import digest

    return table(spark, d, "documents").select("doc_id", digest(F.lit("c1").alias("contract"), F.col("lang")).alias("fingerprint"))


@query(
    "ev_normalized_span",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE length(trim(text, ' ')) >= 80 AND strlen(text) <= 500000),
    s AS (SELECT *, strlen(t) = length(t) AS plain, regexp_extract(t, '([^\x09-\x0D\x1C-\x20]+)[\x09-\x0D\x1C-\x20]*$', 1) AS word, regexp_extract(t, '([\x09-\x0D\x1C-\x20]*)$', 1) AS rest FROM l WHERE trim(t) <> '')
    SELECT doc_id AS doc, 'description.' || pos::VARCHAR AS ref, length(t)::BIGINT AS covered, CASE WHEN plain THEN md5(regexp_replace(replace(replace(lower(t), chr(34), chr(39)), chr(96), chr(39)), '[\x09-\x0D\x1C-\x20]+', ' ', 'g')) END AS folded,
      CASE WHEN plain THEN (length(t) - length(rest) - length(word))::BIGINT END AS word_start, CASE WHEN plain THEN (length(t) - length(rest))::BIGINT END AS word_end FROM s""",
)
def _(spark, d):
    # each line folded; its whole length, and the place of its last folded word, led back to the line
    s = E.folded_sources(E.sources_of(table(spark, d, "documents")).select("doc", "ref", "text"))
    plain = F.octet_length("text") == F.length("text")
    end = F.length(F.rtrim("folded"))
    word = F.length(F.substring_index(F.rtrim("folded"), " ", -1))
    whole, last = E.source_span(F.col("offsets"), F.lit(0), F.length("folded")), E.source_span(F.col("offsets"), end - word, end)
    return s.select("doc", "ref", (whole["end"] - whole["start"]).alias("covered"), F.when(plain, F.md5("folded")).alias("folded"), F.when(plain, last["start"]).alias("word_start"), F.when(plain, last["end"]).alias("word_end"))


@query("ev_resolve")
def _(spark, d):
    return E.resolve(*_quotes(spark, d))


@query(
    "ev_resolve_exact",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE length(trim(text, ' ')) >= 80 AND strlen(text) <= 500000),
    q AS (SELECT doc_id, pos, t, CASE WHEN doc_id % 3 = 0 THEN substr(t, 5, 30) WHEN doc_id % 3 = 1 THEN replace(upper(substr(t, 5, 30)), ' ', '  ') ELSE 'no such words anywhere' END AS quote FROM l WHERE length(t) > 40 AND trim(t) <> '')
    SELECT doc_id AS doc, 'description.' || pos::VARCHAR AS ref, (instr(t, quote) - 1)::BIGINT AS start FROM q WHERE instr(t, quote) > 0""",
)
def _(spark, d):
    return E.resolve(*_quotes(spark, d)).filter("method = 'exact'").select("doc", "ref", "start")


def _claims(spark, d):
    """Claims as JSON from the lines of orders: right ones, and ones with an unknown value, a missing part, a key too many or no evidence."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    one = F.lit('[{"source_ref":"description.1","quote":"x"}]')
    fields = [("term", F.when(n == 2, '" "').otherwise('"Python"')), ("category", F.lit('"skill"')), ("proficiency", F.lit("null")), ("strength", F.when(n == 3, '"maybe"').otherwise('"required"')), ("condition", F.lit("null"))]
    fields += [("alternative_group", F.when(n == 4, '"a"').otherwise("null")), ("alternative_option", F.lit("null")), ("evidence", F.when(n == 5, "[]").otherwise(one))]
    text = F.concat(F.lit("{"), *(x for i, (f, v) in enumerate(fields) for x in (F.lit(f'{"," if i else ""}"{f}":'), v)), F.when(n == 6, ',"more":1}').otherwise("}"))
    return table(spark, d, "lineitem").select(k.alias("l_orderkey"), n.cast("bigint").alias("l_linenumber"), F.when(n == 7, F.replace(text, F.lit('"category":"skill",'), F.lit(""))).otherwise(text).alias("claim"))


@query("val_schema", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE l_linenumber WHEN 2 THEN 'term: is too short' WHEN 3 THEN 'strength: is unknown' WHEN 4 THEN 'alternative: needs group and option' WHEN 5 THEN 'evidence: has too few entries' WHEN 6 THEN 'more: is not allowed' WHEN 7 THEN 'category: is missing' ELSE '' END AS found FROM lineitem")
def _(spark, d):
    c = _claims(spark, d)
    return c.select("l_orderkey", "l_linenumber", F.array_join(F.transform(X.check_json(F.col("claim"), "requirement"), lambda x: F.concat(x["field"], F.lit(": "), x["message"])), "; ").alias("found"))


@query("val_rules", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size % 3 = 0 WHEN 1 THEN true WHEN 2 THEN p_size % 3 <> 0 WHEN 3 THEN true WHEN 4 THEN p_size % 3 <> 0 ELSE true END AS bad FROM part")
def _(spark, d):
    s = F.col("p_size")
    kind = F.get(F.array(*map(F.lit, ("minimum", "maximum", "target_range", "other", "ambiguous_minimum", "exact"))), s % 6)
    upper = F.when((s % 6 == 0) & (s % 3 != 0), F.lit(None).cast("double")).when(s % 6 == 5, s + 1.0).when(s % 3 != 0, s - 1.0).otherwise(s + 1.0)
    return table(spark, d, "part").select("p_partkey", (F.size(X.check_years(kind, s.cast("double"), upper)) > 0).alias("bad"))


@query("val_coherence", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'description_languages: duplicate code; ' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN 'description_languages: evidence is no description text; ' ELSE '' END ||
    CASE o_orderkey % 4 WHEN 0 THEN 'education: has values but is marked not_stated' WHEN 1 THEN 'education: is marked without values' WHEN 2 THEN 'education: conflicts and state differ' ELSE '' END AS found FROM orders""")
def _(spark, d):
    k = F.col("o_orderkey")
    lang = lambda code, ref: F.struct(F.lit(code).alias("code"), F.array(F.struct(ref.alias("source_ref"), F.lit("x").alias("quote"))).alias("evidence"))
    ref = F.when(k % 7 == 0, "title").otherwise("description.2")
    langs = F.when(k % 5 == 0, F.array(lang("de", F.lit("description.1")), lang("de", ref))).otherwise(F.array(lang("de", F.lit("description.1")), lang("en", ref)))
    state = F.when(k % 4 == 0, "not_stated").when(k % 4 == 1, "stated").when(k % 4 == 2, "conflicting").otherwise("stated")
    found = X.check_coherence(langs, {"education": (state, F.when(k % 4 == 1, 0).otherwise(1))}, F.expr("cast(array() AS array<string>)"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda x: F.concat(x["field"], F.lit(": "), x["message"])), "; ").alias("f")).select("o_orderkey", F.concat("f", F.when((k % 4 == 3) & (F.col("f") != ""), "; ").otherwise("")).alias("found"))


@query("val_normalize_terms", "SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN 'Bolt, red' WHEN p_partkey % 3 = 0 THEN 'Power BI' ELSE p_name END AS term, CASE WHEN p_name = 'red bolt' THEN 'fastener' WHEN p_partkey % 3 = 0 THEN 'tool' ELSE p_type END AS category, CASE WHEN p_partkey % 2 = 0 THEN 'de/en' ELSE 'und' END AS language FROM part")
def _(spark, d):
    bolt = F.col("p_name") == "red bolt"
    claims = table(spark, d, "part").select("p_partkey", F.when(~bolt & (F.col("p_partkey") % 3 == 0), " PowerBI").otherwise(F.concat(F.lit(" "), "p_name")).alias("term"), F.col("p_type").alias("category"), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("de"), F.lit("en"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("codes"))
    aliases = X.term_aliases(spark).unionByName(spark.createDataFrame([("Red Bolt", "Bolt, red", "fastener")], "alias string, name string, category string"))
    return X.normal_terms(claims, aliases).select("p_partkey", "term", "category", X.language_code(F.col("codes")).alias("language"))


def _drafts(spark, d):
    return table(spark, d, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("attempt_id"), F.when(F.col("conv_id") % 3 == 0, "failed").otherwise("done").alias("status"), F.lit("v1").alias("version"), "text")


@query("val_publish_latest", "SELECT conv_id AS job_id, max(turn) AS attempt_id FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0 AND conv_id % 2 = 0 AND conv_id % 5 <> 0 GROUP BY conv_id")
def _(spark, d):
    a = _drafts(spark, d)
    done = a.filter("job_id % 5 = 0").select("job_id", "version").distinct()
    return X.publish(a, done, a.filter("job_id % 2 = 0").select("job_id").distinct()).select("job_id", "attempt_id")


@query("val_best_result", "SELECT conv_id AS job_id, CASE WHEN conv_id % 3 = 0 THEN max(turn) ELSE coalesce(max(CASE WHEN turn % 4 = 1 THEN turn END), max(turn)) END AS result_id, conv_id % 3 = 0 OR max(CASE WHEN turn % 4 = 1 THEN turn END) IS NULL AS stale FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(spark, d):
    r = _drafts(spark, d).select("job_id", F.col("attempt_id").alias("result_id"), (F.col("attempt_id") % 4).cast("string").alias("fingerprint"), F.lit(True).alias("has_data"))
    return X.best_result(r, r.filter("job_id % 3 <> 0").select("job_id", F.lit("1").alias("fingerprint")).distinct())


@query(
    "val_legacy_result",
    """WITH e AS (SELECT *, user_id - user_id % 2 AS root FROM events), l AS (SELECT root, arg_max(json_extract_string(props, '$.k')::BIGINT, event_id) AS k FROM e WHERE json_valid(props) AND event_type <> 'view' AND event_id % 5 <> 0 GROUP BY root),
    n AS (SELECT root, arg_max(event_type, event_id) AS review FROM e GROUP BY root) SELECT root, k, review FROM l LEFT JOIN n USING (root)""",
)
def _(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "job_id")
    member = e.select("job_id", (F.col("job_id") - F.col("job_id") % 2).alias("canonical_job_id")).distinct()
    payload = F.when(F.col("event_type") == "view", "{broken").when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"dry_run":1,'), F.expr("substr(props, 2)"))).otherwise(F.col("props"))
    old = e.select("job_id", F.col("event_id").alias("created_at"), payload.alias("payload"))
    notes = e.select("job_id", F.col("event_type").alias("status"), F.col("event_id").alias("noted_at"))
    out = X.legacy_result(old, notes, member)
    return out.select(F.col("canonical_job_id").alias("root"), F.get_json_object("payload", "$.k").cast("bigint").alias("k"), F.col("status").alias("review"))


def _reviewed(spark, d, faults: bool):
    """The report of a plan for drafts of orders: with faults by order key, and older orders, or without both."""
    from ..operators import corrections as C

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("job_id"), "o_orderpriority")
    fault = F.col("work_id") % 7 if faults else F.lit(6)
    quote = lambda ref, words: F.struct(F.lit(ref).alias("source_ref"), words.alias("quote"))
    said, prio = F.concat(F.lit("order number "), F.col("work_id").cast("string")), F.concat(F.lit("Priority "), "o_orderpriority")
    rest = ",".join([f'"{f}":[]' for f in C.CLAIMS if f not in ("description_languages", "requirements")] + ['"states":{' + ",".join(f'"{f}":"{"stated" if f == "requirements" else "not_stated"}"' for f in X.FIELDS) + "}"])
    gone = '{"evidence": [{"quote": "gone", "source_ref": "description.2"}], "code": "xx"}'
    qualified = '"category":"skill","proficiency":null,"strength":"required","condition":null,"alternative_group":null,"alternative_option":null'
    draft = '{"description_languages":[{"code":"en","evidence":[{"source_ref":"description.1","quote":"Order"}]},' + gone + '],"requirements":[{"term":"Python",' + qualified + ',"evidence":[{"source_ref":"description.1","quote":"@"}]}],' + rest + "}"
    filled = lambda text: F.concat(*(x for i, t in enumerate(text.split("@")) for x in ([said] if i else []) + [F.lit(t)]))
    output = filled(draft)
    work = o.select("work_id", "job_id", F.when(fault == 5, "succeeded").otherwise("failed").alias("status"), F.lit("output").alias("error_kind"), F.lit(None).cast("string").alias("repaired_by"))
    attempts = o.select("work_id", (F.col("work_id") * 2).alias("attempt_id"), output.alias("output"))
    texts = F.array(quote("description.1", F.concat(F.lit("Order "), F.col("work_id").cast("string"))), quote("description.2", prio))
    sources = o.select("work_id", F.explode(texts).alias("s")).select("work_id", F.col("s.source_ref").alias("ref"), F.col("s.quote").alias("text"))
    active = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("job_id"))
    fix = F.struct(
        F.array(*map(F.lit, ("requirements", "0", "evidence", "0"))).alias("path"),
        quote("description.1", F.when(fault == 1, "other words").otherwise(said)).alias("original"),
        quote("description.2", F.when(fault == 2, F.upper(prio)).otherwise(prio)).alias("replacement"),
    )
    cut = F.struct(F.lit(gone).alias("original"), F.when(fault == 3, " ").otherwise("not in the text").alias("reason"))
    # the plan's maker writes the draft's normal JSON; it isn't parsed for each order
    sha = F.when(fault == 0, "none").otherwise(F.sha2(filled(json.dumps(json.loads(draft), sort_keys=True, separators=(",", ":"))), 256))
    plan = o.select("work_id", "job_id", (F.col("work_id") * 2).alias("attempt_id"), sha.alias("output_sha256"), F.array(fix).alias("corrections"), F.when(fault != 4, F.array(cut)).alias("removals"))
    if not faults:
        newest = o.groupBy("job_id").agg(F.max("work_id").alias("work_id"))
        plan = plan.join(active, "job_id", "left_semi").join(newest, ["job_id", "work_id"], "left_semi")
    return C.reviewed(plan, work, attempts, sources, active)


# what the corrected draft of an order is, its keys in order
_CORRECTED = """'{"conflicts":[],"description_languages":[{"code":"en","evidence":[{"end":5,"quote":"Order","source_ref":"description.1","start":0}]}],"education":[],"employment_type":[],"experience":[],"languages":[],'
    || '"requirements":[{"alternative_group":null,"alternative_option":null,"category":"skill","condition":null,"evidence":[{"end":' || (9 + length(o_orderpriority))::VARCHAR || ',"quote":"Priority ' || o_orderpriority || '","source_ref":"description.2","start":0}],'
    || '"proficiency":null,"strength":"required","term":"Python"}],"responsibilities":[],"seniority":[],"states":{"education":"not_stated","employment_type":"not_stated","experience":"not_stated","languages":"not_stated",'
    || '"requirements":"stated","responsibilities":"not_stated","seniority":"not_stated","work_arrangement":"not_stated"},"work_arrangement":[]}'"""


@query(
    "val_apply_corrections",
    f"""WITH n AS (SELECT *, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders)
    SELECT o_orderkey AS work_id, o_custkey AS job_id, o_orderkey * 2 AS attempt_id, sha256({_CORRECTED}) AS content_sha256 FROM n WHERE newest AND o_custkey % 3 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)""",
)
def _(spark, d):
    from ..operators import corrections as C

    return C.repairs(_reviewed(spark, d, faults=False)).select("work_id", "job_id", "attempt_id", "content_sha256")


@query(
    "val_review_corrections",
    f"""WITH n AS (SELECT *, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest, o_orderkey % 7 AS fault FROM orders),
    p AS (SELECT *, CASE WHEN o_custkey % 3 = 0 OR o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'no active job' WHEN NOT newest THEN 'changed since review' WHEN fault = 0 THEN 'draft changed since review' WHEN fault = 1 THEN 'evidence is not as reviewed' WHEN fault = 2 THEN 'replacement is no exact span'
      WHEN fault = 3 THEN 'removal has no reason or no such language' WHEN fault = 4 THEN 'evidence is not in its source' WHEN fault = 5 THEN 'no failed output' END AS problem FROM n)
    SELECT o_orderkey AS work_id, problem, CASE WHEN problem IS NULL THEN 'ready' ELSE 'rejected' END AS status, CASE WHEN fault = 4 THEN 0 ELSE 1 END::BIGINT AS n_removed, CASE WHEN problem IS NULL THEN sha256({_CORRECTED}) END AS draft FROM p""",
)
def _(spark, d):
    return _reviewed(spark, d, faults=True).select("work_id", "problem", "status", "n_removed", F.sha2("draft", 256).alias("draft"))


def _streamed(spark, d):
    """Orders as a stream of files."""
    from ..sources.tables import scratch

    path = scratch(spark, "stream")
    sightings(spark, d).select("job_id", "run_id", "observed_at", "arrival", "title", F.col("status").alias("company")).write.option("maxRecordsPerFile", 200_000).parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


@query(
    "stream_sighting_ingest",
    f"""WITH {SIGHTINGS_SQL}, b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, run_id ORDER BY arrival) AS n FROM sightings) WHERE n = 1),
    b2 AS (SELECT * FROM (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY job_id, observed_at ORDER BY arrival) AS n FROM b1) WHERE n = 1), l AS (SELECT job_id, arg_max(title, arrival) AS title, min(observed_at) AS low FROM sightings GROUP BY job_id)
    SELECT b2.job_id, l.title, strftime(min(low), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS seen_count FROM b2 JOIN l ON l.job_id = b2.job_id GROUP BY b2.job_id, l.title""",
)
def _(spark, d):
    from ..sources.tables import scratch
    from ..streaming.sightings import read_state, start_ingest

    root = scratch(spark, "ingest")
    start_ingest(_streamed(spark, d), root, ["title", "company"], f"{root}/checkpoint").awaitTermination()
    return read_state(spark, root).select("job_id", "title", moment("first_seen").alias("first_seen"), moment("last_seen").alias("last_seen"), "seen_count")


@query("stream_sighting_state", f"WITH {SIGHTINGS_SQL} SELECT job_id, strftime(min(observed_at), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_seen, count(DISTINCT run_id) AS runs FROM sightings GROUP BY job_id")
def _(spark, d):
    from ..sources.tables import scratch
    from ..streaming.sightings import rolled_up, running_rollup

    root = scratch(spark, "rollup")
    out = running_rollup(_streamed(spark, d)).writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/updates/batch={n}"))
    out.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return rolled_up(spark.read.parquet(f"{root}/updates")).select("job_id", moment("first_seen").alias("first_seen"), moment("last_seen").alias("last_seen"), "runs")
