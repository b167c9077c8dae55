"""Quotes located in their sources: exact spans of the untouched original."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import by_rows
from ..sources.tables import scratch

# Words that change a claim, which no typo repair may touch.
QUALIFIERS = {"minimum", "maximum", "required", "preferred", "optional", "desirable", "mandatory", "without", "excluding", "including"}


_QUOTES = str.maketrans('"`', "''")
_RUN = re.compile(r"[\s\x1c-\x1f]+", re.ASCII)
_folds: dict[str, str] = {}


def _folded(piece: str) -> str:
    """A character with its marks: case, compatibility forms, dashes, quotation marks and spaces folded.  Different ones are few, and kept."""
    if (found := _folds.get(piece)) is None:
        out = []
        for c in unicodedata.normalize("NFKC", piece).casefold():
            kind = unicodedata.category(c)
            out.append("-" if kind == "Pd" else "'" if kind in ("Pi", "Pf") or c in "'\"`" else " " if c.isspace() else c)
        if len(_folds) >= 1 << 16:
            _folds.clear()
        found = _folds[piece] = "".join(out)
    return found


def normalized(text: str) -> tuple[str, Sequence[int], Sequence[int]]:
    """Case, compatibility forms, punctuation and spaces folded; the source start and end of each character."""
    if text.isascii():
        low = text.lower().translate(_QUOTES)
        runs = list(_RUN.finditer(low))
        if all(m.end() == m.start() + 1 for m in runs):  # as long as the text
            return _RUN.sub(" ", low), range(len(low)), range(1, len(low) + 1)
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and text[j] >= "\u0300" and unicodedata.combining(text[j]):
            j += 1
        for c in _folded(text[i:j]):
            if c == " " and out and out[-1] == " ":
                end[-1] = j
                continue
            out.append(c)
            start.append(i)
            end.append(j)
        i = j
    return "".join(out), start, end


def _span_in(quote: str, source: tuple[str, Sequence[int], Sequence[int]]) -> tuple[int, int] | None:
    folded, start, end = source
    q = normalized(quote)[0].strip()
    for v in (q, q.lstrip("•*- ").strip(), q.rstrip(".")):
        if v and (at := folded.find(v)) >= 0:
            return start[at], end[at + len(v) - 1]
    return None


def _one_typo(a: str, b: str) -> bool:
    """Whether b follows from a by one changed, missing, added or swapped letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def _typo_span_in(quote: str, source: tuple[str, Sequence[int], Sequence[int]]) -> tuple[int, int] | None:
    """Where the quote stands but for one typo.  As one word differs at most, its first or its last half of words is unchanged, so
    only places where one of these runs stands are looked at."""
    q = normalized(quote)[0].split()
    if (n := len(q)) < 5:
        return None
    folded, start, end = source
    text = f" {folded} "  # words stand between blanks; places in it are one further
    found = set()
    for first, last in ((0, n // 2), (n - n // 2, n)):
        run = " " + " ".join(q[first:last]) + " "
        at = text.find(run)
        while at >= 0:
            begin = at
            for _ in range(first):  # back to where the quote's first word would stand
                begin = text.rfind(" ", 0, begin) if begin > 0 else -1
            words = text[begin + 1 : begin + 1 + 2 * sum(map(len, q)) + 2 * n].split(" ", n)[:n] if begin >= 0 else []
            odd = [(x, y) for x, y in zip(q, words, strict=False) if x != y]
            if len(words) == n and all(words) and len(odd) == 1 and len(odd[0][0]) >= 7 and not {*odd[0]} & QUALIFIERS and _one_typo(*odd[0]):
                found.add((begin, begin + len(" ".join(words))))
            at = text.find(run, at + 1)
    if len(found) != 1:
        return None
    ((a, b),) = found
    return start[a], end[b - 1]


def _runs(start: Sequence[int], end: Sequence[int]) -> list[dict[str, int]]:
    """The offsets of normalized() as runs: of characters that stand for one source character each (step 1), or for a piece together (step 0)."""
    if isinstance(start, range):
        return [{"at": 0, "n": len(start), "start": 0, "end": len(start), "step": 1}] if len(start) else []
    out: list[dict[str, int]] = []
    for k, (a, b) in enumerate(zip(start, end, strict=True)):
        last = out[-1] if out else None
        step = int(b - a == 1)
        if last and last["step"] and step and a == last["end"]:
            last["n"], last["end"] = last["n"] + 1, b
        elif last and (a, b) == (last["start"], last["end"]):
            last["n"], last["step"] = last["n"] + 1, 0
        else:
            out.append({"at": k, "n": 1, "start": a, "end": b, "step": step})
    return out


def folded_sources(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """sources with `folded`, the text as quotes are compared, and `offsets`, which lead from it back to the source.

    offsets are runs (at, n, start, end, step): the folded characters at to at + n - 1 stand for the source's start to end - 1, one by
    one (step 1) or all of them together (step 0).  A null text has null in both, an empty one an empty text and no runs.
    """

    @F.pandas_udf("struct<folded:string,offsets:array<struct<at:int,n:int,start:int,end:int,step:int>>>")
    def fold(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else ((f := normalized(t))[0], _runs(*f[1:])) for t in texts]
        return pd.DataFrame(rows, columns=["folded", "offsets"])

    out = sources.withColumn("_f", fold(F.col(text_col)))
    return out.select(*sources.columns, F.col("_f.folded").alias("folded"), F.col("_f.offsets").alias("offsets"))


def source_span(offsets: Column, start: Column, end: Column) -> Column:
    """(start, end) in the source of the folded characters start to end - 1; null where there are none such."""
    run = lambda k: F.get(offsets, F.array_size(F.filter(F.transform(offsets, lambda x: x["at"]), lambda at: at <= k)) - 1)
    first, last = run(start), run(end - 1)
    a = first["start"] + first["step"] * (start - first["at"])
    b = F.when(last["step"] == 1, last["start"] + end - last["at"]).otherwise(last["end"])
    within = (start >= 0) & (start < end) & (end <= F.get(offsets, F.array_size(offsets) - 1)["at"] + F.get(offsets, F.array_size(offsets) - 1)["n"])
    return F.when(within, F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end")))


def _elsewhere(misses: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc, ref, quote, found) of misses (doc, ref, quote) that exactly one other source of the document and family holds.

    The family is the ref before its first dot.  The sources of a document are folded once for all its quotes.
    """
    family = F.substring_index("ref", ".", 1).alias("family")
    asked = misses.distinct().groupBy("doc", family).agg(F.collect_list(F.struct("ref", "quote")).alias("asked"))
    held = sources.groupBy("doc", family).agg(F.collect_list(F.struct("ref", "text")).alias("held"))

    def run(doc, _ref, _other, asked: list[dict], held: list[dict]) -> Iterator[tuple]:
        folded = [(x["ref"], normalized(x["text"])) for x in held if x["text"] is not None]
        hits: dict[str, list] = {}
        for a in asked:
            if (q := a["quote"]) not in hits:
                hits[q] = [(ref, span) for ref, f in folded if (span := _span_in(q, f))]
            if len(others := [h for h in hits[q] if h[0] != a["ref"]]) == 1:
                yield doc, a["ref"], others[0][0], q, *others[0][1]

    doc, ref = (misses.schema[c].dataType.simpleString() for c in ("doc", "ref"))
    both = asked.join(held.hint("merge"), ["doc", "family"]).select("doc", *(F.lit(None).cast(ref).alias(c) for c in ("ref", "_other")), "asked", "held")
    found = both.mapInArrow(by_rows(run, ["doc", "ref", "_other"], [("quote", pa.string()), ("start", pa.int64()), ("end", pa.int64())]), f"doc {doc}, ref {ref}, _other {ref}, quote string, start bigint, end bigint")
    return found.select("doc", "ref", "quote", F.struct(F.col("_other").alias("ref"), "start", "end").alias("found"))


def resolve(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes (doc, ref, quote) with start, end (code points), method, error and source_ref, against sources (doc, ref, text).

    Exact hits are native; only the others go to Arrow batches, brought together by source, which is folded once: typography variants,
    then the only other source of the document and family that holds the quote (method source_reference; source_ref tells which), then one
    typo in a long word that is no qualifier, between unchanged words and in one place only.  Equal quotes of one source are one row each.
    What was tried is written once, so that the texts are folded once for it.
    """
    both = quotes.join(sources.hint("merge"), ["doc", "ref"], "left").withColumn("at", F.expr("instr(text, quote)"))
    exact = both.filter("at > 0").select("doc", "ref", "quote", (F.col("at") - 1).cast("bigint").alias("start"), (F.col("at") - 1 + F.length("quote")).cast("bigint").alias("end"), F.lit("exact").alias("method"), F.lit(None).cast("string").alias("error"))

    def run(doc, ref, asked: list[str], text: str | None) -> Iterator[tuple]:
        folded = None if text is None else normalized(text)
        for quote in asked:
            span, how, error = None, None, None
            if folded is None:
                error = "no source"
            elif not quote:
                error = "no quote"
            elif span := _span_in(quote, folded):
                how = "typography"
            elif span := _typo_span_in(quote, folded):
                how = "typo"
            else:
                error = "not found"
            yield doc, ref, quote, *(span or (None, None)), how, error

    rest = both.filter("at IS NULL OR at = 0").withColumn("quote", F.coalesce("quote", F.lit("")))
    rest = rest.groupBy("doc", "ref").agg(F.collect_list("quote").alias("asked"), F.first("text").alias("text"))
    kinds = f"doc {both.schema['doc'].dataType.simpleString()}, ref {both.schema['ref'].dataType.simpleString()}"
    fields = [("quote", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("method", pa.string()), ("error", pa.string())]
    tried = rest.mapInArrow(by_rows(run, ["doc", "ref"], fields), f"{kinds}, quote string, start bigint, end bigint, method string, error string")
    path = scratch(quotes.sparkSession, "tried")
    tried.write.parquet(path)
    tried = quotes.sparkSession.read.parquet(path)
    missed = (F.col("method").isNull() | (F.col("method") == "typo")) & (F.coalesce("quote", F.lit("")) != "")
    own = tried.join(_elsewhere(tried.filter(missed).select("doc", "ref", "quote"), sources).hint("shuffle_hash"), ["doc", "ref", "quote"], "left")
    moved = F.col("found").isNotNull()
    put = {"start": F.col("found.start"), "end": F.col("found.end"), "method": F.lit("source_reference"), "error": F.lit(None).cast("string")}
    own = own.select("doc", "ref", "quote", *(F.when(moved, x).otherwise(F.col(c)).alias(c) for c, x in put.items()), F.coalesce("found.ref", F.when(F.col("method").isNotNull(), F.col("ref"))).alias("source_ref"))
    return exact.withColumn("source_ref", F.col("ref")).unionByName(own)


def sources_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", title: str | None = None, company: str | None = None, location: str | None = None, criteria: str | None = None, legacy: str | None = None, shortest: int = 80, longest: int = 500_000) -> DataFrame:
    """(doc, ref, pos, text, quality), the sources of each document in order: title, company and location where any of them is named
    (empty if null), its lines as description.<line> from 1, without blank ones, and criteria.<i> from 0 as `label: value`.

    Texts that are shorter, trimmed, than `shortest`, or failure markers, are skipped; longer ones than `longest` bytes refused.  quality is
    public_page, or legacy_completeness_unknown where the column `legacy` says so.  criteria is an array of (label, value).
    """
    ok = docs.filter((F.length(F.trim(text_col)) >= shortest) & (F.trim(text_col) != "FETCH_FAILED") & (F.octet_length(text_col) <= longest))
    quality = F.when(F.coalesce(F.col(legacy), F.lit(False)), "legacy_completeness_unknown").otherwise("public_page") if legacy else F.lit("public_page")
    source = lambda ref, text: F.struct(ref.alias("ref"), text.alias("text"))
    lines = F.transform(F.split(text_col, "\r\n|[\n\r]"), lambda t, i: source(F.concat(F.lit("description."), (i + 1).cast("string")), t))
    parts = [F.filter(lines, lambda x: F.trim(x["text"]) != "")]
    heads = {"title": title, "company": company, "location": location}
    if any(heads.values()):
        parts.insert(0, F.array(*(source(F.lit(n), F.coalesce(F.col(c).cast("string"), F.lit("")) if c else F.lit("")) for n, c in heads.items())))
    if criteria:
        parts.append(F.transform(F.coalesce(F.col(criteria), F.array()), lambda x, i: source(F.concat(F.lit("criteria."), i.cast("string")), F.concat(x["label"], F.lit(": "), x["value"]))))
    return ok.select(F.col(id_col).alias("doc"), quality.alias("quality"), F.posexplode(F.concat(*parts)).alias("pos", "s")).select("doc", "s.ref", F.col("pos").cast("bigint").alias("pos"), "s.text", "quality")
