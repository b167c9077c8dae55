"""Source divergence audit: how far the sources of a language are from each other, term by term, in exact whole numbers.

Identical texts of a language are collapsed to one row with the number of copies that each source has.  A text is tokenized once, and its counts
and document frequencies are added for each source that holds it, times its copies.  Pairs of sources are evaluated sparsely: a term
that one of them lacks has that source's share for no occurrence, so only terms that both have are met as pairs; of the others it is enough how
often each count occurs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

#: A term is kept in a language that has it in so many documents.
LEAST_DOCS = 3
#: Terms listed for each source.
TOP_TERMS = 200
#: Shares are in parts of it.
UNIT = 1_000_000_000
#: Sources whose pairs are in one task's matrix.
TILE = 1024
#: Counts that one task of a pair of tiles gets, about.
BLOCK_ROWS = 1 << 19
#: Groups up to which their table is broadcast (a row each); beyond it is joined by sorting.
BROADCAST_GROUPS = 100_000
#: Words that a task holds before it hands on their counts, and bytes of a text that are split at once.
_HELD, _PIECE = 400_000, 4 << 20
_PAIRS = 1 << 19

#: A-Z lower-cased; every byte that is in no term is a blank.  All bytes of code points from 128 on are in terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(data: bytes) -> dict[bytes, int]:
    """How often each term occurs in a text."""
    data, at, out = data.translate(_TERMS), 0, defaultdict(int)
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        for w in data[at:end].split():
            out[w] += 1
        at = end
    return out


def _partial(groups: dict[tuple[str, str], tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in groups.items():
        size = len(n)
        term = pa.array(list(n), pa.binary()).cast(pa.string())
        columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), term, pa.array(list(n.values()), pa.int64()), pa.array([docs[w] for w in n], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict = defaultdict(lambda: (defaultdict(int), defaultdict(int)))
    for b in batches:
        for lang, text, sources in zip(b.column("lang"), b.column("text"), b.column("sources"), strict=True):
            own, lang = _counted(text.as_py()), lang.as_py()
            for x in sources.as_py():
                n, docs = groups[lang, x["source"]]
                for w, k in own.items():
                    n[w] += k * x["n"]
                    docs[w] += x["n"]
                if sum(len(g[0]) for g in groups.values()) > _HELD:
                    yield from _partial(groups)
                    groups.clear()
    yield from _partial(groups)


def collapsed(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, key, text as binary, sources) for each different text of a language; sources holds (source, n) for each source with copies of it, in one
    row as it has at most as many entries as the language has sources.  key is the text's SHA-256.  Nulls are read as ''."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    read = read.withColumn("key", F.unhex(F.sha2("text", 256)))
    copies = read.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "key").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    texts = read.groupBy("lang", "key").agg(F.any_value("text").cast("binary").alias("text"))
    return texts.join(copies.hint("merge"), ["lang", "key"])


def term_counts(docs: DataFrame, **columns) -> DataFrame:
    """(lang, source, term, n, docs): how often a source's documents of a language hold a term, and how many do."""
    found = collapsed(docs, **columns).select("lang", "text", "sources").mapInArrow(_tokenize, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, v: str) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + v)), 1 where there is no term."""
    return F.expr(f"CASE WHEN {v} = 0 THEN 1L ELSE 1L + (cast({UNIT} AS decimal(10,0)) * cast({n} + 1L AS decimal(20,0))) div cast({total} + {v} AS decimal(20,0)) END")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tile_pairs(key: tuple, table: pa.Table, width: int) -> pa.Table:
    """Sums over a block of terms for the ordered pairs of sources, one of each tile of `width` sources (or both of one tile)."""
    lang, t, u, block = (x.as_py() for x in key)
    i, p = table.column("i").to_numpy(), table.column("p").to_numpy()
    whole = table.column("term").is_null().to_numpy()
    order = np.argsort(i[whole])
    names, none, kept, held = (x[whole][order] for x in (i, p, table.column("v").to_numpy(), table.column("held").to_numpy()))
    size = len(names)
    out = np.zeros((size, size), np.int64)
    if block == 0:  # as if no term were in either
        rest = kept[0] - held[:, None] - held[None, :]
        out += rest * _far(none[:, None], none[None, :])
    term = table.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()[~whole]
    s, p = np.searchsorted(names, i[~whole]), p[~whole]

    # as if each term were in one of the two
    by = np.lexsort((p, s))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(s[by]) != 0) | (np.diff(p[by]) != 0)])) if len(s) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([first, [len(s)]]))
    one, share = s[by][first], p[by][first]
    step = max(1, _PAIRS // size)
    for lo in range(0, len(first), step):
        a, x, n = one[lo : lo + step], share[lo : lo + step, None], times[lo : lo + step, None]
        np.add.at(out, a, n * _far(x, none[None, :]))
        np.add.at(out.T, a, n * _far(none[None, :], x))

    # what that misses of terms that are in both
    by = np.argsort(term, kind="stable")
    s, p, term = s[by], p[by], term[by]
    start = np.searchsorted(term, term, side="left")
    many = np.searchsorted(term, term, side="right") - start
    ends = np.cumsum(many)
    lo = 0
    while lo < len(s):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, side="right")))
        k = many[lo:hi]
        a = np.repeat(np.arange(lo, hi), k)
        b = np.repeat(start[lo:hi] - (np.cumsum(k) - k), k) + np.arange(len(a))
        x, y, x0, y0 = p[a], p[b], none[s[a]], none[s[b]]
        np.add.at(out.ravel(), s[a] * size + s[b], _far(x, y) - _far(x, y0) - _far(x0, y) + _far(x0, y0))
        lo = hi
    wanted = ~np.eye(size, dtype=bool) if t == u else (names[:, None] // width) != (names[None, :] // width)
    a, b = np.nonzero(wanted)
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": names[a], "b": names[b], "value": out[a, b]})


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, **columns) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Terms are runs of letters A-Z, lower-cased, and of code points from 128 on; a language keeps those in at least `least_docs` of its
    documents.  A group, a source in a language or the language, gives a kept term the share p = 1 + floor(10^9 * (count + 1) / (N + V)): V kept
    terms, N their occurrences in the group.  How far it is from a share q is floor((p - q)^2 / q).  Part `pair`: item is another source of
    the language, value the sum over all kept terms.  Part `term`: item is a kept term that the source uses more than its language, value how
    far, the first `top_terms`.  Ranks go by value, largest first, then by item.

    Null texts, languages and sources are read as ''.  A source without kept terms has pairs and no terms; a language of one source
    has no pairs; repeated rows count as often as they occur; an empty table gives an empty result.  Whole texts are read, however long; other columns aren't.
    """
    lang_col, source_col = columns.get("lang_col", "lang"), columns.get("source_col", "source")
    terms = written(term_counts(docs, **columns), "terms")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = written(kept.select("lang", "term", F.col("n").alias("in_lang")), "kept")
    counts = written(terms.drop("docs").join(kept.hint("merge"), ["lang", "term"]), "counts")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col)))).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("held"), F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = groups.join(own.hint("merge"), ["lang", "source"], "left").join(langs.hint("merge"), "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("v", "lang_total", "held", "total")), F.expr("cast(row_number() OVER (PARTITION BY lang ORDER BY source) AS bigint) - 1L").alias("i"))
    groups = written(groups, "groups")

    sizes = groups.agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("i"), F.sum("held").alias("rows")).first()
    small = sizes["n"] <= BROADCAST_GROUPS
    beside = F.broadcast(groups) if small else groups.hint("merge")
    counts = counts.join(beside, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))

    value = "((p - q) * (p - q)) div q"
    listed = counts.withColumn("q", _share("in_lang", "lang_total", "v")).filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(value).alias("value"))
    by_value = "row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)"
    listed = listed.withColumn("rank", F.expr(by_value)).filter(F.col("rank") <= top_terms)

    tiles, blocks = (sizes["i"] or 0) // TILE + 1, 1 + (sizes["rows"] or 0) // BLOCK_ROWS
    everywhere = groups.withColumn("p", _share("0L", "total", "v")).withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    everywhere = everywhere.select("lang", "block", "i", F.lit(None).cast("string").alias("term"), "p", "v", "held")
    somewhere = counts.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "i", "term", "p", "v", "held")
    tile = F.expr(f"i div {TILE}")
    met = everywhere.unionByName(somewhere).withColumn("other", F.explode(F.expr(f"sequence(0L, {tiles - 1}L)")))
    met = met.withColumn("t", F.least(tile, "other")).withColumn("u", F.greatest(tile, "other")).drop("other")
    width = TILE
    sums = met.groupBy("lang", "t", "u", "block").applyInArrow(lambda key, rows: _tile_pairs(key, rows, width), "lang string, a bigint, b bigint, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda i, c: (F.broadcast if small else lambda d: d.hint("merge"))(groups.select("lang", F.col("i").alias(i), F.col("source").alias(c)))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value").withColumn("rank", F.expr(by_value))

    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(listed.withColumn("part", F.lit("term")).select(columns))
