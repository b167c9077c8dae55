"""The source divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from resight.llm import divergence

from . import cases

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(cases.lower(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(w for x, _, words in docs if x == lang for w in set(words))
        kept = {w for w, n in seen.items() if n >= least}
        count = defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                count[source].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, w: 1 + (10**9 * (c[w] + 1)) // (sum(c.values()) + len(kept))
        far = lambda p, q: (p - q) ** 2 // q
        for s in count:
            pairs = [(o, sum(far(share(count[s], w), share(count[o], w)) for w in kept)) for o in count if o != s]
            terms = [(w, far(share(count[s], w), share(whole, w))) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def audit(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **how).collect())


def some_rows(seed=3, n=120):
    rng = random.Random(seed)
    words = "the of and Straße naïve x zażółć 東京 a1b2 don't".split() + [f"w{'abcdefghij'[i % 10]}{'klm'[i // 10]}" for i in range(30)]
    texts = [" ".join(rng.choices(words, weights=[1 + 30 // (i + 1) for i in range(len(words))], k=rng.choice([0, 1, 5, 40]))) for _ in range(n)]
    rows = [(t, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "a", "a", "b", "B", None, "ä"])) for t in texts]
    return rows + [(texts[3], "en", "a")] * 40 + [(texts[3], "en", "b")] * 3 + [(None, "en", "empty"), ("12 34", "en", "digits"), ("one one two", "single", "s")]


def test_as_counted_plainly(spark):
    rows = some_rows()
    assert audit(spark, rows) == plain(rows)
    assert {r[1] for r in audit(spark, rows) if r[2] == "pair"} >= {"empty", "digits"}


def test_small_tiles_blocks_and_tasks_give_the_same(spark, monkeypatch):
    rows = some_rows(seed=9)
    want = plain(rows, top=4)
    for name, value in (("TILE", 2), ("BLOCK_ROWS", 20), ("BROADCAST_GROUPS", 0)):
        monkeypatch.setattr(divergence, name, value)
    assert [r for r in audit(spark, rows, top_terms=4)] == want


def test_words_are_counted_in_pieces(monkeypatch):
    text = ("Ab cd,ef Ab " * 50).encode()
    whole = divergence._counted(text)
    monkeypatch.setattr(divergence, "_PIECE", 7)
    assert divergence._counted(text) == whole == {b"ab": 100, b"cd": 50, b"ef": 50}


def test_flushes_keep_sums(spark, monkeypatch):
    batches = [(("en", t.encode(), [{"source": "a", "n": 2}, {"source": "b", "n": 1}])) for t in ("x y x", "y z", "x")]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([b[i] for b in batches]) for i in range(3)], names=["lang", "text", "sources"])
    sums = Counter()
    monkeypatch.setattr(divergence, "_HELD", 2)
    for out in divergence._tokenize(iter([batch])):
        for r in out.to_pylist():
            sums[r["source"], r["term"], "n"] += r["n"]
            sums[r["source"], r["term"], "docs"] += r["docs"]
    assert sums["a", "x", "n"] == 6 and sums["a", "x", "docs"] == 4 and sums["b", "y", "n"] == 2 and sums["b", "z", "docs"] == 1


def test_awkward_tables(spark):
    assert audit(spark, []) == []
    rows = [tuple(r[k] for k in (1, 2, 3)) for r in cases.rows(unique=False)]
    assert sorted(tuple(r) for r in divergence.audit(cases.frame(spark, unique=False).withColumnRenamed("n", "term")).collect()) == plain(rows)


@pytest.mark.parametrize("count", [5, 3_000_000_000])
def test_large_counts_stay_exact(spark, count):
    df = spark.createDataFrame([(count, count * 7, 5)], "n bigint, total bigint, v bigint")
    assert df.select(divergence._share("n", "total", "v")).first()[0] == 1 + 10**9 * (count + 1) // (count * 7 + 5)
