import random
import re
from itertools import combinations

import pytest
import xxhash

from resight.llm.components import components
from resight.llm.simhash import keep_one, links, near_duplicates

SCHEMA = "doc_id bigint, text string, _fp string, size int"


def fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) >= 3 else [w] if w else []
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(rows):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if bin(fp[i] ^ fp[j]).count("1") <= 3:
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, fp[i], least[find(i)]) for i, (d, _) in enumerate(rows))


def sample():
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(300)] + ["x" * 40, "Y" * 900]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 90, 400]))) for _ in range(40)]
    for _ in range(80):
        t = rng.choice(texts).split()
        t[rng.randrange(len(t))] = rng.choice(words)
        texts.append("\t ".join(t) if rng.random() < 0.5 else " ".join(t).upper())
    texts += [None, "", " \n", "One two", texts[5], texts[5], "word " * 30000, "a b c"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("unique", [True, False])
def test_groups_equal_brute_force(spark, unique):
    rows = [(7 * i + 3 if unique else (7 * i) % 50, t) for i, t in enumerate(sample())]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = near_duplicates(df).select("doc_id", "_fp", "component", "_root").collect()
    assert sorted((d, f & (2**64 - 1), c) for d, f, c, _ in got) == groups(rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len({r for *_, r in got})


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0 and keep_one(df).count() == 0
    df = spark.createDataFrame([(None, "a b c d", "", 1), (5, "a b c d", "", 1)], SCHEMA)
    assert {r.component for r in near_duplicates(df).collect()} == {5}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 10 for i in range(11, 61)}, **{i: 100 for i in range(101, 140)}, 200: 199}


@pytest.mark.parametrize("how", [{}, {"home": 8, "piece": 3, "pairs": 200}])
def test_links_connect_what_brute_force_connects(spark, how):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for f in sorted(prints):
        for _ in range(rng.randrange(6)):
            f ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 4)))
            prints.add(f & (2**64 - 1))
    signed = sorted(p - 2**64 if p >> 63 else p for p in prints)
    got = links(spark.createDataFrame([(p,) for p in signed], "_fp bigint"), **how).collect()

    def classes(pairs):
        root = {p: p for p in signed}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {p: find(p) for p in signed}

    near = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert len(near) > 60 and classes((r.a, r.b) for r in got) == classes(near)
