"""Near-duplicate embeddings against all cosines."""

import math
import random

import numpy as np
import pytest

from resight.llm import components, neighbours


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, least=0.9):
    """(id, n_links, component) for rows with unique ids."""
    near = {i: set() for i, _ in rows}
    live = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v in rows if valid(v)]
    for k, (i, x) in enumerate(live):
        for j, y in live[:k]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                near[i].add(j)
                near[j].add(i)
    root, order = {}, sorted(near, key=lambda x: (x is not None, x))
    for i in order:
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += near[x]
    return sorted((i, len(near[i]), root[i]) for i in near)


def found(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").repartition(3)
    out = neighbours.near_duplicates(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in out)


def clustered(n=400, dims=16, seed=1, copies=30):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims))
    near = base[rng.integers(0, 20, n)] + rng.normal(size=(n, dims)) * rng.uniform(0, 0.6, (n, 1))
    v = np.concatenate([base, near, np.repeat(base[:1], copies, axis=0)]).astype(np.float32)
    return [(int(i), [float(x) for x in row], 0) for i, row in zip(rng.permutation(len(v)) * 3, v, strict=True)]


def test_every_link_is_found(spark):
    rows = clustered()
    want = plain([r[:2] for r in rows])
    got = found(spark, rows)
    assert sum(x[1] for x in want) > 2000 and [x[0] for x in got] == [x[0] for x in want]
    assert got == want


def test_recall_of_links_near_the_threshold(spark, monkeypatch):
    """Directions without any clusters, in 64 dimensions, each with a partner that is barely linked: the hardest case for the lists."""
    monkeypatch.setattr(neighbours, "LISTS_PER_ROOT", 1.0)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = rng.normal(size=x.shape)
    u -= (u * x).sum(1, keepdims=True) * x
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    y = 0.905 * x + math.sqrt(1 - 0.905**2) * u
    got = found(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(np.concatenate([x, y]))], "double")
    links = sum(n for _, n, _ in got) / 2
    assert 0.99 * 1500 <= links <= 1500


def test_parts_and_turns_of_a_list(spark, monkeypatch):
    rows = clustered(seed=4)
    for name, value in (("HOME", 40), ("PAIRS", 3000), ("SAMPLE", 100)):
        monkeypatch.setattr(neighbours, name, value)
    assert found(spark, rows) == plain([r[:2] for r in rows])


def test_no_vector_within_reach_is_passed_over_in_a_list(monkeypatch):
    for name, value in (("_ROWS", 16), ("_GUESTS", 8), ("_EXACT", 10)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 10)) * 0.6 + 1
    index = neighbours.Index.fit(neighbours._unit(x[:60]), 3, 0.9)
    many = np.arange(len(x))
    home = neighbours._Home(index, 1, [(many, many, np.full(len(x), 10), x, [np.zeros(0, np.int64)] * len(x))])
    got = {(int(a), int(b)) for g, o in home.near(index, x, math.sqrt(0.2)) for a, b in zip(g, o, strict=True)}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(unit @ unit.T >= 0.9)), strict=True))
    assert want <= got and len(got) < len(x) ** 2


@pytest.mark.parametrize("limit", [0, 10**6])
def test_small_and_large_link_tables(spark, limit):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(None, 3), (7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a bigint, b bigint"), limit).collect()))
    root = list(range(300))
    for _ in range(300):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {i: r for i, r in enumerate(root) if r != i}


def test_odd_vectors_have_no_links(spark):
    big = 3e38
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [big, 0.0], 0), (11, [1e-40, 0.0], 0), (12, [-1.0, 0.0], 0), (13, [-0.0, 1.0], 0), (14, [0.0, 1.0], 0)]
    got = {i: (n, c) for i, n, c in found(spark, rows)}
    assert {i for i, (n, _) in got.items() if not n} == {3, 4, 5, 6, 7, 8, 9, 12}
    assert all(got[i] == (3, 1) for i in (1, 2, 10, 11)) and got[13] == got[14] == (1, 13)


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, cls int")
    assert neighbours.near_duplicates(empty).collect() == []
    v = [0.5, 0.25]
    rows = [("b", v, 1), ("a", v, 2), (None, v, 3), ("a", v, 4), ("z", [1.0, -2.0], 5), ("c", None, 6)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, n int")
    got = sorted(neighbours.near_duplicates(df).collect(), key=str)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("None", 3, "None", True), ("a", 3, "None", False), ("a", 3, "None", False), ("b", 3, "None", False), ("c", 0, "c", True), ("z", 0, "z", True)]
