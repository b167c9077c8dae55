"""Connected components of a table of links, by alternating large-star and small-star steps.

Links of a stated number at most are settled by one task instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written


#: Links of a file of a written table, about.
LINKS_OF_FILE = 200_000
#: Links that one task settles, at most: 16 bytes each, and about five times that while it works.
LINKS_OF_TASK = 1_000_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links a-b connect, fewer than there are ends: from each end that isn't the smallest that it reaches to that."""
    ends, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(ends), place[: len(a)], place[len(a) :])
    moved = np.flatnonzero(root != np.arange(len(ends)))
    return ends[moved], ends[root[moved]]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if parts:
        node, root = forest(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def _written(df: DataFrame, name: str, links: int) -> DataFrame:
    """A table in as many files as its links ask for: small ones don't cost a task for each shuffle partition."""
    return written(df.coalesce(1 + links // LINKS_OF_FILE), name)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, links_of_task: int = LINKS_OF_TASK) -> DataFrame:
    """(node, root) for every node of edges (a, b), bigint: root is the smallest node it reaches.

    Nodes without a link to another node do not appear, nor do roots themselves.  Null ends are ignored.
    Up to `links_of_task` different links are settled by one task; beyond that, every step keeps at most as many rows as links came in, joins on a node with the smallest neighbour of
    it (pre-aggregated), and is written to the shared folder; the driver sees two numbers a step.
    """
    edges = edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    edges = written(edges, "links")
    state = _state(edges)
    if 0 < state[0] <= links_of_task:
        return written(edges.coalesce(1).mapInArrow(_settle, "node bigint, root bigint"), "roots")
    while state[0]:
        n = state[0]
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        # written, so that both sides of the join are dealt by an exchange of their own and Spark can split a hot root
        least = _written(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m"), "least", 2 * n)
        large = edges.selectExpr("b AS a", "a AS v").join(least.hint("merge"), "a").selectExpr("v AS a", "m AS b").distinct()
        # every remaining link of a points downwards; its targets are linked to the smallest of them
        large = _written(large, "links", n)
        down = _written(large.groupBy("a").agg(F.min("b").alias("m")), "least", n)
        small = large.join(down.hint("merge"), "a").filter("b <> m").selectExpr("b AS a", "m AS b").unionByName(down.selectExpr("a", "m AS b")).distinct()
        edges = _written(small, "links", n)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.selectExpr("a AS node", "b AS root")
