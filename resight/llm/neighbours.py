"""Near-duplicate embeddings by product quantisation, with exact cosines for the pairs that remain.

Coarse inverted lists: every vector belongs to the list of its nearest centroid.  In a list, the residual of a vector is coded in a few
subspaces.  A vector probes its own list and those of centroids that are little further; there a table of distances to the codewords, one for
each subspace, gives its distance to every coded vector.  A code keeps how far its vector is from it, so no vector within the threshold
is passed over in a probed list; what may be within is compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import ordered, written
from .components import components, forest

#: Vectors that the centroids and codewords are fitted on, at most: a sample by hash that the driver holds.
SAMPLE = 1 << 16
#: Lists: about the root of the number of vectors over LISTS_PER_ROOT, at most MOST_LISTS; subspaces and codewords of each.
LISTS_PER_ROOT, MOST_LISTS = 3.5, 2048
SUBSPACES, CODEWORDS = 8, 256
#: How many standard deviations of a link's direction the probes allow for.
SURE = 3.0
#: Vectors of a list that are at home in a task, about, and pairs that one task compares, about.
HOME, PAIRS = 1 << 16, 1 << 34
_ROUNDS = 8
_ROWS, _GUESTS = 4096, 64
_EXACT = 1 << 14


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for lo in range(0, len(x), _ROWS):
        part = x[lo : lo + _ROWS]
        out[lo : lo + _ROWS] = ((centres * centres).sum(1)[None, :] - 2 * (part @ centres.T)).argmin(axis=1)
    return out


def _means(x: np.ndarray, k: int, on_sphere: bool) -> np.ndarray:
    """k-means from the first k vectors of the sample, which is in the order of a hash; a centre without vectors stays."""
    centres = x[:k].copy()
    for _ in range(_ROUNDS):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        some = np.flatnonzero(n)
        sums = np.add.reduceat(x[np.argsort(at, kind="stable")], (np.cumsum(n) - n)[some], axis=0)
        centres[some] = sums / n[some, None].astype(np.float32)
        if on_sphere:
            length = np.linalg.norm(centres, axis=1)
            centres = np.where(length[:, None] > 1e-6, centres / np.maximum(length, 1e-6)[:, None], x[:k])
    return centres


@dataclass
class Index:
    """Centroids of unit length, and the codewords of residuals by subspace; vectors are padded with zeros to subspaces of equal width."""

    centroids: np.ndarray
    codewords: np.ndarray
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, least: float) -> Index:
        width = -(-max(sample.shape[1], 1) // SUBSPACES)
        x = np.zeros((len(sample), SUBSPACES * width), np.float32)
        x[:, : sample.shape[1]] = sample
        if not len(x):
            x = np.zeros((1, x.shape[1]), np.float32)
        centroids = _means(x, min(lists, len(x)), True)
        rest = (x - centroids[_nearest(x, centroids)]).reshape(len(x), SUBSPACES, width)
        codewords = np.stack([_means(np.ascontiguousarray(rest[:, s]), min(CODEWORDS, len(x)), False) for s in range(SUBSPACES)])
        # x and y = least * x + sqrt(1 - least^2) * u, u any direction across x: the difference of y's cosines to two centroids, which are about at
        # right angles, spreads by sqrt(2 / dimensions) times that root.  A link is lost if neither end probes the other's list.
        margin = SURE * math.sqrt(max(0.0, 1 - least * least)) * math.sqrt(2 / max(sample.shape[1], 1)) / (1 + max(least, 0.0))
        return cls(centroids, codewords, margin)

    def padded(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.centroids.shape[1]), np.float32)
        out[:, : x.shape[1]] = x
        return out

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and the other lists that it probes."""
        home, out = np.empty(len(x), np.int64), []
        for lo in range(0, len(x), _ROWS):
            near = self.padded(x[lo : lo + _ROWS]) @ self.centroids.T
            best = near.argmax(axis=1)
            home[lo : lo + _ROWS] = best
            also = near >= near.max(axis=1)[:, None] - self.margin
            also[np.arange(len(best)), best] = False
            row, to = np.nonzero(also)
            out += np.split(to, np.searchsorted(row, np.arange(1, len(best))))
        return home, out

    def codes(self, x: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """A code of each vector of a list, by subspace, and how far the vector is from what the code says."""
        rest = (self.padded(x) - self.centroids[home]).reshape(len(x), SUBSPACES, -1)
        code = np.stack([_nearest(np.ascontiguousarray(rest[:, s]), self.codewords[s]) for s in range(SUBSPACES)])
        off = sum(((rest[:, s] - self.codewords[s][code[s]]) ** 2).sum(axis=1) for s in range(SUBSPACES))
        return code, np.sqrt(off)

    def tables(self, x: np.ndarray, home: int) -> np.ndarray:
        """Squared distances by subspace, codeword and vector."""
        rest = (self.padded(x) - self.centroids[home]).reshape(len(x), SUBSPACES, -1)
        return np.stack([((self.codewords[s] ** 2).sum(1)[:, None] - 2 * self.codewords[s] @ rest[:, s].T) + (rest[:, s] ** 2).sum(1)[None, :] for s in range(SUBSPACES)])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _scaled(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as doubles over their largest component, padded with zeros: no length over- or underflows."""
    size = vectors.value_lengths().to_numpy()
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims)[None, :] < size[:, None]] = vectors.flatten().to_numpy().astype(np.float64)
    return out / np.abs(out).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec, cls, n): the different vectors that can have links, with their smallest order and how many rows have them."""
    some = vectors.filter(F.expr(f"{vector_col} IS NOT NULL AND size({vector_col}) > 0 AND forall({vector_col}, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists({vector_col}, v -> v <> 0)"))
    return some.groupBy(F.col(vector_col).alias("vec")).agg(F.min("_ord").alias("cls"), F.count(F.lit(1)).alias("n"))


class _Home:
    """The vectors of a list, or of a part of it, with their codes."""

    def __init__(self, index: Index, at: int, rows: list[tuple]):
        self.ids, self.sizes, self.dims = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2))
        self.vectors = np.concatenate([r[3] for r in rows])
        self.probes = [p for r in rows for p in r[4]]
        self.at = at
        self.code, self.off = index.codes(_unit(self.vectors), at)
        self.lists = np.unique(np.repeat(np.arange(len(self.ids)), [len(p) for p in self.probes]) * (1 << 20) + np.concatenate([*self.probes, np.zeros(0, np.int64)]).astype(np.int64))

    def near(self, index: Index, guests: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of guests and of own vectors that may be within reach, a block at a time."""
        unit = _unit(guests)
        for lo in range(0, len(guests), _GUESTS):
            table = index.tables(unit[lo : lo + _GUESTS], self.at)
            for begin in range(0, len(self.ids), _ROWS):
                code = self.code[:, begin : begin + _ROWS]
                far = table[0][code[0]]
                for s in range(1, SUBSPACES):
                    far += table[s][code[s]]
                own, guest = np.nonzero(far <= ((self.off[begin : begin + _ROWS] + reach) ** 2)[:, None])
                for k in range(0, len(own), _EXACT):
                    yield guest[k : k + _EXACT] + lo, own[k : k + _EXACT] + begin


def _compare(sent, least: float, dims: int):
    reach = math.sqrt(2 - 2 * least) + 1e-4

    def pairs(index: Index, home: _Home, ids: np.ndarray, sizes: np.ndarray, lists: np.ndarray, width: np.ndarray, vectors: np.ndarray, guests: bool) -> Iterator[pa.RecordBatch]:
        a, b, n = [], [], []
        for x, y in home.near(index, vectors, reach):
            keep = width[x] == home.dims[y]
            if guests:  # a pair that is met in both lists counts in the list of the larger number
                twice = np.isin(y * (1 << 20) + lists[x], home.lists)
                keep &= (home.at > lists[x]) | (~twice & (home.at != lists[x])) | ((home.at == lists[x]) & (ids[x] != home.ids[y]))
            else:
                keep &= ids[x] < home.ids[y]
            x, y = x[keep], y[keep]
            x, y = (z[cosines(vectors[x], home.vectors[y]) >= least] for z in (x, y))
            if len(x):
                a.append(np.stack([ids[x], home.ids[y]]))
                n.append(np.stack([home.sizes[y], sizes[x]]))
            if sum(z.shape[1] for z in a) > 1 << 20:
                yield found(a, n)
                a, n = [], []
        if a:
            yield found(a, n)

    def found(a: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        """Numbers of linked rows by class, b null, and links that connect the same classes."""
        ends, more = np.concatenate(a, axis=1), np.concatenate(n, axis=1)
        names, place = np.unique(ends.ravel(), return_inverse=True)
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, place, more.ravel())
        x, y = forest(ends[0], ends[1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([names, x])), pa.concat_arrays([pa.nulls(len(names), pa.int64()), pa.array(y)]), pa.array(np.concatenate([sums, np.zeros(len(x), np.int64)]))], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, key, rows, home = sent.value, None, [], None
        for b in batches:
            keys, guest = b.column("key").to_numpy(), b.column("guest").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (guest[1:] != guest[:-1])])) if b.num_rows else []
            for lo, hi in zip(edge, [*edge[1:], b.num_rows], strict=True):
                part = b.slice(lo, hi - lo)
                of = [part.column(c).to_numpy() for c in ("cls", "n", "home")]
                vec, probes = part.column("vec"), part.column("probes")
                row = (of[0], of[1], vec.value_lengths().to_numpy(), _scaled(vec, dims), np.split(probes.flatten().to_numpy(), np.cumsum(probes.value_lengths().to_numpy())[:-1]))
                if keys[lo] != key:
                    if rows:
                        yield from inside(index, rows, at)
                    key, rows, home, at = keys[lo], [], None, int(part.column("list")[0].as_py())
                if not guest[lo]:
                    rows.append((*row, of[2], part.column("inside").to_numpy(zero_copy_only=False)))
                elif rows or home:
                    if home is None:
                        home = _Home(index, at, rows)
                        yield from inside(index, rows, at, home)
                        rows = []
                    yield from pairs(index, home, of[0], of[1], of[2], row[2], row[3], True)
        if rows:
            yield from inside(index, rows, at)

    def inside(index: Index, rows: list[tuple], at: int, home: _Home | None = None) -> Iterator[pa.RecordBatch]:
        """Pairs of the vectors at home; of a part that is at home in several tasks, in the first only."""
        if rows[0][6][0]:
            home = home or _Home(index, at, rows)
            yield from pairs(index, home, home.ids, home.sizes, np.full(len(home.ids), at), home.dims, home.vectors, False)

    return run


def links(found: DataFrame, least: float, dims: int, total: int) -> DataFrame:
    """(a, b, n) from classes (vec, cls, n): numbers n of linked rows by class a, b null, to be summed; and links (a, b) that connect what
    all pairs with a cosine of `least` or more connect."""
    spark = found.sparkSession
    share = min(1.0, SAMPLE / max(total, 1)) * 0.98
    sample = found.filter(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(share * (1 << 30)) if total > SAMPLE else F.lit(True)).select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
    lists = max(1, min(MOST_LISTS, int(math.sqrt(total) / LISTS_PER_ROOT)))
    index = Index.fit(_unit(_scaled(sample.column("vec").combine_chunks(), dims)) if len(sample) else np.zeros((0, dims)), lists, least)
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, probes = sent.value.probes(_unit(_scaled(b.column("vec"), dims)))
            ends = np.cumsum([0, *(len(p) for p in probes)]).astype(np.int32)
            flat = np.concatenate([*probes, np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec", "cls", "n")), pa.array(home.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vec", "cls", "n", "home", "probes"])

    kind = found.schema["vec"].dataType.simpleString()
    placed = written(found.select("vec", "cls", "n").mapInArrow(place, f"vec {kind}, cls bigint, n bigint, home int, probes array<int>"), "placed")
    # a row for each list: how many vectors, in how many parts, and for how many tasks each part has pairs to compare
    own = placed.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("own"))
    more = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("more"))
    sizes = written(own.join(more.hint("shuffle_hash"), "list", "left").selectExpr("list", f"cast(ceil(own / {HOME}) AS bigint) AS parts", f"greatest(1L, cast(ceil(own * (own + coalesce(more, 0L)) / ceil(own / {HOME}) / {PAIRS}) AS bigint)) AS turns"), "lists")
    part = F.pmod(F.xxhash64("cls"), "parts")
    base = ["vec", "cls", "n", "home", "probes"]
    homes = placed.join(F.broadcast(sizes), F.col("home") == F.col("list")).withColumn("part", part).withColumn("turn", F.explode(F.expr("sequence(0L, turns - 1L)")))
    homes = homes.select(*base, "list", "part", "turn", F.lit(False).alias("guest"), F.expr("turn = 0L").alias("inside"))
    # guests: of other lists that probe this one, and of earlier parts of the same list
    guests = placed.withColumn("to", F.explode(F.concat(F.array("home"), "probes"))).join(F.broadcast(sizes), F.col("to") == F.col("list")).withColumn("own", part)
    guests = guests.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1L)"))).filter("home <> list OR part > own")
    guests = guests.select(*base, "list", "part", F.expr("pmod(xxhash64(cls, 1), turns)").alias("turn"), F.lit(True).alias("guest"), F.lit(False).alias("inside"))
    dealt = homes.unionByName(guests).withColumn("key", F.xxhash64("list", "part", "turn"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    dealt = dealt.select("key", "guest", "inside", "list", *base).repartition(n, "key").sortWithinPartitions("key", "guest")
    return dealt.mapInArrow(_compare(sent, least, dims), "a bigint, b bigint, n bigint")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: how many other rows have a cosine of `least` or more with it, the
    smallest id that it reaches over such links, itself included, and whether that is its own.

    Equal vectors are one class and linked with each other.  A vector that is null, empty or zero, or has a null or non-finite component, has no links;
    vectors of different lengths aren't linked.  Cosines are in double precision; no pair below `least` is linked.  The index is fitted on SAMPLE vectors at
    most and holds all; a pair of different vectors is missed only if neither end probes the list of the other, which the margin makes rare (a test
    measures recall against brute force).  Rows of equal ids are rows of their own, of which only the first is kept; null ids come first in the order; an empty table
    gives an empty result; other columns aren't looked at.
    """
    rows, direct = ordered(vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vec")), "_id", "_vec")
    if not isinstance(rows.schema["_vec"].dataType, T.ArrayType):
        raise TypeError(f"{vector_col} must be an array of numbers")
    found = written(classes(rows, "_id", "_vec"), "vectors")
    seen = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    pairs = written(links(found, least, seen["dims"] or 1, seen["n"]), "pairs")
    roots = components(pairs.filter("b IS NOT NULL").select("a", "b"))
    counts = pairs.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("more"))
    of = found.join(roots.hint("merge"), F.col("cls") == F.col("node"), "left").join(counts.hint("merge"), F.col("cls") == F.col("a"), "left")
    of = of.select("vec", F.coalesce("root", "cls").alias("_root"), (F.col("n") - 1 + F.coalesce("more", F.lit(0).cast("bigint"))).alias("_links"))
    # back to the rows by their vectors: the classes' side has each vector once
    out = rows.join(of.hint("merge"), F.col("_vec") == F.col("vec"), "left").select("_id", "_ord", F.coalesce("_links", F.lit(0).cast("bigint")).alias("n_links"), F.coalesce("_root", "_ord").alias("_root"))
    if direct:
        named = out.withColumn("component_id", F.col("_root"))
    else:
        names = rows.select(F.col("_ord").alias("_first"), F.col("_id").alias("component_id"))
        named = out.join(names.hint("merge"), F.col("_root") == F.col("_first"))
    return named.select(F.col("_id").alias(id_col), "n_links", "component_id", (F.col("_ord") == F.col("_root")).alias("kept"))
