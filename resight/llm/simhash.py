"""SimHash fingerprints and exact near-duplicate groups by tiled comparison.

Fingerprints of near copies differ in a few bits.  All pairs of different fingerprints are compared, tile
against tile, with numpy exclusive-or and bit counts.  Two fingerprints within `radius` bits have population
counts that differ by `radius` at most, in the whole and summed over their four 16-bit words; so tiles are cut
by these four counts, and pairs of tiles further apart than the radius are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import ordered, schema_of, written
from .components import components, forest

#: Fingerprints of a tile that is at home in a task, about (they are dealt by hash), and of a piece of a tile.
HOME, PIECE = 1 << 18, 1 << 13
#: Pairs that one task compares, about.
PAIRS = 1 << 37
_BLOCK = 512


def fingerprint_rows(column: pa.Array, shingle: int) -> np.ndarray:
    """64-bit SimHash of each text, unsigned."""
    buf, off = B.text_bytes(column)
    out = np.zeros(len(off) - 1, B.U64)
    for lo, hi in B.row_slices(column):
        text, start = B.joined(buf, off, lo, hi, 1, 32)
        text = B.LOWER[text]
        first, last = B.tokens(~B.IS_BLANK[text])
        if not len(first):
            continue
        # words with one space between them, so that a shingle is one byte range
        keep = ~B.IS_BLANK[text]
        keep[last] = True
        new = np.cumsum(keep) - 1
        text = text[keep]
        text[B.IS_BLANK[text]] = 32
        row = np.searchsorted(start, first, side="right") - 1
        first, last = new[first], new[last]
        words = np.bincount(row, minlength=hi - lo)
        begin = np.cumsum(words) - words
        n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        span = np.repeat(np.minimum(words, shingle), n)
        h = B.xxh64(text, first[at], last[at + span - 1])
        out[lo:hi] = B.majority_bits(h, np.cumsum(n) - n, n)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs with text_col replaced by `_fp`, the SimHash of the text as a bigint (the same 64 bits).

    Bits are set where over half of the XXH64 values (seed 42) of the text's word shingles have them; shingles
    count as often as they occur.  A text of fewer words is one shingle; a text without words, empty or null, has
    fingerprint zero.
    """
    rest = [f for f in docs.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprint_rows(b.column(text_col), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), fp], names=[*(f.name for f in rest), "_fp"])

    return docs.mapInArrow(run, schema_of(rest, "_fp bigint"))


def _near(home: np.ndarray, guest: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in home and guest of pairs within the radius, a block of pairs at a time."""
    a, b = [], []
    for i in range(0, len(home), _BLOCK):
        part = home[i : i + _BLOCK, None]
        for j in range(0, len(guest), _BLOCK):
            x, y = np.nonzero(np.bitwise_count(part ^ guest[None, j : j + _BLOCK]) <= radius)
            if len(x):
                a.append(x + i)
                b.append(y + j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home = None, []  # the home tile of the key, which may come in pieces

        for batch in batches:
            keys, guests = batch.column("key").to_numpy(), batch.column("guest").to_numpy(zero_copy_only=False)
            flat, size = batch.column("fps").flatten().to_numpy().view(B.U64), batch.column("fps").value_lengths().to_numpy()
            end = np.cumsum(size)
            found = []
            for i in range(batch.num_rows):
                part = flat[end[i] - size[i] : end[i]]
                if keys[i] != key:
                    key, home = keys[i], []
                for own in home:
                    x, y = _near(own, part, radius)
                    found.append((own[x], part[y]))
                if not guests[i]:
                    x, y = _near(part, part, radius)
                    found.append((part[x[x < y]], part[y[x < y]]))
                    home.append(part.copy())
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, B.U64),) * 2
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = 3, home: int = HOME, piece: int = PIECE, pairs: int = PAIRS) -> DataFrame:
    """Links (a, b) between different fingerprints at `radius` or fewer differing bits.

    prints (_fp) holds every fingerprint once.  Every pair within the radius is found; of the links of some pieces of
    tiles a spanning forest is returned, which connects the same ones.

    A cell is a combination of word counts, at most 17^4 of them: tables of a few numbers for each are broadcast.  Its fingerprints
    are dealt to tiles of about `home`.  A tile is at home in one task, or in several if it has more than `pairs` pairs to compare, and all cells that
    are near enough come to it as guests, in pieces; so a fingerprint is sent to about 65 tasks times its cell's number of tiles.
    """
    spark = prints.sparkSession
    counts = [F.bit_count(F.shiftrightunsigned("_fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    code = sum(c.cast("bigint") * 17**i for i, c in enumerate(counts))
    coded = prints.select("_fp", code.alias("cell"))
    cells = written(coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("tiles", F.expr(f"cast(ceil(n / {home}) AS bigint)")), "cells")

    reach = range(-radius, radius + 1)
    steps = [(d0, d1, d2, d3) for d0 in reach for d1 in reach for d2 in reach for d3 in reach if abs(d0) + abs(d1) + abs(d2) + abs(d3) <= radius]
    steps = [s for s in steps if sum(d * 17**i for i, d in enumerate(s)) >= 0]
    word = lambda i: F.expr(f"cell div {17**i} % 17")
    inside = [(word(i) + F.col(f"d{i}")).between(0, 16) for i in range(4)]
    near = cells.select("cell", "n").withColumn("s", F.explode(F.array(*(F.struct(*(F.lit(d).alias(f"d{i}") for i, d in enumerate(s))) for s in steps))))
    near = near.select("cell", "n", "s.*").filter(inside[0] & inside[1] & inside[2] & inside[3])
    near = near.withColumn("other", F.expr("cell + d0 + 17L * d1 + 289L * d2 + 4913L * d3"))
    near = written(near.join(F.broadcast(cells.selectExpr("cell AS other", "tiles", "n AS own")), "other"), "near")  # cell comes to other
    turns = near.groupBy("other", "tiles").agg(F.expr(f"cast(ceil(sum(n) * max(own) / tiles / {pairs}) AS bigint)").alias("turns"))
    near = near.join(F.broadcast(turns), ["other", "tiles"]).groupBy("cell").agg(F.collect_list(F.struct("other", "tiles", "turns")).alias("goals"))

    coded = coded.join(F.broadcast(cells), "cell").withColumn("nth", F.pmod(F.xxhash64("_fp"), "tiles"))
    coded = coded.withColumn("bit", F.pmod(F.xxhash64("_fp", F.lit(1)), F.expr(f"cast(ceil(n / tiles / {piece}) AS bigint)")))
    pieces = written(coded.groupBy("cell", "nth", "bit").agg(F.collect_list("_fp").alias("fps")).join(F.broadcast(turns.selectExpr("other AS cell", "turns")), "cell"), "pieces")
    # pieces of a home tile meet each other there; of others only those of later tiles of the cell
    homes = pieces.withColumn("turn", F.explode(F.expr("sequence(0L, turns - 1)"))).select("cell", "nth", "turn", F.lit(False).alias("guest"), "fps")
    guests = (
        pieces.join(near.hint("merge"), "cell")
        .withColumn("goal", F.explode("goals"))
        .withColumn("to", F.explode(F.expr("sequence(0L, goal.tiles - 1)")))
        .filter("goal.other <> cell OR to > nth")
        .select(F.col("goal.other").alias("cell"), F.col("to").alias("nth"), F.expr("pmod(xxhash64(cell, nth, bit), goal.turns)").alias("turn"), F.lit(True).alias("guest"), "fps")
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    dealt = homes.unionByName(guests).withColumn("key", F.xxhash64("cell", "nth", "turn")).select("key", "guest", "fps")
    return dealt.repartition(n, "key").sortWithinPartitions("key", "guest").mapInArrow(_compare(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(id_col, _ord, _fp, _root, component): the group of each document over links at `radius` or fewer bits.

    component is the smallest id the document reaches over links, itself included; _root the same as `_ord`, a unique
    order of the rows, so that `_ord = _root` holds for one row of each group.  Texts without words, empty or null, have
    fingerprint zero and are linked like any other.  Rows of equal ids count as rows of their own; null ids come
    first in the order.  An empty table gives an empty result.  Other columns are not looked at.  Whole texts are read, a slice of texts
    at a time or one that is longer.
    """
    return _groups(*ordered(docs, id_col, text_col), id_col, text_col, shingle, radius)


def _groups(rows: DataFrame, direct: bool, id_col: str, text_col: str, shingle: int, radius: int) -> DataFrame:
    prints = written(fingerprints(rows.select(id_col, "_ord", text_col), text_col, shingle), "fingerprints")
    distinct = written(prints.groupBy("_fp").agg(F.min("_ord").alias("id")), "distinct")
    found = components(links(distinct, radius))
    of = distinct.join(found.hint("merge"), F.col("_fp") == F.col("node"), "left").select("_fp", "id", F.coalesce("root", "_fp").alias("group"))
    first = of.groupBy("group").agg(F.min("id").alias("_root"))
    of = of.join(first.hint("merge"), "group").select("_fp", "_root")
    out = prints.join(of.hint("merge"), "_fp").select(id_col, "_ord", "_fp", "_root")
    if direct:
        return out.withColumn("component", F.col("_root"))
    names = out.groupBy("_root").agg(F.min(id_col).alias("component"))
    return out.join(names.hint("merge"), "_root").select(id_col, "_ord", "_fp", "_root", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each group of near copies, that which comes first by id; all columns stay."""
    packed = docs.select(F.struct("*").alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows, direct = ordered(packed, "_id", "_text", "_doc")
    kept = _groups(rows, direct, "_id", "_text", shingle, radius).filter("_ord = _root").select("_ord")
    return rows.join(kept.hint("merge"), "_ord", "left_semi").select("_doc.*")
