"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch is a few cells, each with a count, a sum of digests and a sum of check values.  The cells of two versions subtract;
peeling cells that hold one digest recovers the paragraphs that only one version has.  Where the peeling stops short, it is
done again with a larger sketch.  All documents of a slice are sketched and peeled at the same time in numpy.

A paragraph here is a piece of a line: lines are cut after words whose hash has three low zero bits, so that the pieces
depend on the text near by, not on their place in it, and text without line ends has paragraphs as well.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import ordered, schema_of, written

#: Cells of a fingerprint, three parts of equal size.
CELLS = 12
_CUT = B.U64(7)


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and digest of each different paragraph, by text and digest."""
    rows, digests = [], []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= B.SLICE_BYTES):
            size += len(texts[hi]) + 1
            hi += 1
        buf = np.frombuffer(b"\n".join([*texts[lo:hi], b""]), np.uint8)
        start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[lo:hi]])])
        blank = B.IS_BLANK[buf]
        first, last = B.tokens(~blank)
        if len(first):
            roll = B.RollingHash(buf)
            row = np.searchsorted(start, first, side="right") - 1
            line = np.searchsorted(np.flatnonzero(buf == 10), first)
            word = roll.ranges(first, last)
            ends = (word & _CUT) == 0
            ends[:-1] |= line[1:] != line[:-1]
            ends[-1] = True
            tail = np.flatnonzero(ends)
            head = np.concatenate([[0], tail[:-1] + 1])
            # words of a paragraph in their order, whatever the blanks between them
            place = np.arange(len(word)) - np.repeat(head, tail - head + 1)
            value = np.add.reduceat(B.mixed(word + place.astype(B.U64) * B.U64(0x9E3779B97F4A7C15)), head)
            row, value = row[head] + lo, B.mixed(value)
            once = _once(row, value)
            rows.append(row[once])
            digests.append(value[once])
        lo = hi
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, B.U64)
    return np.concatenate(rows), np.concatenate(digests)


def _once(row: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Places of the first of equal (row, digest), in their order."""
    _, first = np.unique(B.mixed(digest ^ B.mixed(row.astype(B.U64))), return_index=True)
    return np.sort(first)


def _check(digest: np.ndarray) -> np.ndarray:
    return B.mixed(digest ^ B.U64(0xA0761D6478BD642F)) >> B.U64(32)


def _places(row: np.ndarray, digest: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each part, in a flat table of `cells` a row."""
    part = cells // 3
    h = [B.mixed(digest + B.U64(0x632BE59BD9B4E019 * (i + 1) % (1 << 64)) + B.U64(cells)) for i in range(3)]
    return np.stack([row * cells + i * part + (x % B.U64(part)).astype(np.int64) for i, x in enumerate(h)])


class Cells:
    """Sketches of n rows: count, sum of digests, sum of checks."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count, self.digest, self.check = np.zeros(n * cells, np.int64), np.zeros(n * cells, B.U64), np.zeros(n * cells, B.U64)

    def add(self, row: np.ndarray, digest: np.ndarray, sign: np.ndarray | int) -> Cells:
        for at in _places(row, digest, self.cells):
            s = np.broadcast_to(np.asarray(sign, np.int64), at.shape)
            np.add.at(self.count, at, s)
            np.add.at(self.digest, at, digest * s.astype(B.U64))
            np.add.at(self.check, at, _check(digest) * s.astype(B.U64))
        return self

    def minus(self, other: Cells) -> Cells:
        out = Cells(0, self.cells)
        out.count, out.digest, out.check = self.count - other.count, self.digest - other.digest, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row, how many digests only the first and only the second version has, and whether the peeling got to the end.

        The cells are used up.  Cells of false checks can undo each other for ever: there are as many rounds as cells at most.
        """
        n = len(self.count) // self.cells
        one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for _ in range(self.cells):
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at]
            digest = self.digest[at] * sign.astype(B.U64)
            good = self.check[at] * sign.astype(B.U64) == _check(digest)
            at, sign, digest = at[good], sign[good], digest[good]
            if not len(at):
                break
            row = at // self.cells
            once = _once(row, digest)
            row, sign, digest = row[once], sign[once], digest[once]
            one += np.bincount(row[sign > 0], minlength=n)
            two += np.bincount(row[sign < 0], minlength=n)
            self.add(row, digest, -sign)
        rest = self.count.astype(bool) | self.digest.astype(bool)
        return one, two, ~rest.reshape(n, self.cells).any(axis=1)

    def strings(self) -> list[str]:
        n = len(self.count) // self.cells
        cells = np.concatenate([self.count.astype("<i4").view(np.uint8).reshape(-1, 4), self.digest.view(np.uint8).reshape(-1, 8), self.check.astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
        raw = cells.reshape(n, -1)
        return [base64.b64encode(r.tobytes()).decode() for r in raw]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int, base: Cells | None = None) -> np.ndarray:
    """Shared paragraphs over the mean number of paragraphs of n pairs of versions, from peeled differences; two without any are alike.

    a and b are numbers and digests as paragraphs() returns them; base: the difference of their fingerprints.
    """
    size = [np.bincount(x[0], minlength=n) for x in (a, b)]
    out = np.ones(n)
    todo, cells = np.flatnonzero(size[0] + size[1] > 0), base.cells if base else CELLS
    while len(todo):
        if base is not None:
            one, two, done = (x[todo] for x in base.peel())
            base = None
        else:
            number = np.full(n, -1)
            number[todo] = np.arange(len(todo))
            diff = Cells(len(todo), cells)
            for (row, digest), sign in ((a, 1), (b, -1)):
                new = number[row]
                diff.add(new[new >= 0], digest[new >= 0], sign)
            one, two, done = diff.peel()
        own, other = size[0][todo], size[1][todo]
        both = own - one
        sure = done & (both >= 0) & (both == other - two)
        out[todo[sure]] = 2 * both[sure] / (own + other)[sure]
        todo, cells = todo[~sure], cells * 4
    return out


def _fingerprint_batch(texts: list[str], own: np.ndarray, edited: list[str]) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """For the texts numbered in own, each followed by its next."""
    n = len(own)
    row, digest = paragraphs([t.encode() for t in texts])
    number = np.full(len(texts) + 1, -1)
    number[own] = np.arange(n)
    mine, before = number[row], number[row - 1]
    sets = [(mine[mine >= 0], digest[mine >= 0]), paragraphs([t.encode() for t in edited]), (before[before >= 0], digest[before >= 0])]
    prints = [Cells(n, CELLS).add(*s, 1) for s in sets]
    near = [likeness(sets[0], sets[k], n, prints[0].minus(prints[k])) for k in (1, 2)]
    return prints[0].strings(), prints[1].strings(), *near


_FOUND = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Rows, and bytes of text, of a range of ids, about.
RANGE_ROWS, RANGE_BYTES = 20_000, 64 << 20


def _fingerprints(line: list[tuple], own: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
    """Result columns of the rows (id, text) of line numbered in own, each followed by its next."""
    text = [line[k][1] for k in own]
    edited = [t[: len(t) - len(t) // 2] + line[k + 1][1][: len(t) // 2] for t, k in zip(text, own, strict=True)]
    out = _fingerprint_batch([x[1] for x in line], own, edited)
    return [pa.array([line[k][0] for k in own], kind), pa.array([len(t) for t in text], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), *(pa.array(x) for x in out)]


def _in_ranges(names: list[str]):
    """Of a sorted range: the results of all rows but the last, and as rows without results the first and the last text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kind = TaskContext.get().partitionId(), [], None
        edge = lambda end, x: pa.RecordBatch.from_arrays([pa.array([x[0]], kind), pa.array([1], pa.int64()), *(pa.nulls(1, t) for t in types), pa.array([part], pa.int64()), pa.array([end]), pa.array([x[1]], pa.string())], names=names)
        types = [pa.string()] * 3 + [pa.float64()] * 2
        for b in batches:
            first, kind = kind is None, b.column(0).type
            for lo, hi in B.row_slices(b.column(1)):
                ids, texts = (b.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1))
                line = held + [(i, t or "") for i, t in zip(ids, texts, strict=True)]
                if first:
                    yield edge("first", line[0])
                    first = False
                held, own = line[-1:], np.arange(len(line) - 1)
                if len(own):
                    cols = _fingerprints(line, own, kind)
                    yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(own), t) for t in (pa.int64(), pa.string(), pa.string()))], names=names)
        if held:
            yield edge("last", held[0])

    return run


def _over_edges(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, after = (b.column(c).to_pylist() for c in range(3))
            for i, t, a in zip(ids, texts, after, strict=True):
                yield pa.RecordBatch.from_arrays(_fingerprints([(i, t), (None, a)], np.arange(1), b.column(0).type), names=names)

    return run


def compare_with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = RANGE_ROWS) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is that with the next smaller id, after the last one the first.  The edited text has its last half
    (rounded down) replaced by as many first code points of the next text, or all it has.  A null text counts as empty; rows
    of equal ids follow each other in a fixed order, null ids come last; a single row is its own next.  Texts without a word
    have an empty fingerprint, and two of them are alike (1.0).  An empty table gives an empty result.  Whole texts are read; a
    task holds one slice of texts, or one text that is longer.

    Rows are dealt by ranges of ids, as many as rows and bytes ask for, and only there do texts move.  The last text of each range meets
    the first of the next one afterwards: two texts a range.
    """
    rows, _ = ordered(docs, id_col, text_col)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    kind = rows.schema[id_col]
    schema = schema_of([kind], _FOUND)
    if not size["n"]:
        return docs.sparkSession.createDataFrame([], schema)
    n, ready = size["n"], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // rows_at_once), -(-(size["bytes"] or 0) // RANGE_BYTES), min(ready, n // 50))
    dealt = rows.select(id_col, text_col, "_ord").repartitionByRange(parts, F.desc("_ord")).sortWithinPartitions(F.desc("_ord")).select(id_col, text_col)
    inner = schema_of([kind], _FOUND + ", _part bigint, _end string, _text string")
    found = written(dealt.mapInArrow(_in_ranges(inner.names), inner), "ranges")

    edges = found.filter("_end IS NOT NULL").select(id_col, "_part", "_end", "_text")
    used = [r["_part"] for r in edges.filter("_end = 'first'").select("_part").orderBy("_part").collect()]  # numbers of tasks
    after = docs.sparkSession.createDataFrame(list(zip(used, used[1:] + used[:1], strict=True)), "_part bigint, _next bigint")
    last = edges.filter("_end = 'last'").join(after.hint("shuffle_hash"), "_part").select(id_col, "_text", "_next")
    pairs = last.join(edges.filter("_end = 'first'").select(F.col("_part").alias("_next"), F.col("_text").alias("_after")).hint("shuffle_hash"), "_next").select(id_col, "_text", "_after")
    return found.filter("_end IS NULL").select(*schema.names).unionByName(pairs.mapInArrow(_over_edges(schema.names), schema))
