"""Removal of byte strings that occurred before, by two-stage suffix sorting.

Equal strings of `length` bytes hold equal k-grams of smallest hash.  Consecutive starts whose strings have the same smallest
hash make a stretch; only stretches of equal hash can hold equal strings.  Stretches that are equal as a whole are settled
without a look at their bytes: all but the first are repeats.  What is left, different stretches of one hash, is brought together
and suffix-sorted: only suffixes smaller than their successors are sorted directly, the others are induced by scans over the
buckets of first bytes, and common prefixes of neighbours of at least `length` bytes show the equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import ordered, schema_of, written

#: Length of the k-grams; a string of 100 bytes has 77 of them.
KGRAM = 24
#: Starts in a stretch at most; the number of starts is packed beside the place of the first.
_STARTS = 127
#: Different stretches of one key that one task compares at most; more are dealt out string by string, equal strings held once.
STRETCHES_OF_KEY = 2_000
_ROW_BYTES = 1 << 20
_SORT_BYTES = 2 << 20


def _stretches(buf: np.ndarray, begin: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """First start, number of starts, key, hash of the bytes, and whether the key's k-gram occurs twice, of the stretches of pieces.

    Piece i is buf[begin[i] : begin[i + 1]].
    """
    w = length - k + 1
    roll = B.RollingHash(buf)
    h = roll.windows(k)
    least, width = h, 1
    while 2 * width <= w:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < w:
        least = np.minimum(least[: len(least) - (w - width)], least[w - width :])
    n = len(least)
    edge = np.zeros(n + 1, np.int64)
    size = np.diff(begin)
    full = size >= length
    edge[begin[:-1][full]] += 1
    edge[(begin[:-1] + size - length + 1)[full]] -= 1
    ok = np.cumsum(edge[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    valid = ok[first]
    first, count = first[valid], count[valid]
    if (count > _STARTS).any():  # periodic text
        parts = -(-count // _STARTS)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = np.repeat(first, parts) + nth * _STARTS, np.repeat(count, parts)
        count = np.minimum(count - nth * _STARTS, _STARTS)
    key = least[first]
    # occurrences of the key's k-gram among those of the stretch: places where h equals the least of a window that holds them
    stop = first + count + w - 1
    owner = np.repeat(np.arange(len(first)), count + w - 1)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count + w - 1) - (count + w - 1), count + w - 1) + first[owner]
    twice = np.bincount(owner[h[at] == key[owner]], minlength=len(first)) > 1
    return first, count, key, roll.ranges(first, stop + k - 1), twice


def _pieces(off: np.ndarray, lo: int, hi: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(row, start in the row, bytes) of pieces of rows lo to hi; long rows in pieces that overlap."""
    for r in range(lo, hi):
        n = int(off[r + 1] - off[r])
        for o in range(0, max(n - length + 1, 0), _ROW_BYTES):
            yield r, o, min(n - o, _ROW_BYTES + length - 1)


def _settled_early(a: np.ndarray) -> np.ndarray:
    """Stretches (key, whole, _ord, at) of a batch, those that repeat one of the batch marked by whole = 0.

    Marked ones get a key of their own: they are spread evenly, and a stretch that very many documents share doesn't meet in one
    task as often as it occurs.
    """
    a = a[:, np.lexsort((a[3], a[2]))]
    _, first = np.unique(B.mixed(a[0].view(B.U64)) ^ a[1].view(B.U64), return_index=True)
    again = np.ones(a.shape[1], bool)
    again[first] = False
    a[0, again] = B.mixed(a[2, again].view(B.U64) ^ B.mixed(a[3, again].view(B.U64))).view(np.int64)
    a[1, again] = 0
    return a


def _find_stretches(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = B.text_bytes(b.column("_text"))
            order = b.column("_ord").to_numpy()
            found = []
            for lo, hi in B.row_slices(b.column("_text")):
                todo = list(_pieces(off, lo, hi, length))
                while todo:
                    some, size = [], 0
                    while todo and (not some or size + todo[0][2] <= 2 * _ROW_BYTES):
                        some.append(todo.pop(0))
                        size += some[-1][2]
                    row, start, n = (np.array(x, np.int64) for x in zip(*some, strict=True))
                    begin = np.concatenate([[0], np.cumsum(n)])
                    text = np.concatenate([buf[off[r] + o : off[r] + o + m] for r, o, m in some])
                    first, count, key, whole, twice = _stretches(text, begin, length, k)
                    piece = np.searchsorted(begin, first, side="right") - 1
                    place = first - begin[piece] + start[piece]
                    found.append(np.stack([key.view(np.int64), whole.view(np.int64), order[row[piece]], (place << 8) | (count << 1) | twice]))
            if found:
                a = _settled_early(np.concatenate(found, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in a], names=["key", "whole", "_ord", "at"])

    return run


_STRETCH = "key bigint, whole bigint, _ord bigint, at bigint"
#: What is known of a stretch: it repeats another one, its bytes must be compared, or its strings one by one.
_REPEAT, _COMPARE, _SPLIT = 0, 1, 2
_FOUND = "key bigint, _ord bigint, at bigint, kind int"


def _settle(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows come by key, then in document order.  Repeats of whole stretches, and stretches whose bytes must be compared.

    Where more than `most` different stretches have one key, they are to be split.  From then on none of the key is held: of
    later ones only those that repeat one of their batch are settled, the others are split too.
    """

    def rows(a: np.ndarray, kind: np.ndarray | int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[2]), pa.array(a[3]), pa.array(np.broadcast_to(np.asarray(kind, np.int32), a.shape[1:]))], names=["key", "_ord", "at", "kind"])

    def firsts(a: np.ndarray) -> np.ndarray:
        _, at = np.unique(B.mixed(a[0].view(B.U64)) ^ a[1].view(B.U64), return_index=True)
        mask = np.zeros(a.shape[1], bool)
        mask[at] = True
        return mask

    def compared(a: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of first stretches of complete keys: those with others of the key, or periodic ones."""
        _, of, n = np.unique(a[0], return_inverse=True, return_counts=True)
        todo = (n[of] > 1) | (a[3] & 1 > 0)
        if todo.any():
            yield rows(a[:, todo], np.where(n[of] > most, _SPLIT, _COMPARE)[todo])

    held, hot = np.zeros((4, 0), np.int64), None
    for b in batches:
        a = np.stack([b.column(c).to_numpy() for c in ("key", "whole", "_ord", "at")])
        if (known := a[1] == 0).any():
            yield rows(a[:, known], _REPEAT)
            a = a[:, ~known]
        a = np.concatenate([held, a], axis=1)
        if not a.shape[1]:
            continue
        first = firsts(a)
        if not first.all():
            yield rows(a[:, ~first], _REPEAT)
        a = a[:, first]
        if hot is not None and (more := a[0] == hot).any():
            yield rows(a[:, more], _SPLIT)
            a = a[:, ~more]
            if not a.shape[1]:
                held = a
                continue
        last = a[0] == a[0, -1]  # the key may go on in the next batch
        if last.sum() > most:
            hot, last = a[0, -1], np.zeros(a.shape[1], bool)
        held, a = a[:, last], a[:, ~last]
        yield from compared(a)
    yield from compared(held)


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `wanted` places (and those they are induced from), sorted by their first `depth` bytes at least.

    Two-stage sorting: suffixes smaller than their successors are sorted directly, the others are induced from left to right.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(256)))
    # in a run of equal bytes, what follows the run decides
    change = np.where(step != 0, np.arange(n), n - 1)
    rising = step[np.minimum.accumulate(change[::-1])[::-1]] > 0
    need = np.zeros(n, bool)
    need[wanted] = True
    new = np.flatnonzero(need & ~rising)
    while len(new):
        new = new + 1
        new = new[~need[new]]
        need[new] = True
        new = new[~rising[new]]
    direct = _sorted_directly(text, np.flatnonzero(need & rising), depth)
    falling = need & ~rising
    # stage two: scan the buckets of first bytes; a sorted suffix places the larger one before it at its bucket's next free place
    lead = text[direct]
    cut = np.searchsorted(lead, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def scan(done: np.ndarray) -> None:
        out.append(done)
        before = done[done > 0] - 1
        before = before[falling[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            for c, part in zip(np.unique(byte).tolist(), np.split(before, np.flatnonzero(np.diff(byte)) + 1), strict=True):
                waiting[c].append(part)

    for c in range(256):
        while waiting[c]:
            part = np.concatenate(waiting[c])
            waiting[c] = []
            scan(part)
        if cut[c] < cut[c + 1]:
            scan(direct[cut[c] : cut[c + 1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from any place on, the first one weighing most."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = _words(padded)
    at = at[np.argsort(words[at].astype(B.U64), kind="stable")]
    w = words[at]
    group = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])]) if len(at) else np.zeros(0, np.int64)
    for d in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            break
        w = words[at[places] + d].astype(B.U64)
        order = np.lexsort((w, group[places]))
        w, g = w[order], group[places][order]
        at[places] = at[places][order]
        split = np.zeros(len(at), np.int64)
        split[places[1:]] = (g[1:] == g[:-1]) & (w[1:] != w[:-1])
        group = group + np.cumsum(split)
    return at


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to `depth`."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    words = _words(padded)
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for d in range(0, depth, 8):
        x = words[order[live] + d].astype(B.U64) ^ words[order[live - 1] + d].astype(B.U64)
        equal = x == 0
        part = live[~equal]
        lead = np.zeros(len(part), np.int64)
        rest = x[~equal]
        for i in range(1, 8):
            lead += rest >> B.U64(64 - 8 * i) == 0
        out[part] = d + lead
        live = live[equal]
        if not len(live):
            break
    out[live] = depth
    return np.minimum(out, depth)


def _repeats(parts: list[np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    """Places in the joined parts, which come in document order, whose string of `length` bytes is at an earlier start as well."""
    text = np.concatenate(parts)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size) - size
    wanted = np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    order = suffix_order(text, wanted, length)
    group = np.cumsum(common_prefixes(text, order, length) < length)
    asked = np.zeros(len(text), bool)
    asked[wanted] = True
    mine = asked[order]
    order, group = order[mine], group[mine] - 1
    least = np.full(int(group[-1]) + 1 if len(group) else 0, len(text), np.int64)
    np.minimum.at(least, group, order)
    return np.sort(order[order != least[group]])


def _compare(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        # strings of the key that are rows of their own: later copies are repeats at once, and not held
        seen: set[bytes] = set()
        current = None

        def settle(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch | None:
            starts = np.array([len(r[3]) - length + 1 for r in rows], np.int64)
            found = _repeats([r[3] for r in rows], starts, length)
            if not len(found):
                return None
            size = starts + length - 1
            begin = np.cumsum(size) - size
            row = np.searchsorted(begin, found, side="right") - 1
            place = np.array([r[2] for r in rows], np.int64)[row] + found - begin[row]
            new = np.ones(len(found), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(found)))
            return pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in rows], np.int64)[row[at]]), pa.array((place[at] << 8) | (count << 1))], names=["_ord", "at"])

        size = 0
        for b in batches:
            key, order, place = (b.column(c).to_numpy() for c in ("key", "_ord", "place"))
            buf, off = B.text_bytes(b.column("bytes"))
            again = []
            for i in range(b.num_rows):
                if off[i] == off[i + 1]:
                    again.append(i)
                    continue
                if current != key[i]:
                    current, seen = key[i], set()
                    if size >= _SORT_BYTES:
                        if (out := settle(held)) is not None:
                            yield out
                        held, size = [], 0
                if off[i + 1] - off[i] == length:
                    if (string := buf[off[i] : off[i + 1]].tobytes()) in seen:
                        again.append(i)
                        continue
                    seen.add(string)
                held.append((key[i], order[i], place[i], buf[off[i] : off[i + 1]].copy()))
                size += int(off[i + 1] - off[i])
            if again:
                yield pa.RecordBatch.from_arrays([pa.array(order[again]), pa.array((place[again] << 8) | (1 << 1))], names=["_ord", "at"])
        if held and (out := settle(held)) is not None:
            yield out

    return run


def _cut_out(length: int):
    """The bytes of stretches, and of the strings of those that are split.

    A string that another one of its batch equals and precedes is a repeat, whatever other batches hold: it goes on without
    bytes, by a key of its own, so that a hot string doesn't meet in one task as often as it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = B.text_bytes(b.column("_text"))
            order, lists = b.column("_ord").to_numpy(), b.column("need").to_pylist()
            keys, ords, places, parts = [], [], [], []
            alone, least = [], {}
            for i, need in enumerate(lists):
                for x in need:
                    place, count = x["at"] >> 8, (x["at"] >> 1) & 127
                    whole = buf[off[i] + place : off[i] + place + count + length - 1]
                    if x["kind"] == _COMPARE:
                        keys.append(x["key"])
                        ords.append(order[i])
                        places.append(place)
                        parts.append(whole.tobytes())
                        continue
                    # equal strings have equal hashes: each goes where its hash says
                    alone += range(len(keys), len(keys) + count)
                    keys += B.RollingHash(whole).windows(length).view(np.int64).tolist()
                    ords += [order[i]] * count
                    places += range(place, place + count)
                    parts += [whole[k : k + length].tobytes() for k in range(count)]
            for j in alone:
                at = (ords[j], places[j])
                if at < least.get(parts[j], (np.inf,)):
                    least[parts[j]] = at
            if again := [j for j in alone if least[parts[j]] != (ords[j], places[j])]:
                own = B.mixed(np.array([ords[j] for j in again], np.int64).view(B.U64) ^ B.mixed(np.array([places[j] for j in again], np.int64).view(B.U64)))
                for j, k in zip(again, own.view(np.int64).tolist(), strict=True):
                    keys[j], parts[j] = k, b""
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ords, pa.int64()), pa.array(places, pa.int64()), pa.array(parts, pa.binary())], names=["key", "_ord", "place", "bytes"])

    return run


def _remove(names: list[str], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = B.text_bytes(b.column("_text"))
            marks = b.column("marks")
            values, ends = marks.flatten().to_numpy(), np.cumsum(marks.value_lengths().to_numpy())
            removed, spans, kept = [], [], []
            for i in range(b.num_rows):
                text = buf[off[i] : off[i + 1]]
                m = values[(ends[i - 1] if i else 0) : ends[i]]
                if not len(m):
                    removed.append(0)
                    spans.append(0)
                    kept.append(hashlib.sha256(text).hexdigest())
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                place = m >> 8
                np.add.at(edge, place, 1)
                np.add.at(edge, place + ((m >> 1) & 127) + length - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(len(B.tokens(gone)[0]))
                kept.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def marks_of(rows: DataFrame, length: int = 100, k: int = KGRAM, most: int = STRETCHES_OF_KEY) -> DataFrame:
    """(_ord, at) for rows (_ord, _text): ranges of starts of strings that occur earlier, packed as place << 8 | starts << 1."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    stretches = rows.mapInArrow(_find_stretches(length, k), _STRETCH)
    found = written(stretches.repartition(n, "key").sortWithinPartitions("key", "_ord", "at").mapInArrow(lambda batches: _settle(batches, most), _FOUND), "stretches")
    need = found.filter(F.col("kind") != _REPEAT).groupBy("_ord").agg(F.collect_list(F.struct("key", "at", "kind")).alias("need"))
    bytes_ = rows.join(need.hint("shuffle_hash"), "_ord").mapInArrow(_cut_out(length), "key bigint, _ord bigint, place bigint, bytes binary")
    compared = bytes_.repartition(n, "key").sortWithinPartitions("key", "_ord", "place").mapInArrow(_compare(length), "_ord bigint, at bigint")
    return found.filter(F.col("kind") == _REPEAT).select("_ord", "at").unionByName(compared)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, most: int = STRETCHES_OF_KEY) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every document, as UTF-8 bytes.

    A byte is removed if it lies in a string of `length` bytes that also starts earlier: in a document with a smaller id, or in
    the same one before.  Strings may overlap, and don't go over the end of a document.  A null text counts as empty, an
    empty table gives an empty result, and long texts are cut into pieces that overlap; rows of equal ids follow each other in a fixed order, null ids first.  Strings are compared byte by byte where stretches differ; stretches
    that are equal as a whole are recognised by two 64-bit hashes.
    """
    rows, _ = ordered(docs, id_col, text_col)
    rows = rows.select(F.col(id_col), "_ord", F.col(text_col).alias("_text"))
    marks = written(marks_of(rows.select("_ord", "_text"), length, most=most), "marks")
    lists = marks.groupBy("_ord").agg(F.collect_list("at").alias("marks"))
    joined = rows.join(lists.hint("shuffle_hash"), "_ord", "left").withColumn("marks", F.coalesce("marks", F.expr("cast(array() AS array<bigint>)"))).select(id_col, "_text", "marks")
    return joined.mapInArrow(_remove([id_col], length), schema_of([rows.schema[id_col]], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))
