"""Benchmark decontamination by Wu-Manber search for many word windows at once.

Texts and windows are brought to one form: words in lower case with single spaces around them, so that a byte match
of a window is a match of its words.  The search steps over the text by block shifts; where the shift is zero the block
selects a bucket of windows, and direct comparison confirms.  Many stretches of text step at the same time in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import schema_of, written

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}

#: Benchmark bytes searched for in one pass over the documents, of about 8 times as many broadcast.
PASS_BYTES = 8 << 20
_STRETCH = 2048


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class WuManber:
    """Shift table and buckets for patterns of at least `shortest` bytes, which are ranges [start, end) of one byte string with eight bytes more."""

    def __init__(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int = 18):
        self.text, self.start, self.end = text, start, end
        self.shortest = m = int((end - start).min())
        self.block = min(8, max(1, m // 2))
        self.bits = bits
        eight, mask = _view(text), _mask(self.block)
        self.shift = np.full(1 << bits, m - self.block + 1, np.int32)
        for last in range(self.block, m + 1):
            code = eight[start + last - self.block] & mask
            np.minimum.at(self.shift, self._slot(code), m - last)
        self.order = np.argsort(code, kind="stable").astype(np.int32)
        self.codes = code[self.order]  # of the last block of each head

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * B.U64(0x9E3779B97F4A7C15)) >> B.U64(64 - self.bits)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start in text and number of the pattern, for each occurrence."""
        m, w = self.shortest, self.block
        none = np.zeros(0, np.int64)
        if len(text) < m:
            return none, none
        eight, mask = _eight(text), _mask(w)
        at = np.arange(m - 1, len(text), _STRETCH)
        stop = np.minimum(at + _STRETCH, len(text))
        found = []
        while len(at):
            step = self.shift[self._slot(eight[at - w + 1] & mask)]
            if (hit := step == 0).any():
                found.append(at[hit])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return none, none
        end = np.concatenate(found)
        code = eight[end - w + 1] & mask
        lo, hi = np.searchsorted(self.codes, code, "left"), np.searchsorted(self.codes, code, "right")
        n = hi - lo
        out = []
        # buckets of common suffixes are compared a part at a time
        for some in np.array_split(np.arange(len(n)), max(1, int(n.sum()) >> 20)):
            k = n[some]
            start = np.repeat(end[some] - m + 1, k)
            which = self.order[np.repeat(lo[some] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))].astype(np.int64)
            out.append(self._confirmed(text, eight, start, which))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _confirmed(self, text: np.ndarray, eight: np.ndarray, start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those whose bytes are the pattern's, compared eight at a time."""
        begin, size = self.start[which].astype(np.int64), (self.end[which] - self.start[which]).astype(np.int64)
        fits = start + size <= len(text)
        start, which, begin, size = start[fits], which[fits], begin[fits], size[fits]
        own, live, d = _view(self.text), np.arange(len(start)), 0
        equal = np.zeros(len(start), bool)
        while len(live):
            left = size[live] - d
            same = ((eight[start[live] + d] ^ own[begin[live] + d]) & _MASKS[np.minimum(left, 8)]) == 0
            equal[live[same & (left <= 8)]] = True
            live, d = live[same & (left > 8)], d + 8
        return start[equal], which[equal]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], B.U64)


def _mask(n: int) -> np.uint64:
    return _MASKS[n]


def _view(padded: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on."""
    return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))


def _eight(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, zeros after the end."""
    return _view(np.concatenate([text, np.zeros(8, np.uint8)]))


@dataclass
class Windows:
    """The windows of some benchmark items, ready to be searched for: items in canonical form, places in it, and numbers of items."""

    parts: list[tuple[WuManber, np.ndarray, np.ndarray, np.ndarray]]  # search, words, and the window's owners[first[i] : first[i + 1]]
    items: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], size: int = 13) -> Windows:
        names = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(names)}
        texts, start, end, count, owner = [], [], [], [], []
        done = 0
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            line = f" {' '.join(w)} ".encode()
            gap = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)  # before each word, and at the end
            n = max(1, len(w) - size + 1)
            start.append(gap[:n] + done)
            end.append(gap[min(size, len(w)) :][:n] + 1 + done)
            count.append(np.full(n, min(size, len(w))))
            owner.append(np.full(n, number[item]))
            texts.append(line)
            done += len(line)
        if not texts:
            return cls([], names)
        text = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
        start, end, count, owner = (np.concatenate(x).astype(np.int32) for x in (start, end, count, owner))
        # equal windows are one pattern with all their items
        h = B.RollingHash(text).ranges(start, end)
        h, first, of = np.unique(h, return_index=True, return_inverse=True)
        pair = np.unique(of.astype(np.int64) << 32 | owner)
        of, owner = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
        start, end, count = start[first], end[first], count[first]
        out = []
        for low, high in ((1, 7), (8, 23), (24, 1 << 60)):  # short windows don't shorten the steps of long ones
            some = np.flatnonzero((end - start >= low) & (end - start <= high))
            if len(some):
                lo, hi = np.searchsorted(of, some, "left"), np.searchsorted(of, some, "right")
                n = hi - lo
                owners = owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                out.append((WuManber(text, start[some], end[some]), count[some], np.concatenate([[0], np.cumsum(n)]).astype(np.int32), owners))
        return cls(out, names)

    def scan(self, column: pa.Array) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """Of each text: number of words, hit ranges of words, items with occurring windows."""
        buf, off = B.text_bytes(column)
        n_words = np.zeros(len(off) - 1, np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(n_words))]
        items: list[list[str]] = [[] for _ in range(len(n_words))]
        for lo, hi in B.row_slices(column):
            text, start = B.joined(buf, off, lo, hi, 3, 32)
            text = B.LOWER[text]
            text[~B.IS_WORD[text]] = 32
            text[start[1:] - 2] = 0
            text = np.concatenate([np.full(1, 32, np.uint8), text])
            space = text == 32
            text = text[~(space & np.concatenate([[False], space[:-1]]))]
            first, _ = B.tokens(text > 32)
            row = np.searchsorted(np.flatnonzero(text == 0), first)
            n_words[lo:hi] = np.bincount(row, minlength=hi - lo)
            begin = np.cumsum(n_words[lo:hi]) - n_words[lo:hi]
            cover = np.zeros(len(first) + 1, np.int64)
            seen = []
            for search, count, own, owners in self.parts:
                at, which = search.search(text)
                if len(at):
                    word = np.searchsorted(first, at + 1)
                    np.add.at(cover, word, 1)
                    np.add.at(cover, word + count[which], -1)
                    once = np.unique(row[word].astype(np.int64) << 32 | which)
                    r, which = once >> 32, once & 0xFFFFFFFF
                    n = own[which + 1] - own[which]
                    seen.append(np.repeat(r, n) << 32 | owners[np.repeat(own[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))])
            if seen:
                # a run may not go on into the next text
                hit, seen = np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(seen))
                r, at = np.unique(seen >> 32, return_index=True)
                for k, own in zip(r.tolist(), np.split(seen & 0xFFFFFFFF, at[1:]), strict=True):
                    b = int(begin[k])
                    s, e = B.tokens(hit[b : b + int(n_words[lo + k])])
                    spans[lo + k] = list(zip(s.tolist(), e.tolist(), strict=True))
                    items[lo + k] = sorted(self.items[i] for i in own.tolist())
        return n_words.tolist(), spans, items


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def find_passages(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: list[str] | None = None, size: int = 13, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The columns `keep` of docs (all by default, but those named as a result) with `_n_words`, `_spans` and `_items`.

    `_spans` are the maximal ranges [first, end) of words inside an occurrence of a window of `size` words of an item (an
    item of fewer words, but not none, is one window); `_items` the sorted ids, as strings, of items with occurring windows.
    Null texts have no words, on either side; a null item id counts as "null"; rows of equal ids are rows of their own.  Without
    items nothing is hit, and an empty table gives an empty result.  Whole texts are read, of any length.  The items go out in
    blocks of about `pass_bytes` (or one longer item), each searched for in a pass of its own over all documents: about 8 bytes an
    item byte are broadcast, and released before the next block's.
    """
    keep = [c for c in docs.columns if c not in ("_n_words", "_spans", "_items")] if keep is None else keep
    spark = docs.sparkSession
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    passes = max(1, -(-int(total) // pass_bytes))
    base = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))
    if passes > 1:
        base = written(base.withColumn("_ord", F.monotonically_increasing_id()), "numbered")  # the same numbers in every pass
    named = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.col(item_text).alias("t"))
    more = "_n_words bigint, _spans array<struct<first:bigint,end:bigint>>, _items array<string>"

    def one_pass(rows: list[Row], kept: str, hits_only: bool) -> tuple[DataFrame, Broadcast]:
        windows = spark.sparkContext.broadcast(Windows.of([(r.i, r.t) for r in rows], size))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, spans, found = windows.value.scan(b.column("_text"))
                cols = [b.column(kept), pa.array(n, pa.int64()), pa.array([[{"first": s, "end": e} for s, e in x] for x in spans], _SPANS), pa.array(found, pa.list_(pa.string()))]
                out = pa.RecordBatch.from_arrays(cols, names=[kept, "_n_words", "_spans", "_items"])
                yield out.filter(pa.array([bool(x) for x in found])) if hits_only else out

        return base.select(kept, "_text").mapInArrow(run, schema_of([base.schema[kept]], more)), windows

    if passes == 1:
        return one_pass(named.collect(), "_row", False)[0].select("_row.*", "_n_words", "_spans", "_items")
    out = None
    for k in range(passes):
        hits, sent = one_pass(named.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect(), "_ord", k > 0)
        hits = written(hits, "hits")
        sent.unpersist()
        out = hits if out is None else out.unionByName(hits)
    out = out.groupBy("_ord").agg(F.max("_n_words").alias("_n_words"), F.flatten(F.collect_list("_spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))
    out = base.select("_ord", "_row").join(out.hint("shuffle_hash"), "_ord")
    merge = """aggregate(array_sort(s), cast(array() AS array<struct<first:bigint,end:bigint>>), (a, x) ->
        CASE WHEN size(a) > 0 AND x.first <= element_at(a, -1).end
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'end', greatest(x.end, element_at(a, -1).end))))
        ELSE concat(a, array(x)) END)"""
    return out.select("_row.*", "_n_words", F.expr(merge).alias("_spans"), "_items")


N_HIT = "aggregate(_spans, 0L, (a, x) -> a + x.end - x.first)"


def clean_only(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated ones (some word hit, and one word in twenty or more); all columns stay, whatever their names."""
    packed = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    found = find_passages(packed, items, keep=["doc"], **how)
    return found.filter(f"NOT ({N_HIT} > 0 AND 20 * {N_HIT} >= _n_words)").select("doc.*")
