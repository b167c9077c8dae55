"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE (B) share bytes of the same text.

Both sequences of token ends run over the same bytes.  Where both have a token end, a group ends.  Diagonal run skipping: at the current
shift between the two indices, stretches in which the ends are the same one to one are measured by exponential probing of the end
arrays and jumped; an irregular group is resolved locally, token by token, and changes the shift.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import written

#: Id pairs whose counts are sent to every task, at most: 17 bytes each.  The others are joined.
SENT_PAIRS = 1 << 20
#: Words whose tokens a Python worker keeps, about, and bytes of text that are aligned at once.
_KEPT_WORDS, _SLICE = 400_000, 1 << 20
#: Tokens of a lane, about.
_LANE = 192
#: A pair of ids is a * _B + b.
_B = 1 << 24
# Fixed value: how the byte-level BPE cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No token of either tokenizer spans the place before a single space between two other characters.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Texts without any of these can be cut at every space.
_UNEVEN = re.compile(r"\s |^ | $| \s|▁ | ▁")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of as many places as size, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def align(ends_a: np.ndarray, ends_b: np.ndarray, lanes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Groups and links of two rising sequences of ends, of which the last are the same.

    Lanes are places in A and B with the same end before them, first (0, 0), from which the search goes on side by side; one lane by
    default.  Returns the numbers of tokens of A and of B up to the end of each group, and the places in A and B of each linked pair: those
    whose ranges overlap, in order.
    """
    begin_i, begin_j = (np.zeros(min(1, len(ends_a)), np.int64),) * 2 if lanes is None else lanes
    runs, odd, links = [], [], []
    i, j = begin_i.astype(np.int64), begin_j.astype(np.int64)
    stop_i, stop_j = np.append(i[1:], len(ends_a)), np.append(j[1:], len(ends_b))
    step = np.ones(len(i), np.int64)
    live = np.flatnonzero(i < stop_i)
    while len(live):
        # the next `step` ends at the current shift: all the same, and the step doubles; or up to the first that differs
        at_i, at_j = i[live], j[live]
        size = np.minimum(step[live], np.minimum(stop_i[live] - at_i, stop_j[live] - at_j))
        first = np.cumsum(size) - size
        differs = ends_a[_spread(at_i, size)] != ends_b[_spread(at_j, size)]
        nth = np.arange(len(differs)) - np.repeat(first, size)
        k = np.minimum.reduceat(np.where(differs, nth, len(differs)), first)
        held = k == len(differs)
        k = np.where(held, size, k)
        runs.append((at_i[k > 0], at_j[k > 0], k[k > 0]))
        i[live], j[live] = at_i + k, at_j + k
        step[live] = np.where(held, 2 * step[live], 1)
        # irregular groups: token by token, until the ends meet
        at = live[~held]
        while len(at):
            x, y = i[at], j[at]
            links.append((x, y))
            a, b = ends_a[x], ends_b[y]
            i[at] = x + (a <= b)
            j[at] = y + (b <= a)
            met = at[a == b]
            odd.append((i[met], j[met]))
            at = at[a != b]
        live = live[i[live] < stop_i[live]]
    whole = lambda parts, n: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * n
    run_i, run_j, size = whole(runs, 3)
    one_i, one_j = _spread(run_i, size), _spread(run_j, size)
    odd_i, odd_j = whole(odd, 2)
    more_i, more_j = whole(links, 2)
    group_i, group_j = np.concatenate([one_i + 1, odd_i]), np.concatenate([one_j + 1, odd_j])
    link_i, link_j = np.concatenate([one_i, more_i]), np.concatenate([one_j, more_j])
    by, at = np.argsort(group_i), np.argsort(link_i + link_j)
    return group_i[by], group_j[by], link_i[at], link_j[at]


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, size: int = _LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B with the same end before them: the first, and of every `size`th token of A those whose end B has too."""
    at = np.arange(size, len(ends_a), size)
    to = np.searchsorted(ends_b, ends_a[at - 1])
    same = ends_b[np.minimum(to, len(ends_b) - 1)] == ends_a[at - 1] if len(at) else np.zeros(0, bool)
    none = np.zeros(min(1, len(ends_a)), np.int64)
    return np.concatenate([none, at[same]]), np.concatenate([none, to[same] + 1])


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of their tokens, and the tokens of the words that they met last.

    Ids of A follow the order of its merges, so that an encoder by ranks gives them too; a test holds it against the file's own one.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        plain = byte_level()
        vocabulary = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=False)
        ranks = {bytes(plain[c] for c in token): i for token, i in vocabulary.items() if all(c in plain for c in token)}
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            bytes_a[i] = token
        self.a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.bytes_of = (bytes_a, bytes_b)
        self.size_of = [np.array([len(x) for x in y], np.int64) for y in self.bytes_of]
        self.forget()

    def forget(self) -> None:
        """No word is known any more."""
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]  # by A and B, one word after the other
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.same = np.zeros(0, bool)

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids by A of space+word and by B of the word, how many each word has, and whether the bytes of both are space+word.

        The words are encoded as one text, in which no token spans two of them; where its bytes don't come back, each on its own.
        """
        text = " ".join(words)
        whole = (" " + text).encode()
        ids = [np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text), np.int64)]
        if len(words) > 1 and not all(b"".join([of[i] for i in x.tolist()]) == whole for x, of in zip(ids, self.bytes_of, strict=True)):
            each = [self.encode([w]) for w in words]
            return [np.concatenate([x[0][k] for x in each]) for k in (0, 1)], [np.concatenate([x[1][k] for x in each]) for k in (0, 1)], np.concatenate([x[2] for x in each])
        if len(words) == 1:
            same = all(b"".join([of[i] for i in x.tolist()]) == whole for x, of in zip(ids, self.bytes_of, strict=True))
            return ids, [np.array([len(x)]) for x in ids], np.array([same])
        last = np.cumsum([1 + len(w.encode()) for w in words])
        counts = [np.diff(np.searchsorted(np.cumsum(size[x]), last) + 1, prepend=0) for x, size in zip(ids, self.size_of, strict=True)]
        return ids, counts, np.ones(len(words), bool)

    def _learn(self, words: list[str]) -> None:
        """Puts words that aren't known yet behind the known ones."""
        alone = [w for w in words if w[:1].isspace() or w[-1:].isspace() or "▁" in w or not w]
        odd = set(alone)
        joined = [w for w in words if w not in odd]
        for some in [[w] for w in alone] + [joined[lo : lo + 20_000] for lo in range(0, len(joined), 20_000)]:
            ids, counts, same = self.encode(some)
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some)), strict=True))
            for k in (0, 1):
                self.ids[k] = np.concatenate([self.ids[k], ids[k]])
                self.ends[k] = np.concatenate([self.ends[k], self.ends[k][-1] + np.cumsum(counts[k])])
            self.same = np.concatenate([self.same, same])

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of the texts by A and B, one after the other, and how many each text has: none where the bytes don't come back.

        Texts are cut where no token spans the cut, so that the parts' tokens are the text's, and parts that were met before needn't be
        encoded again.  A text of which some part's bytes differ is looked at as a whole.
        """
        parts = [(t.split(" ") if _UNEVEN.search(t) is None else _CUT.split(t)) if t else [] for t in texts]
        if len(self.known) > _KEPT_WORDS:
            self.forget()
        words = list(chain.from_iterable(parts))
        self._learn(list(set(words).difference(self.known)))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        last = np.cumsum([len(p) for p in parts])
        ids, sizes = [], []
        for k in (0, 1):
            first, n = self.ends[k][at], self.ends[k][at + 1] - self.ends[k][at]
            ids.append(self.ids[k][_spread(first, n)])
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], last])]))
        if not self.same[at].all():
            ids, sizes = self._whole(texts, np.unique(np.searchsorted(last, np.flatnonzero(~self.same[at]), side="right")), ids, sizes)
        return ids, sizes

    def _whole(self, texts: list[str], asked: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The same with the texts asked for encoded as a whole."""
        pieces = [np.split(x, np.cumsum(n)[:-1]) for x, n in zip(ids, sizes, strict=True)]
        for i in asked.tolist():
            own, _, same = self.encode([texts[i]])
            for k in (0, 1):
                pieces[k][i] = own[k] if same[0] else own[k][:0]
        return [np.concatenate(x) for x in pieces], [np.array([len(y) for y in x], np.int64) for x in pieces]


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    """One pair for each Python worker."""
    return Pair(path_a, path_b)


def _said(ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with a sign after it, as bytes, and where each ends."""
    digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 9))
    end = np.cumsum(digits + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = sign
    rest, k = ids.copy(), 0
    at = np.arange(len(ids))
    while len(at):
        out[end[at] - 2 - k] = 48 + rest % 10
        rest, k = rest // 10, k + 1
        at, rest = at[digits[at] > k], rest[digits[at] > k]
    return out, end


def align_texts(texts: list[str], pair: Pair) -> dict[str, np.ndarray | list]:
    """Figures of each text, its groups' digest, and its id pairs with how often each is linked."""
    (ids_a, ids_b), (n_a, n_b) = pair.tokens(texts)
    ends_a, ends_b = (np.cumsum(size[x]) for size, x in zip(pair.size_of, (ids_a, ids_b), strict=True))
    group_i, group_j, link_i, link_j = align(ends_a, ends_b, lanes(ends_a, ends_b))
    last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
    row = np.searchsorted(last_a, link_i, side="right")
    key, times = np.unique((row << 48) | (ids_a[link_i] * _B + ids_b[link_j]), return_counts=True)

    # a1,a2|b1;a3|b2,b3: group by group, the tokens of A, then those of B
    size_i, size_j = np.diff(group_i, prepend=0), np.diff(group_j, prepend=0)
    place_a = np.arange(len(ids_a)) + np.repeat(group_j - size_j, size_i)
    place_b = np.arange(len(ids_b)) + np.repeat(group_i, size_j)
    ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = ids_a, ids_b
    sign[place_a[group_i - 1]], sign[place_b[group_j - 1]] = ord("|"), ord(";")
    said, end = _said(ids, sign)
    cut = np.concatenate([[0], end])[np.concatenate([[0], last_a + last_b])].tolist()
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(np.searchsorted(group_i, last_a, side="right"), prepend=0), "n_links": np.bincount(row, minlength=len(texts)),
        "groups_sha256": [hashlib.sha256(said[lo : hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(cut, cut[1:], strict=False)],
        "cuts": np.searchsorted(key >> 48, np.arange(len(texts) + 1)), "pairs": key & ((1 << 48) - 1), "times": times,
    }


_ROW = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for lo, hi in B.row_slices(column, _SLICE):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def linked(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each document: pairs are its different linked id pairs a * 2^24 + b,
    sorted, and times how often each is linked."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        for b in batches:
            for lo, hi, texts in _slices(b.column("text")):
                x = align_texts(texts, pair)
                lists = [pa.ListArray.from_arrays(pa.array(x["cuts"].astype(np.int32)), pa.array(x[c].astype(t))) for c, t in (("pairs", np.int64), ("times", np.int32))]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), *(pa.array(x[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x["groups_sha256"], pa.string()), *lists], names=["id", *(c.split()[0] for c in _ROW.split(", "))])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, {_ROW}")


def compare(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A encodes space+text, B the text, before which it puts a space itself; strings of special tokens are plain text.  Groups end at byte
    offsets where tokens of both end; links are the pairs of token occurrences whose byte ranges overlap.  The count of an id pair is
    the number of documents that hold it linked.  n_best is the number of links whose count is the highest of their A id (ties are
    too), count_sum the sum of all links' counts.  groups_sha256 is of `a1,a2|b1;a3|b2,b3`.

    Texts that are null or empty, or that either tokenizer doesn't give back byte for byte, have no tokens: zeros and ''.  Rows of equal or null
    ids are rows of their own; an empty table gives an empty result; other columns aren't looked at.  Whole texts are aligned, of any length.
    """
    spark = docs.sparkSession
    found = linked(docs, path_a, path_b, id_col=id_col, text_col=text_col).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "alignments")  # once written, `row` stays
    counts = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "pair-counts")
    best = counts.groupBy(F.expr(f"pair div {_B}").alias("a")).agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary
    counts = written(counts.withColumn("a", F.expr(f"pair div {_B}")).join(F.broadcast(best), "a").select("pair", "n", F.expr("n = most").alias("best")), "pair-counts")

    # at most SENT_PAIRS pairs have more than their SENT_PAIRSth part of all entries
    least = (counts.agg(F.sum("n")).first()[0] or 0) // SENT_PAIRS
    often = counts.filter(F.col("n") > least).orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast(tuple(often.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, is_best = sent.value
        for b in batches:
            flat, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            row = np.repeat(np.arange(b.num_rows), b.column("pairs").value_lengths().fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            sums, bests = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(sums, row[hit], times[hit] * n[at[hit]])
            np.add.at(bests, row[hit], times[hit] * is_best[at[hit]])
            cuts = np.searchsorted(row[~hit], np.arange(b.num_rows + 1)).astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[~hit])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(bests), pa.array(sums), *rest], names=["row", "n_best", "count_sum", "pairs", "times"])

    scored = written(found.select("row", "pairs", "times").mapInArrow(run, "row bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>"), "scored")
    rare = scored.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.*").withColumnRenamed("pairs", "pair")
    rare = rare.join(counts.filter(F.col("n") <= least).hint("merge"), "pair").groupBy("row").agg(F.sum(F.expr("CASE WHEN best THEN times ELSE 0 END")).alias("more_best"), F.sum(F.expr("times * n")).alias("more_sum"))
    out = found.drop("pairs", "times").join(scored.select("row", "n_best", "count_sum").hint("merge"), "row").join(rare.hint("merge"), "row", "left")
    zero = F.lit(0).cast("bigint")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")
