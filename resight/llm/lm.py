"""Scoring texts with a hashed maximum-entropy model.

The probability of a token is that of its class in the context times that of the token in its class and context.  Classes have a
softmax over hashed features: the word before, the two words before, the words two and three before (skips), and the classes
of the two before.  In a class the features are the token, and the token with the class before it; for such indicators the
maximum-entropy solution is relative frequency, which is used in closed form and smoothed from the second to the first.

Classes are learned from contexts: words of equal endings are brought to one row of a table that counts the endings beside
them, and rows with like neighbours make a class.  Weights are trained by rounds of distributed gradient updates: each task runs adaptive
gradient steps over its documents from the weights of the round before, and the changes are averaged.  Scoring goes through
sparse numpy batches: a token touches five rows of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import ordered, written

#: Classes, the first of them for the end of a text.
CLASSES = 16
#: Rows of hashed weights: an eighth of the different tokens, between these powers of two.
LEAST_FEATURES, MOST_FEATURES = 14, 16
#: Endings (hashes of three bytes) that get a class, and coarse endings (of two) that are counted beside them.
ENDINGS, COARSE = 1 << 12, 1 << 6
#: Rounds of gradient updates; each goes over its share of the training documents, together over all.
ROUNDS = 2
#: Tokens with at least this share of all training tokens are sent to the scoring tasks: 1 / share of them at most.
SENT_SHARE = 1e-6
#: Squared gradients that a weight starts with: rare features move little.
POWER = 10.0
#: How many tokens' worth the class's frequencies weigh in a context, for each different token seen in it.
SMOOTHING = 4.0
_BATCH = 1 << 14
_BLOCK = 64
_END = B.U64(0x5851F42D4C957F2D)
_BEFORE = CLASSES + 1  # classes of the token before, with that of none
_COUNTS_AT_ONCE = 1 << 20


@dataclass
class Tokens:
    hash: np.ndarray
    ending: np.ndarray  # 0 for the end of a text
    coarse: np.ndarray
    row: np.ndarray
    place: np.ndarray  # in its text
    cls: np.ndarray | None = None

    @classmethod
    def of(cls, buf: np.ndarray, off: np.ndarray, lo: int, hi: int, classes: np.ndarray | None = None) -> Tokens:
        """Lower-cased words of the texts lo to hi, and the end of each; with their classes, if those of the endings are given."""
        text, start = B.joined(buf, off, lo, hi, 1, 32)
        text = B.LOWER[text]
        first, last = B.tokens(~B.IS_BLANK[text])
        row = np.searchsorted(start, first, side="right") - 1
        words = np.bincount(row, minlength=hi - lo)
        n = len(first) + hi - lo
        end = np.cumsum(words + 1) - 1
        h, ending, coarse = np.full(n, _END, B.U64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.arange(len(first)) + row
        h[at] = B.RollingHash(text).ranges(first, last)
        one, two, three = (np.where(last - first >= k, text[np.maximum(last - k, 0)], 0).astype(B.U64) for k in (1, 2, 3))
        pair = one << B.U64(8) | two
        ending[at] = 1 + (B.mixed(pair << B.U64(8) | three) % B.U64(ENDINGS - 1)).astype(np.int64)
        coarse[at] = 1 + (B.mixed(pair + B.U64(77)) % B.U64(COARSE - 1)).astype(np.int64)
        rows = np.repeat(np.arange(hi - lo), words + 1)
        return cls(h, ending, coarse, rows, np.arange(n) - np.repeat(end - words, words + 1), None if classes is None else classes[ending])

    def before(self) -> np.ndarray:
        """Class of the token before, CLASSES where there is none."""
        out = np.full(len(self.cls), CLASSES)
        out[1:] = self.cls[:-1]
        out[self.place == 0] = CLASSES
        return out

    def features(self, size: int) -> np.ndarray:
        """Rows of weights, of `size` ones, that each token's context touches."""
        n = len(self.hash)
        back = []
        for d in (1, 2, 3):
            h, c = np.zeros(n, B.U64), np.zeros(n, np.int64)
            h[d:], c[d:] = self.hash[:-d] if n > d else h[d:], self.cls[:-d] if n > d else c[d:]
            inside = self.place >= d
            back.append((np.where(inside, h, B.U64(0)), np.where(inside, c, CLASSES)))
        (h1, c1), (h2, c2), (h3, _) = back
        mask = B.U64(size - 1)
        keys = [
            (c1 * _BEFORE + c2).astype(B.U64) * B.U64(0x9E3779B97F4A7C15),
            h1,
            h1 * B.U64(0xD6E8FEB86659FD93) + h2,
            h2 ^ B.U64(0xA5A5A5A5A5A5A5A5),
            h3 ^ B.U64(0x3C3C3C3C3C3C3C3C),
        ]
        return np.stack([(B.mixed(k) & mask).astype(np.int64) for k in keys], axis=1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each coarse ending stands before and after each ending, of a task, as blocks of rows."""
    total = np.zeros(ENDINGS * 2 * COARSE, np.int64)
    for b in batches:
        buf, off = B.text_bytes(b.column("_text"))
        for lo, hi in B.row_slices(b.column("_text")):
            t = Tokens.of(buf, off, lo, hi)
            before = np.concatenate([[0], t.coarse[:-1]])  # that of an end, 0, before the first
            after = np.concatenate([t.coarse[1:], [0]])
            word = t.ending > 0
            line = t.ending[word] * 2 * COARSE
            total += np.bincount(np.concatenate([line + before[word], line + COARSE + after[word]]), minlength=len(total))
    if total.any():
        blocks = total.reshape(ENDINGS // _BLOCK, -1)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([blocks[i].astype(np.uint32).tobytes() for i in some], pa.binary())], names=["block", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(x.as_py(), np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])


def clustered(counts: np.ndarray, groups: int, rounds: int = 30) -> np.ndarray:
    """Group of each row of counts: k-means over the square roots of relative frequencies, weighted by the rows' totals."""
    weight = counts.sum(axis=1).astype(np.float64)
    x = np.sqrt(counts / np.maximum(weight, 1)[:, None])
    centre = x[[int(weight.argmax())]]
    far = np.square(x - centre[0]).sum(axis=1)
    for _ in range(groups - 1):
        new = x[int((far * weight).argmax())]
        centre, far = np.vstack([centre, new]), np.minimum(far, np.square(x - new).sum(axis=1))
    for _ in range(rounds):
        own = (np.square(centre).sum(axis=1)[None, :] - 2 * x @ centre.T).argmin(axis=1)
        for k in range(groups):
            if (w := weight * (own == k)).any():
                centre[k] = w @ x / w.sum()
    return own


def learn_classes(training: DataFrame) -> np.ndarray:
    """Class of each ending, from the neighbours of all words of the texts `_text`; the driver gets a table of fixed size."""
    blocks = ENDINGS // _BLOCK
    found = training.select("_text").mapInArrow(_neighbours, "block int, counts binary").repartition(blocks, "block").mapInArrow(_summed, "block int, counts binary")
    total = np.zeros((ENDINGS, 2 * COARSE), np.int64)
    for r in found.collect():
        total[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.counts, np.int64).reshape(_BLOCK, -1)
    return np.concatenate([[0], 1 + clustered(total[1:], CLASSES - 1)])


def _logits(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    out = weights.take(features[:, 0], axis=0)
    for i in range(1, features.shape[1]):
        out += weights.take(features[:, i], axis=0)
    out -= out.max(axis=1, keepdims=True)
    return out


def class_scores(weights: np.ndarray, tokens: Tokens) -> np.ndarray:
    """Natural log probability of each token's class in its context."""
    features = tokens.features(len(weights))
    out = np.zeros(len(features))
    for i in range(0, len(features), _BATCH):
        z = _logits(weights, features[i : i + _BATCH])
        own = z[np.arange(len(z)), tokens.cls[i : i + _BATCH]]
        out[i : i + _BATCH] = own - np.log(np.exp(z).sum(axis=1))
    return out


def descend(weights: np.ndarray, power: np.ndarray, tokens: Tokens, rate: float) -> None:
    """Adaptive gradient steps, in place, over batches of tokens."""
    features = tokens.features(len(weights))
    for i in range(0, len(features), _BATCH):
        f, c = features[i : i + _BATCH], tokens.cls[i : i + _BATCH]
        p = np.exp(_logits(weights, f))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), c] -= 1
        flat = f.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # there are 2^16 rows at most
        rows = flat[order]
        at = np.flatnonzero(np.diff(rows, prepend=-1))
        g = np.add.reduceat(p.take(order // f.shape[1], axis=0), at, axis=0)
        rows = rows[at]
        power[rows] += np.square(g)
        weights[rows] -= rate * g / np.sqrt(power[rows])


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Equal (hash, class before) of (hash, class, class before, n) as one."""
    h, c, x, n = (np.concatenate(p) for p in zip(*parts, strict=True))
    _, at, of = np.unique(B.mixed(h + x.astype(B.U64) * B.U64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
    return h[at], c[at], x[at], np.bincount(of, n).astype(np.int64)


def _counts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            h, c, x, n = _merged(parts)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int8)), pa.array(x.astype(np.int8)), pa.array(n)], names=["h", "cls", "x", "n"])

        parts, size = [], 0
        for b in batches:
            buf, off = B.text_bytes(b.column("_text"))
            for lo, hi in B.row_slices(b.column("_text")):
                t = Tokens.of(buf, off, lo, hi, sent.value)
                parts.append(_merged([(t.hash, t.cls, t.before(), np.ones(len(t.hash)))]))
                size += len(parts[-1][0])
                if size > _COUNTS_AT_ONCE:
                    yield out(parts)
                    parts, size = [], 0
        if parts:
            yield out(parts)

    return run


def token_counts(training: DataFrame, classes: np.ndarray) -> DataFrame:
    """(h, cls, c, by) for each different token of the texts `_text`: its 64-bit hash, class, count, and counts n by the class x before it."""
    sent = training.sparkSession.sparkContext.broadcast(classes)
    n = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = training.select("_text").mapInArrow(_counts(sent), "h bigint, cls tinyint, x tinyint, n bigint").repartition(n, "h")
    pairs = found.groupBy("h", "x").agg(F.first("cls").alias("cls"), F.sum("n").alias("n"))
    return written(pairs.groupBy("h").agg(F.first("cls").alias("cls"), F.sum("n").alias("c"), F.collect_list(F.struct("x", "n")).alias("by")), "counts")


def train(training: DataFrame, classes: np.ndarray, features: int, rounds: int = ROUNDS, rate: float = 0.3) -> np.ndarray:
    """Weights (features x CLASSES) from all texts `_text` of training (`_ord`, `_text`)."""
    spark = training.sparkSession
    weights = np.zeros((features, CLASSES), np.float32)
    blocks = features // _BLOCK
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((weights, classes))

        def steps(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start, classes = sent.value
            own, power = start.copy(), np.full(start.shape, POWER, np.float32)
            any_row = False
            for b in batches:
                buf, off = B.text_bytes(b.column("_text"))
                for lo, hi in B.row_slices(b.column("_text")):
                    any_row = True
                    descend(own, power, Tokens.of(buf, off, lo, hi, classes), rate)
            if any_row:
                change = (own - start).astype(np.float16).reshape(blocks, -1)
                for i in range(0, blocks, 64):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 64, dtype=np.int32)), pa.array([x.tobytes() for x in change[i : i + 64]], pa.binary())], names=["block", "change"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, tuple[np.ndarray, int]] = {}
            for b in batches:
                for k, x in zip(b.column("block").to_pylist(), b.column("change"), strict=True):
                    s, n = total.get(k, (0, 0))
                    total[k] = s + np.frombuffer(x.as_py(), np.float16).astype(np.float64), n + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for s, n in total.values()], pa.binary())], names=["block", "change"])

        part = training.filter(F.pmod(F.xxhash64("_ord"), F.lit(rounds)) == r).select("_text")
        moved = part.mapInArrow(steps, "block int, change binary").repartition(min(blocks, 64), "block").mapInArrow(mean, "block int, change binary")
        weights = weights.copy()
        for x in moved.collect():  # features x CLASSES numbers, whatever the input
            weights[x.block * _BLOCK : (x.block + 1) * _BLOCK] += np.frombuffer(x.change, np.float32).reshape(_BLOCK, CLASSES)
        sent.unpersist()
    return weights


@dataclass
class Model:
    classes: np.ndarray
    weights: np.ndarray
    hashes: np.ndarray  # of frequent tokens, sorted
    counts: np.ndarray
    by: np.ndarray  # of frequent tokens, counts by the class before
    class_total: np.ndarray  # of each class, smoothed
    seen: np.ndarray  # tokens by class and class before
    prior: np.ndarray  # weight of the class's frequencies there

    def in_class(self, c: np.ndarray, n: np.ndarray, cls: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Probability of tokens of count c, and count n after class x, in their class there."""
        a = self.prior[cls, x]
        return (n + a * (c + 0.5) / self.class_total[cls]) / (self.seen[cls, x] + a)


_SCORED = "_ord bigint, n bigint, known bigint, log_counts double, log_model double, rare array<bigint>, at array<smallint>, times array<int>"


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        rest = np.log10(m.seen + m.prior)
        for b in batches:
            buf, off = B.text_bytes(b.column("_text"))
            order = b.column("_ord")
            for lo, hi in B.row_slices(b.column("_text")):
                t = Tokens.of(buf, off, lo, hi, m.classes)
                rows, x = hi - lo, t.before()
                at = np.minimum(np.searchsorted(m.hashes, t.hash), max(len(m.hashes) - 1, 0))
                sure = m.hashes[at] == t.hash if len(m.hashes) else np.zeros(len(t.hash), bool)
                logs = np.bincount(t.row[sure], np.log10(m.counts[at[sure]] + 0.5), rows).astype(float)
                model = class_scores(m.weights, t) / np.log(10)
                model[sure] += np.log10(m.in_class(m.counts[at[sure]], m.by[at[sure], x[sure]], t.cls[sure], x[sure]))
                model[~sure] -= rest[t.cls[~sure], x[~sure]]
                # the others go on by token and class before, each once a text
                rare_row, rare, context = t.row[~sure], t.hash[~sure], (t.cls * _BEFORE + x)[~sure]
                by = np.lexsort((context, rare, rare_row))
                rare_row, rare, context = rare_row[by], rare[by], context[by]
                differs = (np.diff(rare_row) != 0) | (rare[1:] != rare[:-1]) | (np.diff(context) != 0)
                new = np.flatnonzero(np.concatenate([[True], differs])[: len(rare)])
                times = np.diff(np.append(new, len(rare))).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(np.bincount(rare_row[new], minlength=rows))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (rare[new].view(np.int64), context[new].astype(np.int16), times)]
                figures = [pa.array(np.bincount(t.row, minlength=rows)), pa.array(np.bincount(t.row[sure], minlength=rows)), pa.array(logs, pa.float64()), pa.array(np.bincount(t.row, model, rows), pa.float64())]
                yield pa.RecordBatch.from_arrays([order.slice(lo, rows), *figures, *lists], names=[f.split()[0] for f in _SCORED.split(", ")])

    return run


def learn(training: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame, int, int]:
    """The model of the texts `_text` of training (`_ord`, `_text`), its token counts, their sum and number."""
    classes = learn_classes(training)
    counts = token_counts(training, classes)
    contexts = counts.select("cls", F.explode("by").alias("b")).groupBy("cls", "b.x").agg(F.sum("b.n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # by class and class before
    different = np.zeros(CLASSES)
    for r in counts.groupBy("cls").agg(F.count(F.lit(1)).alias("v")).collect():
        different[r.cls] = r.v
    seen, prior = np.zeros((CLASSES, _BEFORE)), np.ones((CLASSES, _BEFORE))
    for r in contexts:
        seen[r.cls, r.x], prior[r.cls, r.x] = r.n, 1 + SMOOTHING * r.v
    total = int(seen.sum())
    sent = counts.filter(F.col("c") >= max(1, SENT_SHARE * total)).select("h", "c", F.map_from_entries("by").alias("by"))
    sent = sent.select("h", "c", *(F.coalesce(F.element_at("by", F.lit(i).cast("tinyint")), F.lit(0)).cast("float").alias(f"x{i}") for i in range(_BEFORE))).toPandas()
    hashes = sent.h.to_numpy().astype(np.int64).view(B.U64)
    by = np.argsort(hashes)
    features = 1 << min(MOST_FEATURES, max(LEAST_FEATURES, (int(different.sum()) // 8).bit_length()))
    weights = train(training, classes, features, rounds)
    table = sent[[f"x{i}" for i in range(_BEFORE)]].to_numpy().astype(np.float32)
    model = Model(classes, weights, hashes[by], sent.c.to_numpy().astype(np.float64)[by], table[by], seen.sum(axis=1) + 0.5 * (different + 1), seen, prior)
    return model, counts, total, int(different.sum())


def score(docs: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every document; training: a condition on the id.

    Tokens are lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ and one end a text; a null text counts as empty and has an end.  base_score
    sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; score is the model's log10 probability of the text.  In a class, a token has
    p = (c + 0.5) / (the class's counts + 0.5 (its different tokens + 1)), and after class x (n + a p) / (all n there + a), where
    a is 1 + SMOOTHING for each different token there.  Counts are of all training documents and exact, up to tokens of equal 64-bit
    hashes; they grow with the input, while the class softmax has a fixed size.  Frequent tokens (SENT_SHARE) are looked up where
    they stand; the others are joined by a shuffle.  Rows of equal ids are rows of their own.  Without training documents all
    counts are zero; an empty table gives an empty result.  Whole texts are read, a slice of texts at a time or one that is longer.
    """
    rows, _ = ordered(docs, id_col, text_col)
    rows = rows.select(F.col(id_col), "_ord", F.col(text_col).alias("_text"))
    return scores(rows, id_col, *learn(rows.filter(training).select("_ord", "_text"), rounds))


def scores(rows: DataFrame, id_col: str, model: Model, counts: DataFrame, total: int, different: int) -> DataFrame:
    """The result of score() for rows (id_col, `_ord`, `_text`) by a learned model."""
    spark = rows.sparkSession
    shares = F.array(*(F.lit(float(v)) for v in (model.prior / model.class_total[:, None]).ravel()))
    scored = written(rows.select("_ord", "_text").mapInArrow(_score(spark.sparkContext.broadcast(model)), _SCORED), "scored")

    rare = scored.select("_ord", F.explode(F.arrays_zip("rare", "at", "times")).alias("x")).select("_ord", F.col("x.rare").alias("h"), F.col("x.at").alias("at"), F.col("x.times").alias("times"))
    c = F.coalesce("c", F.lit(0)) + 0.5
    n = F.coalesce(F.get(F.filter("by", lambda b: b["x"] == F.col("at") % _BEFORE), F.lit(0))["n"], F.lit(0))
    rare = rare.join(counts.select("h", "c", "by").hint("merge"), "h", "left").groupBy("_ord").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("times") * F.log10(c)).alias("log_rare"),
        F.sum(F.col("times") * F.log10(n + F.get(shares, F.col("at")) * c)).alias("model_rare"),
    )
    out = rows.select(id_col, "_ord").join(scored.drop("rare", "at", "times").hint("shuffle_hash"), "_ord").join(rare.hint("shuffle_hash"), "_ord", "left")
    logs = F.col("log_counts") + F.coalesce("log_rare", F.lit(0.0))
    return out.select(
        id_col,
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (logs - F.col("n") * F.lit(float(np.log10(total + 0.5 * (different + 1))))).alias("base_score"),
        (F.col("log_model") + F.coalesce("model_rare", F.lit(0.0))).alias("score"),
    )
