"""Language identification with language-bitmask n-gram filters.

A learned table has, for a slot of a Bloom filter, a bit for each language, in as many 64-bit words as they need.  The conjunction of an n-gram's slots gives the
languages that contain it, all at once.  Per-language counts over a text's n-grams, less the expected false positives, decide.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from ._spark import schema_of, written

#: Labelled documents of each language to learn from, about.
DOCS_PER_LANGUAGE = 2000
#: A language contains an n-gram that makes up more than this share of its n-grams, so 1 / share n-grams at most; one rule for all languages.
LEAST_SHARE = 1e-5
#: It doesn't contain one that another language uses so many times as often.
MOST_TIMES = 20.0
#: Slots of the filter for each n-gram of the language that contains most, a power of two in all.
SLOTS_PER_GRAM = 8
PROBES = 3


class _Letters:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        return cls.table


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of code points as exact 63-bit keys, the number of the text of each, and whether each text has a letter.

    Texts are lower-cased; a run of anything but letters is one boundary, code 0; a trigram has a letter in its middle.
    """
    code = np.frombuffer("\0".join(["", *((t or "").lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    # texts may hold U+0000 of their own: the boundaries between texts come from the lengths
    size = np.array([len((t or "").lower()) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)]) + 1
    letter = _Letters.get()[code]
    code = np.where(letter, code, 0).astype(B.U64)
    keep = letter | np.concatenate([[True], letter[:-1]])
    at = np.flatnonzero(keep)
    code, letter = code[at], letter[at]
    if len(code) < 3:
        return np.zeros(0, B.U64), np.zeros(0, np.int64), np.zeros(len(texts), bool)
    key = code[:-2] << B.U64(42) | code[1:-1] << B.U64(21) | code[2:]
    middle = letter[1:-1]
    key, at = key[middle], at[1:-1][middle]
    row = np.searchsorted(begin, at, side="right") - 1
    return key, row, np.bincount(row, minlength=len(texts))[: len(texts)] > 0


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    for lo, hi in B.row_slices(column, 1 << 19):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


@dataclass
class LanguageModel:
    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], key: np.ndarray, lang: np.ndarray) -> LanguageModel:
        """From n-grams and the number of a language that contains each; a row of slots for 64 languages each."""
        most = int(np.bincount(lang, minlength=1).max()) if len(lang) else 1
        slots = np.zeros((-(-len(languages) // 64), 1 << max(12, (SLOTS_PER_GRAM * most - 1).bit_length())), B.U64)
        for i in cls.places(key, slots.shape[1]):
            np.bitwise_or.at(slots, (lang >> 6, i), B.U64(1) << (lang & 63).astype(B.U64))
        fill = np.array([((slots[b >> 6] >> B.U64(b & 63)) & B.U64(1)).mean() for b in range(len(languages))])
        return cls(languages, slots, fill**PROBES)

    @staticmethod
    def places(key: np.ndarray, slots: int) -> list[np.ndarray]:
        h, width = B.mixed(key), slots.bit_length() - 1
        return [((h >> B.U64(i * width)) & B.U64(slots - 1)).astype(np.int64) for i in range(PROBES)]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        best, score = np.full(len(column), -1), np.zeros(len(column))
        for lo, hi, texts in _slices(column):
            key, row, some = grams(texts)
            n = np.bincount(row, minlength=hi - lo)
            hits, places = np.zeros((hi - lo, len(self.languages))), self.places(key, self.slots.shape[1])
            for w, slots in enumerate(self.slots):
                mask = np.full(len(key), ~B.U64(0))
                for i in places:
                    mask &= slots[i]
                for b in range(64 * w, min(64 * w + 64, len(self.languages))):
                    hits[:, b] = np.bincount(row, ((mask >> B.U64(b & 63)) & B.U64(1)).astype(np.float64), hi - lo)
            if hits.shape[1]:
                true = np.clip((hits - n[:, None] * self.false_rate) / (1 - self.false_rate), 0, None)
                best[lo:hi] = np.where(some, true.argmax(axis=1), -1)
                score[lo:hi] = np.where(some, true.max(axis=1) / np.maximum(n, 1), 0)
        names = [*self.languages, "und"]
        return [names[i] for i in best], np.clip(score, 0, 1)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE, least_share: float = LEAST_SHARE, most_times: float = MOST_TIMES) -> LanguageModel:
    """A model from labelled documents: about `docs_per_language` of each language, chosen by a hash of the id.

    A language contains the n-grams that make up more than `least_share` of its n-grams, but for those that another language uses
    more than `most_times` times as often; with 0 and infinity, all that it has.

    Rows without a label or a text are left out; every label is learned, from all n-grams of the chosen documents.  The counting
    is Spark's; what comes to the driver are two counts and, of each language, the n-grams above `least_share`, fewer than its inverse.
    """
    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id")).filter("lang IS NOT NULL")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel.build([], np.zeros(0, B.U64), np.zeros(0, np.int64))
    shares = docs.sparkSession.createDataFrame([(l, min(1.0, docs_per_language / counts[l])) for l in languages], "lang string, share double")
    chosen = labelled.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    number = {l: i for i, l in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
            for lo, hi, texts in _slices(b.column("text")):
                key, row, _ = grams(texts)
                own = langs[lo:hi][row]
                for lang in np.unique(own):
                    u, n = np.unique(key[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), lang)), pa.array(u.view(np.int64)), pa.array(n)], names=["l", "g", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "l bigint, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    counted = written(counted, "ngrams")
    total = np.ones(len(languages))
    for r in counted.groupBy("l").agg(F.sum("n").alias("n")).collect():
        total[r.l] = r.n
    least = docs.sparkSession.createDataFrame([(i, least_share * t) for i, t in enumerate(total.tolist())], "l bigint, least double")
    rows = counted.join(F.broadcast(least), "l").filter("n > least").select("l", "g", "n").toPandas()
    lang = rows.l.to_numpy().astype(np.int64)
    key, of = np.unique(rows.g.to_numpy().astype(np.int64).view(B.U64), return_inverse=True)
    rate, most = rows.n.to_numpy() / total[lang], np.zeros(len(key))
    np.maximum.at(most, of, rate)
    # not where another language uses the n-gram far more often
    has = rate >= most[of] / most_times
    return LanguageModel.build(languages, key[of[has]], lang[has])


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default, but those named as a result) with `_lang`, a learned language or `und`, and `_lang_score` from 0 to 1.

    `und` is for texts that are null or without a letter, and for all where nothing was learned; ties go to the first
    language by name.  The score is the share of the text's n-grams that the language contains.  Whole texts are read, of any length;
    repeated rows and ids are rows of their own, and an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("_lang", "_lang_score")] if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = sent.value.predict(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(lang, pa.string()), pa.array(score)], names=["_row", "_lang", "_lang_score"])

    return base.mapInArrow(run, schema_of([base.schema["_row"]], "_lang string, _lang_score double")).select("_row.*", "_lang", "_lang_score")


def keep_known(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least: float = 0.1) -> DataFrame:
    """docs without those in no language: und, or with a score below `least`; all columns stay, whatever their names.

    Where nothing was learned, all documents with a letter stay.
    """
    if not model.languages:
        return docs.filter(F.col(text_col).rlike("\\p{L}"))
    packed = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    return predict(packed, model, keep=["doc"]).filter((F.col("_lang") != "und") & (F.col("_lang_score") >= least)).select("doc.*")
