"""What Spark has no function for: normal form C and case folding.  Only the characters that they can change go to Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeezed

#: Characters that normal form C neither changes, nor moves, nor joins to the one before, as the inside of a Java character class: up to Latin, Greek,
#: Cyrillic, punctuation, Kana, Han and Hangul.  Others of this kind may be missing here: they only go the longer way.
SETTLED = "\\x00-\\u02FF\\u0388-\\u03FF\\u0400-\\u0482\\u048A-\\u0530\\u2010-\\u2027\\u2030-\\u205E\\u20A0-\\u20C0\\u3001-\\u3029\\u3041-\\u3096\\u30A0-\\u30FF\\u4E00-\\u9FFF\\uAC00-\\uD7A3"
_AT_ONCE = 4096


def _each(f: Callable[[str], str]):
    """A function of arrays of strings, for each of their strings; a few of them are Python objects at a time."""

    @F.arrow_udf("array<string>")
    def run(found: pa.Array) -> pa.Array:
        values = found.flatten()
        out = [pa.array([f(x.as_py()) for x in values.slice(i, _AT_ONCE)], pa.string()) for i in range(0, len(values), _AT_ONCE)]
        ends = pc.cumulative_sum(found.value_lengths().cast(pa.int32()))
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), pa.concat_arrays(out) if out else pa.array([], pa.string()))

    return run


def replaced(c: Column, pattern: str, f: Callable[[str], str], where: Column, rest: Callable[[Column], Column] = lambda x: x) -> Column:
    """c with f(match) for each match of the pattern (Java's, never empty), and rest() of what stands between; null for null.

    Only the matches go to Python, so its memory follows them and not the texts.  where: what is to be looked through at all, a cheap condition that
    holds for every c with a match.
    """
    none = F.expr("cast(array() AS array<string>)")
    put = _each(f)(F.coalesce(F.when(where, F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), none))
    whole = F.array_join(F.zip_with(F.split(c, pattern, -1), put, lambda a, b: F.concat(rest(a), F.coalesce(b, F.lit("")))), "")
    return F.when(F.size(put) > 0, whole).otherwise(rest(c))


def composed(c: Column) -> Column:
    """Normal form C."""
    return replaced(c, f"[{SETTLED}]?[^{SETTLED}]++", lambda x: unicodedata.normalize("NFC", x), c.rlike("[^\\x00-\\u02FF]"))


def case_folded(c: Column) -> Column:
    """Normal form C, then case-folded."""
    return replaced(c, "[\\x00-\\x7F]?[^\\x00-\\x7F]++", lambda x: unicodedata.normalize("NFC", x).casefold(), F.octet_length(c) > F.length(c), F.lower)


def normal_text(c: Column) -> Column:
    """NFC and squeezed: the same words in the same letters."""
    return composed(squeezed(F.coalesce(c, F.lit(""))))


def text_key(c: Column) -> Column:
    """NFC, squeezed and case-folded: equal keys mean equal texts to a reader."""
    return case_folded(squeezed(F.coalesce(c, F.lit(""))))
