"""Personal data in text: plain identifiers, and disguised ones by offset-preserving deobfuscation.

Base identifiers are found in the text as it stands.  A transducer then rewrites disguises (look-alike characters, spelled
digits, at/dot words) into a normal form and keeps, for each character written, the source range it came from; identifiers
found there are mapped back to source ranges.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import schema_of

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# runs of digits are taken whole: a match can't begin inside one
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """(start, kind, end) of the base identifiers: leftmost and not overlapping within a kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# Characters that look like an ASCII one.
LOOKALIKES = {
    "а": "a", "в": "B", "е": "e", "к": "k", "м": "M", "н": "H", "о": "o", "р": "p", "с": "c", "т": "T", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "\uFE6B": "@", "\u2024": ".", "\u3002": ".", "\u2010": "-", "\u2011": "-", "\u2013": "-", "\u2212": "-", "\u00A0": " ", "\u2009": " ", "\u202F": " ",
}
#: Full-width forms of ASCII, and digits of other scripts, follow from a rule.
LOOKALIKES |= {chr(0xFEE0 + i): chr(i) for i in range(33, 127)}
LOOKALIKES |= {chr(zero + i): str(i) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
#: Characters that are not seen.
UNSEEN = "\u200B\u200C\u200D\u2060\uFEFF\u00AD"
# Spelled digits.
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DIGIT_WORD = "|".join(SPELLED)
_OPEN, _CLOSE = r"[\[({<]\s*+", r"\s*+[\])}>]"
_DOMAIN_WORD = "[A-Za-z0-9-]++"
_ANY_AT = rf"(?:@|\s*+{_OPEN}(?:at|@){_CLOSE}\s*+|\s++at\s++)"
_HIDDEN_DOT = rf"(?:\s*+{_OPEN}(?:dot|\.){_CLOSE}\s*+|\s++dot\s++)"
# blanks before a bracket are tried once, from the first of them on; an address in words has one disguised dot at least
_RULES = re.compile(
    rf"""(?P<wordy>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_ANY_AT}{_DOMAIN_WORD}(?:\.{_DOMAIN_WORD})*+{_HIDDEN_DOT}{_DOMAIN_WORD}(?:(?:\.|{_HIDDEN_DOT}){_DOMAIN_WORD})*+)
    |(?P<at>(?<!\s)\s*+{_OPEN}(?:at|@){_CLOSE}\s*+)|(?P<dot>(?<!\s)\s*+{_OPEN}(?:dot|\.){_CLOSE}\s*+)
    |(?P<digits>(?<![A-Za-z0-9])(?:plus[\s-]++)?(?:{_DIGIT_WORD})(?:[\s,-]++(?:{_DIGIT_WORD}|dot|[0-9]++))*(?:[\s,-]++(?:{_DIGIT_WORD}|[0-9]++))(?![A-Za-z0-9]))""",
    re.IGNORECASE | re.VERBOSE,
)
#: Whether the transducers can change anything: RE2 syntax, for Arrow.
DISGUISED = (
    r"(?i)[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|\sdot\s|\b(?:" + _DIGIT_WORD + r")[\s,-]+(?:" + _DIGIT_WORD + r"|dot|[0-9])|[" + "".join(re.escape(c) if c.isascii() else c for c in LOOKALIKES if not c.isascii()) + UNSEEN + "]"
)
_INNER = re.compile(rf"(?P<word>{_DIGIT_WORD})|(?P<dot>dot)|(?P<plus>plus)|(?P<plain>[0-9]+)|(?P<gap>[\s,-]+)", re.IGNORECASE)
_WORDY = re.compile(rf"(?P<at>{_ANY_AT})|(?P<dot>{_HIDDEN_DOT})|(?P<plain>[A-Za-z0-9._%+-]++)", re.IGNORECASE)
_SEEN_AS = np.arange(0x110000, dtype="<u4")
_SEEN_AS[[ord(c) for c in LOOKALIKES]] = [ord(c) for c in LOOKALIKES.values()]
_UNSEEN_RUN = re.compile(f"[{UNSEEN}]+")


class Tape:
    """A text that is written piece by piece, and the source range of each piece.

    A copied piece stands for its source character by character, a written one for its range as a whole.
    """

    def __init__(self) -> None:
        self.text: list[str] = []
        self.at: list[int] = []  # where the pieces begin
        self.source: list[tuple[int, int, bool]] = []
        self.size = 0

    def put(self, text: str, lo: int, hi: int, copied: bool) -> None:
        if text:
            self.text.append(text)
            self.at.append(self.size)
            self.source.append((lo, hi, copied))
            self.size += len(text)

    def start(self, i: int) -> int:
        """Source place where character i begins."""
        k = bisect_right(self.at, i) - 1
        lo, _, copied = self.source[k]
        return lo + i - self.at[k] if copied else lo

    def end(self, i: int) -> int:
        """Source place where character i ends."""
        k = bisect_right(self.at, i) - 1
        lo, hi, copied = self.source[k]
        return lo + i - self.at[k] + 1 if copied else hi


def normal_form(text: str) -> tuple[str, Tape, Tape]:
    """The text with disguises undone, its tape over the text as it is seen, and that one's tape over the source."""
    seen, done = Tape(), 0
    same = _SEEN_AS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tobytes().decode("utf-32-le", "surrogatepass")
    for m in _UNSEEN_RUN.finditer(same):
        seen.put(same[done : m.start()], done, m.start(), True)
        done = m.end()
    seen.put(same[done:], done, len(same), True)
    shown = "".join(seen.text)
    out, done = Tape(), 0
    for m in _RULES.finditer(shown):
        out.put(shown[done : m.start()], done, m.start(), True)
        done = m.end()
        if m["at"]:
            out.put("@", m.start(), m.end(), False)
        elif m["dot"]:
            out.put(".", m.start(), m.end(), False)
        elif m["wordy"]:
            for x in _WORDY.finditer(shown, m.start(), m.end()):
                out.put("@" if x["at"] else "." if x["dot"] else x[0], x.start(), x.end(), bool(x["plain"]))
        else:
            for x in _INNER.finditer(shown, m.start(), m.end()):
                out.put(SPELLED[x[0].lower()] if x["word"] else "." if x["dot"] else "+" if x["plus"] else x[0] if x["plain"] else "", x.start(), x.end(), bool(x["plain"]))
    out.put(shown[done:], done, len(shown), True)
    return "".join(out.text), out, seen


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers of the normal form, as source ranges, where no plain one of the kind lies."""
    normal, out, seen = normal_form(text)
    if normal == text:
        return []
    # plain ones of a kind don't overlap, so that the last one that begins before an end is the one to look at
    starts: list[list[int]] = [[], [], [], []]
    ends: list[list[int]] = [[], [], [], []]
    for s, kind, e in plain:
        starts[kind].append(s)
        ends[kind].append(e)
    found = []
    for s, kind, e in plain_spans(normal):
        lo, hi = seen.start(out.start(s)), seen.end(out.end(e - 1) - 1)
        k = bisect_left(starts[kind], hi)
        if not k or ends[kind][k - 1] <= lo:
            found.append((lo, kind, hi))
    return found


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """text with every range of spans, overlapping ones as one, replaced by <KIND> of its first."""
    out, done = [], 0
    for s, k, e in sorted(spans):
        if s >= done:
            out += [text[done:s], f"<{KINDS[k].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


_EMPTY = hashlib.sha256(b"").hexdigest()
_FOUND = "_counts array<bigint>, _base_sha256 string, _base string, _all string, _masked string"


def find(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """The columns `keep` of docs (all by default, but those named as a result) with the personal data of the whole text.

    `_counts` of base spans by kind (email, ip, card, phone), `_base` and `_all` spans as kind:start:end (code points, end
    exclusive) by start, then kind, comma-joined; `_base_sha256` of `_base`; `_masked`, where asked for, the text with all
    spans replaced (null for null).  A null text counts as empty, an empty table gives an empty result, repeated rows and ids are
    rows of their own.  A disguised identifier is added where no base one of its kind overlaps it.  Whole texts are read, of any
    length: the work grows with the text.
    """
    keep = [c for c in docs.columns if c not in ("_counts", "_base_sha256", "_base", "_all", "_masked")] if keep is None else keep
    base = docs.select(F.struct(*keep).alias("_row"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("_text")
            text = text.cast(pa.string()) if pa.types.is_null(text.type) else text
            n = len(text)
            hint = pc.fill_null(pc.match_substring_regex(text, "[@0-9]"), False).to_numpy(zero_copy_only=False)
            odd = pc.fill_null(pc.match_substring_regex(text, DISGUISED), False).to_numpy(zero_copy_only=False)
            counts, digest, plain, every = [[0, 0, 0, 0]] * n, [_EMPTY] * n, [""] * n, [""] * n
            hidden: dict[int, str] = {}
            for i in (hint | odd).nonzero()[0].tolist():
                t = text[i].as_py()
                found = plain_spans(t) if hint[i] else []
                more = disguised_spans(t, found) if odd[i] else []
                if found:
                    counts[i] = [sum(k == j for _, k, _ in found) for j in range(4)]
                    plain[i] = render(found)
                    digest[i] = hashlib.sha256(plain[i].encode()).hexdigest()
                if found or more:
                    every[i] = render(found + more)
                    if mask:
                        hidden[i] = masked(t, found + more)
            clean = text if not hidden else pa.array([hidden.get(i) for i in range(n)], pa.string())
            if hidden:
                clean = pc.if_else(pc.is_null(clean), text, clean)
            if not mask:
                clean = pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), pa.array(counts, pa.list_(pa.int64())), pa.array(digest), pa.array(plain), pa.array(every), clean], names=["_row", "_counts", "_base_sha256", "_base", "_all", "_masked"]
            )

    return base.mapInArrow(run, schema_of([base.schema["_row"]], _FOUND)).select("_row.*", "_counts", "_base_sha256", "_base", "_all", "_masked")


def mask_text(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with all personal data in text_col replaced; all columns and rows stay."""
    packed = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"))
    found = find(packed, keep=["doc"], mask=True)
    return found.select(*(F.col("_masked").alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns))
