"""Cleaning and folding of text columns.  All native: no Python runs for them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.split() treats as white space, as a Java character class.
BLANKS = "[\\s\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
_BLANK_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Dashes that count as a hyphen, and words that stand for a missing identity.
DASHES = "‐‑‒–—−"
NO_IDENTITY = ["<na>", "nan", "nat", "none", "null"]
# Titles that say nothing, and company names (folded) that name none.
NO_TITLE = "(?iU)archived[\\s/-]+placeholder|\\bjobs (?:in|near)\\b"
NO_COMPANY = ["", "unknown", "not specified", "n/a"]


def _accents() -> tuple[str, str]:
    """Characters whose canonical decomposition leaves one ASCII character, and that character."""
    pairs = []
    for i in range(128, 0x10000):
        kept = [c for c in unicodedata.normalize("NFD", chr(i)) if c < "\x80"]
        if len(kept) == 1:
            pairs.append((chr(i), kept[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def clean_value(c: Column, default: str = "") -> Column:
    """Trimmed text; null and blank become the default."""
    t = F.regexp_replace(c.cast("string"), f"^{BLANKS}|{BLANKS}$", "")
    return F.coalesce(F.when(t != "", t), F.lit(default))


def clean_number(c: Column, default: float) -> Column:
    """NaN and null become the default."""
    return F.when(c.isNull() | F.isnan(c), F.lit(default)).otherwise(c)


def clean_identity(c: Column) -> Column:
    """As clean_value, and words that stand for nothing become empty."""
    t = clean_value(c)
    return F.when(F.lower(t).isin(NO_IDENTITY), "").otherwise(t)


def folded(c: Column) -> Column:
    """ASCII lower case without accents: dashes as hyphens, other characters dropped, white space squeezed."""
    t = F.translate(F.coalesce(c, F.lit("")), _BLANK_CHARS + DASHES, " " * len(_BLANK_CHARS) + "-" * len(DASHES))
    plain = F.regexp_replace(F.translate(t, _ACCENTED, _PLAIN), "[^\\x00-\\x7F]+", "")
    t = F.when(t.rlike("[^\\x00-\\x7F]"), plain).otherwise(t)
    return F.trim(F.regexp_replace(F.lower(t), " {2,}", " "))


def ascii_lower(c: Column) -> Column:
    """Only A-Z change."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_contains(c: Column, part: Column) -> Column:
    """Substring search that folds A-Z only; % and _ mean themselves."""
    return F.contains(ascii_lower(c), ascii_lower(part))


def valid_title(c: Column) -> Column:
    """A title that says something: not blank, no placeholder of an archived record, not the heading of a search."""
    return (clean_value(c) != "") & ~F.coalesce(c, F.lit("")).rlike(NO_TITLE)


def primary_location(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The part before the first comma, with spellings of a city merged; Unknown if blank."""
    city = squeezed(F.split_part(F.coalesce(c, F.lit("")), F.lit(","), F.lit(1)))
    for spelling, name in (aliases or {}).items():
        city = F.when(F.lower(city) == spelling.lower(), name).otherwise(city)
    return F.when(city == "", "Unknown").otherwise(city)


def name_list(c: Column) -> Column:
    """Comma list to an array of folded tokens, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), folded), lambda x: x != "")


def query_key(c: Column, families: list[tuple[str, str, str]]) -> Column:
    """(key, name) of the first family whose pattern the folded term meets; else custom_<slug>."""
    t = folded(c)
    slug = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_|_$", "")
    found = F.struct(F.concat(F.lit("custom_"), slug).alias("key"), squeezed(c).alias("name"))
    for pattern, key, name in reversed(families):
        found = F.when(t.rlike(pattern), F.struct(F.lit(key).alias("key"), F.lit(name).alias("name"))).otherwise(found)
    return found


def salary_shown(c: Column) -> Column:
    """Null for wordings that tell nothing."""
    t = squeezed(c)
    return F.when(~t.rlike("(?i)^(not specified|not available|n/?a|unknown)?$"), t)


def locations_shown(names: Column) -> Column:
    """Two different names, then how many more there are."""
    d = F.array_distinct(names)
    more = F.size(d) - 2
    return F.concat(F.array_join(F.slice(d, 1, 2), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.when(more == 1, " more location").otherwise(" more locations"))).otherwise(""))


def years_shown(kind: Column, lower: Column, upper: Column) -> Column:
    """Bounds of years in words."""
    n = lambda c: F.regexp_replace(c.cast("string"), "\\.0$", "")
    return (
        F.when(kind == "minimum", F.concat(F.lit("at least "), n(lower), F.lit(" years")))
        .when(kind == "maximum", F.concat(F.lit("up to "), n(upper), F.lit(" years")))
        .when(kind == "range", F.concat(n(lower), F.lit(" to "), n(upper), F.lit(" years")))
        .when(kind == "exact", F.concat(n(lower), F.lit(" years")))
    )
