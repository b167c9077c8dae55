"""Time, digests, counters and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_utc(text: Column, zone: str = "Europe/Berlin") -> Column:
    """Any date-time text as an instant: with an offset as it says, without one as wall-clock time of the zone; bad text is null."""
    t = F.trim(text)
    zoned = t.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$") & t.contains(":")
    local = F.try_to_timestamp(F.when(~zoned, F.concat(t, F.when(t.contains(":"), "Z").otherwise(" 00:00:00Z"))))
    return F.when(zoned, F.try_to_timestamp(t)).otherwise(F.to_utc_timestamp(local, zone))


def to_second(c: Column) -> Column:
    return F.date_trunc("second", c)


def earliest(*c: Column) -> Column:
    """Smallest, nulls skipped."""
    return F.least(*c)


def latest(*c: Column) -> Column:
    return F.greatest(*c)


def active_days(first: Column, last: Column) -> Column:
    """Calendar days from first to last, both counted, one at least; null if either is missing."""
    days = F.datediff(last, first)
    return F.when(days.isNotNull(), F.greatest(F.lit(0), days) + 1)


def digest(*c: Column) -> Column:
    """SHA-256 of the columns as JSON, by name."""
    return F.sha2(F.to_json(F.struct(*c)), 256)


def text_list(items: Column) -> Column:
    """JSON array of the items that are not blank."""
    return F.to_json(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def counter(c: Column) -> Column:
    """A count that can't be negative; what is no number is 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(F.try_cast(c, "bigint") if hasattr(F, "try_cast") else c.try_cast("bigint"), F.lit(0).cast("bigint")))


def request_cost(tokens_in: Column, cached: Column, tokens_out: Column, prices: tuple[float, float, float] = (0.375, 0.0375, 2.25)) -> Column:
    """USD at prices for a million input, cached and output tokens."""
    return ((tokens_in - cached) * prices[0] + cached * prices[1] + tokens_out * prices[2]) / 1e6
