"""Scalar functions of the engine as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER, NUMBER = r"^\s*[+-]?[0-9]+\s*$", r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\s*$"
TIMESTAMP = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?(Z|[+-][0-9]{2}:[0-9]{2})?)?\s*$"


def trim(c: Column) -> Column:
    return F.trim(c)


def nullify_empty(c: Column) -> Column:
    """Null for blank text; other text is untouched."""
    return F.when(F.trim(c) != "", c)


def to_int(c: Column) -> Column:
    return F.when(c.rlike(INTEGER), F.trim(c).try_cast("bigint"))


def to_decimal(c: Column) -> Column:
    """Not-a-number and infinity are no numbers."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("decimal(18,4)"))


def to_minor_units(c: Column) -> Column:
    """Hundredths, half to even, without floating point."""
    return F.bround(to_decimal(c) * 100, 0).cast("bigint")


def to_timestamp(c: Column) -> Column:
    """ISO 8601 only; without a zone it is UTC."""
    return F.when(c.rlike(TIMESTAMP), F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00")))


def humanise(c: Column) -> Column:
    spaced = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1000))


def age_label(seconds: Column) -> Column:
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(whole(60), F.lit("m"))).when(seconds < 172800, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))


def money(minor: Column) -> Column:
    return F.format_number((minor / 100).cast("decimal(20,2)"), 2)


def percent(ratio: Column) -> Column:
    return F.format_string("%.1f%%", ratio * 100)


def linear_scale(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Clamped; a domain without width gives the range's start."""
    if high == low:
        return F.lit(to_low)
    return to_low + F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (to_high - to_low)


def delta_label(now: Column, before: Column) -> Column:
    """No comparison is not the same as no change."""
    return F.when(now.isNull() | before.isNull(), "no comparison available").when(now > before, "up").when(now < before, "down").otherwise("unchanged")


def subsequence(text: Column, query: str) -> Column:
    """Whether the letters of query occur in text in that order, whatever the case."""
    return F.lower(text).rlike(".*".join("\\Q" + c + "\\E" for c in query.lower()))


def redact(c: Column, secrets: list[str]) -> Column:
    for s in secrets:
        c = F.replace(c, F.lit(s), F.lit("***"))
    return c


TRANSFORMS = {"trim": trim, "lower": F.lower, "upper": F.upper, "to_int": to_int, "to_decimal": to_decimal, "to_timestamp": to_timestamp, "to_minor_units": to_minor_units, "nullify_empty": nullify_empty}
#: Those whose null result for a non-null input is a rejected record.
PARSERS = frozenset(("to_int", "to_decimal", "to_timestamp", "to_minor_units"))


def linear_unscale(y: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """The way back of linear_scale; a range without width gives the domain's start."""
    return linear_scale(y, to_low, to_high, low, high)


def band_start(index: Column, count: int, width: float, padding: float = 0.2) -> Column:
    """Where the band of an index begins, of count bands across width, each with its share of padding."""
    step = width / max(1, count)
    return index * step + (step - max(0.0, step * (1 - padding))) / 2


def nice_step(low: Column, high: Column, target: int = 5) -> Column:
    """The least of 1, 2 or 5 times a power of ten that needs no more than about target steps."""
    raw = (high - low) / max(1, target)
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    share = raw / power
    return F.when(share <= 1, 1.0).when(share <= 2, 2.0).when(share <= 5, 5.0).otherwise(10.0) * power


def nice_ticks(low: Column, high: Column, target: int = 5) -> Column:
    """Ticks that span low to high; a single one if they are equal, null if either is unknown or no number."""
    a, b = F.least(low, high), F.greatest(low, high)
    step = nice_step(a, b, target)
    ticks = F.transform(F.sequence(F.floor(a / step), F.ceil(b / step)), lambda i: F.round(i * step, 9))
    known = low.isNotNull() & high.isNotNull() & (F.abs(low) < float("inf")) & (F.abs(high) < float("inf"))
    return F.when(known & (a == b), F.array(a)).when(known, ticks)


def digest_of_key(key: Column) -> Column:
    """The digest that a content-addressed key ends with: its last part up to the first dot."""
    return F.regexp_extract(key, r"([^/.]*)[^/]*$", 1)


def lookup(values: Column, key: str) -> Column:
    """A value of a map, null where it isn't there."""
    return F.try_element_at(values, F.lit(key))


def required(values: Column, key: str) -> Column:
    """A value of a map; where it isn't there the query fails and names it."""
    return F.coalesce(lookup(values, key), F.raise_error(F.lit(f"the dimension {key} is missing")).cast("string"))
