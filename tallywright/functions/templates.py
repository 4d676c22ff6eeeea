"""Message templates such as "{scope} was {rate:.1%} over {n:,} observations", compiled to column expressions.

Fields are named; what may follow the colon is a closed set: nothing (text as it is), ``d`` (whole number), ``,`` (with separators),
``.Nf`` and ``,.Nf`` (N decimals) and ``.N%`` (per cent). Unknown fields, other formats, conversions and look-ups inside a field are
refused when the template is compiled. Halves are rounded to even, in decimals. A null reads "unknown".
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
FORMAT = re.compile(r"(?P<sep>,?)(?:\.(?P<places>[0-9])(?P<kind>[f%]))?|d")


def _shown(value: Column, spec: str) -> Column:
    m = FORMAT.fullmatch(spec)
    if m is None or (m["kind"] == "%" and m["sep"]):
        raise ValueError(f"a field can't be shown as {spec!r}")
    if not spec:
        return value.cast("string")
    places = int(m["places"] or 0)
    number = value.cast("decimal(38,12)")
    rounded = F.bround(number * 100 if m["kind"] == "%" else number, places)
    text = F.format_number(rounded, places) if m["sep"] else rounded.cast(f"decimal(38,{places})").cast("string")
    return F.concat(text, F.lit("%")) if m["kind"] == "%" else text


def fields(template: str) -> list[str]:
    """The names that a template uses."""
    return [name for _, name, _, _ in Formatter().parse(template) if name is not None]


def compiled(template: str, **values: Column) -> Column:
    """The text of each row."""
    parts = []
    for text, name, spec, conversion in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is None:
            continue
        if not name.isidentifier() or conversion or "{" in (spec or ""):
            raise ValueError(f"{{{name}}} is no plain field")
        if name not in values:
            raise ValueError(f"unknown field {name}; there are {', '.join(sorted(values))}")
        parts.append(F.coalesce(_shown(values[name], spec or ""), F.lit(UNKNOWN)))
    return F.concat(*parts) if parts else F.lit("")
