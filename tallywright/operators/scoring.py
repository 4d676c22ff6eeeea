"""Confidence and exposure arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weight of each confidence component, the band limits and the caps.
WEIGHTS = {
    "sample_size": 0.20,
    "completeness": 0.20,
    "freshness": 0.15,
    "source_agreement": 0.15,
    "metric_stability": 0.10,
    "detector_fit": 0.15,
    "identity_match": 0.05,
}
LOW_BELOW, HIGH_ABOVE = 0.4, 0.7
CAP_LOW_BELOW, CAP_MEDIUM_BELOW, WIDE_RATIO = 0.1, 0.2, 5.0
BANDS = ("low", "medium", "high")


def sample_size(n: Column, least: int) -> Column:
    return F.lit(1.0) if least <= 0 else F.least(F.lit(1.0), n.cast("double") / least)


def freshness(age_seconds: Column, latency_seconds: float) -> Column:
    age = age_seconds.cast("double")
    return F.when(F.lit(latency_seconds <= 0) | (age <= latency_seconds), 1.0).otherwise(latency_seconds / age)


def score(components: dict[str, Column]) -> Column:
    """Weighted mean of the components that are known, unrounded; null if none is."""
    total = sum((F.coalesce(c.cast("double") * WEIGHTS[k], F.lit(0.0)) for k, c in components.items()), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in components.items()), F.lit(0.0))
    return total / F.nullif(weight, F.lit(0.0))


def band_rank(components: dict[str, Column], attribution: bool = False, low: Column | None = None, high: Column | None = None) -> Column:
    """0 low, 1 medium, 2 high, after the caps."""
    s = score(components)
    rank = F.when(s < LOW_BELOW, 0).when(s > HIGH_ABOVE, 2).otherwise(1)
    weakest = F.least(*components.values(), F.lit(1.0)) if len(components) > 1 else next(iter(components.values()))
    rank = F.least(rank, F.when(weakest < CAP_LOW_BELOW, 0).when(weakest < CAP_MEDIUM_BELOW, 1).otherwise(2))
    if low is not None and high is not None:
        rank = F.least(rank, F.when((low > 0) & (high / F.nullif(low, F.lit(0)) > WIDE_RATIO), 0).otherwise(2))
    return F.least(rank, F.lit(1)) if attribution else rank


def band(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(b) for b in BANDS]), rank + 1)


def exposure(factors: list[tuple[Column, Column, Column]]) -> list[Column]:
    """Low, base and high as whole minor units, half up, of a product of (low, base, high) factors."""
    out = []
    for i in range(3):
        product = F.lit(1).cast("decimal(38,10)")
        for f in factors:
            product = (product * f[i]).cast("decimal(38,10)")
        out.append(F.round(product, 0).cast("long"))
    return out


def weight_record(components: dict[str, Column]) -> list[Column]:
    """(weights, dropped): the known components' weights, normalised to 4 digits, and the names of the unknown, both by name."""
    names = sorted(components)
    total = sum((F.when(components[k].isNotNull(), WEIGHTS[k]).otherwise(0.0) for k in names), F.lit(0.0))
    weights = F.filter(F.array(*[F.when(components[k].isNotNull(), F.struct(F.lit(k).alias("name"), F.round(F.lit(WEIGHTS[k]) / total, 4).alias("weight"))) for k in names]), lambda w: w.isNotNull())
    dropped = F.filter(F.array(*[F.when(components[k].isNull(), k) for k in names]), lambda n: n.isNotNull())
    return [weights, dropped]


def exposure_faults(low: Column, base: Column, high: Column, currency: Column, assumptions: Column) -> Column:
    """Why an exposure can't be stated: it isn't ordered, has no currency of three letters, or rests on no assumption."""
    faults = [
        F.when(~F.coalesce((low <= base) & (base <= high), F.lit(False)), "not_ordered"),
        F.when(~F.coalesce(currency.rlike("^[A-Za-z]{3}$"), F.lit(False)), "no_currency"),
        F.when(F.coalesce(F.size(assumptions), F.lit(0)) < 1, "no_assumptions"),
    ]
    return F.filter(F.array(*faults), lambda f: f.isNotNull())


def assumption(key: str, statement: str, low: Column, base: Column, high: Column, source: str, kind: str) -> Column:
    """One input of an exposure as a record, whether observed or assumed."""
    value = F.concat(low.cast("string"), F.lit(".."), high.cast("string"), F.lit(" (base "), base.cast("string"), F.lit(")"))
    return F.struct(F.lit(key).alias("key"), F.lit(statement).alias("statement"), value.alias("value"), F.lit(source).alias("source"), F.lit(kind).alias("kind"))


# The wording of the statements below.
def describe(low_minor: Column, high_minor: Column, currency: Column, confidence: Column) -> Column:
    """The one wording of an exposure; it never speaks of savings."""
    money = lambda c: F.format_number((c / 100).cast("decimal(38,2)"), 2)
    return F.concat(F.lit("Estimated exposure "), F.upper(currency), F.lit(" "), money(low_minor), F.lit("\u2013"), money(high_minor), F.lit(" ("), confidence, F.lit(" confidence)"))
