"""Fulfilment routing: which ways of serving a request there are, ranked; one expression, no user code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The score of each route.
SCORES = {
    "staff_delivery_green": 98,
    "staff_delivery_amber": 63,
    "staff_delivery_accessibility": 82,
    "companion_green": 76,
    "companion_constrained": 91,
    "self_collection_red": 74,
    "self_collection": 48,
    "batch_amber": 88,
    "batch": 70,
    "before_i_finish_preferred": 86,
    "before_i_finish": 42,
    "checkout_preferred": 75,
    "checkout": 45,
    "reserve_nearby_with_stock": 39,
    "reserve_nearby_without_stock": 81,
    "home_delivery_with_stock": 31,
    "home_delivery_without_stock": 77,
    "alternative_product": 96,
    "unable": 1,
}
CONFIDENCE = ("check", "likely", "confirmed")


@dataclass(frozen=True)
class Policy:
    amber_queue: int = 5
    red_queue: int = 10
    batch_minutes: int = 8
    promise_minutes: int = 12
    least_confidence: str = "likely"
    disabled: tuple[str, ...] = ()


def capacity(queue: Column, policy: Policy) -> Column:
    return F.when(queue >= policy.red_queue, "red").when(queue >= policy.amber_queue, "amber").otherwise("green")


def unmet_reason(policy: Policy) -> Column:
    """Why stock can't be used; null when it can."""
    sure = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("stock_confidence"))
    return F.when(F.col("stock_units") <= 0, "no_stock").when(sure < CONFIDENCE.index(policy.least_confidence) + 1, "confidence_below_minimum")


def rank(requests: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """request_id, rank, method, score, estimate, reason: one row for each route, best first, names breaking ties.

    requests: request_id, queue_length, location, stock_units, stock_confidence, walking_minutes, timing, companion, batch, accessibility, online, nearby.
    """
    rows = requests.withColumn("capacity", capacity(F.col("queue_length"), policy)).withColumn("why", unmet_reason(policy))
    stocked = F.col("why").isNull()
    minutes = F.greatest(F.lit(2), F.col("walking_minutes") + F.when(F.col("location") == "stockroom", 3).otherwise(1))
    at, timing = F.col("capacity"), F.col("timing")
    pick = lambda cond, a, b: F.when(cond, SCORES[a]).otherwise(SCORES[b])

    def route(method: str, available: Column, score: Column, time: Column, reason: Column | None = None) -> Column:
        estimate = F.when(time <= policy.promise_minutes, F.concat(F.lit("About "), time.cast("string"), F.lit(" min"))).otherwise("Timing will be confirmed")
        made = F.struct((-score).alias("order"), F.lit(method).alias("method"), estimate.alias("estimate"), (reason if reason is not None else F.lit(None).cast("string")).alias("reason"))
        return F.when(available & F.lit(method not in policy.disabled), made)

    zero = F.lit(0)
    staff = F.when(at == "green", SCORES["staff_delivery_green"]).when(at == "amber", SCORES["staff_delivery_amber"]).otherwise(SCORES["staff_delivery_accessibility"])
    routes = [
        route("staff_delivery_now", stocked & ((at != "red") | F.col("accessibility")), staff, minutes, F.when(F.col("accessibility"), "accessibility_need")),
        route("companion_collection", stocked & F.col("companion"), pick(at == "green", "companion_green", "companion_constrained"), minutes),
        route("customer_self_collection", stocked, pick(at == "red", "self_collection_red", "self_collection"), minutes),
        route("batch_pick", stocked & F.col("batch"), pick(at == "amber", "batch_amber", "batch"), minutes + policy.batch_minutes),
        route("bring_before_i_finish", stocked, pick(timing == "before_i_finish", "before_i_finish_preferred", "before_i_finish"), minutes + 3),
        route("collect_at_checkout", stocked, pick(timing == "no_rush", "checkout_preferred", "checkout"), minutes + 5),
        route("reserve_nearby", F.col("nearby"), pick(stocked, "reserve_nearby_with_stock", "reserve_nearby_without_stock"), zero),
        route("home_delivery", F.col("online"), pick(stocked, "home_delivery_with_stock", "home_delivery_without_stock"), zero),
        route("alternative_product", ~stocked, F.lit(SCORES["alternative_product"]), zero, F.col("why")),
    ]
    unable = F.struct(F.lit(-SCORES["unable"]).alias("order"), F.lit("unable_to_fulfil").alias("method"), F.lit("Unavailable").alias("estimate"), F.coalesce("why", F.lit("no_enabled_method")).alias("reason"))
    offered = F.array_sort(F.filter(F.array(*routes), lambda r: r.isNotNull()))
    all_routes = F.when(F.size(offered) > 0, offered).otherwise(F.array(unable))
    return rows.select("request_id", F.posexplode(all_routes).alias("place", "r")).select("request_id", (F.col("place") + 1).alias("rank"), "r.method", (-F.col("r.order")).alias("score"), "r.estimate", "r.reason")
