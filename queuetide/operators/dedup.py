"""Greedy price-ordered deduplication of offers, split by route and time.

An offer is dropped when a kept cheaper one shares its route, departs within the
time tolerance and is within the seat tolerance. The outcome of an offer depends
only on cheaper offers near it, so the work is split by time:

1. Offers equal in route, departure and seats always conflict, so only the cheapest
   can stay. One combinable aggregate removes the rest; afterwards a route has at
   most one row per (departure, seats).
2. Each (route, span of time) with a margin on both sides is folded in price order.
   Offers that conflict with no kept one are kept; what is kept in a span has pairwise
   no conflict, so it is bounded by the span's length, not by its offers. An offer is
   left open only if its outcome could hinge on something beyond the margin.
3. What is settled leaves. Open offers, with the kept ones near them, are folded again
   in spans of double length. Spans grow, so rounds are logarithmic in the longest
   chain of offers that hinge on one another; nearly always nothing is open after the
   first round. The result is the one of a single ordered scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import micros
from ..session import materialise

ROUTE = ["origin", "destination"]
SPOT = [*ROUTE, "us", "seats"]
DROPPED, OPEN, KEPT = 0, 1, 2
MOST_CELLS = 256
_NEAR = "array<struct<us:bigint,seats:int,row:bigint,state:int>>"


def _span(us: Column, length: int) -> Column:
    return F.floor(us / F.lit(length)).cast("bigint")


def _fold(offers: Column, sees_from: Column, length: int, reach: int, seat_gap: int) -> Column:
    """Kept and open offers of the ``length`` microseconds from ``sees_from``; ``offers`` come in price order.

    What is near is held by cell of time, at least ``reach`` wide, so an offer meets only
    its own cell and the two beside it, however many its route has.
    """
    width = max(reach, length // MOST_CELLS, 1)
    cells = -(-length // width)
    sees_to = sees_from + length

    def step(near: Column, offer: Column) -> Column:
        # From 1; the first and the last of all cells stay empty.
        cell = F.floor((offer["us"] - sees_from) / F.lit(width)).cast("int") + 1
        close = F.filter(F.flatten(F.slice(near, cell, 3)), lambda other: (F.abs(other["us"] - offer["us"]) <= reach)
                         & (F.abs(other["seats"] - offer["seats"]) <= seat_gap))
        around = F.coalesce(F.array_max(F.transform(close, lambda other: other["state"])), F.lit(DROPPED))
        inside = (offer["us"] - reach >= sees_from) & (offer["us"] + reach < sees_to)
        # By what is around: nothing, an open offer, a kept one.
        free = F.element_at(F.array(F.when(inside, KEPT).otherwise(OPEN), F.lit(OPEN), F.lit(DROPPED)), around + 1)
        state = F.when(offer["state"] == KEPT, KEPT).otherwise(free)

        def held(state: Column) -> Column:
            settled = F.array(F.struct(offer["us"].alias("us"), offer["seats"].alias("seats"), offer["row"].alias("row"), state.alias("state")))
            own = F.concat(F.element_at(near, cell + 1), settled)
            return F.concat(F.slice(near, 1, cell), F.array(own), F.slice(near, cell + 2, cells + 2))

        # An array of one binds the state, which is not worked out twice.
        return F.get(F.transform(F.array(state), lambda s: F.when(s == DROPPED, near).otherwise(held(s))), 0)

    return F.flatten(F.aggregate(offers, F.array_repeat(F.array().cast(_NEAR), cells + 2), step))


def _settled(rows: DataFrame, span: int, reach: int, seat_gap: int) -> DataFrame:
    """``rows`` (spot, row, price, offer_id, state) without those that a kept one covers; new states."""
    margin = max(6 * reach, span // 8)
    us = F.col("us")
    # A row is seen by its own span and by a neighbour whose margin holds it.
    seen = rows.withColumn("span", F.explode(F.sequence(_span(us - margin, span), _span(us + margin, span))))
    ordered = F.array_sort(F.collect_list(F.struct("price_value", "offer_id", "us", "seats", "row", "state")))
    begins = F.col("span") * span
    near = _fold(F.col("offers"), begins - margin, span + 2 * margin, reach, seat_gap)
    return (seen.groupBy(*ROUTE, "span").agg(ordered.alias("offers")).where(F.exists("offers", lambda o: o["state"] == OPEN))
            .select(*ROUTE, "span", F.explode(near).alias("s")).select(*ROUTE, "span", "s.*")
            .where(_span(us, span) == F.col("span")).drop("span"))


def dedup_offers(offers: DataFrame, minutes: int = 20, seat_gap: int = 2, first_span_hours: int = 6) -> DataFrame:
    """The kept offers. Equal prices are taken in ``offer_id`` order.

    Offers without a readable departure, without seats or without a route conflict with none and stay.

    Runs jobs: the input is written once with a number for each row, and the settled
    offers of each round are written. Only routes, times, prices and ids travel.
    """
    reach, span = minutes * 60_000_000, first_span_hours * 3_600_000_000
    placed = materialise(offers.withColumns({
        "us": micros("departs"), "seats": F.col("seats").cast("int"), "row": F.monotonically_increasing_id()}), "offers")
    whole = F.greatest(*[F.col(c).isNull().cast("int") for c in SPOT]) == 0
    first = F.min(F.struct("price_value", "offer_id", "row")).alias("r")
    cheapest = materialise(placed.where(whole).groupBy(*SPOT).agg(first).select(*SPOT, "r.*"), "cheapest")

    rows, kept = cheapest.withColumn("state", F.lit(OPEN)), None
    while True:
        settled = materialise(_settled(rows, span, reach, seat_gap), "settled")
        new = settled.where(F.col("state") == KEPT)
        # Offers kept before this round come along as neighbours; they are in ``kept`` already.
        kept = new if kept is None else kept.unionByName(new.join(kept, "row", "left_anti"))
        left = settled.where(F.col("state") == OPEN)
        if left.isEmpty():
            break
        span *= 2
        cell = F.floor(F.col("us") / F.lit(reach)).cast("bigint")
        cells = left.select(*ROUTE, F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell")).distinct()
        beside = (kept.withColumn("cell", cell).join(cells, [*ROUTE, "cell"], "left_semi").drop("cell"))
        rows = left.unionByName(beside).join(cheapest.select("row", "price_value", "offer_id"), "row")
    chosen = kept.select("row", F.lit(True).alias("_kept"))
    return placed.join(chosen, "row", "left").where(F.col("_kept") | ~whole).drop("us", "row", "_kept")
