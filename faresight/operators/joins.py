"""Join operators. No side is hinted for broadcast, and none is counted to find out.

Equi joins are left to adaptive execution: it broadcasts a side that turns out small and splits the
partitions of a hot key. Sides that only need one row per key are aggregated before the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import as_date, names
from .ordered import top_k


def visible_rows(df: DataFrame, owners: DataFrame, owner_col: str = "user_id", owner_key: str = "id") -> DataFrame:
    """Rows owned by one of ``owners`` (profiles already restricted to the caller's identities)."""
    return df.join(owners.select(F.col(owner_key).alias(owner_col)), owner_col, "left_semi")


def visible_through(
    child: DataFrame, parent: DataFrame, owners: DataFrame, fk: str = "booking_id", parent_key: str = "id"
) -> DataFrame:
    """Two levels: child rows of parents owned by the caller."""
    own = visible_rows(parent, owners)
    return child.join(own.select(F.col(parent_key).alias(fk)), fk, "left_semi")


def own_profiles(profiles: DataFrame, identities: DataFrame) -> DataFrame:
    """Profiles whose sign-in identity is in ``identities(auth_user_id)``."""
    return profiles.join(identities.select("auth_user_id"), "auth_user_id", "left_semi")


def match_payments(events: DataFrame, bookings: DataFrame) -> DataFrame:
    """Bookings not yet paid that a captured payment settles; the first payment of an order counts."""
    paid = events.filter(F.col("event").isin("payment.captured", "order.paid"))
    first = paid.groupBy("order_id").agg(
        F.min(F.struct("ts", "payment_id")).alias("_p")
    ).select("order_id", F.col("_p.payment_id").alias("new_payment_id"), F.col("_p.ts").alias("paid_at"))
    unpaid = bookings.filter(F.coalesce(F.col("payment_status"), F.lit("")) != "PAID")
    return unpaid.join(first, "order_id")


def expand_grid(
    routes: DataFrame, offsets: Sequence[int], as_of, airlines: str | None = "airlines"
) -> DataFrame:
    """Route × horizon × airline rows, produced row by row from each route."""
    out = routes.withColumn("days_out", F.explode(F.array(*[F.lit(int(d)) for d in offsets])))
    out = out.withColumn("departure_date", F.date_add(as_date(as_of), F.col("days_out")))
    return out.withColumn("airline_code", F.explode(airlines)).drop(airlines) if airlines else out


def day_grid(df: DataFrame, days: int) -> DataFrame:
    """Adds ``day`` 1..days to every row."""
    return df.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))


def lookup_default(
    df: DataFrame, dim: DataFrame, keys: str | Sequence[str], defaults: Mapping[str, object]
) -> DataFrame:
    """Adds columns of a dimension (one row per key), each with a value for unknown keys.

    A default may be a Column, for instance the key itself.
    """
    k = names(keys)
    looked = df.join(dim.select(*k, *defaults), k, "left")
    return looked.withColumns(
        {c: F.coalesce(F.col(c), d if isinstance(d, Column) else F.lit(d)) for c, d in defaults.items()}
    )


def known_routes(requests: DataFrame, routes: DataFrame, keys: Sequence[str] = ("origin", "destination"), out: str = "is_known") -> DataFrame:
    """All requests, flagged by whether their route is flown; one pass over either table."""
    k = list(keys)
    known = routes.select(F.col("origin_code").alias(k[0]), F.col("destination_code").alias(k[1])).distinct()
    return requests.join(known.withColumn(out, F.lit(True)), k, "left").withColumn(out, F.coalesce(F.col(out), F.lit(False)))


def supported_routes(requests: DataFrame, routes: DataFrame, keys: Sequence[str] = ("origin", "destination")) -> tuple:
    """(known, unknown) requests by route."""
    flagged = known_routes(requests, routes, keys, "_known")
    return flagged.filter("_known").drop("_known"), flagged.filter("not _known").drop("_known")


def lowest_fares(fares: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fares.groupBy(*keys).agg(F.min("price").alias("current_price"))


def match_alerts(
    alerts: DataFrame, fares: DataFrame, keys: Sequence[str] = ("origin_code", "destination_code")
) -> DataFrame:
    """Active alerts whose route (and any further key) now has a fare at or under the target.

    Only the lowest fare of a key can decide, so fares are reduced to one row per key first and an
    alert never meets more than one row.
    """
    k = list(keys)
    current = lowest_fares(fares, k)
    hit = alerts.filter("is_active").join(current, k)
    return hit.filter(F.col("current_price") <= F.col("target_price").cast("double"))


def connecting_routes(fares: DataFrame, min_saving: float = 0.0) -> DataFrame:
    """Two-leg journeys cheaper than the direct fare, with the saving.

    Works on one lowest fare per route. Such a journey is a triangle: first leg, second leg and direct route. Each triangle is
    formed once, at its airport with the fewest routes, from two routes to airports with more; the third is then a lookup by
    its full route. An airport has at most sqrt(2 m) such routes of m, so a hub forms next to nothing, its spokes do, and
    candidates grow as m on a star and as m sqrt(m) at worst.
    """
    lowest = fares.filter(F.col("origin_code") != F.col("destination_code")).groupBy("origin_code", "destination_code").agg(F.min("price").alias("fare"))
    ends = lowest.select(F.explode(F.array("origin_code", "destination_code")).alias("code"))
    degree = ends.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, out: degree.select(F.col("code").alias(c), F.struct("n", "code").alias(out))
    ranked = lowest.join(side("origin_code", "_o"), "origin_code").join(side("destination_code", "_d"), "destination_code")
    leaving = ranked.filter("_o < _d").select(F.col("origin_code").alias("at"), F.col("destination_code").alias("to"), F.col("fare").alias("out_fare"))
    coming = ranked.filter("_o > _d").select(F.col("destination_code").alias("at"), F.col("origin_code").alias("from"), F.col("fare").alias("in_fare"))

    # By the corner with the fewest routes: the stop, the origin, the destination.
    stop = coming.join(leaving, "at").filter(F.col("from") != F.col("to")).select(
        F.col("from").alias("origin_code"), F.col("at").alias("via"), F.col("to").alias("destination_code"),
        F.col("in_fare").alias("first_fare"), F.col("out_fare").alias("second_fare"), F.lit(None).cast("double").alias("direct_fare"),
        F.col("from").alias("_from"), F.col("to").alias("_to"),
    )
    other = leaving.withColumnsRenamed({"to": "end", "out_fare": "direct_fare"})
    origin = leaving.join(other, "at").filter((F.col("to") != F.col("end")) & (F.col("out_fare") < F.col("direct_fare"))).select(
        F.col("at").alias("origin_code"), F.col("to").alias("via"), F.col("end").alias("destination_code"),
        F.col("out_fare").alias("first_fare"), F.lit(None).cast("double").alias("second_fare"), "direct_fare",
        F.col("to").alias("_from"), F.col("end").alias("_to"),
    )
    other = coming.withColumnsRenamed({"from": "begin", "in_fare": "direct_fare"})
    end = coming.join(other, "at").filter((F.col("from") != F.col("begin")) & (F.col("in_fare") < F.col("direct_fare"))).select(
        F.col("begin").alias("origin_code"), F.col("from").alias("via"), F.col("at").alias("destination_code"),
        F.lit(None).cast("double").alias("first_fare"), F.col("in_fare").alias("second_fare"), "direct_fare",
        F.col("begin").alias("_from"), F.col("from").alias("_to"),
    )
    third = lowest.select(F.col("origin_code").alias("_from"), F.col("destination_code").alias("_to"), F.col("fare").alias("_fare"))
    legs = ["first_fare", "second_fare", "direct_fare"]
    closed = stop.unionByName(origin).unionByName(end).join(third, ["_from", "_to"]).withColumns({c: F.coalesce(c, "_fare") for c in legs})
    saved = F.col("direct_fare") - (F.col("first_fare") + F.col("second_fare"))
    return (
        closed.withColumn("total_price", F.col("first_fare") + F.col("second_fare"))
        .withColumn("savings", saved)
        .filter(F.col("savings") > min_saving)
        .withColumn("savings_percent", F.col("savings") / F.col("direct_fare") * 100)
        .select("origin_code", "via", "destination_code", "total_price", "direct_fare", "savings", "savings_percent")
    )


def best_connections(fares: DataFrame, k: int = 1) -> DataFrame:
    """The k cheapest of those per route."""
    return top_k(connecting_routes(fares), ["origin_code", "destination_code"], ["total_price", "via"], k)
