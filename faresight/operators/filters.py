"""Selections, predicates and row-level projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import as_date, as_ts, clip, col
from .ordered import row_index, top_k

# Hour ranges of the time-of-day filter, lower bound included, upper excluded.
DAY_PARTS = {"NIGHT": (0, 6), "MORNING": (6, 12), "AFTERNOON": (12, 18), "EVENING": (18, 24)}


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter("is_active")


def in_price_bounds(price: str | Column = "price", low: float = 800, high: float = 60000, inclusive: bool = True) -> Column:
    p = col(price)
    return p.between(low, high) if inclusive else (p > low) & (p < high)


def within_price_bounds(
    df: DataFrame, low: float = 800, high: float = 60000, inclusive: bool = True, price: str = "price"
) -> DataFrame:
    return df.filter(in_price_bounds(price, low, high, inclusive))


def departures_on(
    flights: DataFrame, origin: str, destination: str, day, status: str = "SCHEDULED", limit: int | None = 20
) -> DataFrame:
    """Flights of one route on one day, earliest first."""
    start = as_ts(as_date(day))
    end = as_ts(F.date_add(as_date(day), 1))
    hit = flights.filter(
        (F.col("origin_code") == origin)
        & (F.col("destination_code") == destination)
        & (F.col("departure_time") >= start)
        & (F.col("departure_time") < end)
        & (F.col("status") == status)
    )
    return hit if limit is None else hit.orderBy("departure_time", "id").limit(limit)


def departures_for(
    flights: DataFrame, searches: DataFrame, status: str = "SCHEDULED", limit: int | None = 20,
    order: Sequence[str] = ("departure_time", "id"),
) -> DataFrame:
    """The same for a whole table of searches (origin_code, destination_code, departure_date), with the ``position`` of each flight.

    Only flights that some search wants are ranked. With a limit each route and day is cut before the shuffle, so a crowded
    day never travels whole; None returns all of them, numbered by ranges.
    """
    route = ["origin_code", "destination_code", "departure_date"]
    wanted = searches.select(*route).distinct()
    offered = flights.filter(F.col("status") == status).withColumn(
        "departure_date", F.col("departure_time").cast("date")
    )
    met = offered.join(wanted, route, "left_semi")
    return row_index(met, route, list(order), out="position") if limit is None else top_k(met, route, list(order), limit, rank="position")


def is_live_alert(as_of) -> Column:
    open_until = F.col("expires_at").isNull() | (F.col("expires_at") > as_ts(as_of))
    return F.col("is_active") & open_until & (F.col("departure_date") >= as_date(as_of))


def live_alerts(alerts: DataFrame, as_of) -> DataFrame:
    return alerts.filter(is_live_alert(as_of))


def expire_alerts(alerts: DataFrame, as_of) -> DataFrame:
    """Switches off alerts whose expiry or departure has passed; everything else is unchanged."""
    over = (F.col("expires_at") < as_ts(as_of)) | (F.col("departure_date") < as_date(as_of))
    ended = F.col("is_active") & F.coalesce(over, F.lit(False))
    return alerts.withColumn("is_active", F.when(ended, False).otherwise(F.col("is_active")))


def pending_notifications(queue: DataFrame, as_of, limit: int | None = 200) -> DataFrame:
    """Due notifications, the longest waiting first; a run takes ``limit`` of them, None takes all."""
    due = queue.filter(
        (F.col("status") == "PENDING")
        & (F.col("scheduled_at") <= as_ts(as_of))
        & (F.col("retry_count") < F.col("max_retries"))
    )
    return due if limit is None else due.orderBy("scheduled_at", "id").limit(limit)


def day_part(hour: str | Column) -> Column:
    h = col(hour)
    out = None
    for name, (low, high) in DAY_PARTS.items():
        inside = (h >= low) & (h < high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def time_of_day(offers: DataFrame, *buckets: str, departure: str = "departure_time") -> DataFrame:
    """Offers leaving in the given parts of the day, in one pass; ``ALL`` or none keeps every offer, even one without a time."""
    if not buckets or "ALL" in buckets:
        return offers
    return offers.filter(day_part(F.hour(F.col(departure))).isin(list(buckets)))


def alert_records(alerts: DataFrame) -> DataFrame:
    """Reported shape of an alert: triggered flag and saving against the last fare seen."""
    last = F.nullif(F.col("last_price").cast("double"), F.lit(0.0))
    return alerts.select(
        "id",
        "user_id",
        F.col("origin_code").alias("origin"),
        F.col("destination_code").alias("destination"),
        F.col("target_price").cast("double").alias("target_price"),
        "departure_date",
        "created_at",
        (F.coalesce(F.col("triggered_count"), F.lit(0)) > 0).alias("triggered"),
        F.col("last_price").cast("double").alias("current_price"),
        (F.col("target_price").cast("double") - last).alias("savings"),
    )


def mask_unobserved(df: DataFrame, flag: str | Column = "is_live", live_value: bool = True) -> DataFrame:
    """Seats and demand count only on observed rows; elsewhere 50 seats and demand 0.5."""
    seen = col(flag) == F.lit(live_value)
    out = df.withColumn("seats_available", clip(F.when(seen, F.col("seats_available")).otherwise(50), 1, 100))
    if "demand_score" in df.columns:
        out = out.withColumn("demand_score", F.when(seen, F.col("demand_score")).otherwise(0.5))
    return out


def visible_coupons(coupons: DataFrame, as_of) -> DataFrame:
    now = as_ts(as_of)
    return coupons.filter(
        F.col("is_active")
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= now))
        & (F.col("valid_until").isNull() | (F.col("valid_until") >= now))
    )
