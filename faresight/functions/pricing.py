"""Deterministic demand and fare factors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..columns import at_most, clip, col, pick, round_even
from .dates import beside_holiday, is_weekend, on_holiday

# Month factors of the two seasonality rules, weekday factors, cabin factors.
SEASON = {1: 1.26, 5: 1.26, 6: 1.26, 10: 1.26, 12: 1.26, 4: 1.12, 7: 1.12, 11: 1.12}
SEARCH_SEASON = {4: 1.25, 5: 1.25, 10: 1.25, 12: 1.25}
WEEKDAY = {0: 0.97, 4: 1.16, 5: 1.08, 6: 1.14}
CABIN = {"ECONOMY": 1.0, "PREMIUM_ECONOMY": 1.5, "BUSINESS": 2.8, "FIRST": 4.5}
# Base fare of an unknown route, in pricing and in the alert rule.
DEFAULT_BASE = 4500.0
ALERT_BASE = 5000.0


def sigmoid_demand(days: str | Column) -> Column:
    return 1.0 + 0.72 / (1.0 + F.exp(-((14 - col(days)) / 5.5)))


def inventory_pressure(seats: str | Column) -> Column:
    empty = (60 - clip(col(seats), 1, 60)) / 60
    return round_even(1.0 + empty * empty * 0.62, 4)


def seasonality(d: str | Column, months: dict[int, float] = SEASON) -> Column:
    return pick(F.month(col(d)), months, 1.0)


def weekday_factor(d: str | Column) -> Column:
    return pick(F.weekday(col(d)), WEEKDAY, 1.0)


def holiday_factor(d: str | Column) -> Column:
    return F.when(on_holiday(d), 1.24).when(beside_holiday(d), 1.1).otherwise(1.0)


def demand_score(days: str | Column, d: str | Column, seats: str | Column) -> Column:
    pull = (sigmoid_demand(days) - 1.0) * 0.58  # the sigmoid part never exceeds 0.72, so it needs no bound
    season = (seasonality(d) - 1.0) * 1.05
    stock = (inventory_pressure(seats) - 1.0) * 0.72
    return round_even(at_most(pull + season + stock, 1.0), 4)


def advance_factor(days: str | Column) -> Column:
    d = col(days).cast("double")
    return (
        F.when(d > 30, 0.7 + 0.1 * F.sin(d / 10))
        .when(d < 3, 1.8 + 0.2 * F.cos(d))
        .otherwise(1.0 + 0.5 * F.exp(-d / 12))
    )


def cabin_factor(cabin: str | Column) -> Column:
    return pick(F.upper(col(cabin)), CABIN, 1.0)


def charm_round(price: str | Column) -> Column:
    """Above 1000, move to the nearer of x49 and x99 of the same hundred."""
    p = col(price)
    tail = F.when(p % 100 > 50, 99).otherwise(49)
    return F.when(p > 1000, p - p % 100 + tail).otherwise(p)


def fare_estimate(base, airline_factor, days, departure, cabin, noise=None) -> Column:
    """Whole-currency fare; ``noise`` is a caller's column where the source used a random draw."""
    raw = (
        F.coalesce(col(base), F.lit(DEFAULT_BASE))
        * F.coalesce(col(airline_factor), F.lit(1.0))
        * advance_factor(days)
        * F.when(is_weekend(departure, 4), 1.15).otherwise(1.0)
        * seasonality(departure)
        * cabin_factor(cabin)
        * (F.lit(1.0) if noise is None else col(noise))
    )
    return charm_round(raw.cast("bigint"))


def trip_total(out_fare, in_fare, hour, adults) -> Column:
    slot = F.when(col(hour).isin([6, 18]), 1.1).otherwise(1.0)
    both = F.coalesce(col(out_fare), F.lit(0.0)) + F.coalesce(col(in_fare), F.lit(0.0))
    return both * slot * F.greatest(F.lit(1), col(adults))


def base_share(total: str | Column, share: float = 0.82) -> Column:
    return round_even(col(total) * share, 2)


def fare_split(total: str | Column, base: str | Column | None = None, share: float = 0.85) -> dict[str, Column]:
    """Base and taxes; a missing or zero base is ``share`` of the total, taxes never below 0."""
    t = F.coalesce(col(total), F.lit(0.0))
    default = t * share
    b = default if base is None else F.coalesce(F.nullif(col(base), F.lit(0.0)), default)
    return {"total": t, "base": b, "taxes": F.greatest(t - b, F.lit(0.0))}


def alert_fare(base: str | Column, days: str | Column) -> Column:
    """Current fare of the alert check: base with a last-week premium, to the nearest 50 (ties to even)."""
    late = F.greatest(F.lit(0.0), (7 - F.coalesce(col(days), F.lit(30))) / 7)
    fare = F.coalesce(col(base), F.lit(ALERT_BASE)) * (1.0 + late * 0.35)
    return F.bround(fare / 50, 0) * 50
