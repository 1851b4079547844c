"""The record that is kept of a fare when it is observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import round_even
from ..functions import dates, pricing


def record_fares(fares: DataFrame, departure: str = "departure_date", at: str = "recorded_at") -> DataFrame:
    """``fares`` with what a record holds beside the fare: calendar, urgency, demand and season as known at ``at``.

    A column that the table already has is kept. A fare without a departure date or without a time gets nulls in the columns
    that follow from it. No row is moved; all columns come from the row itself.
    """
    day, seen = F.col(departure).cast("date"), F.col(at)
    calendar = dates.calendar_features(day)
    have = lambda name, made: F.col(name) if name in fares.columns else made
    days = have("days_until_dep", F.greatest(F.datediff(day, seen.cast("date")), F.lit(0)))
    hour = have("hour_of_day", F.hour(seen.cast("timestamp")))
    made: dict[str, Column] = {
        "days_until_dep": days,
        "urgency": round_even(dates.urgency(days.cast("double")), 4),
        "day_of_week": calendar["day_of_week"],
        "month": calendar["month"],
        "week_of_year": calendar["week_of_year"],
        "hour_of_day": hour,
        "is_peak_hour": dates.is_peak_hour(hour).cast("int"),
        "is_holiday": dates.is_holiday(day),
        "is_weekend": dates.is_weekend(day),
        "seasonality_factor": pricing.seasonality(day),
    }
    if "seats_available" in fares.columns:
        made["demand_score"] = pricing.demand_score(days, day, F.col("seats_available"))
    return fares.withColumns({name: c for name, c in made.items() if name not in fares.columns})
