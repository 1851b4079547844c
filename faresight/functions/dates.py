"""Calendar helpers. Time is always a parameter, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..columns import as_date, at_least, col

# Holidays as month * 100 + day, and the peak hours of a day.
HOLIDAYS = [101, 126, 815, 1002, 1225]
PEAK_HOURS = [7, 8, 9, 18, 19, 20, 21]


def parse_date_default(c: str | Column, as_of, fallback_days: int = 14) -> Column:
    """ISO date, or ``as_of`` plus the fallback when the text is missing; malformed text gives null."""
    text = F.nullif(F.trim(col(c)), F.lit(""))
    return F.when(text.isNull(), F.date_add(as_date(as_of), fallback_days)).otherwise(F.try_to_date(text, "yyyy-MM-dd"))


def days_until(departure: str | Column, as_of, default: int = 7) -> Column:
    left = F.datediff(col(departure).cast("date"), as_date(as_of))
    return F.coalesce(at_least(left, 0), F.lit(default))


def calendar_features(d: str | Column) -> dict[str, Column]:
    """Monday-based weekday, month, ISO week and hour."""
    c = col(d)
    return {
        "day_of_week": F.weekday(c),
        "month": F.month(c),
        "week_of_year": F.weekofyear(c),
        "hour_of_day": F.hour(c.cast("timestamp")),
    }


def is_weekend(d: str | Column, from_day: int = 5) -> Column:
    """``from_day`` 5 is Saturday–Sunday (features); 4 adds Friday (pricing)."""
    return F.weekday(col(d)) >= from_day


def is_peak_hour(hour: str | Column) -> Column:
    return col(hour).isin(PEAK_HOURS)


def _month_day(d: Column) -> Column:
    return F.month(d) * 100 + F.dayofmonth(d)


def on_holiday(d: str | Column) -> Column:
    return _month_day(col(d)).isin(HOLIDAYS)


def beside_holiday(d: str | Column) -> Column:
    return _month_day(F.date_sub(col(d), 1)).isin(HOLIDAYS) | _month_day(F.date_add(col(d), 1)).isin(HOLIDAYS)


def is_holiday(d: str | Column) -> Column:
    """The holiday itself or the day on either side of it."""
    return on_holiday(d) | beside_holiday(d)


def urgency(days: str | Column) -> Column:
    return F.lit(1.0) / (col(days) + 1)


def add_minutes(ts: str | Column, minutes: str | Column) -> Column:
    return F.timestamp_add("MINUTE", col(minutes).cast("int"), col(ts))


def expiry(ts: str | Column, interval: str) -> Column:
    """``expiry('created_at', '10 minutes')``"""
    return col(ts) + F.expr(f"INTERVAL {interval}")


def parse_iso_ts(c: str | Column) -> Column:
    """ISO-8601 timestamp, ``Z`` accepted; unreadable text gives null."""
    return col(c).try_cast("timestamp")
