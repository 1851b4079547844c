"""Rule scores of the book-or-wait decision as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..columns import at_most, clip, col, round_even


def delta_percent(average: str | Column, current: str | Column) -> Column:
    return (col(average) - col(current)) / F.greatest(col(current), F.lit(1.0)) * 100


def pricing_trend(delta: str | Column) -> Column:
    return F.when(col(delta) >= 4.0, "RISING").when(col(delta) <= -4.0, "FALLING").otherwise("STABLE")


def pricing_score(delta: str | Column) -> Column:
    score = F.when(F.abs(col(delta)) >= 4.0, clip(col(delta) / 16, -1.0, 1.0)).otherwise(0.0)
    return round_even(score, 4)


def pricing_reason(delta: str | Column) -> Column:
    size = F.format_string("%.1f", F.abs(col(delta)))
    return (
        F.when(col(delta).isNull(), "No forecast movement detected.")
        .when(col(delta) >= 4.0, F.concat(F.lit("Forecast average is "), size, F.lit("% above the current fare.")))
        .when(col(delta) <= -4.0, F.concat(F.lit("Forecast average is "), size, F.lit("% below the current fare.")))
        .otherwise("Forecast prices are close to the current fare.")
    )


def demand_raw(days: str | Column, seats: str | Column, demand: str | Column) -> Column:
    """Unrounded demand score; the label is read from this, the reported score is rounded."""
    soon = F.lit(1.0) / F.greatest(col(days) + 1, F.lit(1)) * 2.4
    scarce = clip((32 - col(seats)) / 32, 0.0, 1.0)
    return at_most(soon + scarce * 0.55 + col(demand) * 0.35, 1.0)


def risk_raw(stdev: str | Column, spread: str | Column, points: str | Column, current: str | Column) -> Column:
    price = F.greatest(col(current), F.lit(1.0))
    score = at_most(col(stdev) / price * 4.0 + col(spread) / price * 0.8, 1.0)
    return F.when(F.coalesce(col(points), F.lit(0)) < 2, 0.0).otherwise(score)


def level(score: str | Column, high: float, medium: float) -> Column:
    return F.when(col(score) >= high, "HIGH").when(col(score) >= medium, "MEDIUM").otherwise("LOW")


def demand_level(score: str | Column) -> Column:
    return level(score, 0.62, 0.34)


def risk_level(score: str | Column) -> Column:
    return level(score, 0.5, 0.24)


def demand_reason(label: str | Column) -> Column:
    return (
        F.when(col(label) == "HIGH", "Demand pressure is high from timing and remaining seat inventory.")
        .when(col(label) == "MEDIUM", "Demand pressure is moderate; inventory is worth watching.")
        .otherwise("Demand pressure is low enough to allow more waiting room.")
    )


def risk_reason(label: str | Column, points: str | Column) -> Column:
    return (
        F.when(F.coalesce(col(points), F.lit(0)) < 2, "Volatility is limited in the forecast.")
        .when(col(label) == "HIGH", "Forecast volatility is high, increasing price-move risk.")
        .when(col(label) == "MEDIUM", "Forecast volatility is moderate across the next 30 days.")
        .otherwise("Forecast volatility is low.")
    )


def buy_score(pricing: str | Column, demand: str | Column, risk: str | Column) -> Column:
    return F.greatest(F.lit(0.0), col(pricing)) * 0.44 + col(demand) * 0.36 + col(risk) * 0.20


def wait_score(pricing: str | Column, demand: str | Column) -> Column:
    return F.greatest(F.lit(0.0), -col(pricing)) * 0.58 + (1.0 - col(demand)) * 0.28


def decision(buy: str | Column, wait: str | Column) -> Column:
    return F.when(col(buy) >= col(wait), "BOOK NOW").otherwise("WAIT")


def decision_confidence(buy: str | Column, wait: str | Column) -> Column:
    return round_even(clip(0.56 + F.abs(col(buy) - col(wait)) * 0.55, 0.52, 0.94), 2)


def decision_reason(choice: str | Column) -> Column:
    return F.when(
        col(choice) == "BOOK NOW",
        "The combined agent score favors locking the fare before upward pressure compounds.",
    ).otherwise("The combined agent score leaves enough room to monitor for a better fare.")


def change_trend(change: str | Column) -> Column:
    return F.when(col(change) > 3.0, "RISING").when(col(change) < -3.0, "FALLING").otherwise("STABLE")


def rise_probability(change: str | Column) -> Column:
    c = col(change)
    bonus = F.least(F.lit(0.2), F.abs(c) / 100)
    raw = F.when(c > 3.0, 0.75 + bonus).when(c < -3.0, 0.25 - bonus).otherwise(0.5 + c / 10)
    return clip(raw, 0.0, 1.0)


def market_status(confidence: str | Column) -> Column:
    return F.when(col(confidence) < 0.6, "VOLATILE").otherwise("STABLE")


def fallback_trend(status: str | Column, probability: str | Column) -> Column:
    """Trend read from market status and rise probability when no trend was delivered."""
    p = col(probability)
    volatile = F.upper(F.coalesce(col(status), F.lit(""))) == "VOLATILE"
    calm = F.when(p > 0.65, "RISING").when(p < 0.35, "FALLING").otherwise("STABLE")
    return F.when(volatile, F.when(p > 0.5, "RISING").otherwise("FALLING")).otherwise(calm)
