"""Forecast signals and the book-or-wait decision over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..columns import names, round_even
from ..functions import scores
from .aggregates import ROUTE, change_percent, forecast_profile


def pricing_signal(
    current: DataFrame, forecast: DataFrame, keys: str | Sequence[str] = ROUTE
) -> DataFrame:
    """Trend, score and reason of the near forecast mean against the current fare."""
    k = names(keys)
    return _pricing(current.join(forecast_profile(forecast, k), k, "left"))


def _pricing(df: DataFrame) -> DataFrame:
    with_delta = df.withColumn("delta_percent", scores.delta_percent("near_mean", "current_price"))
    return with_delta.withColumns(
        {
            "pricing_trend": scores.pricing_trend("delta_percent"),
            "pricing_score": scores.pricing_score("delta_percent"),
            "pricing_reason": scores.pricing_reason("delta_percent"),
        }
    )


def demand_signal(df: DataFrame) -> DataFrame:
    """Needs days_until_departure, seats_available and demand_score."""
    raw = df.withColumn(
        "_demand", scores.demand_raw("days_until_departure", "seats_available", "demand_score")
    ).withColumn("demand_level", scores.demand_level("_demand"))
    return raw.withColumns(
        {"demand_points": round_even(F.col("_demand"), 4), "demand_reason": scores.demand_reason("demand_level")}
    ).drop("_demand")


def risk_signal(current: DataFrame, forecast: DataFrame, keys: str | Sequence[str] = ROUTE) -> DataFrame:
    k = names(keys)
    return _risk(current.join(forecast_profile(forecast, k), k, "left"))


def _risk(df: DataFrame) -> DataFrame:
    raw = df.withColumn("_risk", scores.risk_raw("stdev", "spread", "points", "current_price")).withColumn(
        "risk_level", scores.risk_level("_risk")
    )
    return raw.withColumns(
        {"risk_score": round_even(F.col("_risk"), 4), "risk_reason": scores.risk_reason("risk_level", "points")}
    ).drop("_risk")


def booking_decision(
    snapshots: DataFrame, forecast: DataFrame, keys: str | Sequence[str] = ROUTE
) -> DataFrame:
    """Decision, confidence and four reasons per snapshot; the forecast is read once for all signals."""
    k = names(keys)
    df = _risk(_pricing(demand_signal(snapshots.join(forecast_profile(forecast, k), k, "left"))))
    df = df.withColumns(
        {
            "buy_score": scores.buy_score("pricing_score", "demand_points", "risk_score"),
            "wait_score": scores.wait_score("pricing_score", "demand_points"),
        }
    )
    df = df.withColumns(
        {
            "decision": scores.decision("buy_score", "wait_score"),
            "confidence": scores.decision_confidence("buy_score", "wait_score"),
        }
    )
    return df.withColumn(
        "reasons", F.array("pricing_reason", "demand_reason", "risk_reason", scores.decision_reason("decision"))
    )


def trend_probability(df: DataFrame) -> DataFrame:
    """Trend and rise probability from first_price, last_price and points."""
    out = df.withColumn("change_percent", change_percent())
    return out.withColumns(
        {"trend": scores.change_trend("change_percent"), "prob_increase": scores.rise_probability("change_percent")}
    )


def intelligence(snapshots: DataFrame, forecast: DataFrame, keys: str | Sequence[str] = ROUTE) -> DataFrame:
    """Everything a prediction answer reports: decision, trend, probability, market status."""
    df = trend_probability(booking_decision(snapshots, forecast, keys))
    return df.withColumns(
        {
            "change_percent": round_even(F.col("change_percent"), 2),
            "prob_increase": round_even(F.col("prob_increase"), 2),
            "market_status": scores.market_status("confidence"),
            "confidence_percent": F.col("confidence") * 100,
        }
    )
