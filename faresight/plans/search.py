"""Search enrichment: offers as found, the model's fare for each, and advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, pricing
from ..operators.offers import dedupe_offers, enrich_offers
from .model import FareModel, predict_fares

# Demand of a search by days left, and seats of an offer that does not tell them.
NEAR_DAYS, NEAR_DEMAND, FAR_DEMAND, SEATS = 7, 0.85, 0.5, 30


def offer_inputs(offers: DataFrame, as_of, departure: str = "departure_date", airline: str = "airline_code") -> DataFrame:
    """``offers`` with the model's inputs, which a search fills by its own rules: noon, no price change, demand by days left."""
    calendar = dates.calendar_features(departure)
    days = F.greatest(F.datediff(F.col(departure), F.lit(as_of).cast("date")), F.lit(0))
    seats = F.nullif(F.col("seats_available"), F.lit(0)) if "seats_available" in offers.columns else F.lit(None).cast("int")
    return offers.withColumns(
        {
            "airline_code": F.coalesce(F.col(airline), F.lit("AI")),
            "days_until_dep": days,
            "day_of_week": calendar["day_of_week"],
            "month": calendar["month"],
            "week_of_year": calendar["week_of_year"],
            "hour_of_day": F.lit(12),
            "is_peak_hour": F.lit(0),
            "is_live": F.lit(1),
            "seats_available": F.coalesce(seats, F.lit(SEATS)),
            "price_change_1d": F.lit(0.0),
            "price_change_3d": F.lit(0.0),
            "demand_score": F.when(days < NEAR_DAYS, NEAR_DEMAND).otherwise(FAR_DEMAND),
            "seasonality_factor": pricing.seasonality(departure, pricing.SEARCH_SEASON),
        }
    )


def enriched_search(offers: DataFrame, model: FareModel, as_of, **columns: str) -> DataFrame:
    """Distinct offers with ``ai_price`` and advice: offer to model inputs, guarded prediction, recommendation."""
    return enrich_offers(predict_fares(offer_inputs(dedupe_offers(offers), as_of, **columns), model))
