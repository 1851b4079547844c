"""Helpers over nested offers: itineraries, segments, passengers and raw JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import col, names, round_even
from ..schemas import RAW_OFFER
from .text import safe_number

# Defaults of a passenger entry.
PASSENGER_DEFAULTS = {
    "type": "ADULT",
    "nationality": "Indian",
    "passport_country": "India",
    "seat_preference": "WINDOW",
    "meal_preference": "VEG",
    "baggage_allowance": 15,
}


def parse_offer(c: str | Column, schema: str = RAW_OFFER) -> Column:
    """JSON text to the raw offer struct; unreadable text gives a null offer."""
    return F.from_json(col(c), schema, {"mode": "PERMISSIVE"})


def offer_json(c: str | Column) -> Column:
    return F.to_json(col(c))


def offer_variant(c: str | Column) -> Column:
    """Variant for offers of unknown shape; read with ``F.try_variant_get``."""
    return F.try_parse_json(col(c))


def json_text(c: str | Column, path: str) -> Column:
    return F.get_json_object(col(c), path)


def segments(offer: str | Column, itinerary: int = 0) -> Column:
    return F.get(col(offer)["itineraries"], F.lit(itinerary))["segments"]


def first_segment(offer: str | Column) -> Column:
    return F.try_element_at(segments(offer), F.lit(1))


def last_segment(offer: str | Column) -> Column:
    return F.try_element_at(segments(offer), F.lit(-1))


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trip_card(offer: str | Column) -> dict[str, Column]:
    """Places, times and carrier of an offer, whichever spelling it uses; null where absent."""
    first, last = first_segment(offer), last_segment(offer)
    return {
        "origin": F.coalesce(_text(first["origin"]), first["departure"]["iataCode"]),
        "destination": F.coalesce(_text(last["destination"]), last["arrival"]["iataCode"]),
        "departure_time": F.coalesce(_text(first["departure_time"]), first["departure"]["at"]),
        "arrival_time": F.coalesce(_text(last["arrival_time"]), last["arrival"]["at"]),
        "airline": F.coalesce(_text(first["airline_code"]), first["carrierCode"]),
    }


def offer_price(offer: str | Column, share: float = 0.85) -> dict[str, Column]:
    """Total, base and taxes from any of the accepted price spellings."""
    price = col(offer)["price"]
    total = F.lit(0.0)
    for field in ("total", "grand_total", "grandTotal"):
        number = safe_number(price[field])
        total = F.when(number != 0, number).otherwise(total)
    given = safe_number(price["base"])
    base = F.when(given != 0, given).otherwise(total * share)
    return {"total_price": total, "base_fare": base, "taxes": total - base}


def stops(segs: str | Column) -> Column:
    return F.greatest(F.coalesce(F.size(col(segs)), F.lit(0)) - 1, F.lit(0))


def explode_passengers(df: DataFrame, booking_id: str = "booking_id", passengers: str = "passengers") -> DataFrame:
    """One row per listed passenger, numbered from 1, with the entry's defaults filled in."""
    fields = set(df.schema[passengers].dataType.elementType.fieldNames())
    rows = df.select(booking_id, F.posexplode(passengers).alias("_pos", "_p"))

    def read(field: str) -> Column:
        given = F.col("_p")[field] if field in fields else F.lit(None)
        return F.coalesce(given, F.lit(PASSENGER_DEFAULTS[field])) if field in PASSENGER_DEFAULTS else given

    renamed = {"type": "passenger_type", "baggage_allowance": "baggage_kg"}
    wanted = [f for f in [*PASSENGER_DEFAULTS, *sorted(fields - set(PASSENGER_DEFAULTS))]]
    return rows.select(
        booking_id,
        (F.col("_pos") + 1).alias("ordinal"),
        *[read(f).alias(renamed.get(f, f)) for f in wanted],
    )


def carries(airlines: str | Column, code: str | Column) -> Column:
    return F.array_contains(col(airlines), col(code) if isinstance(code, Column) else F.lit(code))


def explode_airlines(df: DataFrame, airlines: str = "airlines", out: str = "airline_code") -> DataFrame:
    return df.withColumn(out, F.explode(airlines))


def assemble_offers(
    legs: DataFrame,
    offer_keys: str | Sequence[str] = "offer_id",
    itinerary: str = "itinerary",
    ordinal: str = "ordinal",
    total: str = "total",
    share: float = 0.82,
    currency: str = "INR",
) -> DataFrame:
    """Nested offers from flat legs. A leg row names its offer, itinerary (0 out, 1 back) and position.

    The lists hold one offer's own legs, so their length is the length of a journey.
    """
    k = names(offer_keys)
    segment = F.struct(
        F.col(ordinal).alias("ordinal"),
        *[
            F.col(c)
            for c in ("flight_number", "airline_code", "origin", "destination", "departure_time", "arrival_time",
                      "duration", "cabin")
        ],
    )
    itineraries = (
        legs.groupBy(*k, itinerary)
        .agg(
            F.array_sort(F.collect_list(segment)).alias("segments"),
            F.min_by("itinerary_duration", ordinal).alias("duration"),
            F.max(total).alias("_total"),
            F.min_by("airline_code", ordinal).alias("_carrier"),
        )
        .withColumn("segments", F.transform("segments", lambda s: s.dropFields("ordinal")))
    )
    return itineraries.groupBy(*k).agg(
        F.struct(
            F.max("_total").alias("total"),
            round_even(F.max("_total") * share, 2).alias("base"),
            F.lit(currency).alias("currency"),
        ).alias("price"),
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(itinerary).alias("i"), "duration", "segments"))),
            lambda x: F.struct(x["duration"].alias("duration"), x["segments"].alias("segments")),
        ).alias("itineraries"),
        F.min_by("_carrier", itinerary).alias("primary_airline"),
    )
