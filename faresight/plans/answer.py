"""End-to-end plans composed of the operators: prediction answers and the daily run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, pricing
from ..functions.text import norm_code
from ..operators.aggregates import market_snapshot
from ..operators.quality import request_rules, validate
from ..operators.signals import intelligence
from .model import FareModel, current_fare_table, forecast_fares, predict_fares

REQUEST = ["request_id"]


def distinct_requests(requests: DataFrame, asked: str = "asked_id") -> tuple[DataFrame, DataFrame]:
    """(distinct, links): requests that differ in nothing but their id, once under the least of their ids, and per id the one ``asked``.

    An answer follows from a request's text, so there are at most routes times dates of them however many ask. Rows of a
    repeated or null id all stay, linked with themselves. ``requests`` are read several times, so they should be stored.
    """
    own = REQUEST[0]
    text = [c for c in requests.columns if c != own]
    odd = requests.groupBy(own).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) | F.col(own).isNull()).select(F.col(own).alias(asked))
    many = requests.join(odd, F.col(own).eqNullSafe(F.col(asked)), "left_semi")
    single = requests.filter(F.col(own).isNotNull()).join(odd, F.col(own) == F.col(asked), "left_anti")
    first = single.groupBy(*text).agg(F.min(own).alias(asked))
    other = first.withColumnsRenamed({c: f"_{c}" for c in text})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in text]
    links = single.join(other, same).select(own, asked).unionByName(odd.select(F.col(asked).alias(own), asked))
    return first.withColumnRenamed(asked, own).select(*requests.columns).unionByName(many), links


def of_all(links: DataFrame, answers: DataFrame, asked: str = "asked_id") -> DataFrame:
    """``answers`` of distinct requests, given to every request that is linked with one."""
    own = REQUEST[0]
    found = answers.withColumnRenamed(own, "_own")
    return links.join(found, F.col(asked).eqNullSafe(F.col("_own"))).select(own, *[c for c in answers.columns if c != own])


def request_snapshots(requests: DataFrame, fares: DataFrame, routes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(snapshots, rejects) for a table of requests (request_id, origin, destination, departure_date text).

    A request is rejected for its text, for a route that is not flown (``unsupported_route``), or for a route that is flown
    but has no usable fare (``no_fare``); none is lost.
    """
    valid, rejects = validate(requests, request_rules())
    asked = valid.withColumns(
        {
            "origin": norm_code("origin"),
            "destination": norm_code("destination"),
            "departure_date": dates.parse_date_default("departure_date", as_of),
        }
    )
    flown = routes.select(F.col("origin_code").alias("origin"), F.col("destination_code").alias("destination"), F.lit(True).alias("is_flown")).distinct()
    market = market_snapshot(fares, ["origin_code", "destination_code"], seats="seats_available")
    market = market.withColumnsRenamed({"origin_code": "origin", "destination_code": "destination"})
    met = asked.join(flown, ["origin", "destination"], "left").join(market, ["origin", "destination"], "left")
    lost = met.filter(F.col("current_price").isNull())
    reason = F.when(F.col("is_flown"), "no_fare").otherwise("unsupported_route")
    unknown = lost.withColumns({"departure_date": F.col("departure_date").cast("string"), "reject_reasons": F.array(reason)})
    snapshots = met.filter(F.col("current_price").isNotNull()).drop("is_flown")
    snapshots = snapshots.withColumnsRenamed({"origin": "origin_code", "destination": "destination_code", "airline": "airline_code"})
    snapshots = snapshots.withColumn("days_until_departure", dates.days_until("departure_date", as_of)).withColumns(
        {
            "demand_score": pricing.demand_score("days_until_departure", "departure_date", "seats_available"),
            "seasonality_factor": pricing.seasonality("departure_date"),
        }
    )
    return snapshots, rejects.select(*requests.columns, "reject_reasons").unionByName(
        unknown.select(*requests.columns, "reject_reasons")
    )


def answer_requests(snapshots: DataFrame, model: FareModel, as_of, days: int = 30) -> DataFrame:
    """One answer per request: predicted fare, decision, trend and market status."""
    calendar = dates.calendar_features("departure_date")
    inputs = snapshots.withColumns(
        {
            "days_until_dep": F.col("days_until_departure"),
            **{c: calendar[c] for c in ("day_of_week", "month", "week_of_year")},
        }
    )
    predicted = predict_fares(inputs, model).select(*REQUEST, "predicted")
    current = current_fare_table(snapshots, predicted, REQUEST)
    forecast = forecast_fares(snapshots, model, as_of, days).select(*REQUEST, "day", "price")
    return intelligence(current, forecast, REQUEST)
