"""Registered queries: fare factors, decisions, alerts, ledgers, model and streams."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..functions import pricing, scores
from ..operators import aggregates as agg, alerts as alerting, joins, ledger, merges, observations, offers as search, signals
from ..operators.filters import within_price_bounds
from ..session import swept, work_dir
from ..sources import star, tables
from ..streaming import jobs
from . import answer, model, search as finding, settlement
from .oracle_tables import demand, even, pressure, season, sigmoid
from .registry import query

ROUTE = list(agg.ROUTE)
R = "origin_code, destination_code"


# -- fare factors -----------------------------------------------------------------------------------------------------


@query(
    "demand_factors", "D1 D2", "price_history",
    sql=f"""SELECT days_until_dep, seats_available, round({sigmoid('days_until_dep')}, 8) AS demand, {pressure('seats_available')} AS pressure,
              count(*) AS fares FROM price_history GROUP BY days_until_dep, seats_available""",
)
def demand_factors(spark, sf):
    counted = star.price_history(spark, sf).groupBy("days_until_dep", "seats_available").agg(F.count(F.lit(1)).alias("fares"))
    return counted.withColumns(
        {"demand": F.round(pricing.sigmoid_demand("days_until_dep"), 8), "pressure": pricing.inventory_pressure("seats_available")}
    )


@query(
    "date_factors", "D3", "price_history",
    sql=f"""SELECT departure_date, {season('departure_date')} AS season,
              CASE WHEN month(departure_date) IN (4,5,10,12) THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS search_season,
              CASE isodow(departure_date) WHEN 1 THEN 0.97::DOUBLE WHEN 5 THEN 1.16::DOUBLE WHEN 6 THEN 1.08::DOUBLE WHEN 7 THEN 1.14::DOUBLE ELSE 1 END AS weekday,
              CASE WHEN strftime(departure_date, '%m%d') IN ('0101','0126','0815','1002','1225') THEN 1.24::DOUBLE
                   WHEN strftime(departure_date + 1, '%m%d') IN ('0101','0126','0815','1002','1225') THEN 1.1::DOUBLE
                   WHEN strftime(departure_date - 1, '%m%d') IN ('0101','0126','0815','1002','1225') THEN 1.1::DOUBLE ELSE 1 END AS holiday,
              count(*) AS fares FROM price_history GROUP BY 1""",
)
def date_factors(spark, sf):
    daily = star.price_history(spark, sf).groupBy("departure_date").agg(F.count(F.lit(1)).alias("fares"))
    return daily.withColumns(
        {
            "season": pricing.seasonality("departure_date"),
            "search_season": pricing.seasonality("departure_date", pricing.SEARCH_SEASON),
            "weekday": pricing.weekday_factor("departure_date"),
            "holiday": pricing.holiday_factor("departure_date"),
        }
    )


@query(
    "demand_score", "D4", "price_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date,
              {demand('days_until_dep', 'departure_date', 'seats_available')} AS demand_score FROM price_history""",
)
def demand_score(spark, sf):
    return star.price_history(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "departure_date",
        pricing.demand_score("days_until_dep", "departure_date", "seats_available").alias("demand_score"),
    )


_D = "CAST(days_until_dep AS DOUBLE)"
_ADVANCE = f"""(CASE WHEN {_D} > 30 THEN 0.7::DOUBLE + 0.1::DOUBLE * sin({_D} / 10) WHEN {_D} < 3 THEN 1.8::DOUBLE + 0.2::DOUBLE * cos({_D})
   ELSE 1.0::DOUBLE + 0.5::DOUBLE * exp(-{_D} / 12) END)"""
_CABIN = "(CASE cabin_class WHEN 'PREMIUM_ECONOMY' THEN 1.5::DOUBLE WHEN 'BUSINESS' THEN 2.8::DOUBLE WHEN 'FIRST' THEN 4.5::DOUBLE ELSE 1.0::DOUBLE END)"


@query(
    "fare_estimate", "D5", "price_history", "airlines",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date,
              CASE WHEN p > 1000 THEN p - p % 100 + CASE WHEN p % 100 > 50 THEN 99 ELSE 49 END ELSE p END AS fare FROM
              (SELECT *, CAST(trunc((CASE WHEN seats_available > 25 THEN 4500.0::DOUBLE ELSE 3900.0::DOUBLE END) * coalesce(factor, 1.0::DOUBLE) * {_ADVANCE}
                 * (CASE WHEN isodow(departure_date) >= 5 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) * ({season('departure_date')}) * {_CABIN}) AS BIGINT) AS p
               FROM price_history h LEFT JOIN airlines a ON h.airline_code = a.airline_code)""",
)
def fare_estimate(spark, sf):
    base = F.when(F.col("seats_available") <= 25, 3900.0)
    looked = joins.lookup_default(star.price_history(spark, sf), star.airlines(spark, sf), "airline_code", {"factor": 1.0})
    return looked.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "departure_date",
        pricing.fare_estimate(base, "factor", "days_until_dep", "departure_date", "cabin_class").alias("fare"),
    )


@query(
    "trip_total", "D6", "offers",
    sql="""SELECT offer_id, round((total + CASE WHEN flight_number IS NULL THEN 0 ELSE 1500 END) *
              CASE WHEN hour(departure_time) IN (6, 18) THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END * greatest(1, seats_available % 4), 4) AS trip FROM offers""",
)
def trip_total(spark, sf):
    back = F.when(F.col("flight_number").isNotNull(), 1500.0)
    trip = pricing.trip_total("total", back, F.hour("departure_time"), F.col("seats_available") % 4)
    return star.offers(spark, sf).select("offer_id", F.round(trip, 4).alias("trip"))


# -- decision ---------------------------------------------------------------------------------------------------------

_DELTA = "(near_mean - current_price) / greatest(current_price, 1) * 100"
_P = even(f"CASE WHEN {_DELTA} >= 4 THEN least(1, {_DELTA} / 16) WHEN {_DELTA} <= -4 THEN greatest(-1, {_DELTA} / 16) ELSE 0 END", 4)
_DEM = """least(1, 1.0::DOUBLE / greatest(days_until_departure + 1, 1) * 2.4::DOUBLE
    + greatest(0, least(1, (32 - seats_available) / 32.0::DOUBLE)) * 0.55::DOUBLE + demand_score * 0.35::DOUBLE)"""
_RISK = "CASE WHEN points < 2 THEN 0 ELSE least(1, stdev / greatest(current_price, 1) * 4 + spread / greatest(current_price, 1) * 0.8::DOUBLE) END"
_SIGNALS = f"""(SELECT {R}, points, first_price, last_price, days_until_departure, current_price, {_DELTA} AS delta, {_P} AS pricing, {_DEM} AS dem_raw,
    {even(_DEM, 4)} AS dem, {_RISK} AS risk_raw, {even(_RISK, 4)} AS risk FROM snapshots JOIN profile_stats USING ({R}))"""
_SCORED = f"""(SELECT *, greatest(0, pricing) * 0.44::DOUBLE + dem * 0.36::DOUBLE + risk * 0.2::DOUBLE AS buy,
    greatest(0, -pricing) * 0.58::DOUBLE + (1 - dem) * 0.28::DOUBLE AS wait FROM {_SIGNALS})"""
_LEVEL = "CASE WHEN {0} >= {1} THEN 'HIGH' WHEN {0} >= {2} THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "pricing_signal", "D7", "snapshots", "profile_stats",
    sql=f"""SELECT {R}, CASE WHEN delta >= 4 THEN 'RISING' WHEN delta <= -4 THEN 'FALLING' ELSE 'STABLE' END AS pricing_trend,
              pricing AS pricing_score, CASE WHEN delta >= 4 THEN 'up' WHEN delta <= -4 THEN 'down' ELSE 'flat' END AS said FROM {_SIGNALS}""",
)
def pricing_signal(spark, sf):
    out = signals.pricing_signal(star.snapshots(spark, sf), star.forecast(spark, sf))
    reason = F.col("pricing_reason")
    said = F.when(reason.endswith("% above the current fare."), "up").when(reason.endswith("% below the current fare."), "down").otherwise("flat")
    return out.select(*ROUTE, "pricing_trend", "pricing_score", said.alias("said"))


@query(
    "demand_signal", "D8", "snapshots", "profile_stats",
    sql=f"SELECT {R}, {_LEVEL.format('dem_raw', 0.62, 0.34)} AS demand_level, dem AS demand_points FROM {_SIGNALS}",
)
def demand_signal(spark, sf):
    return signals.demand_signal(star.snapshots(spark, sf)).select(
        *ROUTE, "demand_level", "demand_points"
    )


@query(
    "risk_signal", "D9", "snapshots", "profile_stats",
    sql=f"SELECT {R}, {_LEVEL.format('risk_raw', 0.5, 0.24)} AS risk_level, risk AS risk_score, points FROM {_SIGNALS}",
)
def risk_signal(spark, sf):
    out = signals.risk_signal(star.snapshots(spark, sf), star.forecast(spark, sf))
    return out.select(*ROUTE, "risk_level", "risk_score", "points")


@query(
    "booking_decision", "D10 D7 D8 D9", "snapshots", "profile_stats",
    sql=f"""SELECT {R}, CASE WHEN buy >= wait THEN 'BOOK NOW' ELSE 'WAIT' END AS decision, round(buy, 7) AS buy_score, round(wait, 7) AS wait_score,
              {even('greatest(0.52::DOUBLE, least(0.94::DOUBLE, 0.56::DOUBLE + abs(buy - wait) * 0.55::DOUBLE))', 2)} AS confidence,
              4 AS reasons FROM {_SCORED}""",
)
def booking_decision(spark, sf):
    out = signals.booking_decision(star.snapshots(spark, sf), star.forecast(spark, sf))
    return out.select(
        *ROUTE, "decision", F.round("buy_score", 7).alias("buy_score"), F.round("wait_score", 7).alias("wait_score"), "confidence",
        F.size("reasons").alias("reasons"),
    )


_CHANGE = "(CASE WHEN points >= 2 AND first_price > 0 THEN (last_price - first_price) / first_price * 100 ELSE 0 END)"


@query(
    "trend_probability", "D14", "profile_stats",
    sql=f"""SELECT {R}, CASE WHEN c > 3 THEN 'RISING' WHEN c < -3 THEN 'FALLING' ELSE 'STABLE' END AS trend,
              round(greatest(0, least(1, CASE WHEN c > 3 THEN 0.75 + least(0.2, c / 100) WHEN c < -3 THEN 0.25 - least(0.2, abs(c) / 100) ELSE 0.5 + c / 10 END)), 6) AS prob_increase
            FROM (SELECT {R}, {_CHANGE} AS c FROM profile_stats)""",
)
def trend_probability(spark, sf):
    out = signals.trend_probability(agg.forecast_profile(star.forecast(spark, sf)))
    return out.select(*ROUTE, "trend", F.round("prob_increase", 6).alias("prob_increase"))


@query(
    "market_status", "D15", "snapshots", "profile_stats",
    sql=f"""SELECT {R}, CASE WHEN conf < 0.6 THEN 'VOLATILE' ELSE 'STABLE' END AS market_status, round(conf * 100, 4) AS confidence_percent,
              CASE WHEN conf < 0.6 THEN CASE WHEN dem > 0.5 THEN 'RISING' ELSE 'FALLING' END WHEN dem > 0.65 THEN 'RISING' WHEN dem < 0.35 THEN 'FALLING'
                   ELSE 'STABLE' END AS shown_trend
            FROM (SELECT *, {even('greatest(0.52::DOUBLE, least(0.94::DOUBLE, 0.56::DOUBLE + abs(buy - wait) * 0.55::DOUBLE))', 2)} AS conf
                  FROM {_SCORED})""",
)
def market_status(spark, sf):
    out = signals.intelligence(star.snapshots(spark, sf), star.forecast(spark, sf))
    return out.select(
        *ROUTE, "market_status", F.round("confidence_percent", 4).alias("confidence_percent"),
        scores.fallback_trend("market_status", "demand_points").alias("shown_trend"),
    )


@query(
    "enrich_offers", "D16", "offers",
    sql="""SELECT offer_id, CASE WHEN p IS NULL THEN total ELSE round_even(p, 0) END AS ai_price,
              CASE WHEN p IS NULL THEN 'MONITOR' WHEN p > total * 1.12::DOUBLE THEN 'BOOK NOW' WHEN p < total * 0.88::DOUBLE THEN 'WAIT' ELSE 'FAIR PRICE' END AS recommendation,
              CASE WHEN p IS NULL THEN 'STABLE' WHEN p > total * 1.12::DOUBLE THEN 'INCREASING' WHEN p < total * 0.88::DOUBLE THEN 'DECREASING' ELSE 'STABLE' END AS trend
           FROM (SELECT offer_id, total, CASE WHEN flight_number IS NOT NULL THEN greatest(2800.0::DOUBLE, least(55000.0::DOUBLE, total * (0.7::DOUBLE + seats_available * 0.012::DOUBLE))) END AS p FROM offers)""",
)
def enrich_offers(spark, sf):
    guess = F.when(F.col("flight_number").isNotNull(), F.col("total") * (0.7 + F.col("seats_available") * 0.012))
    out = search.enrich_offers(star.offers(spark, sf).withColumn("predicted", guess))
    return out.select("offer_id", "ai_price", "recommendation", "trend")


_SEARCHED = """(SELECT * FROM offers QUALIFY flight_number IS NULL OR row_number() OVER (PARTITION BY search_id, flight_number, departure_time ORDER BY total, offer_id) = 1)"""


@query(
    "search_inputs", "D16 W2", "offers",
    sql=f"""SELECT offer_id, airline_code, days AS days_until_dep, isodow(departure_date) - 1 AS day_of_week, month(departure_date) AS month, weekofyear(departure_date) AS week_of_year,
              coalesce(nullif(seats_available, 0), 30) AS seats_available, CASE WHEN days < 7 THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS demand_score,
              CASE WHEN month(departure_date) IN (4,5,10,12) THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS seasonality_factor
            FROM (SELECT *, greatest(date_diff('day', DATE '{star.AS_OF}', departure_date), 0) AS days FROM {_SEARCHED})""",
)
def search_inputs(spark, sf):
    """Model inputs of every distinct offer of a search."""
    return finding.offer_inputs(search.dedupe_offers(star.offers(spark, sf)), star.AS_OF).select(
        "offer_id", "airline_code", "days_until_dep", "day_of_week", "month", "week_of_year", "seats_available", "demand_score", "seasonality_factor"
    )


@query(
    "search_enrichment", "D16 M7 W2", "offers",
    sql=f"SELECT offer_id, total, TRUE AS in_bounds, TRUE AS advised FROM {_SEARCHED}",
)
def search_enrichment(spark, sf):
    """Every distinct offer with the model's fare inside its bounds and the advice that follows from it."""
    with _history(spark, sf) as history:
        _, fitted = _fitted(spark, sf)
        if not history.stored:
            return _advised(star.offers(spark, sf), fitted)
        path = work_dir(spark, "searched")
        # A search lies within its route, so a part holds whole searches; offers without a search id are one search of all routes.
        named = F.col("search_id").isNotNull()
        for part, kept in [(history.whole, ~named), *[(p, named) for p in history.parts]]:
            with swept(spark):
                _advised(star.offers(spark, sf, part).filter(kept), fitted).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _advised(offers, fitted):
    out = finding.enriched_search(offers, fitted, star.AS_OF)
    fare = F.greatest(F.lit(2800.0), F.least(F.lit(55000.0), F.col("predicted")))
    advice = F.when(fare > F.col("total") * 1.12, "BOOK NOW").when(fare < F.col("total") * 0.88, "WAIT").otherwise("FAIR PRICE")
    return out.select(
        "offer_id", "total", (F.col("ai_price").between(2800, 55000) & (F.col("ai_price") == F.bround(fare, 0))).alias("in_bounds"), (F.col("recommendation") == advice).alias("advised")
    )


# -- alerts -----------------------------------------------------------------------------------------------------------

_ALL_BASES = f"(SELECT {R}, floor(min(price)) + 2000 AS base FROM price_history GROUP BY 1, 2)"
_BASES = f"(SELECT {R}, floor(min(price)) + 2000 AS base FROM price_history WHERE origin_code < 'N18' GROUP BY 1, 2)"
_ALERT_FARE = f"""round_even(coalesce(base, 5000.0::DOUBLE) * (1.0::DOUBLE + greatest(0, (7 - greatest(date_diff('day', DATE '{star.AS_OF}', departure_date), 0)) / 7.0::DOUBLE) * 0.35::DOUBLE) / 50, 0) * 50"""
_PRICED = f"(SELECT a.*, {_ALERT_FARE} AS fare FROM alerts a LEFT JOIN {_BASES} b USING ({R}))"
_ALL_PRICED = f"(SELECT a.*, {_ALERT_FARE} AS fare FROM alerts a LEFT JOIN {_ALL_BASES} b USING ({R}))"


def _all_bases(fares):
    return fares.groupBy(*ROUTE).agg((F.floor(F.min("price")) + 2000).cast("double").alias("base"))


def _bases(spark, sf):
    return _all_bases(star.price_history(spark, sf).filter("origin_code < 'N18'"))


@query(
    "alert_fare", "D17", "price_history", "alerts", sql=f"SELECT id, fare AS current_price FROM {_PRICED}",
)
def alert_fare(spark, sf):
    return alerting.price_alerts_now(star.alerts(spark, sf), _bases(spark, sf), star.AS_OF).select("id", "current_price")


@query(
    "evaluate_alerts", "D18", "price_history", "alerts",
    sql=f"""SELECT id, coalesce(CASE WHEN is_active THEN fare ELSE CAST(last_price AS DOUBLE) END, -1) AS last_price,
              triggered_count + CASE WHEN is_active AND fare <= CAST(target_price AS DOUBLE) THEN 1 ELSE 0 END AS triggered_count,
              is_active AND fare <= CAST(target_price AS DOUBLE) AS is_triggered FROM {_ALL_PRICED}""",
)
def evaluate_alerts(spark, sf):
    priced = alerting.price_alerts_now(star.alerts(spark, sf), _all_bases(star.price_history(spark, sf)), star.AS_OF)
    return alerting.check_alerts(priced).select("id", F.coalesce("last_price", F.lit(-1.0)).alias("last_price"), "triggered_count", "is_triggered")


@query(
    "alert_messages", "D18 D19 F7", "price_history", "alerts", "profiles",
    sql=f"""SELECT a.id AS alert_id, user_id, CASE WHEN notify_email AND email IS NOT NULL THEN 'EMAIL' WHEN notify_sms THEN 'SMS' ELSE 'WHATSAPP' END AS channel,
              CASE WHEN notify_email AND email IS NOT NULL THEN email ELSE phone END AS recipient, full_name AS name,
              origin_code || ' to ' || destination_code || ': now Rs.' || format('{{:,}}', CAST(round_even(fare, 0) AS BIGINT)) || ', target Rs.'
                || format('{{:,}}', CAST(round_even(target_price, 0) AS BIGINT)) AS message, round(CAST(target_price AS DOUBLE) - fare, 4) AS savings
            FROM {_PRICED} a JOIN profiles p ON user_id = p.id
            WHERE is_active AND fare <= CAST(target_price AS DOUBLE) AND ((notify_email AND email IS NOT NULL) OR notify_sms OR notify_whatsapp)""",
)
def alert_messages(spark, sf):
    """The alert run from alerts to message rows."""
    priced = alerting.price_alerts_now(star.alerts(spark, sf), _bases(spark, sf), star.AS_OF)
    out = alerting.alert_messages(alerting.check_alerts(priced), star.profiles(spark, sf))
    return out.withColumn("savings", F.round("savings", 4))


@query(
    "route_channel", "D19", "profiles",
    sql="""SELECT id, CASE WHEN notify_email AND email IS NOT NULL THEN 'EMAIL' WHEN notify_sms THEN 'SMS' WHEN notify_whatsapp THEN 'WHATSAPP' ELSE 'none' END AS channel FROM profiles""",
)
def route_channel(spark, sf):
    return alerting.route_channel(star.profiles(spark, sf)).select("id", F.coalesce("channel", F.lit("none")).alias("channel"))


@query(
    "notify_channels", "D20", "bookings", "profiles",
    sql="""SELECT b.id, unnest(list_filter([CASE WHEN notify_email AND contact_email IS NOT NULL THEN 'EMAIL' END, CASE WHEN notify_sms AND contact_phone IS NOT NULL THEN 'SMS' END,
              CASE WHEN notify_whatsapp AND contact_phone IS NOT NULL THEN 'WHATSAPP' END], lambda x: x IS NOT NULL)) AS channel FROM bookings b JOIN profiles p ON user_id = p.id""",
)
def notify_channels(spark, sf):
    people = star.profiles(spark, sf).select(F.col("id").alias("user_id"), "notify_email", "notify_sms", "notify_whatsapp")
    return alerting.notify_channels(star.bookings(spark, sf).join(people, "user_id")).select("id", "channel")


# -- ledgers ----------------------------------------------------------------------------------------------------------

_TIER = "CASE WHEN {0} >= 500000 THEN 'PLATINUM' WHEN {0} >= 150000 THEN 'GOLD' WHEN {0} >= 50000 THEN 'SILVER' ELSE 'BLUE' END"
_NOW_PAID = "payment_status = 'PAID' AND cabin_class <> 'FIRST'"


@query(
    "loyalty_tier", "D11", "profiles", "bookings",
    sql=f"""SELECT p.id, CAST(coalesce(points, 0) AS BIGINT) AS loyalty_points, coalesce(trips, 0) AS total_bookings, CAST(coalesce(spent, 0) AS DOUBLE) AS total_spent,
              {_TIER.format('coalesce(spent, 0)')} AS tier FROM profiles p LEFT JOIN
              (SELECT user_id, sum(floor(total_price / 100)) AS points, count(*) AS trips, sum(total_price) AS spent FROM bookings WHERE {_NOW_PAID} GROUP BY 1) b ON p.id = user_id""",
)
def loyalty_tier(spark, sf):
    out = ledger.award_loyalty(star.old_bookings(spark, sf), star.bookings(spark, sf), star.profiles(spark, sf))
    return out.select("id", "loyalty_points", "total_bookings", F.col("total_spent").cast("double").alias("total_spent"), "tier")


@query(
    "confirm_bookings", "D12", "bookings", "profiles",
    sql=f"""SELECT b.id, CASE WHEN {_NOW_PAID} THEN 'CONFIRMED' ELSE status END AS status, {_NOW_PAID} AS confirmation_sent,
              CASE WHEN {_NOW_PAID} THEN CAST(floor(total_price / 100) AS BIGINT) ELSE 0 END AS points_earned,
              CASE WHEN {_NOW_PAID} THEN concat_ws(',', CASE WHEN notify_email AND contact_email IS NOT NULL THEN 'EMAIL:' || contact_email END,
                   CASE WHEN notify_sms AND contact_phone IS NOT NULL THEN 'SMS:' || contact_phone END) ELSE '' END AS queued
            FROM bookings b JOIN profiles p ON user_id = p.id""",
)
def confirm_bookings(spark, sf):
    confirmed, notes = ledger.confirm_bookings(star.old_bookings(spark, sf), star.bookings(spark, sf), star.profiles(spark, sf))
    # At most one row per channel and booking.
    sent = notes.groupBy(F.col("booking_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "channel", "recipient"))), ",").alias("queued")
    )
    return confirmed.join(sent, "id", "left").select(
        "id", "status", "confirmation_sent", "points_earned", F.coalesce("queued", F.lit("")).alias("queued")
    )


_SETTLED = """(SELECT b.*, e.payment_id AS new_payment_id FROM bookings b JOIN
             (SELECT user_id AS order_id, 'pay_' || event_id AS payment_id FROM events WHERE event_type = 'purchase'
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, 'pay_' || event_id) = 1) e ON id = order_id WHERE payment_status <> 'PAID')"""


def _settlement(spark, sf):
    events = jobs.parse_payments(star.payment_bodies(star.events(spark, sf)))
    booked = star.bookings(spark, sf).withColumn("order_id", F.col("id").cast("string"))
    return settlement.settle_payments(events, booked, star.profiles(spark, sf))


@query(
    "settled_bookings", "X3 J7 D12 U1", "bookings",
    sql=f"""SELECT b.id, CASE WHEN s.id IS NOT NULL THEN 'CONFIRMED' ELSE b.status END AS status, CASE WHEN s.id IS NOT NULL THEN 'PAID' ELSE b.payment_status END AS payment_status,
              coalesce(new_payment_id, '-') AS payment_id, CASE WHEN s.id IS NOT NULL THEN CAST(floor(b.total_price / 100) AS BIGINT) ELSE 0 END AS points_earned
            FROM bookings b LEFT JOIN {_SETTLED} s USING (id)""",
)
def settled_bookings(spark, sf):
    """All bookings after the captured payments of the events."""
    return _settlement(spark, sf).bookings.select(
        "id", "status", "payment_status", F.coalesce("payment_id", F.lit("-")).alias("payment_id"), F.coalesce("points_earned", F.lit(0)).alias("points_earned")
    )


@query(
    "settled_profiles", "X3 J7 D11", "bookings", "profiles",
    sql=f"""SELECT p.id, CAST(coalesce(points, 0) AS BIGINT) AS loyalty_points, coalesce(trips, 0) AS total_bookings, CAST(coalesce(spent, 0) AS DOUBLE) AS total_spent,
              {_TIER.format('coalesce(spent, 0)')} AS tier FROM profiles p LEFT JOIN
              (SELECT user_id, sum(floor(total_price / 100)) AS points, count(*) AS trips, sum(total_price) AS spent FROM {_SETTLED} GROUP BY 1) b ON p.id = user_id""",
)
def settled_profiles(spark, sf):
    """All profiles after they were credited for the bookings that those payments settled."""
    return _settlement(spark, sf).profiles.select("id", "loyalty_points", "total_bookings", F.col("total_spent").cast("double").alias("total_spent"), "tier")


@query(
    "settled_notifications", "X3 J7 D12 F7", "bookings", "profiles",
    sql=f"""SELECT s.id AS booking_id, 'EMAIL' AS channel, contact_email AS recipient FROM {_SETTLED} s JOIN profiles p ON user_id = p.id WHERE notify_email AND contact_email IS NOT NULL
            UNION ALL SELECT s.id, 'SMS', contact_phone FROM {_SETTLED} s JOIN profiles p ON user_id = p.id WHERE notify_sms AND contact_phone IS NOT NULL""",
)
def settled_notifications(spark, sf):
    """Messages queued for them, one per open channel."""
    return _settlement(spark, sf).notifications.select("booking_id", "channel", "recipient")


@query(
    "cancel_bookings", "D13", "bookings", "profiles",
    sql=f"""SELECT id, CASE WHEN asked THEN 'CANCELLED' ELSE status END AS status, CASE WHEN NOT asked THEN payment_status WHEN payment_status = 'PAID' THEN 'REFUND_PENDING' ELSE 'VOID' END AS payment_status,
              CASE WHEN NOT asked THEN '-' WHEN payment_status = 'PAID' THEN 'PROCESSING' ELSE 'NONE' END AS refund_status, CASE WHEN asked THEN '{star.AS_OF}' ELSE '-' END AS cancelled
            FROM (SELECT *, booking_source = 'APP' AND status <> 'CANCELLED' AS asked FROM bookings)""",
)
def cancel_bookings(spark, sf):
    booked = star.bookings(spark, sf)
    out = ledger.cancel_bookings(booked, booked.filter("booking_source = 'APP'").select("id"), star.AS_OF)
    return out.select(
        "id", "status", "payment_status", F.coalesce("refund_status", F.lit("-")).alias("refund_status"),
        F.coalesce(F.date_format("cancelled_at", "yyyy-MM-dd"), F.lit("-")).alias("cancelled"),
    )


@query(
    "apply_coupon", "D21 A11", "bookings", "coupons",
    sql=f"""SELECT b.id, CAST(coalesce(d, 0) AS DOUBLE) AS discount_amount, CAST(total_price - coalesce(d, 0) AS DOUBLE) AS payable FROM bookings b LEFT JOIN
              (SELECT id, CAST(least(CASE discount_type WHEN 'PERCENT' THEN least(share, coalesce(max_discount, share)) ELSE discount_value END, total_price) AS DECIMAL(10,2)) AS d FROM
                (SELECT *, CAST(total_price * discount_value * 0.01 AS DECIMAL(20,2)) AS share, row_number() OVER (PARTITION BY coupon_code ORDER BY created_at, id) AS nth FROM
                  (SELECT b.*, c.* EXCLUDE (code), row_number() OVER (PARTITION BY coupon_code, user_id ORDER BY created_at, b.id) AS mine
                   FROM bookings b JOIN coupons c ON coupon_code = code
                   WHERE is_active AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1998-06-10') AND total_price >= min_booking_amt)
                 WHERE per_user_limit IS NULL OR mine <= per_user_limit)
               WHERE usage_limit IS NULL OR nth <= usage_limit - used_count) g ON b.id = g.id""",
)
def apply_coupon(spark, sf):
    out = ledger.apply_coupon(star.bookings(spark, sf), star.coupons(spark, sf), "1998-06-10")
    return out.select("id", F.col("discount_amount").cast("double").alias("discount_amount"), F.col("payable").cast("double").alias("payable"))


@query(
    "welcome_rows", "D22 U1", "profiles", "users",
    sql="""SELECT p.id, coalesce(u.email, p.email, '-') AS email, p.full_name, u.email_verified,
              CASE WHEN u.email IS NOT NULL THEN 'Hi ' || coalesce(u.full_name, u.name, split_part(u.email, '@', 1)) || '! Your flight companion is ready.' ELSE '-' END AS message
           FROM profiles p JOIN users u ON p.auth_user_id = u.id""",
)
def welcome_rows(spark, sf):
    people = star.profiles(spark, sf).select("id", "auth_user_id", "email", "phone", "full_name", F.lit(False).alias("email_verified"), F.lit(False).alias("phone_verified"))
    rows, notes = ledger.welcome_rows(people, star.users(spark, sf))
    merged = merges.upsert(people, rows, "auth_user_id", update=["email", "phone", "email_verified", "phone_verified"], keep_when_null=["email", "phone"])
    said = notes.select(F.col("user_id").alias("id"), "message")
    return merged.join(said, "id", "left").select(
        "id", F.coalesce("email", F.lit("-")).alias("email"), "full_name", "email_verified", F.coalesce("message", F.lit("-")).alias("message")
    )


# -- model ------------------------------------------------------------------------------------------------------------

_KEYS = ["l_orderkey", "l_linenumber", "departure_date", "l_partkey", "l_suppkey"]


def _features(spark, sf):
    return model.fare_features(star.price_history(spark, sf), star.AS_OF, star.ORDER, keep=_KEYS)


#: Histories that are held just now, by application and data set.
_HELD: dict[tuple[str, str], star.History] = {}


@contextmanager
def _history(spark, sf):
    """``star.kept_history``, made once for all that reads it inside."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _HELD:
        yield _HELD[key]
        return
    with star.kept_history(spark, sf) as made:
        _HELD[key] = made
        try:
            yield made
        finally:
            del _HELD[key]


#: Folders of the features and the model that a session has fitted, by application and data set.
_FITTED: dict[tuple[str, str], str] = {}


def _fitted(spark, sf):
    """(stored features, model as saved and loaded); fitted once a session and data set, and shared by the queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        path = work_dir(spark, "model")
        # A part holds whole routes, along which the price changes are taken.
        with _history(spark, sf) as history, swept(spark):
            for part in history.parts:
                model.fare_features(part, star.AS_OF, star.ORDER, keep=_KEYS).write.mode("append").parquet(f"{path}/features")
        fitted = model.train_fare_model(spark.read.parquet(f"{path}/features"), _KEYS)
        if fitted is None:
            raise ValueError("too few fares to train on")
        fitted.save(path)
        _FITTED[key] = path
    path = _FITTED[key]
    return spark.read.parquet(f"{path}/features"), model.FareModel.load(spark, path)


@query(
    "fare_features", "M1 M3 P2 P12 P16", "bounded_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, {R}, airline_code, CAST(days AS DOUBLE) AS days_until_dep, round(1.0 / (days + 1), 8) AS urgency,
              CAST(isodow(departure_date) - 1 AS DOUBLE) AS day_of_week, CAST(month(departure_date) AS DOUBLE) AS month, CAST(weekofyear(departure_date) AS DOUBLE) AS week_of_year,
              CAST(hour(recorded_at) AS DOUBLE) AS hour_of_day, CAST(hour(recorded_at) IN (7, 8, 9, 18, 19, 20, 21) AS DOUBLE) AS is_peak_hour,
              CASE WHEN is_live THEN CAST(least(greatest(seats_available, 1), 100) AS DOUBLE) ELSE 50 END AS seats_available,
              CASE WHEN is_live THEN {demand('days_until_dep', 'departure_date', 'seats_available')} ELSE 0.5::DOUBLE END AS demand_score, {season('departure_date')} AS seasonality_factor,
              round(c1, 4) AS price_change_1d, round(c3, 4) AS price_change_3d, CAST(is_live AS INTEGER) AS is_live, round(greatest(training_weight, 0.01), 6) AS weight
            FROM (SELECT *, greatest(date_diff('day', DATE '{star.AS_OF}', departure_date), 0) AS days, coalesce(price - lag(price, 1) OVER w, 0) AS c1,
                    coalesce(price - lag(price, 3) OVER w, 0) AS c3 FROM bounded_history
                  WINDOW w AS (PARTITION BY {R} ORDER BY recorded_at, l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey))
            WHERE price > 800 AND price < 60000""",
)
def fare_features(spark, sf):
    return _features(spark, sf).select(
        *_KEYS, *ROUTE, "airline_code", F.col("days_until_dep").cast("double").alias("days_until_dep"), F.round("urgency", 8).alias("urgency"), "day_of_week", "month",
        "week_of_year", "hour_of_day", "is_peak_hour", "seats_available", "demand_score", "seasonality_factor",
        F.round("price_change_1d", 4).alias("price_change_1d"), F.round("price_change_3d", 4).alias("price_change_3d"), "is_live",
        F.round("weight", 6).alias("weight"),
    )


@query(
    "record_fares", "M1 F17 F18 F19", "price_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, days_until_dep, {even('1.0::DOUBLE / (days_until_dep + 1)', 4)} AS urgency,
              isodow(departure_date) - 1 AS day_of_week, month(departure_date) AS month, weekofyear(departure_date) AS week_of_year, hour(recorded_at) AS hour_of_day,
              CAST(hour(recorded_at) IN (7, 8, 9, 18, 19, 20, 21) AS INTEGER) AS is_peak_hour, isodow(departure_date) >= 6 AS is_weekend,
              len(list_filter([-1, 0, 1], lambda x: strftime(departure_date + CAST(x AS INTEGER), '%m%d') IN ('0101','0126','0815','1002','1225'))) > 0 AS is_holiday,
              {demand('days_until_dep', 'departure_date', 'seats_available')} AS demand_score, {season('departure_date')} AS seasonality_factor
            FROM price_history""",
)
def record_fares(spark, sf):
    seen = star.price_history(spark, sf).drop("days_until_dep")
    return observations.record_fares(seen).select(
        *_KEYS, "days_until_dep", "urgency", "day_of_week", "month", "week_of_year", "hour_of_day", "is_peak_hour", "is_weekend", "is_holiday", "demand_score",
        "seasonality_factor",
    )


_HASH = """CAST((((CAST('0x' || substr(m, 1, 8) AS BIGINT) % 100 * 96 + CAST('0x' || substr(m, 9, 8) AS BIGINT)) % 100 * 96
   + CAST('0x' || substr(m, 17, 8) AS BIGINT)) % 100 * 96 + CAST('0x' || substr(m, 25, 8) AS BIGINT)) % 100 AS BIGINT)"""


_HASH_ROUTE = _HASH.replace("100 * 96", "10000 * 7296").replace("% 100 AS", "% 10000 AS")


@query(
    "train_test_split", "M4", "price_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, {_HASH} < 20 AS is_test FROM
              (SELECT *, md5(concat_ws('|', '42', l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey)) AS m FROM price_history)""",
)
def train_test_split(spark, sf):
    return star.price_history(spark, sf).select(*_KEYS, model.is_test(_KEYS).alias("is_test"))


@query("train_model", "M5 M6 S6 S7")
def train_model(spark, sf):
    """Hold-out metrics of the model trained on the whole history, as saved and loaded, and the rounds it stopped after."""
    features, fitted = _fitted(spark, sf)
    return model.held_out_metrics(features, fitted, _KEYS).withColumn("estimators", F.lit(fitted.trees.getNumTrees))


@query(
    "train_model_invariants", "M4 M5 M6 S6 S7", "price_history",
    sql=f"""SELECT count(*) AS rows, count(*) FILTER (test) AS test_rows, count(*) FILTER (NOT test AND validates) AS validation_rows, TRUE AS enough,
              TRUE AS rounds_in_bounds, TRUE AS metrics_kept, TRUE AS beats_the_mean
            FROM (SELECT {_HASH.replace('m,', 'a,')} < 20 AS test, {_HASH.replace('m,', 'b,')} < 10 AS validates FROM
              (SELECT md5(concat_ws('|', '42', l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey)) AS a,
                      md5(concat_ws('|', '43', l_orderkey, l_linenumber, departure_date, l_partkey, l_suppkey)) AS b
               FROM price_history WHERE price > 800 AND price < 60000))""",
)
def train_model_invariants(spark, sf):
    """What must hold of the trained model whatever the trees: its rows, its rounds, kept metrics, and a lower error than the mean fare's."""
    features, fitted = _fitted(spark, sf)
    test, validates = model.hash_percent(*_KEYS, seed=42) < 20, model.hash_percent(*_KEYS, seed=43) < model.VALIDATION
    counted = features.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(test).alias("test_rows"), F.count_if(~test & validates).alias("validation_rows"),
        F.stddev_pop(F.when(test, F.col("price"))).alias("spread"),
    )
    measured = model.held_out_metrics(features, fitted, _KEYS).first().asDict()
    kept, rounds = fitted.metrics, fitted.trees.getNumTrees
    same = all(abs(kept[k] - v) <= 1e-9 * abs(v) for k, v in measured.items())
    return counted.select(
        "rows", "test_rows", "validation_rows", F.lit(tables.require_rows(features, 200)).alias("enough"),
        F.lit(1 <= rounds <= model.ROUNDS and kept["estimators"] == rounds).alias("rounds_in_bounds"),
        (F.lit(same) & (F.col("test_rows") == measured["samples"])).alias("metrics_kept"), (F.col("spread") > measured["rmse"]).alias("beats_the_mean"),
    )


def _asked(spark, sf):
    """One request per active alert."""
    return star.alerts(spark, sf).filter("is_active").select(
        F.col("id").alias("request_id"), F.col("origin_code").alias("origin"), F.col("destination_code").alias("destination"),
        F.col("departure_date").cast("string").alias("departure_date"),
    )


def _requests(spark, sf, asked, history):
    """Requests split into snapshots and rejects."""
    return answer.request_snapshots(asked, within_price_bounds(history), star.routes(spark, sf, history), star.AS_OF)


def _distinct_snapshots(spark, sf):
    """(snapshots of the distinct requests, links of all requests with them). Requests, the history's columns and snapshots are
    stored, since they are read more than once; dealt by id, the thirty days of a request stay in its task."""
    path = work_dir(spark, "requests")
    with _history(spark, sf) as history, swept(spark):
        _asked(spark, sf).write.parquet(f"{path}/asked")
        distinct, links = answer.distinct_requests(spark.read.parquet(f"{path}/asked"))
        fares = history.whole.select(*ROUTE, "airline_code", "price", "seats_available")
        if not history.stored:
            fares.write.parquet(f"{path}/history")
            fares = spark.read.parquet(f"{path}/history")
        _requests(spark, sf, distinct, fares)[0].write.parquet(f"{path}/snapshots")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.parquet(f"{path}/snapshots").repartition(parts, *answer.REQUEST), links


@query("answer_requests", "M7 M8 M10 D10 D14 D15")
def answer_requests(spark, sf):
    """One prediction answer per active alert's route and date, from the model trained on the whole history."""
    with _history(spark, sf):
        snapshots, links = _distinct_snapshots(spark, sf)
        _, fitted = _fitted(spark, sf)
    answers = answer.answer_requests(snapshots, fitted, star.AS_OF)
    return answer.of_all(links, answers).select(
        "request_id", *ROUTE, "current_price", "decision", "confidence", "trend", "prob_increase", "market_status"
    )


@query(
    "request_rejects", "S7 P9 J13", "price_history", "bounded_history", "alerts",
    sql=f"""SELECT id AS request_id, CASE WHEN origin_code = destination_code THEN 'same_place' WHEN r.o IS NULL THEN 'unsupported_route' WHEN f.o IS NULL THEN 'no_fare' END AS reason
            FROM alerts LEFT JOIN (SELECT DISTINCT origin_code AS o, destination_code AS d FROM price_history) r ON r.o = origin_code AND r.d = destination_code
              LEFT JOIN (SELECT DISTINCT origin_code AS o, destination_code AS d FROM bounded_history) f ON f.o = origin_code AND f.d = destination_code
            WHERE is_active AND (origin_code = destination_code OR f.o IS NULL)""",
)
def request_rejects(spark, sf):
    _, rejects = _requests(spark, sf, _asked(spark, sf), star.price_history(spark, sf))
    return rejects.select("request_id", F.col("reject_reasons")[0].alias("reason"))


@query(
    "answer_invariants", "M7 M8 D10 D14 D15", "bounded_history", "alerts",
    sql=f"""SELECT id AS request_id, {R}, 30 AS points, TRUE AS banded, TRUE AS lifted, TRUE AS dated, TRUE AS decided
            FROM alerts JOIN (SELECT DISTINCT {R} FROM bounded_history) USING (origin_code, destination_code) WHERE is_active AND origin_code <> destination_code""",
)
def answer_invariants(spark, sf):
    """What must hold of every answered request whatever the model: thirty days in a band, no fare left at or below 0, a known decision."""
    with _history(spark, sf):
        snapshots, links = _distinct_snapshots(spark, sf)
        _, fitted = _fitted(spark, sf)
    days = model.forecast_fares(snapshots, fitted, star.AS_OF).groupBy("request_id").agg(
        F.count(F.lit(1)).cast("int").alias("points"), F.bool_and((F.col("lower") <= F.greatest("price", F.lit(800.0))) & (F.col("price") <= F.col("upper"))).alias("banded"),
        F.bool_and(F.col("price") > 0).alias("lifted"), (F.min("day") == 1).alias("from_one"), F.count_distinct("date").alias("dates"),
    )
    given = answer.answer_requests(snapshots, fitted, star.AS_OF).select(
        "request_id", *ROUTE, (F.col("decision").isNotNull() & F.col("confidence").between(0, 1) & F.col("trend").isNotNull()).alias("decided")
    )
    return answer.of_all(links, given.join(days, "request_id")).select(
        "request_id", *ROUTE, "points", "banded", "lifted", (F.col("from_one") & (F.col("dates") == F.col("points"))).alias("dated"), "decided"
    )


@query(
    "forecast_grid", "M8 J8", "snapshots",
    sql=f"""SELECT {R}, CAST(day AS INTEGER) AS day, DATE '{star.AS_OF}' + CAST(day AS INTEGER) AS date, greatest(date_diff('day', DATE '{star.AS_OF}' + CAST(day AS INTEGER), departure_date), 0) AS days_until_dep,
              greatest(seats_available - (day - 1) // 2, 1) AS seats_available, round(least(1, demand_score + (day - 1) * 0.01::DOUBLE), 6) AS demand_score,
              isodow(departure_date) - 1 AS day_of_week, {even('greatest(800, current_price - greatest(120, current_price * 0.06::DOUBLE))', 2)} AS lower
            FROM (SELECT *, unnest(range(1, 31)) AS day FROM snapshots)""",
)
def forecast_grid(spark, sf):
    grid = model.forecast_grid(star.snapshots(spark, sf), star.AS_OF)
    band = model.forecast_band("current_price")
    return grid.select(
        *ROUTE, "day", "date", "days_until_dep", "seats_available", F.round("demand_score", 6).alias("demand_score"), "day_of_week",
        band["lower"].alias("lower"),
    )


@query(
    "guarded_fare", "M7 F4", "bounded_history",
    sql=f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, departure_date, CASE WHEN seats_available < 3 THEN 3000 + {_HASH_ROUTE}
              WHEN price < 8000 THEN {even('price * 0.09::DOUBLE * 1.15::DOUBLE', 2)} ELSE price END AS fare
            FROM (SELECT *, md5(origin_code || destination_code) AS m FROM bounded_history)""",
)
def guarded_fare(spark, sf):
    score = F.when(F.col("seats_available") >= 3, F.when(F.col("price") < 8000, F.col("price") * 0.09).otherwise(F.col("price")))
    scored = star.bounded_history(spark, sf).withColumn("score", score)
    return scored.select(*_KEYS, model.guarded_fare("score").alias("fare"))


@query(
    "fallback_forecast", "M9", "snapshots",
    sql=f"""SELECT {R}, CAST(day AS INTEGER) AS day, DATE '{star.AS_OF}' + CAST(day AS INTEGER) AS date, floor(p + 0.5) AS price, floor(p - b * 0.04::DOUBLE + 0.5) AS lower, floor(p + b * 0.04::DOUBLE + 0.5) AS upper FROM
              (SELECT {R}, day, b, greatest(800, b + b * (CASE WHEN days_until_departure < 13 THEN 0.006::DOUBLE WHEN days_until_departure < 26 THEN -0.004::DOUBLE ELSE 0.001::DOUBLE END) * (day - 1)
                 + b * 0.025::DOUBLE * sin(2 * pi() * (day + 2) / 7)) AS p
               FROM (SELECT *, floor(current_price) AS b, unnest(range(1, 31)) AS day FROM snapshots))""",
)
def fallback_forecast(spark, sf):
    days = F.col("days_until_departure")
    trend = F.when(days < 13, "RISING").when(days < 26, "FALLING").otherwise("STABLE")
    bases = star.snapshots(spark, sf).select(*ROUTE, F.floor("current_price").cast("double").alias("base_price"), trend.alias("trend"))
    return model.fallback_forecast(bases, star.AS_OF).select(*ROUTE, "day", "date", "price", "lower", "upper")


@query(
    "complete_forecast", "M9", "forecast", "snapshots",
    sql=f"""SELECT {R}, CASE WHEN n >= 7 THEN n ELSE 30 END AS points FROM snapshots LEFT JOIN
              (SELECT {R}, count(*) AS n FROM forecast WHERE day <= CASE WHEN origin_code < destination_code THEN 5 ELSE 20 END GROUP BY 1, 2) USING ({R})""",
)
def complete_forecast(spark, sf):
    short = F.when(F.col("origin_code") < F.col("destination_code"), 5).otherwise(20)
    given = star.forecast(spark, sf).filter(F.col("day") <= short)
    bases = star.snapshots(spark, sf).select(*ROUTE, F.col("current_price").alias("base_price"), F.lit("STABLE").alias("trend"))
    return model.complete_forecast(given, bases, star.AS_OF).groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("points"))


@query(
    "current_fares", "M10", "snapshots",
    sql=f"SELECT {R}, CASE WHEN seats_available >= 10 THEN current_price * 1.1::DOUBLE ELSE current_price END AS current_price FROM snapshots",
)
def current_fares(spark, sf):
    predicted = F.when(F.col("seats_available") >= 10, F.col("current_price") * 1.1)
    return model.current_fares(star.snapshots(spark, sf).withColumn("predicted", predicted)).select(*ROUTE, "current_price")


# -- streams ----------------------------------------------------------------------------------------------------------


def _finish(stream_query):
    stream_query.awaitTermination()


@query(
    "alert_stream", "X1 X2 J14", "alerts", "ticks",
    sql=f"""SELECT id AS alert_id, current_price FROM alerts a JOIN (SELECT {R}, min(price) AS current_price FROM ticks GROUP BY 1, 2) t USING ({R})
            WHERE is_active AND current_price <= CAST(target_price AS DOUBLE)""",
)
def alert_stream(spark, sf):
    out, mark = work_dir(spark, "alerts"), work_dir(spark, "alerts-log")
    ticks = star.fare_ticks(star.event_stream(spark, sf))
    _finish(jobs.alert_stream(ticks, lambda: star.alerts(spark, sf), out, mark, every=None))
    return jobs.notify_once(spark.read.parquet(f"{out}/hits"), ts="batch_id").select("alert_id", "current_price")


@query(
    "alert_state", "X1 D18", "alerts", "ticks",
    sql=f"""SELECT id, coalesce(CASE WHEN is_active THEN p END, CAST(last_price AS DOUBLE)) AS last_price,
              CAST(triggered_count + CASE WHEN is_active AND p <= CAST(target_price AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS triggered_count
            FROM alerts LEFT JOIN (SELECT {R}, min(price) AS p FROM ticks GROUP BY 1, 2) USING ({R})""",
)
def alert_state(spark, sf):
    """What the alert job leaves behind after the one batch that the supplied events make."""
    out, mark = work_dir(spark, "alert-state"), work_dir(spark, "alert-state-log")
    ticks = star.fare_ticks(star.event_stream(spark, sf))
    _finish(jobs.alert_stream(ticks, lambda: star.alerts(spark, sf), out, mark, every=None))
    return jobs.alert_state(spark, out, 0)


@query(
    "notify_once", "X2", "ticks",
    sql=f"""SELECT {R}, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS at FROM ticks GROUP BY 1, 2 HAVING min(ts) < (SELECT max(ts) FROM ticks)""",
)
def notify_once(spark, sf):
    """The earliest tick of every route; the very last one of the events waits for a later one."""
    out, mark = work_dir(spark, "once"), work_dir(spark, "once-log")
    ticks = star.fare_ticks(star.event_stream(spark, sf)).select("ts", *ROUTE, F.concat(*ROUTE).alias("alert_id"))
    first = jobs.notify_once(ticks, "60 days")
    sink = first.writeStream.outputMode("update").option("checkpointLocation", mark)
    _finish(sink.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}")).trigger(availableNow=True).start())
    return spark.read.parquet(out).select(*ROUTE, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query(
    "payment_stream", "X3 J7", "bookings",
    sql="""SELECT id, payment_id AS new_payment_id, 'PAID' AS payment_status FROM bookings JOIN
             (SELECT user_id AS order_id, 'pay_' || event_id AS payment_id, ts FROM events WHERE event_type = 'purchase'
              QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, 'pay_' || event_id) = 1) e ON id = order_id WHERE payment_status <> 'PAID'""",
)
def payment_stream(spark, sf):
    out, mark = work_dir(spark, "payments"), work_dir(spark, "payments-log")
    events = jobs.parse_payments(star.payment_bodies(star.event_stream(spark, sf)))
    booked = star.bookings(spark, sf).withColumn("order_id", F.col("id").cast("string"))
    _finish(jobs.payment_stream(events, booked, out, mark, every=None))
    return spark.read.parquet(out).select("id", "new_payment_id", "payment_status")


_RETRY = """SELECT q.id, CASE WHEN q.status <> 'PENDING' THEN q.status WHEN coalesce(sent, 0) = 1 THEN 'SENT'
       WHEN least(retry_count + coalesce(failures, 0), greatest(retry_count, max_retries)) >= max_retries THEN 'FAILED' ELSE 'PENDING' END AS status,
     CAST(least(retry_count + coalesce(failures, 0), greatest(retry_count, max_retries)) AS INTEGER) AS retry_count
   FROM queue q {} JOIN (SELECT notification_id, count(*) FILTER (outcome = 'FAILED') AS failures, max(CAST(outcome = 'SENT' AS INTEGER)) AS sent
                         FROM outcomes GROUP BY 1) s ON q.id = notification_id"""


@query("retry_queue", "X4", "queue", "outcomes", sql=_RETRY.format("LEFT"))
def retry_queue(spark, sf):
    source = star.events(spark, sf)
    return jobs.retry_queue(star.notification_queue(source), jobs.retry_state(star.outcomes(source))).select("id", "status", "retry_count")


@query("retry_stream", "X4", "queue", "outcomes", sql=_RETRY.format("INNER"))
def retry_stream(spark, sf):
    out, mark = work_dir(spark, "retry"), work_dir(spark, "retry-log")
    queue = star.notification_queue(star.events(spark, sf))
    _finish(jobs.retry_stream(star.outcomes(star.event_stream(spark, sf)), queue, out, mark, every=None))
    return jobs.latest_versions(spark.read.parquet(out)).select("id", "status", "retry_count")


_ATTEMPTS = """SELECT challenge_id, CAST(coalesce(min(n) FILTER (is_match), count(*)) AS INTEGER) AS attempts, count(*) FILTER (is_match) > 0 AS is_used FROM
   (SELECT *, row_number() OVER (PARTITION BY challenge_id ORDER BY ts, attempt_id) AS n FROM attempts WHERE ts <= expires_at) WHERE n <= 5 GROUP BY 1"""


@query("challenge_results", "X5 W3", "attempts", sql=_ATTEMPTS)
def challenge_results(spark, sf):
    return jobs.challenge_results(star.code_attempts(star.events(spark, sf)))


@query("challenge_stream", "X5", "attempts", sql=_ATTEMPTS)
def challenge_stream(spark, sf):
    out, mark = work_dir(spark, "codes"), work_dir(spark, "codes-log")
    states = jobs.challenge_stream(star.code_attempts(star.event_stream(spark, sf)))
    sink = states.writeStream.outputMode("update").option("checkpointLocation", mark)
    _finish(sink.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch_id={i}")).trigger(availableNow=True).start())
    rows = spark.read.parquet(out)
    latest = F.max(F.struct("batch_id", "attempts", "is_used"))
    return rows.groupBy("challenge_id").agg(latest.alias("s")).select("challenge_id", "s.attempts", "s.is_used")


@query(
    "fare_ingest_stream", "X6 S4", "ticks",
    sql=f"SELECT {R}, count(*) AS fares, round(sum(price), 2) AS total FROM ticks GROUP BY 1, 2",
)
def fare_ingest_stream(spark, sf):
    out, mark = work_dir(spark, "ingest"), work_dir(spark, "ingest-log")
    ticks = star.fare_ticks(star.event_stream(spark, sf))
    _finish(jobs.fare_ingest_stream(ticks, out, mark, partition_by=["origin_code"], every=None))
    return spark.read.parquet(out).groupBy(*ROUTE).agg(F.count(F.lit(1)).alias("fares"), F.round(F.sum("price"), 2).alias("total"))


@query(
    "alert_expiry_stream", "X7 P5", "ticks",
    sql="""SELECT event_id AS id, strftime(least(ts + INTERVAL 3 DAY, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS expired_at
           FROM ticks WHERE date_trunc('millisecond', least(ts + INTERVAL 3 DAY, CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP))) < (SELECT max(date_trunc('millisecond', ts)) FROM ticks)""",
)
def alert_expiry_stream(spark, sf):
    """Alerts that ended before the last event, each at its own time."""
    out, mark = work_dir(spark, "expiry"), work_dir(spark, "expiry-log")
    rows = star.event_stream(spark, sf).select(
        F.col("event_id").alias("id"), F.lit(True).alias("is_active"), F.col("ts").cast("date").alias("departure_date"),
        (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"), F.col("ts").alias("created_at"),
    )
    _finish(jobs.alert_expiry_stream(rows, out, mark))
    return spark.read.parquet(out).select("id", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss").alias("expired_at"))


_WINDOWED = f"""SELECT {R}, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(min(price), 2) AS low, round(max(price), 2) AS high, round(avg(price), 4) AS mean, count(*) AS fares
    FROM ticks {{}} GROUP BY 1, 2, 3"""


def _windowed_columns(df):
    return df.select(
        *ROUTE, F.date_format("window_start", "yyyy-MM-dd").alias("day"), F.round("low", 2).alias("low"), F.round("high", 2).alias("high"),
        F.round("mean", 4).alias("mean"), "fares",
    )


@query("windowed_fares", "X8", "ticks", sql=_WINDOWED.format(""))
def windowed_fares(spark, sf):
    return _windowed_columns(jobs.windowed_fares(star.fare_ticks(star.events(spark, sf))))


@query(
    "windowed_fares_stream", "X8", "ticks",
    sql=_WINDOWED.format("WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR"),
)
def windowed_fares_stream(spark, sf):
    """Closed windows only: a window is emitted once the watermark has passed its end."""
    out, mark = work_dir(spark, "windows"), work_dir(spark, "windows-log")
    closed = jobs.windowed_fares(star.fare_ticks(star.event_stream(spark, sf)), lateness="1 hour")
    _finish(closed.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start())
    return _windowed_columns(spark.read.parquet(out))
