"""Derived relations over the logical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .filters import live_alerts, pending_notifications

_BOOKING_COLUMNS = (
    "id booking_reference pnr status payment_status total_price base_fare taxes discount_amount currency cabin_class "
    "num_passengers contact_email contact_phone checkin_notif_sent confirmation_sent flight_offer_data created_at "
    "cancelled_at refund_amount refund_status"
).split()
_ALERT_COLUMNS = (
    "id user_id origin_code destination_code departure_date cabin_class target_price notify_email notify_sms "
    "notify_whatsapp last_checked last_price lowest_seen triggered_count expires_at"
).split()


def _have(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def booking_details(bookings: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bookings with their customer; bookings without a known customer drop out."""
    people = profiles.select(
        F.col("id").alias("user_id"),
        F.col("full_name").alias("user_name"),
        F.col("email").alias("user_email"),
        F.col("phone").alias("user_phone"),
        *_have(profiles, ["notify_email", "notify_sms", "notify_whatsapp", "loyalty_points", "tier"]),
    )
    mine = bookings.select(*_have(bookings, [*_BOOKING_COLUMNS, "user_id"]))
    return mine.join(people, "user_id").drop("user_id")


def _airport(airports: DataFrame, role: str, key: str, columns: dict[str, str]) -> DataFrame:
    side = airports.select(
        F.col("iata_code").alias(key), *[F.col(c).alias(f"{role}_{out}") for c, out in columns.items()]
    )
    return side


def active_alert_details(alerts: DataFrame, profiles: DataFrame, airports: DataFrame, as_of) -> DataFrame:
    people = profiles.select(F.col("id").alias("user_id"), "full_name", "email", "phone")
    place = {"city": "city", "name": "airport"}
    return (
        live_alerts(alerts, as_of)
        .select(*_have(alerts, _ALERT_COLUMNS))
        .join(_airport(airports, "origin", "origin_code", place), "origin_code")
        .join(_airport(airports, "dest", "destination_code", place), "destination_code")
        .join(people, "user_id")
    )


def domestic_routes(routes: DataFrame, airports: DataFrame, country: str = "IN", ordered: bool = True) -> DataFrame:
    """Active routes with both ends in one country, busiest first."""
    home = airports.filter(F.col("country_code") == country)
    wanted = {"city": "city", "name": "airport", "state": "state", "region": "region", "latitude": "lat",
              "longitude": "lng"}
    place = {c: out for c, out in wanted.items() if c in airports.columns}
    out = (
        routes.filter("is_active")
        .drop("is_active", "created_at", "updated_at")
        .join(_airport(home, "origin", "origin_code", place), "origin_code")
        .join(_airport(home, "dest", "destination_code", place), "destination_code")
    )
    if not ordered:
        return out
    return out.orderBy(F.desc("flights_per_day"), "origin_code", "destination_code")


def alerts_with_profile(alerts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every alert with its customer as a nested ``profile`` (null when unknown)."""
    card = F.struct("email", "phone", "full_name", "notify_email", "notify_sms", "notify_whatsapp")
    people = profiles.select(F.col("id").alias("user_id"), card.alias("profile"))
    return alerts.join(people, "user_id", "left")


def first_passenger_name(bookings: DataFrame, passengers: DataFrame, default: str = "Traveller") -> DataFrame:
    lead = passengers.groupBy("booking_id").agg(
        F.min(F.struct("ordinal", "first_name")).getField("first_name").alias("_lead")
    )
    return (
        bookings.join(lead.withColumnRenamed("booking_id", "id"), "id", "left")
        .withColumn("passenger_name", F.coalesce("_lead", F.lit(default)))
        .drop("_lead")
    )


def profile_card(profiles: DataFrame) -> DataFrame:
    """Nested preferences and loyalty, with defaults for missing settings."""

    def known(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in profiles.columns else F.lit(default)

    def given(name: str) -> Column:
        return F.col(name) if name in profiles.columns else F.lit(None).cast("string")

    return profiles.select(
        "id",
        "full_name",
        "email",
        "phone",
        known("phone_verified", False).alias("phone_verified"),
        F.struct(
            known("notify_email", True).alias("notify_email"),
            known("notify_sms", False).alias("notify_sms"),
            known("notify_whatsapp", False).alias("notify_whatsapp"),
            given("meal_preference").alias("meal"),
            given("preferred_seat").alias("seat"),
            known("preferred_cabin", "ECONOMY").alias("cabin"),
        ).alias("preferences"),
        F.struct(
            known("loyalty_points", 0).alias("points"),
            known("tier", "BLUE").alias("tier"),
            F.col("created_at").alias("member_since"),
        ).alias("loyalty"),
    )


def register_views(tables: dict[str, DataFrame], as_of) -> None:
    """Makes the four derived relations available to SQL."""
    booking_details(tables["bookings"], tables["profiles"]).createOrReplaceTempView("v_booking_details")
    active_alert_details(
        tables["price_alerts"], tables["profiles"], tables["airports"], as_of
    ).createOrReplaceTempView("v_active_alerts")
    domestic_routes(tables["routes"], tables["airports"]).createOrReplaceTempView("v_domestic_routes")
    pending_notifications(tables["notifications"], as_of).createOrReplaceTempView("v_pending_notifications")
