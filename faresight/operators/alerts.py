"""Price-alert evaluation and the choice of notification channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import col, non_blank
from ..functions.dates import days_until
from ..functions.pricing import ALERT_BASE, alert_fare
from ..functions.text import alert_text
from .joins import lookup_default
from .ordered import row_index, running

CHANNELS = ("EMAIL", "SMS", "WHATSAPP")


def price_alerts_now(alerts: DataFrame, base_fares: DataFrame, as_of) -> DataFrame:
    """Adds ``current_price`` by the alert rule; null for an alert without a route.

    ``base_fares`` holds one ``base`` per route.
    """
    has_route = non_blank("origin_code").isNotNull() & non_blank("destination_code").isNotNull()
    with_base = lookup_default(alerts, base_fares, ["origin_code", "destination_code"], {"base": ALERT_BASE})
    days = days_until("departure_date", as_of, default=30)
    return with_base.withColumn("current_price", F.when(has_route, alert_fare("base", days))).drop("base")


def check_alerts(priced: DataFrame) -> DataFrame:
    """Alerts carrying ``current_price`` after their check, in one pass: ``last_price`` and ``triggered_count`` as updated,
    ``is_triggered`` and the ``savings`` against the target.
    """
    met = F.coalesce(F.col("is_active") & (F.col("current_price") <= F.col("target_price").cast("double")), F.lit(False))
    count = F.coalesce(F.col("triggered_count"), F.lit(0))
    before = F.col("last_price").cast("double") if "last_price" in priced.columns else F.lit(None).cast("double")
    return priced.withColumns(
        {
            "is_triggered": met,
            "last_price": F.coalesce(F.when(F.col("is_active"), F.col("current_price")), before),
            "triggered_count": F.when(met, count + 1).otherwise(count),
            "savings": F.when(met, F.col("target_price").cast("double") - F.col("current_price")),
        }
    )


def evaluate_alerts(priced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(updated alerts, triggers): the two parts of ``check_alerts``, for writers that store them apart."""
    checked = check_alerts(priced)
    return checked.drop("is_triggered", "current_price", "savings"), checked.filter("is_triggered").drop("is_triggered")


def lowest_seen(
    observations: DataFrame, order: Sequence[str], keys: str | Sequence[str] = "alert_id", price: str = "price"
) -> DataFrame:
    """Running minimum fare per alert (or any other key)."""
    return running(observations, keys, order, {"lowest_seen": ("min", price)})


def _open_channels(email: str, phone: str) -> list[Column]:
    def open_(flag: str, contact: str, name: str) -> Column:
        usable = F.coalesce(col(flag), F.lit(False)) & non_blank(contact).isNotNull()
        return F.when(usable, F.struct(F.lit(name).alias("channel"), F.col(contact).alias("recipient")))

    return [
        open_("notify_email", email, "EMAIL"),
        open_("notify_sms", phone, "SMS"),
        open_("notify_whatsapp", phone, "WHATSAPP"),
    ]


def route_channel(df: DataFrame, email: str = "email", phone: str = "phone") -> DataFrame:
    """First usable channel in the order e-mail, SMS, WhatsApp; null when none is usable."""
    first = F.coalesce(*_open_channels(email, phone))
    return df.withColumns({"channel": first["channel"], "recipient": first["recipient"]})


def notify_channels(df: DataFrame, email: str = "contact_email", phone: str = "contact_phone") -> DataFrame:
    """One row per usable channel."""
    rows = df.withColumn("_c", F.explode(F.array_compact(F.array(*_open_channels(email, phone)))))
    return rows.select("*", F.col("_c.channel").alias("channel"), F.col("_c.recipient").alias("recipient")).drop("_c")


def alert_messages(checked: DataFrame, profiles: DataFrame) -> DataFrame:
    """One message per triggered alert whose customer can be reached, on the first usable channel.

    (alert_id, user_id, channel, recipient, name, message, savings)
    """
    people = profiles.select(F.col("id").alias("user_id"), "full_name", "email", "phone", "notify_email", "notify_sms", "notify_whatsapp")
    due = route_channel(checked.filter("is_triggered").join(people, "user_id")).filter(F.col("channel").isNotNull())
    return due.select(
        F.col("id").alias("alert_id"), "user_id", "channel", "recipient", F.coalesce("full_name", F.lit("Traveller")).alias("name"),
        alert_text("origin_code", "destination_code", "current_price", "target_price").alias("message"), "savings",
    )


def alerts_by_departure(alerts: DataFrame) -> DataFrame:
    """Active alerts with their 1-based ``position`` by departure among those of the same customer."""
    return row_index(alerts.filter("is_active"), "user_id", ["departure_date", "id"], out="position")
