"""From captured payments to confirmed bookings: one plan over the booking, profile and notification tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.joins import match_payments
from ..operators.ledger import award_loyalty, confirm_bookings
from ..operators.merges import upsert


@dataclass
class Settlement:
    """The tables after the payments: all bookings, all profiles, and the notifications to queue."""

    bookings: DataFrame
    profiles: DataFrame
    notifications: DataFrame


def settle_payments(events: DataFrame, bookings: DataFrame, profiles: DataFrame, order: str = "order_id") -> Settlement:
    """Captured payments settle unpaid bookings, which are confirmed, credited to their customers and announced.

    The first captured payment of an order counts and a booking that is paid already stays as it is, so messages that are
    sent again change nothing. Everything after the match is done for the settled bookings alone; they meet the whole
    tables once, where their new versions are merged in.
    """
    open_ = bookings.drop("payment_id", "paid_at").withColumnRenamed(order, "order_id")
    matched = match_payments(events, open_)
    paid = matched.withColumns({"payment_status": F.lit("PAID"), "payment_id": F.col("new_payment_id")})
    before = matched.select("id", "payment_status")
    confirmed, notifications = confirm_bookings(before, paid, profiles)
    changed = ["status", "payment_status", "payment_id", "paid_at", "confirmation_sent", "points_earned"]
    kinds = dict(confirmed.dtypes)
    base = bookings.withColumns({c: F.lit(None).cast(kinds[c]) for c in changed if c not in bookings.columns})
    merged = upsert(base, confirmed.select("id", *changed), "id", update=changed)
    return Settlement(merged, award_loyalty(before, paid, profiles), notifications)
