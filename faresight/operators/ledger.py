"""Booking, payment, loyalty and coupon ledgers. Money stays decimal."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import as_ts, col, non_blank
from ..functions import text
from .aggregates import loyalty_totals
from .filters import visible_coupons
from .ordered import row_index, running, top_k

# Lifetime spend from which a tier holds.
TIERS = [("PLATINUM", 500000), ("GOLD", 150000), ("SILVER", 50000)]


def tier_of(spent: str | Column) -> Column:
    out = None
    for name, floor in TIERS:
        hit = col(spent) >= floor
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("BLUE")


def award_points(total: str | Column) -> Column:
    return F.greatest(F.lit(0), F.floor(col(total) / 100)).cast("int")


def newly_paid(old: DataFrame, new: DataFrame) -> DataFrame:
    """All new versions, with ``newly_paid`` where an existing booking changed to PAID just now."""
    before = old.select("id", F.coalesce(F.col("payment_status"), F.lit("")).alias("_was"))
    changed = (F.col("payment_status") == "PAID") & (F.col("_was") != "PAID")
    return (
        new.join(before, "id", "left").withColumn("newly_paid", F.coalesce(changed, F.lit(False))).drop("_was")
    )


def award_loyalty(old: DataFrame, new: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles after crediting the bookings that just became paid."""
    credit = loyalty_totals(newly_paid(old, new).filter("newly_paid")).withColumnRenamed("user_id", "id")
    spent = F.coalesce(F.col("total_spent"), F.lit(0)) + F.coalesce(F.col("spent"), F.lit(0))
    joined = profiles.join(credit, "id", "left").withColumn("_spent", spent)
    return joined.withColumns(
        {
            "loyalty_points": F.col("loyalty_points") + F.coalesce(F.col("points"), F.lit(0)),
            "total_bookings": F.col("total_bookings") + F.coalesce(F.col("trips"), F.lit(0)),
            "total_spent": F.col("_spent"),
            "tier": F.when(F.col("trips").isNull(), F.col("tier")).otherwise(tier_of("_spent")),
        }
    ).select(*profiles.columns)


def tier_progress(bookings: DataFrame, paid_at: str = "created_at") -> DataFrame:
    """Running spend of each customer over paid bookings, and the tier after each."""
    paid = bookings.filter((F.col("payment_status") == "PAID") & F.col("user_id").isNotNull())
    out = running(paid, "user_id", [paid_at, "id"], {"running_spend": ("sum", "total_price")})
    return out.withColumn("tier", tier_of("running_spend"))


def confirm_bookings(
    old: DataFrame, new: DataFrame, profiles: DataFrame, brand: str = "Faresight"
) -> tuple[DataFrame, DataFrame]:
    """(bookings, notifications): bookings just paid become confirmed and queue one row per open channel."""
    flagged = newly_paid(old, new)
    now = F.col("newly_paid")
    bookings = flagged.withColumns(
        {
            "status": F.when(now, "CONFIRMED").otherwise(F.col("status")),
            "confirmation_sent": F.when(now, True).otherwise(
                F.col("confirmation_sent") if "confirmation_sent" in new.columns else F.lit(False)
            ),
            "points_earned": F.when(now, award_points("total_price")).otherwise(
                F.col("points_earned") if "points_earned" in new.columns else F.lit(0)
            ),
        }
    ).drop("newly_paid")

    people = profiles.select(F.col("id").alias("user_id"), "notify_email", "notify_sms")
    due = flagged.filter(now).join(people, "user_id")
    mail = F.when(
        F.col("notify_email") & F.col("contact_email").isNotNull(),
        F.struct(
            F.lit("EMAIL").alias("channel"),
            F.col("contact_email").alias("recipient"),
            text.confirmation_subject("booking_reference").alias("subject"),
            text.confirmation_email("total_price", brand).alias("message"),
            F.lit("booking_confirm_email").alias("template_id"),
        ),
    )
    sms = F.when(
        F.col("notify_sms") & F.col("contact_phone").isNotNull(),
        F.struct(
            F.lit("SMS").alias("channel"),
            F.col("contact_phone").alias("recipient"),
            F.lit(None).cast("string").alias("subject"),
            text.confirmation_sms("booking_reference", "total_price", brand).alias("message"),
            F.lit("booking_confirm_sms").alias("template_id"),
        ),
    )
    notifications = due.select(
        "user_id",
        F.col("id").alias("booking_id"),
        F.lit("BOOKING_CONFIRMATION").alias("type"),
        F.inline(F.array_compact(F.array(mail, sms))),
    ).withColumn("status", F.lit("PENDING"))
    return bookings, notifications


def cancel_bookings(bookings: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Applies cancellation requests (``id``); a booking already cancelled stays untouched."""
    asked = requests.select("id").distinct().withColumn("_asked", F.lit(True))
    joined = bookings.join(asked, "id", "left").withColumn(
        "_now", F.coalesce(F.col("_asked"), F.lit(False)) & (F.coalesce(F.col("status"), F.lit("")) != "CANCELLED")
    )
    paid = F.coalesce(F.col("payment_status"), F.lit("")) == "PAID"

    def prior(c: str, kind: str) -> Column:
        return F.col(c) if c in bookings.columns else F.lit(None).cast(kind)

    now = F.col("_now")
    return joined.withColumns(
        {
            "status": F.when(now, "CANCELLED").otherwise(F.col("status")),
            "refund_status": F.when(now, F.when(paid, "PROCESSING").otherwise("NONE")).otherwise(
                prior("refund_status", "string")
            ),
            "payment_status": F.when(now, F.when(paid, "REFUND_PENDING").otherwise("VOID")).otherwise(
                F.col("payment_status")
            ),
            "cancelled_at": F.when(now, as_ts(as_of)).otherwise(prior("cancelled_at", "timestamp")),
        }
    ).drop("_asked", "_now")


def payment_mismatch(bookings: DataFrame, orders: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Payment orders with the amount in minor units and a flag where it strays from the booking total."""
    known = bookings.select(F.col("id").alias("booking_id"), "payment_status", "total_price")
    amount = F.col("amount").cast("double")
    return orders.join(known, "booking_id").withColumns(
        {
            "amount_minor": F.bround(amount * 100, 0).cast("bigint"),
            "is_mismatch": F.abs(F.col("total_price").cast("double") - amount) > tolerance,
            "already_paid": F.coalesce(F.col("payment_status"), F.lit("")) == "PAID",
        }
    )


def apply_coupon(bookings: DataFrame, coupons: DataFrame, as_of, order: str = "created_at") -> DataFrame:
    """Discount per booking, with limits spent in booking order.

    A use counts when the coupon is valid and the booking large enough. A customer's uses are
    numbered first; those within the customer's limit are then numbered per coupon, and the ones
    beyond the remaining total get no discount. Bookings without a customer have no customer's limit to share.
    """
    valid = visible_coupons(coupons, as_of).select(
        F.col("code").alias("coupon_code"), "discount_type", "discount_value", "max_discount", "min_booking_amt",
        "usage_limit", "used_count", "per_user_limit",
    )
    asked = bookings.filter(F.col("coupon_code").isNotNull()).select(
        "id", "coupon_code", F.coalesce(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("b"), F.col("id").cast("string"))).alias("_user"), "total_price",
        order,
    )
    fits = asked.join(valid, "coupon_code").filter(
        F.col("total_price") >= F.coalesce(F.col("min_booking_amt"), F.lit(0))
    )
    by_user = row_index(fits, ["coupon_code", "_user"], [order, "id"], out="user_use")
    within = by_user.filter(F.col("per_user_limit").isNull() | (F.col("user_use") <= F.col("per_user_limit")))
    placed = row_index(within, "coupon_code", [order, "id"], out="coupon_use")
    left = F.col("usage_limit") - F.coalesce(F.col("used_count"), F.lit(0))
    granted = placed.filter(F.col("usage_limit").isNull() | (F.col("coupon_use") <= left))

    money = "decimal(10,2)"
    share = (F.col("total_price") * F.col("discount_value") * F.lit(Decimal("0.01"))).cast("decimal(20,2)")
    percent = F.least(share, F.coalesce(F.col("max_discount").cast("decimal(20,2)"), share))
    amount = F.when(F.col("discount_type") == "PERCENT", percent).otherwise(F.col("discount_value").cast(money))
    discount = F.least(amount, F.col("total_price")).cast(money).alias("_discount")
    got = granted.select("id", discount)
    out = bookings.join(got, "id", "left").withColumn("discount_amount", F.coalesce("_discount", F.lit(Decimal("0.00"))))
    return out.withColumn("payable", (F.col("total_price") - F.col("discount_amount")).cast(money)).drop("_discount")


def welcome_rows(
    profiles: DataFrame, users: DataFrame, brand: str = "Faresight"
) -> tuple[DataFrame, DataFrame]:
    """(profile rows to upsert by auth_user_id, welcome notifications) for newly registered users.

    ``users``: id, email, phone, full_name, name, email_confirmed_at, phone_confirmed_at.
    """
    name = text.display_name("full_name", "name", "email", "id")
    rows = users.select(
        F.col("id").alias("auth_user_id"),
        "email",
        "phone",
        name.alias("full_name"),
        name.alias("display_name"),
        F.col("email_confirmed_at").isNotNull().alias("email_verified"),
        F.col("phone_confirmed_at").isNotNull().alias("phone_verified"),
    )
    known = profiles.select("auth_user_id", F.col("id").alias("_profile"))
    mail = rows.filter(non_blank("email").isNotNull()).join(known, "auth_user_id", "left")
    notifications = mail.select(
        F.coalesce(F.col("_profile"), F.col("auth_user_id")).alias("user_id"),
        F.lit("WELCOME").alias("type"),
        F.lit("EMAIL").alias("channel"),
        F.col("email").alias("recipient"),
        F.lit(f"Welcome to {brand}!").alias("subject"),
        text.welcome_text("full_name").alias("message"),
        F.lit("welcome_email").alias("template_id"),
    )
    return rows, notifications


def assign_booking_refs(new: DataFrame, existing: DataFrame, as_of, key: str = "id", attempts: int = 2) -> DataFrame:
    """Adds a unique ``booking_reference`` to every new booking, in one pass over either table.

    Every booking offers a short reference for each of ``attempts`` salts. A reference that nobody holds goes to the booking
    that offers it with the lowest salt, then the lowest key; a booking takes the first of those it was given. Which ones it
    has no use for is not passed on, so a booking that was given none gets the full digest, which cannot collide in practice.
    """
    offered = F.array(*[F.struct(F.lit(salt).alias("_salt"), text.booking_ref(key, as_of, salt).alias("_ref")) for salt in range(attempts)])
    each = new.select(key, F.struct(*new.columns).alias("_row"), F.inline(offered))
    held = existing.select(F.col("booking_reference").alias("_ref")).distinct().withColumn("_held", F.lit(True))
    met = each.join(held, "_ref", "left")
    turn = F.row_number().over(Window.partitionBy("_ref").orderBy("_salt", key))
    given = F.when(F.col("_held").isNull() & (F.col("_turn") == 1), F.struct("_salt", "_ref"))
    chosen = met.withColumn("_turn", turn).groupBy(key).agg(F.any_value("_row").alias("_row"), F.min(given)["_ref"].alias("_given"))
    last = text.booking_ref(key, as_of, attempts, digits=32)
    return chosen.select("_row.*", F.coalesce("_given", last).alias("booking_reference"))


def latest_challenge(challenges: DataFrame, as_of) -> DataFrame:
    """Newest unused one-time code per (user, purpose), with ``is_valid`` while it can still be tried."""
    unused = challenges.filter(~F.col("is_used"))
    newest = top_k(unused, ["user_id", "purpose"], [F.desc("created_at"), F.desc("id")], 1)
    usable = (F.col("expires_at") >= as_ts(as_of)) & (F.col("attempts") < F.col("max_attempts"))
    return newest.withColumn("is_valid", usable)
