"""Logical tables derived from the supplied star schema and event tables, whole and unsampled."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import pricing
from ..operators.aggregates import ROUTE
from ..operators.filters import within_price_bounds
from ..operators.ordered import UNKNOWN_BYTES, input_bytes, top_k
from ..session import is_folder, remove, swept, work_dir

# Order that is total on every fare row.
TIES = ["l_orderkey", "l_linenumber", "departure_date", "l_partkey", "l_suppkey"]
ORDER = ["recorded_at", *TIES]
AS_OF = "1998-06-01"
EVENT_AS_OF = "2024-01-20 00:00:00"

#: Bytes of tables from which one share of a stored history is made. A session overrides it with this setting.
SHARE_BYTES = 1 << 30
SHARE_SETTING = "spark.faresight.shareBytes"

_CABIN = {"STANDARD": "PREMIUM_ECONOMY", "LARGE": "BUSINESS", "PROMO": "FIRST"}
_PRIORITY_CABIN = {"1-URGENT": "FIRST", "2-HIGH": "BUSINESS", "3-MEDIUM": "PREMIUM_ECONOMY"}


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code(key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("N"), F.lpad(c.cast("string"), 2, "0"))


def _mapped(c: Column, table: dict[str, str], other: Column) -> Column:
    out = None
    for key, val in table.items():
        out = F.when(c == key, val) if out is None else out.when(c == key, val)
    return out.otherwise(other)


def price_history(spark: SparkSession, sf: str, share: tuple[int, int] | None = None) -> DataFrame:
    """One row per fare. With ``share`` (k, n) only the fares whose order is in the k-th of n shares, counted from 0."""
    line, orders = raw(spark, sf, "lineitem"), raw(spark, sf, "orders")
    if share:
        in_share = lambda key: F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(share[1])) == share[0]
        line, orders = line.filter(in_share("l_orderkey")), orders.filter(in_share("o_orderkey"))
    # Codes are composed on the dimensions, once per dimension row and not once per fare.
    seller = raw(spark, sf, "supplier").select("s_suppkey", code("s_nationkey").alias("origin_code"))
    buyer = raw(spark, sf, "customer").select("c_custkey", code("c_nationkey").alias("destination_code"))
    part = raw(spark, sf, "part").select(
        "p_partkey",
        F.upper("p_brand").alias("airline_code"),
        _mapped(F.col("p_type"), _CABIN, F.col("p_type")).alias("cabin_class"),
    )
    # Customers meet the orders, which are fewer than the fares.
    booked = orders.join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        line.join(booked, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
    )
    left = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return joined.select(
        "origin_code",
        "destination_code",
        "airline_code",
        "cabin_class",
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("departure_date"),
        F.col("o_orderdate").cast("timestamp").alias("recorded_at"),
        F.greatest(left, F.lit(0)).alias("days_until_dep"),
        F.col("l_quantity").cast("int").alias("seats_available"),
        (F.col("l_returnflag") == "R").alias("is_live"),
        (1 - F.col("l_discount") * 10).alias("training_weight"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


@dataclass
class History:
    """The price history as one table, and as parts that hold whole routes; ``stored`` where both are read from a folder."""

    whole: DataFrame
    parts: list[DataFrame]
    stored: bool


@contextmanager
def kept_history(spark: SparkSession, sf: str) -> Iterator[History]:
    """The price history for readers that work through it part by part; its folder goes at the end.

    The joins shuffle every fare several times, so over large tables they run share by share of the orders, and the shuffle
    files of a share go before the next one begins. A share is made from ``SHARE_BYTES`` of tables; up to that, or
    where sizes are unknown, nothing is stored and the history is its only part. Parts are dealt by a hash of the route and are half as large as shares.
    """
    made = price_history(spark, sf)
    size = input_bytes(made)
    n = -(-size // max(1, int(spark.conf.get(SHARE_SETTING, str(SHARE_BYTES)))))
    if n <= 1 or size >= UNKNOWN_BYTES:
        yield History(made, [made], False)
        return
    path = work_dir(spark, "history")
    try:
        for k in range(n):
            dealt = price_history(spark, sf, (k, n)).withColumn("_part", F.pmod(F.xxhash64(*ROUTE), F.lit(2 * n)))
            with swept(spark):
                dealt.write.mode("append").partitionBy("_part").option("compression", "zstd").parquet(path)
        whole = spark.read.schema(made.schema).parquet(path).select(*made.columns)
        folders = [f for f in (f"{path}/_part={k}" for k in range(2 * n)) if is_folder(spark, f)]
        yield History(whole, [spark.read.schema(made.schema).parquet(f) for f in folders] or [whole], True)
    finally:
        remove(spark, path)


def bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    return within_price_bounds(price_history(spark, sf))


def airports(spark: SparkSession, sf: str) -> DataFrame:
    nation = raw(spark, sf, "nation").join(raw(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(
        code("n_nationkey").alias("iata_code"),
        F.col("n_name").alias("city"),
        F.concat(F.col("n_name"), F.lit(" airport")).alias("name"),
        F.col("r_name").alias("country"),
        F.col("r_name").alias("country_code"),
        F.col("r_name").alias("region"),
        F.lit(True).alias("is_active"),
        (F.col("n_regionkey") >= 2).alias("is_international"),
    )


def routes(spark: SparkSession, sf: str, history: DataFrame | None = None) -> DataFrame:
    """Routes of the price history, which a caller that has stored it hands in."""
    history = price_history(spark, sf) if history is None else history
    listed = history.groupBy(*ROUTE, "airline_code").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return listed.groupBy(*ROUTE).agg(
        F.min("low").alias("min_price"),
        F.max("high").alias("max_price"),
        F.sum("n").cast("int").alias("flights_per_day"),
        F.array_sort(F.collect_list("airline_code")).alias("airlines"),
    ).withColumn("is_active", F.lit(True))


def airlines(spark: SparkSession, sf: str) -> DataFrame:
    brand = raw(spark, sf, "part").select("p_brand").distinct()
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return brand.select(
        F.upper("p_brand").alias("airline_code"),
        F.col("p_brand").alias("name"),
        (F.lit(0.88) + F.lit(0.02) * number).alias("factor"),
    )


def bookings(spark: SparkSession, sf: str) -> DataFrame:
    orders = raw(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    user = F.col("o_custkey").cast("string")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("B"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("booking_reference"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("total_price"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        _mapped(status, {"F": "CONFIRMED", "O": "PENDING"}, F.lit("CANCELLED")).alias("status"),
        _mapped(status, {"F": "PAID", "O": "UNPAID"}, F.lit("VOID")).alias("payment_status"),
        _mapped(priority, _PRIORITY_CABIN, F.lit("ECONOMY")).alias("cabin_class"),
        F.when(priority == "5-LOW", "APP").otherwise("WEB").alias("booking_source"),
        F.when(priority != "5-LOW", F.concat(F.lit("c"), user, F.lit("@example.com"))).alias("contact_email"),
        F.when(priority != "4-NOT SPECIFIED", F.concat(F.lit("+91 98"), F.lpad(user, 8, "0"))).alias("contact_phone"),
        F.concat(F.lit("C"), F.lpad((F.col("o_custkey") % 30).cast("string"), 2, "0")).alias("coupon_code"),
    )


def old_bookings(spark: SparkSession, sf: str) -> DataFrame:
    """The previous versions: what is paid now was unpaid, but for urgent orders, which were paid already."""
    was_paid = (F.col("payment_status") == "PAID") & (F.col("cabin_class") == "FIRST")
    return bookings(spark, sf).withColumns(
        {
            "payment_status": F.when(was_paid, "PAID").otherwise("UNPAID"),
            "status": F.when(was_paid, "CONFIRMED").otherwise("PENDING"),
        }
    )


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    mail = F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com"))
    return raw(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("auth_user_id"),
        F.col("c_name").alias("full_name"),
        F.when(segment != "MACHINERY", mail).alias("email"),
        F.concat(F.lit("+91-98"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("phone"),
        segment.isin("BUILDING", "AUTOMOBILE", "MACHINERY").alias("notify_email"),
        segment.isin("BUILDING", "FURNITURE").alias("notify_sms"),
        segment.isin("HOUSEHOLD", "FURNITURE").alias("notify_whatsapp"),
        F.when(segment == "BUILDING", "VEG").alias("meal_preference"),
        F.when(segment == "FURNITURE", "BUSINESS").alias("preferred_cabin"),
        F.lit(0).cast("bigint").alias("loyalty_points"),
        F.lit("BLUE").alias("tier"),
        F.lit(0).cast("bigint").alias("total_bookings"),
        F.lit(Decimal("0.00")).cast("decimal(12,2)").alias("total_spent"),
        F.to_timestamp(F.lit("1995-01-01")).alias("created_at"),
    )


def passengers(spark: SparkSession, sf: str) -> DataFrame:
    named = raw(spark, sf, "lineitem").join(raw(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        F.col("l_orderkey").alias("booking_id"),
        F.col("l_linenumber").alias("ordinal"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_name"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("last_name"),
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    owned = raw(spark, sf, "orders").join(raw(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    return owned.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        code(F.col("o_orderkey") % 25).alias("origin_code"),
        code("c_nationkey").alias("destination_code"),
        day.alias("departure_date"),
        (F.floor("o_totalprice") / 100).cast("decimal(10,2)").alias("target_price"),
        (F.col("o_orderstatus") != "F").alias("is_active"),
        F.date_add(day, 90).cast("timestamp").alias("expires_at"),
        (F.col("o_orderkey") % 3).cast("int").alias("triggered_count"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.floor("o_totalprice") / 125).cast("decimal(10,2)")).alias(
            "last_price"
        ),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        _mapped(F.col("o_orderpriority"), _PRIORITY_CABIN, F.lit("ECONOMY")).alias("cabin_class"),
    )


def _mean_price() -> Column:
    """Mean fare from whole cents: the sum is exact, so it does not depend on the order of rows."""
    return F.sum(F.floor(F.col("price") * 100 + 0.5)).cast("double") / 100 / F.count(F.lit(1))


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Series per route: mean price of each recorded day, the first 30 days, with a 6 percent band."""
    daily = (
        bounded_history(spark, sf)
        .withColumn("date", F.col("recorded_at").cast("date"))
        .groupBy(*ROUTE, "date")
        .agg(_mean_price().alias("price"))
    )
    width = F.greatest(F.lit(120.0), F.col("price") * 0.06)
    return top_k(daily, ROUTE, ["date"], 30, rank="day").withColumns(
        {"lower": F.greatest(F.lit(800.0), F.col("price") - width), "upper": F.col("price") + width}
    )


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Current state per route: mean fare, days to go, seats and demand, varied by the route's size."""
    return (
        bounded_history(spark, sf)
        .groupBy(*ROUTE)
        .agg(
            _mean_price().alias("current_price"),
            F.max("departure_date").alias("departure_date"),
            (F.count(F.lit(1)) % 40).cast("int").alias("days_until_departure"),
            (F.count(F.lit(1)) % 60).cast("int").alias("seats_available"),
        )
        .withColumns(
            {
                "demand_score": pricing.demand_score("days_until_departure", "departure_date", "seats_available"),
                "seasonality_factor": pricing.seasonality("departure_date"),
            }
        )
    )


def offers(spark: SparkSession, sf: str, history: DataFrame | None = None) -> DataFrame:
    """Flat offers: one search per route and departure month; first-class offers carry no flight number. ``history`` as in ``routes``."""
    history = price_history(spark, sf) if history is None else history
    minutes = F.col("seats_available") * 13
    key = [F.col(c).cast("string") for c in TIES]
    flight = F.concat_ws("-", F.col("airline_code"), F.col("l_linenumber").cast("string"))
    return history.select(
        F.concat("origin_code", "destination_code", F.date_format("departure_date", "yyyyMM")).alias("search_id"),
        F.concat_ws("-", *key).alias("offer_id"),
        "origin_code",
        "destination_code",
        "airline_code",
        "cabin_class",
        F.when(F.col("cabin_class") != "FIRST", flight).alias("flight_number"),
        "departure_date",
        F.timestamp_add("HOUR", F.col("l_linenumber") * 3, F.col("departure_date").cast("timestamp")).alias(
            "departure_time"
        ),
        F.col("price").alias("total"),
        F.concat(
            F.lit("PT"), F.floor(minutes / 60).cast("string"), F.lit("H"), (minutes % 60).cast("string"), F.lit("M")
        ).alias("duration"),
        "days_until_dep",
        "seats_available",
    )


def coupons(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    money = "decimal(10,2)"
    return raw(spark, sf, "nation").select(
        F.concat(F.lit("C"), F.lpad(n.cast("string"), 2, "0")).alias("code"),
        F.when(n % 2 == 0, "PERCENT").otherwise("FLAT").alias("discount_type"),
        F.when(n % 2 == 0, 5 + n).otherwise(n * 1000 + 500).cast(money).alias("discount_value"),
        F.when(n % 4 == 0, F.lit(5000)).cast(money).alias("max_discount"),
        (n * 4000).cast(money).alias("min_booking_amt"),
        F.when(n != 24, 100 + n * 20).cast("int").alias("usage_limit"),
        n.cast("int").alias("used_count"),
        F.when(n != 23, 1 + n % 5).cast("int").alias("per_user_limit"),
        F.lit(None).cast("timestamp").alias("valid_from"),
        F.when(n != 22, F.to_timestamp(F.concat(F.lit("1998-06-"), F.lpad((1 + n).cast("string"), 2, "0")))).alias(
            "valid_until"
        ),
        (n != 21).alias("is_active"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Registrations: some known by full name, some by short name, some by e-mail or id only."""
    segment = F.col("c_mktsegment")
    mail = F.concat(F.lower(F.regexp_replace("c_name", "#", "")), F.lit("@example.com"))
    return raw(spark, sf, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(segment != "MACHINERY", mail).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        F.when(segment == "BUILDING", F.col("c_name")).alias("full_name"),
        F.when(segment == "FURNITURE", F.substring("c_name", 1, 8)).alias("name"),
        F.when(F.col("c_acctbal") > 0, F.to_timestamp(F.lit("1998-01-01"))).alias("email_confirmed_at"),
        F.lit(None).cast("timestamp").alias("phone_confirmed_at"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return raw(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def fare_ticks(source: DataFrame) -> DataFrame:
    return source.select(
        "ts",
        "event_id",
        code(F.col("user_id") % 25).alias("origin_code"),
        code(F.col("event_id") % 25).alias("destination_code"),
        (F.lit(800) + F.col("value") * 100).alias("price"),
    )


def payment_bodies(source: DataFrame) -> DataFrame:
    """Webhook bodies: a purchase is a captured payment of the order numbered by the customer."""
    name = F.when(F.col("event_type") == "purchase", "payment.captured").otherwise(
        F.concat(F.lit("payment."), F.col("event_type"))
    )
    entity = F.struct(
        F.col("user_id").cast("string").alias("order_id"), F.concat(F.lit("pay_"), F.col("event_id")).alias("id")
    )
    body = F.struct(name.alias("event"), F.struct(F.struct(entity.alias("entity")).alias("payment")).alias("payload"))
    return source.select("ts", F.to_json(body).alias("body"))


def notification_queue(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.when(F.col("event_type") == "error", "FAILED").otherwise("PENDING").alias("status"),
        (F.col("event_id") % 5).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
        F.col("ts").alias("scheduled_at"),
    )


def outcomes(source: DataFrame) -> DataFrame:
    """Delivery outcomes addressed to the notification numbered by the customer."""
    return source.select(
        "ts",
        F.col("user_id").alias("notification_id"),
        F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 100, "SENT").otherwise("FAILED"))
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("DELAYED")
        .alias("outcome"),
    )


def challenges(source: DataFrame) -> DataFrame:
    return source.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("event_type").alias("purpose"),
        (F.col("value") > 50).alias("is_used"),
        (F.col("event_id") % 7).cast("int").alias("attempts"),
        F.lit(5).alias("max_attempts"),
        (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"),
        F.col("ts").alias("created_at"),
    )


def code_attempts(source: DataFrame) -> DataFrame:
    """Attempts on the code of each customer; codes expire in the middle of the month."""
    return source.select(
        F.col("user_id").alias("challenge_id"),
        "ts",
        F.col("event_id").alias("attempt_id"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 30)).alias("is_match"),
        F.to_timestamp(F.lit("2024-01-15 00:00:00")).alias("expires_at"),
    )
