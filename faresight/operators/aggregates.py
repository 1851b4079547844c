"""Grouped summaries. All aggregates combine map-side, so a hot key shuffles one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..columns import names
from .ordered import top_k

ROUTE = ("origin_code", "destination_code")


def market_snapshot(
    fares: DataFrame,
    keys: Sequence[str] = (*ROUTE, "departure_date", "cabin_class"),
    listing: str | Sequence[str] = "airline_code",
    seats: str | None = None,
) -> DataFrame:
    """Low, high and current fare per key, and the fewest ``seats`` if asked for; the primary airline is the one listed first.

    ``listing`` orders the airlines of a key. A lowest text has no fixed width and would make Spark sort all fares, so fares
    are summed up per key and airline first, which hashing does, and the text is resolved among a key's airlines.
    """
    numbers = {"market_low": (F.min, "price"), "market_high": (F.max, "price"), **({seats: (F.min, seats)} if seats else {})}
    by_airline = names(listing) == ["airline_code"]
    first = F.min(F.struct(*names(listing), "airline_code")).getField("airline_code")
    fine = fares.groupBy(*keys, "airline_code") if by_airline else fares.groupBy(*keys, "airline_code", *names(listing))
    parts = fine.agg(*[how(c).alias(f"_{out}") for out, (how, c) in numbers.items()], F.count(F.lit(1)).alias("_fares"))
    whole = parts.groupBy(*keys).agg(
        *[how(f"_{out}").alias(out) for out, (how, _) in numbers.items()],
        (F.min("airline_code") if by_airline else first).alias("airline"),
        F.sum("_fares").alias("fares"),
    )
    columns = ["market_low", "market_high", F.col("market_low").alias("current_price"), "airline", "fares", *([seats] if seats else [])]
    return whole.select(*keys, *columns)


def leading_points(forecast: DataFrame, n: int, keys: str | Sequence[str] = ROUTE, rank: str = "point") -> DataFrame:
    """First n points by day of every series, numbered."""
    return top_k(forecast, keys, ["day"], n, rank=rank)


def forecast_profile(forecast: DataFrame, keys: str | Sequence[str] = ROUTE, near: int = 14, far: int = 30) -> DataFrame:
    """Everything the decision needs from a forecast, in one pass over its leading points.

    Near mean; population deviation, range and count over the far horizon; first and last price.
    """
    k = names(keys)
    price = F.col("price")
    return (
        leading_points(forecast, far, k)
        .groupBy(*k)
        .agg(
            F.avg(F.when(F.col("point") <= near, price)).alias("near_mean"),
            F.stddev_pop("price").alias("stdev"),
            (F.max("price") - F.min("price")).alias("spread"),
            F.count(F.lit(1)).alias("points"),
            F.min_by("price", "day").alias("first_price"),
            F.max_by("price", "day").alias("last_price"),
        )
    )


def forecast_mean(forecast: DataFrame, current: DataFrame, keys: str | Sequence[str] = ROUTE, n: int = 14) -> DataFrame:
    """Mean of the first n points and its percentage distance from the current fare."""
    k = names(keys)
    mean = leading_points(forecast, n, k).groupBy(*k).agg(F.avg("price").alias("forecast_mean"))
    base = F.greatest(F.col("current_price"), F.lit(1.0))
    return current.join(mean, k, "left").withColumn(
        "delta_percent", (F.col("forecast_mean") - F.col("current_price")) / base * 100
    )


def forecast_risk_stats(
    forecast: DataFrame, current: DataFrame, keys: str | Sequence[str] = ROUTE, n: int = 30
) -> DataFrame:
    """Deviation and range of the first n points, relative to the current fare."""
    k = names(keys)
    stats = leading_points(forecast, n, k).groupBy(*k).agg(
        F.stddev_pop("price").alias("_dev"),
        (F.max("price") - F.min("price")).alias("_range"),
        F.count(F.lit(1)).alias("points"),
    )
    base = F.greatest(F.col("current_price"), F.lit(1.0))
    return (
        current.join(stats, k)
        .withColumn("volatility", F.col("_dev") / base)
        .withColumn("spread", F.col("_range") / base)
        .drop("_dev", "_range")
    )


def first_last_change(forecast: DataFrame, keys: str | Sequence[str] = ROUTE) -> DataFrame:
    """Percentage change from the first to the last point; 0 for a single point or a non-positive start."""
    ends = forecast.groupBy(*names(keys)).agg(
        F.min_by("price", "day").alias("first_price"),
        F.max_by("price", "day").alias("last_price"),
        F.count(F.lit(1)).alias("points"),
    )
    return ends.withColumn("change_percent", change_percent())


def change_percent(first: str = "first_price", last: str = "last_price", points: str = "points"):
    usable = (F.coalesce(F.col(points), F.lit(0)) >= 2) & (F.col(first) > 0)
    return F.when(usable, (F.col(last) - F.col(first)) / F.col(first) * 100).otherwise(0.0)


def best_worst_day(forecast: DataFrame, keys: str | Sequence[str] = ROUTE) -> DataFrame:
    """Cheapest and dearest day of every series, the earliest day on ties."""
    low = F.min(F.struct("price", "day"))
    high = F.max(F.struct(F.col("price"), (-F.col("day")).alias("back")))
    return forecast.groupBy(*names(keys)).agg(
        low.getField("day").alias("best_day"),
        low.getField("price").alias("best_price"),
        (-high.getField("back")).alias("worst_day"),
        high.getField("price").alias("worst_price"),
    )


def forecast_extent(forecast: DataFrame, keys: str | Sequence[str] = ROUTE, pad: float = 0.08) -> DataFrame:
    """Value range of price and band together, padded by a share of the range (1 when the range is 0)."""
    ends = forecast.groupBy(*names(keys)).agg(
        F.min(F.least("lower", "price", "upper")).alias("_low"), F.max(F.greatest("lower", "price", "upper")).alias("_high")
    )
    width = F.col("_high") - F.col("_low")
    room = F.when(width == 0, 1.0).otherwise(width) * pad
    return (
        ends.withColumn("axis_low", F.col("_low") - room)
        .withColumn("axis_high", F.col("_high") + room)
        .drop("_low", "_high")
    )


def customer_kpis(bookings: DataFrame, alerts: DataFrame, trip_points: int = 1200) -> DataFrame:
    """Per customer with a booking: bookings, spend, confirmed trips, active alerts, display points."""
    spend = bookings.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("bookings"),
        F.sum("total_price").alias("total_spent"),
        F.count_if(F.col("status") == "CONFIRMED").alias("confirmed"),
    )
    watching = alerts.filter("is_active").groupBy("user_id").agg(F.count(F.lit(1)).alias("_alerts"))
    return (
        spend.join(watching, "user_id", "left")
        .withColumn("active_alerts", F.coalesce("_alerts", F.lit(0)))
        .withColumn("display_points", F.col("confirmed") * trip_points)
        .drop("_alerts")
    )


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(F.coalesce(F.col("triggered_count"), F.lit(0)) > 0).alias("triggered_alerts"),
    )


def trip_counts(trips: DataFrame) -> DataFrame:
    """Needs the ``is_upcoming`` flag of ``merges.split_trips``."""
    return trips.groupBy("user_id").agg(
        F.count_if("is_upcoming").alias("upcoming"),
        F.count_if(~F.col("is_upcoming")).alias("past"),
        F.count(F.lit(1)).alias("total"),
    )


def regression_metrics(
    df: DataFrame, actual: str = "price", predicted: str = "prediction", keys: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, R², MAPE (denominator at least 1), accuracy share and row count in one aggregation."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    miss = y - p
    n = F.count(miss)
    squared = F.sum(miss * miss)
    mape = F.avg(F.abs(miss) / F.greatest(y, F.lit(1.0))) * 100
    # A constant target leaves no variance to explain: 1 when every prediction is exact, else 0.
    spread = F.var_pop(y) * n
    r2 = F.when(spread > 0, 1 - squared / F.nullif(spread, F.lit(0.0))).when(squared == 0, 1.0).otherwise(0.0)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        r2.alias("r2"),
        mape.alias("mape"),
        ((100 - mape) / 100).alias("accuracy"),
        n.alias("samples"),
    )


def loyalty_totals(bookings: DataFrame) -> DataFrame:
    """Points, trips and spend per customer over paid bookings, one point per whole hundred of each booking."""
    paid = bookings.filter((F.col("payment_status") == "PAID") & F.col("user_id").isNotNull())
    points = F.greatest(F.lit(0), F.floor(F.col("total_price") / 100))
    return paid.groupBy("user_id").agg(
        F.sum(points).cast("bigint").alias("points"),
        F.count(F.lit(1)).alias("trips"),
        F.sum("total_price").alias("spent"),
    )


def coupon_usage(bookings: DataFrame, coupons: DataFrame) -> DataFrame:
    """Uses per coupon, its heaviest customer, and whether the limits are reached."""
    per_user = bookings.filter(F.col("coupon_code").isNotNull()).groupBy("coupon_code", "user_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    used = per_user.groupBy(F.col("coupon_code").alias("code")).agg(
        F.sum("n").alias("uses"), F.max("n").alias("most_by_user"), F.count("user_id").alias("users")
    )
    out = coupons.join(used, "code", "left").fillna(0, ["uses", "most_by_user", "users"])
    return out.withColumn("exhausted", F.coalesce(F.col("uses") >= F.col("usage_limit"), F.lit(False))).withColumn(
        "user_limit_passed", F.coalesce(F.col("most_by_user") > F.col("per_user_limit"), F.lit(False))
    )


def ingest_counts(records: DataFrame, keys: Sequence[str] = (*ROUTE, "days_until_dep")) -> DataFrame:
    """Rows per key and, with all keys null and ``is_total`` set, the grand total."""
    return records.rollup(*keys).agg(F.count(F.lit(1)).alias("records"), F.grouping_id().alias("_g")).filter(
        (F.col("_g") == 0) | (F.col("_g") == 2 ** len(keys) - 1)
    ).withColumn("is_total", F.col("_g") > 0).drop("_g")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count; a caller filters a table before passing it."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
