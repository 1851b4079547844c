"""Fare model: features, encoders, boosted trees, prediction and forecasts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import as_date, half_up, round_even
from ..functions import dates
from ..functions.text import hash_bucket_estimate, hash_percent, norm_code
from ..operators.aggregates import ROUTE, regression_metrics
from ..operators.filters import mask_unobserved, within_price_bounds
from ..operators.joins import day_grid
from ..operators.observations import record_fares
from ..operators.ordered import lag_values, row_index
from ..operators.quality import fill_defaults
from ..session import work_dir
from ..sources.tables import fare_history, require_rows

# Model inputs in order, their defaults, and the encoded ones.
FEATURES = [
    "origin_code", "destination_code", "airline_code", "days_until_dep", "urgency", "day_of_week", "month",
    "week_of_year", "hour_of_day", "is_peak_hour", "seats_available", "price_change_1d", "price_change_3d",
    "demand_score", "seasonality_factor", "is_live",
]
DEFAULTS = {
    "day_of_week": 0, "month": 1, "week_of_year": 1, "hour_of_day": 12, "is_peak_hour": 0, "seats_available": 50,
    "price_change_1d": 0, "price_change_3d": 0, "demand_score": 0.5, "seasonality_factor": 1.0,
}
CATEGORIES = ["origin_code", "destination_code", "airline_code"]


def price_changes(
    df: DataFrame,
    order: Sequence[str],
    keys: str | Sequence[str] = ROUTE,
    lags: Sequence[int] = (1, 3),
) -> DataFrame:
    """Adds ``price_change_{n}d``: price minus the price n rows earlier of the same key, 0 at the start."""
    lagged = lag_values(df, keys, order, "price", lags)
    change = {
        f"price_change_{n}d": F.coalesce(F.col("price") - F.col(f"price_lag_{n}"), F.lit(0.0)) for n in lags
    }
    return lagged.withColumns(change).drop(*[f"price_lag_{n}" for n in lags])


def label_index(df: DataFrame, column: str) -> DataFrame:
    """Dictionary of a text column: sorted distinct upper-cased values numbered from 1."""
    return fit_encoders(df, [column]).drop("column")


def fit_encoders(df: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Dictionaries of several columns in one table (column, value, label), made in one pass over ``df``.

    Values are numbered within their column by ranges of (column, value), so no task gathers a dictionary.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.upper(F.col(c).cast("string")).alias("value")) for c in columns]))
    values = df.select(each.alias("_e")).select("_e.column", "_e.value").filter(F.col("value").isNotNull()).distinct()
    return row_index(values, "column", ["value"], out="label").withColumn("label", F.col("label").cast("int"))


def apply_encoders(
    df: DataFrame, encoders: DataFrame, columns: Sequence[str] = CATEGORIES
) -> DataFrame:
    """Replaces text by its label, unseen text by 0. Adaptive execution broadcasts a dictionary that turns out small."""
    out = df
    for c in columns:
        side = encoders.filter(F.col("column") == c).select(F.col("value").alias(f"_{c}"), F.col("label").cast("int").alias("_label"))
        out = (
            out.withColumn(f"_{c}", F.upper(F.col(c).cast("string")))
            .join(side, f"_{c}", "left")
            .withColumn(c, F.coalesce("_label", F.lit(0)))
            .drop(f"_{c}", "_label")
        )
    return out


def sample_weight(df: DataFrame) -> Column:
    """Training weight, at least 0.01; 1 where the table has none."""
    given = F.col("training_weight").cast("double") if "training_weight" in df.columns else F.lit(None).cast("double")
    return F.greatest(F.coalesce(given, F.lit(1.0)), F.lit(0.01))


def fare_features(
    history: DataFrame,
    as_of,
    order: Sequence[str] = ("recorded_at",),
    keys: str | Sequence[str] = ROUTE,
    live_value: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The 16 features, the price and the weight, before category encoding. ``keep`` passes row keys on.

    Calendar, season and demand come from the departure and the time of record where the table does not hold them, so
    that training sees what scoring does. Lag features follow row order within the key; a route with a large share of
    the history is spread over many tasks.
    """
    df = history.withColumn("price", F.col("price").cast("double"))
    df = fare_history(df)
    if "departure_date" in df.columns and "recorded_at" in df.columns:
        df = record_fares(df)
    df = df.withColumns({c: F.coalesce(norm_code(c), F.lit("UNKNOWN")) if c in df.columns else F.lit("UNKNOWN") for c in CATEGORIES})
    days = dates.days_until("departure_date", as_of) if "departure_date" in df.columns else F.lit(7)
    live = F.coalesce(F.col("is_live"), F.lit(False)) if "is_live" in df.columns else F.lit(False)
    df = df.withColumns({"days_until_dep": days, "is_live": live, "weight": sample_weight(df)})
    df = price_changes(df, order, keys)
    df = fill_defaults(df, DEFAULTS)
    df = mask_unobserved(df, "is_live", live_value)
    df = df.withColumns({"urgency": dates.urgency("days_until_dep"), "is_live": F.col("is_live").cast("int")})
    extra = [c for c in keep if c not in FEATURES and c != "price"]
    return within_price_bounds(df, inclusive=False).select(*extra, *FEATURES, "price", "weight")


def is_test(keys: Sequence[str], test_share: int = 20, seed: int = 42) -> Column:
    """Whether a row is kept out of training, by a hash of its key: the same row always falls on the same side."""
    return hash_percent(*keys, seed=seed) < test_share


def split(df: DataFrame, keys: Sequence[str], test_share: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by ``is_test``. Both parts read ``df``, so it should be stored."""
    test = is_test(keys, test_share, seed)
    return df.filter(~test), df.filter(test)


@dataclass
class FareModel:
    trees: GBTRegressionModel
    encoders: DataFrame
    metrics: dict = field(default_factory=dict)

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        self.encoders.write.mode("overwrite").parquet(f"{path}/encoders")
        spark = self.encoders.sparkSession
        spark.createDataFrame([(json.dumps(self.metrics),)], "metrics string").write.mode("overwrite").json(
            f"{path}/metrics"
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> FareModel:
        metrics = spark.read.schema("metrics string").json(f"{path}/metrics").first()
        return FareModel(
            GBTRegressionModel.load(f"{path}/trees"),
            spark.read.schema("column string, value string, label int").parquet(f"{path}/encoders"),
            json.loads(metrics["metrics"]) if metrics else {},
        )


def _vector(df: DataFrame) -> DataFrame:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    return assembler.transform(df)


#: Most rounds and depth of the trees.
ROUNDS, DEPTH = 900, 9
#: Boosting ends with the first round that lowers the loss on the validation rows by less than this share of it.
TOLERANCE = 0.002
#: Per cent of the training rows that only decide when to stop.
VALIDATION = 10


def train_fare_model(
    features: DataFrame,
    row_keys: Sequence[str],
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    rate: float = 0.04,
    min_rows: int = 200,
    seed: int = 42,
    tolerance: float = TOLERANCE,
) -> FareModel | None:
    """Boosted trees on the training share, measured on the rest; None with too few rows.

    Up to ``rounds`` rounds, stopped by the loss on ``VALIDATION`` per cent of the training rows, which are chosen by another
    hash of the row key and build no trees. The rows kept out for the metrics take no part in that. ``features`` are read
    many times, so they should be stored.
    """
    spark = features.sparkSession
    if not require_rows(features, min_rows):
        return None
    encoders = fit_encoders(features)
    path = work_dir(spark, "encoders")
    encoders.write.parquet(path)
    encoders = spark.read.schema(encoders.schema).parquet(path)
    # Labels and hashes are found once; boosting and the metrics pass over plain numbers, in the order and parts of ``features``.
    parts = {"is_test": is_test(row_keys, seed=seed), "validates": hash_percent(*row_keys, seed=seed + 1) < VALIDATION}
    encoded = apply_encoders(features, encoders).withColumns(parts).select(*FEATURES, "price", "weight", *parts).persist(StorageLevel.DISK_ONLY)
    train, test = encoded.filter(~F.col("is_test")), encoded.filter("is_test")
    learner = GBTRegressor(
        labelCol="price",
        weightCol="weight",
        maxIter=rounds,
        stepSize=rate,
        maxDepth=depth,
        maxBins=64,
        subsamplingRate=0.9,
        featureSubsetStrategy="0.9",
        seed=seed,
        validationIndicatorCol="validates",
        validationTol=tolerance,
    )
    trees = learner.fit(_vector(train))
    row = regression_metrics(trees.transform(_vector(test))).first()
    encoded.unpersist()
    return FareModel(trees, encoders, (row.asDict() if row else {}) | {"estimators": trees.getNumTrees})


def held_out_metrics(features: DataFrame, model: FareModel, row_keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Metrics of ``model`` on the rows that ``train_fare_model`` kept out of training with the same keys and seed."""
    _, test = split(apply_encoders(features, model.encoders), row_keys, seed=seed)
    return regression_metrics(model.trees.transform(_vector(test)))


def predict_fares(df: DataFrame, model: FareModel, out: str = "predicted") -> DataFrame:
    """Predicted fare per row; very low scores are lifted, rows without a score get the route estimate."""
    days = F.greatest(F.coalesce(F.col("days_until_dep").cast("double"), F.lit(7.0)), F.lit(0.0))
    ready = df.withColumns(
        {
            "days_until_dep": days,
            "is_live": F.coalesce(F.col("is_live").cast("int"), F.lit(1)) if "is_live" in df.columns else F.lit(1),
            **{f"_text_{c}": F.col(c) for c in CATEGORIES},
        }
    )
    ready = fill_defaults(ready.withColumn("urgency", dates.urgency("days_until_dep")), DEFAULTS)
    scored = model.trees.transform(_vector(apply_encoders(ready, model.encoders)))
    restored = scored.withColumns({c: F.col(f"_text_{c}") for c in CATEGORIES})
    return restored.withColumn(out, guarded_fare("prediction")).drop(
        "features", "prediction", *[f"_text_{c}" for c in CATEGORIES]
    )


def guarded_fare(score: str, origin: str = "origin_code", destination: str = "destination_code") -> Column:
    raw = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    lifted = F.when(raw < 800, raw * 1.15).otherwise(raw)
    return F.coalesce(round_even(lifted, 2), hash_bucket_estimate(origin, destination))


def forecast_grid(snapshots: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Model inputs of every snapshot for each of the coming days.

    Snapshots carry the route, airline, departure_date, seats_available, demand_score and
    seasonality_factor. Rows multiply by ``days`` here, so filter before.
    """
    grid = day_grid(snapshots, days)
    offset = F.col("day") - 1
    target = F.date_add(as_date(as_of), F.col("day"))
    calendar = dates.calendar_features("departure_date")
    seats = F.coalesce(F.col("seats_available").cast("int"), F.lit(50))
    demand = F.coalesce(F.col("demand_score"), F.lit(0.5))
    return grid.withColumns(
        {
            "date": target,
            "days_until_dep": F.greatest(F.datediff("departure_date", target), F.lit(0)),
            "day_of_week": calendar["day_of_week"],
            "month": calendar["month"],
            "week_of_year": calendar["week_of_year"],
            "hour_of_day": F.lit(12),
            "is_peak_hour": F.lit(0),
            "seats_available": F.greatest(seats - F.floor(offset / 2), F.lit(1)).cast("int"),
            "demand_score": F.least(demand + offset * 0.01, F.lit(1.0)),
            "seasonality_factor": F.coalesce(F.col("seasonality_factor"), F.lit(1.0)),
            "price_change_1d": F.lit(0.0),
            "price_change_3d": F.lit(0.0),
            "is_live": F.lit(1),
        }
    )


def forecast_band(price: str = "price") -> dict[str, Column]:
    """Lower and upper bound: 6 percent, at least 120, the lower never under 800."""
    p = F.col(price)
    width = F.greatest(F.lit(120.0), p * 0.06)
    return {
        "lower": round_even(F.greatest(F.lit(800.0), p - width), 2),
        "upper": round_even(p + width, 2),
    }


def forecast_fares(snapshots: DataFrame, model: FareModel, as_of, days: int = 30) -> DataFrame:
    scored = predict_fares(forecast_grid(snapshots, as_of, days), model, out="price")
    return scored.withColumns(forecast_band())


def fallback_forecast(bases: DataFrame, as_of, base: str = "base_price", trend: str = "trend", days: int = 30) -> DataFrame:
    """Deterministic forecast from a base fare (5000 where there is none) and a trend, with a weekly wave."""
    return day_grid(bases, days).withColumns(_fallback_point(F.col("day"), as_of, base, trend))


def _fallback_point(day: Column, as_of, base: str = "base_price", trend: str = "trend") -> dict[str, Column]:
    slope = F.when(F.col(trend) == "RISING", 0.006).when(F.col(trend) == "FALLING", -0.004).otherwise(0.001)
    b = F.coalesce(F.nullif(F.col(base), F.lit(0.0)), F.lit(5000.0))
    step = day - 1
    wave = b * 0.025 * F.sin(2 * F.pi() * (step + 3) / 7)
    fare = F.greatest(F.lit(800.0), b + b * slope * step + wave)
    return {
        "date": F.date_add(as_date(as_of), day),
        "price": half_up(fare).cast("double"),
        "lower": half_up(fare - b * 0.04).cast("double"),
        "upper": half_up(fare + b * 0.04).cast("double"),
    }


def complete_forecast(
    forecast: DataFrame, bases: DataFrame, as_of, keys: str | Sequence[str] = ROUTE, min_points: int = 7
) -> DataFrame:
    """Delivered forecasts with enough points, and the fallback for every other base (keys, base_price, trend)."""
    k = [keys] if isinstance(keys, str) else list(keys)
    point = ["day", "date", "price", "lower", "upper"]
    # A forecast is one short list per route, so each table is read once and a route is decided in its own row.
    listed = forecast.groupBy(*k).agg(F.collect_list(F.struct(F.col("day").cast("int").alias("day"), *point[1:])).alias("_given"))
    listed = listed.filter(F.size("_given") >= min_points)
    both = bases.withColumn("_base", F.lit(True)).join(listed, k, "full")
    made = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda day: F.struct(day.alias("day"), *[c.alias(n) for n, c in _fallback_point(day, as_of).items()]))
    rows = F.when(F.col("_given").isNotNull(), F.col("_given")).when(F.col("_base"), made)
    return both.select(*k, F.inline(rows)).select(*k, *point)


def current_fares(df: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Rows whose current price is the model's, where the model gave one."""
    return df.withColumn("current_price", F.coalesce(predicted, "current_price")).drop(predicted)


def current_fare_table(snapshots: DataFrame, predicted: DataFrame, keys: str | Sequence[str] = ROUTE) -> DataFrame:
    """Snapshots whose current price is the model's, where the model gave one."""
    k = [keys] if isinstance(keys, str) else list(keys)
    return current_fares(snapshots.join(predicted.select(*k, "predicted"), k, "left"))
