"""Typed scans, sources and sinks of the logical tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.nested import offer_json, parse_offer
from ..operators.filters import within_price_bounds
from ..schemas import RAW_OFFER, SCHEMAS
from ..session import work_dir


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan with the declared schema; nothing is inferred, so only used columns are read."""
    return spark.read.format(fmt).schema(SCHEMAS[name]).options(**options).load(path)


def fare_history(df: DataFrame, low: float = 800, high: float = 60000, limit: int | None = None) -> DataFrame:
    """Usable fares. The row cap is off by default; with it, the earliest rows are kept."""
    usable = within_price_bounds(df.filter(F.col("price").isNotNull()), low, high)
    return usable if limit is None else usable.orderBy("recorded_at").limit(limit)


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Parallel JDBC scan split on a date, timestamp or number column. Filters and columns push down."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=partition_column, lowerBound=lower, upperBound=upper)
        .option("numPartitions", partitions)
        .options(**options)
        .load()
    )


def append_history(df: DataFrame, path: str, partition_by: Sequence[str] = ("departure_date",)) -> None:
    """Appends observations. The rebalance evens out file sizes: hot dates are split, small ones merged."""
    df.hint("rebalance", *partition_by).write.mode("append").partitionBy(*partition_by).parquet(path)


def rewrite_partitions(
    spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], partition_by: str
) -> None:
    """Applies ``merge(base, changes)`` to a table partitioned by a column of the key, reading and writing touched partitions only.

    Which partitions are touched is a list no longer than the table's partitions. The new versions are written beside the
    table first and then replace their partitions, so a run that stops in between leaves whole rows and can be repeated:
    merges by key give the same table again. Changes of keys that the table lacks may open partitions.
    """
    touched = [r[0] for r in changes.select(partition_by).distinct().collect()]
    if not touched:
        return
    base = spark.read.parquet(path)
    within = F.col(partition_by).isin([v for v in touched if v is not None])
    base = base.filter(within | F.col(partition_by).isNull() if None in touched else within)
    beside = work_dir(spark, "rewrite")
    merge(base, changes).write.partitionBy(partition_by).parquet(beside)
    fresh = spark.read.schema(base.schema).parquet(beside)
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def read_offers(spark: SparkSession, path: str, schema: str = RAW_OFFER) -> DataFrame:
    """One offer JSON per line. Lines that do not parse keep a null ``offer`` and their text."""
    return spark.read.text(path).withColumn("offer", parse_offer("value", schema))


def write_offers(df: DataFrame, path: str, column: str = "offer", mode: str = "append") -> None:
    df.select(offer_json(column).alias("value")).write.mode(mode).text(path)


def row_gates(df: DataFrame, keys: Sequence[str], gates: Mapping[str, int], out: str = "rows") -> DataFrame:
    """Row count per key and, for each named gate, whether it has at least that many: the gate for all keys at once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return counted.withColumns({name: F.col(out) >= n for name, n in gates.items()})


def require_rows(df: DataFrame, n: int) -> bool:
    """Whether at least ``n`` rows exist; reads no more than it needs to tell."""
    return df.limit(n).count() >= n


def latest_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """Output of a streaming job written per batch, or None before its first batch."""
    try:
        return spark.read.parquet(path)
    except Exception as missing:  # the folder appears with the first batch
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise
