"""Merges of a base table with changes. Each returns the new table; the caller writes it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import as_date, as_ts, names
from .ordered import top_k


def upsert(
    base: DataFrame,
    new: DataFrame,
    keys: str | Sequence[str],
    update: Iterable[str] | None = None,
    keep_when_null: Iterable[str] = (),
    as_of=None,
) -> DataFrame:
    """Insert or update by key. Keys are unique on both sides, as in any conflict clause.

    ``update`` lists the columns an existing row takes from the new one (default: all of ``new``);
    those in ``keep_when_null`` keep the old value where the new one is null. With ``as_of``, rows
    that were updated get it as ``updated_at``.
    """
    k = names(keys)
    taken = set(update if update is not None else [c for c in new.columns if c not in k])
    keep = set(keep_when_null)
    fresh = new.select(*k, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c not in k], F.lit(True).alias("_new"))
    both = base.withColumn("_old", F.lit(True)).join(fresh, k, "full")

    def merged(c: str) -> Column:
        old = F.col(c)
        if c in k:
            return old
        if c not in new.columns:
            out = old
        else:
            incoming = F.col(f"_n_{c}").cast(base.schema[c].dataType)
            updated = incoming if c in taken else old
            updated = F.coalesce(incoming, old) if c in keep and c in taken else updated
            out = F.when(F.col("_old").isNull(), incoming).when(F.col("_new"), updated).otherwise(old)
        if c == "updated_at" and as_of is not None:
            out = F.when(F.col("_old") & F.col("_new"), as_ts(as_of)).otherwise(out)
        return out.alias(c)

    return both.select(*[merged(c) for c in base.columns])


def insert_missing(base: DataFrame, new: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Adds the new rows whose key the base lacks, one per key, the least by its other columns; existing rows stay as they are."""
    k = names(keys)
    missing = new.select(*base.columns).join(base.select(*k), k, "left_anti")
    rest = [c for c, kind in base.dtypes if c not in k and not kind.startswith(("map", "variant"))]
    missing = top_k(missing, k, rest or k, 1)
    return base.unionByName(missing.select(*base.columns))


def with_reverse_routes(routes: DataFrame) -> DataFrame:
    """Closes a route table under reversal, copying the attributes of the listed direction."""
    back = routes.withColumns(
        {"origin_code": F.col("destination_code"), "destination_code": F.col("origin_code")}
    )
    return insert_missing(routes, back, ["origin_code", "destination_code"])


def patch(
    base: DataFrame, changes: DataFrame, keys: str | Sequence[str], supplied: str | None = None, as_of=None
) -> DataFrame:
    """Updates only supplied fields. ``supplied`` names an array column listing them, so that a
    null can be set on purpose; without it every non-null field counts as supplied."""
    k = names(keys)
    fields = [c for c in changes.columns if c not in k and c != supplied and c in base.columns]
    flags = F.col(supplied) if supplied else F.lit(None)
    fresh = changes.select(
        *k, *[F.col(c).alias(f"_n_{c}") for c in fields], flags.alias("_fields"), F.lit(True).alias("_hit")
    )
    both = base.join(fresh, k, "left")

    def patched(c: str) -> Column:
        if c in fields:
            given = F.array_contains("_fields", c) if supplied else F.col(f"_n_{c}").isNotNull()
            return F.when(given, F.col(f"_n_{c}").cast(base.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c == "updated_at" and as_of is not None:
            return F.when(F.col("_hit"), as_ts(as_of)).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return both.select(*[patched(c) for c in base.columns])


def soft_delete(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    gone = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return (
        df.join(gone, key, "left")
        .withColumn("is_active", F.when(F.col("_gone"), False).otherwise(F.col("is_active")))
        .drop("_gone")
        .select(*df.columns)
    )


def union_horizons(df: DataFrame, as_of, past: int, future: int, step: int = 1) -> DataFrame:
    """One row per input row and date, from ``past`` days back up to yesterday and from tomorrow on."""
    today = as_date(as_of)
    every = F.make_dt_interval(F.lit(step))
    back = F.sequence(F.date_sub(today, past), F.date_sub(today, 1), every)
    ahead = F.sequence(F.date_add(today, 1), F.date_add(today, future), every)
    return df.withColumn("date", F.explode(F.concat(back, ahead)))


def split_trips(trips: DataFrame, as_of, departure: str = "departure_time") -> DataFrame:
    """Flags trips leaving after ``as_of``; a missing or unreadable departure counts as past."""
    leaves = F.col(departure).try_cast("timestamp")
    return trips.withColumn("is_upcoming", F.coalesce(leaves > as_ts(as_of), F.lit(False)))


def touch_updated(df: DataFrame, changed: str | Column, as_of) -> DataFrame:
    flag = F.col(changed) if isinstance(changed, str) else changed
    return df.withColumn("updated_at", F.when(flag, as_ts(as_of)).otherwise(F.col("updated_at")))
