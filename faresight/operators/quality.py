"""Data-quality operators: rule splits, allowed values, defaults, references."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import col, names
from ..functions.text import coalesce_text

Rules = Mapping[str, Column]


def reasons(rules: Rules) -> Column:
    """Names of the rules a row breaks. A rule is the condition to hold; unknown counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def check(df: DataFrame, rules: Rules, out: str = "reject_reasons") -> DataFrame:
    """All rows with the names of the rules they break, in one pass; valid rows have none."""
    return df.withColumn(out, reasons(rules))


def validate(df: DataFrame, rules: Rules, out: str = "reject_reasons") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): together they are the input; rejects keep the names of the broken rules.

    Both parts read the input. A caller that needs them together takes ``check``.
    """
    flagged = check(df, rules, out)
    return flagged.filter(F.size(out) == 0).drop(out), flagged.filter(F.size(out) > 0)


def code_rule(c: str | Column) -> Column:
    return F.length(F.trim(col(c))) == 3


def differ_rule(a: str | Column, b: str | Column) -> Column:
    return F.upper(F.trim(col(a))) != F.upper(F.trim(col(b)))


def date_rule(c: str | Column) -> Column:
    """Missing is allowed, unreadable is not."""
    text = F.nullif(F.trim(col(c).cast("string")), F.lit(""))
    return text.isNull() | F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def positive_rule(c: str | Column) -> Column:
    return col(c) > 0


def present_rule(c: str | Column) -> Column:
    return F.length(F.trim(col(c))) > 0


def range_rule(c: str | Column, low, high) -> Column:
    return col(c).between(low, high)


def filled_rule(c: str | Column) -> Column:
    return F.size(col(c)) > 0


def request_rules() -> dict[str, Column]:
    """Rules of a prediction request."""
    return {
        "origin_code": code_rule("origin"),
        "destination_code": code_rule("destination"),
        "same_place": differ_rule("origin", "destination"),
        "departure_date": date_rule("departure_date"),
    }


def search_rules() -> dict[str, Column]:
    return {
        "same_place": differ_rule("origin", "destination"),
        "adults": range_rule("adults", 1, 9),
        "children": range_rule("children", 0, 9),
        "infants": range_rule("infants", 0, 9),
        "max_results": range_rule("max_results", 1, 50),
    }


def alert_rules() -> dict[str, Column]:
    return {
        "origin_code": code_rule("origin_code"),
        "destination_code": code_rule("destination_code"),
        "same_place": differ_rule("origin_code", "destination_code"),
        "target_price": positive_rule("target_price"),
    }


def booking_rules() -> dict[str, Column]:
    return {"passengers": filled_rule("passengers"), "total_price": positive_rule("total_price")}


def passenger_rules() -> dict[str, Column]:
    return {"first_name": present_rule("first_name"), "last_name": present_rule("last_name")}


def allowed_rules(column: str, allowed: Iterable[str]) -> dict[str, Column]:
    return {column: F.col(column).isin(list(allowed))}


def allowed_values(df: DataFrame, column: str, allowed: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    return validate(df, allowed_rules(column, allowed))


def coalesce_aliases(df: DataFrame, aliases: Mapping[str, Iterable[str]]) -> DataFrame:
    """Fills each target column from the first non-blank of its accepted spellings that the table has."""
    out = df
    for target, spellings in aliases.items():
        found = [s for s in spellings if s in df.columns]
        out = out.withColumn(target, coalesce_text(*found) if found else F.lit(None).cast("string"))
    return out


def fill_defaults(df: DataFrame, defaults: Mapping[str, float | int | str | bool]) -> DataFrame:
    """Adds missing columns and replaces null or non-numeric entries by the column's default."""
    filled = {}
    for name, default in defaults.items():
        if name not in df.columns:
            filled[name] = F.lit(default)
        elif isinstance(default, bool) or isinstance(default, str):
            filled[name] = F.coalesce(F.col(name), F.lit(default))
        else:
            number = F.col(name).cast("string").try_cast("double") if _is_text(df, name) else F.col(name).cast("double")
            filled[name] = F.coalesce(F.nanvl(number, F.lit(None).cast("double")), F.lit(float(default)))
    return df.withColumns(filled)


def _is_text(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() in ("string", "varchar", "char")


def reject_existing(
    new: DataFrame, existing: DataFrame, keys: Iterable[str], id_col: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) new rows; a rejected row names the row already holding its key.

    The holder is an existing row, else the first new row (lowest id) of the same key. Holders are
    aggregated before the join, so a key repeated many times costs one row. A row with a missing
    key part is never a duplicate.
    """
    k = names(keys)
    known = existing.groupBy(*k).agg(F.min(id_col).alias("_known"))
    first = new.groupBy(*k).agg(F.min(id_col).alias("_first"))
    held = new.join(first, k, "left").join(known, k, "left").withColumn(
        "existing_id", F.coalesce("_known", F.nullif("_first", F.col(id_col)))
    )
    plain = held.drop("_known", "_first")
    return (
        plain.filter(F.col("existing_id").isNull()).drop("existing_id"),
        plain.filter(F.col("existing_id").isNotNull()),
    )


def orphans(child: DataFrame, parent: DataFrame, column: str, parent_key: str) -> DataFrame:
    """Child rows whose reference is set but points nowhere."""
    keys = parent.select(F.col(parent_key).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")
