"""Tiny Column helpers shared by every module."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def value(v: Any) -> Column:
    """Literal unless it already is a Column; used for every ``as_of`` argument."""
    return v if isinstance(v, Column) else F.lit(v)


def as_date(v: Any) -> Column:
    return value(v).cast("date")


def as_ts(v: Any) -> Column:
    return value(v).cast("timestamp")


def names(keys: str | Iterable[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def pick(c: Column, table: Mapping[Any, Any], default: Any) -> Column:
    """Value of a small fixed table looked up by ``c``, else ``default``."""
    out = None
    for key, val in table.items():
        out = F.when(c == F.lit(key), F.lit(val)) if out is None else out.when(c == F.lit(key), F.lit(val))
    fallback = value(default)
    return fallback if out is None else out.otherwise(fallback)


def _bound(c: Column, limit: Any) -> Column:
    """The limit where ``c`` is known: ``greatest`` and ``least`` skip nulls, so a bare limit would replace them.

    Only the literal is conditional, which lets Spark compute ``c`` once however often it occurs.
    """
    return F.when(c.isNotNull(), value(limit))


def at_least(c: Column, low: Any) -> Column:
    return F.greatest(c, _bound(c, low))


def at_most(c: Column, high: Any) -> Column:
    return F.least(c, _bound(c, high))


def clip(c: Column, low: Any, high: Any) -> Column:
    return F.greatest(F.least(c, _bound(c, high)), _bound(c, low))


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def non_blank(c: str | Column) -> Column:
    """Trimmed text, with blank treated as missing."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def round_even(c: Column, digits: int) -> Column:
    """Round half to even on the exact binary value, as Python's ``round`` does.

    ``bround`` works on the shortest decimal text, where 1.34875 is a tie although the stored
    number lies beside it. Here the product with 10^digits is split into its rounded value and its
    exact error (a float-sized head and the remainder multiply without loss), and only a true tie
    goes to the even neighbour. Meant for up to four digits.
    """
    if digits == 0:
        return F.bround(c, 0)
    scale = float(10**digits)
    head = c.cast("float").cast("double")
    product = c * scale
    error = (head * scale - product) + (c - head) * scale
    below = F.floor(product)
    side = F.signum((product - below - 0.5) + error)
    return F.bround(below + (side + 1) / 2, 0) / scale
