"""Ordered operators that hold when one key owns a large share of all rows.

A plain window sends every row of a key to one task. Here the table is cut into *ranges* of the full (key, order) tuple,
which no repeated day, text or key can unbalance: a hot key simply spans many ranges. Rows are windowed per (key, range);
one summary row per (key, range) is carried forward along the key and joined back. There are at most as many summaries as
keys and ranges together, so the carry is small whatever the rows.

Where all tables that a frame reads have together at most ``PLAIN_BYTES``, which Spark knows without a job, even a key that holds
everything fits the sort of one task; keyed operators then use the plain window, which shuffles once. Work without keys is
always cut, as a plain window over a whole table is one task at any size. Both ways give the same rows.

Nothing is counted or collected beforehand; building a plan starts no job. Both sides of the join back read the same
range exchange, which Spark plans once and reuses. Ranges are sampled, so a second, different cut would give wrong rows:
every row therefore brings a checksum of its group to the join, and a group that the other side saw differently raises an
error instead. Where a session has switched the reuse of exchanges off, or sets ``spark.faresight.storeRanges``, the cut
is stored with a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import col, names
from ..session import ensure_checkpoint_dir

_RANGE, _SUM = "_range", "_sum"
STORE_SETTING = "spark.faresight.storeRanges"
#: Bytes of input up to which a task may sort a key whole. A session overrides it with this setting.
PLAIN_BYTES = 1 << 30
PLAIN_SETTING = "spark.faresight.plainBytes"
#: What Spark says of a table whose size it does not know.
UNKNOWN_BYTES = (1 << 63) - 1


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, which Spark knows without a job; an unknown size counts as large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _plain(df: DataFrame, keys: list[str]) -> bool:
    """Whether a plain window will do, from the sizes of the tables that ``df`` reads."""
    limit = int(df.sparkSession.conf.get(PLAIN_SETTING, str(PLAIN_BYTES)))
    return bool(keys) and limit > 0 and input_bytes(df) <= limit


def _ranges(df: DataFrame, keys: list[str], order: Sequence[str | Column], kept: Sequence[str]) -> DataFrame:
    """``df`` cut into ranges of (keys, order), with the range's number and a checksum of the row's ``kept`` columns."""
    conf = df.sparkSession.conf
    ranged = df.repartitionByRange(int(conf.get("spark.sql.shuffle.partitions")), *keys, *order).select(
        "*", F.spark_partition_id().alias(_RANGE), F.xxhash64(*kept).alias(_SUM)
    )
    if conf.get("spark.sql.exchange.reuse", "true") == "true" and conf.get(STORE_SETTING, "false") != "true":
        return ranged
    ensure_checkpoint_dir(df.sparkSession)
    return ranged.checkpoint()


def _scan(
    df: DataFrame,
    keys: list[str],
    order: Sequence[str | Column],
    local: Callable[[], Mapping[str, Column]],
    summary: Callable[[DataFrame], DataFrame],
    results: Mapping[str, Column],
) -> DataFrame:
    """``df`` with ``results``, which combine the per-range columns of ``local`` with the carried columns of ``summary``.

    ``summary`` gets the ranges and returns keys, range, the checksum ``_seen`` of each group, and what is carried to it.
    """
    # Maps have no hash, so a column of maps is left out of the checksum.
    kept = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    cut = _ranges(df, keys, order, kept)
    rows = cut.select(*df.columns, _RANGE, *[c.alias(n) for n, c in local().items()], F.bit_xor(_SUM).over(Window.partitionBy(*keys, _RANGE)).alias(_SUM))
    on = [*keys, _RANGE]
    side = summary(cut).withColumnsRenamed({k: f"_on_{k}" for k in on})
    # Null keys match each other, as they do in a window.
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on])
    wrong = F.raise_error(F.lit(f"ranges were cut twice; set {STORE_SETTING} to true"))
    sound = F.col("_seen").eqNullSafe(F.col(_SUM))
    return rows.join(side, same, "left").select(*df.columns, *[F.when(sound, c).otherwise(wrong).alias(n) for n, c in results.items()])


def lag_values(df: DataFrame, keys: str | Sequence[str], order: Sequence[str], value: str, lags: Sequence[int]) -> DataFrame:
    """Adds ``{value}_lag_{n}``: the value n rows earlier within the key."""
    k, reach = names(keys), max(lags)
    if _plain(df, k):
        whole = Window.partitionBy(*k).orderBy(*order)
        return df.select("*", *[F.lag(value, n).over(whole).alias(f"{value}_lag_{n}") for n in lags])
    within = Window.partitionBy(*k, _RANGE).orderBy(*order)

    def local() -> dict[str, Column]:
        return {"_pos": F.row_number().over(within)} | {f"_lag_{n}": F.lag(value, n).over(within) for n in lags}

    def summary(cut: DataFrame) -> DataFrame:
        # The last rows of each range, and from them the last rows before it.
        newest = Window.partitionBy(*k, _RANGE).orderBy(*[F.col(c).desc() for c in order])
        spot = F.struct((-F.col("_back")).alias("at"), F.col("_v").alias("v"))
        tails = (
            cut.select(*k, _RANGE, F.col(value).alias("_v"), F.row_number().over(newest).alias("_back"), F.bit_xor(_SUM).over(Window.partitionBy(*k, _RANGE)).alias(_SUM))
            .filter(F.col("_back") <= reach)
            .groupBy(*k, _RANGE)
            .agg(F.sort_array(F.collect_list(spot)).alias("_t"), F.first(_SUM).alias("_seen"))
        )
        along = Window.partitionBy(*k).orderBy(_RANGE)
        none = F.slice(F.col("_t"), 1, 0)
        earlier = F.concat(*[F.coalesce(F.lag("_t", n).over(along), none) for n in range(reach, 0, -1)])
        return tails.select(*k, _RANGE, "_seen", earlier.alias("_c")).select(*k, _RANGE, "_seen", F.col("_c")["v"].alias("_carry"))

    def lagged(n: int) -> Column:
        back = F.least(F.col("_pos") - n - 1, F.lit(-1)).cast("int")
        return F.when(F.col("_pos") > n, F.col(f"_lag_{n}")).otherwise(F.try_element_at("_carry", back))

    return _scan(df, k, order, local, summary, {f"{value}_lag_{n}": lagged(n) for n in lags})


def row_index(df: DataFrame, keys: str | Sequence[str], order: Sequence[str | Column], out: str = "row_index", total: str | None = None) -> DataFrame:
    """Exact 1-based position within the key (no keys: within the table), and optionally the key's row count."""
    k = names(keys)
    if _plain(df, k):
        place = F.row_number().over(Window.partitionBy(*k).orderBy(*order)).cast("bigint").alias(out)
        return df.select("*", place, *([F.count(F.lit(1)).over(Window.partitionBy(*k)).alias(total)] if total else []))

    def summary(cut: DataFrame) -> DataFrame:
        sums = cut.groupBy(*k, _RANGE).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(_SUM).alias("_seen"))
        before = F.sum("_n").over(Window.partitionBy(*k).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
        return sums.select(*k, _RANGE, "_seen", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*k)).alias("_whole"))

    within = F.row_number().over(Window.partitionBy(*k, _RANGE).orderBy(*order))
    results = {out: F.col("_pos") + F.col("_before")} | ({total: F.col("_whole")} if total else {})
    return _scan(df, k, order, lambda: {"_pos": within}, summary, results)


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(df: DataFrame, keys: str | Sequence[str], order: Sequence[str], outputs: Mapping[str, tuple[str, str | Column]]) -> DataFrame:
    """Running aggregates up to and including the row; ``outputs`` maps a name to (sum|count|min|max, column)."""
    k = names(keys)
    if _plain(df, k):
        so_far = Window.partitionBy(*k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[_COMBINE[how][0](col(c)).over(so_far).alias(name) for name, (how, c) in outputs.items()])
    within = Window.partitionBy(*k, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*k).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)

    def summary(cut: DataFrame) -> DataFrame:
        parts = [_COMBINE[how][0](col(c)).alias(f"_p_{name}") for name, (how, c) in outputs.items()]
        carries = [(F.sum if how == "count" else _COMBINE[how][0])(f"_p_{name}").over(along).alias(f"_b_{name}") for name, (how, _) in outputs.items()]
        return cut.groupBy(*k, _RANGE).agg(*parts, F.bit_xor(_SUM).alias("_seen")).select(*k, _RANGE, "_seen", *carries)

    local = {f"_l_{name}": _COMBINE[how][0](col(c)).over(within) for name, (how, c) in outputs.items()}
    results = {name: _COMBINE[how][1](F.col(f"_b_{name}"), F.col(f"_l_{name}")) for name, (how, _) in outputs.items()}
    return _scan(df, k, order, lambda: local, summary, results)


def top_k(
    df: DataFrame, keys: str | Sequence[str], order: Sequence[str | Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows per key. Spark trims each group before the shuffle, so hot keys stay small."""
    out = rank or "_rank"
    w = Window.partitionBy(*names(keys)).orderBy(*order)
    ranked = df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
    return ranked if rank else ranked.drop(out)
