"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order fixed by a seed, gets a virtual finish time: the words of its source
up to its end, divided by the source's target. The documents of all sources are then taken in the order of that time
until the budget is used; since targets add up to the budget, that is time one for each source. A source whose target
exceeds its size is passed through again. The document that crosses the end is taken for the words before it.

Cumulative words are summed in two levels, so that a source which holds a third of all rows is spread over many tasks:
the shuffled order is cut into ``BUCKETS`` equal ranges of the order key, each range is summed first, and only the rows
of one (source, range) are ordered together. All columns are native; nothing is sampled and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
ADDED = ("size", "source_size", "target", "taken", "copies", "finish")

_WORD = r"[^\x20\x09-\x0D]+"
#: Words with the white space before them, from which a shortened copy is put together.
_PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words; 0 for a null text. White space is collapsed and counted, which needs no list of the words."""
    c = F.col(text) if isinstance(text, str) else text
    gaps = F.regexp_replace(c, _WORD, "x")
    return F.coalesce(F.length(F.regexp_replace(gaps, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: shares of the budget by weight, none above ``most`` times its source.

    Weights repeat over the sources by code point, a null source last. What a full source leaves goes to the others by
    weight: with sources ordered by size over weight, the full ones come first, and the level of the rest follows.
    One row per source is ordered here. A source without words has the target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    values = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("__w", F.get(values, (F.row_number().over(order) - 1) % len(weights)))
    df = df.withColumn("__limit", (F.col("source_size") * most).cast("double")).withColumn("__ratio", F.col("__limit") / F.col("__w"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("__ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    df = df.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))).alias("__budget"),
        F.coalesce(F.sum("__limit").over(before), F.lit(0.0)).alias("__full"),
        F.sum("__w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("__rest"),
    )
    df = df.withColumn("__level", (F.col("__budget") - F.col("__full")) / F.col("__rest"))
    # The first source in that order that isn't filled sets the level; those before it are full.
    df = df.withColumn("__found", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", F.col("source").isNull(), "source", "__level"))).over(everything)["__level"])
    target = F.when(F.col("__found").isNull(), F.col("__limit")).otherwise(F.least(F.col("__found") * F.col("__w"), F.col("__limit")))
    return df.select("source", "source_size", target.alias("target"))


def _shuffled(docs: DataFrame, text: str, key: str, seed: str, buckets: int) -> DataFrame:
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    df = docs.select("*", word_count(text).alias("__size"), order.alias("__order"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("__tie"))
    return df.withColumn("__bucket", F.floor(F.conv(F.substring("__order", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(2**32)).cast("int"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix", weights: Sequence[float] = WEIGHTS,
        share: float = SHARE, most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` without its text, with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), ``copies``
    (words of each pass that takes any) and ``finish`` (virtual finish time of the first pass).

    Null texts and texts without words have size 0 and are taken for 0 words. Null sources are one source. Rows with one
    key are ordered by their text. An empty table gives an empty result. Columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c != text and (c not in ADDED or c in (source, key))]
    sized = _shuffled(docs.select(*kept, text), text, key, seed, buckets).drop(text)
    return _queue(stored(sized, "mix"), kept, source, key, weights, share, most)


def _queue(df: DataFrame, kept: list[str], source: str, key: str, weights: Sequence[float], share: float, most: int) -> DataFrame:
    parts = df.groupBy(F.col(source).alias("__source"), "__bucket").agg(F.sum("__size").alias("__n"))
    ahead = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(parts.groupBy(F.col("__source").alias("source")).agg(F.sum("__n").alias("source_size")), weights, share, most)
    goals = goals.toDF("__goal", "__source_size", "__target")
    level = parts.withColumn("__ahead", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n").withColumnsRenamed({"__source": "__s", "__bucket": "__b"})
    level = level.join(goals, F.col("__s").eqNullSafe(F.col("__goal"))).drop("__goal")
    inside = Window.partitionBy(source, "__bucket").orderBy("__order", F.col(key), "__tie").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    df = df.join(level, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    start = F.col("__ahead") + F.col("__inside")
    goal = F.floor("__target")
    passes = [F.greatest(F.lit(0), F.least(goal - start - F.col("__source_size") * k, F.col("__size"))).cast("bigint") for k in range(most)]
    copies = F.filter(F.array(*passes), lambda n: n > 0)
    return df.select(
        *kept, F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        sum(passes[1:], passes[0]).alias("taken"), copies.alias("copies"),
        F.when(F.col("__target") > 0, (start + F.col("__size")) / F.col("__target")).alias("finish"),
    )


def mixture(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix", weights: Sequence[float] = WEIGHTS,
            share: float = SHARE, most: int = MOST, buckets: int = BUCKETS, whole: bool = False) -> DataFrame:
    """The mix itself: one row per copy taken, range-sorted by virtual finish time, with the columns of ``docs``.

    A document taken twice is two rows; a copy that is taken in part keeps its leading words. With ``whole`` that copy
    stays whole, so a source exceeds its target by less than one document, and documents without words are taken once.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, names))
    # The queue is made of numbers alone; texts meet it once, where the copies are known.
    rows = stored(docs.toDF(*names).withColumn("__row", F.monotonically_increasing_id()), "mix")
    sized = _shuffled(rows.select("__row", *{named[source], named[key], named[text]}), named[text], named[key], seed, buckets).drop(named[text])
    mixed = _queue(stored(sized, "sizes"), ["__row"], named[source], named[key], weights, share, most)
    copies = F.when(F.col("size") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("copies")) if whole else F.col("copies")
    taken = mixed.withColumn("copies", copies).filter(F.size("copies") > 0).join(rows, "__row").select("*", F.posexplode("copies").alias("__pass", "__words"))
    body = F.col(named[text])
    lead = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(_PIECE), F.lit(0)), F.lit(1), F.col("__words").cast("int")), "")
    shown = body if whole else F.when(F.col("__words") < F.col("size"), lead).otherwise(body)
    finish = F.col("finish") + F.col("__pass") * F.col("source_size") / F.nullif(F.col("target"), F.lit(0.0))
    out = taken.select(*[(shown if c == text else F.col(n)).alias(n) for c, n in named.items()], finish.alias("__finish"))
    return out.repartitionByRange("__finish", named[key]).sortWithinPartitions("__finish", named[key]).select(*[F.col(n).alias(c) for c, n in named.items()])
