"""Merkle manifest of a table: one tree a source, one tree over the sources, and a proof for every row.

H is the lowercase hex sha256 of its inputs one after another; digests enter as hex text. A leaf is H of the row's fields,
each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. In a source, leaves ascend by key; while several nodes
remain, each run of ``arity`` consecutive ones (the last run may be shorter, even one) becomes their H. What remains is the
source's root; these, ordered by source, make the root in the same way.

1. *Places.* Leaves are range-sorted by (source, key, leaf) and stored; a place is the row's number in its range plus the
   rows of its source in earlier ranges, so a source that holds a third of all rows is numbered by many tasks.
2. *Up.* Every level equijoins its nodes with the computed places of their siblings (XOR 1 for pairs, slot offsets inside
   the run otherwise), and the rows of slot zero emit the parents. Levels shrink by ``arity`` and are stored.
3. *Down.* From the tops, every level joins its parents' paths and puts its own siblings in front. A proof is folded from
   a leaf and these siblings alone.

Only the root, the length of the longest source and the number of sources reach the driver. Null sources are one source,
which comes first; null keys come first in their source; rows that repeat a key ascend by leaf, and equal rows are leaves
of their own. A null field is ``-``, an empty text ``0:``. An empty table has no root and no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H of the fields, each with its length, so that no two rows run together."""

    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` (place in its group), ``n`` (rows of the group) and ``g`` (place of the group among groups), all from 0.

    No task sees a whole group: a range of the sorted table counts its own rows, and sums over ranges shift them.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.withColumn("row", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("row", 33))
    parts = ranged.groupBy("part", group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("many"))
    whole = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("many").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("*", ahead.alias("ahead"), F.sum("many").over(whole).alias("n"), F.min("part").over(whole).alias("begin"))
    # Groups are numbered in the range where they begin; a row a range is summed up over ranges.
    begun = parts.filter("part = begin").select("part", group, (F.row_number().over(Window.partitionBy("part").orderBy(F.col(group).asc_nulls_first())) - 1).alias("rank"))
    before = begun.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = before.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    named = begun.join(before, "part").select(F.col("part").alias("begin"), F.col(group).alias("__group"), (F.col("before") + F.col("rank")).alias("g"))
    parts = parts.join(named.withColumnRenamed("begin", "__begin"), (F.col("begin") == F.col("__begin")) & F.col(group).eqNullSafe(F.col("__group")))
    parts = stored(parts.select(F.col("part").alias("__part"), "__group", "first", "ahead", "n", "g"), "parts")
    same = (F.col("part") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group"))
    return ranged.join(parts, same).select(*rows.columns, "g", (F.col("row") - F.col("first") + F.col("ahead")).alias("pos"), "n")


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (g, pos, n, hash, ...) with the digests of their siblings: those to the ``left`` and to the ``right``, joined."""
    out, left, right = nodes, [], []
    for offset in range(1, arity):
        if arity == 2:
            place, wrapped = F.col("pos").bitwiseXOR(F.lit(1)), F.col("pos") % 2 == 1
        else:
            place = F.col("pos") - F.col("pos") % arity + (F.col("pos") + offset) % arity
            wrapped = F.col("pos") % arity + offset >= arity
        other = nodes.select(F.col("g"), F.col("pos").alias("__at"), F.col("hash").alias(f"__{offset}"))
        out = out.withColumn("__at", place).join(other, ["g", "__at"], "left").drop("__at")
        digest = F.coalesce(F.unhex(f"__{offset}"), F.lit(b""))
        left.append(F.when(wrapped, digest).otherwise(F.lit(b"")))
        right.append(F.when(wrapped, F.lit(b"")).otherwise(digest))
    return out.select(*nodes.columns, F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """Nodes of the next level, from the first node of every run."""
    first = level.filter((F.col("n") > 1) & (F.col("pos") % arity == 0))
    return first.select(
        "g", F.expr(f"pos div {arity}").alias("pos"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), F.sha2(F.concat("hash", _text(F.col("right"))), 256).alias("hash")
    )


def _levels(nodes: DataFrame, longest: int, arity: int) -> list[DataFrame]:
    """All levels of the trees of the groups, stored; those with one node are tops."""
    levels = [stored(_siblings(nodes, arity), "level")]
    while longest > 1:
        longest = -(-longest // arity)
        levels.append(stored(_siblings(_parents(levels[-1], arity), arity), "level"))
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Rows of the first level with the siblings from there to the root and what ``tops`` (level, g, path, ...) carries."""
    carried = [c for c in tops.columns if c not in ("level", "g", "path")]
    below = None
    for k in range(len(levels) - 1, -1, -1):
        level, heads = levels[k], tops.filter(F.col("level") == k).drop("level")
        extra = [c for c in level.columns if c not in ("g", "pos", "n", "hash", "left", "right")] + ["hash"] if k == 0 else []
        # A source whose tree ends here; its only node has place 0.
        found = level.filter("n = 1").join(heads, "g").select("g", "pos", *extra, "path", *carried) if k == 0 else heads.select("g", F.lit(0).cast("bigint").alias("pos"), "path", *carried)
        if below is not None:
            here = level.filter("n > 1").withColumn("__up", F.expr(f"pos div {arity}"))
            above = below.withColumnRenamed("pos", "__up")
            path = F.concat(F.array(F.struct("left", "right")), F.col("path")).alias("path")
            found = here.join(above, ["g", "__up"]).select("g", "pos", *extra, path, *carried).unionByName(found)
        below = found
    return below


@dataclass
class Manifest:
    """Stored levels of the sources' trees and of the tree over them. The first level keeps the leaves' own columns."""

    levels: list[DataFrame]
    over: list[DataFrame]
    root: str | None
    arity: int

    def proofs(self) -> DataFrame:
        """Every leaf (``hash``) with its own columns, ``subroot`` and ``path``: (left, right) digests of siblings from there to the root."""
        empty = F.array().cast("array<struct<left:binary,right:binary>>")
        top = len(self.over) - 1
        roots = self.over[-1].filter("n = 1").select(F.lit(top).alias("level"), "g", empty.alias("path"))
        over = _paths(self.over, roots, self.arity).select(F.col("pos").alias("g"), F.col("hash").alias("subroot"), "path", F.col("at").alias("level"))
        return _paths(self.levels, stored(over, "tops"), self.arity).drop("g", "pos")


def manifest(rows: DataFrame, group: str, order: Sequence[str], hash: str = "hash", arity: int = ARITY) -> Manifest:
    """Trees over ``rows``, which hold a leaf digest each, by ``group`` in ascending ``order``."""
    leaves = numbered(rows.withColumnRenamed(hash, "hash"), group, [*order, "hash"])
    longest, sources = leaves.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.max("g") + 1, F.lit(0))).first()
    levels = _levels(leaves, longest, arity)
    tops = None
    for k, level in enumerate(levels):
        part = level.filter("n = 1").select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("pos"), F.lit(sources).cast("bigint").alias("n"), "hash", F.lit(k).alias("at"))
        tops = part if tops is None else tops.unionByName(part)
    over = _levels(tops, sources, arity)
    root = over[-1].filter("n = 1").select("hash").first()
    return Manifest(levels, over, root[0] if root else None, arity)


def proof_hash(path: str = "path") -> Column:
    """H of all siblings of a path in its order."""
    joined = F.array_join(F.transform(path, lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), "")
    return F.sha2(F.lower(joined), 256)


def folded(leaf: str | Column, path: str = "path") -> Column:
    """The root that a leaf digest and its siblings give."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(_text(s["left"]), h, _text(s["right"])), 256))


def verify(docs: DataFrame, tampered: Column, group: str = "source", key: str = "doc_id", text: str = "text", fields: Sequence[str] = FIELDS, arity: int = ARITY) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest of ``docs``, checked against a changed copy.

    ``tampered`` is the text as it is found later. Each row's leaf is computed anew with it and folded with the siblings of
    the manifest; rows whose result is the root are verified.
    """
    plain = [F.col(c) for c in fields]
    later = F.when(tampered.eqNullSafe(F.col(text)), F.lit(None)).otherwise(leaf_hash([tampered if c == text else F.col(c) for c in fields]))
    rows = docs.select(F.col(key).alias("key"), F.col(group).alias("source"), leaf_hash(plain).alias("hash"), later.alias("later"))
    tree = manifest(stored(rows, "leaves"), "source", ["key"], arity=arity)
    found = tree.proofs().withColumn("root", F.lit(tree.root).cast("string"))
    found = found.withColumns({"proof_sha256": proof_hash(), "folded_root": folded(F.coalesce("later", "hash"))})
    return found.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
