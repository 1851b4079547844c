"""Cosine similarity join of embeddings in epsilon grid order.

Unit vectors have cosine >= c exactly when they are at most eps = sqrt(2 - 2c) apart, and no nearer on any orthonormal
axes. Vectors of one label are placed on grid cells of side eps on their leading principal axes and range-sorted by
cell; consecutive ones form blocks with a bounding box on those axes. Block pairs whose cells on the first axis are not
neighbours never meet, nor do those whose boxes are more than eps apart. Inside a pair, the two sequences are halved
recursively, distant halves are skipped, and what is left is one matrix product in double precision.

Equal vectors of one label are one class with a weight, formed before anything is compared. Every pair of blocks puts
out one row per linked class: its number of links there and one class it is connected to, so a dense group costs
counts, not pairs. Axes come from second moments over all vectors; they steer the pruning and never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, shuffle_partitions, stored

COSINE = 0.93
AXES = 4
BLOCK = 1024
LEAF = 128
#: Slack for rounding in pruning; the products themselves are compared with the threshold as it is.
_SLACK = 1e-9


def _usable(vector: Column, label: Column) -> Column:
    """Vectors that can link: label and components known, all finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _axes(classes: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """Leading principal axes for each vector length, from sums over all classes; dim * (dim + 1) numbers a length reach the driver."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                v = _unit(part["vector"])
                v = np.c_[v, np.ones(len(v))]
                total[dim] = total.get(dim, 0) + v.T @ v
        for dim, m in total.items():
            yield pd.DataFrame({"dim": np.full(m.size, dim, np.int32), "at": np.arange(m.size, dtype=np.int32), "x": m.ravel()})

    sums = classes.select("dim", "vector").mapInPandas(moments, "dim int, at int, x double").groupBy("dim", "at").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for dim, part in sums.groupby("dim"):
        m = part.sort_values("at")["x"].to_numpy().reshape(dim + 1, dim + 1)
        mean = m[:-1, -1] / m[-1, -1]
        spread = m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean)
        out[int(dim)] = np.linalg.eigh(spread)[1][:, ::-1][:, :axes]
    return out


def _blocks(classes: DataFrame, axes: dict[int, np.ndarray], eps: float, size: int) -> DataFrame:
    """Blocks of at most ``size`` classes, consecutive in epsilon grid order."""
    width = max((a.shape[1] for a in axes.values()), default=1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cells = np.zeros((len(b), width), np.int32)
            for dim, rows in b.groupby("dim").indices.items():
                cells[rows, : axes[dim].shape[1]] = np.floor(_unit(b["vector"].iloc[rows]) @ axes[dim] / eps)
            yield b.assign(cells=pd.Series(list(cells), index=b.index, dtype=object))

    schema = "label string, dim int, node bigint, weight bigint, vector array<double>, cells array<int>"
    placed = classes.select("label", "dim", "node", "weight", "vector").mapInPandas(place, schema)
    ordered = placed.repartitionByRange(shuffle_partitions(classes.sparkSession), "label", "dim", "cells", "node").sortWithinPartitions("label", "dim", "cells", "node")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), part in b.groupby(["label", "dim"], sort=False):
                for at in range(0, len(part), size):
                    rows = part.iloc[at : at + size]
                    unit = _unit(rows["vector"])
                    spot = unit @ axes[dim]
                    yield pd.DataFrame({
                        "block": [int(rows["node"].iloc[0])], "label": [label], "dim": np.array([dim], np.int32), "low": [spot.min(axis=0)], "high": [spot.max(axis=0)],
                        "nodes": [rows["node"].to_numpy(np.int64).tobytes()], "weights": [rows["weight"].to_numpy(np.int64).tobytes()], "units": [unit.tobytes()],
                    })

    return ordered.mapInPandas(pack, "block bigint, label string, dim int, low array<double>, high array<double>, nodes binary, weights binary, units binary")


def _apart(spot_a: np.ndarray, spot_b: np.ndarray, eps: float) -> bool:
    gap = np.maximum(0, np.maximum(spot_a.min(axis=0) - spot_b.max(axis=0), spot_b.min(axis=0) - spot_a.max(axis=0)))
    return float((gap * gap).sum()) > (eps + _SLACK) ** 2


def _meet(a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float, eps: float) -> np.ndarray:
    """Which rows of a and b link, by recursive halving of both sequences."""
    out = np.zeros((len(a), len(b)), bool)
    spot_a, spot_b = a @ axes, b @ axes
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if _apart(spot_a[i:j], spot_b[k:m], eps):
            continue
        if max(j - i, m - k) <= LEAF:
            out[i:j, k:m] = a[i:j] @ b[k:m].T >= cosine
        elif j - i >= m - k:
            todo += [(i, (i + j) // 2, k, m), ((i + j) // 2, j, k, m)]
        else:
            todo += [(i, j, k, (k + m) // 2), (i, j, (k + m) // 2, m)]
    return out


def _links(blocks: DataFrame, axes: dict[int, np.ndarray], cosine: float, eps: float) -> DataFrame:
    """(node, links, near): for every pair of blocks, its linked classes, their links there and a connected class."""
    meta = blocks.select("block", "label", "dim", "low", "high")
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / eps).cast("int")
    left = meta.select(F.col("block").alias("a"), "label", "dim", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    right = meta.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"))
    gap = F.aggregate(
        F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)),
        F.lit(0.0), lambda acc, x: acc + x * x,
    )
    # Either block may be the one whose cells are widened, so pairs are ordered afterwards.
    pairs = left.join(right, ["label", "dim", "cell"]).filter(gap <= (eps + _SLACK) ** 2).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda c: blocks.select(F.col("block").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("nodes", "weights", "units")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b").join(meta.select(F.col("block").alias("a"), "dim"), "a")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                read = lambda x, kind: np.frombuffer(x, kind)
                na, nb = read(r.nodes_a, np.int64), read(r.nodes_b, np.int64)
                wa, wb = read(r.weights_a, np.int64), read(r.weights_b, np.int64)
                hit = _meet(read(r.units_a, np.float64).reshape(len(na), -1), read(r.units_b, np.float64).reshape(len(nb), -1), axes[r.dim], cosine, eps)
                if r.a == r.b:
                    np.fill_diagonal(hit, False)
                # Connected parts of this pair of blocks: the least node spreads until nothing changes.
                far = np.iinfo(np.int64).max
                la, lb = na.copy(), nb.copy()
                while True:
                    low_b = np.minimum(lb, np.where(hit, la[:, None], far).min(axis=0))
                    low_a = np.minimum(la, np.where(hit, low_b[None, :], far).min(axis=1))
                    same = (low_a == la).all() and (low_b == lb).all()
                    la, lb = low_a, low_b
                    if same:
                        break
                count_a, count_b = hit @ wb, wa @ hit
                parts = [(na, count_a, la)] if r.a == r.b else [(na, count_a, la), (nb, count_b, lb)]
                for nodes, count, near in parts:
                    linked = np.flatnonzero(count)
                    if len(linked):
                        yield pd.DataFrame({"node": nodes[linked], "links": count[linked], "near": near[linked]})

    return joined.repartition(shuffle_partitions(blocks.sparkSession)).mapInPandas(match, "node bigint, links bigint, near bigint")


def cosine_components(rows: DataFrame, cosine: float = COSINE, vector: str = "embedding", key: str = "vec_id", label: str = "label", axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for each row; the component is its smallest key, which alone is kept.

    Only vectors of equal, known label and equal length meet. Null or zero vectors and those with null or non-finite
    components link with nothing and stand alone. Rows that repeat an id count as vectors of their own.
    """
    eps = math.sqrt(2 - 2 * cosine)
    plain = rows.select(F.col(key).cast("bigint").alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    usable = _usable(F.col("vector"), F.col("label"))
    groups = plain.filter(usable).groupBy("label", "vector").agg(F.count(F.lit(1)).alias("weight"), F.min("key").alias("least"))
    classes = stored(groups.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("dim"), "vector", "weight", "least"), "classes")
    directions = _axes(classes, axes)
    blocks = stored(_blocks(classes, directions, eps, block), "blocks")
    links = stored(_links(blocks, directions, cosine, eps), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.col("node").alias("a"), F.col("near").alias("b")))
    known = classes.select("node", "label", "vector", "weight", "least").join(counts, "node", "left").join(parts, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("least").alias("smallest"))
    known = known.join(smallest, "component").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "smallest"
    )
    # Rows that cannot link get no partner here.
    mine = plain.select("key", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.col("vector")).alias("vector"))
    out = mine.join(known, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    out = out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("key")).otherwise(F.col("smallest")).alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
