"""Whitening of embeddings: coordinates on the leading principal components, scaled to unit variance.

Vectors that are null or hold null or non-finite entries are left out, as are vectors shorter than the longest (they lack
entries) and those with an entry beyond 2**33, whose sums would no longer be exact. An entry c becomes the whole number
x = floor(1024 c) + 100000.

1. *Sums.* Per-dimension sums S and the number n of vectors, as whole numbers.
2. *Covariance.* Vectors are centred on the rounded mean before they are multiplied, so the entries of their products stay
   small whole numbers and their sums are exact, whatever the order in which tasks add them. The fraction that rounding
   left is taken off in whole numbers too: V = (n sum(z z') - sum(z) sum(z)') / n^2.
3. *Components*, on the driver and of a size that only the dimension sets: Householder reflections make V tridiagonal,
   Sturm counts bisect its leading eigenvalues, inverse iteration finds their vectors, and those of a cluster of close
   values are made orthogonal to each other in every step.
4. *Projection.* The components are broadcast, and every vector is projected in blocks. ``identity_error`` is measured on the
   stored results, not derived: the largest entry of their covariance less the identity.

Components whose eigenvalue is not above rounding (constant dimensions, a single vector) have no whitened coordinate and
are left out, so there may be fewer rows. Repeated rows and equal or null ids are vectors of their own. An empty table, or
one without a whole vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stored

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
#: Entries beyond this are left out; below it, every sum here fits 38 digits.
MOST = 2.0**33
#: Products of a block are summed as doubles while their sum stays below this, the end of exact whole numbers.
EXACT = 2**53
#: Vectors that are multiplied at once.
ROWS = 4096
#: Eigenvalues closer than this share of the largest are one cluster.
CLUSTER = 1e-3


def _whole(column: pd.Series, dim: int | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """x of each vector without null and non-finite entries, by length, and which rows these are (all, or those of ``dim``)."""
    length = np.array([0 if v is None else len(v) for v in column], np.int64)
    keep = np.zeros(len(column), bool)
    out: dict[int, np.ndarray] = {}
    for k in [dim] if dim is not None else np.unique(length).tolist():
        at = np.flatnonzero(length == k)
        if not k or not len(at):
            continue
        c = np.concatenate([np.asarray(column.iloc[i], np.float64) for i in at.tolist()]).reshape(len(at), k)
        fine = (np.abs(c) <= MOST).all(axis=1)
        keep[at[fine]] = True
        if fine.any():
            out[k] = np.floor(SCALE * c[fine]).astype(np.int64) + SHIFT
    return out, keep


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, S) of the longest vectors."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for k, x in _whole(b["v"])[0].items():
                n, s = total.get(k, (0, np.zeros(k, object)))
                total[k] = (n + len(x), s + (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & ((1 << 20) - 1)).sum(axis=0).astype(object))
        for k, (n, s) in total.items():
            yield pd.DataFrame({"dim": k, "at": np.arange(k), "n": n, "s": [str(v) for v in s]})

    partial = vectors.mapInPandas(rows, "dim int, at int, n bigint, s string")
    longest = partial.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = longest.orderBy(F.desc("dim"), "at").toPandas()
    found = found[found["dim"] == found["dim"].max()]
    return (int(found["n"].iloc[0]), [int(v) for v in found["s"]]) if len(found) else (0, [])


def _products(z: np.ndarray) -> np.ndarray:
    """Exact z' z as Python numbers: by doubles where these are exact, else from 22-bit parts."""
    widest = int(np.abs(z).max(initial=0))
    if widest * widest * len(z) < EXACT:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    parts = [(z >> 44).astype(np.float64), ((z >> 22) & 0x3FFFFF).astype(np.float64), (z & 0x3FFFFF).astype(np.float64)]
    total = np.zeros((z.shape[1], z.shape[1]), object)
    step = EXACT >> 44
    for at in range(0, len(z), step):
        p = [x[at : at + step] for x in parts]
        for i in range(3):
            for j in range(3):
                total = total + (p[i].T @ p[j]).astype(np.int64).astype(object) * (1 << (22 * (4 - i - j)))
    return total


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(V as doubles, each correctly rounded from its exact value; the rounded means)."""
    dim = len(sums)
    mean = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(mean, np.int64)
    at, to = np.triu_indices(dim)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim), object)
        for b in batches:
            x = _whole(b["v"], dim)[0].get(dim, np.empty((0, dim), np.int64))
            for start in range(0, len(x), ROWS):
                total = total + _products(x[start : start + ROWS] - centre)
        yield pd.DataFrame({"at": at, "to": to, "s": [str(v) for v in total[at, to]]})

    partial = vectors.mapInPandas(rows, "at int, to int, s string")
    found = partial.groupBy("at", "to").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).toPandas()
    rest = [s - n * m for s, m in zip(sums, mean)]
    out = np.zeros((dim, dim))
    for i, j, s in zip(found["at"], found["to"], found["s"]):
        out[i, j] = out[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    return out, mean


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, Householder vectors) of a symmetric matrix; vector k acts on rows from k + 1."""
    a = a.copy()
    n = len(a)
    turns = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        scale = np.abs(x).max()
        v = np.zeros_like(x)
        if scale and np.abs(x[1:]).max(initial=0.0):
            v = x / scale
            v[0] += np.copysign(np.sqrt(v @ v), v[0])
            v /= np.sqrt(v @ v)
            # H A H with H = I - 2 v v', as a symmetric update of rank two.
            block = a[k + 1 :, k + 1 :]
            p = 2 * (block @ v)
            w = p - (p @ v) * v
            block -= np.outer(v, w) + np.outer(w, v)
            x -= 2 * (v @ x) * v
            a[k + 1 :, k] = a[k, k + 1 :] = x
        turns.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), turns


def count_below(d: np.ndarray, e: np.ndarray, x: float) -> int:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are below x."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    n, q = 0, 1.0
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] * e[i - 1] / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        n += q < 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bounds are neighbouring doubles."""
    n = len(d)
    reach = np.concatenate((np.abs(e), [0.0])) + np.concatenate(([0.0], np.abs(e)))
    low, high = float((d - reach).min()), float((d + reach).max())
    span = max(abs(low), abs(high))
    low, high = low - 1e-12 * span, high + 1e-12 * span
    out = []
    for i in range(k):
        a, b = low, high
        while True:
            m = 0.5 * (a + b)
            if m <= a or m >= b:
                break
            if count_below(d, e, m) <= n - 1 - i:
                a = m
            else:
                b = m
        out.append(0.5 * (a + b))
    return np.array(out)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """(T - shift I) x = b by elimination with row exchanges; vanishing pivots become ``least``."""
    n = len(d)
    p, q, r = d - shift, np.append(e, 0.0), np.zeros(n)
    low, y = e.copy(), b.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(p[i]):
            p[i], low[i] = low[i], p[i]
            q[i], p[i + 1] = p[i + 1], q[i]
            if i < n - 2:
                r[i], q[i + 1] = q[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(p[i]) < least:
            p[i] = least
        f = low[i] / p[i]
        p[i + 1] -= f * q[i]
        if i < n - 2:
            q[i + 1] -= f * r[i]
        y[i + 1] -= f * y[i]
    if abs(p[-1]) < least:
        p[-1] = least
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        x[i] = (y[i] - (q[i] * x[i + 1] if i < n - 1 else 0.0) - (r[i] * x[i + 2] if i < n - 2 else 0.0)) / p[i]
    return x


def principal(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the k leading components of a symmetric matrix."""
    n = len(a)
    scale = float(np.abs(a).max(initial=0.0))
    if not scale or not k:
        return np.zeros(k), np.eye(n)[:, :k]
    d, e, turns = tridiagonal(a / scale)
    values = leading_values(d, e, k)
    size = float(np.abs(d).max() + 2 * np.abs(e).max(initial=0.0))
    least = np.finfo(float).eps * size
    rng = np.random.default_rng(13)
    vectors = np.zeros((n, k))
    begin, shift = 0, np.inf
    for i in range(k):
        if i and values[i - 1] - values[i] > CLUSTER * size:
            begin = i
        # Shifts of equal values are told apart by a rounding error, so that elimination differs.
        shift = min(values[i], shift - 2 * least) if i > begin else values[i]
        x = rng.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                x -= vectors[:, begin:i] @ (vectors[:, begin:i].T @ x)
            x = _solve(d, e, shift, x / np.sqrt(x @ x), least)
            x /= np.abs(x).max()
        for _ in range(2):
            x -= vectors[:, begin:i] @ (vectors[:, begin:i].T @ x)
        vectors[:, i] = x / np.sqrt(x @ x)
    for j in range(len(turns) - 1, -1, -1):
        v, part = turns[j], vectors[j + 1 :]
        part -= 2 * np.outer(v, v @ part)
    vectors /= np.sqrt((vectors**2).sum(axis=0))
    return values * scale, vectors


@dataclass
class Whitening:
    """A fitted transform: ``n`` vectors with sums ``sums``, rounded means, components as columns, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    mean: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Components of all whole vectors of ``df``; none where no direction varies."""
    vectors = df.select(F.col(vector).alias("v"))
    n, sums = _sums(vectors)
    if not n:
        return Whitening(0, [], [], np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance, mean = _covariance(vectors, n, sums)
    values, axes = principal(covariance, min(components, len(sums)))
    trace = float(np.trace(covariance))
    real = values > 1e-12 * trace
    return Whitening(n, sums, mean, values[real], axes[:, real], trace)


def project(df: DataFrame, model: Whitening, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation decimal(38,0), w array<double>) for each whole vector: n^2 times its squared distance from the mean, and its whitened coordinates."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        dim = len(m.sums)
        centre = np.array(m.mean, np.int64)
        rest = [s - m.n * c for s, c in zip(m.sums, m.mean)]
        spread = sum(r * r for r in rest)
        left = np.array([r / m.n for r in rest])
        axes = m.components / np.sqrt(m.values)
        for b in batches:
            found, keep = _whole(b["v"], dim)
            if not found:
                continue
            z = found[dim] - centre
            w = (z.astype(np.float64) - left) @ axes
            # (n x - S)^2 = (n z - rest)^2, summed in whole numbers; those of any length where 63 bits could be too few.
            widest, most = int(np.abs(z).max(initial=0)), max(map(abs, rest), default=0)
            narrow = dim * widest * max(widest, most) < 1 << 63
            wide, by = (z, np.array(rest, np.int64)) if narrow else (z.astype(object), np.array(rest, object))
            squares, crossed = (wide * wide).sum(axis=1).tolist(), (wide * by).sum(axis=1).tolist()
            deviation = [str(m.n * m.n * s - 2 * m.n * c + spread) for s, c in zip(squares, crossed)]
            yield pd.DataFrame({"key": b["key"].to_numpy()[keep], "deviation": deviation, "w": pd.Series(list(w), dtype=object)})

    # Null ids would turn whole numbers into doubles on their way through pandas; as text they stay what they are.
    read = df.select(F.col(key).cast("string").alias("key"), F.col(vector).alias("v")).filter(F.lit(model.n > 0))
    out = read.mapInPandas(rows, "key string, deviation string, w array<double>").withColumn("key", F.col("key").cast(dict(df.dtypes)[key]))
    return out.select(F.col("key").alias(key), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "w")


def identity_error(projected: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of ``w`` less the identity; Spark's covariance centres as it merges."""
    if not components:
        return None
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    row = projected.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max((abs(v - (i == j)) for v, (i, j) in zip(row, pairs) if v is not None), default=None)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each whole vector and component, numbered from 1."""
    model = fit(df, vector, components)
    k = len(model.values)
    rows = stored(project(df, model, vector, key), "projected")
    worst = identity_error(rows, k)
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if k else F.array().cast("array<double>")
    each = rows.select(F.col(key), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        key, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(worst).cast("double").alias("identity_error"),
    )
