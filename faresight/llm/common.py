"""Helpers shared by the operators: stored intermediates, vectorised text hashing and connected components."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import swept, work_dir

#: Bytes of text that one vectorised step works on. Longer texts are cut at white space, so memory stays level.
STEP = 1 << 20
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What one kind of task keeps in its Python worker for later tasks. A worker holds one such thing; another key replaces it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Frees what tasks of another operator left in this worker, which may go on to serve many stages.

    What was freed goes back to the system where the C library can give it back; elsewhere it stays for later tasks.
    """
    if not _held:
        return
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and outlives executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    if _noted is not None:
        _noted.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stored`` whose tables go when the block ends; what outlives the block must be ``stored`` inside it.

    Shuffle files go with each query that is run inside, so disk holds one step's shuffles beside the tables.
    """
    paths: list[str] = []

    def hold(df: DataFrame, name: str) -> DataFrame:
        path = work_dir(spark, name)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        with swept(spark):
            yield hold
    finally:
        for path in paths:
            _delete(spark, path)


#: Folders stored by earlier stages of a pipeline, and those of the stage that runs now.
_earlier: list[str] = []
_noted: list[str] | None = None


@contextmanager
def stage(docs: DataFrame, first: bool = False) -> Iterator[None]:
    """What is stored inside belongs to one stage of a pipeline and goes when the next stage begins.

    By then the result has been written and is read again as ``docs``; a folder that ``docs`` still reads stays one stage more.
    A ``first`` stage follows no other: the result of an earlier pipeline may not be written yet, so its last tables stay.
    """
    global _noted, _earlier
    if first:
        _earlier = []
    read = docs.inputFiles()
    kept = [p for p in _earlier if any(f"/{os.path.basename(p)}/" in f for f in read)]
    for p in _earlier:
        if p not in kept:
            _delete(docs.sparkSession, p)
    _noted = []
    try:
        yield
    finally:
        _earlier, _noted = kept + _noted, None


def slices(batches: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    """Smaller frames from Arrow batches, so that what a step builds from texts stays small."""
    release()
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows].reset_index(drop=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit words for a seed; the same in every process."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(_ODD))


_BYTE_VALUES = random_words(256, 1)
_WORD_VALUES = random_words(64, 2) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * (STEP if n > 2 * PIECE else PIECE))
        forth = np.full(size, _BASE, np.uint64)
        back = np.full(size, _INVERSE, np.uint64)
        forth[0] = back[0] = 1
        have = _powers[0] = (np.multiply.accumulate(forth), np.multiply.accumulate(back))
    return have[0][:n], have[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any range follows (see ``range_hash``)."""
    forth, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * forth[: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hash of each range [start, end) of the hashed values."""
    _, back = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(_ODD))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of all elements of the ranges that begin at ``start`` and have the given lengths."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return np.arange(total, dtype=np.int64) + shift


def byte_steps(data: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(joined bytes, text number of each piece's first byte) in steps of about ``PIECE`` bytes.

    Pieces end in a line feed and long texts are cut after white space, so no word crosses a piece.
    The second array has a row (start, text number) for each piece.
    """
    pieces: list[bytes] = []
    owners: list[tuple[int, int]] = []
    size = 0
    for number, text in enumerate(data):
        at = 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                if cut < at:
                    later = [p for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := text.find(c, end)) >= 0]
                    cut = min(later, default=len(text) - 1)
                end = cut + 1
            piece = text[at:end]
            owners.append((size, number))
            pieces.append(piece)
            size += len(piece) + 1
            at = end
            if size >= PIECE:
                yield np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8), np.array(owners, np.int64)
                pieces, owners, size = [], [], 0
    if pieces:
        yield np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8), np.array(owners, np.int64)


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts (A-Z lower-cased), and the number of words of each text."""
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(data), np.int64)
    for joined, owners in byte_steps(data):
        space = _SPACE[joined]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        hashes.append(range_hash(prefix_hash(_BYTE_VALUES[joined]), start, end))
        piece = np.searchsorted(owners[:, 0], start, side="right") - 1
        counts += np.bincount(owners[piece, 1], minlength=len(data))
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and their number per text.

    A text with fewer words has its whole sequence as one shingle; a text without words has none.
    """
    first = np.cumsum(counts) - counts
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    length = np.repeat(np.minimum(counts, width), sizes)
    at = ragged(first, sizes)
    out = length.astype(np.uint64) * np.uint64(_ODD)
    for k in range(width):
        inside = length > k
        if inside.all():
            out += words[at + k] * _WORD_VALUES[k] if len(at) else np.uint64(0)
        else:
            out[inside] += words[at[inside] + k] * _WORD_VALUES[k]
    return mix(out), sizes


#: Bits of the filter that ``trimmed`` broadcasts, whatever the input: 1 MB.
FILTER_BITS = 1 << 23


def membership(wanted: DataFrame, keys: Sequence[str]) -> Callable[[np.ndarray], np.ndarray]:
    """A test for tasks: which of some ``xxhash64`` values may belong to ``keys`` of ``wanted``.

    A Bloom filter of fixed size: it may let rows through and never loses one. With very many keys it lets everything through.
    """

    def places(h: np.ndarray) -> np.ndarray:
        x = h.view(np.uint64)
        return np.stack((x, x >> np.uint64(32))) & np.uint64(FILTER_BITS - 1)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FILTER_BITS, bool)
        for b in batches:
            seen[places(b["h"].to_numpy()).ravel()] = True
        packed = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(packed)
        yield pd.DataFrame({"at": at, "bits": packed[at]})

    hashed = wanted.select(F.xxhash64(*keys).alias("h"))
    rows = hashed.mapInPandas(words, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    shared = wanted.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def maybe(h: np.ndarray) -> np.ndarray:
        at = places(h)
        return (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).all(axis=0)

    return maybe


def trimmed(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` without most rows whose keys ``wanted`` lacks, so that a join that follows shuffles less; the join still decides."""
    test = membership(wanted, keys)

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(test(h.to_numpy()))

    return df.filter(maybe(F.xxhash64(*keys)))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds. Each round is two joins on a node and is stored; the
    smallest neighbour is a partial aggregate, so a node with very many links costs one row per task.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    seen = None
    while True:
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.toDF("a", "b"))
        links = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    return links.toDF("node", "component").unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
