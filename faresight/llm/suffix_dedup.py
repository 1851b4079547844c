"""Removal of long repeated byte strings, by earlier and later matches in suffix order.

Two suffixes that share their first ``size`` bytes stand together in suffix order, in one class of that depth. Inside a
class the least position is the previous smaller one of every other: a position has an earlier match of ``size`` bytes
exactly when it is not the first of its class (its longest previous factor reaches ``size``), and any match when its
class has two members. A full suffix array of the corpus would sort every byte of it; only the classes are needed, and
they are found from coarse to fine, so that most positions are settled without being looked at one by one:

0. Every start s belongs to an *anchor*: the least hash of ``GRAM`` bytes inside its own ``size`` bytes. That depends on
   those bytes alone, so equal strings have equal anchors at equal places. Starts of one anchor are one interval.
1. Intervals that are still open are cut into runs of ``RUN`` starts.
2. Runs that are still open are cut into single starts.

Each interval has a *hull*, all bytes its strings cover, and a *core*, the bytes they all share. If the hull occurs
again, so do all its strings; if the core is unique, none does; otherwise the interval is open and cut further. Counts
are partial aggregates, so a passage that a third of all documents share costs a row per task and hull.

Matches never cross documents. Null and empty texts have no bytes; texts shorter than ``size`` lose nothing; rows that
repeat id and text are copies of each other. Long texts are worked on in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import STEP, mix, passing, prefix_hash, random_words, range_hash, slices, stored, trimmed

SIZE = 400
GRAM = 32
RUN = 16

_VALUES, _OTHERS = random_words(256, 11), random_words(256, 12)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "key bigint, print bigint, at bigint, lo bigint, hi bigint, weight bigint, core bigint, hull bigint"


def _slide(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours, from running minima of blocks to either side."""
    n = len(x)
    blocks = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def _pieces(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(joined bytes, rows of (begin in them, begin in the text, text number)); long texts overlap by size - 1 bytes."""
    parts: list[bytes] = []
    rows: list[tuple[int, int, int]] = []
    total = 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - size + 1, 0), STEP):
            part = text[at : at + STEP + size - 1]
            rows.append((total, at, number))
            parts.append(part)
            total += len(part)
            if total >= STEP:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array([*rows, (total, 0, -1)], np.int64)
                parts, rows, total = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array([*rows, (total, 0, -1)], np.int64)


def _anchored(docs: DataFrame, size: int) -> DataFrame:
    """Level 0: an interval of starts [lo, hi] for every anchor ``at`` of every document (key, print, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            key, print_ = b["key"].astype("Int64").array, b["print"].to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            for data, parts in _pieces(texts, size):
                n = len(data)
                sums = prefix_hash(_VALUES[data])
                first = np.arange(n - GRAM + 1)
                gram = range_hash(sums, first, first + GRAM)
                # Hash and place in one number: the least one names the leftmost least hash.
                least = _slide((gram >> np.uint64(32) << np.uint64(32)) | first.astype(np.uint64), size - GRAM + 1)
                anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
                start = np.arange(n - size + 1)
                piece = np.searchsorted(parts[:, 0], start, side="right") - 1
                inside = start + size <= parts[piece + 1, 0]
                start, anchor, piece = start[inside], anchor[inside], piece[inside]
                cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
                lo, hi = start[cut], start[np.append(cut[1:] - 1, len(start) - 1)]
                at, owner = anchor[cut], parts[piece[cut], 2]
                shift = parts[piece[cut], 1] - parts[piece[cut], 0]
                yield pd.DataFrame({
                    "key": key[owner], "print": print_[owner], "at": at + shift, "lo": lo + shift, "hi": hi + shift, "weight": np.ones(len(at), np.int64),
                    "core": gram[at].view(np.int64), "hull": mix(range_hash(sums, lo, hi + size) + (at - lo).astype(np.uint64) * _ODD).view(np.int64),
                })

    return docs.mapInPandas(rows, _ROWS)


def _refined(docs: DataFrame, open_: DataFrame, size: int, run: int) -> DataFrame:
    """The next level: intervals of at most ``run`` starts, aligned to their anchor, of the open intervals."""
    lists = open_.groupBy("key", "print").agg(F.collect_list(F.struct("lo", "hi", "at", "weight")).alias("all"))
    lists = lists.select(F.col("key").alias("k"), F.col("print").alias("p"), *[F.col(f"all.{c}").alias(c) for c in ("lo", "hi", "at", "weight")])
    texts = trimmed(docs, open_, ["key", "print"]).join(lists, F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p"))).drop("k", "p")

    def cut(lo: np.ndarray, hi: np.ndarray, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs (first start, last start, anchor, weight, number of the run counted from the anchor)."""
        one, two = (at - hi) // run, (at - lo) // run
        count = two - one + 1
        k = np.repeat(one, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        lo, hi, at, weight = (np.repeat(x, count) for x in (lo, hi, at, weight))
        return np.maximum(lo, at - run * k - run + 1), np.minimum(hi, at - run * k), at, weight, k

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            keys = b["key"].astype("Int64").array
            out: list[tuple[np.ndarray, ...]] = []
            for number, (text, *cols) in enumerate(zip(b["text"], b["lo"], b["hi"], b["at"], b["weight"])):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                cols = [np.asarray(c, np.int64) for c in cols]
                order = np.argsort(cols[0], kind="stable")
                cols = [c[order] for c in cols]
                begin = 0
                while begin < len(order):
                    # Neighbouring intervals share the sums of one slice of the text.
                    stop = max(begin + 1, int(np.searchsorted(cols[0], cols[0][begin] + STEP)))
                    lo, hi, at, weight, k = cut(*[c[begin:stop] for c in cols])
                    base = int(cols[0][begin])
                    if run == 1:
                        sums, other = (prefix_hash(v[data[base : int(hi.max()) + size]]) for v in (_VALUES, _OTHERS))
                        core, hull = range_hash(sums, lo - base, lo - base + size), range_hash(other, lo - base, lo - base + size)
                    else:
                        base = max(0, base - run)
                        sums = prefix_hash(_VALUES[data[base : int(hi.max()) + size + run]])
                        inner, outer = at - run * k - base, at - run * k - run + 1 + size - base
                        core = mix(range_hash(sums, inner, outer) + k.astype(np.uint64) * _ODD)
                        hull = mix(range_hash(sums, lo - base, hi + size - base) + (at - lo).astype(np.uint64) * _ODD)
                    out.append((np.full(len(lo), number), at, lo, hi, weight, core.view(np.int64), hull.view(np.int64)))
                    begin = stop
            if out:
                number, at, lo, hi, weight, core, hull = (np.concatenate(x) for x in zip(*out))
                for s in range(0, len(number), 200_000):
                    w = slice(s, s + 200_000)
                    yield pd.DataFrame({
                        "key": keys[number[w]], "print": b["print"].to_numpy()[number[w]], "at": at[w], "lo": lo[w], "hi": hi[w], "weight": weight[w], "core": core[w], "hull": hull[w],
                    })

    return texts.mapInPandas(rows, _ROWS)


def _settle(rows: DataFrame, hulls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals whose hull occurs again, with the first interval of their class; open intervals)."""
    cores = hulls.groupBy("core").agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all > 1 and least = 1").select("core")
    again = hulls.filter("n > 1").select("core", "hull", F.col("first.key").alias("first_key"), F.col("first.print").alias("first_print"), F.col("first.lo").alias("first_lo"))
    found = rows.join(again, ["core", "hull"]).select("key", "print", "lo", "hi", "first_key", "first_print", "first_lo")
    # One interval stands for a class that occurs again, with weight 2, since open intervals may share single strings with it.
    return found, hulls.join(cores, "core").select("first.*", F.least("n", F.lit(2)).cast("bigint").alias("weight"))


def _found(texts: DataFrame, size: int, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``wanted`` takes of all repeats. Only that is stored for good: the tables of a level go when it is settled, those of open
    intervals at the end.
    """
    out = []
    with passing(texts.sparkSession) as outer:
        open_ = None
        for run in (0, RUN, 1):
            with passing(texts.sparkSession) as inner:
                rows = inner(_anchored(texts, size) if open_ is None else _refined(texts, open_, size, run), "anchors")
                hulls = inner(rows.groupBy("core", "hull").agg(F.sum("weight").alias("n"), F.min(F.struct("key", "print", "lo", "hi", "at")).alias("first")), "hulls")
                found, left = _settle(rows, hulls)
                out.append(stored(wanted(found), "found"))
                if run != 1:  # Single starts are not cut further.
                    open_ = outer(left, "open")
    return out[0].unionByName(out[1]).unionByName(out[2])


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(key, print, lo, hi, first_key, first_print, first_lo): intervals of starts whose ``size`` bytes start elsewhere too.

    ``print`` is a hash of the text that tells rows of one id apart; ``first_*`` is the earliest place of the same bytes.
    """
    return _found(_texts(docs, text, key), size, lambda found: found)


def _texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(plain).alias("print"), plain.alias("text"))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, keep_first: bool = True) -> DataFrame:
    """(key, n_bytes, starts, ends, kept): removed byte spans of each document, and its remaining bytes.

    With ``keep_first`` every repeated string stays where it occurs first, by (id, position); otherwise all copies go.
    One row per input row.
    """
    earliest = F.col("key").eqNullSafe(F.col("first_key")) & (F.col("print") == F.col("first_print")) & (F.col("lo") == F.col("first_lo"))

    def taken(found: DataFrame) -> DataFrame:
        return (found.filter(~earliest) if keep_first else found).select("key", "print", "lo", "hi")

    found = _found(_texts(docs, text, key), size, taken)
    lists = found.groupBy("key", "print").agg(F.collect_set(F.struct("lo", "hi")).alias("all")).select(F.col("key").alias("k"), F.col("print").alias("p"), F.col("all.lo").alias("lo"), F.col("all.hi").alias("hi"))
    joined = _texts(docs, text, key).join(lists, F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p")), "left").select("key", "text", "lo", "hi")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            starts, ends, kept, sizes = [], [], [], []
            for t, lo, hi in zip(b["text"], b["lo"], b["hi"]):
                data = t.encode("utf-8", "surrogatepass")
                sizes.append(len(data))
                if lo is None or not len(lo):
                    starts.append(np.empty(0, np.int64))
                    ends.append(np.empty(0, np.int64))
                    kept.append(data)
                    continue
                step = np.zeros(len(data) + 2, np.int64)
                np.add.at(step, np.asarray(lo, np.int64) + 1, 1)
                np.add.at(step, np.asarray(hi, np.int64) + size + 1, -1)
                gone = np.cumsum(step)[1:] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone))))
                starts.append(edge[0::2])
                ends.append(edge[1::2])
                kept.append(np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes())
            yield pd.DataFrame({
                "key": b["key"].astype("Int64"), "n_bytes": np.array(sizes, np.int64),
                "starts": pd.Series(starts, dtype=object), "ends": pd.Series(ends, dtype=object), "kept": pd.Series(kept, dtype=object),
            })

    out = joined.mapInPandas(rows, "key bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")
    return out.withColumnRenamed("key", key)
