"""MinHash document fingerprints.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle is five of them in a row, a shorter text is one
shingle, a text without words has none. Each of ``PERMUTATIONS`` universal hash functions ``(a x + b) >> 32`` is taken
over all shingles at once in numpy, and the least value of each document kept; a fingerprint shows 16 bits of each.
The likeness of two fingerprints is the share of equal places, an estimate of the Jaccard similarity of the shingles.

Equal texts have equal fingerprints, also across tasks. Texts without words, null ones included, share one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import mix, random_words, shingles, shuffle_partitions, slices, word_hashes
from .ngram_join import similar_classes

PERMUTATIONS = 64
WIDTH = 5
#: Of ``near_duplicates``, which needs more places than a fingerprint shows: 64 bands of 4.
JOINED, BANDS = 256, 64
_BLOCK = 1 << 15


def signatures(texts: Sequence[str | None], permutations: int = PERMUTATIONS, width: int = WIDTH) -> np.ndarray:
    """(text, permutation) -> least 32-bit value; the largest value everywhere for a text without words."""
    words, counts = word_hashes(texts)
    x, sizes = shingles(words, counts, width)
    return _least(x, sizes, permutations)


def _least(x: np.ndarray, sizes: np.ndarray, permutations: int) -> np.ndarray:
    a, b = random_words(permutations, 3) | np.uint64(1), random_words(permutations, 4)
    out = np.full((len(sizes), permutations), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(sizes)
    ends = np.cumsum(sizes)[filled]
    starts = ends - sizes[filled]
    at = 0
    while at < len(filled):
        # Documents in blocks that stay in the cache; a long document is a block of its own.
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK, side="right")))
        part, cuts = x[starts[at] : ends[stop - 1]], starts[at:stop] - starts[at]
        for k in range(permutations):
            out[filled[at:stop], k] = np.minimum.reduceat((part * a[k] + b[k]) >> np.uint64(32), cuts)
        at = stop
    return out


def shown(signature: np.ndarray) -> list[str]:
    """Hexadecimal text of 16 bits a place."""
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Share of equal places, over the 16 bits that a fingerprint shows."""
    return (one.astype(np.uint16) == two.astype(np.uint16)).mean(axis=1) if len(one) else np.empty(0)


def fingerprint(docs: DataFrame, text: str = "text", permutations: int = PERMUTATIONS, name: str = "fingerprint") -> DataFrame:
    """``docs`` with its fingerprint; the column is replaced if it exists."""

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(shown(signatures(texts.where(texts.notna(), None).tolist(), permutations)), dtype=object)

    return docs.withColumn(name, prints(F.col(text)))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Rows (part, ahead, key, text) in sorted partitions in which each row's successor follows it.

    Rows are dealt by ranges of the key whose bounds are keys that occur. The first row of a range is also sent, marked
    ``ahead``, to the range before it, the very first to the last, so no task asks another for its neighbour. Null keys
    come first; rows with one key are ordered by text.
    """
    count = partitions or shuffle_partitions(docs.sparkSession)
    order = F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
    # Text columns of other names are left behind here, so clashing names cannot arise.
    df = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), order.alias("order"))
    edges = df.agg(F.percentile_approx("order", [i / count for i in range(1, count)], 10 * count) if count > 1 else F.array(), F.min("order")).first()
    first = edges[1]
    bounds = np.unique(np.array([b for b in edges[0] or [] if b > first], np.int64))

    @F.pandas_udf("array<int>")
    def targets(order: pd.Series) -> pd.Series:
        at = order.to_numpy()
        own = np.searchsorted(bounds, at, side="right")
        starts = np.isin(at, bounds) | (at == first)
        return pd.Series([[o, o - 1 if o else len(bounds)] if s else [o] for o, s in zip(own.tolist(), starts.tolist())], dtype=object)

    dealt = df.select("*", F.posexplode(targets("order")).alias("ahead", "part"))
    dealt = dealt.select("part", (F.col("ahead") > 0).alias("ahead"), "order", "key", "text")
    return dealt.repartition(count, "part").sortWithinPartitions("part", "ahead", "order", "text").drop("order")


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text, and how alike they are.

    The edited text ends in the first floor(n/4) code points of the next document (all, if it has fewer) instead of its
    own last floor(n/4). One row per input row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The only document of a table is its own next one; an empty table gives an empty result.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for batch in slices(batches):
            parts, ahead, keys, texts = batch["part"].to_numpy(), batch["ahead"].to_numpy(), batch["key"].tolist(), batch["text"].tolist()
            own = signatures(texts, permutations)
            if last is not None:
                parts, ahead = np.append(last[0], parts), np.append(last[1], ahead)
                keys, texts, own = [last[2], *keys], [last[3], *texts], np.concatenate((last[4][None], own))
            pairs = np.flatnonzero((parts[1:] == parts[:-1]) & ~ahead[:-1])
            cut = [len(texts[i]) // 4 for i in pairs]
            edited = [texts[i][: len(texts[i]) - n] + texts[i + 1][:n] for i, n in zip(pairs, cut)]
            changed = signatures(edited, permutations)
            yield pd.DataFrame({
                "key": pd.array([None if keys[i] is None or keys[i] != keys[i] else int(keys[i]) for i in pairs], dtype="Int64"),
                "n_chars": np.array([len(texts[i]) for i in pairs], np.int64),
                "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                "fingerprint": shown(own[pairs]), "edited_fingerprint": shown(changed),
                "near_edited": likeness(own[pairs], changed), "near_next": likeness(own[pairs], own[pairs + 1]),
            })
            last = (parts[-1], ahead[-1], keys[-1], texts[-1], own[-1]) if len(parts) else last

    schema = "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, key, text).mapInPandas(compare, schema).withColumnRenamed("key", key)


def band_hashes(least: np.ndarray, bands: int) -> np.ndarray:
    """(set, band) -> hash of the signature's places in that band."""
    rows = least.shape[1] // bands
    places = least[:, : bands * rows].reshape(len(least), bands, rows).astype(np.uint64)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(least), 1))
    for k in range(rows):
        out = mix(out ^ places[:, :, k])
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", permutations: int = JOINED, bands: int = BANDS, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id): documents that share a signature band are joined and their exact Jaccard verified.

    Two documents of similarity s share one of 64 bands of 4 places with probability 1 - (1 - s**4)**64: at 0.75, about
    3 pairs in 10**11 are missed. ``ngram_join.similar_classes`` misses none.
    """

    def choose(s: np.ndarray) -> np.ndarray:
        return band_hashes(_least(s, np.array([len(s)]), permutations), bands)[0]

    return similar_classes(docs, text, key, percent, WIDTH, choose)
