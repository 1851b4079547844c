"""Token ids in shards, each a wavelet matrix in one compressed file image.

A wavelet matrix keeps one bit-plane per bit of an id. On each plane, ids with a 0 go before ids with a 1, in the order
they had, so that following a position through the planes spells its id, and counting ones up to a position (rank) gives
its place on the next plane. Samples of the rank every ``BLOCK`` bits make access, counting and occurrence lookup short.

File image: ``MAGIC``, a little-endian header (tokens, documents, planes), a table of section lengths, then the sections,
each a zstd frame: document keys, document starts, and per plane its zeros, bits and rank samples. Images are rows of a
table that Spark writes and reads, so they may lie in any store, and a lost executor's images are written again.

Documents are range-partitioned by key and sorted, so shards follow the order of the keys; nothing is counted in one task
but the partition totals.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir
from .bpe import Words
from .common import shuffle_partitions

MAGIC = b"FSWM\x01"
BLOCK = 512
#: Tokens of a shard; a longer document has a shard to itself.
SHARD = 1 << 20
SCHEMA = "part int, seq int, before bigint, n_tokens bigint, image binary"


class WaveletMatrix:
    """Sequence of ids with access, rank (how many of an id come before a position) and select (where its k-th one is)."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        rest = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        planes = []
        for level in range(levels - 1, -1, -1):
            ones = (rest >> level & 1).astype(bool)
            planes.append((len(rest) - int(ones.sum()), np.packbits(ones, bitorder="little"), cls._samples(ones)))
            rest = np.concatenate((rest[~ones], rest[ones]))
        return cls(len(ids), planes)

    @staticmethod
    def _samples(ones: np.ndarray) -> np.ndarray:
        if not len(ones):
            return np.zeros(1, np.uint32)
        sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK), dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)))

    def _ones(self, plane: int, at: int) -> int:
        """Ones before a position of a plane."""
        _, bits, samples = self.planes[plane]
        block = at // BLOCK
        part = np.unpackbits(bits[block * BLOCK // 8 : (at + 7) // 8], bitorder="little")[: at - block * BLOCK]
        return int(samples[block]) + int(part.sum())

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][1][at >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        out = 0
        for p, (zeros, _, _) in enumerate(self.planes):
            bit = self._bit(p, at)
            ones = self._ones(p, at)
            at = zeros + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def rank(self, token: int, end: int, start: int = 0) -> int:
        """Occurrences of an id in [start, end)."""
        return self._range(token, start, end)[1]

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> len(self.planes):
            return 0, 0
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, start), self._ones(p, end)
            start, end = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - p) & 1 else (start - a, end - b)
        return start, max(0, end - start)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        at, found = self._range(token, 0, self.n)
        if not 0 <= k < found:
            raise IndexError(k)
        at += k
        for p in range(len(self.planes) - 1, -1, -1):
            zeros, bits, samples = self.planes[p]
            bit = token >> (len(self.planes) - 1 - p) & 1
            want = at - zeros if bit else at
            before = samples.astype(np.int64) if bit else np.minimum(np.arange(len(samples)) * BLOCK, self.n) - samples
            block = int(np.searchsorted(before, want, side="right")) - 1
            part = np.unpackbits(bits[block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
            at = block * BLOCK + int(np.flatnonzero(part == bit)[want - int(before[block])])
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token, self.n))]

    def ids(self) -> np.ndarray:
        """All ids: the last plane's order is known, and each plane tells where its values came from."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, (zeros, bits, _) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(bits, count=self.n, bitorder="little").view(bool)
            before = np.empty_like(out)
            before[~ones] = out[:zeros]
            before[ones] = out[zeros:] | out.dtype.type(1 << level)
            out = before
        return out


def to_image(keys: list[int | None], counts: np.ndarray, ids: np.ndarray, levels: int) -> bytes:
    matrix = WaveletMatrix.build(ids, levels)
    known = np.array([k is not None for k in keys], bool)
    sections = [
        np.array([k or 0 for k in keys], "<i8").tobytes() + np.packbits(known, bitorder="little").tobytes(),
        np.concatenate(([0], np.cumsum(counts))).astype("<u8").tobytes(),
    ]
    for zeros, bits, samples in matrix.planes:
        sections += [struct.pack("<Q", zeros) + bits.tobytes(), samples.astype("<u4").tobytes()]
    pack = zstandard.ZstdCompressor(level=1).compress
    packed = [pack(s) for s in sections]
    return MAGIC + struct.pack("<QQB", len(ids), len(keys), levels) + struct.pack(f"<{len(packed)}Q", *map(len, packed)) + b"".join(packed)


def from_image(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(keys, document starts with the end, matrix) of a file image."""
    if image[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token shard")
    at = len(MAGIC)
    tokens, docs, levels = struct.unpack_from("<QQB", image, at)
    at += 17
    lengths = struct.unpack_from(f"<{2 + 2 * levels}Q", image, at)
    at += 8 * len(lengths)
    unpack = zstandard.ZstdDecompressor().decompress
    sections = []
    for n in lengths:
        sections.append(unpack(image[at : at + n]))
        at += n
    known = np.unpackbits(np.frombuffer(sections[0], np.uint8, offset=8 * docs), count=docs, bitorder="little")
    keys = [k if there else None for k, there in zip(np.frombuffer(sections[0], "<i8", docs).tolist(), known.tolist())]
    planes = [
        (struct.unpack_from("<Q", bits)[0], np.frombuffer(bits, np.uint8, offset=8), np.frombuffer(samples, "<u4")) for bits, samples in zip(sections[2::2], sections[3::2])
    ]
    return keys, np.frombuffer(sections[1], "<u8").astype(np.int64), WaveletMatrix(tokens, planes)


@lru_cache(2)
def _library(path: str) -> Words:
    """The tokenizers library, asked once for each distinct word of a task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in out], np.int64)
        return np.fromiter((i for x in out for i in x), np.uint32, int(sizes.sum())), sizes

    return Words(encode, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})


def write_shards(docs: DataFrame, tokenizer: str, folder: str, levels: int = 16, key: str = "doc_id", text: str = "text", end: int = 0,
                 shard: int = SHARD, partitions: int | None = None) -> None:
    """Writes the shards of all documents, in ascending key order, to ``folder``; each document ends in the id ``end``.

    ``tokenizer`` names a tokenizers file that every executor can read, ``levels`` the bits of its ids. Null texts are
    empty, null keys come first, rows with one key are ordered by text. An empty table writes no shards. An id that needs more
    bits than ``levels`` ends the job with an error rather than being cut.
    """

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, part, seq, before = _library(tokenizer), TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        rows: list[np.ndarray] = []
        counts: list[int] = []
        size = 0

        def image() -> pd.DataFrame:
            nonlocal keys, rows, counts, size, seq, before
            out = pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_tokens": [size], "image": [to_image(keys, np.array(counts), np.concatenate(rows), levels)]})
            seq, before = seq + 1, before + size
            keys, rows, counts, size = [], [], [], 0
            return out

        for b in batches:
            texts, names = b["text"].tolist(), [None if pd.isna(k) else int(k) for k in b["key"]]
            for at in range(0, len(texts), 256):
                ids, each = words.texts(texts[at : at + 256])
                last = np.cumsum(each)
                ids = np.insert(ids, last, end)
                if len(ids) and int(ids.max()) >> levels:
                    raise ValueError(f"token {int(ids.max())} does not fit {levels} levels; give write_shards more")
                last += np.arange(1, len(last) + 1)
                for k, stop, n in zip(names[at : at + 256], last.tolist(), (each + 1).tolist()):
                    if size and size + n > shard:
                        yield image()
                    keys.append(k)
                    rows.append(ids[stop - n : stop])
                    counts.append(n)
                    size += n
        if keys:
            yield image()

    count = partitions or shuffle_partitions(docs.sparkSession)
    # Only key and text go on, so other columns can not clash.
    df = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows of one key are dealt by their first characters too, which agree with the order of the texts.
    df = df.repartitionByRange(count, "key", F.substring("text", 1, 64)).sortWithinPartitions("key", "text")
    df.mapInPandas(images, SCHEMA).write.option("compression", "uncompressed").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shards of a folder with ``start``, the number of ids before them. Partition totals, one number each, are summed on the driver."""
    shards = spark.read.schema(SCHEMA).parquet(folder)
    totals = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    base = spark.createDataFrame(starts, "part int, base bigint")
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before")).drop("base")


def documents_of(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, decoded from the images."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, image in zip(b["start"].tolist(), b["image"]):
                keys, cuts, matrix = from_image(image)
                data = memoryview(matrix.ids().astype("<u4").tobytes())
                yield pd.DataFrame({
                    "key": pd.array(keys, dtype="Int64"), "start": start + cuts[:-1], "n_tokens": np.diff(cuts),
                    "ids_crc32": np.array([zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.int64),
                })

    out = shards.select("start", "image").mapInPandas(rows, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumnRenamed("key", key)


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n) over all shards, by rank on each image without decoding it. Without shards there are no rows; a token that no
    document holds has 0.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image in b["image"]:
                matrix = from_image(image)[2]
                yield pd.DataFrame({"token": np.array(tokens, np.int64), "n": np.array([matrix.rank(t, matrix.n) for t in tokens], np.int64)})

    return shards.select("image").mapInPandas(rows, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def shard_folder(spark: SparkSession) -> str:
    return work_dir(spark, "shards")
