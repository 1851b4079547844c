"""Lines that many documents share, dropped everywhere but in one document, as compressed keep bitmaps.

A text is split at line feeds (null or empty: one empty line). A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its
ends and with A-Z lower-cased. Keys of at least ``least`` code points found in at least ``documents`` documents lose all
their lines but those of the largest id that holds them.

1. Lines of long enough keys become rows of numbers: a 128-bit hash, the document, the line's place. They are stored.
2. They are range-partitioned by hash with a secondary sort by document, largest first, and place. The whole tuple and a
   number that tells repeated rows apart bound the ranges, so a very common line is dealt to many tasks.
3. One pass streams every range: the first document of a hash keeps its lines, lines of later ones go once enough
   documents were seen. Only a range's first and last hash can go on elsewhere; their rows stay open until the counts of
   the ranges, at most two rows each, are added up.
4. Dropped places are gathered per document and packed as a bitmap of the lines that stay.

Texts meet bitmaps by id and a 128-bit text hash. Rows that share an id are one document; equal ones lose the same lines,
and an id with different texts keeps or loses a key in all of them. Rows without id are one document, the smallest. Empty
tables give empty results. Two keys are taken as equal by their hash (BLAKE2b, 128 bits).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StringType

from .common import slices, stored

LEAST = 40
DOCUMENTS = 5
#: Texts whose lines become rows at once, and lines of one frame.
TEXTS = 256
LINES = 1 << 16

_SPACE = b" \t\n\x0b\x0c\r"
_LINE = "h1 bigint, h2 bigint, keyed int, doc bigint, t1 bigint, t2 bigint, pos int, n_lines int, copy bigint"
_STREAM = "kind int, part int, h1 bigint, h2 bigint, keyed int, doc bigint, t1 bigint, t2 bigint, pos int, n_lines int, docs bigint, last_keyed int, last_doc bigint"
#: Kinds of rows that a range gives: lines that go, lines of a hash that may go on in another range, counts of such a hash.
_GONE, _OPEN, _COUNT = 0, 1, 2


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    if len(key) < least:
        return False
    return len(key) >= 4 * least or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least


def _identity(text: str, key: str) -> list[Column]:
    """What tells rows apart: whether there is an id, the id, and two hashes of the text."""
    body, whole = F.coalesce(F.col(text), F.lit("")), F.col(key).cast("bigint")
    return [whole.isNotNull().cast("int").alias("keyed"), F.coalesce(whole, F.lit(0)).alias("doc"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("second"), body).alias("t2")]


def _lines(docs: DataFrame, text: str, key: str, least: int) -> DataFrame:
    """A row for each line whose key has at least ``least`` code points."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        copy = TaskContext.get().partitionId() << 33
        for b in slices(batches, TEXTS):
            owner, place, many, hashes = [], [], [], []

            def frame() -> pd.DataFrame:
                at = np.array(owner, np.int64)
                halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                of = {c: b[c].to_numpy()[at] for c in ("keyed", "doc", "t1", "t2")}
                return pd.DataFrame({"h1": halves[:, 0], "h2": halves[:, 1], **of, "pos": np.array(place, np.int32), "n_lines": np.array(many, np.int32), "copy": copy + at})

            for i, t in enumerate(b["text"]):
                lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                for p, line in enumerate(lines):
                    if len(line) >= least and _long_enough(k := line_key(line), least):
                        owner.append(i)
                        place.append(p)
                        many.append(len(lines))
                        hashes.append(blake2b(k, digest_size=16).digest())
                if len(owner) >= LINES:
                    yield frame()
                    owner, place, many, hashes = [], [], [], []
            if owner:
                yield frame()
            copy += len(b)

    return docs.select(*_identity(text, key), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(rows, _LINE)


def _first_occurrences(documents: int):
    """The stream over one sorted range; see the module's third step. What it holds is a batch and fewer than ``documents`` documents."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        columns = _LINE.replace(" bigint", "").replace(" int", "").split(", ")[:-1]
        held = None  # rows of the last hash so far, while it has few documents and is not the range's first
        first = None  # the range's first hash
        run = None  # of the last hash so far: hash, documents, first and last document
        previous = None  # the last row, to tell repeated rows

        def out(kind: int, rows: dict[str, np.ndarray], mask: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"kind": kind, "part": part, **{c: x[mask] for c, x in rows.items()}, "docs": 0, "last_keyed": 0, "last_doc": 0})

        def count() -> pd.DataFrame:
            (h1, h2), docs, (keyed, doc), (last_keyed, last_doc) = run
            return pd.DataFrame([(_COUNT, part, h1, h2, keyed, doc, 0, 0, 0, 0, docs, last_keyed, last_doc)], columns=[c.split()[0] for c in _STREAM.split(", ")])

        for b in batches:
            new = {c: b[c].to_numpy() for c in columns}
            if not len(b):
                continue
            # Repeated rows have the same line at the same place; one of them decides.
            same = np.ones(len(b), bool)
            for x in new.values():
                same[1:] &= x[1:] == x[:-1]
            row = tuple(x[0] for x in new.values())
            same[0] = row == previous
            previous = tuple(x[-1] for x in new.values())
            new = {c: x[~same] for c, x in new.items()}
            if not len(new["pos"]):
                continue
            rows = new if held is None else {c: np.concatenate((held[c], x)) for c, x in new.items()}
            h1, h2, keyed, doc = (rows[c] for c in ("h1", "h2", "keyed", "doc"))
            n = len(h1)
            change = np.ones(n, bool)
            change[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            start = np.flatnonzero(change)
            other = change.copy()
            other[1:] |= (keyed[1:] != keyed[:-1]) | (doc[1:] != doc[:-1])
            begins = (int(h1[0]), int(h2[0]))
            goes_on = held is None and run is not None and run[0] == begins
            docs = np.add.reduceat(other.astype(np.int64), start)
            lead = (keyed[start], doc[start])
            if goes_on:
                docs[0] += run[1] - (run[3] == (int(keyed[0]), int(doc[0])))
                lead[0][0], lead[1][0] = run[2]
            if first is None:
                first = begins
            elif run is not None and run[0] == first and begins != first:
                yield count()
            of = np.repeat(np.arange(len(start)), np.diff(np.append(start, n)))
            later = (keyed != lead[0][of]) | (doc != lead[1][of])
            opens = np.zeros(len(start), bool)
            opens[0] = begins == first
            waits = np.zeros(len(start), bool)
            waits[-1] = docs[-1] < documents and not opens[-1]
            decided = ~opens & ~waits & (docs >= documents)
            if (gone := decided[of] & later).any():
                yield out(_GONE, rows, gone)
            if opens[0]:
                yield out(_OPEN, rows, of == 0)
                if len(start) > 1:
                    end = start[1] - 1
                    run = (begins, int(docs[0]), (int(lead[0][0]), int(lead[1][0])), (int(keyed[end]), int(doc[end])))
                    yield count()
            run = ((int(h1[-1]), int(h2[-1])), int(docs[-1]), (int(lead[0][-1]), int(lead[1][-1])), (int(keyed[-1]), int(doc[-1])))
            held = {c: x[start[-1] :] for c, x in rows.items()} if waits[-1] else None
        if held is not None:
            yield out(_OPEN, held, np.ones(len(held["pos"]), bool))
        if run is not None:
            yield count()

    return stream


@F.pandas_udf(BinaryType())
def _bitmap(n: pd.Series, gone: pd.Series) -> pd.Series:
    def packed(lines: int, places: np.ndarray) -> bytes:
        keep = np.ones(lines, bool)
        keep[places] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([packed(k, p) for k, p in zip(n, gone)], dtype=object)


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(keyed, doc, t1, t2, n_lines, n_dropped, keep) for each document that loses lines; all others keep every line.

    ``keep`` is a zlib-compressed bitmap, one bit a line, the first line in the highest bit of the first byte.
    """
    lines = stored(_lines(docs, text, key, least), "lines")
    by = ["h1", "h2", F.desc("keyed"), F.desc("doc"), "pos", "t1", "t2", "n_lines", "copy"]
    ranged = lines.repartitionByRange(*by).sortWithinPartitions(*by)
    found = stored(ranged.mapInPandas(_first_occurrences(documents), _STREAM), "occurrences")
    # A document that ends one range and begins the next was counted by both.
    along = Window.partitionBy("h1", "h2").orderBy("part")
    again = (F.lag("last_keyed").over(along) == F.col("keyed")) & (F.lag("last_doc").over(along) == F.col("doc"))
    counts = found.filter(F.col("kind") == _COUNT).select("h1", "h2", "keyed", "doc", (F.col("docs") - F.coalesce(again.cast("int"), F.lit(0))).alias("docs"))
    totals = counts.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max(F.struct("keyed", "doc")).alias("lead"))
    totals = F.broadcast(totals.filter(F.col("docs") >= documents).drop("docs"))  # at most two rows a range
    rows = ["keyed", "doc", "t1", "t2", "pos", "n_lines"]
    late = found.filter(F.col("kind") == _OPEN).select("h1", "h2", *rows).join(totals, ["h1", "h2"]).filter("keyed <> lead.keyed or doc <> lead.doc")
    gone = found.filter(F.col("kind") == _GONE).select(*rows).unionByName(late.select(*rows))
    gone = gone.groupBy("keyed", "doc", "t1", "t2", "n_lines").agg(F.collect_set("pos").alias("gone"))
    return gone.select("keyed", "doc", "t1", "t2", "n_lines", F.size("gone").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep"))


@F.pandas_udf(StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    """Lines whose bit is set, joined; texts without a bitmap are not sent."""

    def lines(t: str, packed: bytes) -> str:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).tolist()
        return "\n".join(line for line, bit in zip(t.split("\n"), bits) if bit)

    return pd.Series([None if t is None else lines(t, k) for t, k in zip(text, keep)], dtype=object)


def drop_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(key, n_lines, n_dropped, kept) for each row of ``docs``: lines before dropping, lines dropped, and the rest joined by line feeds."""
    keeps = stored(keep_bitmaps(docs, text, key, least, documents), "keeps").drop("n_lines")
    rows = docs.select(F.col(key).alias("key"), *_identity(text, key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = rows.join(keeps, ["keyed", "doc", "t1", "t2"], "left")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    cut = _kept(F.when(F.col("keep").isNotNull(), F.col("text")), "keep")
    return met.select(
        F.col("key").alias(key), n_lines.cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(cut).alias("kept"),
    )
