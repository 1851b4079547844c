"""Jaccard similarity join on word shingles by prefix filters under several global token orders.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set holds its distinct five-word shingles, a shorter
text is one shingle, a text without words has an empty set and links with nothing. Two sets link when
100 * |intersection| >= percent * |union|.

1. *Order A* is by document frequency, rarest first. Shingles are packed by bucket and counted there exactly, so the
   order stays as sharp as the corpus grows. Shingles far above the average of ``1 << BITS`` counters (16 MB, broadcast
   whatever the input) are *heavy*: they come last, in the order of their counters, and never meet in one task.
2. The prefix of a set of n is its first n - ceil(percent n / 100) + 1 shingles: sets that link share one of it. Shingles
   of one document fill its first places and are not indexed. The place of an indexed shingle bounds the overlap of two
   sets whose first common shingle it is, hence the sizes of the sets it can lead to.
3. A run holds the documents that share an indexed shingle. In every run, members are compared with the one whose
   place leaves most room; links join components. Pairs of a run that are still in different components, and whose
   sizes and places allow a link, are compared in a second step, so no link is lost.
4. Before two whole sets meet, they must also share prefixes under *order B* (by hash) and *order C* (the reverse), and
   the shingles that those two prefixes show must leave room for the overlap that is needed.

Documents with equal sets are one class and are compared once. Empty tables give empty results; repeated rows are
documents of one class; null ids keep their rows. Helper tables are stored in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import components, membership, mix, random_words, shingles, shuffle_partitions, slices, stored, word_hashes

PERCENT = 75
WIDTH = 5
BITS = 21
#: Counters of one row on their way to the driver, and rows that each first sum is spread over.
CHUNK = 1 << 14
FAN = 64
#: A shingle is heavy if its counter is above the first number and this many times the average counter.
HEAVY_LEAST = 64
HEAVY_TIMES = 16
#: Documents of one slice of the index, which numbers them with 16 bits.
ROWS = 1 << 11
#: Documents whose shingles are hashed at once, so that a worker's arrays stay small.
HASHED = 1 << 9

_CLASS = random_words(2, 7)


def prefix_length(n, percent: int = PERCENT):
    """How many first elements of a set of n can not all be missing from a set that links with it."""
    return n + (-percent * n) // 100 + 1


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for at in range(0, len(texts), HASHED):
        x, sizes = shingles(*word_hashes(texts[at : at + HASHED]), width)
        ends = np.cumsum(sizes)
        for end, size in zip(ends.tolist(), sizes.tolist()):
            s = np.sort(x[end - size : end])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))] if size else s)
    return out


def _counters(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Ranks of counters of heavy shingles, 0 for others, over all documents; a fixed number of values reaches the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << BITS, np.int64)
        for b in slices(batches, HASHED):
            x, _ = shingles(*word_hashes(b["text"].tolist()), width)
            seen += np.bincount((x >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        parts = seen.reshape(-1, CHUNK)
        task = TaskContext.get().partitionId()
        for at in range(len(parts)):
            yield pd.DataFrame({"chunk": [at], "some": [task % FAN], "counts": [_planes(parts[at], "<i8")]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.int64)
        for x in group["counts"]:
            total += _numbers(x, "<i8")
        return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "some": [0], "counts": [_planes(total, "<i8")]})

    rows, schema = docs.select(F.col(text).alias("text")).mapInPandas(count, "chunk int, some int, counts binary"), "chunk int, some int, counts binary"
    # Sums in two steps, so that no task reads a chunk of every other task.
    for by in (["chunk", "some"], ["chunk"]):
        rows = rows.groupBy(*by).applyInPandas(add, schema)
    out = np.zeros((1 << BITS) // CHUNK * CHUNK, np.int64)
    for r in rows.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = _numbers(r["counts"], "<i8")
    # Ranks in place of counts: 4 bytes a counter, and equal counts stay together.
    ranks = np.unique(out, return_inverse=True)[1].astype(np.uint32) + np.uint32(1)
    return np.where(out > HEAVY_LEAST + HEAVY_TIMES * out.mean(), ranks, np.uint32(0))


Chooser = Callable[[np.ndarray], np.ndarray]
#: Which shingles of a set meet in buckets, and which heavy ones its prefix needs, in their order.
Split = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _without_heavy(docs: DataFrame, text: str, width: int, percent: int) -> Split:
    shared = docs.sparkSession.sparkContext.broadcast(_counters(docs, text, width))

    def split(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = shared.value[(s >> np.uint64(64 - BITS)).astype(np.int64)]
        light, heavy = s[rank == 0], s[rank > 0]
        need = max(0, prefix_length(len(s), percent) - len(light))
        return light, heavy[np.lexsort((heavy, rank[rank > 0]))[:need]]

    return split


def _class_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, by sums of mixed elements."""
    out = np.zeros((2, len(sets)), np.uint64)
    filled = [i for i, s in enumerate(sets) if len(s)]
    if filled:
        flat = np.concatenate([sets[i] for i in filled])
        starts = np.cumsum([0, *[len(sets[i]) for i in filled[:-1]]])
        for k in (0, 1):
            out[k, filled] = np.add.reduceat(mix(flat ^ _CLASS[k]), starts)
    return out[0], out[1]


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Numbers as planes of their bytes; the planes of high bytes are mostly zeros, which compress."""
    return x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T.tobytes()


def _numbers(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _owners(x: bytes) -> np.ndarray:
    return np.cumsum(_numbers(x, "<u2"), dtype=np.int64)


def _packed(at: np.ndarray, base: int, owners: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """A row for each bucket of ``at``: its columns as bytes. Owners ascend and are kept as differences."""
    order = np.argsort(at, kind="stable")
    at, owners = at[order], owners[order]
    cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)])) if len(at) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    out = {"bucket": at[cuts[:-1]].astype(np.int32), "base": np.full(len(spans), base, np.int64), "owners": pd.Series([_planes(np.diff(owners[i:j], prepend=0), "<u2") for i, j in spans], dtype=object)}
    for name, x in columns.items():
        x = x[order]
        out[name] = pd.Series([x[i:j].tobytes() for i, j in spans], dtype=object)
    return pd.DataFrame(out)


#: Rows of documents have a node, rows of packed shingles have -1. Numbers are never null, or pandas would round them.
_INDEX = "bucket int, base bigint, shingles binary, owners binary, counts binary, node bigint, keyed boolean, key bigint, n bigint, one bigint, two bigint, light bigint, low binary, high binary, heavy binary"
_COLUMNS = [c.split()[0] for c in _INDEX.split(", ")]


def _index(docs: DataFrame, text: str, key: str, width: int, percent: int, split: Split, buckets: int) -> DataFrame:
    """Two kinds of rows, made by one scan: a node for each document, and packed (shingle, owner) entries by bucket.

    A node shows the top 16 bits of its prefixes under order B (``low``) and order C (``high``), how many of its shingles
    are ``light``, and the ``heavy`` ones that its prefix needs. An owner is a node less the base of its slice.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 33
        for b in slices(batches, ROWS):
            sets = shingle_sets(b["text"].tolist(), width)
            one, two = _class_of(sets)
            n = len(sets)
            short = [(s >> np.uint64(48)).astype(np.uint16) for s in sets]
            p = [prefix_length(len(s), percent) if len(s) else 0 for s in short]
            # Copies inside a slice enter the index once.
            _, first = np.unique(np.stack((one, two)), axis=1, return_index=True)
            kept = [i for i in sorted(first.tolist()) if len(sets[i])]
            parts = {i: split(sets[i]) for i in kept}
            nodes = pd.DataFrame({
                "bucket": (np.arange(n) + base // ROWS) % buckets, "base": base, "node": base + np.arange(n, dtype=np.int64), "keyed": b["keyed"], "key": b["key"],
                "n": np.array([len(s) for s in sets], np.int64), "one": one.view(np.int64), "two": two.view(np.int64), "light": [len(parts[i][0]) if i in parts else 0 for i in range(n)],
                "low": pd.Series([s[:k].tobytes() for s, k in zip(short, p)], dtype=object), "high": pd.Series([s[len(s) - k :].tobytes() for s, k in zip(short, p)], dtype=object),
                "heavy": pd.Series([parts[i][1].tobytes() if i in parts else b"" for i in range(n)], dtype=object),
            })
            yield nodes.assign(shingles=None, owners=None, counts=None)[_COLUMNS]
            if kept:
                tokens = np.concatenate([parts[i][0] for i in kept])
                owners = np.repeat(np.array(kept, np.int64), [len(parts[i][0]) for i in kept])
                entries = _packed((tokens % np.uint64(buckets)).astype(np.int32), base, owners, shingles=(tokens >> np.uint64(32)).astype(np.uint32))
                yield _without_nodes(entries.assign(counts=None))
            base += n

    whole = F.col(key).cast("bigint")
    return docs.select(whole.isNotNull().alias("keyed"), F.coalesce(whole, F.lit(0)).alias("key"), F.col(text).alias("text")).mapInPandas(rows, _INDEX)


def _without_nodes(entries: pd.DataFrame) -> pd.DataFrame:
    return entries.assign(node=-1, keyed=False, **dict.fromkeys(("key", "n", "one", "two", "light"), 0), low=None, high=None, heavy=None)[_COLUMNS]


def _shared(index: DataFrame) -> DataFrame:
    """``index`` with only those entries whose shingle occurs again in the corpus, and their numbers of documents."""

    def count(group: pd.DataFrame) -> pd.DataFrame:
        packed = group["node"] < 0
        entries = group[packed]
        if not len(entries):
            return group
        each = [np.frombuffer(x, np.uint32) for x in entries["shingles"]]
        seen, at, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        n = np.minimum(n, 65535).astype(np.uint16)[at]
        kept, start = [], 0
        for tokens, owners in zip(each, entries["owners"]):
            mine = n[start : start + len(tokens)]
            start += len(tokens)
            again = mine > 1
            kept.append((tokens[again].tobytes(), _planes(np.diff(_owners(owners)[again], prepend=0), "<u2"), _planes(mine[again], "<u2")))
        entries = entries.assign(shingles=[k[0] for k in kept], owners=[k[1] for k in kept], counts=[k[2] for k in kept])
        return pd.concat([group[~packed], entries[[len(k[0]) > 0 for k in kept]]])

    return index.groupBy("bucket").applyInPandas(count, _INDEX)


def _prefixes(shared: DataFrame, percent: int) -> DataFrame:
    """Packed (shingle, owner, most) entries of the prefixes under order A, from the shared shingles of each slice.

    ``most`` is the largest size of a set that can link if this is the first common shingle. Shingles of one document
    come first and take places only; heavy ones come last.
    """

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        nodes, packed = group[group["node"] >= 0], group[group["node"] < 0]
        base = int(group["base"].iloc[0])
        if not len(packed):
            return pd.DataFrame({"bucket": pd.Series([], dtype="int32"), "base": pd.Series([], dtype="int64"), "owners": [], "shingles": [], "most": []})
        at = nodes["node"].to_numpy(np.int64) - base
        n, light = np.zeros(at.max() + 1, np.int64), np.zeros(at.max() + 1, np.int64)
        n[at], light[at] = nodes["n"].to_numpy(np.int64), nodes["light"].to_numpy(np.int64)
        each = [np.frombuffer(x, np.uint32) for x in packed["shingles"]]
        tokens = np.concatenate(each)
        owners = np.concatenate([_owners(x) for x in packed["owners"]])
        counts = np.concatenate([_numbers(x, "<u2") for x in packed["counts"]])
        bucket = np.repeat(packed["bucket"].to_numpy(np.int64), [len(x) for x in each])
        order = np.lexsort((tokens, bucket, counts, owners))
        tokens, owners, bucket = tokens[order], owners[order], bucket[order]
        many = np.bincount(owners, minlength=len(n))
        place = light[owners] - many[owners] + np.arange(len(owners)) - (np.cumsum(many) - many)[owners]
        most = _most(n[owners], place, percent)
        use = 100 * most >= percent * n[owners]
        return _packed(bucket[use], base, owners[use], shingles=tokens[use], most=most[use].astype(np.int32))

    columns = shared.select("bucket", "base", "shingles", "owners", "counts", "node", "n", "light")
    return columns.groupBy("base").applyInPandas(entries, "bucket int, base bigint, owners binary, shingles binary, most binary")


def _most(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Size up to which another set can link with one of ``n`` whose first common shingle has this place."""
    return (100 + percent) * (n - place) // percent - n


def _heavy_runs(nodes: DataFrame, percent: int) -> DataFrame:
    """(run, node, most) of heavy shingles in prefixes: a row each, so no task gathers one."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for b in slices(iter([b]), 512):
                each = [np.frombuffer(x, np.uint64) for x in b["heavy"]]
                size = [len(x) for x in each]
                n = np.repeat(b["n"].to_numpy(), size)
                place = np.concatenate([light + np.arange(k) for light, k in zip(b["light"].tolist(), size)])
                most = _most(n, place, percent)
                use = 100 * most >= percent * n
                yield pd.DataFrame({"run": mix(np.concatenate(each)).view(np.int64)[use], "node": np.repeat(b["node"].to_numpy(), size)[use], "most": most[use]})

    return nodes.filter("octet_length(heavy) > 0").select("node", "n", "light", "heavy").mapInPandas(rows, "run bigint, node bigint, most bigint")


def _runs(packed: DataFrame) -> DataFrame:
    """(run, node, most): documents that share an indexed shingle. Runs with the same members are one, that of its first shingle."""

    def runs(group: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in group["shingles"]])
        nodes = np.concatenate([_owners(x) + b for x, b in zip(group["owners"], group["base"])])
        most = np.concatenate([np.frombuffer(x, np.int32) if x else np.full(len(t) // 4, np.iinfo(np.int32).max) for x, t in zip(group["most"], group["shingles"])])
        order = np.lexsort((-most, nodes, tokens))
        tokens, nodes, most = tokens[order], nodes[order], most[order]
        # Two shingles of a document may share the bits that are kept; the first place counts.
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])))
        tokens, nodes, most = tokens[new], nodes[new], most[new]
        cut = np.concatenate(([0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1))
        length = np.diff(np.append(cut, len(tokens)))
        name = np.repeat(np.add.reduceat(mix(nodes.view(np.uint64) + np.uint64(1)), cut), length).view(np.int64)
        many = np.repeat(length, length) > 1
        found = pd.DataFrame({"run": name[many], "node": nodes[many], "most": most[many].astype(np.int64)})
        return found.groupby(["run", "node"], as_index=False, sort=False)["most"].max()

    return packed.groupBy("bucket").applyInPandas(runs, "run bigint, node bigint, most bigint")


def _overlap_room(n: list[int], low: list[np.ndarray], high: list[np.ndarray], percent: int) -> bool:
    """Whether two sets, of which the least and the largest shingles are shown, may link.

    Shown values are shortened, which can only make more of them equal. Shingles strictly below the lower of the two
    ends of ``low``, and strictly above the higher of the two ends of ``high``, are all shown; the others may all be shared.
    """
    below, above = len(np.intersect1d(low[0], low[1])), len(np.intersect1d(high[0], high[1]))
    if not below or not above:
        return False
    # Equal shortened values inside one set count once in an intersection, so the repeats are added.
    spare = min(len(low[0]) - len(np.unique(low[0])), len(low[1]) - len(np.unique(low[1]))) + min(len(high[0]) - len(np.unique(high[0])), len(high[1]) - len(np.unique(high[1])))
    v, u = min(low[0][-1], low[1][-1]), max(high[0][0], high[1][0])
    hidden = [n[i] - int((low[i] < v).sum()) - int((high[i] > u).sum()) for i in (0, 1)]
    most = min(below + above + spare + max(0, min(hidden)), *n)
    return 100 * most >= percent * (n[0] + n[1] - most)


def _sieve(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose prefixes under orders B and C leave room for a link."""
    side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "low", "high")])

    def pass_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = lambda x: np.frombuffer(x, np.uint16)
        for b in batches:
            keep = [
                _overlap_room([x, y], [read(p), read(q)], [read(r), read(s)], percent)
                for x, y, p, q, r, s in zip(b["n_a"].tolist(), b["n_b"].tolist(), b["low_a"], b["low_b"], b["high_a"], b["high_b"])
            ]
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return near.mapInPandas(pass_, "a bigint, b bigint")


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole sets link."""
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = stored(wanted.join(classes, "class").select(F.col("class").alias("node"), F.col("shown").alias("key"), "one", "two"), "wanted")
    sets = stored(_sets(docs, text, key, wanted, width), "sets")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}"))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for p, q in zip(b["tokens_a"], b["tokens_b"]):
                both = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(p) + len(q)) // 8 - both))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(exact, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, text: str, key: str, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the wanted classes, each once, from the document that stands for it or a repeated row of it."""
    may = membership(wanted, ["key"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, ROWS):
            b = b[may(b["h"].to_numpy())]
            sets = shingle_sets(b["text"].tolist(), width)
            one, two = _class_of(sets)
            yield pd.DataFrame({"h": b["h"], "one": one.view(np.int64), "two": two.view(np.int64), "tokens": pd.Series([s.tobytes() for s in sets], index=b.index, dtype=object)})

    texts = docs.select(F.xxhash64(F.col(key).cast("bigint")).alias("h"), F.col(text).alias("text"))
    # Dealt by the columns of the join that follows, so repeats of a hot id meet as partial results only.
    found = texts.mapInPandas(rows, "h bigint, one bigint, two bigint, tokens binary").groupBy("h", "one", "two").agg(F.first("tokens").alias("tokens"))
    return found.join(wanted.withColumn("h", F.xxhash64("key")).drop("key"), ["h", "one", "two"]).select("node", "tokens")


def similar_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT, width: int = WIDTH, choose: Chooser | None = None) -> DataFrame:
    """(key, n_shingles, component_id) for each row of ``docs``; the component is its smallest key.

    ``choose`` picks the indexed hashes of a set; without it, they are the prefix under order A.
    """
    spark = docs.sparkSession
    buckets = max(64, 4 * shuffle_partitions(spark))
    if choose:
        index = stored(_index(docs, text, key, width, percent, lambda s: (choose(s), s[:0]), buckets), "index")
    else:
        index = stored(_shared(_index(docs, text, key, width, percent, _without_heavy(docs, text, width, percent), buckets)), "index")
    shown = index.filter("node >= 0")
    nodes = shown.select("node", F.when(F.col("keyed"), F.col("key")).alias("key"), "n", "one", "two")
    # Documents with equal sets are one class, named by its first node; an empty set is a class of its own.
    empty = F.when(F.col("n") == 0, F.col("node")).otherwise(F.lit(0))
    nodes = nodes.withColumn("alone", empty)
    by = ["one", "two", "n", "alone"]
    classes = stored(nodes.groupBy(*by).agg(F.min(F.struct("node", "key")).alias("first"), F.min("key").alias("least")), "classes")
    classes = classes.select(F.col("first")["node"].alias("class"), F.col("first")["key"].alias("shown"), "least", *by)
    member = stored(nodes.join(classes.select("class", *by), by).select("node", "key", "n", "class"), "members")

    if choose:
        # Chosen hashes have no places, so only the sizes bound each other.
        packed = index.filter("node < 0").select("bucket", "base", "shingles", "owners", F.lit(None).cast("binary").alias("most"))
        found = _runs(packed)
    else:
        found = _runs(_prefixes(index, percent)).unionByName(_heavy_runs(shown, percent))
    of = member.select("node", "class", "n")
    runs = found.join(of, "node").groupBy("run", F.col("class").alias("node")).agg(F.max("most").alias("most"), F.first("n").alias("n"))
    runs = stored(runs, "runs")

    def linked(pairs: DataFrame) -> DataFrame:
        return stored(_verify(stored(_sieve(pairs, shown, percent), "near"), docs, classes, text, key, width, percent), "links")

    first = runs.groupBy("run").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("room"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"))).alias("f")).select("run", "f.*")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    fits = "a <> b and n <= most_a and n_a <= most"
    stars = runs.withColumnRenamed("node", "b").join(first, "run").filter(fits).select(*ordered).distinct()
    stars = stored(stars, "stars")
    links = linked(stars)
    label = components(links)
    # Members of a run that are still apart meet each other; those already together need not. One side of a pair is
    # outside the component that has most members of the run.
    named = runs.join(label, "node", "left").select("run", "node", "n", "most", F.coalesce("component", "node").alias("component"))
    parts = named.groupBy("run", "component").agg(F.count(F.lit(1)).alias("members"))
    apart = parts.groupBy("run").agg(F.max(F.struct("members", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    open_ = stored(named.join(apart.select("run", F.col("main")["component"].alias("main")), "run"), "open")
    outside = open_.filter("component <> main").select("run", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("component").alias("other"))
    rest = open_.withColumnRenamed("node", "b").join(outside, "run").filter(f"{fits} and component <> other and (component = main or a < b)").select(*ordered).distinct()
    rest = stored(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    label = components(links.unionByName(linked(rest)))

    grouped = member.join(label.withColumnRenamed("node", "class"), "class", "left").select("key", "n", F.coalesce("component", "class").alias("component"))
    least = grouped.groupBy("component").agg(F.min("key").alias("component_id"))
    return grouped.join(least, "component").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the first of those with the smallest id, or of those without id if no row has one.

    Rows are told apart by a number that is stored with them, so repeated and null ids decide nothing but the order.
    Documents without words belong to no component and stay.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = similar_classes(rows, text, "__row", percent).select("__row", "component_id")
    ids = rows.select("__row", F.col(key).cast("bigint").alias("__id"))
    order = F.struct(F.col("__id").isNull().alias("no_id"), "__id", "__row")
    first = found.join(ids, "__row").groupBy("component_id").agg(F.min(order)["__row"].alias("__row"))
    later = found.join(first, "__row", "left_anti").select("__row")
    return rows.join(later, "__row", "left_anti").select(*docs.columns)
