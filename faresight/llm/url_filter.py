"""URL filter: a cascade of Bloom filters that answers membership exactly for every key of the corpus.

Level 1 encodes the listed keys, level 2 the keys of the corpus that level 1 wrongly accepts, level 3 the listed keys
that level 2 wrongly accepts, and so on until no key of the corpus is answered wrongly. Looking a key up walks the
levels until one rejects it; no join is needed. The universe is every key that any url of the corpus can ask for.

The filters are broadcast. Their size follows the list, not the corpus: level 1 holds log2(universe / listed) + 1 bits
a key over ln 2, the later levels shrink. ``MAX_BYTES`` bounds it; a longer list is refused, to be split by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import mix, random_words, stored

MAX_BYTES = 64 << 20
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


class Cascade:
    """Bit arrays of the levels; odd levels encode listed keys, even levels the others."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []

    @staticmethod
    def places(one: np.ndarray, two: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
        """(key, hash) -> bit; both 64-bit hashes of a key are mixed anew for every level."""
        seed = random_words(2, 100 + level)
        a, b = mix(one ^ seed[0]), mix(two ^ seed[1]) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)

    def holds(self, level: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        words, hashes = self.levels[level]
        at = self.places(one, two, level, 64 * len(words), hashes)
        return ((words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Exact answer for keys of the universe: the first level that rejects a key settles it."""
        answer = np.zeros(len(one), bool)
        open_ = np.arange(len(one))
        for level in range(len(self.levels)):
            inside = self.holds(level, one[open_], two[open_])
            answer[open_[~inside]] = level % 2 == 1
            open_ = open_[inside]
        answer[open_] = len(self.levels) % 2 == 1
        return answer

    def bytes(self) -> int:
        return sum(w.nbytes for w, _ in self.levels)


def _hashed(keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.select(F.xxhash64(key).alias("one"), F.xxhash64(F.lit("second"), key).alias("two")).distinct()


def _encode(keys: DataFrame, level: int, count: int, rate: float, room: int) -> tuple[np.ndarray, int]:
    """The level's words: every task sets its own bits, words are combined with OR, and only words reach the driver."""
    hashes = max(1, round(math.log2(1 / rate)))
    words = max(1, math.ceil(count * hashes / math.log(2) / 64))
    if 8 * words > room:
        raise ValueError(f"the cascade would need more than {MAX_BYTES} bytes: split the list")

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.unique(Cascade.places(b["one"].to_numpy().view(np.uint64), b["two"].to_numpy().view(np.uint64), level, 64 * words, hashes))
            if len(at):
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                yield pd.DataFrame({"word": word.astype(np.int64), "bits": np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64)})

    rows = keys.mapInPandas(bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(words, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64), hashes


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key", max_levels: int = 64) -> Cascade:
    """Cascade that separates ``listed`` from the other keys of ``universe``; null keys are no keys.

    Listed keys that the corpus lacks are left out, as nobody asks for them. Empty lists and corpora are allowed.
    """
    cascade, spark = Cascade(), universe.sparkSession
    whole = stored(_hashed(universe.filter(F.col(key).isNotNull()), key), "universe")
    inside = stored(whole.join(_hashed(listed.filter(F.col(key).isNotNull()), key), ["one", "two"], "left_semi"), "listed")
    other = whole.join(inside, ["one", "two"], "left_anti")
    n, rest = inside.count(), whole.count()
    if not n:
        return cascade
    sides = [inside, other]
    rate = min(0.5, n / (math.sqrt(2) * max(1, rest - n)))
    while n:
        level = len(cascade.levels)
        if level == max_levels:
            raise RuntimeError("two keys of the corpus share both hashes")
        cascade.levels.append(_encode(sides[0], level, n, rate, MAX_BYTES - cascade.bytes()))
        shared = spark.sparkContext.broadcast(cascade)

        def wrong(batches: Iterator[pd.DataFrame], shared=shared, level=level) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[shared.value.holds(level, b["one"].to_numpy().view(np.uint64), b["two"].to_numpy().view(np.uint64))]

        missed = stored(sides[1].mapInPandas(wrong, "one bigint, two bigint"), "missed")
        sides = [missed, sides[0]]
        n, rate = missed.count(), 0.5
    return cascade


def lookup(cascade: Cascade, df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with ``name``: for an array of keys, the array of answers; a null key is not listed."""
    shared = df.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("array<boolean>")
    def answers(one: pd.Series, two: pd.Series) -> pd.Series:
        sizes = [len(x) for x in one]
        flat = [np.concatenate([np.empty(0, np.int64), *s]).astype(np.int64).view(np.uint64) for s in (one, two)]
        return pd.Series(np.split(shared.value.listed(*flat), np.cumsum(sizes)[:-1]) if sizes else [], dtype=object)

    both = [F.transform(key, lambda k: F.xxhash64(k)), F.transform(key, lambda k: F.xxhash64(F.lit("second"), k))]
    return df.withColumn(name, answers(*both))


def rule_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every rule text a url can match, longest first: host suffixes of ``labels`` labels, path starts of ``lengths`` characters."""
    count = F.size(F.split(host, r"\."))
    out = [
        F.when((host != "") & (count >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.lit("|"), F.substring(path, 1, m)))
        for n, m in ((n, m) for n in labels for m in lengths)
    ]
    return F.array_sort(F.array_compact(F.array(*out)), lambda a, b: F.length(b) - F.length(a))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules`` has host, path and verdict (allow or block).

    A rule fits its host and all subdomains when the url's path starts with its path; the longest rule wins, block
    before allow among equals. Two cascades, of blocked and of allowed rules, answer which of a url's keys are listed.
    A url without a rule gets ``default``. Null urls and urls without ``://`` have an empty host and path and no rule.
    ``rules`` is a list: its label counts and path lengths are read to the driver; null hosts are no rules.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url]
    df = pages.select(*kept, host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    listed = rules.filter("host is not null").select(F.concat("host", F.lit("|"), F.coalesce("path", F.lit(""))).alias("key"), "verdict")
    shapes = rules.filter("host is not null").select(F.size(F.split("host", r"\.")).alias("n"), F.length(F.coalesce("path", F.lit(""))).alias("m"))
    shape = shapes.agg(F.sort_array(F.collect_set("n")).alias("n"), F.sort_array(F.collect_set("m")).alias("m")).first()
    if not shape["n"]:
        shape = {"n": [1], "m": [0]}
    df = df.withColumn("__keys", rule_keys(F.col("__host"), F.col("__path"), shape["n"], shape["m"]))
    # Pages repeat hosts, so keys are made unique per host and path start before they are exploded.
    universe = df.select(F.explode("__keys").alias("key")).distinct()
    universe = stored(universe, "keys")
    for verdict in ("block", "allow"):
        df = lookup(build_cascade(listed.filter(F.col("verdict") == verdict), universe), df, "__keys", f"__{verdict}")
    hits = F.filter(
        F.transform("__keys", lambda k, i: F.struct(k.alias("key"), F.get("__block", i).alias("block"), F.get("__allow", i).alias("allow"))),
        lambda h: h["block"] | h["allow"],
    )
    df = df.withColumn("__hit", F.get(hits, F.lit(0)))
    verdict = F.when(F.col("__hit").isNull(), F.lit(default)).when(F.col("__hit")["block"], F.lit("block")).otherwise(F.lit("allow"))
    rule = F.col("__hit")["key"]
    at = F.substring_index(rule, "|", 1)
    rest = F.substring(rule, F.length(at) + 2, F.length(rule))
    text = F.concat(at, F.when(rest == "", F.lit("/")).otherwise(rest))
    return df.select(*kept, F.col("__host").alias("host"), F.col("__path").alias("path"), text.alias("rule"), verdict.alias("verdict"))


#: The rules of the registered query.
RULES = [("net", "", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
