"""Byte-level BPE by speculation and verification.

Texts are cut into words by the usual rule (contractions, letters, digits, other marks, each with one leading space, and
runs of white space), on code point arrays rather than by a regular expression. Words repeat, so each distinct word of a
task is encoded once. For all new words together, a walk through a trie proposes the longest vocabulary entry at every
place. A proposal is the true encoding exactly when every two adjacent tokens are compatible, that is when merging their
joint bytes never joins across the seam; this is tested for all distinct pairs at once. Only words with an incompatible
pair, or longer than ``LONGEST`` bytes, are merged step by step in rank order.

The vocabulary file is a parameter. Null and empty texts have no ids.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import held, prefix_hash, ragged, random_words, range_hash

#: Code points that one step works on, words that a task remembers, and bytes of the longest word that is proposed for.
STEP = 1 << 19
MEMORY = 1 << 20
SLOTS = 1 << 21
LONGEST = 64
#: The same of a worker that also holds this module's vocabulary.
SMALL = {"memory": 1 << 19, "slots": 1 << 20, "step": 1 << 17}

_OTHER, _LETTER, _NUMBER, _SPACE, _END = range(5)
_STOP = 0x110000
_NEVER = 1 << 30


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and its value in word hashes; code points past the last one mark ends and special tokens."""
    import regex

    kinds = np.zeros(_STOP + 64, np.uint8)
    every = "".join(chr(c) for c in range(_STOP) if not 0xD800 <= c < 0xE000)
    for kind, name in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
        kinds[[ord(c) for c in regex.findall(name, every)]] = kind
    kinds[_STOP:] = _END
    return kinds, random_words(len(kinds), 5)


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where words begin in an array of code points; every end mark is a word of its own."""
    kinds = _tables()[0][points]
    cut = np.flatnonzero((kinds[1:] != kinds[:-1]) | (kinds[1:] == _END)) + 1
    start = np.concatenate(([0], cut)).astype(np.int64)
    end = np.concatenate((cut, [len(points)])).astype(np.int64)
    kind = kinds[start]
    n = len(start)
    after = np.concatenate((kind[1:], [_END]))
    space = kind == _SPACE
    gives = space & (points[end - 1] == 0x20) & (after != _END)
    takes = np.concatenate(([False], gives[:-1]))
    first = start - takes
    # A lone apostrophe without leading space takes s, t, m, d, re, ve or ll from the letters behind it.
    quote = np.flatnonzero((kind == _OTHER) & (end - start == 1) & ~takes & (points[start] == 0x27) & (after == _LETTER))
    mark = ~space
    extra = np.empty(0, np.int64)
    if len(quote):
        at, stop = end[quote], end[np.minimum(quote + 1, n - 1)]
        one = points[at]
        two = np.where(at + 1 < stop, points[np.minimum(at + 1, len(points) - 1)], 0)
        took = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        took = np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")), 2, took)
        hit = took > 0
        mark[quote[hit] + 1] = False
        more = (at + took)[hit]
        extra = more[more < stop[hit]]
    whole = space & (after == _END)
    long = space & ~whole & (end - start > 1)
    last = space & ~whole & ~gives
    begins = np.zeros(len(points), bool)
    for at in (first[mark], start[whole | long], (end - 1)[last], extra):
        begins[at] = True
    return np.flatnonzero(begins)


class Words:
    """Ids of the words of texts; ``encode`` gets only words that are not remembered."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: dict[str, int], memory: int = MEMORY, slots: int = SLOTS, step: int = STEP) -> None:
        self.encode, self.special, self.memory, self.slots, self.step = encode, special, memory, slots, step
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.size, self.check = (np.empty(0, t) for t in (np.int64, np.int64, np.uint64))
        self.ids, self.used, self.count = np.empty(1 << 16, np.uint32), 0, 0
        self.slot_name, self.slot_place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)

    def _points(self, text: str) -> list[np.ndarray]:
        """Code points of a text in pieces of about ``step``, cut where white space begins; special tokens stand for themselves."""
        if any(s in text for s in self.special):
            import re

            parts = re.split("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text)
            order = list(self.special)
            one = [np.array([_STOP + 1 + order.index(p)], np.uint32) if p in self.special else np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in parts]
            points = np.concatenate(one)
        else:
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) <= self.step:
            return [points]
        space = _tables()[0][points] == _SPACE
        safe = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        cuts = np.unique(safe[np.minimum(np.searchsorted(safe, np.arange(self.step, len(points), self.step)), len(safe) - 1)]) if len(safe) else []
        return np.split(points, cuts)

    def texts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        pieces: list[np.ndarray] = []
        owners: list[int] = []
        size = 0
        stop = np.array([_STOP], np.uint32)

        def flush() -> None:
            nonlocal pieces, owners, size
            if pieces:
                ids, each = self._step(np.concatenate([x for p in pieces for x in (p, stop)]))
                out.append(ids)
                np.add.at(counts, owners, each)
            pieces, owners, size = [], [], 0

        for number, text in enumerate(texts):
            if text:
                for piece in self._points(text):
                    pieces.append(piece)
                    owners.append(number)
                    size += len(piece)
                    if size >= self.step:
                        flush()
        flush()
        return (np.concatenate(out) if out else np.empty(0, np.uint32)), counts

    def _step(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = word_starts(points)
        end = np.concatenate((start[1:], [len(points)]))
        values = _tables()[1][points]
        name = range_hash(prefix_hash(values), start, end)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
        check = total[end] - total[start]
        is_stop = points[start] == _STOP
        if len(self.known) + len(name) > self.memory:
            self.clear()
        # Most words are found in their slot; only the others are made unique and looked up.
        slot = (name & np.uint64(self.slots - 1)).astype(np.int64)
        place = self.slot_place[slot]
        miss = np.flatnonzero(self.slot_name[slot] != name)
        if len(miss):
            unique, first, back = np.unique(name[miss], return_index=True, return_inverse=True)
            at = np.fromiter((self.known.get(h, -1) for h in unique.tolist()), np.int64, len(unique))
            new = np.flatnonzero(at < 0)
            if len(new):
                word = miss[first[new]]
                at[new] = self._add(points, start[word], end[word], unique[new], check[word])
            place[miss] = at[back]
            slot = slot[miss[first]]
            self.slot_name[slot], self.slot_place[slot] = unique, at
            lost = self.slot_name[slot] != unique  # two new words of one slot: the name written last has to own the place
            self.slot_name[slot[lost]] = 0
        if (self.check[place] != check).any():
            raise RuntimeError("two words share a hash")
        size = self.size[place]
        piece = np.cumsum(is_stop) - is_stop
        each = np.bincount(piece, weights=size, minlength=int(is_stop.sum())).astype(np.int64)
        return self.ids[ragged(self.start[place], size)], each

    def _add(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray, check: np.ndarray) -> np.ndarray:
        raw = points.tobytes()
        plain = points[start] < _STOP
        words = [raw[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(start[plain].tolist(), end[plain].tolist())]
        ids, lengths = self.encode(words) if words else (np.empty(0, np.uint32), np.empty(0, np.int64))
        size = np.zeros(len(start), np.int64)
        size[plain] = lengths
        order = list(self.special.values())
        named = [(int(i), order[int(points[start[i]]) - _STOP - 1]) for i in np.flatnonzero(points[start] > _STOP)]
        begin = np.zeros(len(start), np.int64)
        begin[plain] = self.used + np.cumsum(lengths) - lengths
        extra = np.array([v for _, v in named], np.uint32)
        for k, (i, _) in enumerate(named):
            size[i], begin[i] = 1, self.used + len(ids) + k
        need = self.used + len(ids) + len(extra)
        if need > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(max(need - len(self.ids), len(self.ids)), np.uint32)))
        self.ids[self.used : need] = np.concatenate((ids, extra))
        self.used = need
        if self.count + len(start) > len(self.start):
            room = max(len(start), len(self.start), 1 << 16)
            self.start, self.size, self.check = (np.concatenate((a, np.zeros(room, a.dtype))) for a in (self.start, self.size, self.check))
        place = np.arange(self.count, self.count + len(start))
        self.start[place], self.size[place], self.check[place] = begin, size, check
        self.known.update(zip(names.tolist(), place.tolist()))
        self.count += len(start)
        return place


def byte_letters() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of one vocabulary file: token bytes, merge ranks, the derivation of every token, and a trie."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {t: i for t, i in vocab.items() if t not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in plain.items():
            self.bytes[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks, self.pair_tokens = (np.array([v[k] for v in self.pairs.values()], np.int64)[order] for k in (0, 1))
        # How merging derives each token: last merge, its rank, and the two parts; bytes have rank -1.
        self.made = np.full(size, -2, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.made[self.byte_id] = -1
        for (a, b), (rank, t) in self.pairs.items():
            if self.made[t] == -2 and self.merge(self.bytes[t]) == [t]:
                last = self._last(self.bytes[t])
                self.made[t], self.left[t], self.right[t] = self.pairs[last][0], *last
        self._trie([(self.bytes[i], i) for i in plain.values() if self.made[i] > -2])
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def _trie(self, entries: list[tuple[bytes, int]]) -> None:
        child: dict[int, int] = {}
        token = [-1]
        for data, i in entries:
            node = 0
            for b in data:
                step = node << 8 | b
                node = child.setdefault(step, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = i
        # Arcs by (node, byte): those of the first two bytes in a table, as every word needs them, the others in order of their key.
        keys = np.fromiter(child.keys(), np.int64, len(child))
        values = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        self.arc_keys, self.arc_nodes = keys, values
        first = np.unique(np.append(values[keys < 256], 0))
        self.near = np.full(len(token), -1, np.int32)
        self.near[first] = np.arange(len(first))
        self.table = np.zeros((len(first), 256), np.int32)
        close = self.near[keys >> 8] >= 0
        self.table[self.near[keys[close] >> 8], keys[close] & 255] = values[close]
        self.token = np.array(token, np.int64)

    def follow(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to; 0 where there is no arc."""
        row = self.near[node]
        out = np.where(row >= 0, self.table[row, byte], 0).astype(np.int64)
        far = np.flatnonzero(row < 0)
        if len(far):
            key = (node[far] << 8) | byte[far]
            at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            out[far] = np.where(self.arc_keys[at] == key, self.arc_nodes[at], 0)
        return out

    def _steps(self, parts: list[int]) -> Iterator[tuple[int, int]]:
        """Merges ``parts`` in place, lowest rank first and leftmost among equals; yields each merged pair."""
        pairs, none = self.pairs, (_NEVER, -1)
        while len(parts) > 1:
            best, at = none, -1
            for i in range(len(parts) - 1):
                found = pairs.get((parts[i], parts[i + 1]), none)
                if found < best:
                    best, at = found, i
            if at < 0:
                return
            pair = parts[at], parts[at + 1]
            parts[at : at + 2] = [best[1]]
            yield pair

    def _last(self, data: bytes) -> tuple[int, int]:
        last = (0, 0)
        for last in self._steps(self.byte_id[list(data)].tolist()):
            pass
        return last

    def merge(self, data: bytes) -> list[int]:
        """Exact encoding of one word."""
        parts = self.byte_id[list(data)].tolist()
        if len(parts) > 4 * LONGEST:
            return self._merge_long(parts)
        for _ in self._steps(parts):
            pass
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a queue and linked neighbours, for words of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.pairs[p][0], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.pairs]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if parts[i] != pair[0] or j >= n or parts[j] != pair[1]:
                continue
            parts[i], parts[j] = self.pairs[pair][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in self.pairs:
                    heapq.heappush(queue, (self.pairs[p][0], k, p))
        return [p for p in parts if p >= 0]

    def propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the longest matches of all words, ordered by word."""
        word = np.arange(len(start))
        pos, node = start.copy(), np.zeros(len(start), np.int64)
        best, reach = np.zeros(len(start), np.int64), start.copy()
        found: list[np.ndarray] = []
        padded = np.append(data, np.uint8(0))
        while len(word):
            step = np.where(pos < end, self.follow(node, padded[pos].astype(np.int64)), 0)
            go = step > 0
            node = np.where(go, step, 0)
            pos = np.where(go, pos + 1, reach)
            stuck = np.flatnonzero(~go)
            if len(stuck):
                found.append(np.stack((word[stuck], best[stuck])))
            token = self.token[node]
            hit = go & (token >= 0)
            best = np.where(hit, token, best)
            reach = np.where(hit, pos, reach)
            done = ~go & (pos >= end)
            if done.any():
                keep = ~done
                word, pos, node, best, reach, end = word[keep], pos[keep], node[keep], best[keep], reach[keep], end[keep]
        all_ = np.concatenate(found, axis=1)
        return tuple(all_[:, np.argsort(all_[0], kind="stable")])

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of a and b together leaves exactly a and b.

        Goes back in time from the two tokens to their bytes. While a part x at the end of a and a part y at the start of b
        stand side by side, they must not merge before either is merged into its own token; the left one wins a tie.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.copy(), b.copy()
        until_x, until_y = np.full(len(a), _NEVER), np.full(len(a), _NEVER)
        while len(open_):
            rank, _ = self.ranks(x, y)
            bad = (rank < until_x) & (rank <= until_y)
            good[open_[bad]] = False
            made_x, made_y = self.made[x], self.made[y]
            keep = ~bad & ((made_x >= 0) | (made_y >= 0))
            back_x = made_x > made_y
            until_x, until_y = np.where(back_x, made_x, until_x)[keep], np.where(back_x, until_y, made_y)[keep]
            x, y = np.where(back_x, self.right[x], x)[keep], np.where(back_x, y, self.left[y])[keep]
            open_ = open_[keep]
        return good

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of every pair; ``_NEVER`` where it does not merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER), self.pair_tokens[at]

    def merge_all(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact encoding of many short words, one merge in each word at a time; (word, token) ordered by word."""
        size = end - start
        word = np.repeat(np.arange(len(start)), size)
        part = self.byte_id[data[ragged(start, size)]]
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def rank_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs that begin at the given parts; the last part of a word begins none."""
            after = np.minimum(at + 1, len(part) - 1)
            rank, token = self.ranks(part[at], part[after])
            return np.where((word[after] == word[at]) & (after > at), rank, _NEVER), token

        rank, token = rank_at(np.arange(len(part)))
        while len(part):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat((rank << 32) | np.arange(len(part)), first)
            open_ = (least >> 32) < _NEVER
            at = (least & 0xFFFFFFFF)[open_]
            part[at] = token[at]
            keep = np.ones(len(part), bool)
            keep[at + 1] = False
            if not open_.all():
                over = np.repeat(~open_, np.diff(np.append(first, len(part))))
                done.append((word[over], part[over]))
                keep &= ~over
            moved = np.cumsum(keep) - 1
            at = moved[at]
            word, part, rank, token = word[keep], part[keep], rank[keep], token[keep]
            if len(at):
                near = np.concatenate((at, at[at > 0] - 1))
                rank[near], token[near] = rank_at(near)
        words, parts = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        order = np.argsort(words, kind="stable")
        return words[order], parts[order]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each word)."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        short = np.flatnonzero(sizes <= LONGEST)
        results: list[tuple[np.ndarray, np.ndarray]] = []
        wrong = np.ones(len(words), bool)
        if len(short):
            data = np.frombuffer(b"".join(raw[i] for i in short), np.uint8)
            end = np.cumsum(sizes[short])
            word, token = self.propose(data, end - sizes[short], end)
            inner = np.flatnonzero(word[1:] == word[:-1])
            pair, back = np.unique((token[inner] << 32) | token[inner + 1], return_inverse=True)
            fits = self.compatible(pair >> 32, pair & 0xFFFFFFFF)[back]
            wrong[short] = False
            wrong[short[word[inner[~fits]]]] = True
            results.append((short[word], token))
            redo = short[wrong[short]]
            keep = ~wrong[results[0][0]]
            results[0] = results[0][0][keep], results[0][1][keep]
            if len(redo):
                at = np.searchsorted(short, redo)
                word, token = self.merge_all(data, (end - sizes[short])[at], end[at])
                results.append((redo[word], token))
        redo = np.flatnonzero(sizes > LONGEST)
        merged = [self.merge(raw[i]) for i in redo.tolist()]
        if len(redo):
            results.append((np.repeat(redo, [len(m) for m in merged]), np.array([t for m in merged for t in m], np.int64)))
        word, ids = np.concatenate([r[0] for r in results]), np.concatenate([r[1] for r in results])
        order = np.argsort(word, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[ragged(self.offsets[ids], self.sizes[ids])].tobytes()


def _tools(path: str) -> tuple[Vocabulary, Words]:
    def make() -> tuple[Vocabulary, Words]:
        v = Vocabulary(path)
        return v, Words(v.encode_words, v.special, **SMALL)

    return held(("bpe", path), make)


def vocabulary(path: str) -> Vocabulary:
    return _tools(path)[0]


def _words(path: str) -> Words:
    return _tools(path)[1]


def _split(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    data, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
    return [data[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist())]


def encode(text: Column, path: str) -> Column:
    """Ids of a text as little-endian unsigned 32-bit integers; null and empty texts have none. ``path`` must name the vocabulary on
    every executor.
    """

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _words(path)
        for texts in batches:
            yield pd.Series(_split(*words.texts(texts.tolist())), dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Text of the ids; byte sequences that are not UTF-8 become replacement characters, null ids the empty text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = vocabulary(path)
        for rows in batches:
            yield pd.Series([v.decode(np.frombuffer(r, "<u4").astype(np.int64)).decode("utf-8", "replace") for r in rows], dtype=object)

    return texts(F.coalesce(ids, F.lit(b"")))


def encoded(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``docs`` with the ids of its text, replacing a column of that name."""
    return docs.withColumn(name, encode(F.col(text), path))


def round_trip(docs: DataFrame, path: str, text: str = "text", rows: int = 1000) -> DataFrame:
    """``docs`` with its text replaced by ``ids`` and ``decoded``, both made by one worker from ``rows`` texts at a time."""
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, v = _words(path), vocabulary(path)
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                ids, counts = words.texts([t if isinstance(t, str) else "" for t in part["__text"]])
                ends = np.cumsum(counts)
                texts = [v.decode(ids[e - n : e].astype(np.int64)).decode("utf-8", "replace") for e, n in zip(ends.tolist(), counts.tolist())]
                yield part[kept].assign(ids=pd.Series(_split(ids, counts), dtype=object, index=part.index), decoded=pd.Series(texts, dtype=object, index=part.index))

    chosen = docs.select(*kept, F.col(text).alias("__text"))
    fields = StructType([*[docs.schema[c] for c in kept], StructField("ids", BinaryType()), StructField("decoded", StringType())])
    return chosen.mapInPandas(both, fields)
