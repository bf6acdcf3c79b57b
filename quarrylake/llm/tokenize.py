"""Byte-pair encoding by dynamic programming over prefixes.

For a byte-pair vocabulary the encoding of every prefix of a word ends in exactly
one token: the one that may follow the last token of the shorter prefix before
it. Two tokens may stand side by side if encoding their joint bytes gives them
back. So one pass over the prefixes, with a test of the tokens that end at each
position, stores the last token of every prefix, and following these back gives
the ids. The pass runs over all distinct words of a batch at once in numpy: the
tokens that end at a position are looked up by rolling hash and compared byte by byte before one is
taken, the pair test walks the merge tree of both tokens, and its answers are
remembered. Very long words, and long ones of which a batch has few, go one by one
through an automaton of all tokens, with the same test.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = np.uint64(0x100000001B3 * 2 + 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
#: How the public vocabulary cuts a text into words before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


NARROW = 0x250  # code points below are Latin


@lru_cache(maxsize=1)
def splitter():
    """Cuts a text into words. Texts of Latin characters alone go through the standard
    library's pattern engine, whose classes are spelled out; it is twice as fast."""
    whole = regex.compile(PATTERN).findall

    def listed(kind: str) -> str:
        return "".join(f"\\u{c:04x}" for c in range(NARROW) if regex.match(kind, chr(c)))

    letters, numbers, blanks = listed(r"\p{L}"), listed(r"\p{N}"), listed(r"\s")
    narrow = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{blanks}{letters}{numbers}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+").findall
    wide = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search
    return lambda text: whole(text) if wide(text) else narrow(text)


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def byte_letters() -> dict[int, str]:
    """The vocabulary file writes bytes as letters: printable Latin-1 characters as
    themselves, the others as the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class _Table:
    """Open-addressing map of uint64 keys to int32, for arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 19):
        self.shift = np.uint64(64 - bits)
        size = (1 << bits) + 64
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        with np.errstate(over="ignore"):
            slots = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        self.probes = 1
        for k, v, s in zip(keys.tolist(), values.tolist(), slots.tolist()):
            n = 1
            while self.values[s] >= 0:
                s += 1
                n += 1
            self.keys[s], self.values[s] = k, v
            self.probes = max(self.probes, n)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = ((keys * _SPREAD) >> self.shift).astype(np.int64)
        v = self.values[slots]
        hit = self.keys[slots] == keys
        out = np.where(hit, v, np.int32(-1))
        more = np.flatnonzero(~hit & (v >= 0))
        for _ in range(1, self.probes):
            if not len(more):
                break
            slots[more] += 1
            s = slots[more]
            v, hit = self.values[s], self.keys[s] == keys[more]
            out[more[hit & (v >= 0)]] = v[hit & (v >= 0)]
            more = more[~hit & (v >= 0)]
        return out


class PrefixEncoder:
    """Encoder of one byte-level vocabulary; ids as in its file."""

    MEMO_BITS = 21

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # ranks: the 256 bytes, then one for each merge, in merge order
        names = [letters[b] for b in range(256)] + [a + b for a, b in merges]
        rank = {}
        for i, n in enumerate(names):
            rank.setdefault(n, i)
        self.ids = np.array([model["vocab"][n] for n in names], np.int32)
        n = len(names)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        pair_keys = np.zeros(len(merges), np.uint64)
        for i, (a, b) in enumerate(merges):
            self.left[256 + i], self.right[256 + i] = rank[a], rank[b]
            pair_keys[i] = (rank[a] << 20) | rank[b]
        self.pairs = _Table(pair_keys, np.arange(256, n, dtype=np.int32))
        tokens = [bytes(back[c] for c in name) for name in names]
        self.by_bytes = {t: i for i, t in reversed(list(enumerate(tokens)))}
        self.longest = max(map(len, tokens))
        self.bytes = np.zeros((n, self.longest), np.uint8)
        for i, t in enumerate(tokens):
            self.bytes[i, : len(t)] = np.frombuffer(t, np.uint8)
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                self.powers[k] = self.powers[k - 1] * _BASE
        # every suffix of a token, with the token it is, or one past the last if it is none
        suffixes: dict[int, int] = {}
        named: dict[int, bytes] = {}
        for i, t in enumerate(tokens):
            h, power = 0, 1
            for k, byte in enumerate(reversed(t), 1):
                h = (h + (byte + 1) * power) & 0xFFFFFFFFFFFFFFFF
                power = (power * int(_BASE)) & 0xFFFFFFFFFFFFFFFF
                if named.setdefault(h, t[len(t) - k :]) != t[len(t) - k :]:
                    raise ValueError("two parts of tokens share a hash; choose another base")
                if k == len(t):
                    suffixes[h] = min(i, suffixes.get(h, n))
                else:
                    suffixes.setdefault(h, n)
        self.by_hash = _Table(np.array(list(suffixes), np.uint64), np.array(list(suffixes.values()), np.int32), bits=20)
        # what suffixes of one and two bytes are, without a hash
        self.of_one = np.array([suffixes[b + 1] for b in range(256)], np.int32)
        base = int(_BASE)
        self.of_two = np.array([suffixes.get((a + 1) * base + b + 1 & 0xFFFFFFFFFFFFFFFF, -1) for a in range(256) for b in range(256)], np.int32)
        self.memo_keys = np.full(1 << self.MEMO_BITS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.memo = np.zeros(1 << self.MEMO_BITS, bool)
        self.find = splitter()
        self.forget()

    def forget(self) -> None:
        """Remembered words: word to its place in starts and counts, ids one after another."""
        self.index: dict[str, int] = {}
        self.starts, self.counts, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.used = 0

    def _remember(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.index)
        while n + len(words) > len(self.starts):
            self.starts, self.counts = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.counts, 2 * len(self.counts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + len(words)] = counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.index.update(zip(words, range(n, n + len(words))))

    def _adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b (ranks) may follow each other.

        Undoing merges on the side that was merged last, from the border inwards:
        if at any time the two border parts have a merge of their own that would
        have come before the merges undone so far, it would have been made.
        """
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(live):
            merged = self.pairs.get(((a << 20) | b).astype(np.uint64)).astype(np.int64)
            bad = (merged >= 0) & (merged < limit)
            ok[live[bad]] = False
            # the later merged side is undone; a byte cannot be
            cut_a = (a > b) & (a >= 256)
            cut_b = ~cut_a & (b >= 256)
            cut_a |= ~cut_b & (a >= 256)
            go = ~bad & (cut_a | cut_b)
            live, a, b, limit, cut_a = live[go], a[go], b[go], limit[go], cut_a[go]
            # a merge at the border made before a's own one (ties: leftmost first) would win
            limit = np.where(cut_a, a, b + 1)
            a, b = np.where(cut_a, self.right[a], a), np.where(cut_a, b, self.left[b])
        return ok

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        slot = ((key * _SPREAD) >> np.uint64(64 - self.MEMO_BITS)).astype(np.int64)
        out = self.memo[slot]
        miss = np.flatnonzero(self.memo_keys[slot] != key)
        if len(miss):
            fresh = self._adjacent(a[miss], b[miss])
            out[miss] = fresh
            # two keys of one slot may meet here: only pairs whose key was stored last keep their answer
            self.memo_keys[slot[miss]] = key[miss]
            mine = self.memo_keys[slot[miss]] == key[miss]
            self.memo[slot[miss][mine]] = fresh[mine]
        return out

    def _encode_block(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and all ids, of words sorted by falling length."""
        sizes = np.array([len(w) for w in words], np.int64)
        width, n, none = int(sizes[0]), len(words), len(self.left)
        text = np.zeros((n, width), np.uint8)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        columns = np.ascontiguousarray(text.T).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((width + 1, n), np.uint64)
        last = np.zeros((width + 1, n), np.int32)
        begin = np.zeros((width + 1, n), np.int32)
        for i in range(1, width + 1):
            prefix[i] = prefix[i - 1] * _BASE + columns[i - 1]
        for i in range(1, width + 1):
            rows = np.arange(int(np.searchsorted(-sizes, -i, side="right")))
            now = prefix[i]
            for size in range(1, min(i, self.longest) + 1):
                if size == 1:
                    token = self.of_one[text[rows, i - 1]]
                elif size == 2:
                    token = self.of_two[text[rows, i - 2].astype(np.int64) << 8 | text[rows, i - 1]]
                else:
                    token = self.by_hash.get(now[rows] - prefix[i - size][rows] * self.powers[size])
                going = token >= 0
                at = np.flatnonzero(going & (token < none))
                if len(at):
                    found, these = token[at], rows[at]
                    fits = self.adjacent(last[i - size][these], found) if size < i else self.whole[found]
                    # a hash may deceive: the bytes decide
                    fits[fits] = (text[these[fits], i - size : i] == self.bytes[found[fits], :size]).all(axis=1)
                    done = these[fits]
                    last[i, done], begin[i, done] = found[fits], i - size
                    going[at[fits]] = False  # the last token of a prefix is unique
                rows = rows[going]
                if not len(rows):
                    break
        rows, at, steps = np.arange(n), sizes.copy(), []
        while len(rows):
            steps.append((rows, last[at, rows]))
            at = begin[at, rows].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        counts = np.zeros(n, np.int64)
        for rows, _ in steps:
            counts[rows] += 1
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]), np.int32)
        for k, (rows, token) in enumerate(steps, 1):
            out[ends[rows] - k] = self.ids[token]
        return counts, out

    def _encode_long(self, word: bytes) -> list[int]:
        """The same for one very long word: an automaton names the tokens that end at
        each position, longest first."""
        if not hasattr(self, "_automaton"):
            self._automaton = ahocorasick.Automaton()
            for t, i in self.by_bytes.items():
                self._automaton.add_word(t.decode("latin-1"), (i, len(t)))
            self._automaton.make_automaton()
            self._pairs: dict[tuple[int, int], bool] = {}
        pairs = self._pairs
        last, begin, done = [0] * (len(word) + 1), [0] * (len(word) + 1), 0
        for end, (token, size) in self._automaton.iter(word.decode("latin-1")):
            i = end + 1
            if i == done:
                continue  # the last token of a prefix is unique
            start = i - size
            if start == 0:
                fits = bool(self.whole[token])
            else:
                pair = (last[start], token)
                if pair not in pairs:
                    if len(pairs) > 1_000_000:
                        pairs.clear()
                    pairs[pair] = bool(self._adjacent(np.array([pair[0]]), np.array([token]))[0])
                fits = pairs[pair]
            if fits:
                last[i], begin[i], done = token, start, i
        found, at = [], len(word)
        while at:
            found.append(last[at])
            at = begin[at]
        return self.ids[np.array(found[::-1], np.int64)].tolist()

    #: Bytes from which a word is encoded by itself.
    LONG = 4000
    #: Bytes from which this goes for words of which there are fewer in a batch, because
    #: a step for all of them takes as long as one for thousands.
    SCARCE = 64

    @property
    def whole(self) -> np.ndarray:
        """Which tokens encode to themselves: the halves of their last merge must not
        have an earlier merge at the border."""
        if not hasattr(self, "_whole"):
            n = len(self.left)
            ok = np.ones(n, bool)
            a, b, limit, live = self.left[256:].copy(), self.right[256:].copy(), np.arange(256, n), np.arange(256, n)
            while len(live):
                merged = self.pairs.get(((a << 20) | b).astype(np.uint64)).astype(np.int64)
                bad = (merged >= 0) & (merged < limit)
                ok[live[bad]] = False
                cut_a = (a > b) & (a >= 256)
                cut_b = ~cut_a & (b >= 256)
                cut_a |= ~cut_b & (a >= 256)
                go = ~bad & (cut_a | cut_b)
                live, a, b, cut_a = live[go], a[go], b[go], cut_a[go]
                limit = np.where(cut_a, a, b + 1)
                a, b = np.where(cut_a, self.right[a], a), np.where(cut_a, b, self.left[b])
            self._whole = ok
        return self._whole

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered yet."""
        raw = list(map(str.encode, words))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        token = np.fromiter(map(self.by_bytes.get, raw, repeat(-1)), np.int64, len(raw))
        known = (token >= 0) & self.whole[token]
        self._remember([words[i] for i in np.flatnonzero(known).tolist()], np.ones(int(known.sum()), np.int64), self.ids[token[known]])
        for i in np.flatnonzero(~known & (sizes >= self.LONG)).tolist():
            own = np.array(self._encode_long(raw[i]), np.int32)
            self._remember([words[i]], np.array([len(own)]), own)
        todo = np.flatnonzero(~known & (sizes < self.LONG))
        todo = todo[np.argsort(-sizes[todo], kind="stable")]
        fall = -sizes[todo]
        start = 0
        with np.errstate(over="ignore"):
            while start < len(todo):
                width = -int(fall[start])
                # blocks of similar length and of bounded area
                end = min(start + max(16, 1_500_000 // width), int(np.searchsorted(fall, (8 - width) // 2, side="right")))
                block = todo[start : max(end, start + 1)].tolist()
                if width >= self.SCARCE and len(block) < self.SCARCE:
                    own = [self._encode_long(raw[i]) for i in block]
                    found = np.array([len(x) for x in own], np.int64), np.array(list(chain.from_iterable(own)), np.int32)
                else:
                    found = self._encode_block([raw[i] for i in block])
                self._remember([words[i] for i in block], *found)
                start += len(block)

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(where each text's words end, places of all words)."""
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.index) > 300_000:
            self.forget()
        self.learn(list(set().union(*cut).difference(self.index)))
        place = self.index.__getitem__
        return np.cumsum([len(c) for c in cut]), np.fromiter(map(place, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))

    def count_batch(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        words_end, at = self._places(texts)
        ends = np.concatenate([[0], np.cumsum(self.counts[at])])
        return np.diff(np.concatenate([[0], ends[words_end]]))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts; null and empty texts have no ids."""
        words_end, at = self._places(texts)
        counts = self.counts[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        gather = np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])
        return np.concatenate([[0], ends[words_end]]), self.flat[gather]


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder a Python worker."""
    return PrefixEncoder(path)


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, ids): token ids of every text, without special tokens.

    A null, empty text has an empty list, a blank one the ids of its blanks.
    Strings that look like special tokens are ordinary text. Rows are encoded one
    by one where they lie: nothing is shuffled, repeated rows are all returned.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                offsets, ids = enc.encode_batch(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
