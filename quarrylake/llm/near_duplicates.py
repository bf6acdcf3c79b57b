"""Documents that share most of their wording.

A text is the set of its distinct runs of three words. ProbMinHash gives each set
a signature: every shingle is a Poisson process whose arrivals fall into random
registers, each register keeps its earliest arrival, and a shingle is followed
only while its next arrival can still be the earliest somewhere. With equal rates
the share of agreeing registers estimates the Jaccard similarity; with the number of
times a run occurs as its rate, the probability Jaccard similarity. Bands of registers give candidate pairs; those a bound rules out are
dropped without a look at their texts, the others are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import WORD, WordHashes, mix64, release, stored, unit_interval

#: 52 bands of 4, of which one must agree. A pair at 0.6 is missed with probability
#: 0.0007, at 0.65 with 0.00004.
BANDS, ROWS = 52, 4
BITS = 512  # of the bitmap that bounds how many shingles two texts do not share
SHINGLE = 3
#: Classes of one band that are paired in one task; larger bands are cut into blocks.
BAND_BLOCK = 2000
POINTS = 1_000_000  # characters whose words are hashed at once; a longer text is taken by itself
_STEP = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _word_points() -> np.ndarray:
    """Of every code point, whether it is part of a word."""
    out = np.zeros(0x110000, bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), of all words of the texts in
    lower case at once: a word's hash is the sum of the scrambled pairs of place and character."""
    lower = [t.lower() if t else "" for t in texts]
    lengths = np.array([len(t) + 1 for t in lower], np.int64)
    ends = np.cumsum(lengths)
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    a = 0
    while a < len(lower):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] - lengths[a] + POINTS, side="right")))
        points = np.frombuffer("\n".join([*lower[a:z], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(_word_points()[points])
        first = np.append(True, at[1:] != at[:-1] + 1)[: len(at)]
        start = np.flatnonzero(first)
        place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        mixed = mix64(place.astype(np.uint64) << np.uint64(21) | points[at])
        hashes.append(mix64(np.add.reduceat(mixed, start)) if len(start) else hashes[0])
        counts.append(np.diff(np.searchsorted(at[start], ends[a:z] - (ends[a] - lengths[a])), prepend=0))
        a = z
    return np.concatenate(hashes), np.concatenate(counts)


def batch_shingles(texts: list[str | None], min_words: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``shingle_hashes`` of many texts, whose words are hashed together."""
    h, counts = hashed_words(texts)
    enough = counts >= max(min_words, size)
    return _runs(h[np.repeat(enough, counts)], np.where(enough, counts, 0), size)


def shingle_hashes(texts: list[str | None], hashes: WordHashes, min_words: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count): distinct shingles of each text of at least ``min_words`` words."""
    flat: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            words = WORD.findall(text.lower())
            if len(words) >= max(min_words, size):
                lengths[i] = len(words)
                flat += [hashes[w] for w in words]
    return _runs(np.array(flat, np.uint64), lengths, size)


def _runs(h: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of ``size`` of the words of each text, given by their hashes."""
    if not len(h):
        e = np.empty(0, np.int64)
        return e, e.astype(np.uint64), e
    with np.errstate(over="ignore"):
        g = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            g = mix64(g * np.uint64(3)) + h[k : len(h) - size + 1 + k]
        g = mix64(g)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(g)]
    inside = np.arange(len(g)) + size <= ends[row]
    g, row = g[inside], row[inside]
    bits = np.uint64(len(lengths).bit_length())  # one sort of row and shingle together
    order = np.argsort(row.astype(np.uint64) << np.uint64(64) - bits | g >> bits)
    g, row = g[order], row[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    starts = np.flatnonzero(first)
    return row[starts], g[starts], np.diff(np.append(starts, len(g)))


def probminhash(row: np.ndarray, item: np.ndarray, n_rows: int, registers: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Signatures (n_rows x registers) of the items that win each register.

    Arrivals of an item have rate ``weight`` (1 if not given). All items of all
    rows draw their r-th arrival together; an item stops once its arrival is later
    than the latest register of its row.
    """
    best = np.full((n_rows, registers), np.inf)
    winner = np.zeros((n_rows, registers), np.uint64)
    rate = np.ones(len(item)) if weight is None else weight.astype(np.float64)
    state, at = mix64(item ^ _STEP), np.zeros(len(item))
    flat_best, flat_winner = best.ravel(), winner.ravel()
    while len(item):
        with np.errstate(over="ignore"):
            state = mix64(state + _STEP)
        at = at - np.log(unit_interval(state)) / rate
        with np.errstate(over="ignore"):
            register = (mix64(state ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        cell = row * registers + register
        np.minimum.at(flat_best, cell, at)
        won = flat_best[cell] == at
        flat_winner[cell[won]] = item[won]
        latest = best.max(axis=1)
        go = at < latest[row]
        row, item, rate, state, at = row[go], item[go], rate[go], state[go], at[go]
    return winner


def band_hashes(winner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        w = winner.reshape(len(winner), bands, rows)
        out = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), w.shape[:2]).copy()
        for r in range(rows):
            out = mix64(out * np.uint64(3) + w[:, :, r])
    return out.view(np.int64)


def parity_bitmaps(row: np.ndarray, item: np.ndarray, n_rows: int) -> np.ndarray:
    """(n_rows x BITS / 64): whether a text has an odd number of shingles at each bit.
    Every bit in which two texts differ stands for a shingle they do not share."""
    bit = (item % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(row * BITS + bit, minlength=n_rows * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_rows, BITS), axis=1).view(np.int64)


def probability_jaccard(u: np.ndarray, x: np.ndarray, v: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets, items sorted: the sum over
    common items i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).

    Items sorted by y / x: for those up to i's ratio x_j / x_i is the larger, for the
    others y_j / y_i, so prefix sums give every denominator.
    """
    items = np.union1d(u, v)
    a, b = np.zeros(len(items)), np.zeros(len(items))
    a[np.searchsorted(items, u)], b[np.searchsorted(items, v)] = x, y
    with np.errstate(divide="ignore"):
        ratio = b / a
    order = np.argsort(ratio)
    a, b, ratio = a[order], b[order], ratio[order]
    up_to = np.searchsorted(ratio, ratio, side="right")
    left, right = np.concatenate([[0], np.cumsum(a)])[up_to], b.sum() - np.concatenate([[0], np.cumsum(b)])[up_to]
    both = (a > 0) & (b > 0)
    return float((1 / (left[both] / a[both] + right[both] / b[both])).sum())


def signatures(df: DataFrame, key: str, text: str, min_words: int = 20, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, weighted: bool = False) -> DataFrame:
    """(key, digest, bands, size, bits) of each text with at least ``min_words`` words;
    digest names the exact set of shingles (with their numbers if ``weighted``), size
    is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                row, item, times = batch_shingles(b.column("text").to_pylist(), min_words, shingle)
                if not len(row):
                    continue
                present, dense, counts = np.unique(row, return_inverse=True, return_counts=True)
                sig = band_hashes(probminhash(dense, item, len(present), bands * rows, times if weighted else None), bands, rows)
                ends = np.cumsum(counts)
                digest = [xxhash.xxh3_128_hexdigest(item[e - c : e].tobytes() + (times[e - c : e].tobytes() if weighted else b"")) for e, c in zip(ends, counts)]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel())) for m in (sig, parity_bitmaps(dense, item, len(present)))]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(present)), pa.array(digest), lists[0], pa.array(counts, pa.int32()), lists[1]], names=["key", "digest", "bands", "size", "bits"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, f"key {kind}, digest string, bands array<long>, size int, bits array<long>")


def _band_pairs(entries: DataFrame) -> DataFrame:
    """(low, high) of classes (band, rep) that share a band. A band of very many
    classes is cut into blocks, and every pair of its blocks is a join key of its own."""
    sizes = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BAND_BLOCK).cast("int").alias("blocks"))
    large = stored(sizes.where("blocks > 1"))
    if large.isEmpty():
        left = right = entries.select("band", "rep", F.lit(0).alias("one"), F.lit(0).alias("two"))
    else:
        cut = entries.join(large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
        cut = cut.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", "rep", "side", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"))
        left, right = cut.where("side = one"), cut.where("side = two")
    pairs = left.select("band", "one", "two", F.col("rep").alias("x")).join(right.select("band", "one", "two", F.col("rep").alias("y")), ["band", "one", "two"])
    # within a block both orders come, across blocks only one
    return pairs.where((F.col("x") < F.col("y")) | (F.col("one") != F.col("two"))).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()


def near_duplicate_classes(df: DataFrame, key: str, text: str, threshold: float = 0.6, min_words: int = 20, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives with their similarity, membership).

    Texts with the same shingles form one class, named by its smallest key, so a
    text copied a million times is one record in the search. Null, empty and short
    texts belong to no class. ``weighted`` compares by how often each run of words
    occurs (probability Jaccard) instead of by which runs occur (Jaccard).
    """
    sigs = stored(signatures(df, key, text, min_words, bands, rows, shingle, weighted))
    classes = sigs.groupBy("digest").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    pairs = _band_pairs(classes.select("rep", F.explode("bands").alias("band")))
    if not weighted:
        # texts of a and b shingles at similarity t do not share (1 - t) / (1 + t) (a + b) of them at most
        bounds = {side: classes.select(F.col("rep").alias(side), F.col("size").alias(f"{side}_size"), F.col("bits").alias(f"{side}_bits")) for side in ("low", "high")}
        apart = F.expr("aggregate(zip_with(low_bits, high_bits, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n)")
        possible = apart <= (1 - threshold) / (1 + threshold) * (F.col("low_size") + F.col("high_size")) + 1e-6
        pairs = pairs.join(bounds["low"], "low").join(bounds["high"], "high").where(possible).select("low", "high")
    pairs = stored(pairs)
    wanted = pairs.select(F.explode(F.array("low", "high")).alias("key")).distinct()
    texts = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, "key", "left_semi").dropDuplicates(["key"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def shingles(k: int, t: str) -> tuple[np.ndarray, np.ndarray]:
            if k not in kept:
                if len(kept) > 20_000:
                    kept.clear()
                kept[k] = shingle_hashes([t], hashes, min_words, shingle)[1:]
            return kept[k]

        def similarity(lo: int, x: str, hi: int, y: str) -> float:
            (u, m), (v, n) = shingles(lo, x), shingles(hi, y)
            if weighted:
                return probability_jaccard(u, m, v, n)
            if min(len(u), len(v)) < threshold * max(len(u), len(v)) - 1e-9:
                return 0.0
            both = np.concatenate([u, v])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            return common / (len(both) - common)

        for b in batches:
            idx, sims = [], []
            for i, (lo, hi, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("low", "high", "low_text", "high_text")))):
                s = similarity(lo, x, hi, y)
                if s >= threshold - 1e-9:
                    idx.append(i)
                    sims.append(s)
            at = pa.array(idx, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("low").take(at), b.column("high").take(at), pa.array(sims, pa.float64())], names=["low", "high", "similarity"])

    kind = df.schema[key].dataType.simpleString()
    verified = (
        pairs.join(texts.select(F.col("key").alias("low"), F.col("text").alias("low_text")), "low")
        .join(texts.select(F.col("key").alias("high"), F.col("text").alias("high_text")), "high")
        .mapInArrow(check, f"low {kind}, high {kind}, similarity double")
    )
    members = sigs.select("key", "digest").join(classes.select("digest", "rep"), "digest").select("key", "rep")
    return verified, members


def near_duplicate_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.6, min_words: int = 20, **options) -> DataFrame:
    """(low, high) of all pairs of rows, copies expanded (see ``near_duplicate_classes``)."""
    verified, members = near_duplicate_classes(df, key, text, threshold, min_words, **options)
    within = members.where("key <> rep").select(F.col("rep").alias("low"), F.col("rep").alias("high")).distinct()
    linked = verified.select("low", "high").unionByName(within)
    out = linked.join(members.select(F.col("rep").alias("low"), F.col("key").alias("x")), "low").join(members.select(F.col("rep").alias("high"), F.col("key").alias("y")), "high")
    return out.where((F.col("low") != F.col("high")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))


def connected(links: DataFrame) -> DataFrame:
    """(key, root): smallest key reachable over links (low, high), by alternating
    large-star and small-star steps; each round's links are a table in the shared
    folder. Goes on until a round changes nothing, however many that takes."""
    edges = stored(links.select(F.col("low").alias("u"), F.col("high").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: every neighbour above a node goes to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b")
        old, edges = edges, stored(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        release(links.sparkSession, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("v").alias("key")).agg(F.min("u").alias("root"))


def near_duplicate_groups(df: DataFrame, key: str, text: str, threshold: float = 0.6, min_words: int = 20, **options) -> DataFrame:
    """(key, group_id, n_links, n_copies): one row a document; the group is named by its
    smallest key, n_links counts the other classes a document's class is linked to
    and n_copies the documents of its class, itself included. Texts that are null,
    empty or short have a null group."""
    verified, members = near_duplicate_classes(df, key, text, threshold, min_words, **options)
    verified = stored(verified)
    roots = connected(verified).withColumnRenamed("key", "rep")
    degree = verified.select(F.explode(F.array("low", "high")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    counts = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    out = members.join(counts, "rep").join(roots, "rep", "left").join(degree, "rep", "left").select("key", F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return df.select(F.col(key).alias("key")).distinct().join(out, "key", "left").withColumnRenamed("key", key)
