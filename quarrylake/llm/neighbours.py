"""Most similar vectors: a neighbour graph by NN-descent.

A row of the graph holds one vector, cut to half a byte a dimension, and its list
of up to ``K`` neighbours. Lists start from random partitions of the sphere (three
of them) and a few random rows. Every round of NN-descent then picks, of
each list, some entries that were never picked and some older ones, and lets the
picked rows meet in both directions at the rows that link them: two that meet are
compared unless both are old, and each goes into the other's list if it is closer
than what the list holds. Where very many meet, at a hub, they are split at random
into groups of bounded size, at the largest hubs into tasks first. Rounds go on until fewer than ``SETTLED`` of the lists
change. Equal vectors are one row of the graph, whatever their number.

A list holds ``K`` rows. Rows whose whole list is as similar as asked for may have
more such partners than that; for these there is an exact step, a metric join of
those rows with one another.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import mix64, partitions_for, release, stored

DIM = 64
K = 16
TABLES = 3
CELL = 3000  # vectors a cell of the first lists holds on average
BLOCK = 8_000  # rows of a cell compared at once; larger cells are compared by pairs of blocks
FEW = 6  # of each row's neighbours in a cell that go into its first list
STARTS = 64  # random rows that lists with few entries start from
PICKS, OLD_PICKS = 4, 2  # entries of a list that meet in a round
GROUP = 24  # rows compared with one another at a hub
HEAVY = 50_000  # rows linking to a hub from which they are spread over tasks
COUNTERS = 1 << 15
SLICES = 3  # parts of the rows at which others meet, one after the other, so that a part of the shuffle files is on disk
SETTLED = 0.001
LEAST_ROUNDS = 2  # of a small table a handful of lists decides whether one round was enough
SLACK = 0.07  # four deviations of the cosine of two coded vectors

_log = logging.getLogger(__name__)


def usable(vector: Column, dim: int = DIM) -> Column:
    """Arrays of ``dim`` finite values that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)




def _rotation() -> np.ndarray:
    """A fixed random rotation: it spreads every vector evenly over the dimensions."""
    return np.linalg.qr(np.random.default_rng(29).normal(size=(DIM, DIM)))[0].astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _nibbles(v: np.ndarray) -> np.ndarray:
    r = v.astype(np.float32) @ _rotation()
    q = (np.rint(r / np.abs(r).max(axis=1, keepdims=True) * 7) + 8).astype(np.uint8)
    return q[:, 0::2] << 4 | q[:, 1::2]


def _bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each value, all bytes) of a binary column; a null has none."""
    sizes, parts = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        c = c.fill_null(b"") if c.null_count else c
        _, ends, data = c.buffers()
        if len(c) and data is not None:
            ends = np.frombuffer(ends, np.int32)[c.offset : c.offset + len(c) + 1]
            sizes.append(np.diff(ends).astype(np.int64))
            parts.append(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]])
        else:
            sizes.append(np.zeros(len(c), np.int64))
    return np.concatenate(sizes), np.concatenate(parts)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Codes to unit float rows."""
    raw = _bytes(column)[1].reshape(-1, DIM // 2)
    out = np.empty((len(raw), DIM), np.float32)
    out[:, 0::2], out[:, 1::2] = raw >> 4, raw & 15
    out -= 8
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, code, digest): usable vectors at half a byte a dimension; equal vectors
    of keys that are both even or both odd share a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("v")), DIM), False))
            v = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, DIM) + 0.0
            able = np.isfinite(v).all(axis=1) & v.any(axis=1)  # a null is not finite here
            b, v = b.filter(pa.array(able)), v[able]
            if b.num_rows:
                v /= np.abs(v).max(axis=1, keepdims=True)  # so that no square overflows
                odd = b.column("key").to_numpy() & 1
                digest = [xxhash.xxh3_128_digest(row.tobytes(), seed=int(o)) for row, o in zip(v.astype(np.float32), odd)]
                yield pa.RecordBatch.from_arrays([b.column("key"), _binary(_nibbles(v)), pa.array(digest, pa.binary())], names=["key", "code", "digest"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, "key long, code binary, digest binary")


def copies_of(coded: DataFrame) -> DataFrame:
    """(key, first): rows whose vector another row of a smaller key has as well."""
    often = coded.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    return coded.select("key", "digest").join(often, "digest").where("key <> first").select("key", "first")


# ---- first lists -------------------------------------------------------------------


def planes(tables: int, bits: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, DIM, max(bits, 1))).astype(np.float32)


def _cells(bits: int, tables: int):
    """Every vector once a table in the cell of its signs, its home, and once in the
    cell behind its nearest plane, where it only asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(tables, bits)
        for b in batches:
            if not b.num_rows:
                continue
            x, key = _matrix(b.column("code")), b.column("key").to_numpy()
            for t in range(tables):
                d = x @ p[t]
                cell = ((d > 0) * (1 << np.arange(d.shape[1]))).sum(axis=1) if bits else np.zeros(len(x), np.int64)
                near = cell ^ (1 << np.abs(d).argmin(axis=1))
                for home in (True, False)[: 2 if bits else 1]:
                    place = (t << 40) | ((cell if home else near).astype(np.int64) << 1) | (key & 1)
                    yield pa.RecordBatch.from_arrays([pa.array(place), b.column("key"), b.column("code"), pa.array(np.full(len(x), home))], names=["cell", "key", "code", "home"])

    return run


def _sizes(bits: int, tables: int):
    """(cell, n) of the entries of a batch."""
    cells = _cells(bits, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cells(batches):
            cell, n = np.unique(b.column("cell").to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    return run


def _in_blocks(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds side, one and two to rows with cell and key: a row of a cell of several
    blocks goes to the pairs of its block (``side``) with every block of the cell,
    its own included. ``sizes`` has cell and n."""
    large = stored(sizes.where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if large.isEmpty():
        return placed.select("*", *[F.lit(0).alias(c) for c in ("side", "one", "two")])
    cut = placed.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("side", F.expr("cast(pmod(xxhash64(key), blocks) as int)")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    return cut.select(*placed.columns, "side", F.least("side", "with").alias("one"), F.greatest("side", "with").alias("two"))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows equal in ``by``, of sorted batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        place = np.stack([b.column(c).to_numpy() for c in by], axis=1)
        starts = np.flatnonzero(np.append(True, (place[1:] != place[:-1]).any(axis=1)))
        for a, z in zip(starts, np.append(starts[1:], len(place))):
            here = tuple(place[a])
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _largest(sims: np.ndarray, few: int, lanes: int = 8) -> np.ndarray:
    """Columns of the few largest values of each row. Every ``wide``-th column makes a
    strip; a strip whose maximum is not among the few largest maxima holds none of them."""
    n = sims.shape[1]
    wide = n // lanes
    if wide < 2 * few:
        return np.argpartition(sims, n - few, axis=1)[:, -few:]
    top = sims[:, : wide * lanes].reshape(len(sims), lanes, wide).max(axis=1)
    strips = np.argpartition(top, wide - few, axis=1)[:, -few:]
    columns = (strips[:, :, None] + np.arange(lanes) * wide).reshape(len(sims), -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(wide * lanes, n), (len(sims), n - wide * lanes))], axis=1)
    among = np.take_along_axis(sims, columns, axis=1)
    return np.take_along_axis(columns, np.argpartition(among, among.shape[1] - few, axis=1)[:, -few:], axis=1)


def _within(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair of blocks is compared across, a block with itself in full."""
        for table in _groups(batches, ["cell", "one", "two"]):
            key, side, home = (table.column(c).to_numpy() for c in ("key", "side", "home"))
            one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
            x = _matrix(table.column("code"))
            for asks, given in {(one, two), (two, one)}:
                base, rows = np.flatnonzero(home & (side == given)), np.flatnonzero(side == asks)
                if not len(base) or not len(rows):
                    continue
                own, to = key[base], np.ascontiguousarray(x[base].T)  # keys ascend
                few = min(k, len(base))
                column, best = np.empty((len(rows), few), np.int64), np.empty((len(rows), few), np.float32)
                for s in range(0, len(rows), 200):  # what is compared at once stays in the cache
                    ask = rows[s : s + 200]
                    sims = x[ask] @ to
                    at, end = np.searchsorted(own, key[ask]), np.searchsorted(own, key[ask], side="right")
                    while (here := np.flatnonzero(at < end)).size:
                        sims[here, at[here]] = -2
                        at += 1
                    column[s : s + 200] = c = _largest(sims, few)
                    best[s : s + 200] = np.take_along_axis(sims, c, axis=1)
                keep = best > -1.5  # not the row itself
                yield _rows(key[rows], pa.nulls(len(rows), pa.binary()), np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), own[column[keep]], best[keep], np.ones(int(keep.sum()), bool))

    return run


# ---- lists --------------------------------------------------------------------------

#: A list is one binary value of entries, first bytes first: Arrow and Parquet pass it
#: on as it is, and the bytes that are alike in all entries compress away.
_ENTRY = np.dtype([("other", "<i8"), ("sim", "<f4"), ("fresh", "u1")])
_ROW = "key long, code binary, list binary, picks binary, bar float, changed float"


def _planes(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Of lists of these sizes, one after the other: where the first, second, ... byte of each entry is."""
    begin, n = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    at = begin * (_ENTRY.itemsize - 1) + np.arange(len(n))
    for _ in range(_ENTRY.itemsize):
        yield at
        at = at + n


def _blobs(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, _ENTRY.itemsize)
    out = np.empty(raw.size, np.uint8)
    for i, at in enumerate(_planes(np.diff(offsets))):
        out[at] = raw[:, i]
    ends = (offsets * _ENTRY.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(out)])


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all entries)."""
    sizes, given = _bytes(column)
    sizes = sizes // _ENTRY.itemsize
    raw = np.empty((int(sizes.sum()), _ENTRY.itemsize), np.uint8)
    for i, at in enumerate(_planes(sizes)):
        raw[:, i] = given[at]
    return sizes, raw.view(_ENTRY).reshape(-1)


def _rows(key: np.ndarray, code: pa.Array, offsets: np.ndarray, other: np.ndarray, sim: np.ndarray, fresh: np.ndarray, more: list[pa.Array] | None = None) -> pa.RecordBatch:
    entries = np.empty(len(other), _ENTRY)
    entries["other"], entries["sim"], entries["fresh"] = other, sim, fresh
    none = [pa.nulls(len(key), pa.binary()), pa.nulls(len(key), pa.float32()), pa.nulls(len(key), pa.float32())]
    return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), code, _blobs(offsets, entries), *(more or none)], names=["key", "code", "list", "picks", "bar", "changed"])


def edges(graph: DataFrame, least: float = -2.0) -> DataFrame:
    """(key, other, sim): the entries of all lists that are at least ``least`` similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes, e = _entries(b.column("list"))
                key, at = np.repeat(b.column("key").to_numpy(), sizes), e["sim"] >= least
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(e["other"][at]), pa.array(e["sim"][at])], names=["key", "other", "sim"])

    return graph.select("key", "list").mapInArrow(run, "key long, other long, sim float")


def _best(place: np.ndarray, other: np.ndarray, sim: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar distinct others of each place (a small number),
    by place and falling similarity; of an entry that comes twice the known one.

    One sort of 63-bit numbers: place, similarity to 1e-4, hash of the other, known.
    """
    fall = np.clip(np.rint((1 - sim.astype(np.float64)) * 10_000), 0, 32_767).astype(np.int64)
    mixed = (mix64(other.astype(np.uint64)) >> np.uint64(35)).astype(np.int64)
    number = (((place << 15 | fall) << 29) | mixed) << 1 | ~known
    order = np.argsort(number)
    at, who = place[order], other[order]
    first = np.ones(len(order), bool)
    first[1:] = (at[1:] != at[:-1]) | (who[1:] != who[:-1])
    order = order[first]
    at = place[order]
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    return order[rank < k]


def _found(key: np.ndarray, other: np.ndarray, sim: np.ndarray, k: int = K) -> Iterator[pa.RecordBatch]:
    """Found neighbours as rows without a code, one a key."""
    if len(key):
        keys, place = np.unique(key, return_inverse=True)
        at = _best(place, other, sim, np.zeros(len(key), bool), k)
        ends = np.concatenate([[0], np.cumsum(np.bincount(place[at], minlength=len(keys)))])
        yield _rows(keys, pa.nulls(len(keys), pa.binary()), ends, other[at], sim[at], np.ones(len(at), bool))


def _merge(k: int, number: int):
    """Found neighbours into the lists, and the picks of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b.select(["key", "code", "list"]) for b in batches if b.num_rows]
        if not given:
            return
        t = pa.Table.from_batches(given)
        own = np.flatnonzero(t.column("code").is_valid().to_numpy())
        row_key = t.column("key").to_numpy()
        own = own[np.argsort(row_key[own])]
        keys = row_key[own]
        sizes, entries = _entries(t.column("list"))
        is_own = np.zeros(len(row_key), bool)
        is_own[own] = True
        place, known = np.repeat(np.searchsorted(keys, row_key), sizes), np.repeat(is_own, sizes)
        other, sim, fresh = entries["other"], entries["sim"], entries["fresh"].astype(bool)
        known &= sim > -1  # the random row a list starts from is not compared yet
        at = _best(place, other, sim, known, k)
        place, other, sim, known, fresh = place[at], other[at], sim[at], known[at], fresh[at] | ~known[at]
        changed = np.full(len(keys), -3.0, np.float32)  # similarity of the nearest row that is new in the list
        np.maximum.at(changed, place[~known], sim[~known])
        count = np.bincount(place, minlength=len(keys))
        offsets = np.concatenate([[0], np.cumsum(count)])
        bar = np.full(len(keys), -2.0, np.float32)
        full = count == k
        bar[full] = sim[offsets[1:][full] - 1]
        with np.errstate(over="ignore"):
            dice = mix64(mix64(keys.astype(np.uint64))[place] + other.astype(np.uint64) + mix64(np.array([number], np.uint64)))

        def picked(among: np.ndarray, few: int) -> np.ndarray:
            """At most ``few`` random entries of each list."""
            some = np.flatnonzero(among)
            some = some[np.argsort(place[some] << 45 | (dice[some] >> np.uint64(19)).astype(np.int64))]
            n = np.bincount(place[some], minlength=len(keys))
            rank = np.arange(len(some)) - np.repeat(np.cumsum(n) - n, n)
            return np.sort(some[rank < few])

        new, old = picked(fresh, PICKS), picked(~fresh, OLD_PICKS)
        fresh[new] = False
        some = np.concatenate([new, old])
        is_new = np.arange(len(some)) < len(new)
        some, is_new = some[(by_place := np.argsort(place[some], kind="stable"))], is_new[by_place]
        picks = np.empty(len(some), _ENTRY)
        picks["other"], picks["sim"], picks["fresh"] = other[some], 0, is_new
        ends = np.concatenate([[0], np.cumsum(np.bincount(place[some], minlength=len(keys)))])
        more = [_blobs(ends, picks), pa.array(bar), pa.array(changed)]
        code = t.column("code").combine_chunks().take(pa.array(own))
        whole = _rows(keys, code, offsets, other, sim, fresh, more)
        for start in range(0, len(keys), 50_000):
            yield whole.slice(start, 50_000)

    return run


def _local_joins(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At each row: those that meet there compared with one another."""
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        t = pa.Table.from_batches(given)
        at, task, key, bar = (t.column(c).to_numpy() for c in ("at", "task", "key", "bar"))
        fresh = t.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
        # where very many meet, random parts of them do
        order = np.lexsort((task, at)) if task.any() else np.argsort(at)
        begins = np.append(True, (at[order][1:] != at[order][:-1]) | (task[order][1:] != task[order][:-1]))
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(begins) - 1
        parts = np.maximum(1, -(-(np.bincount(place) - PICKS - OLD_PICKS) // GROUP)).astype(np.uint64)
        with np.errstate(over="ignore"):
            part = mix64(mix64(key.astype(np.uint64)) + np.uint64(number)) % parts[place]
        at = place << 32 | part.astype(np.int64)
        order = np.lexsort((key, at))
        at, key, bar, fresh = at[order], key[order], bar[order], fresh[order]
        x = _matrix(t.column("code"))[order]
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        size = np.diff(np.append(start, len(at)))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(size[size > 1]):
            many = start[size == n]
            step = max(1, 40_000 // int(n))
            for s in range(0, len(many), step):
                rows = many[s : s + step, None] + np.arange(n)
                y = x[rows]
                sims = y @ y.transpose(0, 2, 1)
                k, f = key[rows], fresh[rows]
                ok = (k[:, :, None] != k[:, None, :]) & (f[:, :, None] | f[:, None, :]) & (sims > bar[rows][:, :, None])
                g, i, j = np.nonzero(ok)
                out.append((k[g, i], k[g, j], sims[g, i, j]))
        if out:
            yield from _found(*(np.concatenate(c) for c in zip(*out)))

    return run


def _hubs(graph: DataFrame, heavy: int = HEAVY) -> DataFrame | None:
    """(at, tasks): rows linked by so many others that these are spread over tasks, if
    there are any. Only rows that share one of ``COUNTERS`` too large counters are counted."""
    counter = lambda e: (mix64(e["other"].astype(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)

    def counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for b in batches:
            n += np.bincount(counter(_entries(b.column("picks"))[1]), minlength=COUNTERS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    picks = graph.select("picks")
    summed = lambda run: picks.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > heavy)
    large = np.array([r["at"] for r in summed(counters).select("at").collect()], np.int64)
    if not len(large):
        return None

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = _entries(b.column("picks"))[1]
            at, n = np.unique(e["other"][np.isin(counter(e), large)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    return stored(summed(counts).select("at", F.ceil(F.col("n") / heavy).cast("int").alias("tasks")))


def _meetings(graph: DataFrame, number: int, partitions: int, part: int = 0, parts: int = 1, hubs: DataFrame | None = None) -> DataFrame:
    """(at, task, key, fresh, code, bar): the rows that meet at each row, or at those of
    one of ``parts`` slices. Both ends of a picked entry meet whoever is linked with the
    other end: a row brings its code to those it picked, and to it come the codes of these."""

    def here(at: np.ndarray) -> np.ndarray:
        return np.flatnonzero(mix64(at.astype(np.uint64)) % np.uint64(parts) == part)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes, e = _entries(b.column("picks"))
                some = here(e["other"])
                own = b.select(["key", "code", "bar"]).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)[some]))
                yield pa.RecordBatch.from_arrays([pa.array(e["other"][some]), own.column("key"), pa.array(e["fresh"][some].astype(bool)), own.column("code"), own.column("bar")], names=["at", "key", "fresh", "code", "bar"])

    def forth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                b = b.take(pa.array(here(b.column("key").to_numpy())))
                sizes, e = _entries(b.column("picks"))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("key").to_numpy(), sizes)), pa.array(e["other"]), pa.array(e["fresh"].astype(bool))], names=["at", "key", "fresh"])

    asked = graph.select("key", "picks").mapInArrow(forth, "at long, key long, fresh boolean").join(graph.select("key", "code", "bar").hint("shuffle_hash"), "key")
    met = graph.select("key", "code", "picks", "bar").mapInArrow(back, "at long, key long, fresh boolean, code binary, bar float").unionByName(asked)
    task = F.lit(0)
    if hubs is not None:
        met = met.join(hubs, "at", "left")
        task = F.coalesce(F.expr(f"cast(pmod(xxhash64(key, {number}), tasks) as int)"), task)
    return met.select("at", task.alias("task"), "key", "fresh", "code", "bar").repartition(partitions, "at", "task")


def neighbour_graph(coded: DataFrame, k: int = K, tables: int = TABLES, cell: int = CELL, rounds: int | None = None, near: float = -2.0, log: list | None = None) -> DataFrame:
    """(key, code, list, ...): up to k neighbours of each row of (key, code); ``edges``
    gives them as rows.

    Rows of even and of odd keys are kept apart. ``rounds`` bounds the number of
    rounds (0: first lists only); by default they go on until the lists settle:
    until fewer than ``SETTLED`` of them get a row of at least the similarity ``near``,
    after ``LEAST_ROUNDS`` at least.
    Every round adds (round, lists with such a row, lists that changed, lists) to ``log``.
    """
    spark = coded.sparkSession
    coded = coded.select("key", "code")
    total = coded.count()
    bits = max(0, round(math.log2(max(1, total / cell))))
    n = partitions_for(spark, total, 100_000)
    tables = tables if bits else 1  # one cell: its lists are complete
    placed = coded.mapInArrow(_cells(bits, tables), "cell long, key long, code binary, home boolean")
    sizes = coded.mapInArrow(_sizes(bits, tables), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    placed = _in_blocks(placed, sizes).repartition(n, "cell", "one", "two").sortWithinPartitions("cell", "one", "two", "key")
    lists = placed.mapInArrow(_within(FEW if bits else k), _ROW)
    starts: dict[int, list[int]] = {0: [], 1: []}
    for side in starts:  # a bounded number of keys
        starts[side] = [r["key"] for r in coded.where(F.col("key") % 2 == side).orderBy(F.xxhash64("key"), "key").limit(STARTS).select("key").collect()]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The row itself; its list begins with a random row, to be replaced by any other."""
        for b in batches:
            if b.num_rows:
                key = b.column("key").to_numpy()
                other = np.array([starts[s][d % len(starts[s])] for s, d in zip((key & 1).tolist(), (mix64(key.astype(np.uint64)) >> np.uint64(8)).tolist())], np.int64)
                some = other != key
                yield _rows(key, b.column("code"), np.concatenate([[0], np.cumsum(some)]), other[some], np.full(int(some.sum()), -1.0), np.ones(int(some.sum()), bool))

    held = ("key", "code", "list")  # what a merge reads
    graph = stored(coded.mapInArrow(begin, _ROW).unionByName(lists).select(*held).repartition(n, "key").mapInArrow(_merge(k, 0), _ROW))
    del placed, sizes, lists
    release(spark)
    number = 0
    while bits and (rounds is None or number < rounds):
        number += 1
        met = partitions_for(spark, total * 2 * (PICKS + OLD_PICKS) // SLICES, 600_000)
        found, hubs = [], _hubs(graph)
        for part in range(SLICES):
            found.append(stored(_meetings(graph, number, met, part, SLICES, hubs).mapInArrow(_local_joins(number), _ROW).select(*held)))
            release(spark)
        before, graph = graph, stored(reduce(DataFrame.unionByName, found, graph.select(*held)).repartition(n, "key").mapInArrow(_merge(k, number), _ROW))
        gained, changed = graph.agg(F.count_if(F.col("changed") >= near), F.count_if(F.col("changed") > -3)).first()
        release(spark, before, *found)
        _log.info("round %d: of %d lists %d changed, %d by a row as near as %s", number, total, changed, gained, near)
        if log is not None:
            log.append((number, gained, changed, total))
        if number >= LEAST_ROUNDS and gained < SETTLED * total:
            break
    return graph


# ---- pairs ---------------------------------------------------------------------------


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the vectors x and y of pairs (a, b), in doubles, one dimension after the other."""
    for b in batches:
        if b.num_rows:
            x, y = (np.asarray(b.column(c).flatten(), np.float64).reshape(-1, DIM).T.copy() for c in ("x", "y"))
            dot = lambda p, q: reduce(np.add, (p[i] * q[i] for i in range(DIM)))
            with np.errstate(all="ignore"):
                cosine = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
            known = pa.array(~np.isnan(cosine))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(cosine)], names=["a", "b", "cosine"]).filter(known)


def _exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs of keys of (key, v)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = vectors.where(F.size("v") == DIM).join(wanted, "key", "left_semi")
    both = pairs.join(held.select(F.col("key").alias("a"), F.col("v").alias("x")), "a").join(held.select(F.col("key").alias("b"), F.col("v").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_cosines, "a long, b long, cosine double")


def _metric_join(rows: DataFrame, threshold: float, most_pivots: int = 4096, rows_a_pivot: int = 2000) -> DataFrame:
    """(a, b) of all pairs of rows (key, v) whose cosine is at least ``threshold`` or
    nearly so, exactly: every row belongs to the cell of its nearest pivot and visits
    each cell whose rows may, by the triangle inequality of angles, lie near enough.
    A pair is compared in the smaller of its two cells, a large cell by pairs of blocks.
    """
    spark = rows.sparkSession
    total = rows.count()
    few = rows.orderBy(F.xxhash64("key"), "key").limit(min(most_pivots, math.ceil(total / rows_a_pivot))).collect()
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    pivots = spark.sparkContext.broadcast(unit(np.array([r["v"] for r in few], np.float64)))  # of bounded size
    reach = math.acos(min(1.0, threshold)) + 1e-6

    def angles(b: pa.RecordBatch) -> np.ndarray:
        x = unit(np.asarray(b.column("v").flatten(), np.float64).reshape(-1, DIM))
        return np.arccos(np.clip(x @ pivots.value.T, -1, 1))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a = angles(b)
                yield pa.RecordBatch.from_arrays([pa.array(a.argmin(axis=1)), pa.array(a.min(axis=1))], names=["cell", "radius"])

    radius = np.zeros(len(few))
    for r in rows.mapInArrow(homes, "cell long, radius double").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # one row a pivot
        radius[r["cell"]] = r["radius"]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                a = angles(b)
                home = a.argmin(axis=1)
                r, c = np.nonzero((a <= radius + reach) & (np.arange(len(radius)) <= home[:, None]))
                own = home[r] == c
                yield pa.RecordBatch.from_arrays([pa.array(c * 2 + (b.column("key").to_numpy()[r] & 1)), b.column("key").take(pa.array(r)), b.column("v").take(pa.array(r)), pa.array(own)], names=["cell", "key", "v", "own"])

    placed = rows.mapInArrow(visits, "cell long, key long, v array<float>, own boolean")
    n = partitions_for(spark, total, 20_000)
    placed = _in_blocks(placed, placed.groupBy("cell").agg(F.count("*").alias("n"))).repartition(n, "cell", "one", "two").sortWithinPartitions("cell", "one", "two", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["cell", "one", "two"]):
            key, side = t.column("key").to_numpy(), t.column("side").to_numpy()
            own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
            one, two = t.column("one")[0].as_py(), t.column("two")[0].as_py()
            x = unit(np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, DIM))
            left, right = np.flatnonzero(side == one), np.flatnonzero(side == two)
            for s in range(0, len(left) if len(right) else 0, 1000):
                ask = left[s : s + 1000]
                close = (x[ask] @ x[right].T >= threshold - 1e-6) & (own[ask][:, None] | own[right][None, :])
                if one == two:
                    close &= key[ask][:, None] < key[right][None, :]
                r, c = np.nonzero(close)
                u, v = key[ask[r]], key[right[c]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    return placed.mapInArrow(compare, "a long, b long").distinct()


def similar_pairs(df: DataFrame, key: str, vector: str, kind: str | None = None, threshold: float = 0.9, rounds: int | None = None, log: list | None = None) -> DataFrame:
    """(kind, low, high, cosine) of the pairs whose exact cosine similarity is at
    least ``threshold``: those of the neighbour graph, those between rows whose whole
    list is that similar (all of them, by a metric join), and those of equal vectors.

    ``kind`` (0 or 1) keeps two collections apart. Rows whose vector is null, of
    another length, all zero or not finite take no part. Equal vectors of
    different keys are neighbours like others. Keys are integers; extra columns
    are not read; an empty table gives no pair.
    """
    spark = df.sparkSession
    both = df.select((F.col(key).cast("long") * 2 + (F.col(kind).cast("long") if kind else F.lit(0))).alias("key"), F.col(vector).alias("v"))
    coded = stored(codes(both, "key", "v"))
    copies = stored(copies_of(coded))
    alone = stored(coded.join(copies.select("key"), "key", "left_anti").select("key", "code"))  # read several times
    release(spark, coded)
    graph = neighbour_graph(alone, rounds=rounds, near=threshold - SLACK, log=log)
    links = edges(graph, threshold - SLACK).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
    crowded = graph.where(F.col("bar") >= threshold - SLACK).select("key")
    if not crowded.isEmpty():
        links = links.unionByName(_metric_join(stored(both.join(crowded, "key", "left_semi").select("key", F.transform("v", lambda x: x.cast("float")).alias("v"))), threshold))
    links = stored(links.distinct())
    release(spark)
    found = _exact(links, both).where(F.col("cosine") >= threshold)
    if not copies.isEmpty():
        found = stored(found)
        again = copies.unionByName(copies.select(F.col("first").alias("key"), "first").distinct())
        to_a, to_b = again.select(F.col("key").alias("x"), F.col("first").alias("a")), again.select(F.col("key").alias("y"), F.col("first").alias("b"))
        across = found.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "cosine")
        within = again.select(F.col("key").alias("x"), "first").join(again.select(F.col("key").alias("y"), "first"), "first").where("x < y").select("x", "y", F.lit(1.0).alias("cosine"))
        found = across.unionByName(within.where(F.lit(threshold <= 1))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
    return found.select((F.col("a") % 2).alias("kind"), F.expr("a div 2").alias("low"), F.expr("b div 2").alias("high"), "cosine")


def nearest(df: DataFrame, key: str, vector: str, k: int = 10, every: int = 20, rows_a_block: int = 65_536, queries_a_block: int = 4_096) -> DataFrame:
    """(query_id, id, cosine, rank): the k most similar other rows of every row whose
    key is divisible by ``every``, over all rows.

    Queries and rows are cut into blocks of bounded size by a hash of their keys;
    each pair of blocks is one matrix product in one task, so the result is exact.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where(usable(F.col("v")))
    total, asked = rows.count(), rows.where(F.col("key") % every == 0).count()
    rb, qb = max(1, math.ceil(total / rows_a_block)), max(1, math.ceil(asked / queries_a_block))
    unit = F.transform("v", lambda x: x.cast("float"))
    base = rows.select("key", unit.alias("v"), F.pmod(F.xxhash64("key"), F.lit(rb)).cast("int").alias("rb"))
    left = base.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    asked_rows = rows.where(F.col("key") % every == 0)
    right = asked_rows.select(F.col("key").alias("ask"), unit.alias("w"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        x, y = (np.asarray(c.combine_chunks().flatten(), np.float64).reshape(-1, DIM) for c in (a.column("v"), b.column("w")))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        ids, asks = a.column("key").to_numpy(), b.column("ask").to_numpy()
        out = []
        for start in range(0, len(y), 256):
            sims = y[start : start + 256] @ x.T
            sims[asks[start : start + 256, None] == ids[None, :]] = -2
            sims = np.round(sims, 6)
            few = min(k, sims.shape[1])
            bar = np.partition(sims, sims.shape[1] - few, axis=1)[:, -few]
            r, c = np.nonzero((sims >= bar[:, None]) & (sims > -1.5))
            order = np.lexsort((ids[c], -sims[r, c], r))  # ties by smaller id
            r, c = r[order], c[order]
            first = np.searchsorted(r, np.arange(len(sims)))
            keep = np.arange(len(r)) - first[r] < k
            r, c = r[keep], c[keep]
            out.append((asks[start + r], ids[c], sims[r, c]))
        q, i, s = (np.concatenate(z) for z in zip(*out))
        return pa.table([q, i, s], schema=schema)

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(best, "query_id long, id long, cosine double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by cosine desc, id)"))
    return ranked.where(F.col("rank") <= k)


# ---- graph search --------------------------------------------------------------------


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            sims = np.einsum("ij,ij->i", _matrix(b.column("q_code")), _matrix(b.column("code")))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("other"), pa.array(sims.astype(np.float32))], names=["key", "other", "sim"])


def graph_search(graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 64, hops: int = 8, entries: int = 32) -> DataFrame:
    """(key, other, sim): greedy search of the graph for the queries (key, code).

    A query the graph holds starts at its own list, any other at ``entries`` random
    rows. In each hop the neighbours of those of its best ``beam`` rows that were
    not followed yet are compared with it. Edges are followed in both directions; of
    the edges into a hub as many as a list has are kept. The work of a hop is
    queries x beam x neighbours, whatever the number of rows, and the search ends
    when no query has anything left to follow.
    """
    spark = graph.sparkSession
    out = edges(graph).select("key", "other")
    back = out.select(F.col("other").alias("key"), F.col("key").alias("other")).withColumn("n", F.expr("row_number() over (partition by key order by xxhash64(other))")).where(F.col("n") <= K).drop("n")
    ways = stored(out.unionByName(back).distinct())
    held = graph.select(F.col("key").alias("other"), "code")
    asked = queries.select("key", F.col("code").alias("q_code"))
    total = asked.count()
    n = partitions_for(spark, total * beam, 500_000)
    own = edges(graph.join(asked.select("key"), "key", "left_semi")).select("key", "other")
    lost = asked.select("key").join(graph.select("key"), "key", "left_anti")
    few = [(r["key"] % 2, r["key"]) for side in (0, 1) for r in graph.where(F.col("key") % 2 == side).orderBy(F.xxhash64("key"), "key").limit(entries).select("key").collect()]
    doors = spark.createDataFrame(few, "side long, other long")
    begin = own.unionByName(lost.withColumn("side", F.pmod("key", F.lit(2))).join(F.broadcast(doors), "side").select("key", "other"))  # entries x queries
    score = lambda pairs: pairs.join(held, "other").join(asked, "key").mapInArrow(_score, "key long, other long, sim float")
    rank = F.expr("row_number() over (partition by key order by sim desc, other)")
    state = stored(score(begin.where("key <> other")).withColumn("seen", F.lit(False)).repartition(n, "key").withColumn("rank", rank).where(F.col("rank") <= beam).drop("rank"))
    for _ in range(hops):
        steps = state.where("not seen").select("key", F.col("other").alias("via"))
        if steps.isEmpty():
            break
        reached = steps.join(ways.select(F.col("key").alias("via"), "other"), "via").where("key <> other").select("key", "other").distinct()
        reached = reached.join(state.select("key", "other"), ["key", "other"], "left_anti")
        merged = state.select("key", "other", "sim", F.lit(True).alias("seen")).unionByName(score(reached).withColumn("seen", F.lit(False)))
        before, state = state, stored(merged.repartition(n, "key").withColumn("rank", rank).where(F.col("rank") <= beam).drop("rank"))
        release(spark, before)
    return state.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "other", "sim")


def search(df: DataFrame, key: str, vector: str, k: int = 10, every: int = 20, rounds: int | None = None, beam: int = 64, hops: int = 8) -> DataFrame:
    """(query_id, id, cosine, rank): ``graph_search`` for the rows whose key is divisible
    by ``every``; four times ``k`` rows are found by their codes and ranked exactly.

    Equal vectors are one row of the graph; every one of them is a query and a
    result. Rows whose vector is not usable take no part, an empty table gives no row.
    """
    both = df.select((F.col(key).cast("long") * 2).alias("key"), F.col(vector).alias("v"))
    coded = stored(codes(both, "key", "v"))
    copies = stored(copies_of(coded))
    graph = neighbour_graph(coded.join(copies.select("key"), "key", "left_anti"), rounds=rounds)
    again = copies.unionByName(copies.select(F.col("first").alias("key"), "first").distinct())
    asked = coded.where(F.expr(f"(key div 2) % {every} = 0")).select("key", "code")
    found = stored(graph_search(graph, asked.join(copies.select("key"), "key", "left_anti").unionByName(asked.join(copies.select("key"), "key", "left_semi")), max(4 * k, k), beam, hops).select("key", "other"))
    # the few smallest keys of equal vectors can be in a list of k
    few = again.withColumn("n", F.expr("row_number() over (partition by first order by key)")).where(F.col("n") <= k + 1).drop("n")
    spread = found.join(few.select(F.col("first").alias("other"), F.col("key").alias("copy")), "other", "left").select("key", F.coalesce("copy", "other").alias("other"))
    twins = asked.select("key").join(again, "key").join(few.select("first", F.col("key").alias("other")), "first").select("key", "other")
    pairs = spread.unionByName(twins).where("key <> other").distinct().select(F.col("key").alias("a"), F.col("other").alias("b"))
    scored = _exact(pairs, both).select(F.expr("a div 2").alias("query_id"), F.expr("b div 2").alias("id"), F.round("cosine", 6).alias("cosine"))
    return scored.withColumn("rank", F.expr("row_number() over (partition by query_id order by cosine desc, id)")).where(F.col("rank") <= k)
