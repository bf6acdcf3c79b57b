"""Filling containers of fixed capacity with texts measured in tokens.

Rows are spread at random over shards of a bounded number of rows, and every shard
is packed on its own, largest item first, each into the tightest compatible
container: open containers are ordered by residual room, and a successor search
starting at the item's size walks to larger residuals until one is found that does
not conflict.

Two texts conflict if they are near-duplicates of one another (five-word runs,
similarity 0.8) or come from the same source. Each container carries the set of
the sources and clusters in it. Keeping to both rules may leave containers more
than half empty, as when one source holds a third of all texts. Only what is in such
containers at the end is packed again, first without the rule for sources, then what
is still in containers under half full without any rule; each row says under which
rule it was placed, and ``conflicts`` counts the rows that broke one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import partitions_for, stored
from quarrylake.llm.near_duplicates import near_duplicate_groups
from quarrylake.llm.tokenize import encoder, vocabulary_path

CAPACITY = 2048
ROWS_A_SHARD = 20_000
#: Bands for clusters of similarity 0.8: a pair at 0.8 is missed with probability 0.0002.
CLUSTER = {"threshold": 0.8, "min_words": 5, "shingle": 5, "bands": 12, "rows": 3}
RULES = ("both", "copies", "none")
_OUT = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("container", pa.int64()), ("position", pa.int32()), ("token_start", pa.int64()), ("n_tokens", pa.int32()), ("rule", pa.string()), ("conflict", pa.string())])


def token_sizes(df: DataFrame, key: str, text: str, source: str, vocabulary: str | None = None) -> DataFrame:
    """(key, source, size): tokens of each text. Texts without a token are left out."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                sizes = enc.count_batch(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), pa.array(sizes.astype(np.int64))], names=["key", "source", "size"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(run, "key long, source string, size long").where("size > 0")


class Containers:
    """Open containers by residual room.

    An item has a mark for its source and one for its cluster, a container those of
    its items. So that a frequent source or cluster does not make the
    search walk over all containers that hold it, their number in each room is kept.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # in the order of arrival
        self.rooms = 0  # bit r: some container has r left
        self.marks: list[set[int]] = []
        self.count: dict[tuple[int, int], int] = {}  # (mark, room): containers there with the mark
        self.items: list[list[int]] = []
        self.room: list[int] = []

    def find(self, size: int, marks: tuple[int, ...]) -> tuple[int, int] | None:
        """(room, container) of the tightest container that holds none of the marks."""
        rooms = self.rooms >> size << size
        while rooms:
            room = (rooms & -rooms).bit_length() - 1
            bins = self.by_room[room]
            if all(self.count.get((m, room), 0) < len(bins) for m in marks):
                for b in bins:
                    if self.marks[b].isdisjoint(marks):
                        return room, b
            rooms &= rooms - 1
        return None

    def _move(self, b: int, room: int, step: int) -> None:
        for m in self.marks[b]:
            self.count[m, room] = self.count.get((m, room), 0) + step

    def put(self, item: int, size: int, barred: tuple[int, ...], marks: tuple[int, ...]) -> None:
        """Into a container with none of the ``barred`` marks; it then has the item's marks."""
        at = self.find(size, barred)
        if at is None:
            b, room = len(self.items), self.capacity
            self.items.append([])
            self.marks.append(set())
            self.room.append(room)
        else:
            room, b = at
            self._move(b, room, -1)
            del self.by_room[room][b]
            if not self.by_room[room]:
                self.rooms &= ~(1 << room)
        self.items[b].append(item)
        self.marks[b].update(marks)
        self.room[b] = room = room - size
        if room:
            self.by_room[room][b] = None
            self.rooms |= 1 << room
            self._move(b, room, 1)

    def dissolve(self, which) -> list[int]:
        """The items of the containers that ``which`` tells; these are gone."""
        out: list[int] = []
        for b, items in enumerate(self.items):
            if items and which(items):
                room = self.room[b]
                self._move(b, room, -1)
                del self.by_room[room][b]
                if not self.by_room[room]:
                    self.rooms &= ~(1 << room)
                out += items
                self.items[b] = []
        return out


def fill(sizes: list[int], sources: list[str | None], clusters: list[int | None], capacity: int = CAPACITY) -> tuple[list[list[int]], list[str]]:
    """(containers as lists of item numbers, the rule each item was placed under); no
    size may exceed the capacity.

    A null source is no source, a null cluster no cluster. Items of a cluster with
    more than a twentieth as many items as containers are needed go first, because
    they need so many different containers. See the module for the rules.
    """
    often: dict[tuple[str, object], int] = {}
    names = [(("source", s), ("cluster", c)) for s, c in zip(sources, clusters)]
    for pair in names:
        for name in pair:
            if name[1] is not None:
                often[name] = often.get(name, 0) + 1
    numbers: dict[tuple[str, object], int] = {}
    # what occurs once here cannot conflict
    mark = lambda name: (numbers.setdefault(name, len(numbers)),) if often.get(name, 0) > 1 else ()
    own = [mark(s) + mark(c) for s, c in names]
    few = [mark(c) for _, c in names]
    barred = {"both": own, "copies": few, "none": [()] * len(names)}
    needed = -(-sum(sizes) // capacity)
    heavy = [20 * often.get(c, 0) > needed for _, c in names]
    order = sorted(range(len(sizes)), key=lambda i: (not heavy[i], -sizes[i], i))
    packed, rule_of = Containers(capacity), [RULES[0]] * len(sizes)
    for rule in RULES:
        for i in order:
            rule_of[i] = rule
            packed.put(i, sizes[i], barred[rule][i], own[i])
        order = [] if rule == RULES[-1] else packed.dissolve(lambda items: 2 * sum(sizes[i] for i in items) < capacity)
        order.sort(key=lambda i: (not heavy[i], -sizes[i], i))
    return [items for items in packed.items if items], rule_of


def conflict_of(own: list[int], sources: list[str | None], clusters: list[int | None]) -> list[str]:
    """Of each item of a container what it shares with one before it: 'copy', 'source' or 'none'."""
    seen_sources: set[str] = set()
    seen_clusters: set[int] = set()
    out = []
    for i in own:
        out.append("copy" if clusters[i] in seen_clusters else "source" if sources[i] in seen_sources else "none")
        seen_sources |= {sources[i]} - {None}
        seen_clusters |= {clusters[i]} - {None}
    return out


def pack(df: DataFrame, key: str, text: str, source: str, capacity: int = CAPACITY, vocabulary: str | None = None, shards: int | None = None, rows_a_shard: int = ROWS_A_SHARD) -> DataFrame:
    """(doc_id, part, container, position, token_start, n_tokens, rule, conflict) of
    every text that has a token.

    A text within the capacity has one part. A longer one fills containers of its
    own with full parts, and its rest is packed like any text. ``rule`` is the rule
    it was placed under: 'both', 'copies' (sources may repeat) or 'none';
    ``conflict`` what the row shares with one before it in its container. Null and
    empty texts have no row, an empty table gives none. Keys must be integers;
    repeated keys are packed as rows of their own, extra columns are not read. The
    number of shards follows from the number of rows, so no task holds more than
    about ``rows_a_shard``.
    """
    spark = df.sparkSession
    sized = token_sizes(df, key, text, source, vocabulary)
    groups = near_duplicate_groups(df, key, text, **CLUSTER).where("n_links > 0 or n_copies > 1").select(F.col(key).cast("long").alias("key"), F.col("group_id").cast("long").alias("cluster"))
    rows = stored(sized.join(groups, "key", "left"))
    n = shards or partitions_for(spark, rows.count(), rows_a_shard)
    shard = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(n)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        whole = pa.Table.from_batches(given).sort_by([("shard", "ascending"), ("size", "descending"), ("key", "ascending")])
        numbers = whole.column("shard").to_numpy()
        for number in np.unique(numbers).tolist():
            table = whole.slice(int(np.searchsorted(numbers, number)), int((numbers == number).sum()))
            keys, sizes, sources, clusters = (table.column(c).to_pylist() for c in ("key", "size", "source", "cluster"))
            rest, full = [], []
            for i, size in enumerate(sizes):
                parts, left = divmod(size, capacity)
                if left == 0:
                    parts, left = parts - 1, capacity
                full += [(i, p) for p in range(parts)]
                rest.append(left)
            base = number << 32
            out = [(keys[i], p, base + c, 0, p * capacity, capacity, "both", "none") for c, (i, p) in enumerate(full)]
            bins, rules = fill(rest, sources, clusters, capacity)
            for c, own in enumerate(bins, len(full)):
                for position, (i, conflict) in enumerate(zip(own, conflict_of(own, sources, clusters))):
                    out.append((keys[i], (sizes[i] - rest[i]) // capacity, base + c, position, sizes[i] - rest[i], rest[i], rules[i], conflict))
            for start in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[start : start + 50_000]), _OUT)], schema=_OUT)

    return rows.withColumn("shard", shard).repartition(n, "shard").mapInArrow(run, "doc_id long, part int, container long, position int, token_start long, n_tokens int, rule string, conflict string")


def conflicts(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, fill (share of all room that is used), and how many
    rows share a source or a cluster with one before them in their container."""
    return packed.agg(
        F.count_distinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("n_tokens") / (F.count_distinct("container") * capacity), 6).alias("fill"),
        F.count("*").alias("n_rows"), F.count_if(F.col("conflict") == "source").alias("n_same_source"), F.count_if(F.col("conflict") == "copy").alias("n_copies"),
    )
