"""Trees of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators.dedupe import first_per_key
from quarrylake.sources.store import cut


# Families of topics by the part of the tree they lie in, in order.
GROUPS = [
    ("ile-rpg", "programming > ile languages > rpg"), ("cl-clle", "programming > control language > cl programming"), ("dds", "programming > dds"),
    ("mensajes-sql", "database > reference > sql messages and codes"), ("sql", "database > reference > sql reference"),
]


def flatten(nodes: DataFrame) -> DataFrame:
    """(id, path, ids, level) of (id, parent, label): one join a level, until none is
    left, whatever the depth; ``ids`` are those of the node and its ancestors, root
    first. A node that is its own ancestor hangs on no root and is left out."""
    found = level = cut(nodes.where("parent is null").select("id", F.array("label").alias("path"), F.array("id").alias("ids"), F.lit(0).alias("level")))
    n = 0
    while True:
        n += 1
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("_p"), F.col("ids").alias("_i"))
        level = cut(nodes.join(above, "parent").select("id", F.concat("_p", F.array("label")).alias("path"), F.concat("_i", F.array("id")).alias("ids"), F.lit(n).alias("level")))
        if level.isEmpty():
            return found
        found = found.unionByName(level)


def in_scope(path: Column, prefixes: list[str], excluded: list[str], patterns: list[str] | None = None, ids: Column | None = None, listed: list | None = None) -> Column:
    """Whether the path or one of its ancestors begins with a prefix or has a pattern, or
    its id or an ancestor's is listed, and no excluded term occurs."""
    joined = T.fold(F.array_join(path, " > "))
    inside = F.lit(False)
    for p in prefixes:
        inside = inside | joined.startswith(p)
    for p in patterns or []:
        inside = inside | joined.rlike(p)
    if ids is not None and listed:
        inside = inside | F.arrays_overlap(ids, F.array(*[F.lit(x) for x in listed]))
    for t in excluded:
        inside = inside & ~joined.contains(t)
    return inside


def topic_group(path: Column, groups: list[tuple[str, str]] = GROUPS, default: str = "others") -> Column:
    """The family of a topic."""
    joined, out = T.fold(F.array_join(path, " > ")), None
    for name, part in groups:
        hit = joined.contains(part)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def distinct_topics(topics: DataFrame, href: str, topic: str, order: str) -> DataFrame:
    """One topic an address, or an id where it has no address, the first by ``order``."""
    keyed = topics.withColumn("_key", F.coalesce(F.nullif(F.col(href), F.lit("")), F.col(topic).cast("string")))
    return first_per_key(keyed, ["_key"], [order]).drop("_key")


def balanced(topics: DataFrame, group: str, order: str, most: int, important: Column | None = None) -> DataFrame:
    """Important topics, then one of each group in turn, ``most`` in all."""
    rows = topics.withColumn("_important", important if important is not None else F.lit(False))
    turn = rows.withColumn("_turn", F.expr(f"row_number() over (partition by _important, {group} order by {order})"))
    return turn.where(F.col("_turn") <= most).orderBy(F.desc("_important"), F.when(F.col("_important"), 0).otherwise(F.col("_turn")), group, order).limit(most).drop("_important", "_turn")
