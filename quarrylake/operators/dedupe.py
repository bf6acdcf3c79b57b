"""Deduplication, merging and exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.sources.store import cut


def first_per_key(df: DataFrame, key: list, order: list) -> DataFrame:
    """One row a key, the first by ``order``. The window keeps only rank 1, which
    Spark applies before the shuffle, so a hot key sends one row a task."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_key(version: Column, category: Column, topic: Column, url: Column, sha: Column, row_id: Column) -> Column:
    """topic, else url, else sha, else id: what names a document in a corpus."""
    none = F.lit("")
    scope = F.concat_ws(":", F.coalesce(version, none), F.coalesce(category, none))
    useful = F.coalesce(topic, none).rlike("^.+$") & ~F.coalesce(topic, none).rlike("(?i):(topic|ibm|ile|sql|cobol|dds|rpg|cl)$")
    return (
        F.when(useful, F.concat(F.lit("topic:"), scope, F.lit(":"), topic))
        .when(F.coalesce(url, none) != "", F.concat(F.lit("url:"), scope, F.lit(":"), T.normalize_url(url)))
        .when(F.coalesce(sha, none) != "", F.concat(F.lit("sha:"), sha))
        .otherwise(F.concat(F.lit("id:"), row_id))
    )


def corpus_dedupe(docs: DataFrame, priority: Column, order: str) -> DataFrame:
    """One document a key; the lower source priority wins, the earlier on equality."""
    keyed = docs.withColumn("dedupe_key", dedupe_key(F.col("doc_version"), F.col("category"), F.col("canonical_topic_key"), F.col("canonical_url"), F.col("sha256"), F.col("id"))).withColumn("priority", priority)
    return first_per_key(keyed, ["dedupe_key"], ["priority", order])


def unique_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """The second row of an id gets ``-2``, the third ``-3``."""
    n = F.row_number().over(Window.partitionBy(column).orderBy(order))
    return df.withColumn("unique_id", F.when(n == 1, F.col(column)).otherwise(F.concat(F.col(column), F.lit("-"), n.cast("string"))))


def merge_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def exclude_held_out(train: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share none of the keys with a held-out row: one hash anti join a key."""
    for k in keys:
        train = train.join(held.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti")
    return train


def seen_set(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows kept by reading in ``order`` (unique) and dropping a row that shares any
    key with a row kept before. Null keys match nothing.

    Instead of one reader, rounds over the undecided rows: a row that is the first
    of all its keys is kept, and rows that share a key with a kept one are dropped.
    The first undecided row is always decided, so the rounds come to an end, however
    long a chain of rows that share keys is; they go on until every row is decided.
    """
    values = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)]), lambda x: x["v"].isNotNull())
    open_ = df.select(F.col(order).alias("_o"), values.alias("_k"))
    kept = None
    while True:
        each = open_.select("_o", F.explode_outer("_k").alias("k")).select("_o", F.col("k.i").alias("i"), F.col("k.v").alias("v"))
        first = each.where("v is not null").groupBy("i", "v").agg(F.min("_o").alias("f"))
        ahead = each.join(first, ["i", "v"]).where(F.col("_o") != F.col("f")).select("_o").distinct()
        now = cut(open_.join(ahead, "_o", "left_anti"))
        taken = now.select(F.explode("_k").alias("k")).distinct()
        hit = each.where("v is not null").join(taken.select(F.col("k.i").alias("i"), F.col("k.v").alias("v")), ["i", "v"], "left_semi").select("_o").distinct()
        kept = now.select("_o") if kept is None else kept.unionByName(now.select("_o"))
        open_ = cut(open_.join(hit, "_o", "left_anti").join(now.select("_o"), "_o", "left_anti"))
        if open_.isEmpty():
            break
    return df.join(kept.withColumnRenamed("_o", order), order, "left_semi")
