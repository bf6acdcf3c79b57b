"""Usage traces: counts, rates and what follows a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions.scores import percent


def by_tool(events: DataFrame, tool: str) -> DataFrame:
    return events.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("n"))


def rates(events: DataFrame, tool: str, search: str, read: str, assist: str) -> DataFrame:
    """Totals and percentages of searches, reads and assists; an empty total counts as one."""
    total = F.count("*")
    n = lambda name: F.count_if(F.col(tool) == name)
    return events.agg(total.alias("events"), n(search).alias("searches"), n(read).alias("reads"), percent(n(assist), total).alias("assist_rate"), percent(n(search), total).alias("search_rate"))


def search_then_read(events: DataFrame, tool: str, user: str, search: str, read: str) -> DataFrame:
    """Searches whose user also reads at any time (set membership, no time order)."""
    readers = events.where(F.col(tool) == read).select(user).distinct().withColumn("r", F.lit(1))
    joined = events.where(F.col(tool) == search).join(readers, user, "left")
    return joined.agg(F.count("*").alias("searches"), F.count("r").alias("followed"), percent(F.count("r"), F.count("*")).alias("rate"))


def followed_searches(events: DataFrame, tool: str, search: str, read: str, followed: str = "followedReadCandidateIds", read_id: str = "id", result_id: str = "topResultId") -> DataFrame:
    """One row (searches, followed, followed_rate, search_only_rate): searches of which any
    result they name was read (by id, at any time); a hash semi join on the ids."""
    reads = events.where(F.col(tool) == read).select(F.coalesce(read_id, result_id).alias("_id")).where("_id is not null").distinct()
    searches = events.where(F.col(tool) == search).withColumn("_n", F.monotonically_increasing_id())
    hit = searches.select("_n", F.explode(followed).alias("_id")).join(reads, "_id", "left_semi").agg(F.count_distinct("_n").alias("followed"))
    n = searches.agg(F.count("*").alias("searches")).crossJoin(hit)  # one row each
    return n.select("searches", "followed", percent(F.col("followed"), F.col("searches")).alias("followed_rate"), percent(F.col("searches") - F.col("followed"), F.col("searches")).alias("search_only_rate"))


def expansions(events: DataFrame, column: str = "scopeExpansions") -> DataFrame:
    """(kind, scope, n): widened scopes by kind, with a null scope for the kind's total."""
    each = events.select(F.explode(column).alias("e")).select(F.col("e.kind").alias("kind"), F.col("e.requestedScope").alias("scope"))
    return each.rollup("kind", "scope").agg(F.count("*").alias("n"), F.grouping("kind").alias("_k")).where("_k = 0").drop("_k")


def read_after_search(events: DataFrame, tool: str, user: str, at: str, search: str, read: str, within: int = 3600) -> DataFrame:
    """(user, searches, followed): the ordered variant, a read at most ``within`` seconds later.

    Time is cut into spans of that length, so the next read lies in the span of the
    search or in the one after it: a window holds what one user does in one span, and
    a user of very many events is spread over many tasks.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = events.where(F.col(tool).isin(search, read)).select(F.col(user), F.col(tool).alias("_tool"), micros.alias("_at")).withColumn("_span", F.floor(F.col("_at") / (within * 1_000_000)))
    w = Window.partitionBy(user, "_span").orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = rows.withColumn("_next", F.min(F.when(F.col("_tool") == read, F.col("_at"))).over(w)).where(F.col("_tool") == search)
    later = rows.where(F.col("_tool") == read).groupBy(user, (F.col("_span") - 1).alias("_span")).agg(F.min("_at").alias("_later"))
    both = same.join(later, [user, "_span"], "left")
    marked = both.withColumn("follows", F.coalesce(F.least("_next", "_later") - F.col("_at") <= within * 1_000_000, F.lit(False)))
    return marked.groupBy(user).agg(F.count("*").alias("searches"), F.count_if("follows").alias("followed"))


def last_events(events: DataFrame, order: list[Column], most: int) -> DataFrame:
    return events.orderBy(*order).limit(most)


def windowed(events: DataFrame, at: str, tool: str, width: str = "1 hour") -> DataFrame:
    """(start, tool, n) in tumbling windows; for batch and stream alike."""
    return events.groupBy(F.window(at, width).alias("w"), F.col(tool).alias("tool")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "tool", "n")
