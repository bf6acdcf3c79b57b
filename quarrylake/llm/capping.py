"""Caps per contributor by exact positions in one global range sort.

The rows are range-sorted on (contributor, score, id). The sort key is unique, so
a contributor that owns a third of the table is cut over as many partitions as
its size asks for. Every partition then reports one summary row (its length, its
first and last contributor, where the last run begins); a prefix sum over those
gives, for each partition, how many rows of its first contributor lie before it.
With that carry each partition knows the exact position of each of its rows
within the contributor, without a join and without a window over one contributor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import checkpointed, shuffle_width


def _run_starts(keys: pa.Array) -> np.ndarray:
    """Indices at which a new key begins, without the first row."""
    if len(keys) < 2:
        return np.empty(0, np.int64)
    changed = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
    return np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, first, last, last_start = 0, None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("k")
        starts = _run_starts(keys)
        head = keys[0].as_py()
        if first is None:
            first = head
        if last is not None and head != last:
            last_start = n
        if len(starts):
            last_start = n + int(starts[-1])
        last = keys[len(keys) - 1].as_py()
        n += b.num_rows
    if n:
        row = {"pid": [TaskContext.get().partitionId()], "n": [n], "first": [first], "last": [last], "last_start": [last_start]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("pid", pa.int32()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("last_start", pa.int64())]))


def carries(summaries: list) -> dict[int, int]:
    """Rows of each partition's first contributor that lie in earlier partitions."""
    out: dict[int, int] = {}
    run_key, run = None, 0
    for s in sorted(summaries, key=lambda r: r["pid"]):
        carry = run if s["first"] == run_key else 0
        out[s["pid"]] = carry
        run_key, run = s["last"], s["n"] - s["last_start"] + (carry if s["last_start"] == 0 else 0)
    return out


def positions(df: DataFrame, contributor: str, score: str, row_id: str, kind: str | None = None, partitions: int | None = None) -> DataFrame:
    """(kind, contributor, row_id, position): position counts from 1 within the
    contributor, highest score first, null scores last, ties by smaller row_id.

    Rows whose contributor is null have no position and are left out. Repeated
    rows count as rows. Other columns are not read. An empty table gives no row.
    """
    kind_col = F.col(kind) if kind else F.lit("")
    rows = df.where(F.col(contributor).isNotNull()).select(
        F.concat_ws("\u0001", F.coalesce(kind_col.cast("string"), F.lit("")), F.col(contributor)).alias("k"), F.col(score).alias("s"), F.col(row_id).alias("id")
    )
    n = partitions or shuffle_width(df.sparkSession)
    ordered = rows.repartitionByRange(n, F.col("k"), F.col("s").desc_nulls_last(), F.col("id")).sortWithinPartitions(F.col("k"), F.col("s").desc_nulls_last(), F.col("id"))
    ordered = checkpointed(ordered.select("k", "id"))
    carry = carries(ordered.mapInArrow(_summaries, "pid int, n long, first string, last string, last_start long").collect())  # one row a partition

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, carry.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("k")
            if key is not None and keys[0].as_py() != key:
                seen = 0
            starts = _run_starts(keys)
            bounds = np.concatenate([[0], starts, [b.num_rows]]).astype(np.int64)
            pos = np.arange(1, b.num_rows + 1, dtype=np.int64) - np.repeat(bounds[:-1], np.diff(bounds))
            pos[: bounds[1]] += seen
            key, seen = keys[b.num_rows - 1].as_py(), int(pos[-1])
            yield pa.RecordBatch.from_arrays([keys, b.column("id"), pa.array(pos)], names=["k", "id", "position"])

    id_type = df.schema[row_id].dataType.simpleString()
    placed = ordered.mapInArrow(place, f"k string, id {id_type}, position long")
    parts = F.split("k", "\u0001", 2)
    return placed.select(parts[0].alias("contributor_kind"), parts[1].alias("contributor"), F.col("id").alias(row_id), "position")


def beyond_cap(df: DataFrame, contributor: str, score: str, row_id: str, cap: int | None = 25, share: float | None = None, kind: str | None = None) -> DataFrame:
    """Rows that a cap leaves out: position above ``cap`` rows, or above
    floor(share * rows of the same kind that have a contributor) where a share is
    given (both: the smaller)."""
    if cap is None and share is None:
        raise ValueError("cap or share is needed")
    placed = positions(df, contributor, score, row_id, kind)
    if share is None:
        return placed.where(F.col("position") > cap)
    name = F.coalesce(F.col(kind).cast("string"), F.lit("")) if kind else F.lit("")
    sizes = df.where(F.col(contributor).isNotNull()).groupBy(name.alias("contributor_kind")).agg(F.floor(F.count("*") * share + 1e-9).alias("_limit"))
    limit = F.col("_limit") if cap is None else F.least("_limit", F.lit(cap))
    return placed.join(sizes, "contributor_kind").where(F.col("position") > limit).drop("_limit")


#: Values of an author field that name nobody.
NOBODY = ["", "anonymous", "[deleted]", "unknown"]


def source_contributor(source):
    """Host of an http(s) URL without 'www.' and port, else the trimmed value, in
    lower case; null for a null or blank value."""
    s = F.lower(F.btrim(source))
    host = F.regexp_extract(s, r"^https?://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.nullif(F.when(host != "", host).otherwise(s), F.lit(""))


def author_contributor(author):
    """Trimmed, inner blanks collapsed, lower case; null for nobody."""
    a = F.lower(F.btrim(F.regexp_replace(author, r"\s+", " ")))
    return F.when(~a.isin(NOBODY), a)


def question_bank_contributors(bank: DataFrame) -> DataFrame:
    """(row_no, score, contributor_kind, contributor), two rows a bank row."""
    kinds = F.array(
        F.struct(F.lit("source").alias("kind"), source_contributor(F.col("source")).alias("who")),
        F.struct(F.lit("author").alias("kind"), author_contributor(F.col("extraction.author")).alias("who")),
    )
    return bank.select("row_no", F.col("extraction.answer_score").alias("score"), F.explode(kinds).alias("c")).select(
        "row_no", "score", F.col("c.kind").alias("contributor_kind"), F.col("c.who").alias("contributor")
    )
