"""Exhaustive similarity of a query set with all rows, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BLOCK, QUERIES_A_BLOCK = 50_000, 2_000
PAIRS_A_BLOCK = 2_000_000  # where all pairs are returned
AT_ONCE = 256  # queries of one matrix product
BEST_ROWS, BEST_QUERIES, BEST_AT_ONCE = 100_000, 50_000, 64  # the same where a document has several rows


def usable(vector: Column, dim: int) -> Column:
    """Arrays of ``dim`` finite values that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def block_search(rows: DataFrame, queries: DataFrame, row_id: str, row_vector: str, query_id: str, query_vector: str, k: int | None, dim: int, skip_self: bool = True, unit: bool = False) -> DataFrame:
    """(query_id, row_id, sim): for every query the k rows of largest dot product
    (all rows for k = None), at six digits, ties by smaller row id.

    With ``unit`` vectors are brought to unit length first, so that sim is the
    cosine. Rows and queries are cut into blocks of bounded size by a hash of their
    ids; each pair of blocks is one task, in which some queries at a time are
    multiplied with all rows. Vectors that are not usable take no part.
    """
    n_rows, n_queries = rows.count(), queries.count()
    rb, qb = max(1, math.ceil(n_rows / ROWS_A_BLOCK)), max(1, math.ceil(n_queries / (QUERIES_A_BLOCK if k else max(1, PAIRS_A_BLOCK // ROWS_A_BLOCK))))
    # a few more row blocks than needed keep all cores busy
    rb = max(rb, min(8, max(1, n_rows // 2000)))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    r = rows.where(usable(F.col(row_vector), dim)).select(F.col(row_id).alias("rid"), double(row_vector).alias("v"), F.pmod(F.xxhash64(row_id), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    q = queries.where(usable(F.col(query_vector), dim)).select(F.col(query_id).alias("qid"), double(query_vector).alias("v"), F.pmod(F.xxhash64(query_id), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["qid", "rid", "sim"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], b.schema.field("qid").type), pa.array([], a.schema.field("rid").type), pa.array([], pa.float64())], names=names)
        x, y = (np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, dim) for t in (a, b))
        if unit:
            x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        a_id, b_id = a.column("rid").to_numpy(), b.column("qid").to_numpy()
        out = []
        for start in range(0, len(y), AT_ONCE):
            asks = b_id[start : start + AT_ONCE]
            sims = np.round(y[start : start + AT_ONCE] @ x.T, 6)
            if skip_self:
                sims[asks[:, None] == a_id[None, :]] = -np.inf
            few = sims.shape[1] if k is None else min(k, sims.shape[1])
            bar = np.partition(sims, sims.shape[1] - few, axis=1)[:, -few]
            i, j = np.nonzero((sims >= bar[:, None]) & (sims > -np.inf))
            if k is not None:
                order = np.lexsort((a_id[j], -sims[i, j], i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, np.arange(len(sims)))
                keep = np.arange(len(i)) - first[i] < k
                i, j = i[keep], j[keep]
            out.append((asks[i], a_id[j], sims[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    kinds = rows.schema[row_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    found = r.groupBy("qb", "rb").cogroup(q.groupBy("qb", "rb")).applyInArrow(best, f"qid {kinds[1]}, rid {kinds[0]}, sim double")
    if k is None:
        return found
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "rid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def facet_similarity(content: DataFrame, title: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, chunk, document, sim): similarity of a query with a chunk, for the first
    chunk of a document the larger of that with its text and with the title.

    ``content`` has qid, rid (a chunk) and sim, ``title`` qid, rid (a document) and sim,
    ``chunks`` chunk, document and chunk_index.
    """
    rows = content.join(chunks.withColumnRenamed("chunk", "rid"), "rid").select("qid", F.col("rid").alias("chunk"), "document", "chunk_index", "sim")
    titles = title.select("qid", F.col("rid").alias("document"), F.col("sim").alias("_title"))
    both = rows.join(titles, ["qid", "document"], "left")
    return both.select("qid", "chunk", "document", F.when(F.col("chunk_index") == 0, F.greatest("sim", "_title")).otherwise(F.col("sim")).alias("sim"))


def facet_rows(content: DataFrame, titles: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """(skip, document, v): the vectors by which a document is found, those of its chunks
    and, if it has a first chunk, those of its title. A query whose id is ``skip`` does
    not look at the row: it is that chunk, or the only first chunk behind a title.

    ``content`` has chunk and v, ``titles`` document and v, ``chunks`` chunk, document
    and chunk_index. Vectors that are not usable take no part.
    """
    fine = content.where(usable(F.col("v"), dim))
    firsts = chunks.where("chunk_index = 0").join(fine.select("chunk"), "chunk", "left_semi").groupBy("document").agg(F.min("chunk").alias("a"), F.max("chunk").alias("z"))
    named = titles.where(usable(F.col("v"), dim)).join(firsts, "document").select(F.when(F.col("a") == F.col("z"), F.col("a")).alias("skip"), "document", "v")
    return fine.join(chunks.select("chunk", "document"), "chunk").select(F.col("chunk").alias("skip"), "document", "v").unionByName(named)


def best_documents(rows: DataFrame, queries: DataFrame, k: int, dim: int, n_rows: int) -> DataFrame:
    """(qid, document, sim): for every query the k documents of the largest cosine of
    any of their rows, at six digits, ties by smaller document, none last.

    ``rows`` are ``facet_rows``, about ``n_rows``, ``queries`` has qid and v. Blocks are
    as in ``block_search``; of a pair of blocks only the k best documents of each query
    leave the task. No other can be among the k of the query: the row a document is
    best by is in one block, and what is ahead of it there is ahead of it at the end.
    """
    n_queries = queries.count()
    rb, qb = max(1, math.ceil(n_rows / BEST_ROWS), min(24, n_rows // 2000)), max(1, math.ceil(n_queries / BEST_QUERIES))
    r = rows.select("skip", "document", "v", F.pmod(F.xxhash64("document", "skip"), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    q = queries.where(usable(F.col("v"), dim)).select(F.col("qid").alias("ask"), F.col("v").alias("w"), F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))

    def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
        m = np.asarray(vectors.combine_chunks().flatten(), np.float64).reshape(-1, dim)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        kind = a.schema.field("document").type
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], b.schema.field("ask").type), pa.array([], kind), pa.array([], pa.float64())], names=["qid", "document", "sim"])
        # rows by document, in the order in which ties are kept
        a = a.take(pc.sort_indices(a, sort_keys=[("document", "ascending")], null_placement="at_end"))
        code = a.column("document").combine_chunks().dictionary_encode(null_encoding="encode")
        names, place = code.dictionary, code.indices.to_numpy()
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        x, y, asked = matrix(a.column("v")), matrix(b.column("w")), b.column("ask").to_numpy()
        at = np.flatnonzero(a.column("skip").is_valid().to_numpy())
        skip = a.column("skip").drop_null().to_numpy()
        order = np.argsort(skip, kind="stable")
        at, skip = at[order], skip[order]
        few = min(k, len(starts))
        out = []
        for s in range(0, len(y), BEST_AT_ONCE):
            asks = asked[s : s + BEST_AT_ONCE]
            sims = x @ y[s : s + BEST_AT_ONCE].T
            lo, hi = np.searchsorted(skip, asks, "left"), np.searchsorted(skip, asks, "right")
            for i in np.flatnonzero(hi > lo):
                sims[at[lo[i] : hi[i]], i] = -np.inf
            top = np.ascontiguousarray(np.maximum.reduceat(sims, starts, axis=0).T)
            bar = np.round(np.partition(top, top.shape[1] - few, axis=1)[:, -few], 6)
            i, j = np.nonzero(top >= bar[:, None] - 1e-6)
            sim = np.round(top[i, j], 6)
            keep = (sim >= bar[i]) & (sim > -np.inf)
            i, j, sim = i[keep], j[keep], sim[keep]
            order = np.lexsort((j, -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            keep = np.arange(len(i)) - np.searchsorted(i, np.arange(len(asks)))[i] < k
            out.append((asks[i[keep]], j[keep], sim[keep]))
        qid, j, sim = (np.concatenate(c) for c in zip(*out))
        return pa.table([pa.array(qid), names.take(pa.array(j)), pa.array(sim)], names=["qid", "document", "sim"])

    kinds = queries.schema["qid"].dataType.simpleString(), rows.schema["document"].dataType.simpleString()
    found = r.groupBy("qb", "rb").cogroup(q.groupBy("qb", "rb")).applyInArrow(best, f"qid {kinds[0]}, document {kinds[1]}, sim double")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), F.asc_nulls_last("document"))
    return found.groupBy("qid", "document").agg(F.max("sim").alias("sim")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def project_head(rows: DataFrame, vector: str, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: np.ndarray, alpha: float) -> DataFrame:
    """(1 - alpha) x + alpha (W2 gelu(W1 x + b1) + b2), at unit length, as a new column ``projected``."""

    @F.pandas_udf("array<double>")
    def head(v: pd.Series) -> pd.Series:
        x = np.stack(v).astype(np.float64)
        h = x @ w1.T + b1
        h = 0.5 * h * (1 + np.tanh(0.7978845608028654 * (h + 0.044715 * h**3)))
        y = (1 - alpha) * x + alpha * (h @ w2.T + b2)
        return pd.Series(list(y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)))

    return rows.withColumn("projected", head(F.col(vector)))
