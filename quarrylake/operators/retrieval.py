"""Ranking of candidates found by vector search.

Tables are long: one row for each question, perspective and chunk. A question's
perspective 0 is the question itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions.text import let, titled
from quarrylake.functions.scores import round_half_up, sigmoid, upper_median, z_score

RRF_K = 40


def document_scores(sims: DataFrame) -> DataFrame:
    """(question, document, primary, median, best, score) from (question,
    perspective, document, sim): 100 (0.72 primary + 0.18 upper median + 0.10 best)."""
    per = sims.groupBy("question", "document", "perspective").agg(F.max("sim").alias("s"))
    agg = per.groupBy("question", "document").agg(F.max(F.when(F.col("perspective") == 0, F.col("s"))).alias("primary"), upper_median(F.collect_list("s")).alias("median"), F.max("s").alias("best"))
    return agg.withColumn("score", round_half_up(100 * (0.72 * F.col("primary") + 0.18 * F.col("median") + 0.10 * F.col("best")), 5))


def top_passages(sims: DataFrame, most: int = 4) -> DataFrame:
    """(question, document, passages): the ``most`` best chunks of each document, each
    with its best similarity over the perspectives, from (question, perspective,
    document, chunk, sim)."""
    best = sims.groupBy("question", "document", "chunk").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("question", "document").orderBy(F.desc("sim"), "chunk")
    few = best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return few.groupBy("question", "document").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk", "sim"))), lambda x: F.struct(x["chunk"].alias("chunk"), x["sim"].alias("sim"))).alias("passages"))


def perspective_fusion(lists: DataFrame, most: int = 512) -> DataFrame:
    """(question, perspective, chunk, rrf, sim): what each perspective adds to a chunk over its facets."""
    w = Window.partitionBy("question", "perspective", "facet").orderBy(F.desc("sim"), "chunk")
    ranked = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.groupBy("question", "perspective", "chunk").agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("rrf"), F.max("sim").alias("sim"))


def reciprocal_rank_fusion(lists: DataFrame, most: int = 512) -> DataFrame:
    """(question, chunk, rrf, max_sim) from (question, perspective, facet, chunk,
    sim, weight): each list adds weight / (40 + rank)."""
    w = Window.partitionBy("question", "perspective", "facet").orderBy(F.desc("sim"), "chunk")
    ranked = lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.groupBy("question", "chunk").agg(F.sum(F.col("weight") / (RRF_K + F.col("rank"))).alias("rrf"), F.max("sim").alias("max_sim"))


def pool_union(pool: DataFrame, slices: list[tuple[str, int]], most: int = 160) -> DataFrame:
    """(question, chunk, slice, rank, place): the best few by each column of
    ``slices``, in that order; a chunk keeps its first place; at most ``most``."""
    parts = None
    for no, (column, few) in enumerate(slices):
        w = Window.partitionBy("question").orderBy(F.desc_nulls_last(column), "chunk")
        part = pool.select("question", "chunk", F.lit(no).alias("slice"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= few)
        parts = part if parts is None else parts.unionByName(part)
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy("question", "chunk").orderBy("slice", "rank"))).where("n = 1").drop("n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("slice", "rank"))).where(F.col("place") <= most)


def rerank_pool(fused: DataFrame, per: DataFrame, titles: DataFrame, most: int = 160, focus: int = 12, title_cap: int = 96) -> DataFrame:
    """(question, chunk, slice, rank, place): what is worth reranking, a union of slices of
    which a chunk keeps its first place.

    ``fused`` has question, chunk, rrf, max_sim, direct and concise, ``per`` the rows of
    ``perspective_fusion``, ``titles`` question, chunk and logit of reranked titles. In
    order: 12 of each perspective, titles by logit, of concise chunks 6 by rrf, by
    max_sim and by direct, then 24 by rrf, 32 by direct and 32 by max_sim of all.
    """
    at = lambda *keys, by: Window.partitionBy("question", *keys).orderBy(F.desc_nulls_last(by), "chunk")
    top = lambda df, no, column, few: df.select("question", "chunk", F.lit(no).alias("slice"), F.row_number().over(at(by=column)).alias("rank")).where(F.col("rank") <= few)
    parts = per.select("question", "chunk", F.col("perspective").cast("int").alias("slice"), F.row_number().over(at("perspective", by="rrf")).alias("rank")).where(F.col("rank") <= focus)
    short = fused.where("concise")
    for part in (top(titles, 100, "logit", title_cap), top(short, 101, "rrf", 6), top(short, 102, "max_sim", 6), top(short, 103, "direct", 6), top(fused, 104, "rrf", 24), top(fused, 105, "direct", 32), top(fused, 106, "max_sim", 32)):
        parts = parts.unionByName(part)
    first = parts.withColumn("n", F.row_number().over(Window.partitionBy("question", "chunk").orderBy("slice", "rank"))).where("n = 1").drop("n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("slice", "rank"))).where(F.col("place") <= most)


def distinct_by(rows: DataFrame, question: str, identity: Column, order: str) -> DataFrame:
    """The first row of each identity within a question, in order: a chunk, or a topic
    (a document where it has none)."""
    w = Window.partitionBy(question, "_identity").orderBy(order)
    return rows.withColumn("_identity", identity).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_identity")


def perspective_weights(logits: DataFrame) -> DataFrame:
    """(question, perspective, median, spread, weight) from (question, perspective, chunk,
    logit): the middle logit, the root mean square distance from it (0 counts as 1) and
    1 - exp(-(best - middle)), how well a perspective tells chunks apart."""
    values = F.sort_array(F.collect_list("logit"), asc=False)
    stats = logits.groupBy("question", "perspective").agg(values.alias("v")).withColumn("median", F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int")))
    spread = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("median")) * (x - F.col("median"))) / F.size("v"))
    return stats.select("question", "perspective", "median", F.coalesce(F.nullif(spread, F.lit(0.0)), F.lit(1.0)).alias("spread"), (1 - F.exp(-F.greatest(F.lit(0.0), F.col("v")[0] - F.col("median")))).alias("weight"))


def perspective_coverage(logits: DataFrame) -> DataFrame:
    """(question, chunk, perspective, coverage): sigmoid of the logit's distance from the
    middle in spreads, times the perspective's weight."""
    rows = logits.join(perspective_weights(logits), ["question", "perspective"])
    return rows.select("question", "chunk", "perspective", (sigmoid((F.col("logit") - F.col("median")) / F.col("spread")) * F.col("weight")).alias("coverage"))


def consensus(rows: DataFrame) -> DataFrame:
    """Adds ``consensus`` = 1.5 z(direct) + z(rrf) + z(logit) + 0.5 z(title) within
    the question (a missing title adds 0) and ``place``: by consensus, then logit;
    the row of the best logit goes first if it leads the winner by more than 2."""
    q = Window.partitionBy("question")
    scored = rows.withColumn("consensus", F.round(1.5 * z_score(F.col("direct"), q) + z_score(F.col("rrf"), q) + z_score(F.col("logit"), q) + 0.5 * F.coalesce(z_score(F.col("title"), q), F.lit(0.0)), 6))
    order = q.orderBy(F.desc("consensus"), F.desc("logit"), "chunk")
    ranked = scored.withColumn("n", F.row_number().over(order)).withColumn("winner", F.first("logit").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = ranked.withColumn("m", F.row_number().over(q.orderBy(F.desc("logit"), "chunk")))
    promoted = ((F.col("m") == 1) & (F.col("logit") - F.col("winner") > 2)).cast("int")
    return ranked.withColumn("place", F.row_number().over(q.orderBy(promoted.desc(), "n"))).drop("n", "m", "winner")


def support_gate(rows: DataFrame) -> DataFrame:
    """(question, top, logit, agree, topics, supported, confidence) from placed rows
    with logit, direct and topic.

    Supported if the top row's logit is at least 1; or the strongest row has at
    least 1.5, agrees with the top's topic and its direct similarity is at least
    0.75 of the best; or the top has at least -0.9, agrees by 0.9 and two topics
    stand by it.
    """
    q = Window.partitionBy("question")
    row = F.struct("chunk", "logit", "direct", "topic")
    best = rows.withColumn("t", F.min_by(row, "place").over(q)).withColumn("s", F.max_by(row, F.struct(F.col("logit"), -F.col("place"))).over(q)).withColumn("top_direct", F.max("direct").over(q))
    near = (F.col("logit") >= F.greatest(F.col("t.logit") - 0.75, F.lit(-1.5))) & (F.col("direct") >= 0.75 * F.col("t.direct"))
    head = best.withColumn("topics", F.size(F.collect_set(F.when(near, F.col("topic"))).over(q)).cast("long")).where("place = 1")
    share = lambda c: F.when(F.col("top_direct") > 0, c / F.col("top_direct")).otherwise(0.0)
    out = head.select(
        "question", F.col("t.chunk").alias("top"), F.col("t.logit").alias("logit"), F.round(share(F.col("t.direct")), 6).alias("agree"), "topics",
        (F.col("s.logit") >= 1.5).alias("s1"), (share(F.col("s.direct")) >= 0.75).alias("s2"), (F.col("s.topic") == F.col("t.topic")).alias("s3"),
    )
    ok = (F.col("logit") >= 1) | (F.col("s1") & F.col("s2") & F.col("s3")) | ((F.col("logit") >= -0.9) & (F.col("agree") >= 0.9) & (F.col("topics") >= 2))
    out = out.withColumn("supported", ok)
    return out.withColumn("confidence", F.when(~F.col("supported"), "low").when(F.col("logit") >= -2, "high").otherwise("medium")).drop("s1", "s2", "s3")


def scope_expansion(scored: DataFrame, scope: DataFrame, limit: int = 8) -> DataFrame:
    """(question, document, score, place, expanded): results within the asked
    version, or all if another topic outside it scores higher or it holds nothing.

    ``scored`` has question, document, topic, version, score; ``scope`` question
    and version. Scores are computed once and looked at twice.
    """
    rows = scored.join(scope.select("question", F.col("version").alias("asked")), "question").withColumn("inside", F.coalesce(F.col("version") == F.col("asked"), F.lit(False)))
    q = Window.partitionBy("question")
    key = F.struct("score", (-F.col("document")).alias("tie"))
    best = rows.withColumn("in_best", F.max(F.when(F.col("inside"), F.col("score"))).over(q)).withColumn("out_best", F.max(F.when(~F.col("inside"), F.col("score"))).over(q))
    best = best.withColumn("in_topic", F.max_by(F.when(F.col("inside"), F.col("topic")), F.when(F.col("inside"), key)).over(q)).withColumn("out_topic", F.max_by(F.when(~F.col("inside"), F.col("topic")), F.when(~F.col("inside"), key)).over(q))
    expanded = F.coalesce(F.col("in_best").isNull() | ((F.col("out_best") > F.col("in_best")) & (F.col("out_topic") != F.col("in_topic"))), F.lit(False))
    kept = best.withColumn("expanded", expanded).where(F.col("expanded") | F.col("inside"))
    return kept.withColumn("place", F.row_number().over(q.orderBy(F.desc("score"), "document"))).where(F.col("place") <= limit).select("question", "document", "score", "place", "expanded")


def select_responses(rows: DataFrame, picks: int = 3, redundant: float = 0.985, floor: float = 0.0) -> DataFrame:
    """(question, item, pick, lead): greedy choice of the passages of an answer.

    Rows need question, item, document, chunk_index, span, topic, logit, direct, title,
    vector, place, length (of the compacted text) and coverage (an array, by
    perspective). The first pick is the top place, or, if its text is under 120
    characters, of the next eleven places the same document's longer passage that is
    nearly as good. ``lead`` is the first chunk of its document where that is another
    item. Others must be near the first (0.65 of its direct similarity) and good enough
    (logit within 0.9 of the top, coverage 0.35 or title 0.7) and have 20 characters.
    Every next pick maximises 0.50 relevance + 0.20 title + 0.08 novelty + 0.12 gain of
    coverage + 0.10 direct share, unless its topic was seen, it repeats a pick, or,
    from the third on, its logit lies more than 0.15 below the top. A question has a
    bounded pool, so its rows fit one task.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["place", "item"]).reset_index(drop=True)
        v = np.stack(f["vector"]).astype(np.float64)
        logit, direct, length = (f[c].to_numpy(float) for c in ("logit", "direct", "length"))
        title, documents, topics = f["title"].to_numpy(float), f["document"].tolist(), f["topic"].tolist()
        covers = np.stack([np.asarray(c, np.float64) for c in f["coverage"]])
        fine = np.isfinite(title)
        at_title = np.zeros(len(f))
        if fine.any():
            at_title[fine] = np.exp(np.minimum(0, title[fine] - title[fine].max()))
        first = 0
        if length[0] < 120:
            same = [i for i in range(1, min(12, len(f))) if documents[i] == documents[0] and logit[i] >= max(floor, logit[0] - 2.5) and length[i] > length[0] + 80]
            if same:
                first = max(same, key=lambda i: (logit[i] + 0.8 * min(900, length[i]) / 900, -i))
        leads = [i for i in range(len(f)) if documents[i] == documents[first] and f["chunk_index"][i] == 0 and not f["span"][i]]
        lead = leads[0] if leads and leads[0] != first else None
        good = (logit >= max(floor, logit[0] - 0.9)) | (covers.max(axis=1, initial=0.0) >= 0.35) | (at_title >= 0.7)
        may = (direct >= 0.65 * direct[first]) & good & (length >= 20)
        base = 0.50 * np.exp(np.minimum(0, logit - logit[0])) + 0.20 * at_title + 0.10 * (np.clip(direct / direct[first], 0, 1) if direct[first] > 0 else 0 * direct)
        chosen, seen, covered = [first], {topics[first]} - {None, ""}, covers[first].copy()
        nearest = v @ v[first]
        while len(chosen) < picks:
            open_ = may & (nearest < redundant) & np.array([i not in chosen and topics[i] not in seen and (len(chosen) < 2 or logit[i] >= logit[0] - 0.15) for i in range(len(f))])
            if not open_.any():
                break
            gain = np.maximum(0, covers - covered).sum(axis=1) / max(1, covers.shape[1])
            score = np.where(open_, base + 0.08 * (1 - np.clip(nearest, -1, 1)) + 0.12 * gain, -np.inf)
            best = int(np.argmax(score))
            chosen.append(best)
            seen |= {topics[best]} - {None, ""}
            covered = np.maximum(covered, covers[best])
            nearest = np.maximum(nearest, v @ v[best])
        lead_of = [None if lead is None or i != first else f["item"][lead] for i in chosen]
        return pd.DataFrame({"question": f["question"][chosen].to_numpy(), "item": f["item"][chosen].to_numpy(), "pick": range(1, len(chosen) + 1), "lead": pd.Series(lead_of, dtype=object)})

    q, c = (rows.schema[x].dataType.simpleString() for x in ("question", "item"))
    return rows.groupBy("question").applyInPandas(run, f"question {q}, item {c}, pick int, lead {c}")


def coverage_status(supported: Column, evidence: Column, reads: Column) -> Column:
    """complete (two pieces of evidence, one read), partial or thin."""
    return F.when(~supported, "thin").when((evidence >= 2) & (reads >= 1), "complete").otherwise("partial")


#: What is said where nothing supports an answer, and where it comes from another version.
NO_EVIDENCE = "No sufficiently related evidence was found in the corpus."
OTHER_VERSION = "\n\nThis is documented for version {0}; nothing equally relevant was found for version {1}."


def render_answer(fragments: Column, supported: Column, version: Column, asked: Column) -> Column:
    """Fragments (title, body), the first as text and the others as items; a note where
    the first comes from another version than asked for."""
    said = F.transform(F.filter(F.coalesce(fragments, F.array().cast("array<struct<title:string,body:string>>")), lambda f: F.coalesce(f["body"], F.lit("")) != ""), lambda f: titled(F.btrim(F.coalesce(f["title"], F.lit(""))), f["body"]))
    items = lambda s: F.nullif(F.array_join(F.transform(F.slice(s, 2, 100), lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit(""))
    answer = let(said, lambda s: F.when(F.size(s) > 0, F.concat_ws("\n\n", F.get(s, F.lit(0)), items(s))))
    head, middle, tail = (F.lit(x) for x in OTHER_VERSION.replace("{1}", "{0}").split("{0}"))
    note = F.when(asked.isNotNull() & version.isNotNull() & (asked != version), F.concat(head, version, middle, asked, tail)).otherwise("")
    return F.coalesce(F.when(supported, F.concat(answer, note)), F.lit(NO_EVIDENCE))
