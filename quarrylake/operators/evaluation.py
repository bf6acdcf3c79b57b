"""Ranking metrics, mining and scoring of cases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.sources.store import cut


def target_ranks(sims: DataFrame) -> DataFrame:
    """(question, rank): place of the best relevant row among all, from (question, chunk, sim, relevant)."""
    ranked = sims.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("sim"), "chunk")))
    return ranked.where("relevant").groupBy("question").agg(F.min("rank").alias("rank"))


def ranking_metrics(ranks: DataFrame, cuts: tuple[int, ...] = (1, 5, 10, 50)) -> DataFrame:
    """Share of questions within each cut, mean reciprocal rank and lower median rank."""
    tops = [F.round(F.avg((F.col("rank") <= c).cast("double")), 6).alias(f"top{c}") for c in cuts]
    # the lower of two middle values
    median = F.expr("percentile_disc(0.5) within group (order by rank)").cast("long").alias("median_rank")
    return ranks.agg(F.count("*").alias("n"), *tops, F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"), median)


def hard_negatives(sims: DataFrame, few: int = 3) -> DataFrame:
    """(question, chunk, sim, place): the most similar rows that are not relevant."""
    w = Window.partitionBy("question").orderBy(F.desc("sim"), "chunk")
    return sims.where(~F.col("relevant")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= few).select("question", "chunk", "sim", "place")


def grounding(sims: DataFrame, least: float) -> DataFrame:
    """(question, chunk, sim): the best row of each question if it is good enough."""
    best = sims.groupBy("question").agg(F.max_by(F.struct("chunk", "sim"), F.struct(F.col("sim"), -F.col("chunk"))).alias("b"))
    return best.where(F.col("b.sim") >= least).select("question", "b.chunk", "b.sim")


def mined_pairs(near_question: DataFrame, near_answer: DataFrame, share: float = 0.85, few: int = 3) -> DataFrame:
    """(question, positive, negative, place): the row nearest to the answer, with the
    rows near the question whose similarity to the answer is under ``share`` of the
    best. Rows without a similarity to
    the answer count as far from it."""
    best = near_answer.where("arank = 1").select("qid", F.col("rid").alias("positive"), F.col("asim").alias("best"))
    rows = near_question.join(best, "qid").join(near_answer.select("qid", "rid", "asim"), ["qid", "rid"], "left")
    far = rows.where((F.col("rid") != F.col("positive")) & (F.coalesce("asim", F.lit(-1.0)) < share * F.col("best")))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "rid")
    placed = far.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= few)
    return placed.select(F.col("qid").alias("question"), "positive", F.col("rid").alias("negative"), "place")


def contains_any(text: Column, needles: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.exists(needles, lambda n: low.contains(F.lower(n))), F.lit(False))


def case_scores(cases: DataFrame, answer: str, evidence: str) -> DataFrame:
    """Adds ``score`` = 0.45 answer term + 0.35 evidence term + 0.15 nothing
    forbidden + 0.05 usable, and ``passed``: at least 0.85, nothing forbidden and
    usable. An empty list of terms never matches."""
    hit, proof = contains_any(F.col(answer), F.col("answer_must_contain_any")), contains_any(F.col(evidence), F.col("evidence_must_contain_any"))
    bad = contains_any(F.col(answer), F.col("forbidden_any"))
    usable = F.length(F.btrim(F.coalesce(F.col(answer), F.lit("")))) > 0
    score = F.round(0.45 * hit.cast("int") + 0.35 * proof.cast("int") + 0.15 * (~bad).cast("int") + 0.05 * usable.cast("int"), 4)
    return cases.withColumn("score", score).withColumn("passed", (score >= 0.85) & ~bad & usable)


def park_miller_order(n: int, seed: int) -> list[int]:
    """A shuffle of range(n) by swaps drawn from x -> 16807 x mod (2^31 - 1)."""
    x = seed % 2147483647 or 1
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        x = x * 16807 % 2147483647
        j = int((x - 1) / 2147483646 * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def rotating_window(df: DataFrame, key: str, start: int, size: int) -> DataFrame:
    """``size`` rows in the order of the key from place ``start`` on, going round; a sampling operator.

    Places come from one global sort: partition sizes are counted and added up, so
    no single task sees all rows. The sorted rows are written once, because a second
    sort could cut its partitions elsewhere.
    """
    ordered = df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("m", F.monotonically_increasing_id())
    ordered = cut(ordered.select(key, F.shiftright("m", 33).alias("p"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    sizes = sorted((r["p"], r["n"]) for r in ordered.groupBy("p").agg(F.count("*").alias("n")).collect())  # one row a partition
    total = sum(n for _, n in sizes)
    before = np.cumsum([0] + [n for _, n in sizes])[:-1].tolist()
    offsets = df.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(sizes, before)], "p long, o long")
    placed = ordered.join(F.broadcast(offsets), "p")
    return placed.withColumn("turn", F.pmod(F.col("o") + F.col("i") - start, F.lit(max(total, 1)))).where(F.col("turn") < size).select(key, F.col("turn").cast("long").alias("turn"))


def seeded_sample(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """(key, turn): the first ``size`` rows of the seeded shuffle of all rows in the order
    of the key; a sampling operator. The shuffle is a chain of swaps and runs on the
    driver over positions, eight bytes a row; the rows themselves stay where they are."""
    ordered = cut(rotating_window(df, key, 0, 1 << 62))
    picked = park_miller_order(ordered.count(), seed)[:size]
    turns = df.sparkSession.createDataFrame([(p, t) for t, p in enumerate(picked)], "turn long, place long")
    return ordered.join(turns, "turn").select(key, F.col("place").alias("turn"))


def ntuples(cases: DataFrame, negatives: DataFrame, few: int) -> DataFrame:
    """(case, query, positive, negative_1 ...): one row a case with at least ``few``
    negatives (case, negative, place), texts from cases (case, question, answer)."""
    answers = cases.select(F.col("case").alias("negative"), F.col("answer").alias("text"))
    wide = negatives.where(F.col("place") <= few).join(answers, "negative").groupBy("case").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("t"))
    rows = cases.join(wide.where(F.col("n") >= few), "case")
    return rows.select("case", F.col("question").alias("query"), F.col("answer").alias("positive"), *[F.col("t")[i]["text"].alias(f"negative_{i + 1}") for i in range(few)])


def labelled_pairs(cases: DataFrame, negatives: DataFrame) -> DataFrame:
    """(case, query, passage, label): every case with its answer, label 1, and with the
    answers of its negatives, label 0."""
    answers = cases.select(F.col("case").alias("negative"), F.col("answer").alias("passage"))
    wrong = negatives.select("case", "negative").join(answers, "negative").join(cases.select("case", F.col("question").alias("query")), "case").select("case", "query", "passage", F.lit(0.0).alias("label"))
    return cases.select("case", F.col("question").alias("query"), F.col("answer").alias("passage"), F.lit(1.0).alias("label")).unionByName(wrong)


def reranking_samples(cases: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query, positive, negative): arrays of texts for the evaluation of a reranker."""
    answers = cases.select(F.col("case").alias("negative"), F.col("answer").alias("text"))
    wrong = negatives.join(answers, "negative").groupBy("case").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("negative"))
    return cases.join(wrong, "case").select("case", F.col("question").alias("query"), F.array("answer").alias("positive"), "negative")


def golden_check(hits: DataFrame, golden: DataFrame, top: int = 5) -> DataFrame:
    """(name, reason): what is wrong with the hits (name, place, title) of each golden
    query (name, first_title, contains_title, pattern); null if nothing is."""
    titles = hits.where(F.col("place") <= top).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]).alias("titles"))
    rows = golden.join(titles, "name", "left")
    reason = (
        F.when(F.coalesce(F.size("titles"), F.lit(0)) <= 0, "no results")
        .when(F.col("first_title").isNotNull() & (F.col("titles")[0] != F.col("first_title")), "another title is first")
        .when(F.col("contains_title").isNotNull() & ~F.exists("titles", lambda t: F.contains(t, F.col("contains_title"))), "a title is missing")
        .when(F.col("pattern").isNotNull() & ~F.regexp(F.array_join("titles", "\n"), F.concat(F.lit("(?i)"), F.col("pattern"))), "no title has the pattern")
    )
    return rows.select("name", reason.alias("reason"))


def graded_metrics(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 5, 10), longest: int = 100) -> DataFrame:
    """Accuracy, precision and recall at the cuts, MRR@10 and MRR@100, NDCG@10 and MAP@100, averaged over
    the questions of ``relevant`` (question, n_relevant); ``ranked`` has question,
    rank and relevant. A question without any hit counts as 0."""
    hits = ranked.where(F.col("relevant") & (F.col("rank") <= longest)).withColumn("hit_no", F.row_number().over(Window.partitionBy("question").orderBy("rank")))
    log2 = lambda c: F.log(2.0, c)
    per = hits.groupBy("question").agg(
        *[F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in cuts],
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / log2(F.col("rank") + 1))).alias("dcg"), F.sum(F.col("hit_no") / F.col("rank")).alias("ap"),
    )
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / log2(i + 1))
    rows = relevant.where("n_relevant > 0").join(per, "question", "left").fillna(0)
    reciprocal = lambda c: F.when((F.col("first") > 0) & (F.col("first") <= c), 1 / F.col("first")).otherwise(0.0)
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.agg(
        F.count("*").alias("n"), *[mean((F.col(f"h{c}") > 0).cast("double")).alias(f"accuracy{c}") for c in cuts], *[mean(F.col(f"h{c}") / c).alias(f"precision{c}") for c in cuts],
        *[mean(F.col(f"h{c}") / F.col("n_relevant")).alias(f"recall{c}") for c in cuts], mean(F.col("dcg") / best).alias("ndcg10"), mean(F.col("ap") / F.least("n_relevant", F.lit(longest))).alias("map100"),
        mean(reciprocal(10)).alias("mrr10"), mean(reciprocal(100)).alias("mrr100"),
    )
