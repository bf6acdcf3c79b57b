"""Registered queries over the tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import questions as Q
from quarrylake.functions import scores as S
from quarrylake.functions import text as T
from quarrylake.engine import hashing_embedder
from quarrylake.operators import dedupe, evaluation, html, qabank, quality, retrieval, scoring, structure, toc, trace, vectors
from quarrylake.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return store.table(spark, d, name)


# ---- similarity ---------------------------------------------------------------

DIM, LIST = 64, 512
_SIMS = """WITH sims AS (
  SELECT q.vec_id AS qid, q.label AS q_label, r.vec_id AS rid, r.label AS r_label,
         round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND r.vec_id <> q.vec_id),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS rank FROM sims QUALIFY rank <= 512)"""


def _top(spark: SparkSession, d: str, k: int | None = LIST) -> DataFrame:
    """(qid, rid, sim, rank): queries are all rows whose id is divisible by 20. All
    rows without a rank for k = None; LIST bounds the lists of the fusion only."""
    e = _t(spark, d, "embeddings")
    return vectors.block_search(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", "embedding", k, DIM)


def _labelled(spark: SparkSession, d: str, k: int | None = LIST) -> DataFrame:
    e = _t(spark, d, "embeddings")
    top = _top(spark, d, k)
    return top.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("q_label")), "qid").join(e.select(F.col("vec_id").alias("rid"), F.col("label").alias("r_label")), "rid")


@query(_SIMS + " SELECT qid, rid, sim, rank FROM top WHERE rank <= 10")
def vector_search_topk(spark, d):
    return _top(spark, d, 10).select("qid", "rid", "sim", F.col("rank").cast("long").alias("rank"))


_SIMS_ALL = _SIMS.replace(" QUALIFY rank <= 512", "")  # every row, as scores and ranks look at all

# a question is a label; its query vectors, by id, are its perspectives; every fourth
# row is the first chunk of a document whose title vector is the vector of the next row
_LISTS = _SIMS + """,
ttop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS rank FROM (
  SELECT q.vec_id AS qid, t.vec_id - 1 AS rid, round(list_dot_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND t.vec_id > 0 AND (t.vec_id - 1) % 4 = 0 AND t.vec_id - 1 <> q.vec_id) QUALIFY rank <= 512),
persp AS (SELECT vec_id AS qid, label AS question, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS perspective FROM embeddings WHERE vec_id % 20 = 0),
bo AS (SELECT qid, rid, r_label AS document, sim, rank, 'content' AS facet FROM top UNION ALL SELECT qid, rid, e.label, sim, rank, 'title' FROM ttop JOIN embeddings e ON e.vec_id = rid),
lists AS (SELECT p.question, p.perspective, t.facet, t.rid AS chunk, t.document, t.sim, t.rank, CASE WHEN p.perspective = 0 THEN 1.0 ELSE 0.35 END AS weight FROM bo t JOIN persp p USING (qid)),
fused AS (SELECT question, chunk, round(sum(weight::DOUBLE / (40 + rank)), 9) AS rrf, max(sim) AS max_sim, max(CASE WHEN perspective = 0 AND facet = 'content' THEN sim END) AS direct FROM lists GROUP BY ALL),
per AS (SELECT question, perspective, chunk, round(sum(weight::DOUBLE / (40 + rank)), 9) AS rrf, max(sim) AS sim FROM lists GROUP BY ALL)"""
_LISTS_ALL = _LISTS.replace(" QUALIFY rank <= 512", "")


def _lists(spark: SparkSession, d: str, k: int | None = LIST) -> DataFrame:
    e = _t(spark, d, "embeddings")
    labels = e.select(F.col("vec_id").alias("rid"), F.col("label").alias("document"))
    titles = e.where("vec_id > 0 and (vec_id - 1) % 4 = 0").select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    by_title = vectors.block_search(titles, e.where("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", "embedding", k, DIM)
    both = _top(spark, d, k).select("qid", "rid", "sim", F.lit("content").alias("facet")).unionByName(by_title.select("qid", "rid", "sim", F.lit("title").alias("facet"))).join(labels, "rid")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("question"))
    persp = q.withColumn("perspective", F.expr("row_number() over (partition by question order by qid) - 1").cast("long"))
    return both.join(persp, "qid").select("question", "perspective", "facet", F.col("rid").alias("chunk"), "document", "sim", F.when(F.col("perspective") == 0, 1.0).otherwise(0.35).alias("weight"))


def _fused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(fused rows, rows by perspective), from one search that is kept as a table."""
    lists = store.cut(_lists(spark, d))
    direct = lists.where("perspective = 0 and facet = 'content'").select("question", "chunk", F.col("sim").alias("direct"))
    fused = retrieval.reciprocal_rank_fusion(lists).withColumn("rrf", F.round("rrf", 9)).join(direct, ["question", "chunk"], "left")
    return store.cut(fused), store.cut(retrieval.perspective_fusion(lists).withColumn("rrf", F.round("rrf", 9)))


@query(_LISTS_ALL + """, s AS (SELECT question, document, perspective, max(sim) AS s FROM lists GROUP BY ALL)
SELECT question, document, max(CASE WHEN perspective = 0 THEN s END) AS "primary", list_sort(list(s))[(count(*) // 2)::INT + 1] AS median, max(s) AS best,
  floor((100 * (0.72::DOUBLE * max(CASE WHEN perspective = 0 THEN s END) + 0.18::DOUBLE * list_sort(list(s))[(count(*) // 2)::INT + 1] + 0.10::DOUBLE * max(s))) * 100000.0::DOUBLE + 0.5) / 100000.0::DOUBLE AS score
FROM s GROUP BY question, document""")
def document_score(spark, d):
    return retrieval.document_scores(_lists(spark, d, None))


@query(_LISTS + " SELECT question, chunk, rrf, max_sim, direct FROM fused")
def rrf_fusion(spark, d):
    return _fused(spark, d)[0]


@query(_LISTS + " SELECT question, perspective, chunk, row_number() OVER (PARTITION BY question, perspective ORDER BY rrf DESC, chunk) AS rank FROM per QUALIFY rank <= 12")
def perspective_top(spark, d):
    per = _fused(spark, d)[1]
    return per.withColumn("rank", F.expr("row_number() over (partition by question, perspective order by rrf desc, chunk)").cast("long")).where("rank <= 12").select("question", "perspective", "chunk", "rank")


@query(_LISTS_ALL + """, b AS (SELECT question, document, chunk, max(sim) AS sim FROM lists GROUP BY ALL)
SELECT question, document, row_number() OVER (PARTITION BY question, document ORDER BY sim DESC, chunk) AS place, chunk, sim FROM b QUALIFY place <= 4""")
def document_passages(spark, d):
    top = retrieval.top_passages(_lists(spark, d, None))
    return top.select("question", "document", F.posexplode("passages").alias("n", "p")).select("question", "document", (F.col("n") + 1).cast("long").alias("place"), F.col("p.chunk").alias("chunk"), F.col("p.sim").alias("sim"))


_POOL = _LISTS + """,
tl AS (SELECT question, chunk, round(8 * max_sim - 3, 6) AS logit FROM fused WHERE chunk % 2 = 0),
short AS (SELECT * FROM fused WHERE chunk % 5 = 0),
slices AS (
  SELECT question, chunk, perspective::INT AS slice, row_number() OVER (PARTITION BY question, perspective ORDER BY rrf DESC NULLS LAST, chunk) AS rank FROM per QUALIFY rank <= 12
  UNION ALL SELECT question, chunk, 100, row_number() OVER (PARTITION BY question ORDER BY logit DESC NULLS LAST, chunk) AS rank FROM tl QUALIFY rank <= 96
  UNION ALL SELECT question, chunk, 101, row_number() OVER (PARTITION BY question ORDER BY rrf DESC NULLS LAST, chunk) AS rank FROM short QUALIFY rank <= 6
  UNION ALL SELECT question, chunk, 102, row_number() OVER (PARTITION BY question ORDER BY max_sim DESC NULLS LAST, chunk) AS rank FROM short QUALIFY rank <= 6
  UNION ALL SELECT question, chunk, 103, row_number() OVER (PARTITION BY question ORDER BY direct DESC NULLS LAST, chunk) AS rank FROM short QUALIFY rank <= 6
  UNION ALL SELECT question, chunk, 104, row_number() OVER (PARTITION BY question ORDER BY rrf DESC NULLS LAST, chunk) AS rank FROM fused QUALIFY rank <= 24
  UNION ALL SELECT question, chunk, 105, row_number() OVER (PARTITION BY question ORDER BY direct DESC NULLS LAST, chunk) AS rank FROM fused QUALIFY rank <= 32
  UNION ALL SELECT question, chunk, 106, row_number() OVER (PARTITION BY question ORDER BY max_sim DESC NULLS LAST, chunk) AS rank FROM fused QUALIFY rank <= 32),
firsts AS (SELECT * FROM slices QUALIFY row_number() OVER (PARTITION BY question, chunk ORDER BY slice, rank) = 1),
pool AS (SELECT question, chunk, slice, rank, row_number() OVER (PARTITION BY question ORDER BY slice, rank) AS place FROM firsts QUALIFY place <= 160)"""


def _pool(fused: DataFrame, per: DataFrame) -> DataFrame:
    titles = fused.where("chunk % 2 = 0").select("question", "chunk", F.round(8 * F.col("max_sim") - 3, 6).alias("logit"))
    return retrieval.rerank_pool(fused.withColumn("concise", F.col("chunk") % 5 == 0), per, titles)


@query(_POOL + " SELECT question, chunk, slice, rank, place FROM pool")
def rerank_pool_union(spark, d):
    p = _pool(*_fused(spark, d))
    return p.select("question", "chunk", "slice", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


# scores a reranker would give: a fixed function of the similarity, and titles for even chunks
_SCORED = _POOL + """,
scored AS (SELECT f.question, f.chunk, f.rrf, coalesce(f.direct, 0.0) AS direct, round(10 * f.max_sim - 4 + (f.chunk % 7) * 0.05::DOUBLE, 6) AS logit,
  CASE WHEN f.chunk % 2 = 0 THEN round(8 * f.max_sim - 3, 6) END AS title, e.label AS topic FROM pool JOIN fused f USING (question, chunk) JOIN embeddings e ON e.vec_id = f.chunk),
z AS (SELECT *, round(1.5::DOUBLE * (direct - avg(direct) OVER w) / coalesce(nullif(stddev_pop(direct) OVER w, 0), 1) + (rrf - avg(rrf) OVER w) / coalesce(nullif(stddev_pop(rrf) OVER w, 0), 1)
  + (logit - avg(logit) OVER w) / coalesce(nullif(stddev_pop(logit) OVER w, 0), 1) + 0.5::DOUBLE * coalesce((title - avg(title) OVER w) / coalesce(nullif(stddev_pop(title) OVER w, 0), 1), 0.0), 6) AS consensus
  FROM scored WINDOW w AS (PARTITION BY question)),
n AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY consensus DESC, logit DESC, chunk) AS n, row_number() OVER (PARTITION BY question ORDER BY logit DESC, chunk) AS m FROM z),
placed AS (SELECT question, chunk, direct, rrf, logit, title, topic, consensus, row_number() OVER (PARTITION BY question ORDER BY CASE WHEN m = 1 AND logit - winner > 2 THEN 1 ELSE 0 END DESC, n) AS place
  FROM (SELECT *, max(CASE WHEN n = 1 THEN logit END) OVER (PARTITION BY question) AS winner FROM n))"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    (f, per), e = _fused(spark, d), _t(spark, d, "embeddings")
    rows = _pool(f, per).select("question", "chunk").join(f, ["question", "chunk"]).join(e.select(F.col("vec_id").alias("chunk"), F.col("label").alias("topic")), "chunk")
    return rows.select(
        "question", "chunk", "rrf", F.coalesce("direct", F.lit(0.0)).alias("direct"), F.round(10 * F.col("max_sim") - 4 + (F.col("chunk") % 7) * 0.05, 6).alias("logit"),
        F.when(F.col("chunk") % 2 == 0, F.round(8 * F.col("max_sim") - 3, 6)).alias("title"), "topic",
    )


@query(_SCORED + " SELECT question, chunk, consensus, place FROM placed")
def consensus_zscore(spark, d):
    return retrieval.consensus(_scored(spark, d)).select("question", "chunk", "consensus", F.col("place").cast("long").alias("place"))


@query(_SCORED + """, head AS (SELECT question, arg_min(chunk, place) AS top, arg_min(logit, place) AS logit, arg_min(direct, place) AS direct, arg_min(topic, place) AS topic, max(direct) AS best FROM placed GROUP BY question),
strong AS (SELECT question, logit AS sl, direct AS sd, topic AS st FROM placed QUALIFY row_number() OVER (PARTITION BY question ORDER BY logit DESC, place) = 1),
near AS (SELECT p.question, count(DISTINCT p.topic) AS topics FROM placed p JOIN head h USING (question) WHERE p.logit >= greatest(h.logit - 0.75, -1.5) AND p.direct >= 0.75::DOUBLE * h.direct GROUP BY p.question),
g AS (SELECT question, top, logit, round(CASE WHEN best > 0 THEN direct / best ELSE 0 END, 6) AS agree, coalesce(topics, 0) AS topics, sl, CASE WHEN best > 0 THEN sd / best ELSE 0 END AS sa, st = topic AS same FROM head JOIN strong USING (question) LEFT JOIN near USING (question))
SELECT question, top, logit, agree, topics, (logit >= 1 OR (sl >= 1.5 AND sa >= 0.75 AND same) OR (logit >= -0.9 AND agree >= 0.9 AND topics >= 2)) AS supported,
  CASE WHEN NOT (logit >= 1 OR (sl >= 1.5 AND sa >= 0.75 AND same) OR (logit >= -0.9 AND agree >= 0.9 AND topics >= 2)) THEN 'low' WHEN logit >= -2 THEN 'high' ELSE 'medium' END AS confidence FROM g""")
def support_gate(spark, d):
    return retrieval.support_gate(retrieval.consensus(_scored(spark, d)))


@query(_LISTS_ALL + """, s AS (SELECT question, document, max(sim) AS score, document % 5 AS topic, document % 3 AS version FROM lists GROUP BY question, document),
i AS (SELECT *, version = question % 3 AS inside FROM s),
b AS (SELECT question, max(score) FILTER (inside) AS in_best, max(score) FILTER (NOT inside) AS out_best FROM i GROUP BY question),
it AS (SELECT question, topic AS in_topic FROM i WHERE inside QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, document) = 1),
ot AS (SELECT question, topic AS out_topic FROM i WHERE NOT inside QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, document) = 1),
x AS (SELECT b.question, coalesce(in_best IS NULL OR (out_best > in_best AND out_topic <> in_topic), false) AS expanded FROM b LEFT JOIN it USING (question) LEFT JOIN ot USING (question))
SELECT question, document, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, document) AS place, expanded FROM i JOIN x USING (question) WHERE expanded OR inside QUALIFY place <= 8""")
def version_expansion(spark, d):
    best = _lists(spark, d, None).groupBy("question", "document").agg(F.max("sim").alias("score")).withColumn("topic", F.col("document") % 5).withColumn("version", F.col("document") % 3)
    scope = best.select("question").distinct().withColumn("version", F.col("question") % 3)
    out = retrieval.scope_expansion(best, scope)
    return out.withColumn("place", F.col("place").cast("long"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    """(question, perspective, chunk, logit) of the 48 best chunks of each perspective."""
    per = _fused(spark, d)[1].withColumn("n", F.expr("row_number() over (partition by question, perspective order by rrf desc, chunk)")).where("n <= 48")
    return per.select("question", "perspective", "chunk", F.round(10 * F.col("sim") - 4, 6).alias("logit"))


_LOGITS = _LISTS + """,
lg AS (SELECT question, perspective, chunk, round(10 * sim - 4, 6) AS logit FROM (SELECT *, row_number() OVER (PARTITION BY question, perspective ORDER BY rrf DESC, chunk) AS n FROM per) WHERE n <= 48),
md AS (SELECT question, perspective, list_sort(list(logit), 'DESC')[(count(*) // 2)::INT + 1] AS median, max(logit) AS best FROM lg GROUP BY ALL),
st AS (SELECT m.question, m.perspective, any_value(median) AS median, coalesce(nullif(sqrt(avg((logit - median) * (logit - median))), 0), 1) AS spread, 1 - exp(-greatest(0, any_value(best) - any_value(median))) AS weight FROM md m JOIN lg USING (question, perspective) GROUP BY ALL)"""


@query(_LOGITS + " SELECT question, perspective, round(median, 6) AS median, round(spread, 6) AS spread, round(weight, 6) AS weight FROM st")
def perspective_weights(spark, d):
    w = retrieval.perspective_weights(_logits(spark, d))
    return w.select("question", "perspective", *[F.round(c, 6).alias(c) for c in ("median", "spread", "weight")])


@query(_LOGITS + " SELECT question, perspective, chunk, round(weight / (1 + exp(-(logit - median) / spread)), 6) AS coverage FROM lg JOIN st USING (question, perspective)")
def perspective_coverage(spark, d):
    return retrieval.perspective_coverage(_logits(spark, d)).withColumn("coverage", F.round("coverage", 6))


@query()
def mmr_select(spark, d):
    placed = retrieval.consensus(_scored(spark, d))
    vec = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    cover = retrieval.perspective_coverage(_logits(spark, d)).where("perspective = 0").select("question", "chunk", F.array("coverage").alias("coverage"))
    rows = placed.join(vec, "chunk").join(cover, ["question", "chunk"], "left").withColumn("coverage", F.coalesce("coverage", F.array(F.lit(0.0))))
    rows = rows.select("question", F.col("chunk").alias("item"), F.col("topic").alias("document"), (F.col("chunk") % 4).alias("chunk_index"), F.lit(False).alias("span"), "topic", "logit", "direct", "title", "vector", "place", (20 + F.col("chunk") % 300).alias("length"), "coverage")
    return retrieval.select_responses(rows)


_UNIT = "list_transform({0}, lambda x: x::DOUBLE / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])))"
_FINE = "coalesce(len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0, false)"
_FACETS = f"""WITH q AS (SELECT chunk_id AS qid, {_UNIT.format('vector')} AS v FROM chunk_vectors WHERE {_FINE.format('vector')} AND chunk_id % 100 = 0),
c AS (SELECT v.chunk_id AS chunk, k.document_id AS document, k.chunk_index, {_UNIT.format('v.vector')} AS v FROM chunk_vectors v JOIN chunks k ON k.chunk_id = v.chunk_id WHERE {_FINE.format('v.vector')}),
t AS (SELECT document_id AS document, {_UNIT.format('title_vector')} AS v FROM document_vectors WHERE {_FINE.format('title_vector')}),
ts AS (SELECT qid, document, max(round(list_dot_product(q.v, t.v), 6)) AS sim FROM q, t GROUP BY ALL),
f AS (SELECT qid, chunk, c.document, CASE WHEN chunk_index = 0 THEN greatest(round(list_dot_product(q.v, c.v), 6), ts.sim) ELSE round(list_dot_product(q.v, c.v), 6) END AS sim FROM q JOIN c ON q.qid <> c.chunk LEFT JOIN ts USING (qid, document))"""


def _best_documents(spark: SparkSession, d: str, k: int, among: DataFrame | None = None) -> DataFrame:
    """(qid, document, sim): the k best documents of some chunks by text or title, of all
    documents or of those ``among`` names."""
    v, t = _t(spark, d, "chunk_vectors").select(F.col("chunk_id").alias("chunk"), F.col("vector").alias("v")), _t(spark, d, "document_vectors").select(F.col("document_id").alias("document"), F.col("title_vector").alias("v"))
    chunks = _t(spark, d, "chunks").select(F.col("chunk_id").alias("chunk"), F.col("document_id").alias("document"), "chunk_index")
    if among is not None:
        chunks = chunks.join(among, "document", "left_semi")
    asked = v.where("chunk % 100 = 0").withColumnRenamed("chunk", "qid")
    return vectors.best_documents(vectors.facet_rows(v, t, chunks, DIM), asked, k, DIM, v.count() + t.count())


@query(_FACETS + " SELECT qid, document, max(sim) AS sim FROM f GROUP BY qid, document QUALIFY row_number() OVER (PARTITION BY qid ORDER BY max(sim) DESC, document) <= 10")
def facet_similarity(spark, d):
    """The ten best documents of some chunks, by text or title; all rows are compared."""
    return _best_documents(spark, d, 10)


@query(_FACETS + """, r AS (SELECT id, title, doc_version FROM document_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1), g AS (SELECT id, category FROM document_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1)
SELECT qid, document, round(100 * max(sim), 5) AS score FROM f JOIN g ON g.id = f.document WHERE g.category = 'dds' GROUP BY qid, document QUALIFY row_number() OVER (PARTITION BY qid ORDER BY max(sim) DESC, document) <= 8""")
def search_scope(spark, d):
    """The best documents of one category: all of it is scored, none is cut off before."""
    docs = dedupe.first_per_key(_t(spark, d, "document_records").select(F.col("id").alias("document"), "category", "record_no"), ["document"], ["record_no"]).where("category = 'dds'").select("document")
    return _best_documents(spark, d, 8, docs).select("qid", "document", F.round(100 * F.col("sim"), 5).alias("score"))


_RNG = np.random.default_rng(1)
_W1, _W2 = np.round(_RNG.normal(size=(32, DIM)) / 8, 4), np.round(_RNG.normal(size=(DIM, 32)) / 8, 4)
_WEIGHTS = [str([[float(x) for x in row] for row in m]).replace(" ", "") for m in (_W1, _W2)]
_HEAD = f"""WITH w AS (SELECT {_WEIGHTS[0]}::DOUBLE[][] AS w1, {_WEIGHTS[1]}::DOUBLE[][] AS w2),
h AS (SELECT vec_id, embedding::DOUBLE[] AS x, w2, list_transform(w1, lambda r: list_dot_product(r, embedding::DOUBLE[])) AS a FROM embeddings, w WHERE vec_id % 20 = 0),
g AS (SELECT vec_id, x, w2, list_transform(a, lambda v: 0.5::DOUBLE * v * (1 + tanh(0.7978845608028654::DOUBLE * (v + 0.044715::DOUBLE * v * v * v)))) AS h FROM h),
y AS (SELECT vec_id, list_transform(x, lambda v, i: 0.9::DOUBLE * v + 0.1::DOUBLE * list_dot_product(w2[i], h)) AS y FROM g),
u AS (SELECT vec_id AS qid, list_transform(y, lambda v: v / sqrt(list_dot_product(y, y))) AS u FROM y)
SELECT qid, e.vec_id AS rid, round(list_dot_product(u, e.embedding::DOUBLE[]), 6) AS sim, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(u, e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank FROM u JOIN embeddings e ON e.vec_id <> qid QUALIFY rank <= 10"""


@query(_HEAD)
def query_head_projection(spark, d):
    """A residual head with fixed weights, and the answer's first places under it."""
    e = _t(spark, d, "embeddings")
    q = vectors.project_head(e.where("vec_id % 20 = 0"), "embedding", _W1, np.zeros(32), _W2, np.zeros(DIM), 0.1).select("vec_id", "projected")
    return vectors.block_search(e, q, "vec_id", "embedding", "vec_id", "projected", 10, DIM).select("qid", "rid", "sim", F.col("rank").cast("long").alias("rank"))


@query(_SIMS + " SELECT qid AS question, rid AS chunk, sim FROM top WHERE rank = 1 AND sim >= 0.3")
def grounding_argmax(spark, d):
    return evaluation.grounding(_top(spark, d, 1).select(F.col("qid").alias("question"), F.col("rid").alias("chunk"), "sim"), 0.3)


@query(_SIMS + " SELECT qid AS question, rid AS chunk, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, rid) AS place FROM top WHERE q_label <> r_label QUALIFY place <= 3")
def hard_negatives(spark, d):
    sims = _labelled(spark, d).select(F.col("qid").alias("question"), F.col("rid").alias("chunk"), "sim", (F.col("q_label") == F.col("r_label")).alias("relevant"))
    return evaluation.hard_negatives(sims).withColumn("place", F.col("place").cast("long"))


@query(_SIMS_ALL + """, ranks AS (SELECT qid, min(rank) AS rank FROM top WHERE q_label = r_label GROUP BY qid)
SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS top1, round(avg((rank <= 5)::INT), 6) AS top5, round(avg((rank <= 10)::INT), 6) AS top10, round(avg((rank <= 50)::INT), 6) AS top50,
  round(avg(1.0::DOUBLE / rank), 6) AS mrr, quantile_disc(rank, 0.5) AS median_rank FROM ranks""")
def ir_metrics(spark, d):
    sims = _labelled(spark, d, None).select(F.col("qid").alias("question"), F.col("rid").alias("chunk"), "sim", (F.col("q_label") == F.col("r_label")).alias("relevant"))
    return evaluation.ranking_metrics(evaluation.target_ranks(sims))


# ---- corpus -----------------------------------------------------------------

_VERSIONS = "coalesce(array_to_string(list_sort(list(DISTINCT doc_version) FILTER (doc_version IS NOT NULL)), '|'), '') AS versions"


@query(f"SELECT title, count(*) AS n, {_VERSIONS} FROM document_records GROUP BY title HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return quality.duplicate_titles(_t(spark, d, "document_records"))


_EXACT = "SELECT title, doc_version, category, sha256, count(*) AS n FROM document_records GROUP BY ALL HAVING count(*) > 1"


@query(_EXACT)
def exact_duplicates(spark, d):
    return quality.exact_duplicates(_t(spark, d, "document_records"))


@query(f"SELECT canonical_topic_key, count(*) AS n, count(DISTINCT doc_version) AS n_versions, {_VERSIONS} FROM document_records WHERE coalesce(canonical_topic_key, '') <> '' GROUP BY canonical_topic_key HAVING count(*) > count(DISTINCT doc_version)")
def duplicate_topics(spark, d):
    return quality.duplicate_topics(_t(spark, d, "document_records"))


@query(f"SELECT title, count(*) AS n, count(DISTINCT doc_version) AS n_versions FROM document_records WHERE coalesce(title NOT IN (SELECT title FROM ({_EXACT}) WHERE doc_version IS NOT NULL AND title IS NOT NULL), true) GROUP BY title HAVING count(*) > 1 AND count(DISTINCT doc_version) > 1")
def cross_version_duplicates(spark, d):
    return quality.expected_duplicates(_t(spark, d, "document_records"))


_KEY = """CASE WHEN coalesce(canonical_topic_key, '') <> '' AND NOT regexp_matches(canonical_topic_key, '(?i):(topic|ibm|ile|sql|cobol|dds|rpg|cl)$') THEN 'topic:' || coalesce(doc_version, '') || ':' || coalesce(category, '') || ':' || canonical_topic_key
 WHEN coalesce(canonical_url, '') <> '' THEN 'url:' || coalesce(doc_version, '') || ':' || coalesce(category, '') || ':' || lower(regexp_replace(regexp_replace(regexp_replace(canonical_url, '#.*$', '', 'g'), '(?i)[?&]view=kc.*$', '', 'g'), '/+$', '', 'g'))
 WHEN coalesce(sha256, '') <> '' THEN 'sha:' || sha256 ELSE 'id:' || id END"""


@query(f"SELECT record_no, dedupe_key FROM (SELECT record_no, {_KEY} AS dedupe_key, CASE WHEN source_kind LIKE 'manual%' THEN 0 ELSE 1 END AS priority FROM document_records) QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY priority, record_no) = 1")
def corpus_dedupe(spark, d):
    priority = F.when(F.col("source_kind").like("manual%"), 0).otherwise(1)
    return dedupe.corpus_dedupe(_t(spark, d, "document_records"), priority, "record_no").select("record_no", "dedupe_key")


def _count_by(name: str, column: str) -> None:
    QUERIES[name] = lambda spark, d: quality.count_by(_t(spark, d, "document_records"), column)
    SQL[name] = f"SELECT {column} AS value, count(*) AS n FROM document_records GROUP BY 1"


for _name, _column in (("count_by_category", "category"), ("count_by_version", "doc_version"), ("count_by_source_kind", "source_kind"), ("count_by_document_kind", "document_kind"), ("count_by_lang", "lang")):
    _count_by(_name, _column)


@query("SELECT DISTINCT source FROM documents")
def distinct_sources(spark, d):
    return _t(spark, d, "documents").select("source").distinct()


@query("WITH b AS (SELECT greatest(20, floor(count(*) * 0.05))::BIGINT AS bar FROM document_records), c AS (SELECT category, count(*) AS n FROM document_records GROUP BY 1) SELECT category, n, bar FROM c, b WHERE n < bar")
def sparse_categories(spark, d):
    return quality.sparse_categories(_t(spark, d, "document_records"), 20, 0.05)


@query("SELECT category, count(*) AS n FROM document_records GROUP BY 1 HAVING count(*) >= 50")
def substantial_categories(spark, d):
    return _t(spark, d, "document_records").groupBy("category").agg(F.count("*").alias("n")).where("n >= 50")


@query(f"""WITH b AS (SELECT count(*) AS total, count(*) FILTER (text_length < 300) AS short, count(*) FILTER (document_kind = 'stub') AS stub FROM document_records),
s AS (SELECT count(*) FILTER (n >= 20) AS substantial FROM (SELECT category, count(*) AS n FROM document_records GROUP BY 1)), t AS (SELECT count(*) AS twice FROM ({_EXACT})),
o AS (SELECT * FROM b, s, t), r AS (SELECT 'documents' AS name, total::DOUBLE AS actual, 500.0::DOUBLE AS threshold, 'gte' AS operator FROM o UNION ALL SELECT 'exact_duplicates', twice::DOUBLE, 0.0, 'eq' FROM o
UNION ALL SELECT 'substantial_categories', substantial::DOUBLE, 5.0, 'gte' FROM o UNION ALL SELECT 'stub_rate', stub / total, 0.05, 'lte' FROM o UNION ALL SELECT 'short_rate', short / total, 0.05, 'lte' FROM o)
SELECT name, round(actual, 6) AS actual, threshold, operator, CASE operator WHEN 'gte' THEN actual >= threshold WHEN 'lte' THEN actual <= threshold ELSE actual = threshold END AS ok FROM r""")
def quality_gate(spark, d):
    return quality.quality_gate(_t(spark, d, "document_records"))


@query("SELECT category, source_kind, doc_version, document_kind, grouping(category, source_kind, doc_version, document_kind)::INT AS g, count(*) AS n FROM document_records GROUP BY GROUPING SETS ((category), (source_kind), (doc_version), (document_kind), ())")
def coverage(spark, d):
    return quality.coverage(_t(spark, d, "document_records"))


@query("SELECT record_no, doc_version FROM document_records WHERE coalesce(doc_version, '') NOT IN ('7.3', '7.4', '7.5', '7.6')")
def version_anomalies(spark, d):
    return _t(spark, d, "document_records").where(~F.coalesce("doc_version", F.lit("")).isin("7.3", "7.4", "7.5", "7.6")).select("record_no", "doc_version")


@query("SELECT record_no, title, text_length FROM document_records WHERE text_length < 300")
def short_documents(spark, d):
    return _t(spark, d, "document_records").where("text_length < 300").select("record_no", "title", "text_length")


@query("""SELECT 'documents_without_chunks' AS metric, count(*) AS n FROM document_records r WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = r.id)
UNION ALL SELECT 'chunks_without_vectors', count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.chunk_id = c.chunk_id)
UNION ALL SELECT 'documents_without_vectors', count(*) FROM document_records r WHERE NOT EXISTS (SELECT 1 FROM document_vectors v WHERE v.document_id = r.id)""")
def vector_coverage(spark, d):
    return quality.vector_coverage(*(_t(spark, d, n) for n in ("document_records", "chunks", "chunk_vectors", "document_vectors")))


@query("SELECT c.chunk_id, c.document_id, c.chunk_index, d.doc_id, r.record_no, r.title, r.doc_version FROM chunks c JOIN chunk_vectors v USING (chunk_id) JOIN document_vectors d ON d.document_id = c.document_id JOIN (SELECT * FROM document_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1) r ON r.id = c.document_id")
def enriched_candidates(spark, d):
    first = dedupe.first_per_key(_t(spark, d, "document_records").select("id", "record_no", "title", "doc_version"), ["id"], ["record_no"])
    v = _t(spark, d, "chunk_vectors").select("chunk_id")
    dv = _t(spark, d, "document_vectors").select("document_id", "doc_id")
    return _t(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index").join(v, "chunk_id").join(dv, "document_id").join(first.withColumnRenamed("id", "document_id"), "document_id")


@query("""WITH k AS (SELECT DISTINCT canonical_topic_key AS t, id FROM document_records WHERE coalesce(canonical_topic_key, '') <> '')
SELECT a.id, b.id AS related, row_number() OVER (PARTITION BY a.id, a.t ORDER BY b.id) AS rank FROM k a JOIN k b ON a.t = b.t AND a.id <> b.id QUALIFY rank <= 5""")
def related_documents(spark, d):
    out = structure.neighbours_by_topic(_t(spark, d, "document_records"), "canonical_topic_key", "id")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT record_no, normalized_text_path FROM document_records WHERE normalized_text_path IS NOT NULL AND NOT regexp_matches(normalized_text_path, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$)')")
def safe_paths(spark, d):
    return _t(spark, d, "document_records").where(T.is_safe_relative(F.col("normalized_text_path"))).select("record_no", "normalized_text_path")


@query("SELECT id, registry_kind, host FROM source_registry WHERE lower(coalesce(license_status, 'unknown')) NOT IN ('restricted', 'unknown') AND NOT coalesce(dev_only, false)")
def licensed_sources(spark, d):
    return store.licensed(_t(spark, d, "source_registry")).select("id", "registry_kind", "host")


@query("""WITH t AS (SELECT record_no, category, record_no % 97 = 0 AS i, row_number() OVER (PARTITION BY record_no % 97 = 0, category ORDER BY record_no) AS turn FROM document_records)
SELECT record_no FROM t ORDER BY i DESC, CASE WHEN i THEN 0 ELSE turn END, category NULLS FIRST, record_no LIMIT 100""")
def round_robin_balance(spark, d):
    """A hundred records: some important ones, then one of each category in turn."""
    r = _t(spark, d, "document_records").select("record_no", "category")
    return toc.balanced(r, "category", "record_no", 100, F.col("record_no") % 97 == 0).select("record_no")


# ---- text -------------------------------------------------------------------

_WS = r"[ \t\n\r\f\x{0B}\x{A0}\x{FEFF}]"


def _fold_sql(column: str) -> str:
    return f"trim(regexp_replace({_plain_sql(column)}, '{_WS}+', ' ', 'g'), ' ')"


def _plain_sql(column: str) -> str:
    return rf"regexp_replace(translate(lower({column}), '{T.ACCENTED}', '{T.PLAIN}'), '\p{{M}}+', '', 'g')"


def _clean_sql(column: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({column}, ''), '[\x{{200B}}\x{{FEFF}}]', '', 'g'), '[“”]', '"', 'g'), '[‘’]', '''', 'g'), '{_WS}+', ' ', 'g'), ' ')"""


def _q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"



@query(r"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r', chr(10), 'g'), '[\t\f\x{0B} ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))) AS sha FROM documents WHERE text IS NOT NULL""")
def collapse_whitespace(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(T.collapse_whitespace(F.col("text")), 256).alias("sha"))


@query("SELECT doc_id, CASE WHEN length(trim(substr(c, 1, 240), ' ')) < length(c) THEN trim(substr(c, 1, 240), ' ') || '…' ELSE trim(substr(c, 1, 240), ' ') END AS snippet FROM (SELECT doc_id, trim(translate(text, chr(13) || chr(10) || chr(9), '   '), ' ') AS c FROM documents WHERE text IS NOT NULL)")
def snippet(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(f"SELECT record_no, coalesce(nullif(substr(regexp_replace(regexp_replace({_fold_sql('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90), ''), 'item') AS slug FROM document_records")
def title_slug(spark, d):
    return _t(spark, d, "document_records").select("record_no", T.slug(F.col("title")).alias("slug"))


@query("SELECT doc_id, sha256(trim(text, ' ')) AS sha, substr(sha256(trim(text, ' ')), 1, 16) AS short, ceil(length(text) / 4)::INT AS token_hint FROM documents WHERE text IS NOT NULL")
def text_fingerprint(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.fingerprint(t).alias("sha"), T.fingerprint(t, 16).alias("short"), T.token_hint(t).alias("token_hint"))


@query(f"SELECT case_no, sha256({_fold_sql('question')} || chr(10) || {_fold_sql('answer')}) AS signature FROM qa_cases WHERE question IS NOT NULL AND answer IS NOT NULL")
def pair_signature(spark, d):
    return _t(spark, d, "qa_cases").where("question is not null and answer is not null").select("case_no", T.pair_signature(F.col("question"), F.col("answer")).alias("signature"))


@query("SELECT record_no, 'normalized/' || substr(regexp_replace(coalesce(nullif(sha256, ''), id), '[^a-fA-F0-9]', '', 'g'), 1, 24) || '.txt' AS path FROM document_records")
def portable_path(spark, d):
    return _t(spark, d, "document_records").select("record_no", T.portable_path(F.col("sha256"), F.col("id")).alias("path"))


@query("SELECT record_no, lower(regexp_replace(regexp_replace(regexp_replace(original_url, '#.*$', '', 'g'), '(?i)[?&]view=kc.*$', '', 'g'), '/+$', '', 'g')) AS url FROM document_records WHERE original_url IS NOT NULL")
def url_normalize(spark, d):
    return _t(spark, d, "document_records").where("original_url is not null").select("record_no", T.normalize_url(F.col("original_url")).alias("url"))


@query(r"SELECT record_no, nullif(trim(regexp_replace(trim(doc_version), '(?i)^(?:release|version|v)[ \t\n\r\f]*', '')), '') AS version FROM document_records WHERE doc_version IS NOT NULL")
def version_normalize(spark, d):
    c = T.normalize_version(F.col("doc_version"), r"(?i)^(?:release|version|v)[ \t\n\r\f]*")
    return _t(spark, d, "document_records").where("doc_version is not null").select("record_no", c.alias("version"))


def _rules_sql(column: str, rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '(?i){p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


@query(f"SELECT section_id, {_rules_sql('title', T.SECTION_KINDS, 'generic')} AS kind FROM document_sections WHERE title IS NOT NULL")
def section_kind(spark, d):
    return _t(spark, d, "document_sections").where("title is not null").select("section_id", T.section_kind(F.col("title")).alias("kind"))


_HAY = _fold_sql("concat_ws(' ', title, array_to_string(breadcrumbs, ' '), canonical_url)")


@query(f"SELECT record_no, {_rules_sql('h', T.CATEGORY_RULES, 'general')} AS category FROM (SELECT record_no, {_HAY} AS h FROM document_records)")
def category_rules(spark, d):
    return _t(spark, d, "document_records").select("record_no", T.category(F.col("title"), F.col("breadcrumbs"), F.col("canonical_url")).alias("category"))


@query(r"""SELECT record_no, CASE WHEN text_length > 0 AND text_length < 300 THEN 'stub' WHEN regexp_matches(t, '^(welcome|home)$') THEN 'landing'
WHEN regexp_matches(b, '\b(what''?s new|contents|table of contents|appendix|appendixes|index|overview)\b') THEN 'index' WHEN regexp_matches(t, '\b(reference|programmer''?s guide|language reference|messages and codes|keyword finder)\b') THEN 'reference' ELSE 'topic' END AS kind
FROM (SELECT record_no, text_length, lower(coalesce(title, '')) AS t, lower(coalesce(title, '')) || ' ' || lower(coalesce(array_to_string(breadcrumbs, ' '), '')) AS b FROM document_records)""")
def document_kind(spark, d):
    return _t(spark, d, "document_records").select("record_no", T.document_kind(F.col("title"), F.col("breadcrumbs"), F.col("text_length")).alias("kind"))


_RED = "text"
for _p, _r in (
    (r"(?is)-----BEGIN [^\r\n-]*PRIVATE KEY-----.*?-----END [^\r\n-]*PRIVATE KEY-----", "[PRIVATE KEY]"), (r"(?i)\bAuthorization *: *(?:Bearer|Basic) +[^ \t\r\n,;]+", "Authorization: [REDACTED]"),
    (rf"(?i)([\"']?{T.SECRETS}[\"']? *: *)[\"'][^\"']*[\"']", '\\1"[REDACTED]"'), (rf"(?i)\b{T.SECRETS} *[:=] *[^ \t\r\n,;]+", "\\1=[REDACTED]"),
    (rf"(?i)\b{T.SECRETS} *\( *(?:'[^']*'|\"[^\"]*\") *\)", "\\1([REDACTED])"), (r"[ \t\r\n\f]+", " "),
):
    _RED = f"regexp_replace({_RED}, {_q(_p)}, {_q(_r)}, 'g')"


@query(f"SELECT doc_id, CASE WHEN length(r) <= 180 THEN r ELSE substr(r, 1, 180) || '…' END AS preview FROM (SELECT doc_id, trim({_RED}, ' ') AS r FROM documents WHERE text IS NOT NULL)")
def redact_secrets(spark, d):
    return _t(spark, d, "documents").where("text is not null").select("doc_id", T.redact(F.col("text")).alias("preview"))


_LINES = r"regexp_split_to_array(text, '\r?\n')"
_TRIM = "trim({0}, ' ' || chr(9) || chr(13))"


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS lines FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM l),
t AS (SELECT doc_id, no, {_TRIM.format('lines[no]')} AS title FROM n), k AS (SELECT doc_id, no, title, {_rules_sql('title', T.SECTION_KINDS, 'generic')} AS kind FROM t WHERE title <> '' AND length(title) <= 140),
h AS (SELECT *, lead(no) OVER w AS nxt, row_number() OVER w - 1 AS i FROM k WHERE kind <> 'generic' OR (no > 1 AND regexp_matches(title, '{structure.HEADING_CAPS}')) WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
s AS (SELECT doc_id, i, kind, title, no AS a, coalesce(nxt - 1, len(lines)) AS z, lines FROM h JOIN l USING (doc_id) WHERE i < 80 UNION ALL SELECT doc_id, 0, 'description', 'Content', 0, len(lines), lines FROM l WHERE doc_id NOT IN (SELECT doc_id FROM h)),
b AS (SELECT *, trim(array_to_string(lines[a + 1:z], chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM s)
SELECT doc_id, i::INT AS section_index, kind AS section_kind, title, CASE WHEN body = '' THEN title ELSE body END AS body, greatest(a, 1)::INT AS start_line, z::INT AS end_line FROM b""")
def sections_extract(spark, d):
    return structure.sections(_t(spark, d, "documents"), "doc_id", "text")


@query()
def chunk_documents(spark, d):
    """Chunks of all documents, with single entries where the record says that there are some."""
    r = _t(spark, d, "document_records").where("normalized_text_path is not null").groupBy("normalized_text_path").agg(F.max(T.has_entries(F.col("document_kind"), F.col("title"), F.col("canonical_topic_key"), F.col("breadcrumbs"))).alias("entries"))
    docs = _t(spark, d, "documents").join(r, "normalized_text_path", "left")
    return structure.chunks(docs, "doc_id", "text", atomic=F.col("entries"))


@query("SELECT document_id, count(*) AS n_chunks, sum(length(body))::BIGINT AS n_chars, max(length(body))::BIGINT AS longest FROM chunks GROUP BY document_id")
def chunk_stats(spark, d):
    c = _t(spark, d, "chunks")
    return c.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("body")).alias("n_chars"), F.max(F.length("body")).cast("long").alias("longest"))


_FIRST = "list_filter({0}, lambda x, i: list_position(list_transform({0}, lambda y: lower(y)), lower(x)) = i)"


def _parts(column: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace({column}, '\\r', '', 'g'), '\\n{{2,}}'), lambda p: trim(regexp_replace(p, '{_WS}+', ' ', 'g'), ' ')), lambda p: p <> '' AND len(string_split(p, ' > ')) < 3 AND NOT (contains(p, 'Last Updated:') AND length(p) <= 240) AND NOT starts_with(lower(p), 'parent topic:'))"




@query(f"""WITH p AS (SELECT doc_id, {_parts('text')} AS p FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, array_to_string({_FIRST.format('p')}, ' ') AS n FROM p),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(n, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) >= 20) AS s FROM n),
w AS (SELECT doc_id, list_transform(range(1, len(s) + 1, 2), lambda i: substr(array_to_string(s[i:i + 1], ' '), 1, 700)) AS w FROM s WHERE len(s) > 0),
u AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:8] AS w FROM w)
SELECT doc_id, (unnest(range(1, len(w) + 1)) - 1)::INT AS window_no, unnest(w) AS "window" FROM u""")
def passage_windows(spark, d):
    return structure.passage_windows(_t(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH c AS (SELECT case_no, trim(regexp_replace(question, '[ \t\r\n]+', ' ', 'g'), ' ') AS c FROM qa_cases WHERE question IS NOT NULL),
v AS (SELECT case_no, list_concat([c], list_filter(string_split(regexp_replace(c, '([.!?]) +', '\1' || chr(10), 'g'), chr(10)), lambda s: length(s) >= 24 AND length(s) < length(c))) AS v FROM c WHERE c <> ''),
u AS (SELECT case_no, list_filter(v, lambda x, i: list_position(v, x) = i)[1:4] AS v FROM v)
SELECT case_no, (unnest(range(1, len(v) + 1)) - 1)::INT AS perspective, unnest(v) AS query FROM u""")
def query_perspectives(spark, d):
    return structure.query_perspectives(_t(spark, d, "qa_cases"), "case_no", "question")


@query()
def html_extract(spark, d):
    return html.extract(_t(spark, d, "raw_pages"), "page_id", "html")


@query("""SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*"([^"]+)"', 1), regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*''([^'']+)''', 1)))) AS href FROM raw_pages WHERE html IS NOT NULL""")
def link_extract(spark, d):
    return html.links(_t(spark, d, "raw_pages"), "page_id", "html")


# ---- questions and answers ----------------------------------------------------


@query("SELECT row_no, CASE WHEN n = 1 THEN id ELSE id || '-' || n END AS unique_id FROM (SELECT row_no, id, row_number() OVER (PARTITION BY id ORDER BY row_no) AS n FROM question_bank)")
def id_uniquify(spark, d):
    return dedupe.unique_ids(_t(spark, d, "question_bank").select("row_no", "id"), "id", "row_no").select("row_no", "unique_id")


@query("""SELECT extraction.question_id AS question_id, row_no FROM question_bank WHERE extraction.question_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY extraction.question_id ORDER BY coalesce(extraction.accepted, false) DESC, extraction.answer_score DESC NULLS LAST, row_no) = 1""")
def best_answer(spark, d):
    q = _t(spark, d, "question_bank").where("extraction.question_id is not null").select(F.col("extraction.question_id").alias("question_id"), "row_no", F.coalesce("extraction.accepted", F.lit(False)).alias("ok"), F.col("extraction.answer_score").alias("s"))
    return dedupe.first_per_key(q, ["question_id"], [F.desc("ok"), F.desc_nulls_last("s"), "row_no"]).select("question_id", "row_no")


@query("SELECT source_id, extraction.extraction_quality AS quality, lang, count(*) AS n, count(*) FILTER (evaluation_eligible) AS eligible FROM question_bank GROUP BY ALL")
def qa_summary(spark, d):
    return _t(spark, d, "question_bank").groupBy("source_id", F.col("extraction.extraction_quality").alias("quality"), "lang").agg(F.count("*").alias("n"), F.count_if("evaluation_eligible").alias("eligible"))


def _prompt_sql(column: str) -> str:
    folded = _fold_sql(f"coalesce({column}, '')")
    return f"(ends_with({folded}, '?') OR " + " OR ".join(f"contains({folded}, {_q(x)})" for x in (*Q.ASKING_BACK, *Q.NOT_GIVEN)) + ")"


@query(f"SELECT row_no FROM question_bank WHERE extraction.extraction_quality IN ('answered', 'partial') AND length(trim(question)) >= 8 AND length(trim(expected_answer_summary)) >= 24 AND NOT {_prompt_sql('expected_answer_summary')}")
def usable_cases(spark, d):
    return qabank.usable_cases(_t(spark, d, "question_bank"), "extraction.extraction_quality", "question", "expected_answer_summary").select("row_no")


def _concise_sql(cleaned: str) -> str:
    t = f"regexp_replace({cleaned}, '[.;,]+$', '')"
    return f"({t} <> '' AND (" + " OR ".join(f"regexp_matches({t}, {_q(p)})" for p in Q.CONCISE) + "))"


_ANSWER = _clean_sql("expected_answer_summary")


@query(f"""SELECT row_no, CASE WHEN c = '' THEN 'question-only' WHEN regexp_matches(c, '(?i)^([A-E](?:\\s*,\\s*[A-E])*)$') OR regexp_matches(coalesce(raw, ''), '(?i)\\bAnswer\\s*:\\s*[A-E]\\b') THEN 'multiple-choice' WHEN {_concise_sql('c')} THEN 'answered' WHEN length(c) < 12 THEN 'partial' ELSE 'answered' END AS quality,
c <> '' AND (length(c) >= 12 OR {_concise_sql('c')}) AS usable, {_concise_sql('c')} AS concise, p AS asks_back FROM (SELECT row_no, {_ANSWER} AS c, extraction.raw_answer AS raw, {_prompt_sql('expected_answer_summary')} AS p FROM question_bank)""")
def answer_kinds(spark, d):
    a = F.col("expected_answer_summary")
    return _t(spark, d, "question_bank").select("row_no", Q.answer_quality(a, F.col("extraction.raw_answer")).alias("quality"), Q.is_usable_answer(a).alias("usable"), Q.is_concise(a).alias("concise"), Q.is_unanswered_prompt(a).alias("asks_back"))


@query(f"""SELECT row_no, length(c) >= 8 AND (contains(c, '?') OR regexp_matches(c, {_q(Q.QUESTION_START)}) OR ((regexp_matches(c, {_q(Q.TECHNICAL_NAME)}) OR regexp_matches(c, '(?i)%[A-Z][A-Z0-9_-]*|\\*[A-Z][A-Z0-9_]*')) AND regexp_matches(c, {_q(Q.ACTION)}))) AS asks,
c <> '' AND (regexp_matches(c, {_q(Q.BROKEN_OFF)}) OR (regexp_matches(c, {_q(Q.HANGING)}) AND length(c) < 180)) AS breaks_off, {_rules_sql("coalesce(question, '')", Q.LANGUAGES, 'general').replace("(?i)(?i)", "(?i)")} AS language, regexp_matches(c, {_q(Q.BOILERPLATE)}) AS boilerplate
FROM (SELECT row_no, question, {_clean_sql('question')} AS c FROM question_bank)""")
def question_kinds(spark, d):
    q = F.col("question")
    return _t(spark, d, "question_bank").select("row_no", Q.looks_like_question(q).alias("asks"), Q.breaks_off(q).alias("breaks_off"), Q.language_of(q).alias("language"), F.coalesce(Q.is_boilerplate(q), F.lit(False)).alias("boilerplate"))


_FIELDS = ["certification exam", "full description", "citation preview", "panel attribute"]
_BOTH = _plain_sql("concat_ws(chr(10), question, expected_answer_summary)")


@query(f"""SELECT row_no FROM (SELECT row_no, {_clean_sql('question')} AS c, {_BOTH} AS b, concat_ws(chr(10), question, expected_answer_summary) AS r FROM question_bank),
LATERAL (SELECT {' + '.join(f"contains(b, {_q(x)})::INT" for x in _FIELDS)} AS n, len(regexp_extract_all(b, '\\bread more\\b')) AS m, regexp_matches(r, {_q(Q.TECHNICAL_NAME)}) OR regexp_matches(r, '(?i)\\b(?:CPF|MCH|RNF|SQL)\\d{{4,5}}\\b') OR regexp_matches(r, '(?i)%[A-Z][A-Z0-9_-]*|\\*[A-Z][A-Z0-9_]*') AS t)
WHERE regexp_matches(b, {_q(Q.TRAINING_OFFER)}) OR (c <> '' AND (regexp_matches(c, {_q(Q.BROKEN_OFF)}) OR (regexp_matches(c, {_q(Q.HANGING)}) AND length(c) < 180))) OR n >= 2 OR (m >= 3 AND n >= 1) OR (NOT t AND n >= 1)""")
def noisy_cases(spark, d):
    return _t(spark, d, "question_bank").where(Q.is_noise(F.col("question"), F.col("expected_answer_summary"), _FIELDS)).select("row_no")


@query(f"""WITH b AS (SELECT 0 AS list, row_no AS n, question FROM question_bank WHERE source_id IS NOT NULL UNION ALL SELECT 1, case_no, question FROM eval_cases),
k AS (SELECT *, trim(regexp_replace({_plain_sql('question')}, '[^a-z0-9]+', ' ', 'g'), ' ') AS key FROM b) SELECT n FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY list, n) = 1""")
def merged_questions(spark, d):
    """The bank's questions, then those of the evaluation cases that it lacks."""
    bank = _t(spark, d, "question_bank").where("source_id is not null").select(F.col("row_no").alias("n"), "question")
    return qabank.merge_questions(bank, _t(spark, d, "eval_cases").select(F.col("case_no").alias("n"), "question"), "question", "n").select("n")


_NORMAL = _clean_sql("question")
for _p in (r"(?i)^(?:Q(?:uestion)? *)?[0-9]{1,4}[.):] *", r"(?i)^(?:Q(?:uestion)?)(?: *[0-9]{1,4})? *[:\-] *", r"(?i)^Q[A-Z0-9]{2,}[:.)]? +", r"(?i)\b(?:Ans|Answer)(?: *[0-9]{1,4})? *[:\-]+.*$"):
    _NORMAL = f"regexp_replace({_NORMAL}, {_q(_p)}, '')"


@query(f"SELECT row_no, trim(regexp_replace({_NORMAL}, ' +', ' ', 'g'), ' ') AS question, 'qa-' || substr(sha256(question || chr(10) || expected_answer_summary), 1, 24) AS stable_id FROM question_bank WHERE question IS NOT NULL AND expected_answer_summary IS NOT NULL")
def normal_questions(spark, d):
    rows = _t(spark, d, "question_bank").where("question is not null and expected_answer_summary is not null")
    return rows.select("row_no", T.normalize_question(F.col("question")).alias("question"), T.stable_id(F.col("question"), F.col("expected_answer_summary")).alias("stable_id"))




@query(f"""WITH h AS (SELECT id, {_fold_sql('question')} AS k, sha256({_fold_sql('question')} || chr(10) || {_fold_sql('expected_answer_summary')}) AS s FROM eval_cases UNION ALL SELECT case_id, {_fold_sql('question')}, sha256({_fold_sql('question')} || chr(10) || {_fold_sql('answer')}) FROM qa_cases WHERE split_name <> 'train'),
t AS (SELECT case_no, case_id, {_fold_sql('question')} AS k, sha256({_fold_sql('question')} || chr(10) || {_fold_sql('answer')}) AS s FROM qa_cases WHERE split_name = 'train')
SELECT case_no FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = t.case_id) AND NOT EXISTS (SELECT 1 FROM h WHERE h.k = t.k) AND NOT EXISTS (SELECT 1 FROM h WHERE h.s = t.s)""")
def holdout_exclusion(spark, d):
    """Training rows that share neither id nor question nor pair with a held-out one."""
    keys = lambda df, row_id, answer: df.select("*", F.col(row_id).alias("id_key"), T.fold(F.col("question")).alias("k"), T.pair_signature(F.col("question"), F.col(answer)).alias("s"))
    qa = keys(_t(spark, d, "qa_cases"), "case_id", "answer")
    held = keys(_t(spark, d, "eval_cases"), "id", "expected_answer_summary").select("id_key", "k", "s").unionByName(qa.where("split_name <> 'train'").select("id_key", "k", "s"))
    return dedupe.exclude_held_out(qa.where("split_name = 'train'"), held, ["id_key", "k", "s"]).select("case_no")


_ANY = "coalesce(len(list_filter({1}, lambda x: contains(lower(coalesce({0}, '')), lower(x)))) > 0, false)"
_CASE = f"""SELECT row_no, score, score >= 0.85 AND NOT bad AND usable AS passed FROM (SELECT row_no, bad, usable, round(0.45::DOUBLE * hit::INT + 0.35::DOUBLE * proof::INT + 0.15::DOUBLE * (NOT bad)::INT + 0.05::DOUBLE * usable::INT, 4) AS score FROM (
SELECT row_no, {_ANY.format('expected_answer_summary', 'answer_must_contain_any')} AS hit, {_ANY.format('extraction.raw_answer', 'evidence_must_contain_any')} AS proof, {_ANY.format('expected_answer_summary', 'forbidden_any')} AS bad,
length(trim(coalesce(expected_answer_summary, ''))) > 0 AS usable FROM question_bank))"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.case_scores(_t(spark, d, "question_bank"), "expected_answer_summary", "extraction.raw_answer")


@query(_CASE)
def case_score(spark, d):
    return _cases(spark, d).select("row_no", "score", "passed")


@query(f"SELECT count(*) AS n, count(*) FILTER (passed) AS n_passed, floor(count(*) FILTER (passed) / greatest(count(*), 1) * 10000 + 0.5) / 100 AS pass_rate FROM ({_CASE})")
def eval_summary(spark, d):
    return _cases(spark, d).agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), S.percent(F.count_if("passed"), F.count("*")).alias("pass_rate"))


@query("SELECT case_no, n - 1 AS turn FROM (SELECT case_no, row_number() OVER (ORDER BY case_no) - 101 AS p, count(*) OVER () AS t, ((row_number() OVER (ORDER BY case_no) - 101) % count(*) OVER () + count(*) OVER ()) % count(*) OVER () + 1 AS n FROM eval_cases) WHERE n <= 40")
def rotating_sample(spark, d):
    return evaluation.rotating_window(_t(spark, d, "eval_cases"), "case_no", 100, 40)


# ---- traces: 'view' is a search, 'click' a read, 'signup' an assist -------------


@query("SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1")
def trace_by_tool(spark, d):
    return trace.by_tool(_t(spark, d, "events"), "event_type")


@query("SELECT count(*) AS events, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'click') AS reads, floor(count(*) FILTER (event_type = 'signup') / greatest(count(*), 1) * 10000 + 0.5) / 100 AS assist_rate, floor(count(*) FILTER (event_type = 'view') / greatest(count(*), 1) * 10000 + 0.5) / 100 AS search_rate FROM events")
def trace_rates(spark, d):
    return trace.rates(_t(spark, d, "events"), "event_type", "view", "click", "signup")


@query("SELECT count(*) AS searches, count(*) FILTER (user_id IN (SELECT user_id FROM events WHERE event_type = 'click')) AS followed, floor(count(*) FILTER (user_id IN (SELECT user_id FROM events WHERE event_type = 'click')) / greatest(count(*), 1) * 10000 + 0.5) / 100 AS rate FROM events WHERE event_type = 'view'")
def search_then_read(spark, d):
    return trace.search_then_read(_t(spark, d, "events"), "event_type", "user_id", "view", "click")


@query("SELECT user_id, count(*) AS searches, count(*) FILTER (nxt - ts <= INTERVAL 1 HOUR) AS followed FROM (SELECT *, min(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nxt FROM events) WHERE event_type = 'view' GROUP BY user_id")
def read_after_search(spark, d):
    return trace.read_after_search(_t(spark, d, "events"), "event_type", "user_id", "ts", "view", "click")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, d):
    return trace.last_events(_t(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS tool, count(*) AS n FROM events GROUP BY 1, 2")
def trace_windowed(spark, d):
    out = trace.windowed(_t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _expanded(spark: SparkSession, d: str) -> DataFrame:
    """Events as traces: every third one widened a scope, searches name the next two events."""
    e = _t(spark, d, "events")
    widened = F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.when(F.col("event_id") % 2 == 0, "version").otherwise("category").alias("kind"), F.concat(F.lit("s"), (F.get_json_object("props", "$.k").cast("long") % 4).cast("string")).alias("requestedScope"))))
    return e.withColumn("scopeExpansions", widened).withColumn("id", F.col("event_id").cast("string")).withColumn("topResultId", F.lit(None).cast("string")).withColumn("followedReadCandidateIds", F.array((F.col("event_id") + 1).cast("string"), (F.col("event_id") + 2).cast("string")))


@query("""SELECT kind, scope, count(*) AS n FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'version' ELSE 'category' END AS kind, 's' || (json_extract_string(props, '$.k')::BIGINT % 4) AS scope FROM events WHERE event_id % 3 = 0) GROUP BY GROUPING SETS ((kind), (kind, scope))""")
def scope_expansions(spark, d):
    """Widened scopes by kind and by what was asked for."""
    return trace.expansions(_expanded(spark, d))


@query("""WITH s AS (SELECT event_id, EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'click' AND r.event_id IN (e.event_id + 1, e.event_id + 2)) AS hit FROM events e WHERE event_type = 'view')
SELECT count(*) AS searches, count(*) FILTER (hit) AS followed, floor(count(*) FILTER (hit) / greatest(count(*), 1) * 10000 + 0.5) / 100 AS followed_rate, floor(count(*) FILTER (NOT hit) / greatest(count(*), 1) * 10000 + 0.5) / 100 AS search_only_rate FROM s""")
def followed_searches(spark, d):
    return trace.followed_searches(_expanded(spark, d), "event_type", "view", "click")


# ---- more of the question bank and the corpus -----------------------------------


@query(f"SELECT row_no FROM (SELECT row_no, {_fold_sql('question')} AS q, {_fold_sql('expected_answer_summary')} AS a FROM question_bank) WHERE q <> '' AND a <> '' QUALIFY row_number() OVER (PARTITION BY q, a ORDER BY row_no) = 1")
def question_dedupe(spark, d):
    return qabank.question_dedupe(_t(spark, d, "question_bank").select("row_no", "question", "expected_answer_summary"), "question", "expected_answer_summary", "row_no").select("row_no")


@query("""SELECT extraction.question_id AS question_id, row_no, row_number() OVER (PARTITION BY extraction.question_id ORDER BY extraction.answer_score DESC NULLS LAST, extraction.community_yes DESC NULLS LAST, length(expected_answer_summary) DESC NULLS LAST, row_no) AS place
FROM question_bank WHERE extraction.question_id IS NOT NULL QUALIFY place <= 2""")
def answer_order(spark, d):
    b = _t(spark, d, "question_bank").select("row_no", "expected_answer_summary", F.col("extraction.question_id").alias("question_id"), F.col("extraction.answer_score").alias("s"), F.col("extraction.community_yes").alias("y"))
    return qabank.ranked_answers(b, "question_id", "s", "y", "expected_answer_summary", "row_no").select("question_id", "row_no", F.col("place").cast("long").alias("place"))


@query("SELECT row_no FROM question_bank WHERE coalesce(extraction.accepted, false) OR coalesce(extraction.answer_score, -1) >= 3")
def policy_filter(spark, d):
    return qabank.by_policy(_t(spark, d, "question_bank"), "extraction.accepted", "extraction.answer_score", 3).select("row_no")


@query()
def eval_terms(spark, d):
    return qabank.terms(_t(spark, d, "question_bank"), "row_no", "expected_answer_summary", "question")


@query()
def text_questions(spark, d):
    return qabank.text_questions(_t(spark, d, "question_bank").select("row_no", F.concat_ws("\n", F.concat(F.lit("1. "), F.col("question")), F.concat(F.lit("Answer: "), F.col("expected_answer_summary"))).alias("t")), "row_no", "t")


@query("""SELECT section_id, query, passage FROM (SELECT section_id, concat_ws(' ', r.title, s.title) AS query, substr(trim(body, ' '), 1, 4000) AS passage FROM document_sections s
JOIN (SELECT id, title FROM document_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1) r ON r.id = s.document_id) WHERE length(query) >= 8 AND length(passage) >= 24""")
def section_pairs(spark, d):
    return qabank.section_pairs(_t(spark, d, "document_sections"), _t(spark, d, "document_records"))


_CMD = "|".join(T.COMMAND_PREFIXES)
_GEN = ", ".join(f"'{x}'" for x in T.GENERIC_TERMS)


@query(rf"""WITH h AS (SELECT record_no, title, category, concat_ws(' ', coalesce(title, ''), coalesce(array_to_string(breadcrumbs, ' '), ''), coalesce(category, '')) AS h FROM document_records),
k AS (SELECT record_no, category, nullif(regexp_extract(title, '(?i)(%[A-Z][A-Z0-9_-]+)', 1), '') AS a, nullif(regexp_extract(h, '(?i)\b(RNF[0-9]{{4}}|CPF[0-9]{{4}}|MCH[0-9]{{4}}|SQL[0-9]{{4,5}})\b', 1), '') AS b, nullif(regexp_extract(title, '\b([A-Z]{{2,}}-[A-Z0-9-]+)\b', 1), '') AS c,
CASE WHEN regexp_matches(h, '(?i)\bcommands?\b') THEN list_filter(regexp_extract_all(h, '\b([A-Z][A-Z0-9]{{1,11}})\b', 1), lambda n: n NOT IN ({_GEN}) AND regexp_matches(lower(n), '^({_CMD})[a-z0-9]+$'))[1] END AS e,
substr(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace({_fold_sql('title')}, '{T.TITLE_WORDS}', ' ', 'g'), '[()%]', ' ', 'g'), ' +', ' ', 'g'), ' '), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 80) AS f FROM h)
SELECT record_no, coalesce(category, '') || ':' || lower(coalesce(a, b, c, e, f, 'topic')) AS topic_key FROM k""")
def topic_key(spark, d):
    return _t(spark, d, "document_records").select("record_no", T.topic_key(F.col("title"), F.col("breadcrumbs"), F.col("category")).alias("topic_key"))


@query(f"""WITH p AS (SELECT chunk_id, title, {_parts('body')} AS p FROM chunks WHERE body IS NOT NULL), n AS (SELECT chunk_id, title, array_to_string({_FIRST.format('p')}, ' ') AS n FROM p),
f AS (SELECT chunk_id, title, list_filter(list_transform(regexp_split_to_array(n, ' +\\d+\\) +'), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g'), ' ')), lambda x: x <> '') AS f FROM n),
j AS (SELECT chunk_id, title, string_split(array_to_string({_FIRST.format('f')}, ' '), ' ') AS w FROM f),
m AS (SELECT chunk_id, title, CASE WHEN len(w) = 2 AND lower(w[1]) = lower(w[2]) THEN w[1] ELSE array_to_string(w, ' ') END AS n FROM j),
c AS (SELECT *, reverse(substr(n, 1, 600)) AS r FROM m), a AS (SELECT *, 600 - coalesce(list_min(list_filter([position(' .' IN r), position(' ;' IN r), position(' :' IN r)], lambda x: x > 0)), 1000000) AS pl FROM c),
b AS (SELECT chunk_id, title, CASE WHEN length(n) <= 600 THEN n ELSE trim(CASE WHEN pl >= 331 THEN substr(n, 1, pl) ELSE substr(n, 1, 600) END, ' ') || '…' END AS b FROM a)
SELECT chunk_id, CASE WHEN coalesce(title, '') <> '' AND NOT starts_with(lower(b), lower(title)) THEN title || ': ' || b ELSE b END AS passage FROM b""")
def compact_passage(spark, d):
    return _t(spark, d, "chunks").where("body is not null").select("chunk_id", T.titled(F.col("title"), T.compact(F.col("body"), 600)).alias("passage"))


@query("SELECT record_no, coalesce(title, '') = '' AS no_title, coalesce(normalized_text_path, '') = '' AS no_text, coalesce(length(raw_html_path), 0) > 240 OR coalesce(length(normalized_text_path), 0) > 240 AS long_path, count(*) OVER (PARTITION BY id) > 1 AS repeated_id FROM document_records")
def lint_documents(spark, d):
    r = _t(spark, d, "document_records")
    often = r.groupBy("id").agg((F.count("*") > 1).alias("repeated_id"))
    long_path = (F.coalesce(F.length("raw_html_path"), F.lit(0)) > 240) | (F.coalesce(F.length("normalized_text_path"), F.lit(0)) > 240)
    return r.join(often, "id").select("record_no", (F.coalesce("title", F.lit("")) == "").alias("no_title"), (F.coalesce("normalized_text_path", F.lit("")) == "").alias("no_text"), long_path.alias("long_path"), "repeated_id")


@query("SELECT record_no FROM document_records r WHERE normalized_text_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.normalized_text_path = r.normalized_text_path)")
def missing_texts(spark, d):
    """Records whose text is not there."""
    r = _t(spark, d, "document_records").where("normalized_text_path is not null").select("record_no", "normalized_text_path")
    return r.join(_t(spark, d, "documents").select("normalized_text_path"), "normalized_text_path", "left_anti").select("record_no")


_PATH = _fold_sql("array_to_string(breadcrumbs, ' > ')")
_INSIDE = f"((starts_with({_PATH}, 'cl') OR starts_with({_PATH}, 'database >') OR regexp_matches({_PATH}, '\\b(command|dds)s?\\b')) AND NOT contains({_PATH}, 'printer'))"


@query(f"SELECT record_no, {_INSIDE} AS in_scope FROM document_records WHERE breadcrumbs IS NOT NULL AND len(breadcrumbs) > 0")
def toc_scope(spark, d):
    """Whether a record lies under some parts of the tree of contents."""
    r = _t(spark, d, "document_records").where("breadcrumbs is not null and size(breadcrumbs) > 0")
    return r.select("record_no", toc.in_scope(F.col("breadcrumbs"), ["cl", "database >"], ["printer"], [r"\b(command|dds)s?\b"]).alias("in_scope"))


@query(f"SELECT CASE {' '.join(f'WHEN contains({_PATH}, {_q(p)}) THEN {_q(n)}' for n, p in [*toc.GROUPS, ('entry', 'entry')])} ELSE 'others' END AS topic_group, count(*) AS n FROM document_records WHERE breadcrumbs IS NOT NULL GROUP BY 1")
def topic_groups(spark, d):
    r = _t(spark, d, "document_records").where("breadcrumbs is not null")
    return r.groupBy(toc.topic_group(F.col("breadcrumbs"), [*toc.GROUPS, ("entry", "entry")]).alias("topic_group")).agg(F.count("*").alias("n"))


@query("SELECT record_no FROM document_records QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(canonical_url, ''), id) ORDER BY record_no) = 1")
def distinct_topics(spark, d):
    return toc.distinct_topics(_t(spark, d, "document_records").select("record_no", "canonical_url", "id"), "canonical_url", "id", "record_no").select("record_no")


_FEED = _SIMS_ALL.replace("WITH sims", "WITH ans AS (SELECT q.vec_id AS qid, r.vec_id AS rid, round(list_dot_product(a.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS asim FROM embeddings q JOIN embeddings a ON q.vec_id % 20 = 0 AND a.vec_id = q.vec_id + 1 JOIN embeddings r ON r.vec_id <> q.vec_id), sims", 1)


@query(_FEED + """, atop AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY asim DESC, rid) AS arank FROM ans), pos AS (SELECT qid, rid AS positive, asim AS best FROM atop WHERE arank = 1),
c AS (SELECT t.qid, t.rid, t.sim, row_number() OVER (PARTITION BY t.qid ORDER BY t.sim DESC, t.rid) AS place FROM top t JOIN pos p USING (qid) LEFT JOIN atop a ON a.qid = t.qid AND a.rid = t.rid WHERE t.rid <> p.positive AND coalesce(a.asim, -1.0) < 0.85::DOUBLE * p.best QUALIFY place <= 3)
SELECT qid AS question, positive, rid AS negative, place FROM pos JOIN c USING (qid)""")
def feedback_mining(spark, d):
    """Positive: the row nearest to the answer; negatives: near the question, not near the answer.
    The answer of a query row is the row with the next id."""
    e = _t(spark, d, "embeddings")
    answers = e.where("(vec_id - 1) % 20 = 0").select((F.col("vec_id") - 1).alias("vec_id"), "embedding")
    near_q = _top(spark, d, None).select("qid", "rid", "sim")
    near_a = vectors.block_search(e, answers, "vec_id", "embedding", "vec_id", "embedding", None, DIM).select("qid", "rid", F.col("sim").alias("asim"))
    near_a = near_a.withColumn("arank", F.expr("row_number() over (partition by qid order by asim desc, rid)"))
    return evaluation.mined_pairs(near_q, near_a)


# ---- models as plug-ins, graded metrics -------------------------------------------


@query(_SIMS + """, rel AS (SELECT q.vec_id AS qid, count(r.vec_id) AS n FROM embeddings q LEFT JOIN embeddings r ON r.label = q.label AND r.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1),
h AS (SELECT qid, rank, row_number() OVER (PARTITION BY qid ORDER BY rank) AS hit_no FROM top WHERE q_label = r_label AND rank <= 100),
p AS (SELECT qid, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, sum(hit_no / rank) AS ap, min(rank) AS first FROM h GROUP BY 1),
x AS (SELECT n, coalesce(h1, 0) AS h1, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(dcg, 0) AS dcg, coalesce(ap, 0) AS ap, first, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS best FROM rel LEFT JOIN p USING (qid) WHERE n > 0)
SELECT count(*) AS n, round(avg((h1 > 0)::INT), 6) AS accuracy1, round(avg((h5 > 0)::INT), 6) AS accuracy5, round(avg((h10 > 0)::INT), 6) AS accuracy10, round(avg(h1 / 1), 6) AS precision1, round(avg(h5 / 5), 6) AS precision5, round(avg(h10 / 10), 6) AS precision10,
 round(avg(h1 / n), 6) AS recall1, round(avg(h5 / n), 6) AS recall5, round(avg(h10 / n), 6) AS recall10, round(avg(dcg / best), 6) AS ndcg10, round(avg(ap / least(n, 100)), 6) AS map100, round(avg(CASE WHEN first <= 10 THEN 1 / first ELSE 0 END), 6) AS mrr10, round(avg(CASE WHEN first <= 100 THEN 1 / first ELSE 0 END), 6) AS mrr100 FROM x""")
def graded_metrics(spark, d):
    e = _t(spark, d, "embeddings")
    sizes = e.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("m"))
    relevant = e.where("vec_id % 20 = 0").join(sizes, F.col("label") == F.col("l")).select(F.col("vec_id").alias("question"), (F.col("m") - 1).alias("n_relevant"))
    ranked = _labelled(spark, d, 100).select(F.col("qid").alias("question"), "rank", (F.col("q_label") == F.col("r_label")).alias("relevant"))
    return evaluation.graded_metrics(ranked, relevant)


@query(_SCORED + """, v AS (SELECT question, chunk, place AS old, min(CASE WHEN topic % 3 = question % 3 AND logit >= 0.5 THEN place END) OVER (PARTITION BY question) AS front FROM placed)
SELECT question, chunk, row_number() OVER (PARTITION BY question ORDER BY CASE WHEN old = front THEN 0 ELSE 1 END, old) AS place FROM v""")
def preferred_version(spark, d):
    rows = retrieval.consensus(_scored(spark, d)).withColumn("version", F.col("topic") % 3).withColumn("asked", F.col("question") % 3)
    return scoring.preferred_version(rows, "asked").select("question", "chunk", F.col("place").cast("long").alias("place"))


@query("SELECT chunk_id, 'passage: ' || concat_ws(chr(10), nullif(c.title, ''), nullif(array_to_string(breadcrumbs, ' > '), ''), body) AS passage FROM chunks c JOIN (SELECT id, breadcrumbs FROM document_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1) r ON r.id = c.document_id")
def passage_templates(spark, d):
    first = dedupe.first_per_key(_t(spark, d, "document_records").select(F.col("id").alias("document_id"), "breadcrumbs", "record_no"), ["document_id"], ["record_no"])
    return _t(spark, d, "chunks").join(first, "document_id").select("chunk_id", scoring.passage_text(F.col("title"), F.col("breadcrumbs"), F.col("body")).alias("passage"))


@query()
def embed_passages(spark, d):
    return scoring.embed_texts(_t(spark, d, "chunks"), "chunk_id", "body", hashing_embedder, "passage: ")


@query()
def rerank_answers(spark, d):
    rows = _t(spark, d, "question_bank").select("row_no", "question", "expected_answer_summary")
    return scoring.rerank(rows, "question", "expected_answer_summary", scoring.word_overlap).select("row_no", "logit", "score")


@query("SELECT record_no, coalesce(nullif(regexp_extract(concat_ws(' ', original_url, title, array_to_string(breadcrumbs, ' '), doc_version), '\\b(7\\.[3456])\\b', 1), ''), 'unknown') AS release FROM document_records")
def release_detect(spark, d):
    c = T.release_in(F.col("original_url"), F.col("title"), F.array_join("breadcrumbs", " "), F.col("doc_version"), default=F.lit("unknown"))
    return _t(spark, d, "document_records").select("record_no", c.alias("release"))


@query("SELECT substr(regexp_extract(normalized_text_path, '([^/]*)$', 1), 1, 2) AS folder, sha256(string_agg(line, '' ORDER BY line)) AS digest, count(*) AS n FROM (SELECT DISTINCT normalized_text_path, normalized_text_path || chr(0) || lower(sha256) || chr(10) AS line FROM document_records WHERE normalized_text_path IS NOT NULL AND sha256 IS NOT NULL) GROUP BY 1")
def folder_digests(spark, d):
    return quality.folder_digest(_t(spark, d, "document_records"), "normalized_text_path", "sha256")


@query("""WITH a AS (SELECT category AS value, count(*) AS n FROM document_records WHERE source_kind LIKE 'manual%' GROUP BY 1), b AS (SELECT category AS value, count(*) AS n FROM document_records GROUP BY 1)
SELECT value, coalesce(a.n, 0) AS declared, coalesce(b.n, 0) AS actual, coalesce(a.n, 0) = coalesce(b.n, 0) AS ok FROM a FULL JOIN b USING (value)""")
def declared_categories(spark, d):
    """Counts of one kind of source against those of all."""
    r = _t(spark, d, "document_records")
    return quality.declared_consistency(quality.count_by(r.where("source_kind like 'manual%'"), "category"), r, "category")


@query()
def training_dedupe(spark, d):
    """Training rows of which no earlier kept one has the id, the pair or the question."""
    q = _t(spark, d, "qa_cases").where("split_name = 'train'").select("case_no", "case_id", T.fold(F.col("question")).alias("q"), T.pair_signature(F.col("question"), F.col("answer")).alias("s"))
    return dedupe.seen_set(q, ["case_id", "s", "q"], "case_no").select("case_no")


@query()
def page_questions(spark, d):
    """Headings and lines of the pages that ask something."""
    return html.questions(_t(spark, d, "raw_pages"), "page_id", "html")


@query()
def bank_cases(spark, d):
    """Questions found in texts as rows of a bank."""
    found = text_questions(spark, d).select(F.concat(F.lit("t"), F.col("row_no").cast("string")).alias("source"), "ordinal", "question", "answer")
    return qabank.make_cases(found)


@query("""SELECT document_id, r.title, c.body, v.doc_id FROM (SELECT id AS document_id, title FROM document_records QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1) r
JOIN (SELECT document_id, body FROM chunks WHERE chunk_index = 0 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) = 1) c USING (document_id) JOIN document_vectors v USING (document_id)""")
def lead_chunks(spark, d):
    return qabank.lead_chunks(_t(spark, d, "document_records"), _t(spark, d, "chunks"), _t(spark, d, "document_vectors").select("document_id", "doc_id")).select("document_id", "title", "body", "doc_id")


_RELEASES = ("7.3", "7.4", "7.5", "7.6")


@query(f"""WITH b AS (SELECT count(*) AS total, count(*) FILTER (text_length < 300) AS short, count(*) FILTER (document_kind = 'stub') AS stub, {', '.join(f"count(*) FILTER (doc_version = '{r}') AS r{i}" for i, r in enumerate(_RELEASES))} FROM document_records),
s AS (SELECT count(*) FILTER (n >= 20) AS substantial FROM (SELECT category, count(*) AS n FROM document_records GROUP BY 1)), t AS (SELECT count(*) AS twice FROM ({_EXACT})),
dc AS (SELECT category AS value, count(DISTINCT id) AS n FROM document_records GROUP BY 1), ac AS (SELECT category AS value, count(*) AS n FROM document_records GROUP BY 1), c AS (SELECT count(*) AS stated, count(*) FILTER (dc.n = ac.n) AS held FROM dc JOIN ac USING (value)),
m AS (SELECT count(*) AS missing FROM document_records r WHERE normalized_text_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.normalized_text_path = r.normalized_text_path)),
u AS (SELECT (SELECT count(*) FROM document_records r WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = r.id)) + (SELECT count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunk_vectors v WHERE v.chunk_id = c.chunk_id)) + (SELECT count(*) FROM document_records r WHERE NOT EXISTS (SELECT 1 FROM document_vectors v WHERE v.document_id = r.id)) AS uncovered),
o AS (SELECT * FROM b, s, t, c, m, u), x AS (
SELECT 'integrity' AS name, (missing = 0 AND uncovered = 0)::INT::DOUBLE AS actual, 1.0::DOUBLE AS threshold, 'eq' AS operator FROM o UNION ALL SELECT 'documents', total::DOUBLE, 5000.0, 'gte' FROM o UNION ALL SELECT 'exact_duplicates', twice::DOUBLE, 0.0, 'eq' FROM o
UNION ALL SELECT 'declared_categories', held::DOUBLE, stated::DOUBLE, 'eq' FROM o UNION ALL SELECT 'substantial_categories', substantial::DOUBLE, 8.0, 'gte' FROM o UNION ALL SELECT 'stub_rate', stub / total, 0.015::DOUBLE, 'lte' FROM o UNION ALL SELECT 'short_rate', short / total, 0.015::DOUBLE, 'lte' FROM o
UNION ALL {' UNION ALL '.join(f"SELECT 'release_{r}', r{i}::DOUBLE, 100.0, 'gte' FROM o" for i, r in enumerate(_RELEASES))})
SELECT name, round(actual, 6) AS actual, threshold, operator, CASE operator WHEN 'gte' THEN actual >= threshold WHEN 'lte' THEN actual <= threshold ELSE actual = threshold END AS ok FROM x""")
def release_gate(spark, d):
    """All checks of a release; a manifest states every id once."""
    r = _t(spark, d, "document_records")
    declared = r.groupBy(F.col("category").alias("value")).agg(F.count_distinct("id").alias("n"))
    missing = r.where("normalized_text_path is not null").join(_t(spark, d, "documents"), "normalized_text_path", "left_anti")
    coverage = quality.vector_coverage(*(_t(spark, d, n) for n in ("document_records", "chunks", "chunk_vectors", "document_vectors")))
    return quality.release_gate(r, declared, missing, coverage, list(_RELEASES), category_size=20)


@query(SQL["quality_gate"].replace("SELECT name, round(actual, 6)", ", z AS (SELECT name, round(actual, 6)", 1) + ") SELECT bool_and(ok) AS ok, coalesce(string_agg(name, '|' ORDER BY name) FILTER (NOT ok), '') AS failed FROM z")
def failed_checks(spark, d):
    return quality.failed_checks(quality.quality_gate(_t(spark, d, "document_records"))).select("ok", F.array_join("failed", "|").alias("failed"))


@query(f"SELECT sha256(string_agg(folder || ' ' || digest || chr(10), '' ORDER BY folder)) AS digest, sum(n)::BIGINT AS n FROM ({SQL['folder_digests']})")
def tree_digest(spark, d):
    return quality.tree_digest(quality.folder_digest(_t(spark, d, "document_records"), "normalized_text_path", "sha256"))


@query(f"""SELECT record_no, concat_ws('-', 'doc', regexp_replace(doc_version, '[^A-Za-z0-9_]', '', 'g'), substr(lower(substr(regexp_replace(regexp_replace(coalesce(nullif(canonical_topic_key, ''), 'topic'), '[^A-Za-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), 1, 180)), 1, 72), substr(sha256, 1, 8)) AS stable_id,
coalesce(document_kind IN ('index', 'reference'), false) OR regexp_matches(lower(concat_ws(' ', title, canonical_topic_key, array_to_string(breadcrumbs, ' '))), {_q(T.ENTRY_WORDS)}) AS has_entries, concat_ws('. ', nullif(title, ''), nullif(array_to_string(breadcrumbs, ' > '), ''), nullif(category, ''), nullif(trim(concat_ws(' ', 'v', nullif(doc_version, '')), ' '), ''), nullif(id, '')) AS reranker_text,
'passage: ' || trim(concat_ws(chr(10), nullif(title, ''), nullif(array_to_string(breadcrumbs, ' > '), ''), nullif(category, ''), nullif(doc_version, '')), ' ') AS title_text FROM document_records""")
def record_texts(spark, d):
    """Ids and the texts that models read of a record."""
    t, b, c, v = (F.col(x) for x in ("title", "breadcrumbs", "category", "doc_version"))
    return _t(spark, d, "document_records").select(
        "record_no", T.stable_document_id(v, F.col("canonical_topic_key"), F.col("sha256")).alias("stable_id"), T.has_entries(F.col("document_kind"), t, F.col("canonical_topic_key"), b).alias("has_entries"),
        scoring.reranker_text(t, b, c, v, F.col("id"), "v").alias("reranker_text"), scoring.title_text(t, b, c, v).alias("title_text"),
    )


_CASES = "SELECT case_no AS \"case\", question, answer FROM qa_cases WHERE question IS NOT NULL AND answer IS NOT NULL"
_NEG = f"cs AS ({_CASES}), ng AS (SELECT a.\"case\", b.\"case\" AS negative, b.\"case\" - a.\"case\" AS place FROM cs a JOIN cs b ON b.\"case\" - a.\"case\" BETWEEN 1 AND 3)"


def _cases_and_negatives(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cases, and as negatives of each the next three numbers."""
    cases = _t(spark, d, "qa_cases").where("question is not null and answer is not null").select(F.col("case_no").alias("case"), "question", "answer")
    next_ = cases.select("case", F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])).alias("place")).withColumn("negative", F.col("case") + F.col("place"))
    return cases, next_.join(cases.select(F.col("case").alias("negative")), "negative").select("case", "negative", "place")


@query(f"""WITH {_NEG} SELECT c."case", c.question AS query, c.answer AS positive, x.answer AS negative_1, y.answer AS negative_2, z.answer AS negative_3 FROM cs c JOIN cs x ON x."case" = c."case" + 1 JOIN cs y ON y."case" = c."case" + 2 JOIN cs z ON z."case" = c."case" + 3""")
def ranking_tuples(spark, d):
    return evaluation.ntuples(*_cases_and_negatives(spark, d), 3)


@query(f"""WITH {_NEG} SELECT "case", question AS query, answer AS passage, 1.0::DOUBLE AS label FROM cs UNION ALL SELECT c."case", c.question, n.answer, 0.0 FROM cs c JOIN ng USING ("case") JOIN cs n ON n."case" = ng.negative""")
def labelled_pairs(spark, d):
    return evaluation.labelled_pairs(*_cases_and_negatives(spark, d))


@query(f"""WITH {_NEG} SELECT c.question AS query, any_value(c.answer) AS positive, string_agg(n.answer, '|' ORDER BY place) AS negative FROM cs c JOIN ng USING ("case") JOIN cs n ON n."case" = ng.negative GROUP BY c."case", c.question""")
def reranking_samples(spark, d):
    s = evaluation.reranking_samples(*_cases_and_negatives(spark, d))
    return s.select("query", F.col("positive")[0].alias("positive"), F.array_join("negative", "|").alias("negative"))


@query()
def seeded_sample(spark, d):
    return evaluation.seeded_sample(_t(spark, d, "eval_cases"), "case_no", 42, 40)


@query("""WITH h AS (SELECT category AS name, title, row_number() OVER (PARTITION BY category ORDER BY record_no) AS place FROM document_records WHERE category IS NOT NULL AND title IS NOT NULL QUALIFY place <= 5),
g AS (SELECT name, max(CASE WHEN place = 1 THEN title END) AS first_title, bool_or(contains(title, 'table')) AS has, bool_or(regexp_matches(title, '(?i)parameter|menu')) AS fits FROM h GROUP BY 1)
SELECT name, CASE WHEN length(name) % 2 = 0 AND NOT starts_with(first_title, 'K') THEN 'another title is first' WHEN NOT has THEN 'a title is missing' WHEN NOT fits THEN 'no title has the pattern' END AS reason FROM g""")
def golden_check(spark, d):
    """Expectations on the first titles of every category."""
    r = _t(spark, d, "document_records").where("category is not null and title is not null")
    hits = r.withColumn("place", F.expr("row_number() over (partition by category order by record_no)")).where("place <= 5").select(F.col("category").alias("name"), "place", "title")
    first = hits.where("place = 1")
    wanted = first.select("name", F.when((F.length("name") % 2 == 0) & ~F.col("title").startswith("K"), F.lit("K")).alias("first_title"), F.lit("table").alias("contains_title"), F.lit("parameter|menu").alias("pattern"))
    return evaluation.golden_check(hits, wanted)


@query()
def source_questions(spark, d):
    """Questions of the pages of registered sources with a known licence."""
    return html.source_questions(_t(spark, d, "raw_pages"), _t(spark, d, "source_registry"), "page_id", "html", "source")
