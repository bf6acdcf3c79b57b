"""From questions to answers, for many questions at once.

Every step is a table keyed by question: views of the question, lists of similar
chunks by text and by title, fusion, a pool worth reranking, logits of the pool and
of passages within it, consensus, the asked version first, the support gate, the
choice of passages and the rendered answer. What a question brings to each step is
bounded, so the work grows with the number of questions; only the vector search
looks at all rows, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylake.functions import scores as S
from quarrylake.functions import text as T
from quarrylake.operators import retrieval, scoring, structure, vectors
from quarrylake.operators.dedupe import first_per_key
from quarrylake.sources.store import cut

LIST, POOL, TITLES, SPAN_DOCUMENTS, FOCUS = 512, 160, 96, 12, 48
FOUNDATION = 0.35  # weight of a view that is not the whole question
SUPPORT = 0.5  # logit of a row of the asked version that goes first


def candidates(records: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, document_vectors: DataFrame, dim: int, category: str | None = None) -> DataFrame:
    """(chunk, document, chunk_index, body, title, version, category, breadcrumbs, topic,
    vector, title_vector): every chunk with a usable vector, its document and its
    document's title vector (null where that is not usable). The category is filtered
    before any search."""
    docs = first_per_key(records.select(F.col("id").alias("document"), "title", F.col("doc_version").alias("version"), "category", "breadcrumbs", F.col("canonical_topic_key").alias("topic"), "record_no"), ["document"], ["record_no"]).drop("record_no")
    if category is not None:
        docs = docs.where(F.col("category") == category)
    texts = chunks.select(F.col("chunk_id").alias("chunk"), F.col("document_id").alias("document"), "chunk_index", "body")
    v = chunk_vectors.where(vectors.usable(F.col("vector"), dim)).select(F.col("chunk_id").alias("chunk"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    t = document_vectors.where(vectors.usable(F.col("title_vector"), dim)).select(F.col("document_id").alias("document"), F.transform("title_vector", lambda x: x.cast("double")).alias("title_vector"))
    t = first_per_key(t, ["document"], ["title_vector"])
    return texts.join(docs, "document").join(v, "chunk").join(t, "document", "left")


def views(questions: DataFrame, embedder: Callable) -> DataFrame:
    """(qid, question, perspective, query, qv) of questions (question, text, language, code)."""
    every = structure.assist_perspectives(questions, "question", "text", "language", "code").withColumn("qid", F.col("question") * 8 + F.col("perspective"))
    embedded = scoring.embed_texts(every.withColumn("t", scoring.query_text(F.col("query"))), "qid", "t", embedder).select("qid", F.col("vector").alias("qv"))
    return every.join(embedded, "qid")


def lists(views: DataFrame, found: DataFrame, dim: int) -> DataFrame:
    """(question, perspective, facet, chunk, document, sim, weight): of each view the
    nearest chunks by text, and the nearest first chunks by title."""
    asked = views.select("qid", "qv")
    content = vectors.block_search(found.select("chunk", "vector"), asked, "chunk", "vector", "qid", "qv", LIST, dim, skip_self=False, unit=True).select("qid", F.col("rid").alias("chunk"), "sim", F.lit("content").alias("facet"))
    leads = found.where("chunk_index = 0 and title_vector is not null").select("chunk", "title_vector")
    title = vectors.block_search(leads, asked, "chunk", "title_vector", "qid", "qv", LIST, dim, skip_self=False, unit=True).select("qid", F.col("rid").alias("chunk"), "sim", F.lit("title").alias("facet"))
    rows = content.unionByName(title).join(views.select("qid", "question", "perspective"), "qid")
    return rows.join(found.select("chunk", "document"), "chunk").select("question", "perspective", "facet", "chunk", "document", "sim", F.when(F.col("perspective") == 0, 1.0).otherwise(FOUNDATION).alias("weight"))


def _cosine(x, y):
    return S.dot(x, y) / (F.sqrt(S.dot(x, x)) * F.sqrt(S.dot(y, y)))


def _scored(rows: DataFrame, passage: str, scorer: Callable) -> DataFrame:
    return scoring.rerank(rows, "asked_text", passage, scorer).drop("asked_text", passage, "score")


def reranked(pool: DataFrame, per: DataFrame, views: DataFrame, questions: DataFrame, scorer: Callable) -> DataFrame:
    """The pool's chunks and the passages within the first chunks of the documents with
    the best titles: (question, item, chunk, span, document, ..., logit, coverage, body)."""
    asked = questions.select("question", F.concat_ws("\n\n", T.compose(F.col("text"), code=F.col("code")), F.when(F.col("version").isNotNull(), F.concat(F.lit("Preferred version: "), F.col("version")))).alias("asked_text"))
    read = scoring.reranker_text(F.col("title_text"), F.col("breadcrumbs"), F.col("category"), F.col("version"), T.normalize_passage(F.col("body")))
    full = pool.join(asked, "question").select("question", "chunk", "asked_text", read.alias("passage"))
    logits = _scored(full, "passage", scorer)
    focus = per.withColumn("n", F.row_number().over(Window.partitionBy("question", "perspective").orderBy(F.desc("rrf"), "chunk")))
    more = focus.join(pool.select("question", "chunk"), ["question", "chunk"], "left_semi").where((F.col("perspective") > 0) & (F.col("n") <= FOCUS)).select("question", "chunk", "perspective")
    more = more.join(views.select("question", "perspective", F.col("query").alias("asked_text")), ["question", "perspective"]).join(full.select("question", "chunk", "passage"), ["question", "chunk"])
    by_view = _scored(more, "passage", scorer).select("question", "chunk", "perspective", "logit").unionByName(logits.withColumn("perspective", F.lit(0)).select("question", "chunk", "perspective", "logit"))
    covers = retrieval.perspective_coverage(by_view)
    wide = covers.groupBy("question", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("perspective", "coverage"))).alias("m"))
    n = views.groupBy("question").agg((F.max("perspective") + 1).alias("n"))
    coverage = wide.join(n, "question").select("question", "chunk", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("coverage"))
    whole = pool.join(logits, ["question", "chunk"]).select("*", F.concat_ws("::", F.col("chunk").cast("string")).alias("item"), F.lit(False).alias("span"))
    best = pool.where("title is not null").groupBy("question", "document").agg(F.max("title").alias("t"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("t"), "document"))).where(F.col("n") <= SPAN_DOCUMENTS).select("question", "document")
    leads = pool.where("chunk_index = 0").join(best, ["question", "document"], "left_semi")
    windows = structure.passage_windows(leads.select("chunk", "body").dropDuplicates(["chunk"]), "chunk", "body").withColumnRenamed("window", "window_text")
    spans = leads.drop("body").join(windows, "chunk").withColumnRenamed("window_text", "body")
    names = F.concat_ws("::", F.col("chunk").cast("string"), F.concat(F.lit("span-"), F.col("window_no").cast("string")))
    spans = spans.withColumn("item", names).drop("window_no").withColumn("span", F.lit(True))
    of_spans = _scored(spans.join(asked, "question").select("question", "item", "asked_text", read.alias("passage")), "passage", scorer)
    columns = whole.columns
    return whole.unionByName(spans.join(of_spans, ["question", "item"]).select(columns)).join(coverage, ["question", "chunk"], "left").withColumn("coverage", F.coalesce("coverage", F.array(F.lit(0.0))))


def answers(questions: DataFrame, records: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, document_vectors: DataFrame, embedder: Callable, scorer: Callable, dim: int, category: str | None = None, picks: int = 3) -> DataFrame:
    """(question, supported, confidence, logit, agree, topics, answer, citations, version,
    coverage) of questions (question, text, language, code, version).

    A question without any candidate is not supported. Nulls in language, code and
    version mean that none is given.
    """
    every = cut(views(questions, embedder))
    found = candidates(records, chunks, chunk_vectors, document_vectors, dim, category)
    near = cut(lists(every, found, dim))
    fused = retrieval.reciprocal_rank_fusion(near, LIST)
    per = cut(retrieval.perspective_fusion(near, LIST))
    first = every.where("perspective = 0").select("question", F.transform("qv", lambda x: x.cast("double")).alias("q0"))
    known = fused.join(found, "chunk").join(first, "question").join(questions.select("question", F.col("version").alias("asked")), "question")
    length = F.length(T.normalize_passage(F.col("body")))
    known = cut(known.withColumn("direct", F.coalesce(_cosine("q0", "title_vector"), F.lit(0.0))).withColumn("concise", length.between(8, 280)).drop("q0", "title_vector").withColumnRenamed("title", "title_text"))
    # the identities of the documents with the nearest titles, read by the scorer as well
    leads = known.where("chunk_index = 0").withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("direct"), "chunk"))).where(F.col("n") <= TITLES)
    leads = retrieval.distinct_by(leads, "question", F.coalesce(F.nullif(F.btrim("topic"), F.lit("")), F.col("document")), "n")
    identity = scoring.reranker_text(F.col("title_text"), F.col("breadcrumbs"), F.col("category"), F.col("version"), F.col("title_text"))
    asked = questions.select("question", T.compose(F.col("text"), code=F.col("code")).alias("asked_text"))
    titles = cut(_scored(leads.join(asked, "question").select("question", "document", "chunk", "asked_text", identity.alias("passage")), "passage", scorer))
    overall = retrieval.rerank_pool(known, per, titles, POOL)
    preferred = known.where("asked is not null and version = asked").withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("rrf"), "chunk"))).where(F.col("place") <= POOL).select("question", "chunk")
    with_titles = known.join(titles.select("question", "document", F.col("logit").alias("title")), ["question", "document"], "left")

    def placed(pool: DataFrame) -> DataFrame:
        rows = reranked(with_titles.join(pool.select("question", "chunk"), ["question", "chunk"], "left_semi"), per, every, questions, scorer)
        ordered = retrieval.consensus(rows.withColumnRenamed("chunk", "of_chunk").withColumnRenamed("item", "chunk"))
        return scoring.preferred_version(ordered, "asked", SUPPORT).withColumnRenamed("chunk", "item").withColumnRenamed("of_chunk", "chunk")

    own = cut(placed(preferred))
    # the asked version serves if one of its rows is good enough; else all versions do
    served = own.where((F.col("version") == F.col("asked")) & (F.col("logit") >= SUPPORT)).select("question").distinct()
    rest = cut(placed(overall.join(served, "question", "left_anti")))
    rows = cut(own.join(served, "question", "left_semi").unionByName(rest).withColumn("length", F.length(T.compact(F.col("body"), 900))).where("length >= 3"))
    rows = rows.withColumn("identity", F.coalesce(F.nullif(F.btrim("topic"), F.lit("")), F.col("document")))
    gate = retrieval.support_gate(rows.select("question", F.col("item").alias("chunk"), "logit", "direct", F.col("identity").alias("topic"), "place"))
    chosen = retrieval.select_responses(rows.select("question", "item", "document", "chunk_index", "span", "topic", "logit", "direct", F.col("title").cast("double").alias("title"), "vector", "place", "length", "coverage"), picks)
    texts = rows.select("question", "item", "document", "version", F.col("title_text").alias("t"), "body")
    lead = rows.select("question", F.col("item").alias("lead"), F.col("body").alias("lead_body"))
    said = chosen.join(texts, ["question", "item"]).join(lead, ["question", "lead"], "left")
    body = F.when(F.col("lead_body").isNotNull(), T.combine_evidence(T.compact(F.col("lead_body"), 1150), T.compact(F.col("body"), 450))).otherwise(F.col("body"))
    parts = said.groupBy("question").agg(F.sort_array(F.collect_list(F.struct("pick", "document", "version", F.col("t").alias("title"), T.compact(body, 1600).alias("body")))).alias("parts"))
    out = questions.select("question", F.col("version").alias("asked")).join(gate, "question", "left").join(parts, "question", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
    shown = F.when(F.col("supported"), F.col("parts"))
    fragments = F.transform("parts", lambda p: F.struct(p["title"].alias("title"), p["body"].alias("body")))
    cited = F.coalesce(F.array_distinct(F.transform(shown, lambda p: p["document"])), F.array().cast("array<string>"))
    return out.select(
        "question", "supported", F.coalesce("confidence", F.lit("low")).alias("confidence"), "logit", "agree", "topics",
        retrieval.render_answer(fragments, F.col("supported"), F.get("parts", F.lit(0))["version"], F.col("asked")).alias("answer"), cited.alias("citations"),
        F.get(shown, F.lit(0))["version"].alias("version"), retrieval.coverage_status(F.col("supported"), F.size(cited), F.size(cited)).alias("coverage"),
    )
