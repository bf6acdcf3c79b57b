"""One object over the tables of a corpus: search, read, related, assist, reports.

Scorers are plug-ins: an embedder turns texts into unit vectors, a reranker gives
logits for questions and passages. The default ones look at words; they are
deterministic and meant for tests, not for quality.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import text as T
from quarrylake.operators import evaluation, pipeline, quality, retrieval, scoring, structure, trace, vectors
from quarrylake.operators.dedupe import first_per_key
from quarrylake.sources import store

Embedder = Callable[[list[str]], np.ndarray]
#: By depth: passages of an answer, documents to read.
DEPTHS = {"concise": (3, 3), "standard": (3, 5), "deep": (4, 8)}
LIMITS = {"question": 16_000, "code": 100_000, "version": 256, "category": 512, "language": 256}
#: What other kinds of requests ask; each is one question.
TEMPLATES = {
    "answer": "{text}", "resolve": "{text}", "context": "{text}", "message": "Explain the message {text}: its cause and its recovery.",
    "compile": "Compile {text}: which command, parameters and options apply?", "validate": "Check this code against the documentation: {text}",
    "compare": "What differs between versions about {text}?",
}


def hashing_embedder(dim: int = 64) -> Embedder:
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def checked(name: str, value: str | None) -> str | None:
    if value is not None and len(value) > LIMITS[name]:
        raise ValueError(f"{name} is longer than {LIMITS[name]}")
    return value


def clamp(value: int | float | None, default: int, least: int, most: int) -> int:
    """A whole number within bounds; the default for none."""
    return default if value is None else max(least, min(most, int(value)))


class Corpus:
    def __init__(self, spark: SparkSession, folder: str, embed: Embedder | None = None, dim: int = 64, scorer: Callable = scoring.word_overlap):
        self.spark, self.folder, self.dim = spark, folder, dim
        self.embed, self.scorer = embed or hashing_embedder(dim), scorer

    def table(self, name: str) -> DataFrame:
        return store.table(self.spark, self.folder, name)

    def records(self) -> DataFrame:
        return first_per_key(self.table("document_records"), ["id"], ["record_no"])

    def _similarities(self, question: str, category: str | None) -> DataFrame:
        """(question, perspective, document, chunk, sim) of all chunks of the category with
        every view of the question: by text, for the first chunk of a document also by title."""
        views = structure.query_perspectives(self.spark.createDataFrame([(0, question)], "k int, q string"), "k", "q").orderBy("perspective").collect()  # at most four
        if not views:
            raise ValueError("the question is empty")
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.embed([r["query"] for r in views]))], "qid int, qv array<double>")
        docs = self.records().select(F.col("id").alias("document_id"), "category")
        if checked("category", category) is not None:
            docs = docs.where(F.col("category") == category)
        chunks = self.table("chunks").join(docs, "document_id", "left_semi").select(F.col("chunk_id").alias("chunk"), F.col("document_id").alias("document"), "chunk_index")
        rows = self.table("chunk_vectors").join(chunks.select(F.col("chunk").alias("chunk_id")), "chunk_id", "left_semi")
        titles = self.table("document_vectors").join(docs, "document_id", "left_semi")
        find = lambda df, key, column: vectors.block_search(df, asked, key, column, "qid", "qv", None, self.dim, skip_self=False, unit=True)
        title = find(titles, "document_id", "title_vector").groupBy("qid", "rid").agg(F.max("sim").alias("sim"))
        sims = vectors.facet_similarity(find(rows, "chunk_id", "vector"), title, chunks)
        return sims.select(F.lit(0).alias("question"), F.col("qid").alias("perspective"), "document", "chunk", "sim")

    def search(self, question: str, version: str | None = None, category: str | None = None, limit: int | None = None) -> DataFrame:
        """(document_id, title, version, category, score, place, expanded, snippet), by
        score, then title: all documents of the category are scored, the version is the
        scope, widened if another version's topic answers better."""
        limit = clamp(limit, 8, 1, 50)
        sims = store.cut(self._similarities(checked("question", question) or "", category))
        scores = retrieval.document_scores(sims)
        docs = self.records().select(F.col("id").alias("document"), "title", "record_no", F.coalesce(F.nullif("canonical_topic_key", F.lit("")), "id").alias("topic"), F.col("doc_version").alias("version"), "category")
        rows = scores.join(docs, "document").select("question", F.col("record_no").alias("document"), F.col("document").alias("document_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "title", "topic", "version", "category")
        if version is not None:
            scope = self.spark.range(1).select(F.lit(0).alias("question"), T.normalize_version(F.lit(checked("version", version))).alias("version"))
            kept = retrieval.scope_expansion(rows, scope, limit).select("document", "expanded")
        else:
            kept = rows.orderBy(F.desc("score"), "title", "document").limit(limit).select("document", F.lit(False).alias("expanded"))
        shown = rows.join(kept, "document")
        # the best passages of what is shown
        best = retrieval.top_passages(sims.join(shown.select(F.col("document_id").alias("document")), "document", "left_semi"))
        bodies = self.table("chunks").select(F.col("chunk_id").alias("chunk"), "body")
        texts = best.select("document", F.posexplode("passages").alias("n", "p")).select("document", "n", F.col("p.chunk").alias("chunk")).join(bodies, "chunk").groupBy("document").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "body"))), lambda x: x["body"]).alias("bodies"))
        out = shown.join(texts.withColumnRenamed("document", "document_id"), "document_id", "left")
        order = F.expr("row_number() over (order by score desc, title, document)")
        snippet = T.snippet(T.join_unique(F.coalesce("bodies", F.array().cast("array<string>")), 4000), 700)
        return out.select("document_id", "title", "version", "category", "score", order.alias("place"), "expanded", snippet.alias("snippet")).orderBy("place")

    def read(self, document_id: str) -> DataFrame:
        """The record with its text."""
        doc = store.point_read(self.table("document_records"), "id", document_id)
        text = self.table("documents").select("normalized_text_path", "text")
        return doc.join(text, "normalized_text_path", "left")

    def sections(self, document_id: str) -> DataFrame:
        """Its sections; for a document without any the beginning of its text."""
        found = self.table("document_sections").where(F.col("document_id") == document_id).select(F.col("document_id").alias("id"), "section_index", "section_kind", "title", "body", "start_line", "end_line")
        docs = self.read(document_id).where("text is not null").select("id", "text").limit(1)
        return structure.read_sections(docs, found, "id", "text").withColumnRenamed("id", "document_id").orderBy("section_index")

    def related(self, document_id: str, limit: int | None = None) -> DataFrame:
        docs = self.table("document_records")
        topic = docs.where(F.col("id") == document_id).select("canonical_topic_key").distinct()
        return docs.join(topic, "canonical_topic_key", "left_semi").where(F.col("id") != document_id).select("id", "title").distinct().orderBy("id").limit(clamp(limit, 5, 1, 50))

    def answers(self, questions: DataFrame, category: str | None = None, depth: str = "standard") -> DataFrame:
        """``pipeline.answers`` for many questions (question, text, language, code, version)."""
        embed = self.embed
        tables = (self.table(n) for n in ("document_records", "chunks", "chunk_vectors", "document_vectors"))
        return pipeline.answers(questions, *tables, lambda: embed, self.scorer, self.dim, category, DEPTHS[depth][0])

    def assist(self, question: str, version: str | None = None, language: str | None = None, code: str | None = None, category: str | None = None, depth: str = "standard") -> dict:
        """An answer with what it rests on, or none where nothing supports one."""
        for name, value in (("question", question), ("version", version), ("language", language), ("code", code), ("category", category)):
            checked(name, value)
        if not (question or "").strip():
            raise ValueError("the question is empty")
        wanted = self.spark.range(1).select(F.lit(0).cast("long").alias("question"), F.lit(question).alias("text"), F.lit(language).cast("string").alias("language"), F.lit(code).cast("string").alias("code"), T.normalize_version(F.lit(version).cast("string")).alias("version"))
        row = self.answers(wanted, category, depth).first().asDict()
        return {k: v for k, v in row.items() if k != "question"} | {"reads": row["citations"][: DEPTHS[depth][1]]}

    def ask(self, kind: str, text: str, **options) -> dict:
        """Other kinds of requests, put as a question to ``assist``."""
        return self.assist(TEMPLATES[kind].format(text=text), **options)

    def compare_versions(self, question: str, versions: list[str]) -> dict[str, str | None]:
        """The best document of each version, scored once for all."""
        sims = self._similarities(checked("question", question) or "", None)
        docs = self.records().select(F.col("id").alias("document"), "title", F.col("doc_version").alias("version"))
        best = retrieval.document_scores(sims).join(docs, "document").where(F.col("version").isin(versions))
        top = first_per_key(best.select("version", "document", "score", "title"), ["version"], [F.desc("score"), "title", "document"]).collect()  # one row a version
        return {v: next((r["document"] for r in top if r["version"] == v), None) for v in versions}

    def explain_ranking(self, question: str, version: str | None = None, category: str | None = None, top: int = 5) -> dict:
        """The views of the question and what each hit scores by them."""
        hits = self.search(question, version, category, top)
        views = structure.query_perspectives(self.spark.createDataFrame([(0, question)], "k int, q string"), "k", "q").orderBy("perspective")
        parts = retrieval.document_scores(self._similarities(question, category)).select(F.col("document").alias("document_id"), "primary", "median", "best")
        return {"views": [r["query"] for r in views.collect()], "results": hits.join(parts, "document_id").orderBy("place")}

    def report_query(self, question: str, expected_title: str | None = None, expected_id: str | None = None, **options) -> dict:
        """Whether the first hit is the expected one, and a text that says so."""
        hits = self.search(question, **options).collect()  # at most 50 rows
        top = hits[0] if hits else None
        ok = (not expected_title or (top is not None and expected_title in (top["title"] or ""))) and (not expected_id or (top is not None and top["document_id"] == expected_id))
        lines = [f"# Search report\n\nQuestion: {question}", f"First: {top['title']} ({top['document_id']})" if top else "First: none", f"As expected: {ok}", ""]
        return {"pass": bool(ok), "results": hits, "markdown": "\n".join(lines + [f"{h['place']}. {h['title']} [{h['version']}/{h['category']}] score={h['score']}" for h in hits])}

    def golden(self, queries: list[dict]) -> DataFrame:
        """``evaluation.golden_check`` of queries (name, query, version, category, first_title, contains_title, pattern)."""
        hits = None
        for q in queries:
            own = self.search(q["query"], q.get("version"), q.get("category"), 5).select(F.lit(q["name"]).alias("name"), "place", "title")
            hits = own if hits is None else hits.unionByName(own)
        wanted = self.spark.createDataFrame([tuple(q.get(c) for c in ("name", "first_title", "contains_title", "pattern")) for q in queries], "name string, first_title string, contains_title string, pattern string")
        return evaluation.golden_check(hits, wanted)

    def categories(self) -> dict[str, DataFrame]:
        docs = self.table("document_records")
        return {f"by_{c}": quality.count_by(docs, c) for c in ("category", "doc_version", "source_kind")}

    def pack_diagnostics(self) -> DataFrame:
        """(metric, n): documents, chunks, records without their text, paths that are long
        or leave the folder, and what lacks chunks or vectors."""
        docs, chunks = self.table("document_records"), self.table("chunks")
        missing = docs.where("normalized_text_path is not null").join(self.table("documents"), "normalized_text_path", "left_anti")
        path = F.col("normalized_text_path")
        counts = docs.agg(F.count("*").alias("documents"), F.count_if(F.length(path) > 240).alias("long_paths"), F.count_if(~T.is_safe_relative(path)).alias("unsafe_paths"))
        rows = counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in counts.columns]), F.array(*counts.columns))).alias("metric", "n"))
        rows = rows.unionByName(chunks.agg(F.lit("chunks").alias("metric"), F.count("*").alias("n"))).unionByName(missing.agg(F.lit("missing_texts").alias("metric"), F.count("*").alias("n")))
        return rows.unionByName(quality.vector_coverage(docs, chunks, self.table("chunk_vectors"), self.table("document_vectors")))

    def release_gate(self, declared: DataFrame, releases: list[str], **thresholds) -> DataFrame:
        docs = self.table("document_records")
        missing = docs.where("normalized_text_path is not null").join(self.table("documents"), "normalized_text_path", "left_anti")
        coverage = quality.vector_coverage(docs, self.table("chunks"), self.table("chunk_vectors"), self.table("document_vectors"))
        return quality.release_gate(docs, declared, missing, coverage, releases, **thresholds)

    def model_info(self) -> dict[str, str]:
        return scoring.model_info(self.embed, self.scorer)

    def quality_report(self) -> dict[str, DataFrame]:
        docs = self.table("document_records")
        return {
            "gate": quality.quality_gate(docs), "coverage": quality.coverage(docs), "duplicate_titles": quality.duplicate_titles(docs), "exact_duplicates": quality.exact_duplicates(docs), "duplicate_topics": quality.duplicate_topics(docs),
            "vectors": quality.vector_coverage(docs, self.table("chunks"), self.table("chunk_vectors"), self.table("document_vectors")),
        }

    def trace_report(self, tool: str = "event_type", search: str = "view", read: str = "click", assist: str = "signup") -> dict[str, DataFrame]:
        e = self.table("events")
        return {"by_tool": trace.by_tool(e, tool), "rates": trace.rates(e, tool, search, read, assist), "followed": trace.search_then_read(e, tool, "user_id", search, read)}
