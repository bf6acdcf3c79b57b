"""Counts, duplicates and gates over the documents of a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def _joined(column: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), "|")


def duplicate_titles(docs: DataFrame) -> DataFrame:
    """Titles of more than one document, with the versions they have."""
    return docs.groupBy("title").agg(F.count("*").alias("n"), _joined("doc_version").alias("versions")).where("n > 1")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    return docs.groupBy("title", "doc_version", "category", "sha256").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_topics(docs: DataFrame) -> DataFrame:
    """Topics with more documents than versions."""
    counted = docs.where("coalesce(canonical_topic_key, '') <> ''").groupBy("canonical_topic_key").agg(F.count("*").alias("n"), F.count_distinct("doc_version").alias("n_versions"), _joined("doc_version").alias("versions"))
    return counted.where("n > n_versions")


def expected_duplicates(docs: DataFrame) -> DataFrame:
    """Titles that recur over versions but in none of them twice."""
    many = docs.groupBy("title").agg(F.count("*").alias("n"), F.count_distinct("doc_version").alias("n_versions")).where("n > 1 and n_versions > 1")
    return many.join(exact_duplicates(docs).where("doc_version is not null").select("title").distinct(), "title", "left_anti")


def sparse_categories(docs: DataFrame, least: int = 5, share: float = 0.001) -> DataFrame:
    counts = docs.groupBy("category").agg(F.count("*").alias("n"))
    total = docs.agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).cast("long").alias("bar"))  # one row
    return counts.join(F.broadcast(total), F.col("n") < F.col("bar")).select("category", "n", "bar")


def vector_coverage(docs: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, document_vectors: DataFrame) -> DataFrame:
    """What is missing: documents without chunks, chunks and documents without vectors."""
    missing = [
        ("documents_without_chunks", docs.select(F.col("id").alias("k")).join(chunks.select(F.col("document_id").alias("k")), "k", "left_anti")),
        ("chunks_without_vectors", chunks.select(F.col("chunk_id").alias("k")).join(chunk_vectors.select(F.col("chunk_id").alias("k")), "k", "left_anti").select(F.col("k").cast("string"))),
        ("documents_without_vectors", docs.select(F.col("id").alias("k")).join(document_vectors.select(F.col("document_id").alias("k")), "k", "left_anti")),
    ]
    out = None
    for name, df in missing:
        row = df.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def release_gate(docs: DataFrame, declared: DataFrame, missing: DataFrame, coverage: DataFrame, releases: list[str], min_documents: int = 5000, max_stub: float = 0.015, max_short: float = 0.015, min_categories: int = 8, category_size: int = 50, release_size: int = 100, short: int = 300) -> DataFrame:
    """(name, actual, threshold, operator, ok) of all checks before a release: texts and
    vectors complete, number of documents, exact duplicates, categories as declared,
    substantial categories, share of stubs and of short documents, documents a release.

    ``declared`` has the counts a manifest states (value, n), ``missing`` the records
    whose text is not there, ``coverage`` the counts of what lacks vectors (metric, n).
    """
    one = docs.agg(F.count("*").alias("total"), F.count_if(F.col("text_length") < short).alias("short"), F.count_if(F.coalesce(F.col("document_kind"), F.lit("")) == "stub").alias("stub"), *[F.count_if(F.col("doc_version") == r).alias(f"r{i}") for i, r in enumerate(releases)])
    more = [
        docs.groupBy("category").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= category_size).alias("substantial")),
        exact_duplicates(docs).agg(F.count("*").alias("twice")),
        declared_consistency(declared, docs, "category").where("declared > 0").agg(F.count("*").alias("stated"), F.count_if("ok").alias("held")),
        missing.agg(F.count("*").alias("missing")),
        coverage.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uncovered")),
    ]
    for row in more:
        one = one.crossJoin(row)  # one row each
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(1.0))
    number = lambda c: F.col(c).cast("double")
    whole = ((F.col("missing") == 0) & (F.col("uncovered") == 0)).cast("double")
    checks = [
        ("integrity", whole, F.lit(1.0), "eq"), ("documents", number("total"), F.lit(float(min_documents)), "gte"), ("exact_duplicates", number("twice"), F.lit(0.0), "eq"),
        ("declared_categories", F.when(F.col("stated") > 0, number("held")).otherwise(F.lit(-1.0)), number("stated"), "eq"), ("substantial_categories", number("substantial"), F.lit(float(min_categories)), "gte"),
        ("stub_rate", rate("stub"), F.lit(max_stub), "lte"), ("short_rate", rate("short"), F.lit(max_short), "lte"), *[(f"release_{r}", number(f"r{i}"), F.lit(float(release_size)), "gte") for i, r in enumerate(releases)],
    ]
    holds = {"gte": lambda a, t: a >= t, "lte": lambda a, t: a <= t, "eq": lambda a, t: a == t}
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.round(a, 6).alias("actual"), t.alias("threshold"), F.lit(op).alias("operator"), holds[op](a, t).alias("ok")) for n, a, t, op in checks])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def failed_checks(gate: DataFrame) -> DataFrame:
    """One row: whether all checks hold, and the names of those that do not."""
    return gate.agg(F.bool_and("ok").alias("ok"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"))


def quality_gate(docs: DataFrame, short: int = 300, min_documents: int = 500, min_categories: int = 5, category_size: int = 20, max_short: float = 0.05) -> DataFrame:
    """Named checks: value, threshold, whether it holds. One pass over the documents
    and one over exact duplicates."""
    kind = F.coalesce(F.col("document_kind"), F.lit(""))
    base = docs.agg(F.count("*").alias("total"), F.count_if(F.col("text_length") < short).alias("short"), F.count_if(kind == "stub").alias("stub"))
    sizes = docs.groupBy("category").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= category_size).alias("substantial"))
    twice = exact_duplicates(docs).agg(F.count("*").alias("twice"))
    one = base.crossJoin(sizes).crossJoin(twice)  # one row each
    rate = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(1.0))
    checks = [
        ("documents", F.col("total").cast("double"), float(min_documents), "gte"),
        ("exact_duplicates", F.col("twice").cast("double"), 0.0, "eq"),
        ("substantial_categories", F.col("substantial").cast("double"), float(min_categories), "gte"),
        ("stub_rate", rate("stub"), max_short, "lte"),
        ("short_rate", rate("short"), max_short, "lte"),
    ]
    holds = {"gte": lambda a, t: a >= t, "lte": lambda a, t: a <= t, "eq": lambda a, t: a == t}
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.round(a, 6).alias("actual"), F.lit(t).alias("threshold"), F.lit(op).alias("operator"), holds[op](a, F.lit(t)).alias("ok")) for n, a, t, op in checks])
    return one.select(F.explode(rows).alias("c")).select("c.*")


def coverage(docs: DataFrame) -> DataFrame:
    """Counts by category, source kind, version and document kind in one pass."""
    sets = docs.groupingSets([["category"], ["source_kind"], ["doc_version"], ["document_kind"], []], "category", "source_kind", "doc_version", "document_kind").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n")
    )
    return sets.select("category", "source_kind", "doc_version", "document_kind", F.col("g").cast("int").alias("g"), "n")


def declared_consistency(declared: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """(value, declared, actual, ok) of counts a manifest declares (value, n)."""
    actual = count_by(docs, column).withColumnRenamed("n", "actual")
    both = declared.withColumnRenamed("n", "declared").join(actual, "value", "full_outer")
    return both.select("value", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("actual", F.lit(0)).alias("actual"), (F.coalesce("declared", F.lit(0)) == F.coalesce("actual", F.lit(0))).alias("ok"))


def tree_digest(folders: DataFrame) -> DataFrame:
    """(digest, n): SHA-256 over the sorted 'folder digest' lines of ``folder_digest``, of
    which there are as many as prefixes of names, a fixed number."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("folder", "digest"))), lambda x: F.concat(x["folder"], F.lit(" "), x["digest"], F.lit("\n"))), "")
    return folders.agg(F.sha2(lines, 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def folder_digest(files: DataFrame, path: str, sha: str, digits: int = 2) -> DataFrame:
    """(folder, digest, n): SHA-256 over the sorted 'path NUL sha LF' lines of each
    folder. A folder is the files whose names begin with the same ``digits``
    hexadecimal digits. Its sorted lines are hashed as they come, so a folder of any
    size needs no memory of its own."""
    folder = F.substring(F.regexp_extract(F.col(path), r"([^/]*)$", 1), 1, digits)
    line = F.concat(F.col(path), F.lit("\x00"), F.lower(F.col(sha)), F.lit("\n"))
    rows = files.where(F.col(path).isNotNull() & F.col(sha).isNotNull()).select(folder.alias("folder"), line.alias("line")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, digest = None, 0, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([last]), pa.array([digest.hexdigest()]), pa.array([n], pa.int64())], names=["folder", "digest", "n"])
        for b in batches:
            for name, text in zip(b.column("folder").to_pylist(), b.column("line").to_pylist()):
                if name != last:
                    if n:
                        yield done()
                    last, n, digest = name, 0, hashlib.sha256()
                digest.update(text.encode())
                n += 1
        if n:
            yield done()

    return rows.repartition("folder").sortWithinPartitions("folder", "line").mapInArrow(run, "folder string, digest string, n long")
