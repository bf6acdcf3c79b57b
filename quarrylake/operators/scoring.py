"""Pluggable models over tables: embedding texts, scoring passages, vector formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], np.ndarray]


def embed_texts(df: DataFrame, key: str, text: str, embedder: Callable[[], Embedder], prefix: str = "", batch: int = 256) -> DataFrame:
    """(key, dimensions, vector) of every non-blank text, at unit length.

    ``embedder`` is called once a task and returns the function that embeds a list.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = embedder()
        for f in frames:
            for start in range(0, len(f), batch):
                part = f.iloc[start : start + batch]
                v = embed([prefix + t for t in part["t"]])
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "dimensions": v.shape[1], "vector": list(v.astype(np.float32))})

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.btrim(F.coalesce(F.col(text), F.lit(""))) != "").select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, dimensions int, vector array<float>").withColumnRenamed("k", key)


def word_overlap(questions: list[str], passages: list[str]) -> np.ndarray:
    """A stand-in scorer for tests: logit of the share of question words in the passage."""
    out = np.zeros(len(questions))
    for i, (q, p) in enumerate(zip(questions, passages)):
        words = set(q.lower().split())
        share = len(words & set(p.lower().split())) / max(1, len(words))
        out[i] = 8 * share - 4
    return out


def rerank(df: DataFrame, question: str, passage: str, scorer: Scorer) -> DataFrame:
    """Adds ``logit`` and ``score`` = sigmoid(logit); rows with a blank passage are left
    out. Passages are passed whole; a limit in tokens is the scorer's own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            logit = scorer(f[question].fillna("").tolist(), f[passage].tolist()) if len(f) else np.zeros(0)
            yield f.assign(logit=logit, score=1 / (1 + np.exp(-np.asarray(logit))))

    rows = df.where(F.btrim(F.coalesce(F.col(passage), F.lit(""))) != "")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInPandas(run, schema + ", logit double, score double")


def preferred_version(rows: DataFrame, asked: str, least: float = 0.5) -> DataFrame:
    """New places: a question's first row of the asked version with a logit of at
    least ``least`` goes to the front; without such a row the order stays.

    ``rows`` has question, place, logit, version and the column ``asked``.
    """
    q = Window.partitionBy("question")
    fits = (F.col("version") == F.col(asked)) & (F.col("logit") >= least)
    front = F.min(F.when(fits, F.col("place"))).over(q)
    return rows.withColumn("_front", front).withColumn("place", F.row_number().over(q.orderBy(F.when(F.col("place") == F.col("_front"), 0).otherwise(1), "place"))).drop("_front")


def passage_text(title: Column, breadcrumbs: Column, body: Column, prefix: str = "passage: ") -> Column:
    """What an embedder reads of a chunk: title, trail and body on lines of their own."""
    trail = F.nullif(F.array_join(F.coalesce(breadcrumbs, F.array().cast("array<string>")), " > "), F.lit(""))
    return F.concat(F.lit(prefix), F.concat_ws("\n", F.nullif(title, F.lit("")), trail, body))


def title_text(title: Column, breadcrumbs: Column, category: Column, version: Column, prefix: str = "passage: ") -> Column:
    """What an embedder reads of a document's identity, without its text."""
    trail = F.nullif(F.array_join(F.coalesce(breadcrumbs, F.array().cast("array<string>")), " > "), F.lit(""))
    some = [F.nullif(c, F.lit("")) for c in (title, trail, category, version)]
    return F.concat(F.lit(prefix), F.btrim(F.concat_ws("\n", *some)))


def query_text(question: Column, prefix: str = "query: ") -> Column:
    return F.concat(F.lit(prefix), F.btrim(question))


def reranker_text(title: Column, breadcrumbs: Column, category: Column, version: Column, body: Column, product: str = "") -> Column:
    """What a reranker reads of a passage: title, trail, category, product and version, body."""
    trail = F.nullif(F.array_join(F.coalesce(breadcrumbs, F.array().cast("array<string>")), " > "), F.lit(""))
    release = F.nullif(F.btrim(F.concat_ws(" ", F.lit(product), F.nullif(version, F.lit("")))), F.lit(""))
    return F.concat_ws(". ", F.nullif(title, F.lit("")), trail, F.nullif(category, F.lit("")), release, F.nullif(body, F.lit("")))


def model_info(embedder: Callable, scorer: Callable) -> dict[str, str]:
    """Names of the plugged-in models."""
    return {"embedder": f"{embedder.__module__}.{embedder.__qualname__}", "scorer": f"{scorer.__module__}.{scorer.__qualname__}"}


def to_bytes(df: DataFrame, vector: str, out: str = "blob") -> DataFrame:
    """Vectors as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return df.withColumn(out, pack(F.col(vector)))


def from_bytes(df: DataFrame, blob: str, out: str = "vector") -> DataFrame:
    """The reverse; a blob whose length is no multiple of four is null."""

    @F.pandas_udf("array<float>")
    def unpack(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4"))

    return df.withColumn(out, unpack(F.col(blob)))
