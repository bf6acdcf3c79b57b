"""Corpus tables as Parquet, manifests and trace files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylake.functions import text as T

TABLES = ("documents", "document_records", "raw_pages", "document_sections", "chunks", "chunk_vectors", "document_vectors", "question_bank", "qa_cases", "eval_cases", "review_labels", "source_registry", "events", "embeddings")
MANIFEST_SCHEMA = "schemaVersion int, corpusVersion string, generatedAt string, sources array<struct<id string, kind string, name string>>, documents array<struct<id string, title string, version string, category string, sha256 string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the folder of ``spark.checkpoint.dir``. Only
    a local session gets a temporary folder where that is unset; on a cluster every
    executor would write to a disk of its own, so there it is an error."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_pack(tables: dict[str, DataFrame], folder: str, partition: dict[str, str] | None = None) -> None:
    """Write tables, some partitioned by a column of few values."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition and name in partition:
            w = w.partitionBy(partition[name])
        w.parquet(f"{folder}/{name}.parquet")


def point_read(documents: DataFrame, key: str, value: object) -> DataFrame:
    """One document; the filter reaches the Parquet scan."""
    return documents.where(F.col(key) == value)


def manifests(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Documents of all manifests that exist, with the file they come from; an error if none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not found:
        raise FileNotFoundError("no manifest")
    rows = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(found)
    return rows.select("corpusVersion", F.explode("documents").alias("d")).select("corpusVersion", "d.*")


def trace_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line, event, corrupt) of JSON lines, tolerant of broken ones; blank lines are left out."""
    lines = spark.read.text(path).where(F.btrim("value") != "")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", schema).alias("event"), F.try_parse_json("value").isNull().alias("corrupt"))
    return parsed


def trace_tail(spark: SparkSession, path: str, schema: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(last ``most`` readable events by file and place, one row of counts: lines,
    corrupt, omitted). Blank lines are left out; only one global top-k is sorted."""
    at = ["_metadata.file_name", "_metadata.file_block_start"]
    lines = spark.read.text(path).select("value", F.col(at[0]).alias("file"), F.col(at[1]).alias("block"), F.monotonically_increasing_id().alias("n")).where(F.btrim("value") != "")
    parsed = lines.select("file", "block", "n", F.from_json("value", schema).alias("event"), F.try_parse_json("value").isNull().alias("corrupt"))
    last = parsed.where("not corrupt").orderBy(F.desc("file"), F.desc("block"), F.desc("n")).limit(most)
    counts = parsed.agg(F.count("*").alias("lines"), F.count_if("corrupt").alias("corrupt"), F.greatest(F.count_if(~F.col("corrupt")) - most, F.lit(0)).alias("omitted"))
    return last.orderBy("file", "block", "n").select("event.*"), counts


def rotate(spark: SparkSession, folder: str, most_bytes: int = 5 << 20, most_files: int = 5) -> list[str]:
    """Delete the oldest files of a trace folder beyond ``most_files`` or ``most_bytes``
    in all; the newest file stays. Returns the names that are gone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((s for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda s: (s.getModificationTime(), s.getPath().getName()), reverse=True)
    size, gone = 0, []
    for place, status in enumerate(files):
        size += status.getLen()
        if place and (place >= most_files or size > most_bytes):
            gone.append(status.getPath().getName())
            fs.delete(status.getPath(), False)
    return gone


def write_report(report: dict[str, DataFrame], path: str) -> None:
    """Every table of a report as JSON lines in a folder of its own."""
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def markdown(df: DataFrame, title: str, most: int = 100) -> str:
    """The first ``most`` rows as a Markdown table; for reports of few rows."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(most).collect()])


def append_trace(events: DataFrame, path: str, text: str | None = None) -> None:
    """Append events as JSON lines; a text column is fingerprinted and redacted first."""
    if text:
        events = events.withColumn("fingerprint", T.fingerprint(F.col(text), 16)).withColumn("preview", T.redact(F.col(text))).drop(text)
    events.write.mode("append").json(path)


def licensed(registry: DataFrame, allow_unknown: bool = False, include_dev: bool = False) -> DataFrame:
    """Sources whose licence allows use: restricted never, unknown only if asked for."""
    status = F.lower(F.coalesce("license_status", F.lit("unknown")))
    ok = (status != "restricted") & (F.lit(allow_unknown) | (status != "unknown"))
    if not include_dev:
        ok = ok & ~F.coalesce("dev_only", F.lit(False))
    return registry.where(ok)
