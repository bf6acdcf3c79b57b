"""Trace files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylake.operators import trace

TRACE_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_trace(spark: SparkSession, path: str, schema: str = TRACE_SCHEMA) -> DataFrame:
    """New lines of JSON files in a folder; lines that are no JSON are dropped and can be counted with ``corrupt``."""
    return spark.readStream.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def counts(stream: DataFrame, at: str = "ts", tool: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts; events later than ``late`` behind the newest are left out."""
    return trace.windowed(stream.where(F.col(at).isNotNull()).withWatermark(at, late), at, tool, width)


def write_counts(result: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to Parquet; the checkpoint folder must be shared by all executors."""
    return result.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
