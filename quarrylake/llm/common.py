"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import unicodedata
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"\w+")

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, named by ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) gets a temporary folder where that is
    unset; on a cluster, where executors would each write to a disk of their own,
    an unset folder is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage; partitions and their order stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a
    checkpoint and read by column, but partitions may come back in other sizes."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more, and let Spark remove the
    shuffle files of plans that are gone."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession, at_least: int = 2) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions of at most about ``rows_each`` rows, whatever the number of rows."""
    return max(shuffle_width(spark, 4), math.ceil(rows / rows_each))


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= _MIX1
        x ^= x >> np.uint64(27)
        x *= _MIX2
        x ^= x >> np.uint64(31)
    return x


def unit_interval(x: np.ndarray) -> np.ndarray:
    """Hashes to floats in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a bound so that memory stays flat."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def fold_accents(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
