"""Same or nearly the same questions on both sides of a split.

Exact set-similarity join by prefix filtering. Every record is the set of its
distinct words. The words of a record are ordered from rare to frequent by a
frequency sketch of fixed size (any total order keeps the join exact; the sketch
only decides how selective it is), and two sets that share enough words must share
one of the first few. Evaluation prefixes are joined with training prefixes on the
word, with length, position and bitmap filters inside the join; the rare survivors
are verified on their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import WORD, WordHashes, fold_accents, stored

#: Number of counters in the frequency sketch; its size does not depend on the data.
SKETCH_BITS = 15
#: Pairs of prefix entries of one word that one task may look at; words with more are split.
PAIRS_A_TASK = 4_000_000


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(fold_accents(text))) if text else set()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        found: list[int] = []
        for text in b.column("text").to_pylist():
            found += [hashes[w] for w in words_of(text)]
        if found:
            slots = np.array(found, np.uint64) >> np.uint64(64 - SKETCH_BITS)
            counts += np.bincount(slots.astype(np.int64), minlength=1 << SKETCH_BITS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["slot", "n"])


def word_frequencies(df: DataFrame, text: str) -> np.ndarray:
    """Counts of all rows' words, hashed into 2**SKETCH_BITS counters."""
    rows = df.select(F.col(text).alias("text")).mapInArrow(_sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def prefix_length(size: int, threshold: Fraction) -> int:
    return size - math.ceil(threshold * size) + 1


def set_overlaps(left: DataFrame, right: DataFrame, key: str, text: str, threshold: float = 0.7) -> DataFrame:
    """(left_key, right_key, similarity) of every pair of a left and a right row
    whose sets of distinct words (lower case, no accents) have a Jaccard
    similarity of at least ``threshold``.

    Texts that are null, empty or without a word match nothing. Rows of the same
    word set are one class during the search, so a question that fills a third of
    a table costs one record; its rows come back at the end. Repeated keys on a
    side are allowed and give one row per distinct pair. Other columns, of
    whatever name, are not read.
    """
    t = Fraction(str(threshold))
    spark = left.sparkSession
    both = left.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(0).alias("side")).unionByName(right.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(1).alias("side")))
    freq = spark.sparkContext.broadcast(word_frequencies(both, "text"))
    shift = np.uint64(64 - SKETCH_BITS)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), freq.value
        for b in batches:
            rows: list[int] = []
            digest, size, bits, prefix = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                h = np.array([hashes[w] for w in words], np.uint64)
                h = h[np.lexsort((h, counts[(h >> shift).astype(np.int64)]))]
                rows.append(i)
                digest.append(xxhash.xxh3_128_digest(np.sort(h).tobytes()))
                size.append(len(h))
                slots = np.bitwise_or.reduce(np.left_shift(np.uint64(1), h & np.uint64(63)))
                more = np.bitwise_or.reduce(np.left_shift(np.uint64(1), (h >> np.uint64(6)) & np.uint64(63)))
                bits.append([int(slots.view(np.int64)), int(more.view(np.int64))])
                prefix.append(h[: prefix_length(len(h), t)].view(np.int64))
            idx = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(idx), b.column("side").take(idx), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array([x[0] for x in bits], pa.int64()), pa.array([x[1] for x in bits], pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["key", "side", "digest", "size", "bits", "more", "prefix"],
            )

    kind = left.schema[key].dataType.simpleString()
    records = stored(both.mapInArrow(describe, f"key {kind}, side int, digest binary, size int, bits long, more long, prefix array<long>"))
    classes = records.groupBy("digest").agg(
        F.max((F.col("side") == 0).cast("int")).alias("has_left"), F.max((F.col("side") == 1).cast("int")).alias("has_right"),
        F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("more").alias("more"), F.first("prefix").alias("prefix"),
    )
    entries = classes.select("digest", "has_left", "has_right", "size", "bits", "more", F.posexplode("prefix").alias("pos", "word"))
    side = lambda name, letter: entries.where(f"{name} = 1").select("word", *[F.col(c).alias(f"{letter}_{c}") for c in ("digest", "size", "bits", "more", "pos")])
    a, b = _split_frequent(side("has_left", "a"), side("has_right", "b"), entries, t)
    num, den = t.numerator, t.denominator
    # overlap needed: ceil(t / (1 + t) * (a + b))
    need = F.ceil((F.col("a_size") + F.col("b_size")) * num / (num + den) - 1e-9)
    differing = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")))
    differing2 = F.bit_count(F.col("a_more").bitwiseXOR(F.col("b_more")))
    spare = F.col("a_size") + F.col("b_size") - 2 * need
    close = (
        (F.col("a_size") * den >= F.col("b_size") * num) & (F.col("b_size") * den >= F.col("a_size") * num)
        & (1 + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) - 1 >= need)
        & (differing <= spare) & (differing2 <= spare)
    )
    pairs = stored(a.join(b, ["word", "step", "salt"]).where(close).select("a_digest", "b_digest").distinct())
    return _verified(pairs, records, both, t)


def _split_frequent(a: DataFrame, b: DataFrame, entries: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Adds step and salt to both sides, to be joined on together with the word.

    A word that too many entries share is split by size of the record (``step``: sizes
    within a factor of the threshold; only equal and neighbouring steps can match) and
    its left entries at random (``salt``), its right entries going to every salt.
    """
    often = entries.groupBy("word").agg((F.sum("has_left") * F.sum("has_right")).alias("n")).where(F.col("n") > PAIRS_A_TASK)
    often = stored(often.select("word", F.ceil(F.sqrt(F.col("n") / PAIRS_A_TASK)).cast("int").alias("salts")))
    if often.isEmpty():
        zero = [F.lit(0).alias("step"), F.lit(0).alias("salt")]
        return a.select("*", *zero), b.select("*", *zero)
    step = lambda size: F.floor(F.log(size) / F.lit(-math.log(t.numerator / t.denominator)) + 1e-9).cast("int")
    a = a.join(often, "word", "left")
    a = a.withColumn("step", F.when(F.col("salts").isNull(), 0).otherwise(step(F.col("a_size")))).withColumn("salt", F.coalesce(F.expr("cast(pmod(xxhash64(a_digest), salts) as int)"), F.lit(0))).drop("salts")
    b = b.join(often, "word", "left").withColumn("at", step(F.col("b_size")))
    b = b.withColumn("step", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1))))
    return a, b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts", "at")


def _verified(pairs: DataFrame, records: DataFrame, both: DataFrame, t: Fraction) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sims = [], []
            for i, (x, y) in enumerate(zip(b.column("a_text").to_pylist(), b.column("b_text").to_pylist())):
                u, v = words_of(x), words_of(y)
                common = len(u & v)
                union = len(u) + len(v) - common
                if common * t.denominator >= union * t.numerator:
                    keep.append(i)
                    sims.append(common / union)
            idx = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a_digest").take(idx), b.column("b_digest").take(idx), pa.array(sims, pa.float64())], names=["a_digest", "b_digest", "similarity"])

    # one text for each class that has a candidate
    wanted = pairs.select(F.explode(F.array("a_digest", "b_digest")).alias("digest")).distinct()
    sample = records.select("key", "side", "digest").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct("key", "side")).alias("s"))
    samples = sample.select("digest", "s.key", "s.side").join(both, ["key", "side"]).groupBy("digest").agg(F.min("text").alias("text"))
    true = (
        pairs.join(samples.select(F.col("digest").alias("a_digest"), F.col("text").alias("a_text")), "a_digest")
        .join(samples.select(F.col("digest").alias("b_digest"), F.col("text").alias("b_text")), "b_digest")
        .mapInArrow(check, "a_digest binary, b_digest binary, similarity double")
    )
    members = records.select("key", "side", "digest")
    return (
        true.join(members.where("side = 0").select(F.col("digest").alias("a_digest"), F.col("key").alias("left_key")), "a_digest")
        .join(members.where("side = 1").select(F.col("digest").alias("b_digest"), F.col("key").alias("right_key")), "b_digest")
        .select("left_key", "right_key", "similarity").distinct()
    )


def split_sides(qa: DataFrame, evals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows, and evaluation rows of both tables with split and source."""
    train = qa.where("split_name = 'train'").select("case_no", "question", F.lit("train").alias("split_name"), F.col("source_id").alias("source"))
    held = qa.where("split_name in ('validation', 'test')").select("case_no", "question", "split_name", F.col("source_id").alias("source"))
    return train, held.unionByName(evals.select("case_no", "question", "split_name", "source"))


def overlap_report(overlaps: DataFrame, held: DataFrame) -> DataFrame:
    """Per split and source of the evaluation side: overlapping pairs, rows touched,
    all rows. Null source or split is its own group."""
    touched = overlaps.groupBy(F.col("right_key").alias("case_no")).agg(F.count("*").alias("n"))
    return held.join(touched, "case_no", "left").groupBy("split_name", "source").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count("n").alias("n_overlapping"), F.count("*").alias("n_rows")
    )
