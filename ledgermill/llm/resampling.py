"""Importance resampling towards a target distribution: hashed n-gram features, a gain for each bucket, and a draw of the highest scores.

A document is scanned once, word by word. A ring keeps the running CRC-32 of the runs that began at the last n words; each word extends all of them by a
space and itself, and begins one of its own, so every run of 1 to n words gives its bucket without being built as a string.

The first pass adds up bucket counts within each task, so a task passes on a row a bucket at most. The gains (an integer for each bucket) are broadcast.
The second pass scans again, which costs less than keeping all buckets, and gives each document's numbers; these are written, and the
ranks come from sorting them by ranges, with each range's start added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .mixing import numbered

#: What counts as a part of a word: a-z after lower-casing A-Z, digits, and whatever is beyond ASCII.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are words in memory at a time.
PART = 1 << 20


@dataclass(frozen=True)
class Settings:
    longest: int = 2  #: words of a feature at most
    buckets: int = 10_000
    least: int = 20  #: words that a document needs to be drawn
    percent: int = 25  #: of those documents that are drawn
    seed: str = "7"


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, in lists from parts of it."""
    bare, at = raw.translate(_WORDS), 0
    while at < len(bare):
        end = bare.find(b" ", at + PART)
        end = len(bare) if end < 0 else end
        yield bare[at:end].split()
        at = end


def feature_buckets(raw: bytes, longest: int, buckets: int) -> tuple[int, list[int]]:
    """The number of words, and the bucket of every run of 1 to ``longest`` words."""
    ring: list[int] = []
    found: list[int] = []
    n = 0
    for part in words(raw):
        n += len(part)
        for word in part:
            more = b" " + word
            ring = [crc32(word), *[crc32(more, state) for state in ring[: longest - 1]]]
            found += ring
    return n, [x % buckets for x in found]


def _counts(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets, np.int64)
        for batch in common.slices(batches):
            for raw in common.text_bytes(batch.column("text")):
                _, found = feature_buckets(raw, s.longest, s.buckets)
                total += np.bincount(found, minlength=s.buckets) if found else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return common.frugal(run)


def bucket_counts(table: DataFrame, s: Settings) -> np.ndarray:
    """How many features of all texts fall into each bucket: one row a bucket comes to the driver."""
    found = table.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts(s), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(s.buckets, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's add-one share in the target over that in the source, in doubles."""
    k, n, m = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (n + k) / ((s + 1.0) * (m + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(s: Settings, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in common.slices(batches):
            rows = [feature_buckets(raw, s.longest, s.buckets) for raw in common.text_bytes(batch.column("text"))]
            weight = [int(gain[found].sum()) // len(found) if found else 0 for _, found in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([n for n, _ in rows], [len(found) for _, found in rows], weight))], ["doc_id", "n_words", "n_features", "weight"])

    return common.frugal(run)


def resample(docs: DataFrame, target: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs`` (doc_id, text; other columns are ignored) towards the texts of ``target`` (text).

    rank is 1, 2, 3 ... for the floor(percent * N / 100) highest scores of the N rows with ``least`` words or more, ties to the smaller id; it is null for the
    others. A null text has no words, no features and the weight 0. Without target texts every bucket has the target count 0. Rows that repeat an id, or have none
    (which stand before all ids in a tie), are judged one by one; equal rows have equal scores and take ranks next to each other. An empty table gives an empty result. Texts of any length are read whole, a part at a time."""
    s, spark, work = settings or Settings(), docs.sparkSession, common.Work(docs.sparkSession, "resampling")
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, s), bucket_counts(target, s)))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(s.seed), F.col("doc_id")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = docs.mapInArrow(_weights(s, gain), "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise)
    rows = work.save(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    able = rows.filter(F.col("n_words") >= s.least)
    n = able.count() * s.percent // 100
    placed = numbered(able, [F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col("row")], work, "sorted", "nth")
    placed = placed.withColumn("rank", F.when(F.col("nth") < n, F.col("nth") + 1))
    others = rows.filter(F.col("n_words") < s.least).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return placed.select(names).unionByName(others.select(names))
