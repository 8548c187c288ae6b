"""Keyed merging: keep-first, latest-per-key, upsert, get-or-create and replacement of partitions.

Rows of a key meet as partial aggregates (min_by, max_by), so a hot key needs no large group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _picked(df: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest)).alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def keep_first(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _picked(df, keys, lambda row: F.min_by(row, order))


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _picked(df, keys, lambda row: F.max_by(row, order))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key. A value that isn't null replaces the old one; in ``keep_old`` columns only a null one. Adds ``action``."""
    old, new = base.withColumn("_old", F.lit(True)), changes.withColumn("_new", F.lit(True))
    rest = [c for c in base.columns if c not in keys]
    both = old.alias("o").join(new.alias("n"), keys, "full")
    value = lambda c: F.coalesce(*(F.col(f"{x}.{c}") for x in ("on" if c in keep_old else "no")))
    action = F.when(F.col("_new").isNull(), "KEPT").when(F.col("_old").isNull(), "INSERTED").otherwise("UPDATED")
    return both.select(*keys, *[value(c).alias(c) for c in rest], action.alias("action"))


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and a row for each wanted key that it lacks; ``created`` tells them apart."""
    missing = wanted.select(*keys).distinct().join(existing.select(*keys), keys, "left_anti")
    return existing.select(*keys).withColumn("created", F.lit(False)).unionByName(missing.withColumn("created", F.lit(True)))


def replace_partitions(spark: SparkSession, df: DataFrame, path: str, column: str) -> None:
    """Writes the partitions of ``column`` that ``df`` has, in place of those that are there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
