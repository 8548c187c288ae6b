"""Traces of files, jobs, batches and extractions: their newest events, progress and last usable file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import last_before

#: What events are called.
EVENT_LABELS = {
    "FILE_REGISTERED": "Arquivo registrado", "FILE_REUSED": "Arquivo reutilizado (dedup)", "JOB_QUEUED": "Job enfileirado", "JOB_STARTED": "Job iniciado",
    "JOB_PROGRESS": "Job em progresso", "JOB_COMPLETED": "Job concluído", "JOB_FAILED": "Job com falha",
}


def is_error(kind: Column, payload: Column) -> Column:
    """A failed job, or a payload that speaks of an error."""
    return F.coalesce(kind == "JOB_FAILED", F.lit(False)) | F.coalesce(F.lower(payload).rlike("error|falha|failed"), F.lit(False))


def trace(events: DataFrame, keys: list[str], order: list[Column], told: Column, most: int = 1000) -> DataFrame:
    """keys, n (all their events) and trace, an array of what is told of the first ``most`` of them in the order.

    Every task keeps the first ones of its keys before anything is shuffled (a rank that is only compared with a limit), and counts are added up apart, so that a key with very many
    events is neither sorted nor gathered as a whole."""
    ranked = events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most)
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", told.alias("t")))).alias("trace"))
    counts = events.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(rows, keys).withColumn("trace", F.transform("trace", lambda x: x["t"]))


def progress(events: DataFrame, key: str) -> DataFrame:
    """key, current and total of the newest progress event, and status of the newest event (key, ts, event_id, kind, current, total)."""
    at = F.struct("ts", "event_id")
    last = F.max_by(F.struct("current", "total"), F.when(F.col("kind") == "JOB_PROGRESS", at))
    return events.groupBy(key).agg(last.alias("p"), F.max_by("kind", at).alias("status")).select(key, "p.current", "p.total", "status")


def last_usable(events: DataFrame, key: str, payload: str, path: str = "$.storageKey") -> DataFrame:
    """key and the value at the path in its newest event that has one."""
    value = F.try_variant_get(F.try_parse_json(payload), path, "string")
    found = events.withColumn("_v", value).filter("_v is not null")
    return found.groupBy(key).agg(F.max_by("_v", F.struct("ts", "event_id")).alias("storage_key"))


def joined_trace(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[Column], Column]], most: int = 1000) -> DataFrame:
    """The parent's rows with an array and a count of each kind of child (its table with the key, its order in whole numbers or times, and what is told of it).

    All kinds go through one shuffle, each row with its kind; of a key's kind every task passes on ``most`` rows at most, and counts."""
    width = max(len(order) for _, order, _ in children.values())
    number = lambda c: F.coalesce(c.cast("long"), F.lit(None).cast("long"))
    rows = None
    for name, (child, order, told) in children.items():
        places = [number(c) for c in order] + [F.lit(None).cast("long")] * (width - len(order))
        own = child.select(key, F.lit(name).alias("_kind"), *[c.alias(f"_o{i}") for i, c in enumerate(places)], told.cast("string").alias("_t"))
        rows = own if rows is None else rows.unionByName(own)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_kind").orderBy(*[f"_o{i}" for i in range(width)]))).filter(F.col("_r") <= most)
    lists = first.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("_kind") == name, F.struct("_r", "_t")))).alias(name) for name in children])
    counts = rows.groupBy(key).agg(*[F.count_if(F.col("_kind") == name).alias(f"n_{name}") for name in children])
    found = counts.join(lists, key).select(key, *[c for name in children for c in (f"n_{name}", F.transform(name, lambda x: x["_t"]).alias(name))])
    out = parent.join(found, key, "left")
    return out.withColumns({c: v for name in children for c, v in ((f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long"))), (name, F.coalesce(name, F.array().cast("array<string>"))))})


def priced(uses: DataFrame, prices: DataFrame, per: int) -> DataFrame:
    """uses (ts, event_id, tokens) with their price and cost at the price (ts, event_id, price) that was valid then; uses before any price are left out. Of prices of one time the one with the greatest id counts."""
    return last_before(uses, prices, "ts", "price", "event_id").withColumn("cost", F.col("tokens") * F.col("price") / per)
