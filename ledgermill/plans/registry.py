"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the named tables (its parameters), with its SQL."""

    def add(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[spark if n == "spark" else sf_dir if n == "sf_dir" else table(spark, sf_dir, n) for n in names])
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def money(name: str):
    return F.col(name).cast("decimal(18,2)")


def cases(rows: list[tuple[str | None, dict[str, str | None]]], base: str = "customer", key: str = "c_custkey"):
    """Registers a function of ``docs`` (doc_id, text): every row of the base table gets the text of its case in turn, with its key in place
    of {k}. ``rows``: a text, and the values of the columns that are expected of it, as text. The SQL knows these values only."""
    names = list(rows[0][1])
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            texts = F.array(*[F.lit(t) for t, _ in rows])
            k = F.col(key).cast("string")
            text = F.replace(F.element_at(texts, (F.col(key) % len(rows) + 1).cast("int")), F.lit("{k}"), k)
            # a small file is one part or few, but its rows are long work: all cores share them
            keys = table(spark, sf_dir, base).select(key).repartition(max(64, 4 * spark.sparkContext.defaultParallelism), key)
            found = f(keys.select(F.col(key).cast("long").alias("doc_id"), text.alias("text")))
            return found.select("doc_id", *[F.col(n).cast("string").alias(n) for n in names])

        QUERIES[f.__name__] = run
        values = ", ".join(f"({i}, " + ", ".join(quoted(v[n]) for n in names) + ")" for i, (_, v) in enumerate(rows))
        ORACLE_SQL[f.__name__] = f"SELECT {key}::BIGINT AS doc_id, " + ", ".join(f"replace({n}::VARCHAR, '{{k}}', {key}::VARCHAR) AS {n}" for n in names) + f" FROM {base} JOIN (VALUES {values}) c(i, {', '.join(names)}) ON {key} % {len(rows)} = i"
        return f

    return add
