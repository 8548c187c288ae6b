"""Merges with a rule for each column, and versions of a row over time, of which closed ones are never changed."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def new(old: Column, value: Column) -> Column:
    """The new value, also a null one."""
    return value


def given(old: Column, value: Column) -> Column:
    """The new value, if there is one."""
    return F.coalesce(value, old)


def kept(old: Column, value: Column) -> Column:
    """The old value, if there is one."""
    return F.coalesce(old, value)


def greatest(old: Column, value: Column) -> Column:
    return F.greatest(old, value)


def added(old: Column, value: Column) -> Column:
    return F.coalesce(old, F.lit(0)) + F.coalesce(value, F.lit(0))


def merge_by_rules(base: DataFrame, changes: DataFrame, keys: list[str], rules: dict[str, Rule], defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of both by key (nulls are equal); ``changes`` has one row a key. Of a row that is in both the columns with a rule change by it, and no others; a new row takes what its change has,
    and the defaults elsewhere. Adds ``action``: KEPT, UPDATED or INSERTED."""
    defaults = defaults or {}
    there = set(changes.columns)
    o = base.select(*[F.col(c).alias(f"_o_{c}") for c in base.columns], F.lit(True).alias("_o"))
    n = changes.select(*[F.col(c).alias(f"_n_{c}") for c in changes.columns], F.lit(True).alias("_n"))
    both = o.join(n, reduce(and_, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys]), "full")
    action = F.when(F.col("_n").isNull(), "KEPT").when(F.col("_o").isNull(), "INSERTED").otherwise("UPDATED")

    def column(c: str) -> Column:
        old, value = F.col(f"_o_{c}"), F.col(f"_n_{c}") if c in there else F.lit(None).cast(base.schema[c].dataType)
        if c in keys:
            return F.when(F.col("_o").isNull(), value).otherwise(old)
        inserted = F.coalesce(value, defaults[c]) if c in defaults else value
        updated = rules[c](old, value) if c in rules else old
        return F.when(action == "KEPT", old).when(action == "INSERTED", inserted).otherwise(updated)

    return both.select(*[column(c).cast(base.schema[c].dataType).alias(c) for c in base.columns], action.alias("action"))


def apply_changes(history: DataFrame, changes: DataFrame, keys: list[str], values: list[str], at: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The new history and the refused changes.

    ``history``: keys, values, valid_from, valid_to (null: open), closed. ``changes``: keys, values (a null one changes nothing), the time ``at`` and, for changes of one time, their ``order``.
    A change inside a closed version is refused. Any other ends the version of its time there and opens the next one with the changed values, up to the next version; a change at a
    version's start takes its place. Versions that say the same as the one before are one with it, unless that is closed. Closed versions stay as they are."""
    closed = history.filter("closed").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("valid_from").alias("_f"), F.col("valid_to").alias("_t"))
    inside = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]) & (F.col(at) >= F.col("_f")) & (F.col("_t").isNull() | (F.col(at) < F.col("_t")))
    refused, accepted = changes.join(closed, inside, "left_semi"), changes.join(closed, inside, "left_anti")
    said = lambda c, always: F.when(F.lit(True) if always else F.col(c).isNotNull(), F.struct(F.col(c).alias("v"))).alias(f"_v_{c}")
    rows = history.select(*keys, F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_order"), "closed", F.col("valid_to").alias("_end"), *[said(c, True) for c in values])
    points = accepted.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(order).cast("long").alias("_order"), F.lit(False).alias("closed"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("_end"), *[said(c, False) for c in values])
    by = Window.partitionBy(*keys).orderBy("_at", "_kind", "_order")
    filled = rows.unionByName(points).select(*keys, "_at", "_kind", "_order", "closed", "_end", *[F.last(f"_v_{c}", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_v_{c}") for c in values])
    # the last of a time counts
    last = filled.withColumn("_next", F.lead("_at").over(by)).filter(F.col("_next").isNull() | (F.col("_next") > F.col("_at")))
    in_time = Window.partitionBy(*keys).orderBy("_at")
    same = reduce(and_, [F.col(f"_v_{c}").eqNullSafe(F.lag(f"_v_{c}").over(in_time)) for c in values])
    fresh = ~F.coalesce(same & ~F.lag("closed").over(in_time), F.lit(False)) | F.col("closed")
    versions = last.withColumn("_fresh", fresh).filter("_fresh").withColumn("valid_to", F.when(F.col("closed"), F.col("_end")).otherwise(F.lead("_at").over(in_time)))
    return versions.select(*keys, *[F.col(f"_v_{c}.v").alias(c) for c in values], F.col("_at").alias("valid_from"), "valid_to", "closed"), refused


def close_snapshots(snapshots: DataFrame, wanted: DataFrame, staff: DataFrame, expenses: DataFrame, key: str) -> DataFrame:
    """``snapshots`` (key, closed, hr_total, expense_total, total) after closing those of ``wanted`` (key): the sums of their eligible rows (key, amount, eligible), nulls as nought, and ``result``:
    CLOSED, REFUSED (it was closed before and stays as it is), UNKNOWN (there is no such snapshot) or null for the others. Children are summed by key before they meet."""
    money = "decimal(18,2)"
    eligible = lambda df, name: df.filter("eligible").groupBy(key).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(money).alias(name))
    asked = wanted.select(key).distinct().withColumn("_asked", F.lit(True))
    both = snapshots.withColumn("_there", F.lit(True)).join(asked, key, "full").join(eligible(staff, "_h"), key, "left").join(eligible(expenses, "_e"), key, "left")
    closes = F.coalesce(F.col("_asked") & F.col("_there") & ~F.col("closed"), F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast(money))
    sums = {"hr_total": zero("_h"), "expense_total": zero("_e"), "total": zero("_h") + zero("_e")}
    result = F.when(closes, "CLOSED").when(F.col("_asked") & F.col("_there"), "REFUSED").when(F.col("_asked"), "UNKNOWN")
    return both.select(key, (F.coalesce(F.col("closed"), F.lit(False)) | closes).alias("closed"), *[F.when(closes, v).otherwise(F.col(n)).cast(money).alias(n) for n, v in sums.items()], result.alias("result"))


def apply_operations(base: DataFrame, operations: DataFrame, key: str, values: list[str], order: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """``base`` (key, values) after creates, updates and deletes of its rows: ``operations`` has key, op (CREATE, UPDATE, DELETE), values (a null one changes nothing) and their order.

    A create starts a row anew, with the defaults where it gives nothing; an update changes the values that it gives, and nothing where there is no row; a deleted row is gone until it is
    created again. Every key is known by its last create or delete, a partial aggregate, and the values by the last ones given since."""
    first = base.select(key, F.lit("CREATE").alias("op"), *values, F.lit(-(1 << 62)).cast("long").alias("_at"), F.lit(True).alias("_old"))
    rows = first.unionByName(operations.select(key, "op", *values, F.col(order).cast("long").alias("_at"), F.lit(False).alias("_old")))
    born = rows.filter("op <> 'UPDATE'").groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct("op", F.col("_at").alias("at"), "_old"), "_at").alias("b"))
    alive = rows.join(born.filter("b.op = 'CREATE'"), F.col(key).eqNullSafe(F.col("_k"))).filter("_at >= b.at")
    last = alive.groupBy(key).agg(F.first("b._old").alias("_old"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in values])
    defaults = defaults or {}
    # what the base leaves empty stays so
    return last.select(key, *[F.when(F.col("_old"), F.col(c)).otherwise(F.coalesce(F.col(c), defaults[c])).alias(c) if c in defaults else F.col(c) for c in values])
