"""Search, paging, nested results and counts. Groups are pre-aggregated before they are joined."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.sources.tables import saved


def contains_any(columns: list[str | Column], text: str | None) -> Column:
    """Any column holds the text, whatever its case; without a text everything fits."""
    if not text:
        return F.lit(True)
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(or_, [F.coalesce(F.lower(c.cast("string")).contains(text.lower()), F.lit(False)) for c in cols])


def all_given(**wanted) -> Column:
    """Equality with every value that isn't None; a list means any of its values."""
    return reduce(and_, [F.col(k).isin(v) if isinstance(v, list) else F.col(k) == v for k, v in wanted.items() if v is not None], F.lit(True))


def differs(column: Column, *values) -> Column:
    return ~column.isin(*values) & column.isNotNull()


def page(df: DataFrame, order: list[Column], number: int, size: int, most: int = 200) -> DataFrame:
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total"), F.greatest(F.ceil(n / size), F.lit(1)).cast("long").alias("total_pages"))


def include(parent: DataFrame, child: DataFrame, key: str, foreign: str, columns: list[str], name: str, first: int | None = None) -> DataFrame:
    """Children as an array of structs sorted by their columns; an empty one for parents without any."""
    if first is not None:  # cut before anything is gathered
        child = child.withColumn("_r", F.row_number().over(Window.partitionBy(foreign).orderBy(*columns))).filter(F.col("_r") <= first)
    arrays = child.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    kind = arrays.schema[name].dataType
    return parent.join(arrays, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def linked(left: DataFrame, links: DataFrame, right: DataFrame, left_key: str, right_key: str, block: int = 500_000) -> DataFrame:
    """Rows of both sides that a link table (left_key, right_key) joins; a pair that it names twice is one.

    The links are counted and lie in parts of about ``block``, whatever the session's number of partitions: by their right key while pairs become distinct and meet the right side, then by
    their left key, so that more links are more parts, and grouping by the left key shuffles nothing more. A key's pairs lie in one part; they are no more than the other side's keys."""
    parts = links.count() // block + 1
    given = links.select(left_key, right_key).filter(F.col(left_key).isNotNull() & F.col(right_key).isNotNull())
    # few links are named twice, so they aren't gathered before the shuffle
    found = given.repartition(parts, right_key).distinct().join(right, right_key)
    return left.join(found.repartition(parts, left_key), left_key)


def relation_counts(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    for name, (child, foreign) in children.items():
        counts = child.filter(F.col(foreign).isNotNull()).groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
        parent = parent.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parent


def percent(part: Column, whole: Column) -> Column:
    return F.round(100 * part / F.greatest(whole, F.lit(1))).cast("long")


def ordinal(column: str, values: list[str]) -> Column:
    """Place of a value in its declared order; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.lit(values), F.col(column)), F.lit(0)), F.lit(len(values) + 1))


def ranged(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """The rows sorted by ranges and written, with ``_part`` (their range) and ``_at`` (their place in it, from 0). The order should tell rows apart."""
    rows = saved(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), name)
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def numbered(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Adds the rows' numbers, from 1, in the order of the columns, which should tell rows apart; within each value of ``within`` if it is given. Rows are sorted by
    ranges, so neither a table nor a large group is in one task; what is added up is a row for each range."""
    groups = within or []
    rows = ranged(df, [*groups, *order], "numbered")
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
    if not groups:
        return placed
    first = placed.groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(F.min(name).alias("_first"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups])
    return placed.join(first, same).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first", *[f"_{g}" for g in groups])


def last_before(rows: DataFrame, values: DataFrame, at: str, value: str, tie: str, stretch: int = 100_000) -> DataFrame:
    """``rows`` with ``value``: that of the latest of ``values`` (at, tie, value) at or before them; rows before any are left out. An as-of join without a key: both sides stand in
    one order of time, cut into stretches of so many rows; each row takes the last value of its stretch, or the last one of an earlier stretch."""
    names = rows.columns
    both = rows.select(F.struct(*names).alias("_row"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"), F.lit(None).cast(values.schema[value].dataType).alias("_v"))
    both = both.unionByName(values.select(F.col(at).alias("_t"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.col(value).alias("_v")), allowMissingColumns=True)
    placed = ranged(both.filter("_t is not null"), ["_t", "_kind", "_tie"], "asof").withColumn("_stretch", F.struct("_part", F.floor(F.col("_at") / stretch).alias("s")))
    known = F.when(F.col("_kind") == 0, F.struct("_v"))
    ends = placed.groupBy("_stretch").agg(F.max_by(known, F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    earlier = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_stretch", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    own = Window.partitionBy("_stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_own", F.last(known, ignorenulls=True).over(own)).filter("_kind = 1").join(ends, "_stretch")
    found = found.withColumn("_found", F.coalesce("_own", "_carried")).filter("_found is not null")
    return found.select("_row.*", F.col("_found._v").alias(value))


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``chunk``: rows in the order of the columns in runs of ``size``."""
    return numbered(df, order, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n")


def allowed_sort(wanted: str | None, allowed: dict[str, Column], default: str) -> Column:
    """The column of an allowed name, else the default one's."""
    return allowed.get(wanted or default, allowed[default])


def value_or_null(column: Column, value) -> Column:
    return (column == value) | column.isNull()


def requested(fields: Column, default: Column) -> Column:
    """Distinct requested fields that aren't blank, else the default ones."""
    asked = F.array_distinct(F.filter(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.trim(f) != ""))
    return F.when(F.size(asked) > 0, asked).otherwise(default)


def contains_join(hay: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str], size: int = 6, most: int = 100_000, hot: int = 50_000) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose ``text`` contains the other's ``needle`` (which isn't empty).

    Each needle is known by the one of its pieces of ``size`` characters (or itself, if it is shorter) that the fewest texts have, and a text is only taken apart to pieces that
    some needle chose, so rows are made about as often as there are pairs. Chosen pieces are broadcast up to ``most``; beyond it texts are joined with them by piece. The needles of a
    piece in more than ``hot`` texts stand in several parts, between which its texts are dealt."""
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, n))
    named = needles.filter(F.length(needle) > 0).withColumn("_size", F.least(F.length(needle), F.lit(size)))
    lengths = sorted(r[0] for r in named.select("_size").distinct().collect())  # size rows at most
    if not lengths:
        return hay.join(named.drop("_size"), on or F.lit(False)).filter(F.lit(False))
    of_text = F.array_distinct(F.flatten(F.array(*[pieces(text, F.lit(n)) for n in lengths])))
    texts = hay.filter(F.col(text).isNotNull())
    spread = lambda df: df.withColumn("_piece", F.explode(of_text))
    asked = named.select(*on, F.explode(F.array_distinct(pieces(needle, F.col("_size")))).alias("_piece")).distinct()
    small = asked.limit(most + 1).count() <= most
    kept = lambda df, names: df.join(F.broadcast(names) if small else names.hint("merge"), [*on, "_piece"], "left_semi")
    counts = saved(kept(spread(texts.select(*on, text)), asked).groupBy(*on, "_piece").agg(F.count("*").alias("_k")), "pieces")
    # a piece that no text has excludes its needle
    by_needle = named.select(*on, needle, F.explode(F.array_distinct(pieces(needle, F.col("_size")))).alias("_piece")).distinct().join(counts, [*on, "_piece"], "left")
    best = F.min_by(F.struct("_piece", F.coalesce("_k", F.lit(0)).alias("_k")), F.struct(F.coalesce("_k", F.lit(0)), "_piece")).alias("_best")
    chosen = saved(by_needle.groupBy(*on, needle).agg(best).filter("_best._k > 0").select(*on, needle, "_best._piece", "_best._k"), "chosen")
    parts = F.ceil(F.col("_k") / hot).cast("int")
    keyed = named.drop("_size").join(chosen, [*on, needle]).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_k")
    marks = chosen.groupBy(*on, "_piece").agg(F.max(parts).alias("_parts"))
    # the part of a text follows from the text
    placed = spread(texts).join(F.broadcast(marks) if small else marks.hint("merge"), [*on, "_piece"]).withColumn("_part", F.pmod(F.xxhash64(text), "_parts").cast("int")).drop("_parts")
    return placed.join(keyed, [*on, "_piece", "_part"]).filter(F.col(text).contains(F.col(needle))).drop("_piece", "_part")
