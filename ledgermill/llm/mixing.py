"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

Each source's documents, in the order of a hash, are one stream of words, cut into blocks of ``block`` words (the last one shorter). The schedule is a
row of slots, of one block each. Slot k stands at the golden-ratio point frac(k * 0.618...); the source under whose part of the cumulative
weights the point falls has the slot, so every stretch of the schedule holds the sources by their weights. A source's slots are ranked, and the
slot of rank r takes its block r modulo the number of blocks: blocks come in turn, and again from the first one when all were taken. Points miss
a source's number of slots by a few; slots over it are left out, and those that lack are put at the end, so that each source ends at its target.

Ranks and places in streams are sums over chunks of a bounded size, whose own sums are added up in two steps: no source is ever in one task.
Texts are read once; what follows works on a row of four numbers for each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fixed value: the golden ratio's fraction in units of 2^-40, odd, so that 2^40 slots have different points.
GOLDEN, POINTS = 679_535_556_991, 1 << 40
#: Documents and slots in a chunk, about, and sums of chunks that are added up at a time.
CHUNK, STEP = 256, 1024
#: The most sources that are broadcast; beyond it they are joined by a shuffle.
MOST = 100_000


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (5, 2, 1)  #: of the sources in their order, again from the first
    share: float = 1.5  #: words of the mix, as a multiple of all words
    most: int = 2  #: times that a document is taken at most
    block: int = 128  #: words
    seed: str = "mix"


def words(text: str) -> Column:
    """The number of words between ASCII white space; of a null 0."""
    bare = F.ltrim(F.col(text), F.lit(" \t\n\x0b\f\r"))
    return F.coalesce(F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")), F.lit(0)).cast("long")


def before(sums: DataFrame, keys: list[str], at: str, n: str, name: str) -> DataFrame:
    """``sums`` (one row for each of ``keys`` and ``at``, from 0) with the sum of ``n`` over the smaller ``at`` of its keys. A window has at most ``STEP``
    rows, or one for ``STEP`` values of ``at``."""
    sums = sums.withColumn("step", F.expr(f"`{at}` div {STEP}"))
    own = Window.partitionBy(*keys, "step").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    steps = Window.partitionBy(*keys or [F.lit(0)]).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    whole = sums.groupBy(*keys, "step").agg(F.sum(n).alias("whole")).select(*keys, "step", F.coalesce(F.sum("whole").over(steps), F.lit(0)).alias("earlier"))
    inner = sums.withColumn("within", F.coalesce(F.sum(n).over(own), F.lit(0)))
    return inner.join(whole, [*keys, "step"]).withColumn(name, F.col("earlier") + F.col("within")).drop("step", "within", "earlier")


def numbered(df: DataFrame, order: list[Column], work: common.Work, name: str, number: str) -> DataFrame:
    """The rows in their order, numbered from 0: sorted by ranges and written, then each range's start is added."""
    rows = work.save(df.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("place", 33))
    starts = before(rows.groupBy("part").agg(F.count("*").alias("k")), [], "part", "k", "start").select("part", "start")
    return rows.join(F.broadcast(starts), "part").withColumn(number, F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "start")


def level(sources: DataFrame, share: float, most: int) -> float:
    """What a weight of 1 gets when ``share`` times all words are dealt by weight, and what a source can't take (``most`` times its own) goes to the others.
    Each turn is a sum over the sources; no turn follows when none reached its limit in the last one."""
    n, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = (n or 0) * share
    found = total / weights if weights else 0.0
    while True:
        full = F.col("source_size") * most < F.col("weight") * found
        taken, left = sources.agg(F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if not left or (total - (taken or 0)) / left == found:
            return found
        found = (total - (taken or 0)) / left


class Mix:
    """The schedule of a mix of ``docs``: ``facts`` (documents), ``sources``, and from them ``slots`` and ``pieces``."""

    def __init__(self, docs: DataFrame, s: Settings):
        self.s, self.spark, self.work = s, docs.sparkSession, common.Work(docs.sparkSession, "mix")
        key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(s.seed), F.col("doc_id"))), 1, 10), 16, 10).cast("long")
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
        self.facts = self.work.save(docs.select("doc_id", "source", words("text").alias("size"), key.alias("h")), "documents")
        sums = self.facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
        named = numbered(sums, [F.col("source").asc_nulls_last()], self.work, "names", "s")
        named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, s.weights)), (F.col("s") % len(s.weights) + 1).cast("int")).cast("double"))
        self.few = named.count() <= MOST
        with_target = named.withColumn("target", F.least(F.col("source_size") * float(s.most), F.col("weight") * level(named, s.share, s.most)))
        taken, size, blocks = F.floor("target"), F.greatest("source_size", F.lit(1)), F.col("blocks")
        counted = (
            with_target.withColumn("blocks", F.ceil(F.col("source_size") / s.block))
            .withColumn("rest", taken % size)
            .withColumn("slots", F.floor(taken / size) * blocks + F.ceil(F.col("rest") / s.block))
        )
        self.sources = self.work.save(before(counted, [], "s", "slots", "first"), "sources")
        self.n = self.sources.agg(F.sum("slots")).first()[0] or 0

    def _with_sources(self, df: DataFrame, *columns: str, on: str = "s") -> DataFrame:
        own = self.sources.select(F.col(on).alias("its"), *columns)
        return df.join(F.broadcast(own) if self.few else own.hint("merge"), F.col(on).eqNullSafe(F.col("its"))).drop("its")

    def _points(self) -> DataFrame:
        """k, s, and what slots need of the source: each slot's point falls into a cell of the weights, as many as there are sources, and into one of the cell's sources."""
        cells = max(1, self.sources.count())
        cell = lambda x: F.floor(x * float(cells) / float(max(1, self.n)))
        first, end = F.col("first").cast("double"), (F.col("first") + F.col("slots")).cast("double")
        grid = self.sources.filter("slots > 0").select("s", "blocks", "rest", "slots", first.alias("low"), end.alias("high"), F.explode(F.sequence(cell(first), F.least(cell(end), F.lit(cells - 1)))).alias("cell"))
        low = F.col("k").bitwiseAND(F.lit((1 << 20) - 1))
        point = (low * GOLDEN + F.shiftright("k", 20) * ((GOLDEN << 20) % POINTS)).bitwiseAND(F.lit(POINTS - 1))
        points = self.spark.range(self.n).withColumnRenamed("id", "k").withColumn("x", point / float(POINTS) * float(self.n)).withColumn("cell", F.least(cell(F.col("x")), F.lit(cells - 1)))
        return points.join(F.broadcast(grid) if self.few else grid.hint("merge"), "cell").filter("x >= low and x < high").drop("x", "cell", "low", "high")

    def slots(self) -> DataFrame:
        """slot (its place), s, block, and limit: how many words of the block it takes at most."""
        points = self._points().withColumn("chunk", F.expr(f"k div {CHUNK}"))
        counts = self.work.save(points.groupBy("s", "chunk").agg(F.count("*").alias("k")), "counts")
        own = Window.partitionBy("chunk", "s").orderBy("k")
        ranked = points.repartition("chunk").withColumn("place", F.row_number().over(own) - 1).join(before(counts, ["s"], "chunk", "k", "start").select("s", "chunk", "start"), ["s", "chunk"])
        ranked = ranked.withColumn("rank", F.col("start") + F.col("place")).filter("rank < slots").select(F.col("k").alias("slot"), "s", "rank", "blocks", "rest", "slots")
        found = counts.groupBy("s").agg(F.sum("k").alias("found"))
        lacking = self.sources.join(found.hint("merge"), "s", "left").withColumn("found", F.coalesce("found", F.lit(0))).filter("found < slots")
        lacking = lacking.withColumn("rank", F.explode(F.sequence("found", F.col("slots") - 1))).select((F.col("first") + F.col("rank") + self.n).alias("slot"), "s", "rank", "blocks", "rest", "slots")
        block = F.expr("rank % blocks")
        last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
        return ranked.unionByName(lacking).select("slot", "s", block.alias("block"), F.when(last, F.col("rest") - block * self.s.block).otherwise(self.s.block).alias("limit"))

    def pieces(self) -> DataFrame:
        """Documents that have words, cut at the ends of blocks: s, at (the document's place in its source's stream), doc_id, size, block, start (in the document), offset (in the block), length."""
        chunk = F.shiftright(F.shiftright("h", 20) * (F.expr(f"docs div {CHUNK}") + 1), 20)
        rows = self._with_sources(self.facts.filter("size > 0"), "s", "docs", on="source").withColumn("chunk", chunk).drop("source", "docs")
        own = Window.partitionBy("s", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        starts = before(rows.groupBy("s", "chunk").agg(F.sum("size").alias("n")), ["s"], "chunk", "n", "start")
        placed = rows.withColumn("to", F.sum("size").over(own)).join(starts.select("s", "chunk", "start"), ["s", "chunk"]).select("s", "doc_id", "size", (F.col("start") + F.col("to") - F.col("size")).alias("at"))
        b = self.s.block
        cut = placed.withColumn("block", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))))
        start = F.greatest(F.col("at"), F.col("block") * b)
        return cut.select("s", "at", "doc_id", "size", "block", (start - F.col("at")).alias("start"), (start - F.col("block") * b).alias("offset"), (F.least(F.col("at") + F.col("size"), F.col("block") * b + b) - start).alias("length"))

    def taken(self, how: str) -> DataFrame:
        """Pieces with their slots, and ``n``, the words that the slot takes of the piece."""
        n = F.greatest(F.lit(0), F.least(F.col("length"), F.col("limit") - F.col("offset")))
        return self.pieces().join(self.slots(), ["s", "block"], how).withColumn("n", F.when(F.col("limit").isNotNull(), n).otherwise(0))


def mixture(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The mix: slot (the place in the schedule), source, doc_id, start and length in words. What a slot takes follows by offset. ``docs`` and cases as in ``mix_documents``."""
    mix = Mix(docs, settings or Settings())
    return mix._with_sources(mix.taken("inner").filter("n > 0"), "source").select("slot", "offset", "source", "doc_id", "start", F.col("n").alias("length"))


def mix_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source; other columns are ignored).

    size: words of the text (a null text: 0). Sources stand in the order of code points, null last and a source of its own. target: the words that the mix is
    to take of the row's source, and taken those that it takes of the row: the sum over a source is floor(target), and no row exceeds ``most`` times its
    size. The result follows from ids, sources and sizes alone, so reruns agree. Rows that repeat an id give a row each; rows without an id or without words too, the latter
    with 0 taken. An empty table gives an empty result. A text of any length is cut over as many blocks as it needs."""
    mix = Mix(docs, settings or Settings())
    sums = mix.taken("left").groupBy("s", "at").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("size"), F.sum("n").alias("taken"))
    none = mix._with_sources(mix.facts.filter("size = 0"), "s", on="source").select("s", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    rows = sums.select("s", "doc_id", "size", "taken").unionByName(none)
    return mix._with_sources(rows, "source_size", "target").select("doc_id", "size", "source_size", "target", "taken")
