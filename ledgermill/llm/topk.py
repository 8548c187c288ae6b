"""Exact top-k by inner product over a pivot-distance index.

Each vector gets a further coordinate that makes all of them equally long; then the larger the inner product with a query, the smaller the
distance. Vectors are keyed by their nearest pivot and their distance from it, in rings. A query takes a first bound from a sample,
visits the rings of its nearest pivot that the bound reaches, and with the bound found there those of all pivots; by the triangle
inequality no other ring can hold a better vector. Large rings are split, and queries and vectors meet in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The least pivots, rings of each, the least vectors sampled for pivots and first bounds, and vectors and queries in a block.
PIVOTS, RINGS, SAMPLE, BLOCK = 32, 16, 2048, 4096
#: The most pivots. Between the least and the most there are as many as make rings of about a block.
MOST_PIVOTS = 1024


def pivots_of(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """Centres of the sample by Lloyd's rounds, from vectors spread evenly over it."""
    if not len(sample):
        return sample
    centres = sample[np.linspace(0, len(sample) - 1, min(n, len(sample))).astype(int)]
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(1)
        centres = np.array([sample[own == i].mean(0) if (own == i).any() else centres[i] for i in range(len(centres))])
    return centres


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def _matrix(column, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows of numbers, short ones filled with zeros."""
    out = np.zeros((len(column), width), kind)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _longer(x: np.ndarray, square: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))[:, None]], axis=1)


def _keyed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in common.slices(batches, 4096):
            x = _longer(_matrix(batch.column("v").to_pylist(), m["width"]), m["square"])
            d = _distances(x, m["pivots"])
            own = d.argmin(1)
            r = d[np.arange(len(d)), own]
            ring = np.clip((r - m["low"]) / m["step"], 0, RINGS - 1).astype(int)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own * RINGS + ring, pa.int32()), pa.array(r)], ["vec_id", "v", "cell", "r"])

    return run


def _visits(shared, cells, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, (cell, near, far, parts) = shared.value, cells
        for batch in common.slices(batches, 1024):
            ids, x = batch.column("vec_id").to_pylist(), _matrix(batch.column("v").to_pylist(), m["width"])
            bound = np.array([-np.inf if b is None else b for b in batch.column("bound").to_pylist()])
            # with room for the rounding of the distances and of the bound
            whole = (x * x).sum(1) + m["square"] if len(x) else bound
            reach = np.sqrt(np.maximum(whole - 2 * bound, 0) + 1e-12 * whole) if len(x) else bound
            d = _distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), m["pivots"])
            gap = np.maximum(near[None, :] - d[:, cell // RINGS], d[:, cell // RINGS] - far[None, :])
            open_ = gap <= reach[:, None] * (1 + 1e-9) + 1e-6
            mine = (cell // RINGS)[None, :] == d.argmin(1)[:, None]
            rows = [(ids[q], int(cell[c]), part, b) for q, c in zip(*np.nonzero(open_ & (mine if first else ~mine)), strict=True) for part in range(parts[c]) for b in [None if np.isinf(bound[q]) else float(bound[q])]]
            q, c, part, b = zip(*rows, strict=True) if rows else ((), (), (), ())
            at = {i: k for k, i in enumerate(ids)}
            vs = batch.column("v").take(pa.array([at[i] for i in q], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), vs, pa.array(c, pa.int32()), pa.array(part, pa.int32()), pa.array(b, pa.float64())], ["query_id", "v", "cell", "part", "bound"])

    return run


def _under(score: float) -> float:
    """At most the score, whose rounding may have made it larger, and below the greatest number of 64 bits."""
    return min(score - abs(score) * 1e-14, 9.2e18)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, bound: float) -> list[tuple[int, float]]:
    at = np.flatnonzero((scores >= bound) & (ids != own))
    return [(int(ids[i]), scores[i].item()) for i in at[np.lexsort((ids[at], -scores[at]))[:k]]]


def products(q: np.ndarray, x: np.ndarray, kind: type) -> np.ndarray:
    """Inner products of all rows. ``kind``: the numbers in which those are exact that fit into 64 bits; the others, of very long vectors, are made one by one and cut to 64 bits."""
    scores = q.astype(kind) @ x.astype(kind).T
    if kind is np.int64:
        size = lambda a: np.sqrt((a.astype(float) ** 2).sum(1))
        for i, j in np.argwhere(np.outer(size(q), size(x)) >= 2.0**62):
            scores[i, j] = max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], x[j], strict=True))))
    return scores


def _searched(width: int, k: int, kind: type):
    """``kind``: the numbers in which the products are exact."""

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(vectors) and len(queries):
            x, ids = _matrix(vectors["v"], width, kind), vectors["vec_id"].to_numpy()
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                scores = products(_matrix(part["v"], width, kind), x, kind)
                for q, s, b in zip(part["query_id"], scores, part["bound"].fillna(-np.inf), strict=True):
                    rows += [(q, i, v) for i, v in _best(s, ids, q, k, b)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k vectors of the largest integer inner product, ties to the smaller id.

    ``vectors`` and ``queries``: vec_id, v (arrays of integers; null ones, and those with a null component, take no part; short ones
    count as filled with zeros; other columns are ignored). A vector isn't found by the query of its own id. Inner products are exact; beyond 64 bits they count as the
    largest or least number of 64 bits. Rows that repeat an id count once, with
    the least vector. With fewer vectors all are returned; empty tables give an empty result. The sample fits pivots and first bounds only:
    every vector is indexed, and the result is exact."""
    spark = vectors.sparkSession
    work = common.Work(spark, "topk")
    tidy = lambda df: df.filter("vec_id is not null and v is not null and forall(v, x -> x is not null)").groupBy("vec_id").agg(F.min("v").alias("v"))
    vectors = work.save(tidy(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"))), "vectors")
    queries = work.save(tidy(queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"))), "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    facts = vectors.agg(F.coalesce(F.max(square), F.lit(0.0)).alias("square"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width"), F.count("*").alias("n")).first()
    n_queries, wide = queries.count(), queries.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    width = max(facts.width, wide)
    # no sum of products is larger than the product of the lengths
    longest = float(np.sqrt(facts.square * queries.agg(F.coalesce(F.max(square), F.lit(0.0))).first()[0]))
    kind = np.float64 if longest < 2**52 else np.int64
    n_pivots = max(PIVOTS, min(facts.n // (BLOCK * RINGS), MOST_PIVOTS))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, 8 * n_pivots)).collect()
    ids, x = np.array([r.vec_id for r in sample], np.int64), _matrix([r.v for r in sample], width)
    longer = _longer(x, facts.square)
    pivots = pivots_of(longer, n_pivots)
    r = _distances(longer, pivots).min(1) if len(sample) else np.zeros(1)
    model = spark.sparkContext.broadcast({"pivots": pivots, "square": facts.square, "width": width, "low": float(r.min()), "step": max(float(np.ptp(r)) / RINGS, 1e-9), "ids": ids, "x": x})
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not len(sample) or not n_queries:
        return empty
    keyed = work.save(vectors.mapInArrow(_keyed(model), "vec_id long, v array<long>, cell int, r double"), "keyed")
    cells = sorted(keyed.groupBy("cell").agg(F.min("r").alias("near"), F.max("r").alias("far"), F.count("*").alias("n")).collect())
    index = (np.array([c.cell for c in cells]), np.array([c.near for c in cells]), np.array([c.far for c in cells]), [-(-c.n // BLOCK) for c in cells])
    parts = F.element_at(F.create_map(*[F.lit(int(y)) for c in cells for y in (c.cell, -(-c.n // BLOCK))]), F.col("cell"))
    chunks = -(-n_queries // BLOCK)
    blocks = keyed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts.cast("long")).cast("int")).drop("r")
    keys = ["cell", "part", "chunk"]

    def search(asked: DataFrame, first: bool) -> DataFrame:
        visits = asked.mapInArrow(_visits(model, index, first), "query_id long, v array<long>, cell int, part int, bound double")
        visits = work.save(visits.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")), "visits1" if first else "visits2")
        # a block of vectors is copied only to the blocks of queries that visit it
        wanted = work.save(visits.select(*keys).distinct(), "wanted1" if first else "wanted2")
        copies = common.with_ids(blocks, wanted, ["cell", "part"], "inner", wanted.count())
        return copies.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(_searched(width, k, kind), "query_id long, vec_id long, score long")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in common.slices(batches, 512):
            scores = _matrix(batch.column("v").to_pylist(), m["width"]) @ m["x"].T
            best = [_best(s, m["ids"], q, k, -np.inf) for q, s in zip(batch.column("vec_id").to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array([_under(b[k - 1][1]) if len(b) == k else None for b in best], pa.float64())], ["vec_id", "v", "bound"])

    asked = work.save(queries.mapInArrow(sampled, "vec_id long, v array<long>, bound double"), "asked")
    near = work.save(search(asked, True), "near")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    bounds = near.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.when(F.col("score") > -(2**63), F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-14).alias("better"))
    asked = asked.join(bounds, "vec_id", "left").select("vec_id", "v", F.coalesce(F.greatest("bound", "better"), "bound").alias("bound"))
    found = near.unionByName(search(asked, False)).withColumn("rank", rank).filter(F.col("rank") <= k)
    result = work.save(found.select("query_id", "rank", "vec_id", "score"), "result")
    work.drop_all_but("result")
    return result
