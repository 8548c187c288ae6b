"""Token counts: pieces are counted once per distinct pre-token, joined to per-document pre-token frequencies and summed.

No list of ids is ever made for a document. The most frequent pre-tokens (at most ``HEAD``, so at most a few MB) are
broadcast, which also takes every hot key out of the join; the rest go by a shuffled join on the pre-token.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The most pre-tokens that are broadcast with their numbers of pieces.
HEAD = 131_072
#: Distinct pre-tokens that a task gathers before it passes them on.
FLUSH = 50_000


class Splitter:
    """Special strings and pre-tokens of a text, as a byte-level BPE of the tokenizers library splits them."""

    def __init__(self, path: str):
        import json

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("needs a byte-level BPE without normalizer and prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or need word ends aren't handled")
        # fixed value: the split pattern of byte-level BPE
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, special))).split if special else None

    def __call__(self, text: str) -> tuple[int, list[str]]:
        """The number of special strings, and the pre-tokens."""
        if self.cut and any(s in text for s in self.special):
            parts = self.cut(text)
            return len(parts) - 1, [x for part in parts for x in self.find(part)]
        return 0, self.find(text)


@lru_cache(maxsize=1)  # one for each Python worker
def splitter(path: str) -> Splitter:
    return Splitter(path)


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # else each worker keeps threads and their caches
    return Tokenizer.from_file(path)


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = splitter(path), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"])

        for batch in common.slices(batches):
            for text in batch.column("text").to_pylist():
                seen.update(split(text or "")[1])
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = [len(e.ids) for e in tokenizer.encode_batch(part.column("piece").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column("piece"), part.column("n"), pa.array(n, pa.int64())], ["piece", "n", "pieces"])

    return run


def _documents(path: str, head):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("copies", pa.int64()), ("piece", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        split, known = splitter(path), head.value.get
        for batch in common.slices(batches):
            cols: list[list] = [[] for _ in schema]
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                key = common.signed(xxhash.xxh3_64_intdigest(raw))
                n, found = split(text or "")
                tail = []
                for piece, f in Counter(found).items():
                    p = known(piece)
                    if p is None:
                        tail.append((piece, f))
                    else:
                        n += f * p
                # a digit after \0 is never one pre-token, so this key matches nothing, and it spreads the rows
                for row in ((doc_id, key, len(raw), 1, f"\0{key % 10**9}", n), *((doc_id, key, 0, 0, piece, f) for piece, f in tail)):
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                size += 1 + len(tail)
                if size > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols, size = [[] for _ in schema], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``vocabulary``: a byte-level BPE file of the tokenizers library, at the same place on every executor. Counts are those
    of its ``encode(text, add_special_tokens=False)``: special strings inside a text count as one token each. A null text
    counts as empty (0 bytes, 0 tokens); rows that repeat an id, with the same or another text, or a null id each give a
    row of their own; an empty table gives an empty result."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    work = common.Work(spark, "tokens")
    counts = (
        docs.select("text").mapInArrow(_frequencies(vocabulary), "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .mapInArrow(_pieces(vocabulary), "piece string, n long, pieces long")
    )
    counts = work.save(counts, "counts")
    least = common.rare_below(counts, head)
    known = spark.sparkContext.broadcast({r.piece: r.pieces for r in counts.filter(F.col("n") >= least).select("piece", "pieces").collect()})
    rows = docs.mapInArrow(_documents(vocabulary, known), "doc_id long, text_hash long, n_bytes long, copies long, piece string, n long")
    joined = rows.join(counts.filter(F.col("n") < least).select("piece", "pieces").hint("merge"), "piece", "left")
    found = joined.groupBy("doc_id", "text_hash").agg(F.max("n_bytes").alias("n_bytes"), F.sum("copies").alias("copies"), F.sum(F.col("n") * F.coalesce("pieces", F.lit(1))).alias("total"))
    # equal rows have added up: each has an equal share
    each = found.withColumn("n_tokens", F.expr("total div copies")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
