"""Hierarchical multi-length packing of tokenized documents, without a shuffle and without padding.

Every task packs its own documents in buffers of bounded size. A document's whole windows are sequences of their own; what
is left of it goes to the tier of the least context size (a power of two) that holds it. Tiers are packed from the longest:
each window of a tier is opened by a piece of that tier, and its gap is filled from shorter tiers, with whole pieces while
any fits and else with a cut one. Pieces that fill no window wait for the next buffer; at the end of a task they are laid end
to end and cut at powers of two. The sequences of a buffer are dealt to step groups of even token counts.
"""

from __future__ import annotations

import heapq
import os
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
#: Words whose ids a Python worker keeps.
CACHE = 300_000


class Encoder:
    """Ids of a text as little-endian 32-bit bytes. Ids of words between ASCII white space are kept, as the tokenizer
    (which drops white space and splits at it) gives a text the ids of its words in a row.

    A word of lower-case ASCII letters is one piece of the tokenizer's own splitting, and its byte-level form is itself, so the
    merges are applied to it directly; a mark after it is a piece of its own."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if pre[0].get("behavior") != "Removed" or "\\s" not in str(pre[0].get("pattern")) or spec["post_processor"]:
            raise ValueError("needs a tokenizer that drops white space and splits at it")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.marks = {c: self._encoded([c])[0] for c in (b".", b",", b";", b":", b"!", b"?")}

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _learn(self, words: set[bytes]) -> None:
        known, older, tokenize, other = self.known, self.older.get, self.model.tokenize, []
        for w in words:
            if (x := older(w)) is not None:
                known[w] = x
                continue
            mark = self.marks.get(w[-1:])
            stem = w[:-1] if mark else w
            if stem.isalpha() and stem.islower():
                if (x := known.get(stem)) is None:
                    known[stem] = x = struct.pack(f"<{len(t)}I", *[i.id for i in t]) if (t := tokenize(stem.decode())) else b""
                known[w] = x + mark if mark else x
            else:
                other.append(w)
        for at in range(0, len(other), 2000):
            part = other[at : at + 2000]
            known.update(zip(part, self._encoded(part), strict=True))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # special strings are looked for before the tokenizer lowers case, so a text that may hold one keeps its case
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        words = [(x if b"<|" in x else x.lower()).split() for x in texts]
        self._learn(set().union(*words).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return Encoder(path)


def _fill(gap: int, pool: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces (length, document, start) out of the sorted pool that fill the gap exactly, or all of the pool."""
    got = []
    while gap and pool:
        at = bisect_right(pool, (gap, 1 << 62, 0))
        if at:
            piece = pool.pop(at - 1)
        else:
            n, doc, start = pool.pop(0)
            insort(pool, (n - gap, doc, start + gap))
            piece = (gap, doc, start)
        got.append(piece)
        gap -= piece[0]
    return got


def pack(pieces: list[tuple[int, int, int]], sizes: list[int]) -> tuple[list[tuple[int, list]], list[tuple[int, int, int]]]:
    """Full sequences (size, pieces) of the given descending sizes, and the pieces that are left, fewer tokens than the largest size; each
    piece, given and left, is at most the largest size."""
    pool, total, out = sorted(pieces), sum(x[0] for x in pieces), []
    for size, below in zip(sizes, [*sizes[1:], 0], strict=True):
        # pieces of this tier are longer than the next size
        while pool and (pool[-1][0] > below if below else total >= size):
            if total < size:
                return out, pool
            first = pool.pop()
            out.append((size, [first, *_fill(size - first[0], pool)]))
            total -= size
    return out, pool


def _rest(pieces: list[tuple[int, int, int]], largest: int) -> list[tuple[int, list]]:
    """Sequences of power-of-two sizes that hold the pieces end to end."""
    out, pool, total = [], sorted(pieces), sum(x[0] for x in pieces)
    while total:
        size = min(largest, 1 << (total.bit_length() - 1))
        out.append((size, _fill(size, pool)))
        total -= size
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence: as many groups as steps are needed, longest sequences first, each to the least full."""
    loads = [(0, g) for g in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = loads[0]
        out[i] = g
        heapq.heapreplace(loads, (load + sizes[i], g))
    return out


def _task(path: str, end_id: int, sizes: list[int], step_tokens: int, buffer_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, large = encoder(path), np.array([end_id], "<u4").tobytes(), sizes[0]
        base = TaskContext.get().partitionId() << 40
        docs: dict[int, tuple] = {}
        waiting: list[tuple[int, int, int]] = []
        whole: list[tuple[int, list]] = []
        counts = {"doc": 0, "sequence": 0, "group": 0, "tokens": 0}

        def emit(sequences):
            groups = step_groups([size for size, _ in sequences], step_tokens)
            rows = []
            for (size, pieces), g in zip(sequences, groups, strict=True):
                offset, number = 0, base + counts["sequence"]
                counts["sequence"] += 1
                for n, doc, start in pieces:
                    doc_id, ids = docs[doc]
                    rows.append((doc_id, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, number, offset, size, base + counts["group"] + g))
                    offset += n
            counts["group"] += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW) if rows else None

        def flush(last: bool):
            nonlocal waiting
            full, waiting = pack(waiting, sizes)
            if last:
                full, waiting = [*full, *_rest(waiting, large)], []
            batch = emit([*whole, *full])
            whole.clear()
            keep = {doc for _, doc, _ in waiting}
            for doc in [x for x in docs if x not in keep]:
                del docs[doc]
            counts["tokens"] = 0
            return [batch] if batch else []

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at in range(0, batch.num_rows, 256):
                for doc_id, raw in zip(ids[at : at + 256], encode(common.text_bytes(batch.column("text").slice(at, 256))), strict=True):
                    doc, raw = counts["doc"], raw + end
                    counts["doc"] += 1
                    docs[doc] = (doc_id, raw)
                    n = len(raw) // 4
                    whole += [(large, [(large, doc, s)]) for s in range(0, n - large + 1, large)]
                    if n % large:
                        waiting.append((n % large, doc, n - n % large))
                    counts["tokens"] += n
                    if counts["tokens"] >= buffer_tokens:
                        yield from flush(False)
        yield from flush(True)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, sizes: tuple[int, ...] = (4096, 2048, 1024, 512, 256), step_tokens: int = 1 << 18, buffer_tokens: int = 1 << 21) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``docs``: doc_id, text (other columns are ignored). ``sizes``: descending powers of two. A document's ids are those of
    ``encode(text, add_special_tokens=False)`` and ``end_id``. Each id lies in one piece; the pieces of a sequence follow each
    other without gaps, and every sequence is as long as its tier, at the end of a task also a smaller power of two, so nothing is
    padded. A null or empty text is ``end_id`` alone; rows that repeat an id, or have none, are packed each for itself; a text
    of any length is cut into windows; an empty table gives no rows. ``buffer_tokens`` bounds what a task holds."""
    if any(s & (s - 1) for s in sizes) or list(sizes) != sorted(set(sizes), reverse=True):
        raise ValueError("sizes are descending powers of two")
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_task(vocabulary, end_id, list(sizes), step_tokens, buffer_tokens), SCHEMA)
