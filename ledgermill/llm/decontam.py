"""Benchmark decontamination: CGK random walks turn the edit distance of word sequences into a Hamming distance, repeated
bit-sampling LSH over item-sized windows finds candidates, and an exact edit distance decides.

A window is as long as an item and may start at every word. Before windows are embedded, an exact test thins them: an item within
its edit limit leaves so many of its word triples intact, and stretches with fewer of them can't match. Items of more than ``part_words``
words are looked for by equal parts, one of which is within the limit if the item is. The number of walks is measured for each
length: pairs at the edit limit are made of substitutions, insertions, deletions and all three, and as many walks are taken as bring the worst of
these to the target recall. Benchmark items are broadcast in blocks of bounded size, one pass for each block; documents are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_ASCII = re.compile(rb"[a-z0-9]+").findall
#: Characters of scripts that leave no spaces between words are words of their own.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_ANY = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+").findall
SCHEMA = "doc_id long, item_id long, start_word long, end_word long, edits int, item_words int"


@dataclass(frozen=True)
class Settings:
    edits: float = 0.2  #: of an item's words, at most, may be changed, added or missing
    least_words: int = 8  #: shorter items are found without edits only
    part_words: int = 96  #: longer items are cut into equal parts
    recall: float = 0.98  #: aimed at, at the edit limit
    sampled: int = 2  #: positions of an embedding in one hash
    most_walks: int = 192
    trials: int = 120  #: pairs of each kind by which a length's walks are measured
    block_chars: int = 2_000_000  #: of items that are broadcast at once, about 150 MB in a worker
    seed: int = 7


def words(raw: bytes) -> list[bytes]:
    """Runs of letters and digits, A-Z lowered; of unspaced scripts each character."""
    raw = raw.lower()
    return _ASCII(raw) if raw.isascii() else [w.encode() for w in _ANY(raw.decode(errors="replace"))]


class Walks:
    """CGK embeddings of windows of n words, and the positions that each walk's hash takes."""

    def __init__(self, n: int, s: Settings):
        rng = np.random.default_rng([s.seed, n])
        self.n, self.sampled = n, s.sampled
        self.at = np.sort(rng.integers(0, 2 * n, (s.most_walks, s.sampled)), axis=1)
        self.salt = rng.integers(0, 1 << 63, (2 * n, s.most_walks, 1), np.uint64)

    def hashes(self, windows: np.ndarray, walks: int) -> np.ndarray:
        """By walk and window (rows of n word hashes) the sampled words of the embedding, as one number. In every step of a walk it depends
        on the step and the word whether the walk goes on by a word."""
        m, past = len(windows), np.full((len(windows), 1), 0x5DEECE66D, np.uint64)
        flat = np.concatenate([windows, past], axis=1).ravel()
        row = np.arange(m)[None, :] * (self.n + 1)
        i, key = np.zeros((walks, m), np.int64), np.zeros((walks, m), np.uint64)
        at = self.at[:walks]
        for j in range(int(at.max()) + 1):
            x = flat[row + i]
            for c in range(self.sampled):
                here = np.flatnonzero(at[:, c] == j)
                if len(here):
                    key[here] = (key[here] + x[here] + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15)
            i += (((x ^ self.salt[j, :walks]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
            np.minimum(i, self.n, out=i)
        return key

    def measured(self, s: Settings) -> int:
        """Walks that reach the recall at the edit limit, for the worst kind of edits."""
        rng, n, need = np.random.default_rng([s.seed + 1, self.n]), self.n, 1
        for kinds in ("s", "i", "d", "sid"):
            items = rng.integers(0, 1 << 62, (s.trials, n), np.uint64)
            texts = np.empty_like(items)
            for item, text in zip(items, texts, strict=True):
                edited = item.tolist()
                for at in sorted(rng.choice(n, int(s.edits * n), replace=False).tolist(), reverse=True):
                    kind = kinds[rng.integers(len(kinds))]
                    edited[at : at + (kind != "i")] = [] if kind == "d" else [int(rng.integers(1 << 62))]
                text[:] = [*edited, *rng.integers(0, 1 << 62, n).tolist()][:n]
            same = self.hashes(items, s.most_walks) == self.hashes(texts, s.most_walks)
            found = np.maximum.accumulate(same, axis=0).mean(axis=1)
            need = max(need, int(np.argmax(found >= s.recall)) + 1 if found[-1] >= s.recall else s.most_walks)
        return need


def lengths(n: int, s: Settings) -> list[int]:
    """Lengths of the equal parts of an item of n words."""
    k = -(-n // s.part_words)
    return [n * (i + 1) // k - n * i // k for i in range(k)]


def edit_match(item: list[int], text: list[int]) -> tuple[int, int, int]:
    """Least edits between the item and a stretch of the text, and that stretch (the first one, start and end)."""
    row = [(0, j) for j in range(len(text) + 1)]
    for i, w in enumerate(item, 1):
        new = [(i, 0)]
        for j, x in enumerate(text, 1):
            a, b, c = row[j - 1], row[j], new[j - 1]
            best = (a[0] + (w != x), a[1])
            if b[0] + 1 < best[0]:
                best = (b[0] + 1, b[1])
            if c[0] + 1 < best[0]:
                best = (c[0] + 1, c[1])
            new.append(best)
        row = new
    end = min(range(len(row)), key=lambda j: row[j][0])
    return row[end][0], row[end][1], end


def nearest(bits: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """Least edits between an item of n words and any stretch of the text, and the first end of such a stretch: the last row of
    ``edit_match``, whose columns are held as bits of two numbers (Myers). ``bits``: the places of each of the item's words."""
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, now, best = full, 0, n, (n, 0)
    for end, x in enumerate(text, 1):
        at = bits.get(x, 0)
        same = ((((at & up) + up) ^ up) | at | down) & full
        more, less = down | (full & ~(same | up)), same & up
        now += bool(more & last) - bool(less & last)
        if now < best[0]:
            best = (now, end)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (full & ~(same | more)), more & same
    return best


class Finder:
    """Looks for a block of items in documents. ``walks``: by length of a part."""

    def __init__(self, items: list[tuple[int, str]], walks: dict[int, int], s: Settings):
        self.s = s
        found = [(i, words((t or "").encode())) for i, t in items]
        self.vocabulary: dict[bytes, int] = {}
        coded = [(i, [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]) for i, w in found if w]
        #: Items too short for edits, by length.
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, w in coded:
            if len(w) < s.least_words:
                self.short[len(w)][tuple(w)].append(i)
        self.items = [(i, w) for i, w in coded if len(w) >= s.least_words]
        self.limit = [int(s.edits * len(w)) for _, w in self.items]
        self.bits: list[dict[int, int]] = [defaultdict(int) for _ in self.items]
        self.maybe = np.zeros(1 << 22, bool)
        self.triples: dict[tuple[int, ...], list[int]] = defaultdict(list)
        #: Of a word of the items its hash; of any other word, and past a text's end, one that no item has.
        self.hashed = np.random.default_rng(s.seed).integers(0, 1 << 62, len(self.vocabulary) + 1, np.uint64)
        parts: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            for i, x in enumerate(w):
                self.bits[k][x] |= 1 << i
            self.maybe[self._code(np.array(w))] = True
            for t in set(zip(w, w[1:], w[2:], strict=False)):
                self.triples[t].append(k)
            at = 0
            for n in lengths(len(w), s):
                parts[n].append((k, self.hashed[np.array(w[at : at + n])]))
                at += n
        self.walks = {n: (Walks(n, s), walks[n]) for n in sorted(parts)}
        #: By length of a part: for every walk the parts' hashes, and the items that have them.
        self.buckets: dict[int, list[dict[int, list[int]]]] = {}
        for n, found in parts.items():
            tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(walks[n])]
            for at in range(0, len(found), 1024):
                some = found[at : at + 1024]
                for table, keys in zip(tables, self.walks[n][0].hashes(np.array([x for _, x in some]), walks[n]).tolist(), strict=True):
                    for (k, _), key in zip(some, keys, strict=True):
                        table[key].append(k)
            self.buckets[n] = tables

    @staticmethod
    def _code(x: np.ndarray) -> np.ndarray:
        """Of every three words in a row, a place in the bit map."""
        return ((x[:-2] * 0x9E3779B1 + x[1:-1] * 0x85EBCA77 + x[2:] * 0xC2B2AE3D) >> 7) & ((1 << 22) - 1)

    def _candidates(self, text: np.ndarray, stretches: dict[int, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
        """Those stretches of the items in which a window has a hash of the item, or of one of its parts."""
        starts: dict[int, set[int]] = defaultdict(set)
        for k, found in stretches.items():
            for n in set(lengths(len(self.items[k][1]), self.s)):
                for begin, end in found:
                    starts[n].update(range(begin, end))
        hit: dict[int, set[int]] = defaultdict(set)
        for n, all_starts in starts.items():
            walks, count = self.walks[n]
            at = np.array(sorted(all_starts))
            for s in np.array_split(at, -(-len(at) // 2048)):
                where = s[:, None] + np.arange(n)[None, :]
                windows = self.hashed[np.where(where < len(text), text[np.minimum(where, len(text) - 1)], 0)]
                for table, keys in zip(self.buckets[n], walks.hashes(windows, count).tolist(), strict=True):
                    for start, key in zip(s.tolist(), keys, strict=True):
                        for k in table.get(key, ()):
                            hit[k].add(start)
        return {k: [(a, b) for a, b in found if any(a <= x < b for x in hit[k])] for k, found in stretches.items() if k in hit}

    def find(self, raw: bytes) -> list[tuple[int, int, int, int, int]]:
        """item_id, start and end word, edits and item words of the best match of every item that is in the text."""
        get = self.vocabulary.get
        coded = [get(w, 0) for w in words(raw)]
        out = []
        for n, items in self.short.items():
            seen = set()
            for p, x in enumerate(zip(*(coded[i:] for i in range(n)), strict=False)):
                if x in items and x not in seen:
                    seen.add(x)
                    out += [(i, p, p + n, 0, n) for i in items[x]]
        text = np.array(coded, np.int64)
        if not self.items or len(text) < 3:
            return sorted(out)
        hits: dict[int, list[int]] = defaultdict(list)
        for p in np.flatnonzero(self.maybe[self._code(text)]).tolist():
            for k in self.triples.get(tuple(coded[p : p + 3]), ()):
                hits[k].append(p)
        stretches: dict[int, list[tuple[int, int]]] = {}
        for k, places in hits.items():
            n, limit = len(self.items[k][1]), self.limit[k]
            if found := _stretches(places, max(1, n - 2 - 3 * limit), n + limit, len(text)):
                stretches[k] = found
        for k, found in self._candidates(text, stretches).items():
            item, limit = self.items[k][1], self.limit[k]
            n, best = len(item), None
            for begin, end in found:
                edits, e = nearest(self.bits[k], n, coded[begin:end])
                if edits <= limit and (best is None or edits < best[2]):
                    stop = begin + e
                    begin = max(begin, stop - n - limit)  # no match is longer
                    best = (begin + edit_match(item, coded[begin:stop])[1] if edits else stop - n, stop, edits)
            if best:
                out.append((self.items[k][0], *best, n))
        return sorted(out)


def _stretches(places: list[int], must: int, width: int, end: int) -> list[tuple[int, int]]:
    """Stretches of a text that hold every stretch of at most ``width`` words with ``must`` of the triples at these places, joined where they overlap."""
    out: list[tuple[int, int]] = []
    for a, b in zip(places, places[must - 1 :], strict=False):
        if b + 3 - a <= width:
            begin, stop = max(0, b + 3 - width), min(end, a + width)
            if out and begin <= out[-1][1]:
                out[-1] = (out[-1][0], max(stop, out[-1][1]))
            else:
                out.append((begin, stop))
    return out


#: The finder of the last block in this Python worker, which later tasks of the block use again.
_KEPT: dict[str, Finder] = {}


def _found(items, walks: dict[int, int], settings: Settings):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32())])

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Finder(items.value, walks, settings)
        finder = _KEPT[name]
        for batch in common.slices(batches):
            rows = [(d, *m) for d, raw in zip(batch.column("doc_id").to_pylist(), common.text_bytes(batch.column("text")), strict=True) for m in finder.find(raw)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return common.frugal(run)


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits, item_words: the best match of each item within each row of ``docs``.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored. An item matches a stretch of a text if at most
    ``edits`` of the item's words are changed, added or missing; of equal matches the first counts. An item of fewer than ``least_words`` words
    matches without edits only. Whole texts of any length are searched. Matches at the very edit limit are found with the recall of the
    settings, closer ones with more. Null and empty texts and items match nothing; rows that repeat an id are searched each for itself,
    and equal items match alike; with an empty table on either side the result is empty."""
    s = settings or Settings()
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // s.block_chars))
    parts = []
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = sorted((r.item_id if r.item_id is not None else -1, r.text) for r in block.collect())
        sizes = {n for _, t in found if len(w := words(t.encode())) >= s.least_words for n in lengths(len(w), s)}
        walks = {n: Walks(n, s).measured(s) for n in sorted(sizes)}
        parts.append(docs.mapInArrow(_found(spark.sparkContext.broadcast(found), walks, s), SCHEMA))
    return reduce(DataFrame.unionByName, parts)
