"""Cross-tokenizer alignment: which ids of two tokenizers cover the same bytes, how many documents link a pair of ids, and how well each document's links
agree with the best partners.

A text is encoded once by both tokenizers. The ends of the tokens of A and B cut it into segments, and each segment is one link, as two tokens
overlap in one stretch. The links of some hundred documents (a batch) are written by stripes of A's ids (id modulo the number of stripes, which
spreads the frequent ids), as arrays: distinct pairs, how many documents have each, these documents, and the numbers of links.

Counting adds the pairs up within each task, deals them out by stripe, and adds them with ``np.add.at`` to the stripe's dense matrix of its A ids by all B ids; a row's
maximum is its id's best count. Scoring deals the links and the counts out by the same stripes: a task fills the dense matrix from the counts and passes
the links along it, one row of arrays after the other. A stripe with many links is split over several tasks, each with the stripe's counts.
The sums of a batch's documents are then put together, batch by batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents and distinct pairs of a batch at most (a document is never cut), and counted pairs in a row or held before they are added up.
DOCS, PAIRS, HELD = 1000, 1_000_000, 1_000_000
# fixed value: the split pattern of byte-level BPE
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of so many letters, or of white space, goes to the tokenizers library.
_LONG = 20_000


@dataclass(frozen=True)
class Settings:
    stripes: int = 96
    links: int = 16_000_000  #: pairs of documents and ids that a task scores, about


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes every byte as a letter: printable ones of Latin-1 as themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))}


class ByteLevel:
    """A byte-level BPE file of the tokenizers library: ids, and each id's bytes. Where ids stand in the order of merges, as ranks do, the same merges run in
    tiktoken, which is several times faster; texts with very long runs, and other files, go through the library."""

    def __init__(self, path: str):
        import os

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = byte_of_letter()
        vocab = {word: i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for word, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        pre = spec["pre_tokenizer"] or {}
        plain = not spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        ranked = plain and merged == sorted(merged) and len(vocab) == 256 + len(merged)
        self.fast = tiktoken.Encoding("ids", pat_str=_PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={}) if ranked else None
        self.long = regex.compile(rf"\s{{{_LONG}}}|\S{{{_LONG}}}").search

    def __call__(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [self.fast.encode_ordinary(t) if len(t) < _LONG or not self.long(t) else self.library.encode(t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """A sentencepiece model: ids, and each id's bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both vocabularies, with lengths and decimal names of their ids."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        self.sizes = [np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b)]
        self.names = [str(i) for i in range(max(self.n_a, self.n_b))]

    def align(self, raw: bytes, a: list[int], b: list[int]) -> tuple[int, str, np.ndarray] | None:
        """The number of groups, their digest, and the pair of every link as A's id * n_b + B's id; None if a side's bytes aren't the text's."""
        if not a or not b or b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
            return None
        ids = [np.array(a, np.int64), np.array(b, np.int64)]
        marks = np.zeros(len(raw) + 1, np.uint8)
        for side, x in enumerate(ids):
            marks[np.cumsum(self.sizes[side][x])] |= 1 + side
        marks = marks[marks > 0]
        # a segment's token is the one after those that ended before
        at = [np.cumsum(end := marks >> side & 1) - end for side in (0, 1)]
        both = np.flatnonzero(marks == 3)
        names = [[self.names[i] for i in x] for x in (a, b)]
        parts, i, j = [], 0, 0
        for k, m in zip((at[0][both] + 1).tolist(), (at[1][both] + 1).tolist(), strict=True):
            parts.append(f"{','.join(names[0][i:k])}|{','.join(names[1][j:m])}")
            i, j = k, m
        return len(both), hashlib.sha256(";".join(parts).encode()).hexdigest(), ids[0][at[0]] * self.n_b + ids[1][at[1]]


@lru_cache(maxsize=1)  # one for each Python worker
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def packed(x: np.ndarray) -> bytes:
    """Unsigned integers in the smallest width that holds them, which stands before them."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


LINKS = pa.schema([("batch", pa.int64()), ("stripe", pa.int32()), ("k", pa.int64()), ("pairs", pa.binary()), ("per", pa.binary()), ("docs", pa.binary()), ("n", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("facts", pa.list_(pa.int64())), ("digests", pa.list_(pa.string()))])
LINKS_SCHEMA = "batch long, stripe int, k long, pairs binary, per binary, docs binary, n binary, doc_ids array<long>, facts array<long>, digests array<string>"


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _by_stripe(batch: int, found: list[tuple[np.ndarray, np.ndarray]], stripes: int, n_b: int) -> Iterator[tuple]:
    """Rows of a batch of documents, each with its distinct pairs and their numbers of links: for every stripe its pairs (as places in the stripe's matrix), how many documents have each, these, and their numbers."""
    pair = np.concatenate([p for p, _ in found])
    n = np.concatenate([n for _, n in found])
    doc = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
    a, b = pair // n_b, pair % n_b
    stripe, place = a % stripes, a // stripes * n_b + b
    order = np.lexsort((doc, place, stripe))
    stripe, place, doc, n = stripe[order], place[order], doc[order], n[order]
    starts = _starts(stripe)
    for i, j in zip(starts, np.r_[starts[1:], len(stripe)], strict=False):
        first = _starts(place[i:j])
        yield (batch, int(stripe[i]), int(j - i), packed(place[i:j][first]), packed(np.diff(np.r_[first, j - i])), packed(doc[i:j]), packed(n[i:j]), None, None, None)


def _links(a: str, b: str, stripes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, seq = aligner(a, b), TaskContext.get().partitionId(), 0
        ids: list = []
        facts: list[int] = []
        digests: list[str] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def out():
            nonlocal seq
            batch = part << 32 | seq
            rows = [(batch, -1, 0, None, None, None, None, ids, facts, digests), *_by_stripe(batch, found, stripes, both.n_b)]
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), LINKS, strict=True)], schema=LINKS)

        for batch in common.slices(batches, 100):
            texts = batch.column("text").to_pylist()
            some = [t for t in texts if t]
            encoded = zip(some, both.a([" " + t for t in some]), both.b(some), strict=True)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids.append(doc_id)
                _, x, y = next(encoded) if text else (None, [], [])
                if text and (got := both.align(b" " + text.encode(), x, y)):
                    groups, digest, links = got
                    found.append(np.unique(links, return_counts=True))
                    facts += [len(x), len(y), groups, len(links)]
                    digests.append(digest)
                else:
                    found.append(none)
                    facts += [0, 0, 0, 0]
                    digests.append("")
                if len(ids) == DOCS or sum(len(p) for p, _ in found) > PAIRS:
                    yield from out()
                    ids, facts, digests, found = [], [], [], []
        if ids:
            yield from out()

    return common.frugal(run)


COUNTS = pa.schema([("stripe", pa.int32()), ("pairs", pa.binary()), ("n", pa.binary())])
COUNTS_SCHEMA = "stripe int, pairs binary, n binary"


def _count_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COUNTS, strict=True)], schema=COUNTS)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    place, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return place, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs of each stripe, added up."""
    held: dict[int, list] = {}
    size = 0
    for batch in batches:
        for stripe, pairs, per in zip(*(batch.column(c).to_pylist() for c in ("stripe", "pairs", "per")), strict=True):
            held.setdefault(stripe, []).append((unpacked(pairs), unpacked(per)))
            size += len(held[stripe][-1][0])
            if size > 4 * HELD:
                for s, parts in held.items():
                    held[s] = [_added(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > 2 * HELD:
                    for s, parts in held.items():
                        yield _count_rows([(s, *map(packed, parts[0]))])
                    held, size = {}, 0
    for s, parts in held.items():
        yield _count_rows([(s, *map(packed, _added(parts)))])


class Block:
    """The dense matrix of a stripe: its A ids by all B ids. Made once a task, and filled anew for each stripe."""

    def __init__(self, n_a: int, n_b: int, stripes: int):
        self.n_b, self.counts = n_b, np.zeros(-(-n_a // stripes) * n_b, np.int64)
        self.best = None

    def clear(self) -> None:
        self.counts.fill(0)
        self.best = None

    def add(self, place: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.counts, place, n.astype(np.int64))

    def maxima(self) -> np.ndarray:
        if self.best is None:
            self.best = self.counts.reshape(-1, self.n_b).max(1)
        return self.best


def _summed(a: str, b: str, stripes: int):
    """Counts of all tasks in the stripe's matrix; a stripe's rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        block, own = None, None

        def close():
            at = np.flatnonzero(block.counts)
            for i in range(0, len(at), HELD):
                yield _count_rows([(own, packed(at[i : i + HELD]), packed(block.counts[at[i : i + HELD]]))])

        for batch in batches:
            for stripe, pairs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stripe != own:
                    if own is not None:
                        yield from close()
                        block.clear()
                    block, own = block or Block(both.n_a, both.n_b, stripes), stripe
                block.add(unpacked(pairs), unpacked(n))
        if own is not None:
            yield from close()

    return common.frugal(run)


SCORES = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("best", pa.binary()), ("total", pa.binary())])


def _scored(a: str, b: str, stripes: int):
    """For each row of links the sums of its documents. The counts of a stripe come first, then its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        block, own = None, None
        for batch in batches:
            rows = []
            for stripe, salt, _, number, pairs, per, docs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (stripe, salt) != own:
                    if block:
                        block.clear()
                    block, own = block or Block(both.n_a, both.n_b, stripes), (stripe, salt)
                if number is None:
                    block.add(unpacked(pairs), unpacked(n))
                    continue
                place, per, docs, n = unpacked(pairs).astype(np.int64), unpacked(per), unpacked(docs), unpacked(n).astype(np.int64)
                count = block.counts[place]
                best = np.repeat(count == block.maxima()[place // both.n_b], per)
                end = int(docs.max()) + 1
                some = np.zeros(end, bool)
                some[docs] = True
                sums = np.zeros((2, end), np.int64)
                np.add.at(sums[0], docs, n * best)
                np.add.at(sums[1], docs, n * np.repeat(count, per))
                rows.append((number, packed(np.flatnonzero(some)), packed(sums[0][some]), packed(sums[1][some])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCORES, strict=True)], schema=SCORES)

    return common.frugal(run)


FOUND = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's documents with the sums of all its rows; the row with the documents' own facts comes first."""
    own, ids, facts, digests, sums = None, [], [], [], np.zeros((2, 0), np.int64)

    def out():
        x = np.array(facts, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, x.T), *map(pa.array, sums), pa.array(digests, pa.string())], schema=FOUND)

    for batch in batches:
        for number, docs, best, total, new_ids, new_facts, new_digests in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != own:
                if own is not None:
                    yield out()
                own, ids, facts, digests, sums = number, new_ids, new_facts, new_digests, np.zeros((2, len(new_ids)), np.int64)
            else:
                at = unpacked(docs)
                sums[0][at] += unpacked(best).astype(np.int64)
                sums[1][at] += unpacked(total).astype(np.int64)
    if own is not None:
        yield out()


class Alignment:
    """Written links of ``docs``, and the counts of all pairs of ids."""

    def __init__(self, docs: DataFrame, a: str, b: str, s: Settings):
        self.a, self.b, self.s, self.spark, self.work = a, b, s, docs.sparkSession, common.Work(docs.sparkSession, "alignment")
        common.small_batches(self.spark)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.links = self.work.save(docs.mapInArrow(_links(a, b, s.stripes), LINKS_SCHEMA), "links")
        parts = self.links.filter("stripe >= 0").select("stripe", "pairs", "per").mapInArrow(_combined, COUNTS_SCHEMA)
        self.counts = self.work.save(parts.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_summed(a, b, s.stripes), COUNTS_SCHEMA), "counts")

    def pairs(self) -> DataFrame:
        """a, b, documents (how many have the pair linked), best (whether no other B id has more with this A id)."""
        a, b, stripes = self.a, self.b, self.s.stripes

        def run(batches):
            n_b = aligner(a, b).n_b
            for batch in batches:
                for stripe, pairs, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    place = unpacked(pairs).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(place // n_b * stripes + stripe), pa.array(place % n_b), pa.array(unpacked(n).astype(np.int64))], ["a", "b", "documents"])

        rows = self.counts.mapInArrow(run, "a long, b long, documents long")
        return rows.join(rows.groupBy("a").agg(F.max("documents").alias("most")), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        links = self.links.filter("stripe >= 0")
        sizes = links.groupBy("stripe").agg(F.sum("k").alias("k")).collect()  # a row a stripe
        salts = F.element_at(F.create_map(F.lit(-1), F.lit(1), *(F.lit(int(x)) for r in sizes for x in (r.stripe, -(-r.k // self.s.links)))), F.col("stripe"))
        none = F.lit(None)
        known = self.counts.select("stripe", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), none.cast("long").alias("batch"), "pairs", none.cast("binary").alias("per"), none.cast("binary").alias("docs"), "n")
        asked = links.select("stripe", F.pmod(F.xxhash64("batch"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "batch", "pairs", "per", "docs", "n")
        dealt = known.unionByName(asked).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
        scores = dealt.mapInArrow(_scored(self.a, self.b, self.s.stripes), "batch long, docs binary, best binary, total binary")
        lists = [F.lit(None).cast(kind).alias(x) for x, kind in (("doc_ids", "array<long>"), ("facts", "array<long>"), ("digests", "array<string>"))]
        own = self.links.filter("stripe < 0").select("batch", *(F.lit(None).cast("binary").alias(x) for x in ("docs", "best", "total")), "doc_ids", "facts", "digests", F.lit(0).alias("kind"))
        rows = own.unionByName(scores.select("*", *lists, F.lit(1).alias("kind"))).repartition("batch").sortWithinPartitions("batch", "kind").drop("kind")
        return rows.mapInArrow(_together, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, a: str, b: str, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``a``: a byte-level BPE file of the tokenizers library, applied to a space and the text; ``b``: a sentencepiece model that adds the space itself; both at the same places
    on every executor. n_best: links whose pair of ids is in as many documents as any pair of its A id; count_sum: these numbers over all links.
    A null or empty text, and one whose bytes either side doesn't give back, has no tokens: zeros and an empty digest. Rows that repeat an id, or have
    none, give a row each and count as documents of their own. An empty table gives an empty result. A text of any length is encoded whole."""
    return Alignment(docs, a, b, settings or Settings()).documents()
