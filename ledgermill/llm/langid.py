"""Language identification by cross-parsing: a text is cut greedily into the longest phrases that occur in a language's sample, by
the suffix automaton of that sample; the language that needs the fewest phrases, normalised by its sample's length, wins.

The automata are made from a bounded sample of labelled texts (at most 64 texts of 400 letters, 25,600 letters, a language) and are laid out as tables, so that many pieces of text
advance by one letter at a time together; with many languages or letters the tables hold the transitions only. Each row is judged for itself: nothing is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Sampled texts per language, and the excerpts of each, spread evenly over it, and their code points: the bound of what a language is learnt from.
SAMPLE_TEXTS, EXCERPTS, EXCERPT = 64, 5, 80
#: Letters of the pieces of a text that advance together; the parse is carried from each into the next.
PIECE = 512
BLANK, STRANGE, BREAK, PAD = 0, 1, 2, 3
#: States by letters up to which transitions are dense tables (64 MB); with more they are laid over each other, which takes longer.
CELLS = 1 << 24


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the least automaton that accepts every substring; 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Dense:
    """Transitions as one table of all states by all letters. A value is the next state's row and, as the lowest bit, whether a phrase has started."""

    def __init__(self, automaton: list[dict[int, int]], size: int):
        self.root = 0
        table = np.full((len(automaton), size), -1, np.int64)
        for s, out in enumerate(automaton):
            for c, to in out.items():
                table[s, c] = to * size
        # where a phrase can't go on, the next one starts
        begin = np.maximum(table[0], 0)
        table = np.where(table >= 0, table * 2, begin * 2 + 1)
        table[0] = begin * 2 + 1
        table[:, PAD] = 0
        self.table = table.astype(np.int32).ravel()

    def step(self, state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.table.take(state + letters)
        return to >> 1, to & 1


class Sparse:
    """Transitions of all states laid over each other in one row: a state's stand at its base and the letter, and each place names the state that it
    belongs to. Most states have one transition and fill the gaps, so there are little more places than transitions, whatever the number of letters."""

    def __init__(self, automaton: list[dict[int, int]], size: int):
        self.root = 0
        self.begin = np.zeros(size, np.int32)
        for c, to in automaton[0].items():
            self.begin[c] = to
        self.counts = np.ones(size, np.int32)
        self.counts[PAD] = 0
        # the root starts a phrase with every letter, so it has no row
        rows = [(s, sorted(out)) for s, out in enumerate(automaton) if s and out]
        several = sorted((r for r in rows if len(r[1]) > 1), key=lambda r: -len(r[1]))
        single = [r for r in rows if len(r[1]) == 1]
        # half of the places stay free for the states with several transitions, so a few tries find a base for each
        used = np.zeros(size + 4 * sum(len(cs) for _, cs in several) + sum(len(cs) for _, cs in single) + 1, bool)
        self.base = np.zeros(len(automaton), np.int32)
        rng = np.random.default_rng(1)
        tries = iter(())
        for s, cs in several:
            first = np.array(cs)
            while True:
                if (at := next(tries, None)) is None:
                    tries = iter(rng.integers(1, len(used) - size + 1, 4096).tolist())
                elif not used[at + first].any():
                    break
            self.base[s] = at
            used[at + first] = True
        free = np.flatnonzero(~used[size:]) + size
        if len(free) < len(single):
            free = np.concatenate([free, len(used) + np.arange(len(single) - len(free))])
        for (s, cs), place in zip(single, free.tolist(), strict=False):
            self.base[s] = place - cs[0]
        ends = max((int(self.base[s]) + cs[-1] for s, cs in rows), default=0)
        width = max(ends, int(self.base.max(initial=0)) + size) + 1
        self.of, self.to = np.full(width, -1, np.int32), np.zeros(width, np.int32)
        states = np.repeat([s for s, _ in rows], [len(cs) for _, cs in rows]).astype(np.int64)
        place = self.base[states] + np.array([c for _, cs in rows for c in cs], np.int64)
        self.of[place], self.to[place] = states, [automaton[s][c] for s, cs in rows for c in cs]

    def step(self, state: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.base.take(state) + letters
        goes_on = self.of.take(place) == state
        return np.where(goes_on, self.to.take(place), self.begin.take(letters)), np.where(goes_on, 0, self.counts.take(letters))


class Parser:
    """Phrase counts of texts against the samples of all languages."""

    def __init__(self, samples: dict[str, list[str]], cells: int = CELLS):
        self.languages = sorted(samples)
        lowered = {x: [t.lower() for t in samples[x]] for x in self.languages}
        alphabet = sorted({c for texts in lowered.values() for t in texts for c in t if c.isalpha()})
        ids = {c: i + 4 for i, c in enumerate(alphabet)}
        self.size = len(alphabet) + 4
        self.ids = np.where(_letters(), STRANGE, BLANK).astype(np.int32)
        for c, i in ids.items():
            self.ids[ord(c)] = i
            if len(c.upper()) == 1 and c.upper().lower() == c:
                self.ids[ord(c.upper())] = i
        letters = {x: [s for t in lowered[x] for s in (*self.symbols(t).tolist(), BREAK)] for x in self.languages}
        kind = Dense if sum(2 * len(s) for s in letters.values()) * self.size <= cells else Sparse
        self.tables = [kind(suffix_automaton(letters[x]), self.size) for x in self.languages]
        self.weight = np.log2(np.array([len(letters[x]) for x in self.languages]) + 2.0)

    def symbols(self, text: str) -> np.ndarray:
        """Ids of the letters, runs of anything else being one blank; empty without letters."""
        s = self.ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not s.any():
            return s[:0]
        blank = s == BLANK
        blank[1:] &= blank[:-1].copy()
        blank[:1] = False
        return s[~blank]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Numbers of phrases, by text and language."""
        pieces = [-(-len(t) // PIECE) for t in texts]
        lanes = sum(pieces)
        if not lanes or not self.languages:
            return np.zeros((len(texts), len(self.languages)), np.int64)
        flat = np.full(lanes * PIECE, PAD, np.int32)
        at = 0
        for t, n in zip(texts, pieces, strict=True):
            flat[at : at + len(t)] = t
            at += n * PIECE
        steps = np.ascontiguousarray(flat.reshape(lanes, PIECE).T)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        owner = np.repeat(np.arange(len(texts)), pieces)
        for i, table in enumerate(self.tables):
            state, total = np.full(lanes, table.root, np.int32), np.zeros(lanes, np.int32)
            for step in steps:
                state, started = table.step(state, step)
                total += started
            total += self._carried(table, steps, owner, state)
            out[:, i] = np.bincount(owner, total, len(texts))
        return out

    def _carried(self, table: Dense | Sparse, steps: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """By piece how many phrases more it has (mostly fewer) if it goes on where the piece before it ended, instead of anew. Both
        parses of a piece are followed until they meet; the few that don't within it change where the next piece begins."""
        more, end = np.zeros(len(owner), np.int64), ends.copy()
        later = np.concatenate([[False], owner[1:] == owner[:-1]])
        pending = np.flatnonzero(later)
        while len(pending):
            a, b, d = np.full(len(pending), table.root, np.int32), end[pending - 1], np.zeros(len(pending), np.int64)
            live = np.flatnonzero(a != b)
            for step in steps:
                if not len(live):
                    break
                s = step[pending[live]]
                (x, one), (y, other) = table.step(a[live], s), table.step(b[live], s)
                d[live] += other - one
                a[live], b[live] = x, y
                live = live[a[live] != b[live]]
            new = ends[pending]
            new[live] = b[live]
            more[pending] = d
            changed = pending[new != end[pending]] + 1
            end[pending] = new
            changed = changed[changed < len(owner)]
            pending = changed[later[changed]]
        return more

    def judge(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text; the score is the share of phrases that the second language needs more."""
        symbols = [self.symbols(t) for t in texts]
        cost = self.phrases(symbols) * self.weight
        out = []
        for s, c in zip(symbols, cost, strict=True):
            if not len(s) or not self.languages:
                out.append(("und", 0.0))
                continue
            best = int(c.argmin())
            rest = np.delete(c, best)
            out.append((self.languages[best], float(1 - c[best] / rest.min()) if len(rest) else 1.0))
        return out


def samples(docs: DataFrame, learn: Column) -> dict[str, list[str]]:
    """For each language at most SAMPLE_TEXTS labelled texts, those of the least hashes in as many parts of the ids, and of
    each EXCERPTS excerpts spread evenly over it (a short text whole). Only ids are aggregated; the excerpts are fetched afterwards."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_TEXTS)).alias("part")
    ids = rows.groupBy("lang", part).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), "doc_id")).alias("x")).select("lang", "part", "x.doc_id")
    wanted = [r.doc_id for r in ids.select("doc_id").distinct().collect() if r.doc_id is not None]
    out: dict[str, list[str]] = {}
    if wanted:
        size = F.length("text")
        at = lambda i: (F.lit(1) + F.floor((size - EXCERPT) * i / (EXCERPTS - 1))).cast("int")
        spread = F.array(*[F.substring(F.col("text"), at(i), F.lit(EXCERPT)) for i in range(EXCERPTS)])
        excerpts = F.when(size <= EXCERPT * EXCERPTS, F.array("text")).otherwise(spread)
        # of rows that repeat an id the least text counts
        found = rows.filter(F.col("doc_id").isin(wanted)).groupBy("lang", "doc_id").agg(F.min(excerpts).alias("excerpts"))
        for r in sorted(found.collect(), key=lambda r: (r.lang, r.doc_id, r.excerpts)):
            out.setdefault(r.lang, []).extend(r.excerpts)
    return out


def identify_languages(docs: DataFrame, learn: Column) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text, lang; other columns are ignored).

    ``learn``: a boolean column of doc_id; languages are learnt from rows where it holds. lang and doc_id are no inputs of a prediction.
    Whole texts of any length are parsed. lang_pred is ``und`` with score 0 for a null text, one without letters, and where
    nothing could be learnt; ties go to the language that sorts first, with score 0; rows that repeat an id give a row each; an empty table
    gives an empty result."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learnt = docs.sparkSession.sparkContext.broadcast(samples(rows, learn))
    return rows.select("doc_id", "text").mapInArrow(_judged(learnt), "doc_id long, lang_pred string, score double")


#: The parser of the last run in this Python worker, which later tasks of the run use again.
_KEPT: dict[str, Parser] = {}


def _judged(learnt):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = Parser(learnt.value)
        parser = _KEPT[name]
        for batch in common.slices(batches, 400):
            lang, score = zip(*parser.judge([t or "" for t in batch.column("text").to_pylist()]), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.frugal(run)
