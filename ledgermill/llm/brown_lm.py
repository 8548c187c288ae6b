"""Class-based bigram language model: exchange clustering, class transitions, word emissions, smoothed perplexity.

Every word of at least ``Settings.own`` occurrences in training is a unit (the ``Settings.exchanged`` most frequent ones, two millions, are what
the arrays of labels and counts are bounded by). Rarer and unseen words share sixteen units by their shape (digits, letters beyond ASCII, marks at the
end, length). The end of a text is a unit too. Units are exchanged between classes: first the most frequent ones among themselves, then the
others join the classes that their contexts fit best, then all are exchanged. The probability of a word after another is

    P(class | class before) * P(unit | class) * P(word | unit)

where the last factor is 1 for a word that is a unit and (count + 1) / (tokens + words + 1) of its shape for another. All counts
cover the whole training corpus. Words are told apart by 64-bit hashes.

Tasks gather the tokens after and before each unit in runs of text, for buckets of units; these lists are shuffled by bucket and written, one row
a bucket (the most frequent units are dealt over several, so that no task gets all of one). A round of the exchange is a pass over that table without a shuffle: labels
are broadcast, each task counts its units' neighbours by class and finds the best moves, and the class bigram counts are summed. Only those, the
labels, and the neighbours by class of the dealt units come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Distinct words, or tokens, that a task gathers before it passes them on.
FLUSH = 300_000
SHAPES = 16
#: Counts up to which gains of moves are looked up in tables.
SMALL = 24
#: The most frequent units are dealt over ``PARTS`` buckets.
SPLIT, PARTS = 256, 16
#: Units whose neighbours by class are counted at a time.
SLICE = 512
#: Tokens of a bucket, about, and those that are held before equal ones are added up.
BUCKET, HELD = 500_000, 2_000_000


@dataclass(frozen=True)
class Settings:
    own: int = 3  #: occurrences from which a word is a unit
    exchanged: int = 2_000_000  #: units at most, the most frequent words
    first: int = 16_384  #: most frequent units, which are clustered first
    classes: int = 64
    first_rounds: int = 10
    rounds: int = 6
    prior: float = 8.0  #: weight of the class frequencies in a transition
    add: float = 0.5  #: added to a unit's count in an emission


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each byte at each place of a word; a word's hash mixes the sum of its bytes' numbers.
_NUMBERS = _mixed(np.arange(1, 256 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: What bytes tell of a word's shape: 1 a digit, 2 beyond ASCII; and whether a last byte is neither letter nor digit.
_BYTE = np.array([(48 <= b <= 57) + 2 * (b >= 128) for b in range(256)], np.uint8)
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Tokens:
    """Words of some texts between ASCII white space, A-Z lowered: each one's place among the distinct ones, the number of words of each text, and of the distinct
    ones 64-bit hash and shape. Whatever is done for a word is done for the distinct ones at once."""

    def __init__(self, texts: pa.Array):
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
        found = lists.flatten().dictionary_encode()
        place, words = found.indices.to_numpy(), found.dictionary
        self.sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32).astype(np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.ends = ends - ends[0]
        sizes = np.diff(self.ends)
        if len(empty := np.flatnonzero(sizes == 0)):  # of texts without words
            self.sizes[np.repeat(np.arange(len(self.sizes)), self.sizes)[place == empty[0]]] = 0
            place = place[place != empty[0]]
            place = place - (place > empty[0])
            self.ends, sizes = np.delete(self.ends, empty[0]), np.delete(sizes, empty[0])
        self.place, starts = place, self.ends[:-1]
        if not len(sizes):
            self.hashes, self.shapes = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        at = np.arange(len(data)) - np.repeat(starts, sizes)
        numbers = _NUMBERS[(at & 255) << 8 | data]
        if (long_ := at > 255).any():
            numbers[long_] = _mixed(numbers[long_] + (at[long_] >> 8).astype(np.uint64))
        self.hashes = _mixed(np.add.reduceat(numbers, starts) + sizes.astype(np.uint64)).view(np.int64)
        flags = np.bitwise_or.reduceat(_BYTE[data], starts).astype(np.int64)
        self.shapes = flags + 4 * _MARK[data[self.ends[1:] - 1]] + 8 * (sizes > 8)


def text_hash(raw: bytes) -> int:
    import xxhash

    return common.signed(xxhash.xxh3_64_intdigest(raw))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n and shape of the words of a task, added up over some texts at a time."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out():
        h, n, shapes = (np.concatenate(x) for x in zip(*held, strict=True))
        h, first, at = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(shapes[first].astype(np.int32))], ["h", "n", "shape"])

    for batch in batches:
        t = Tokens(batch.column("text"))
        held.append((t.hashes, np.bincount(t.place, minlength=len(t.hashes)), t.shapes))
        size += len(t.hashes)
        if size > 4 * FLUSH:
            yield out()
            held, size = [], 0
    if held:
        yield out()


class Units:
    """Word to unit: 0 is the end of a text, then the words of ``hashes`` (sorted, with their units), then the shapes."""

    def __init__(self, hashes: np.ndarray, units: np.ndarray):
        self.hashes, self.units, self.shapes = hashes, units, len(hashes) + 1

    def of(self, t: Tokens) -> np.ndarray:
        """The units of distinct words."""
        if not len(self.hashes):
            return (self.shapes + t.shapes).astype(np.int32)
        order = np.argsort(t.hashes)  # a search in order stays in the cache
        h = t.hashes[order]
        at = np.minimum(self.hashes.searchsorted(h), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == h, self.units[at], self.shapes + t.shapes[order])
        out = np.empty(len(h), np.int32)
        out[order] = found
        return out

    def __getitem__(self, word: bytes) -> int:
        return int(self.of(Tokens(pa.array([word.decode()])))[0])


def _bucket(unit: np.ndarray, part: int, buckets: int) -> np.ndarray:
    unit = unit.astype(np.int64)
    return ((unit + 1) * 0x9E3779B1 + np.where(unit < SPLIT, part % PARTS, 0) * 0x85EBCA77) % 0x7FFFFFFF % buckets


def _lists(unit: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> list[bytes]:
    """Units, the numbers of their neighbours, the neighbours, and how often each is one, if not once; sorted by unit."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(unit)])
    return [unit[starts].astype(np.int32).tobytes(), sizes.astype(np.int32).tobytes(), v.astype(np.int32).tobytes(), b"" if n is None else n.astype(np.int64).tobytes()]


NEAR = pa.schema([("bucket", pa.int32())] + [(f"{side}_{x}", pa.binary()) for side in ("after", "before") for x in ("units", "sizes", "v", "n")])
NEAR_SCHEMA = ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in NEAR)


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NEAR, strict=True)], schema=NEAR)


def _near_lists(words, buckets: int):
    """For each bucket of units what comes after and before them in a run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part = Units(*words.value), 0
        end = np.zeros(1, np.int32)
        row, size = [end], 1

        def out():
            # every unit of a run is followed and preceded equally often, as it begins and ends with an end
            x = np.concatenate(row)
            u, v = x[:-1], x[1:]
            b, sides = None, []
            for unit, other in ((u, v), (v, u)):
                key = _bucket(unit, part, buckets) << 32 | unit
                order = np.argsort(key, kind="stable")
                key = key[order]
                b, sides = key >> 32, [*sides, ((key & 0xFFFFFFFF), other[order])]
            starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(b)]
            for at in range(0, len(starts), 64):
                yield _rows([(int(b[i]), *_lists(sides[0][0][i:j], sides[0][1][i:j]), *_lists(sides[1][0][i:j], sides[1][1][i:j])) for i, j in zip(starts[at : at + 64], ends[at : at + 64], strict=True)])

        for batch in batches:
            part = part or zlib.crc32((batch.column("text")[0].as_py() or "").encode()[:1000])
            t = Tokens(batch.column("text"))
            # every text's units, and an end after them
            x = np.zeros(len(t.place) + len(t.sizes), np.int32)
            x[np.arange(len(t.place)) + np.repeat(np.arange(len(t.sizes)), t.sizes)] = units.of(t)[t.place]
            row.append(x)
            size += len(x)
            if size > 4 * FLUSH:
                yield from out()
                row, size, part = [end], 1, part + 1
        yield from out()

    return run


class Side:
    """Of one side of a bucket: unit and neighbour of every entry, and its number if not all are 1."""

    def __init__(self, units: bytes, sizes: bytes, v: bytes, n: bytes):
        self.units, self.sizes = np.frombuffer(units, np.int32), np.frombuffer(sizes, np.int32)
        self.v, self.n = np.frombuffer(v, np.int32), np.frombuffer(n, np.int64) if n else None

    def keys(self) -> np.ndarray:
        return np.repeat(self.units.astype(np.int64), self.sizes) << 32 | self.v

    @staticmethod
    def joined(sides: list[Side], add_up: bool) -> list[bytes]:
        key = np.concatenate([x.keys() for x in sides])
        if not add_up and all(x.n is None for x in sides):
            key = key[np.argsort(key >> 32, kind="stable")]
            return _lists(key >> 32, key & 0xFFFFFFFF)
        n = np.concatenate([np.ones(len(x.v), np.int64) if x.n is None else x.n for x in sides])
        key, at = np.unique(key, return_inverse=True)
        return _lists(key >> 32, key & 0xFFFFFFFF, np.bincount(at, n).astype(np.int64))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each bucket; a bucket's rows follow each other."""
    key, held = None, []

    def close(add_up: bool = False) -> list:
        return [key, *Side.joined([x for x, _ in held], add_up), *Side.joined([x for _, x in held], add_up)]

    for batch in batches:
        for bucket, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != key:
                if held:
                    yield _rows([close()])
                key, held = bucket, []
            held.append((Side(*lists[:4]), Side(*lists[4:])))
            if sum(len(x.v) for x, _ in held) > HELD and len(held) > 1:
                _, *lists = close(True)
                held = [(Side(*lists[:4]), Side(*lists[4:]))]
    if held:
        yield _rows([close()])


def _among(first: int):
    """The first units and neighbours only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = [bucket]
                for side in (Side(*lists[:4]), Side(*lists[4:])):
                    unit = np.repeat(side.units, side.sizes)
                    keep = (unit < first) & (side.v < first)
                    row += _lists(unit[keep], side.v[keep], None if side.n is None else side.n[keep])
                yield _rows([row])

    return run


def near_units(training: DataFrame, words, tokens_: int, work: common.Work) -> DataFrame:
    """The units of every bucket with their neighbours, written."""
    lists = training.mapInArrow(_near_lists(words, max(16, tokens_ // BUCKET)), NEAR_SCHEMA)
    return work.save(lists.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, NEAR_SCHEMA), "near")


def _f(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(cells: np.ndarray) -> float:
    """Of the class bigrams, without the part that no clustering changes."""
    return float(_f(cells).sum() - _f(cells.sum(0)).sum() - _f(cells.sum(1)).sum())


class Gains:
    """Gains in likelihood of moves, by the class bigram counts ``cells``."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.sums = cells, (cells.sum(1), cells.sum(0))
        n = np.arange(SMALL + 1)
        base = _f(cells)
        #: By count, class of the neighbour and class moved to.
        self.tables = [_f(m.T[None] + n[:, None, None]) - f.T[None] for m, f in ((cells, base), (cells.T, base.T))]
        self.margins = [_f(s[None] + n[:, None]) - _f(s)[None] for s in self.sums]

    def _margin(self, side: int, n: np.ndarray) -> np.ndarray:
        small = self.margins[side][np.minimum(n, SMALL).astype(np.int64)]
        big = np.flatnonzero(n > SMALL)
        s = self.sums[side][None]
        small[big] = _f(s + n[big, None]) - _f(s)
        return small

    def of(self, own: np.ndarray, after: np.ndarray, before: np.ndarray, loops: np.ndarray) -> np.ndarray:
        """By unit and class the gain of putting the unit, taken out of its own class (below 0: none), into the class; only
        differences within a row have a meaning. ``after[i, c]`` and ``before[i, c]``: counts of unit i with a following and preceding
        unit of class c, itself included; ``loops``: counts of unit i after itself."""
        k, n_classes = after.shape
        rows, there = np.arange(k), own >= 0
        a = np.where(there, own, 0)
        o, p = after.copy(), before.copy()
        o[rows, a] -= np.where(there, loops, 0)
        p[rows, a] -= np.where(there, loops, 0)
        total = np.zeros((k, n_classes))
        m = self.cells
        for side, (x, y, cells) in enumerate(((o, p, m), (p, o, m.T))):
            i, c = np.nonzero(x)
            if not len(i):
                continue
            n = x[i, c]
            gain = self.tables[side][np.minimum(n, SMALL).astype(np.int64), c]
            mine, inside = there[i], there[i] & (c == a[i])
            hard = np.flatnonzero((n > SMALL) | inside)
            col = cells.T[c[hard]] - np.where(inside[hard, None], y[i[hard]], 0.0)
            gain[hard] = _f(col + n[hard, None]) - _f(col)
            # in its own class the cell lacks the unit's counts
            e = np.flatnonzero(mine)
            cell = cells[a[i[e]], c[e]] - n[e] - np.where(inside[e], y[i[e], a[i[e]]] + loops[i[e]], 0.0)
            gain[e, a[i[e]]] = _f(cell + n[e]) - _f(cell)
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            total[i[starts]] += np.add.reduceat(gain, starts, axis=0)
        # the cell of a class with itself gets both sides
        i, c = np.nonzero(((o > 0) & (p > 0)) | (loops[:, None] > 0))
        d = m[c, c] - np.where(there[i] & (c == a[i]), o[i, c] + p[i, c] + loops[i], 0.0)
        x, y, both = o[i, c], p[i, c], o[i, c] + p[i, c] + loops[i]
        total[i, c] += _f(d + both) - _f(d + x) - _f(d + y) + _f(d)
        for side, n in enumerate((after.sum(1), before.sum(1))):
            part = self._margin(side, n)
            s = self.sums[side][a[there]]
            part[rows[there], a[there]] = _f(s) - _f(s - n[there])
            total -= part
        return total


def _by_class(side: Side, ends: np.ndarray, units: np.ndarray, labels: np.ndarray, classes: int, with_loops: bool = False):
    """Of some ``units`` (sorted) the neighbours by class, without those that have none, and those that are the unit itself. ``ends``: where each unit of the side ends."""
    k = len(units)
    i, j = np.searchsorted(side.units, units[0]), np.searchsorted(side.units, units[-1], "right")
    own = side.units[i:j]
    row = np.minimum(np.searchsorted(units, own), k - 1)
    row = np.where(units[row] == own, row, k)  # the others' go to a row of their own
    start, end = (ends[i - 1] if i else 0), (ends[j - 1] if j else 0)
    entry, v = np.repeat(row, side.sizes[i:j]), side.v[start:end]
    n = None if side.n is None else side.n[start:end]
    found = np.bincount(entry * (classes + 1) + np.minimum(labels[v], classes), n, (k + 1) * (classes + 1)).reshape(k + 1, classes + 1)[:k, :classes].astype(float)
    loops = np.zeros(k)
    if with_loops:
        self_ = np.flatnonzero(v == np.append(units, -1)[entry])
        loops = np.bincount(entry[self_], None if n is None else n[self_], k)[:k] * (labels[units] < classes)
    return found, loops


def _cells(labels, classes: int):
    """Class bigram counts, as rows (i, n) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((classes + 1) ** 2)
        of = np.minimum(labels.value, classes)
        for batch in batches:
            for lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                side = Side(*lists)
                pair = np.repeat(of[side.units].astype(np.int32) * (classes + 1), side.sizes) + of[side.v]
                cells += np.bincount(pair, side.n, len(cells))
        cells = cells.reshape(classes + 1, -1)[:classes, :classes].ravel()
        i = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(cells[i].astype(np.int64))], ["i", "n"])

    return run


class Mover:
    """Best moves by the class bigram counts: of units without a class (``fit``) to any, of a share of the others to a better one."""

    def __init__(self, labels: np.ndarray, cells: np.ndarray, fit: bool, turn: int, share: float):
        self.labels, self.classes, self.gains, self.fit, self.turn, self.share = labels, len(cells), Gains(cells), fit, turn, share

    def wanted(self, unit: np.ndarray) -> np.ndarray:
        own = self.labels[unit]
        dice = ((unit.astype(np.int64) + 1) * 0x9E3779B1 + self.turn * 0x85EBCA77) * 0xC2B2AE35 >> 16 & 1023
        return np.flatnonzero(own >= self.classes if self.fit else (own < self.classes) & (dice < 1024 * self.share))

    def best(self, unit: np.ndarray, after: np.ndarray, before: np.ndarray, loops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that move, and their new classes."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(unit), 512):
            x = slice(at, at + 512)
            u, rows = unit[x].astype(np.int64), np.arange(len(unit[x]))
            old = np.full(len(u), -1) if self.fit else self.labels[u].astype(np.int64)
            total = self.gains.of(old, after[x], before[x], loops[x])
            to = np.where((after[x].sum(1) + before[x].sum(1)) > 0, total.argmax(1), u % self.classes)
            better = np.ones(len(u), bool) if self.fit else total[rows, to] > total[rows, old] + 1e-6
            out.append((u[better], to[better]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _moves(labels, cells: np.ndarray, fit: bool, turn: int, share: float):
    """unit and the class that it moves to; of the units dealt over several buckets, instead, the neighbours by class in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mover = Mover(labels.value, cells, fit, turn, share)
        for batch in batches:
            for _, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, other = Side(*lists[:4]), Side(*lists[4:])
                units = np.union1d(one.units, other.units)
                wanted = units[mover.wanted(units)]
                ends = np.cumsum(one.sizes, dtype=np.int64), np.cumsum(other.sizes, dtype=np.int64)
                found = [told(mover, wanted[at : at + SLICE], one, other, ends) for at in range(0, len(wanted), SLICE)]
                if found:
                    unit, to = (np.concatenate([f[i] for f in found]).astype(np.int32) for i in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(to), pa.array([c for f in found for c in f[2]], pa.binary())], ["unit", "to", "counts"])

    def told(mover, unit, one, other, ends):
        (after, loops), (before, _) = _by_class(one, ends[0], unit, mover.labels, mover.classes, True), _by_class(other, ends[1], unit, mover.labels, mover.classes)
        whole = unit >= SPLIT
        moved, to = mover.best(unit[whole], after[whole], before[whole], loops[whole])
        part = np.flatnonzero(~whole)
        counts = [np.concatenate([after[i], before[i], loops[i : i + 1]]).tobytes() for i in part]
        return np.concatenate([moved, unit[part]]), np.concatenate([to, np.full(len(part), -1)]), [None] * len(moved) + counts

    return run


class Exchange:
    """Classes of units. ``near``: their neighbours, a written table."""

    def __init__(self, near: DataFrame, n_units: int, s: Settings, work: common.Work):
        self.near, self.s, self.spark, self.work = near, s, near.sparkSession, work
        self.labels = np.full(n_units, 255 if s.classes < 256 else 65535, np.uint8 if s.classes < 256 else np.uint16)
        self.cells = np.zeros((s.classes, s.classes))

    def count(self, rows: DataFrame) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(self.labels)
        found = rows.select("after_units", "after_sizes", "after_v", "after_n").mapInArrow(_cells(shared, self.s.classes), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        cells = np.zeros(self.s.classes**2)
        cells[found["i"].to_numpy()] = found["n"].to_numpy()
        return cells.reshape(self.s.classes, -1)

    def _moved(self, rows: DataFrame, fit: bool, turn: int = 0, share: float = 1.0) -> np.ndarray:
        shared = self.spark.sparkContext.broadcast(self.labels)
        found = rows.mapInArrow(_moves(shared, self.cells, fit, turn, share), "unit int, to int, counts binary").toArrow()
        shared.destroy()
        unit, to, new = found["unit"].to_numpy(), found["to"].to_numpy(), self.labels.copy()
        new[unit[to >= 0]] = to[to >= 0]
        parts: dict[int, np.ndarray] = {}
        for u, raw in zip(unit[to < 0].tolist(), found["counts"].filter(pa.array(to < 0)).to_pylist(), strict=True):
            parts[u] = parts.get(u, 0) + np.frombuffer(raw)
        if parts:
            c, x = self.s.classes, np.stack([parts[u] for u in sorted(parts)])
            moved, to = Mover(self.labels, self.cells, fit, turn, share).best(np.array(sorted(parts)), x[:, :c], x[:, c : 2 * c], x[:, -1])
            new[moved] = to
        return new

    def rounds(self, rows: DataFrame, most: int) -> None:
        """Half of the units may move in a round, each to the class that gains most against the counts at its start; a round that loses
        likelihood is undone and tried with fewer moves."""
        self.cells, share = self.count(rows), 0.5
        value = likelihood(self.cells)
        for turn in range(most):
            old, self.labels = self.labels, self._moved(rows, False, turn, share)
            if not (self.labels != old).any():
                break
            cells = self.count(rows)
            if (new := likelihood(cells)) <= value:
                self.labels, share = old, share / 2
                continue
            done, value, self.cells = new - value < 5e-5 * abs(value), new, cells
            if done:
                break

    def run(self) -> None:
        s, n = self.s, len(self.labels)
        first = min(n, s.first)
        self.labels[:first] = np.arange(first) % s.classes
        self.rounds(self.work.save(self.near.mapInArrow(_among(first), NEAR_SCHEMA), "near-first") if first < n else self.near, s.first_rounds)
        if first < n:
            self.labels = self._moved(self.near, True)
            absent = self.labels >= s.classes
            self.labels[absent] = np.arange(n)[absent] % s.classes
            self.rounds(self.near, s.rounds)


def _scores(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("copies", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        units, n_classes, of, step, emit, log = Units(*m["words"]), m["classes"], m["of"], m["step"], m["emit"], m["log"]
        for batch in batches:
            t, raws = Tokens(batch.column("text")), common.text_bytes(batch.column("text"))
            k, sizes = len(raws), t.sizes
            unit = units.of(t)[t.place]
            doc, starts = np.repeat(np.arange(k), sizes), np.cumsum(sizes + 1) - sizes - 1
            u = np.zeros(len(unit) + k, np.int64)  # every text's units and an end
            u[np.arange(len(unit)) + doc] = unit
            c = of[u]
            before = np.empty_like(c)
            before[1:] = c[:-1]
            before[starts] = of[0]
            score = np.add.reduceat(step[before * n_classes + c] + emit[u], starts) if k else np.zeros(0)
            base = np.add.reduceat(log[u], starts) - (sizes + 1) * m["norm"] if k else np.zeros(0)
            # words without a unit of their own: each text's distinct ones
            rare = np.flatnonzero(unit >= units.shapes)
            pair, f = np.unique(doc[rare].astype(np.int64) * len(t.hashes) + t.place[rare], return_counts=True)
            d, h = pair // max(len(t.hashes), 1), t.hashes[pair % max(len(t.hashes), 1)]
            known = sizes - np.bincount(doc[rare], minlength=k) + m["ends"]
            ids, keys = batch.column("doc_id"), np.array([text_hash(raw) for raw in raws], np.int64)
            none = np.zeros(len(d), np.int64)
            # the first row's key is no word's and spreads the rows; it counts for nothing
            for at in range(0, k + len(d), 50_000):
                x = slice(at, at + 50_000)
                row = np.r_[np.arange(k), d][x]
                both = lambda a, b: pa.array(np.concatenate([a, b])[x])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(keys[row]), both(keys, h), both(np.zeros(k, np.int64), f), both(np.ones(k, np.int64), none), both(sizes + 1, none), both(known, none), both(base, none.astype(float)), both(score, none.astype(float))], schema=schema)

    return common.frugal(run)


def train(training: DataFrame, work: common.Work, s: Settings) -> dict:
    """The model of the texts: arrays by unit (class, logarithms of emission and count), class transitions, the units' words, and the table
    of the rarer words' counts."""
    spark = training.sparkSession
    counts = training.mapInArrow(_word_counts, "h long, n long, shape int").groupBy("h").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))
    counts = work.save(counts, "counts")
    texts = training.count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = size.n + texts, size.v + (texts > 0)
    least = max(s.own, common.rare_below(counts, s.exchanged))
    head = counts.filter(F.col("n") >= least).select("h", "n").toArrow()
    h, k = head["h"].to_numpy(), head["n"].to_numpy()
    order = np.lexsort((h, -k))
    h, k = h[order], k[order]
    by_hash = np.argsort(h)
    words = (h[by_hash], (by_hash + 1).astype(np.int32))
    shapes, n_units = len(h) + 1, len(h) + 1 + SHAPES
    rare = work.save(counts.filter(F.col("n") < least), "rare")

    shared = spark.sparkContext.broadcast(words)
    # a bucket's row is some MB
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    near = near_units(training, shared, n, work)
    try:
        spark.conf.set(key, "8")
        exchange = Exchange(near, n_units, s, work)
        exchange.run()
    finally:
        spark.conf.set(key, usual)
    labels, cells = exchange.labels.astype(np.int64), exchange.cells

    unit_n, unit_v = np.concatenate([[texts], k, np.zeros(SHAPES)]).astype(float), np.zeros(n_units)
    for r in rare.groupBy("shape").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        unit_n[shapes + r["shape"]], unit_v[shapes + r["shape"]] = r.n, r.v
    class_n, members = np.bincount(labels, unit_n, s.classes), np.bincount(labels, minlength=s.classes)
    share = (class_n + 1) / (n + s.classes)
    step = np.log10((cells + s.prior * share[None, :]) / (cells.sum(1, keepdims=True) + s.prior))
    emit = np.log10((unit_n + s.add) / (class_n + s.add * members)[labels])
    emit[shapes:] -= np.log10(unit_n + unit_v + 1)[shapes:]
    log = np.zeros(n_units)
    log[:shapes] = np.log10(unit_n[:shapes] + 1)
    work.drop("counts", "near", "near-first")
    return {"words": words, "classes": s.classes, "of": labels, "step": step.ravel(), "emit": emit, "log": log, "norm": float(np.log10(n + v + 1)), "ends": int(texts > 0), "tokens": n, "rare": rare, "texts": texts}


def score_documents(docs: DataFrame, held_out, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of ``docs`` (doc_id, text;
    other columns are ignored). ``held_out``: a boolean column of doc_id; the model learns from the rows where it is false.

    base_score is the add-one unigram log10 probability, score the model's, of the words and one end. A null text counts as
    empty: one token, the end. Rows that repeat an id or have none give a row each and are learnt from as often. Without training rows
    there is no model, and score is base_score. An empty table gives an empty result. Texts of any length are read whole."""
    s, spark, work = settings or Settings(), docs.sparkSession, common.Work(docs.sparkSession, "brown")
    common.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    model = train(docs.filter(~F.col("held_out")).select("text"), work, s)
    rare, texts = model.pop("rare"), model.pop("texts")
    rows = docs.select("doc_id", "text").mapInArrow(
        _scores(spark.sparkContext.broadcast(model)), "doc_id long, text_hash long, h long, f long, copies long, n_tokens long, n_known long, base double, score double"
    )
    joined = rows.join(rare.select("h", "n").hint("merge"), "h", "left").withColumn("more", F.coalesce(F.col("f") * F.log10(F.col("n") + 1.0), F.lit(0.0)))
    found = joined.groupBy("doc_id", "text_hash").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("n") > 0, F.col("f")).otherwise(0)).alias("n_known"),
        (F.sum("base") + F.sum("more")).alias("base_score"), (F.sum("score") + F.sum("more")).alias("score"),
    )
    # equal rows have added up: each has an equal share
    each = found.select("doc_id", "copies", *(F.expr(f"{x} div copies").alias(x) for x in ("n_tokens", "n_known")), *((F.col(x) / F.col("copies")).alias(x) for x in ("base_score", "score")))
    each = each.withColumn("score", F.col("score") if texts else F.col("base_score")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
