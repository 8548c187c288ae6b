"""N-gram Jaccard join by vertical partitioning, to connected components.

The global order of n-grams is that of a 64-bit hash. It is cut into fragments twice.

*Candidates.* Sets of sizes a and b with Jaccard similarity of at least t differ in at most (1-t)/(1+t) * (a+b) n-grams. Cut
into more fragments than that (as many as the sizes' class asks for), two such sets have equal segments in some fragment, and in
no fewer than the surplus. So equal segments, not shared n-grams, make candidates: a passage or frequent phrase that many
documents share makes hardly any. Documents with too few segments in common with anyone are dropped, which loses no pair.

*Overlaps.* The sets of the remaining documents are cut into a few fragments, each pair's partial overlaps are counted
fragment by fragment, joined on (document, fragment), and summed per pair.

*Groups.* Links are wanted as components, so a group of documents with an equal segment is first joined as a star around its hub,
the member with the fewest n-grams of its own. Let D(x) be the n-grams in which x and the hub differ. Two members x and y differ in
|D(x)| + |D(y)| - 2 * |D(x) and D(y)| n-grams, and at least one of two members in different components differs from the hub in more than
a link allows. So the two must share n-grams of D, and with them one of the rarest few (prefix filter): the n-grams shared there make the
next, smaller groups, and so on. Edits of a document's own make no pair, so groups of near copies that don't link end without one.
When the pairs left are fewer than the rows that make them, they are compared outright. Equal texts are one node throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Fragments in which overlaps are counted.
FRAGMENTS = 3
#: Members of a group from which on it is dealt over several tasks.
LARGE = 1000
#: Rounds of stars, at most, before the pairs left are compared outright.
ROUNDS = 8
#: One in so many groups tells how many pairs are left, if no group has more pairs than ``WORST``.
SOME, WORST = 16, 1e7
_U = np.uint64
_SIGNATURES = "sig long, node long, n long, need0 int, need1 int"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def shingles(raw: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; of the whole word sequence, if it has fewer words."""
    words = raw.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    width = min(size, len(h))
    if not width:
        return h
    x = np.full(len(h) - width + 1, width, _U)
    for i in range(width):
        x = _mixed(x + h[i : len(h) - width + 1 + i])
    return np.unique(x)


class Ladder:
    """Classes of set sizes, such that sets that can link are in the same or in neighbouring ones."""

    def __init__(self, percent: int):
        low, self.high = 1, []
        while low < 1 << 40:
            self.high.append(low * 100 // percent)
            low = self.high[-1] + 1
        both = [a + b for a, b in zip(self.high, self.high[1:], strict=False)]
        #: By class j, for sets of the classes j and j + 1: the most n-grams in which they differ, and the fragments.
        self.differ = [x * (100 - percent) // (100 + percent) for x in both]
        self.fragments = [k + 1 + k // 8 for k in self.differ]

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.high, n))


def signatures(s: np.ndarray, ladder: Ladder) -> tuple[list[np.ndarray], list[int]]:
    """Hashes of a set's segments, by the parity of the class in which they are compared (also their lowest bit), and how many of
    them a linked set must have too."""
    out, need = [np.zeros(0, _U), np.zeros(0, _U)], [1 << 30, 1 << 30]
    sums = np.concatenate(([_U(0)], np.cumsum(_mixed(s), dtype=_U)))
    own = ladder.of(len(s))
    for j in (own - 1, own):
        if j < 0:
            continue
        m, k = ladder.fragments[j], ladder.differ[j]
        cut = np.searchsorted(((s >> _U(32)) * _U(m)) >> _U(32), np.arange(m + 1, dtype=_U))
        full = cut[1:] > cut[:-1]
        x = _mixed(sums[cut[1:]] - sums[cut[:-1]] + _U((j + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.arange(m, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))
        must = m - k - int((~full).sum())
        # only if all equal segments may be empty ones, empty ones are given; a set that gives none shares a full one with all it links with
        out[j & 1], need[j & 1] = ((x[full] if must >= 1 else x) & ~_U(1)) | _U(j & 1), max(1, must)
    return out, need


def _signature_rows(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ladder = WordHashes(), Ladder(percent)
        for batch in common.slices(batches, 250):
            sigs, nodes, one = [], [], []
            for node, raw in zip(batch.column("doc_id").to_pylist(), common.text_bytes(batch.column("text")), strict=True):
                s = shingles(raw, size, hashes)
                need = [None, None]
                if len(s):
                    both, need = signatures(s, ladder)
                    for x in both:
                        sigs.append(x.view(np.int64))
                        nodes.append(np.full(len(x), node, np.int64))
                one.append((node, len(s), *need))
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sigs, nodes))
            none = lambda t, k: pa.nulls(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(pa.int64(), len(a)), none(pa.int32(), len(a)), none(pa.int32(), len(a))], ["sig", "node", "n", "need0", "need1"])
            node, n, need0, need1 = zip(*one, strict=True) if one else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([none(pa.int64(), len(node)), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(need0, pa.int32()), pa.array(need1, pa.int32())], ["sig", "node", "n", "need0", "need1"])

    return common.frugal(run)


def _segment_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in common.slices(batches, 250):
            rows = []
            for node, raw in zip(batch.column("doc_id").to_pylist(), common.text_bytes(batch.column("text")), strict=True):
                s = shingles(raw, size, hashes)
                cut = np.searchsorted(((s >> _U(32)) * _U(FRAGMENTS)) >> _U(32), np.arange(FRAGMENTS + 1, dtype=_U))
                rows += [(node, f, s[cut[f] : cut[f + 1]].view(np.int64)) for f in range(FRAGMENTS)]
            node, f, grams = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(f, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], ["node", "fragment", "grams"])

    return common.frugal(run)


def components(work: common.Work, edges: DataFrame, name: str) -> DataFrame:
    """node, component (its smallest node) for the nodes of the edges (a, b): least labels pass along edges and are then
    looked up through each other, so that chains shorten by half; every round is a written table."""
    both = work.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = work.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    for i in itertools.count(1):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "near").alias("new"), "component")
        up = labels.select(F.col("node").alias("new"), F.col("component").alias("up"))
        new = work.save(new.join(up, "new").select("node", F.least("new", "up").alias("component"), (F.least("new", "up") < F.col("component")).alias("changed")), f"{name}-{i}")
        changed = new.filter("changed").limit(1).count()
        if i > 1:
            work.drop(f"{name}-{i - 1}")
        labels = new.select("node", "component")
        if not changed:
            return labels


class Links:
    """Candidates' n-grams, and the components of the links found so far."""

    def __init__(self, work: common.Work, sets: DataFrame, percent: int):
        self.work, self.sets, self.percent, self.labels, self.n = work, sets, percent, None, 0

    def pairs(self, pairs: DataFrame, columns: list[str], joined) -> DataFrame:
        """``columns`` of the pairs (a, b, salt) and ``joined`` of both sides' n-grams (ga, gb), fragment by fragment. The b side's n-grams come
        first; a is a key that many pairs may have, so its n-grams are copied for each of its salts."""
        copies = pairs.groupBy("a").agg(F.max("salt").alias("most"))
        left = self.sets.select(F.col("node").alias("a"), F.col("fragment").alias("f"), F.col("grams").alias("ga")).join(copies, "a")
        left = left.withColumn("salt", F.explode(F.expr("sequence(0, most)"))).drop("most")
        right = pairs.join(self.sets.select(F.col("node").alias("b"), F.col("fragment").alias("f"), F.col("grams").alias("gb")), "b")
        return right.join(left, ["a", "salt", "f"]).select(*columns, joined)

    def add(self, pairs: DataFrame) -> None:
        """Those of the pairs (a, b, na, nb, salt) that link are added: partial overlaps by fragment, summed per pair."""
        self.n += 1
        part = self.pairs(pairs, ["a", "b", "na", "nb"], F.size(F.array_intersect("ga", "gb")).alias("part"))
        total = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
        links = total.filter(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * self.percent).select("a", "b")
        links = self.work.save(links if self.labels is None else links.union(self.labels.select("component", "node")), f"links{self.n}")
        self.labels = components(self.work, links, f"components{self.n}")


def join_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    A document's set holds its distinct word n-grams (A-Z lowered, words between ASCII white space); one with fewer words than ``size``
    has its whole sequence as one, one without words or text an empty set, linked with nothing. Two link when 100 * intersection >=
    percent * union. component_id is the smallest doc_id reachable by links, its own included. Ids are taken as unique: where rows
    repeat an id with different texts, the text of the smallest hash counts for all of them; rows with a null id get nulls and link with
    nothing; equal rows repeat in the result; an empty table gives an empty result. No candidate is capped."""
    if not 50 < percent <= 100:
        raise ValueError("percent is over 50 and up to 100")
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Work(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    base = work.save(rows.select("doc_id", "h"), "base")
    chosen = work.save(base.filter("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("h"), F.count("*").alias("rows")), "chosen")
    copies = work.save(chosen.groupBy("h").agg(F.min("doc_id").alias("node"), F.count("*").alias("k")).filter("k > 1"), "copies")
    members = common.with_groups(chosen, copies, "h", LARGE).select("doc_id", "h", F.coalesce("node", "doc_id").alias("node"), "rows")
    members = work.save(members, "members")
    left_out = base.join(members.filter("doc_id = node").select("doc_id", "h"), ["doc_id", "h"], "left_anti").filter("doc_id is not null").distinct()
    facts = members.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    texts = common.with_ids(rows.filter("doc_id is not null"), left_out, ["doc_id", "h"], "left_anti", left_out.count())

    found = work.save(texts.select("doc_id", "text").mapInArrow(_signature_rows(size, percent), _SIGNATURES), "signatures")
    sizes = work.save(found.filter("sig is null").select("node", "n", "need0", "need1").distinct(), "sizes")
    # rows that repeat a text repeat its segments
    segments = found.filter("sig is not null").select("sig", "node")
    segments = segments.distinct() if facts.most > 1 else segments
    groups = work.save(_shared(segments, work), "groups")
    work.drop("signatures", "chosen", "copies")
    needs = sizes.select("node", "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("need0").alias("need")), F.struct(F.lit(1).alias("side"), F.col("need1").alias("need")))).alias("x")).select("node", "n", "x.*")
    side = F.col("sig").bitwiseAND(F.lit(1)).cast("int").alias("side")
    enough = groups.groupBy("node", side).agg(F.count("*").alias("k")).join(needs, ["node", "side"]).filter("k >= need").select("node", "side", "n")
    groups = work.save(groups.select("sig", "node", side).join(enough, ["node", "side"]).select("sig", "node", "n"), "enough")
    work.drop("groups")
    cand = work.save(groups.select(F.col("node").alias("doc_id")).distinct().join(members.select("doc_id", "h"), "doc_id"), "nodes")
    sets = common.with_ids(rows, cand, ["doc_id", "h"], "left_semi", cand.count()).select("doc_id", "text").mapInArrow(_segment_rows(size), "node long, fragment int, grams array<long>")
    sets = work.save(sets.dropDuplicates(["node", "fragment"]) if facts.most > 1 else sets, "sets")
    grams = sets.select("node", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    own = grams.filter("node = other").groupBy("node").agg(F.count("*").alias("own"))
    groups = groups.join(own, "node", "left").select("sig", "node", "n", F.coalesce("own", F.lit(0)).alias("own")).filter((F.col("n") - F.col("own")) * 100 >= F.col("n") * percent)
    groups = work.save(groups, "groups0")

    links = Links(work, sets, percent)
    for round_ in range(ROUNDS):
        groups = _star_round(groups, links, round_)
        if groups is None:
            break
    else:
        _compare(groups, links)
    labels = links.labels
    top = members.select("doc_id", "node").join(sizes.select("node", "n"), "node", "left").join(labels, "node", "left")
    top = top.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node")).alias("component_id"))
    result = work.save(base.select("doc_id").join(top, "doc_id", "left"), "result")
    work.drop_all_but("result")
    return result


def _shared(segments: DataFrame, work: common.Work) -> DataFrame:
    """Segments (sig, node) that several nodes have. Those that many have, found in a sample of the nodes, are known to be shared and
    aren't shuffled at all; the sample decides about the way only."""
    often = segments.filter(F.pmod(F.xxhash64("node"), F.lit(64)) == 0).groupBy("sig").agg(F.count("*").alias("k")).filter(F.col("k") >= LARGE // 64)
    often = work.save(often.orderBy(F.desc("k"), "sig").limit(common.MAX_BROADCAST_IDS // 2).select("sig"), "often")
    counted = segments.join(F.broadcast(often), "sig", "left_anti").withColumn("k", F.count("*").over(Window.partitionBy("sig")))
    return counted.filter("k > 1").select("sig", "node").union(segments.join(F.broadcast(often), "sig", "left_semi").select("sig", "node"))


def _can_link(percent: int, n: str, own: str, m: str, other: str) -> Column:
    """By the sizes of two sets and the n-grams that only they have."""
    most = F.least(F.col(n) - F.col(own), F.col(m) - F.col(other))
    return most * 100 >= (F.col(n) + F.col(m) - most) * percent


def _star_round(groups: DataFrame, links: Links, round_: int) -> DataFrame | None:
    """Joins every group (sig; node, n, own) with its hub, and gives the groups in which pairs that can link are left, if any."""
    work, p = links.work, links.percent
    name = lambda x: f"{x}{round_}"
    hub = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "own"))
    hubs = work.save(groups.groupBy("sig").agg(hub.alias("hub"), F.count("*").alias("k")).filter("k > 1"), name("hubs"))
    stars = common.with_groups(groups, hubs, "sig", LARGE).filter("node <> hub.node")
    stars = stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"), F.col("hub.own").alias("oa"), F.col("own").alias("ob"), (F.col("k") / LARGE).cast("int").alias("parts"))
    stars = stars.groupBy("a", "b", "na", "nb", "oa", "ob").agg(F.max("parts").alias("parts")).withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts") + 1).cast("int")).drop("parts")
    stars = work.save(stars, name("stars"))
    links.add(stars.filter(_can_link(p, "na", "oa", "nb", "ob")))

    # hubs whose members are in different components
    named = work.save(stars.join(links.labels.withColumnRenamed("node", "b"), "b", "left").withColumn("c", F.coalesce("component", "b")).drop("component"), name("named"))
    mixed = work.save(named.groupBy("a").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("a", "k"), name("mixed"))
    open_ = common.with_groups(named, mixed, "a", LARGE).filter("k is not null").drop("k")
    # an n-gram of D(b) by the hash of the hub and it
    differ = F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga")).alias("d")
    d = work.save(links.pairs(open_, ["a", "b", "na", "nb", "ob", "c"], differ), name("differ"))
    size = d.groupBy("a", "b", "na", "nb", "ob", "c").agg(F.sum(F.size("d")).alias("d"))
    keys = work.save(d.select("a", "b", F.explode("d").alias("gram")).select("a", "b", F.xxhash64("a", "gram").alias("sig")), name("keys"))
    often = work.save(keys.groupBy("sig").agg(F.count("*").alias("k")).filter("k > 1"), name("often"))
    shared = common.with_groups(keys, often, "sig", LARGE).filter("k is not null")
    shared = shared.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("k", "sig"))).alias("shared"))
    both = shared.join(size, ["a", "b"])
    # n-grams in which two linked sets may differ at most, for the hub and b, and for b and the largest that can link with it
    limit = lambda n, m: F.floor((n + m) * (100 - p) / (100 + p))
    most = limit(F.col("nb"), F.floor(F.col("nb") * 100 / p))
    linked = F.col("d") <= limit(F.col("na"), F.col("nb"))
    # the least that D(b) shares with that of a link in another component: if b is one of a link's two with the smaller D, with the larger
    half = F.ceil((F.col("d") + 1 - F.ceil(F.greatest(F.col("nb") - F.col("na"), F.lit(0)) * (100 - p) / (100 + p))) / 2)
    small = F.greatest(F.lit(1), F.col("d") - F.floor(most / 2), F.when(linked, half).otherwise(1))
    large = F.greatest(F.lit(1), F.when(linked, half).otherwise(F.col("d") - most))
    # n-grams that no other member has come first in the order
    rest = lambda least: F.col("d") - least + 1 - (F.col("d") - F.size("shared"))
    both = both.withColumn("short", rest(small)).withColumn("long", F.greatest(rest(large), rest(small))).filter("long > 0")
    taken = both.select("b", "nb", "ob", "c", "d", "short", F.posexplode(F.slice("shared", F.lit(1), F.col("long").cast("int"))).alias("i", "x"))
    taken = taken.select(F.col("x.sig").alias("sig"), F.col("b").alias("node"), F.col("nb").alias("n"), F.col("ob").alias("own"), "c", "d", (F.col("i") < F.col("short")).alias("small"))
    taken = work.save(taken, name("taken"))
    useful = taken.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("k"), F.sum(F.col("small").cast("long")).alias("small")).filter("lo < hi and small > 0")
    useful = work.save(useful.select("sig", "k", (F.col("small") * F.col("k")).cast("double").alias("pairs")), name("useful"))
    sums = useful.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("rows"), F.coalesce(F.max("pairs"), F.lit(0.0)).alias("worst")).first()
    work.drop(*map(name, ("groups", "hubs", "stars", "named", "mixed", "differ", "keys", "often")))
    if not sums.rows:
        return None
    left = common.with_groups(taken, useful, "sig", LARGE).filter("k is not null").select("sig", "node", "n", "own", "c", "d", "small")
    left = work.save(left, f"groups{round_ + 1}")
    if sums.worst <= WORST:
        # how many pairs there are is told by a part of the groups; it decides about the way only
        some = left.filter(F.pmod(F.xxhash64("sig"), F.lit(SOME)) == 0)
        if _left_pairs(some, p).count() * SOME <= 4 * sums.rows:
            _compare(left, links)
            return None
    return left


def _left_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of the groups (sig; node, n, own, component c, and the size d of the difference from the hub) that can link and don't yet, once for each group."""
    x = groups.filter("small").select("sig", *(F.col(c).alias(f"x{c}") for c in ("node", "n", "own", "c", "d")))
    y = groups.select("sig", *(F.col(c).alias(f"y{c}") for c in ("node", "n", "own", "c", "d")))
    return x.join(y, "sig").filter("xc <> yc and struct(xd, xnode) < struct(yd, ynode)").filter(_can_link(percent, "xn", "xown", "yn", "yown"))


def _compare(groups: DataFrame, links: Links) -> None:
    """The overlaps of all pairs that are left."""
    pairs = _left_pairs(groups, links.percent)
    pairs = pairs.select(F.col("xnode").alias("a"), F.col("ynode").alias("b"), F.col("xn").alias("na"), F.col("yn").alias("nb"), F.lit(0).alias("salt")).distinct()
    links.add(links.work.save(pairs, "pairs"))
