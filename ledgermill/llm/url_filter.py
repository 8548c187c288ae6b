"""URL filters: host and path rules, and for the other urls naive Bayes over segmented names.

Host labels and path parts are concatenated names; the most likely split into words of a unigram model (Viterbi) gives their words. The
multinomial naive Bayes model is learnt from the urls that rules judge. Every word and token counts, however many there are: the frequent ones are broadcast, and the
others reach their urls by joins. For these a bitmap of fixed size (bits of their hashes) tells which substrings of a url's names, and which of its tokens, are worth a join; what it lets
through wrongly is found by none. A key that many urls have is broadcast with its value.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The frequent words of the unigram model and tokens of the Bayes model that are broadcast; the others are joined.
WORDS, TOKENS = 50_000, 65_536
#: Bits of the bitmaps, a power of two; and rows from which on a joined key is broadcast.
BITS, LARGE = 1 << 26, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Bitmap:
    """Whether a text may be among the keys."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tobytes()
        self.mask = 8 * len(bits) - 1

    def __contains__(self, text: str) -> bool:
        i = zlib.crc32(text.encode()) & self.mask
        return self.bits[i >> 3] >> (i & 7) & 1 == 1


def bitmap(keys: DataFrame, key: str) -> Bitmap:
    """Of a table's keys: its parts are built in Spark, and as many bytes as it has bits / 8 come to the driver at most."""
    size = 1 << 15
    i = F.crc32(F.col(key).cast("binary")) % BITS
    found = keys.groupBy(F.floor(i / size).alias("part")).agg(F.bitmap_construct_agg(i % size).alias("bits")).collect()
    bits = np.zeros(BITS // 8, np.uint8)
    for r in found:
        part = np.frombuffer(r.bits, np.uint8)
        bits[r.part * (size // 8) : r.part * (size // 8) + len(part)] = part
    return Bitmap(bits)


class Segmenter:
    """Splits a name into its most likely words; a part that is no word costs more the longer it is. ``counts``: the frequent words; ``total``: of all words, and one; ``lengths``: that words have; ``more``:
    the other words."""

    def __init__(self, counts: dict[str, int], total: int | None = None, lengths: list[int] | None = None, more: Bitmap | None = None):
        self.total = total or sum(counts.values()) + 1
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.lengths, self.more = sorted(lengths or set(map(len, counts))), more
        self.split = lru_cache(maxsize=50_000)(self._split)
        self.candidates = lru_cache(maxsize=50_000)(self._candidates)

    def _candidates(self, name: str) -> tuple[str, ...]:
        """Substrings that may be words of the others."""
        if self.more is None:
            return ()
        found = (name[i : i + k] for k in self.lengths if k <= len(name) for i in range(len(name) - k + 1))
        return tuple({w for w in found if w not in self.log and w in self.more})

    def _split(self, name: str, others: tuple[tuple[str, int], ...] = ()) -> tuple[str, ...]:
        log, own = self.log, {w: math.log(n / self.total) for w, n in others}
        best, start = [0.0], [0]
        # a part that is no word: what it costs beyond its end depends on its start alone, so the best start is carried along
        none, from_ = 0.0, 0
        for end in range(1, len(name) + 1):
            found, at = none - math.log(self.total) - 3.0 * end, from_
            for k in self.lengths:
                if k > end:
                    break
                word = name[end - k : end]
                p = log.get(word)
                if p is None and own:
                    p = own.get(word)
                if p is not None and best[end - k] + p >= found:
                    found, at = best[end - k] + p, end - k
            best.append(found)
            start.append(at)
            if found + 3.0 * end > none:
                none, from_ = found + 3.0 * end, end
        out, end = [], len(name)
        while end:
            out.append(name[start[end] : end])
            end = start[end]
        return tuple(reversed(out))

    @staticmethod
    def names(host: str, path: str) -> Iterator[tuple[str, str]]:
        """Runs of letters or of digits, marked by where they stand."""
        for mark, text in (("h:", host), ("p:", path.translate(str.maketrans(UPPER, LOWER)))):
            for part in re.findall(r"[^\W\d_]+|\d+", text):
                yield mark, part

    def asked(self, host: str, path: str) -> list[str]:
        return sorted({w for _, part in self.names(host, path) if not part.isdigit() for w in self.candidates(part)})

    def tokens(self, host: str, path: str, others: dict[str, int] | None = None) -> list[str]:
        """Words of the host's and of the path's names; digits count by their number. ``others``: the rarer words in them."""
        out = []
        for mark, part in self.names(host, path):
            if part.isdigit():
                out.append(f"{mark}#{min(len(part), 9)}")
                continue
            own = tuple((w, others[w]) for w in self.candidates(part) if w in others) if others else ()
            out += [mark + w for w in (self._split(part, own) if own else self.split(part))]
        return out


def parts(url):
    """Host (A-Z lowered) and path of a url column; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit("")).alias("path")


def by_rule(rules: list[tuple[str, str]]):
    """The longest fitting rule (its text, else null) and its verdict. ``rules``: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule.alias("rule"), verdict.alias("judged")


def _asked(model):
    """row and word of every candidate that isn't among the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter(*model.value)
        for batch in common.slices(batches, 2000):
            found = [cut.asked(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            rows = np.repeat(batch.column("row").to_numpy(), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([w for x in found for w in x], pa.string())], ["row", "word"])

    return run


def _tokens(model):
    """row, judged and tokens of every url; ``others`` are its rarer words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Segmenter(*model.value)
        for batch in common.slices(batches, 2000):
            columns = (batch.column(c).to_pylist() for c in ("host", "path", "others"))
            found = [cut.tokens(h, p, {o["word"]: o["n"] for o in others or ()}) for h, p, others in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("judged"), pa.array(found, pa.list_(pa.string()))], ["row", "judged", "tokens"])

    return run


def _scores(model):
    """row, score (of the frequent tokens and of those that no judged url has) and the other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, other, prior, more = model.value
        for batch in common.slices(batches, 2000):
            score, rest = [], []
            for tokens in batch.column("tokens").to_pylist():
                rare = [t for t in tokens if t not in log and t in more]
                # a rare token is added as one that no url has, and the join adds the difference
                score.append(prior + sum(log.get(t, other) for t in tokens))
                rest.append(rare)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score, pa.float64()), pa.array(rest, pa.list_(pa.string()))], ["row", "base", "rest"])

    return run


def _found(asked: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``asked`` (a written table) with the values of its key in ``table``, without keys that it lacks; keys that very many rows ask for are broadcast."""
    known = asked.groupBy(key).agg(F.count("*").alias("k")).join(table, key)
    return common.with_groups(asked, known, key, LARGE).filter("k is not null").drop("k")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages`` (page_id, url, html; other columns are ignored).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest one wins. ``score`` is the log odds of
    block in the Bayes model, learnt from the urls that rules judge, with words of the pages' text as the unigram model; where no rule fits,
    block if it is over 0 (allow on a tie, and where rules judge nothing). A null url, or one without ``://``, has an empty host and path;
    rows that repeat an id give a row each; an empty table gives an empty result; null html has no words. Urls and names of any length are read whole."""
    spark = pages.sparkSession
    work = common.Work(spark, "urls")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    text = F.lower(F.regexp_replace("html", r"(?is)<(script|style).*?</\1>|<[^>]*>", " "))
    counts = work.save(pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")), "words")
    least = common.rare_below(counts, WORDS)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)) + 1).first()[0]
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect())  # as many as the longest word has letters, at most
    rare = counts.filter(F.col("n") < least)
    words = spark.sparkContext.broadcast(({r.word: r.n for r in counts.filter(F.col("n") >= least).collect()}, total, lengths, bitmap(rare, "word")))

    rows = pages.select("page_id", *parts("url")).select("*", *by_rule(rules)).withColumn("row", F.monotonically_increasing_id())
    rows = work.save(rows, "rows")
    asked = work.save(rows.select("row", "host", "path").mapInArrow(_asked(words), "row long, word string"), "asked")
    others = _found(asked, rare, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("others"))
    # small rows that take long: as many parts as shuffles have, none joined
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.select("row", "host", "path", "judged").repartition(n_parts, "row").join(others.repartition(n_parts, "row").hint("merge"), "row", "left")
    named = work.save(named.mapInArrow(_tokens(words), "row long, judged string, tokens array<string>"), "named")

    seen = named.filter("judged is not null")
    tokens = seen.select("judged", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.sum((F.col("judged") == "block").cast("long")).alias("block"))
    tokens = work.save(tokens, "tokens")
    n = {"allow": 0, "block": 0} | {r.judged: r["count"] for r in seen.groupBy("judged").count().collect()}
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.count("*").alias("v")).first()
    block, allow, v = total.block, total.n - total.block, total.v + 1
    odds = lambda b, a: math.log((b + 1) / (block + v)) - math.log((a + 1) / (allow + v))
    least = common.rare_below(tokens, TOKENS)
    log = {r.token: odds(r.block, r.n - r.block) for r in tokens.filter(F.col("n") >= least).collect()}
    other = odds(0, 0) if n["allow"] + n["block"] else 0.0
    rare = tokens.filter(F.col("n") < least)
    model = spark.sparkContext.broadcast((log, other, math.log((n["block"] + 1) / (n["allow"] + 1)), bitmap(rare, "token")))
    scored = work.save(named.select("row", "tokens").mapInArrow(_scores(model), "row long, base double, rest array<string>"), "scored")
    asked = work.save(scored.select("row", F.explode("rest").alias("token")), "asked-tokens")
    gain = F.log((F.col("block") + 1) / F.lit(float(block + v))) - F.log((F.col("n") - F.col("block") + 1) / F.lit(float(allow + v))) - F.lit(other)
    more = _found(asked, rare.select("token", gain.alias("gain")), "token").groupBy("row").agg(F.sum("gain").alias("more"))
    found = rows.join(scored.select("row", "base").hint("merge"), "row").join(more.hint("merge"), "row", "left").withColumn("score", F.col("base") + F.coalesce("more", F.lit(0.0)))
    result = found.select("page_id", "host", "path", "rule", F.coalesce("judged", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
    result = work.save(result, "result")
    work.drop_all_but("result")
    return result
