"""Source mixing, importance resampling and vocabulary alignment against plain computation."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import alignment, mixing, resampling
from ledgermill.llm.alignment import Alignment, align_documents
from ledgermill.llm.mixing import mix_documents, mixture
from ledgermill.llm.resampling import resample

SCHEMA = "doc_id long, text string, source string, size long, s string, rank long, n_a string, k string"
WORDS = "the a of stone river bright cloud seven green house walk open märz ünder data table row".split()


def rows():
    rng = random.Random(11)
    found = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["b", "b", "b", "a", "é", "", None])) for i in range(300)]
    found += [(400, None, "a"), (401, "", "only empty"), (402, " \t\n\x0b ", None), (403, "one\xa0word\x85x", "a"), (404, "x" * 30_000, "long"), (405, "w " * 30_000, "b")]
    found += [(7, found[7][1], found[7][2])] * 3 + [(None, "without id \n\n  here", "b"), (None, None, None), (406, "it's <|endoftext|> a▁b  TEST\r\n\r\n 12 ｗｉｄｅ 😀!", "a"), (407, " " * 25_000 + "z", "a"), (408, "A1 b-2 Ünd ÄÖ", "b")]
    return found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "s", 2, "x", "y") for r in rows()], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mix_targets_and_limits(spark, docs, none):
    got = mix_documents(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t, _ in rows())
    sizes = Counter()
    for _, t, source in rows():
        sizes[source] += size(t)
    names = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None]
    weights = {x: (5, 2, 1)[i % 3] for i, x in enumerate(names)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        each = (total - sum(target.values())) / sum(weights[x] for x in left)
        if not (full := {x for x in left if weights[x] * each > 2 * sizes[x]}):
            break
        target |= {x: 2.0 * sizes[x] for x in full}
        left -= full
    target |= {x: weights[x] * each for x in left}
    taken = Counter()
    source_of = {(i, size(t)): s for i, t, s in rows()}
    for r in got:
        source = source_of[r.doc_id, r["size"]]
        assert r.source_size == sizes[source] and r.target == pytest.approx(target[source], rel=1e-12)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert {x: taken[x] for x in names} == {x: math.floor(target[x]) for x in names}
    assert Counter(mix_documents(docs.repartition(2)).collect()) == Counter(got)
    assert mix_documents(none).count() == 0 and mixture(none).count() == 0


def test_mix_pieces_and_evenness(docs):
    settings = mixing.Settings(weights=(3, 1), share=1.0, block=16)
    parts = mixture(docs, settings).orderBy("slot", "offset").collect()
    taken = {}
    for r in mix_documents(docs, settings).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    summed = Counter()
    for p in parts:
        summed[p.doc_id] += p.length
        assert p.length > 0 and p.start >= 0
    assert dict(summed) == {k: v for k, v in taken.items() if v}
    # what a slot takes lies in a row from the block's start
    ends = {}
    for p in parts:
        assert p.offset == ends.get(p.slot, 0)
        ends[p.slot] = p.offset + p.length
    assert max(ends.values()) <= 16
    # every stretch of the schedule holds a source by its weight
    order = {p.slot: p.source for p in parts}
    slots = [order[k] for k in sorted(order)]
    share = Counter(slots)["b"] / len(slots)
    for at in range(0, len(slots) - 200, 200):
        assert Counter(slots[at : at + 200])["b"] / 200 == pytest.approx(share, abs=0.04)


def test_mix_of_many_sources(spark):
    """More sources than are broadcast, and more than a step of sums."""
    table = spark.createDataFrame([(i, "w " * (i % 40 + 1), f"s{i % 2500}") for i in range(5000)], "doc_id long, text string, source string")
    small = Counter(mix_documents(table).collect())
    most, mixing.MOST = mixing.MOST, 10
    try:
        assert Counter(mix_documents(table).collect()) == small
    finally:
        mixing.MOST = most
    sums = defaultdict(set)
    total = Counter()
    for r in small.elements():
        source = f"s{r.doc_id % 2500}"
        sums[source].add(r.target)
        total[source] += r.taken
    assert all(len(v) == 1 and total[k] == math.floor(next(iter(v))) for k, v in sums.items())


def test_before(spark):
    sums = spark.createDataFrame([(k, i, i % 7 + k) for k in range(2) for i in range(3000) if i % 5], "key long, at long, n long")
    got = {(r.key, r.at): r.sum for r in mixing.before(sums, ["key"], "at", "n", "sum").collect()}
    for k in range(2):
        total = 0
        for i in (i for i in range(3000) if i % 5):
            assert got[k, i] == total
            total += i % 7 + k


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [" ".join(found[i : i + n]).encode() for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


@pytest.mark.parametrize("settings", [resampling.Settings(), resampling.Settings(longest=3, buckets=50, least=1, percent=60, seed="x")])
def test_resampling(spark, docs, settings):
    aims = ["bright cloud seven green", None, "", "Stone river ünder 12"]
    target = spark.createDataFrame([(i, t, "z") for i, t in enumerate(aims)], "item_id long, text string, doc_id string")
    part, resampling.PART = resampling.PART, 50
    found = {i: runs(t, settings.longest) for i, (_, t, _) in enumerate(rows())}
    s = Counter(zlib.crc32(x) % settings.buckets for _, f in found.values() for x in f)
    t = Counter(zlib.crc32(x) % settings.buckets for a in aims for x in runs(a, settings.longest)[1])
    k = settings.buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + k) / ((s[b] + 1) * (t.total() + k)))) for b in range(k)]
    want, able = [], []
    for i, (doc_id, _, _) in enumerate(rows()):
        n, f = found[i]
        weight = sum(gain[zlib.crc32(x) % k] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256((settings.seed if doc_id is None else f"{settings.seed}:{doc_id}").encode()).hexdigest()[:8], 16)
        want.append([doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= settings.least:
            able.append(want[-1])
    able.sort(key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for i, r in enumerate(able[: settings.percent * len(able) // 100]):
        r[5] = i + 1
    try:
        got = resample(docs, target, settings).collect()
    finally:
        resampling.PART = part
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_resampling_parts_and_empty_tables(spark, docs, none):
    assert resample(none, docs).count() == 0
    assert all(r.n_words >= 0 for r in resample(docs, none).collect())
    raw = b"Alpha beta, GAMMA-delta 12x " * 100
    whole = resampling.feature_buckets(raw, 2, 1000)
    part, resampling.PART = resampling.PART, 64
    try:
        assert resampling.feature_buckets(raw, 2, 1000) == whole and whole[0] == 500
    finally:
        resampling.PART = part


PATHS = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")]


def plain_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    one.encode_special_tokens = True
    letters = alignment.byte_of_letter()
    raw = {i: bytes(letters[c] for c in w) for w, i in json.load(open(PATHS[0], encoding="utf-8"))["model"]["vocab"].items() if w != "<|endoftext|>"}
    out, links = [], []
    for text in texts:
        out.append([0] * 6 + [""])
        links.append(Counter())
        if not text:
            continue
        sides = []
        for ids, of in ((one.encode(" " + text, add_special_tokens=False).ids, raw.get), (other.encode(text), lambda i: bytes([int(p[3:5], 16)]) if (p := other.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode())):
            at, side = 0, []
            for i in ids:
                side.append((at, at := at + len(of(i)), i))
            sides.append((side, b"".join(map(of, ids))))
        if any(x != (" " + text).encode() for _, x in sides):
            continue
        (a, _), (b, _) = sides
        at = 0
        for start, end, i in a:
            while b[at][1] <= start:
                at += 1
            j = at
            while j < len(b) and b[j][0] < end:
                links[-1][i, b[j][2]] += 1
                j += 1
        ends, groups = sorted({x[1] for x in a} & {x[1] for x in b}), []
        start = 0
        place = [0, 0]
        for end in ends:
            names = []
            for k, side in enumerate((a, b)):
                n = place[k]
                while n < len(side) and side[n][1] <= end:
                    n += 1
                names.append(",".join(str(x[2]) for x in side[place[k] : n]))
                place[k] = n
            groups.append("|".join(names))
            start = end
        assert start == len((" " + text).encode())
        out[-1] = [len(a), len(b), len(groups), links[-1].total(), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest()]
    counts, best = Counter(k for x in links for k in x), Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    for row, x in zip(out, links, strict=True):
        row[4:6] = [sum(n for k, n in x.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in x.items())]
    return out, counts, best


@pytest.mark.parametrize("small", [False, True])
def test_alignment(docs, small, monkeypatch):
    settings = alignment.Settings()
    if small:  # batches, stripes and salts of a few rows
        settings = alignment.Settings(stripes=7, links=300)
        for name, n in (("DOCS", 9), ("PAIRS", 400), ("HELD", 100)):
            monkeypatch.setattr(alignment, name, n)
    want, counts, best = plain_alignment([t for _, t, _ in rows()])
    got = align_documents(docs, *PATHS, settings).collect()
    assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _, _), w in zip(rows(), want, strict=True))
    assert any(w[0] for w in want) and any(t and not w[0] for (_, t, _), w in zip(rows(), want, strict=True))
    if small:
        pairs = Alignment(docs, *PATHS, settings).pairs().collect()
        assert {(r.a, r.b): (r.documents, r.best) for r in pairs} == {k: (n, n == best[k[0]]) for k, n in counts.items()} and len(pairs) == len(counts)


def test_alignment_encoder_and_empty_table(none):
    assert align_documents(none, *PATHS).count() == 0
    fast = alignment.ByteLevel(PATHS[0])
    assert fast.fast is not None
    texts = [t for _, t, _ in rows() if t] + ["a" * 50_000, " \n" * 30_000, "don't <|endoftext|>　x\x00y"]
    assert fast(texts) == [e.ids for e in fast.library.encode_batch(texts, add_special_tokens=False)]
    assert alignment.unpacked(alignment.packed(np.array([1, 70_000]))).tolist() == [1, 70_000]


def test_words_of_many_texts():
    """Words, hashes and shapes that are told for distinct words at once, against each word by itself."""
    import pyarrow as pa

    from ledgermill.llm.brown_lm import Tokens

    rng, letters = random.Random(3), list("ab \t\n\x0b\x0c\r\x1c\xa0É　Z9.")
    for it in range(200):
        texts = [rng.choice([None, "", "x" * rng.randrange(700)]) if rng.random() < 0.3 else "".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(12))]
        at = rng.randrange(len(texts) + 1)
        got = Tokens(pa.array(texts, pa.string() if it % 2 else pa.large_string()).slice(at))
        words = [(t or "").encode().lower().split() for t in texts[at:]]
        assert got.sizes.tolist() == list(map(len, words))
        of = {}
        for place, word in zip(got.place.tolist(), [w for ws in words for w in ws], strict=True):
            assert of.setdefault(place, word) == word
        assert len(set(of.values())) == len(of) == len(got.hashes)
        for place, word in of.items():
            shape = any(48 <= b <= 57 for b in word) + 2 * (not word.isascii()) + 4 * (not (word[-1:].isalnum() or word[-1] >= 128)) + 8 * (len(word) > 8)
            assert got.shapes[place] == shape and got.hashes[place] == Tokens(pa.array([word.decode()])).hashes[0]


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_url_words_and_tokens_without_limits(spark, monkeypatch, bits):
    """With three broadcast words and tokens, and keys that are broadcast from two rows on, verdicts and scores are those of the whole models."""
    from ledgermill.llm import url_filter
    from ledgermill.llm.queries import RULES

    rng = random.Random(14)
    words = ["red", "stone", "green", "house", "blue", "lake", "r", "onegreen", "x" * 60, "straße", "señal"]
    pages = []
    for i in range(150):
        name = lambda: "".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5])))
        pages.append((i // 2, f"http://{name()}{rng.choice(['.com', '.net', '.org'])}/{rng.choice(['es', 'en', 'fr'])}/{name()}{rng.randrange(99)}", "<p>" + " ".join(rng.choices(words, k=rng.choice([0, 3]))) + "</p>"))
    pages += [(900, None, None), (901, "http://" + "redstone" * 700 + ".org/", ""), (902, "x://a.b/" + "q" * 3000, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    whole = Counter(tuple(r)[:5] + (round(r.score, 9),) for r in url_filter.filter_urls(table, RULES).collect())
    for name, n in (("WORDS", 3), ("TOKENS", 3), ("LARGE", 2), ("BITS", bits)):
        monkeypatch.setattr(url_filter, name, n)
    assert Counter(tuple(r)[:5] + (round(r.score, 9),) for r in url_filter.filter_urls(table, RULES).collect()) == whole
    monkeypatch.setattr(url_filter, "WORDS", 10**6)
    long_ = url_filter.Segmenter({"red": 9, "stone": 7, "redstoneredstone": 1})
    assert long_.split("redstone" * 3) in [("redstoneredstone", "red", "stone"), ("red", "stone", "redstoneredstone")] and long_.split("qqq" * 500) == ("qqq" * 500,)


def test_languages_with_many_letters():
    """Transitions laid over each other parse as dense tables do; 30 languages and 5,000 letters take little memory."""
    import resource
    import time

    from ledgermill.llm.langid import Dense, Parser, Sparse

    rng = random.Random(5)
    words = {x: ["".join(rng.choice("abcdeéfgh") for _ in range(rng.choice([2, 3, 5]))) for _ in range(40)] for x in "pqr"}
    samples = {x: [" ".join(rng.choices(w, k=30)) for _ in range(6)] for x, w in words.items()}
    texts = [" ".join(rng.choices(words[rng.choice("pqr")], k=n)) for n in (0, 1, 3, 50, 400)] + ["", "12 ??", "ééé abc ĀĀ", "z" * 2000]
    dense, sparse = Parser(samples), Parser(samples, cells=0)
    assert isinstance(dense.tables[0], Dense) and isinstance(sparse.tables[0], Sparse) and dense.judge(texts) == sparse.judge(texts)
    assert (dense.phrases([dense.symbols(t) for t in texts]) == sparse.phrases([sparse.symbols(t) for t in texts])).all()
    letters = [chr(0x4E00 + i) for i in range(5000)]
    many = {f"l{i:02}": ["".join(rng.choices(letters[150 * i : 150 * i + 650], k=400)) for _ in range(64)] for i in range(30)}
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    parser = Parser(many)
    assert [lang for lang, _ in parser.judge([many[x][3][50:300] for x in sorted(many)])] == sorted(many)
    assert isinstance(parser.tables[0], Sparse) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000 and time.time() - began < 120


def test_pipeline_rows(spark, tmp_path):
    """Rows without an id, with one that others have, equal rows, very long texts, further columns and empty tables: decisions are about rows."""
    import corpus_pipeline as P

    rng = random.Random(9)
    text = lambda n, s: " ".join(random.Random(s).choices("alpha beta gamma delta river stone bright cloud seven open table data".split(), k=n))
    same, leak = text(60, 1), text(20, 2)
    rows = [(1, text(80, 3)), (1, ""), (1, text(80, 4)), (None, text(80, 5)), (None, None), (None, "12 ??"), (5, same), (6, same + " end"), (None, same + " more"), (7, text(50, 7)), (7, text(50, 7)), (8, f"{text(30, 8)} {leak} {text(30, 10)}"), (8, text(70, 11)), (9, text(30_000, 12)), (None, text(40, 13)), (None, text(40, 13))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n long, k string, h long, _id string"
    docs = spark.createDataFrame([(i, t, "en" if rng.random() < 0.8 else None, "s", len(t or ""), 1, "x", 2, "y") for i, t in rows], schema)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    told = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    left, at = Counter(rows), f"{tmp_path}"
    kept = P.language_id(spark, docs, at)
    for gone in ((1, ""), (None, None), (None, "12 ??")):
        del left[gone]
    assert told(kept) == left and kept.columns == docs.columns
    kept = P.near_duplicates(spark, kept, at)
    for i, t in ((6, same + " end"), (None, same + " more")):
        del left[i, t]
    left = Counter(dict.fromkeys(left, 1))
    assert told(kept) == left and kept.columns == docs.columns
    kept = P.decontamination(spark, kept, at)
    del left[rows[11]]
    assert told(kept) == left and kept.columns == docs.columns
    assert P.secret_scan(spark, kept, at).columns == docs.columns
    packed = P.packing(spark, kept, at).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in packed}) <= left.total() and any(r.doc_id is None for r in packed)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), at).count() == 0
    assert told(P.near_duplicates(spark, docs.filter("doc_id in (5, 6)"), at)) == Counter([(5, same)])


def test_top_k_with_very_long_vectors(spark):
    """One outlier, and products beyond 64 bits, which count as the largest or least number."""
    from ledgermill.llm.topk import top_k

    rng = random.Random(4)
    vectors = {i: [rng.randrange(-300, 300) for _ in range(6)] for i in range(300)}
    vectors |= {500: [10**15, -(10**14), 3, 4, 5, 6], 501: [9 * 10**18] * 6, 502: [-9 * 10**18] * 6, 503: [4 * 10**9] * 6}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>")
    asked = [i for i in vectors if i % 10 == 0 or i > 499]
    got = {}
    for r in top_k(table, table.filter(F.col("vec_id").isin(asked)), k=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in asked:
        cut = lambda x: max(-(2**63), min(2**63 - 1, x))
        scores = sorted((-cut(sum(a * b for a, b in zip(vectors[q], v, strict=True))), i) for i, v in vectors.items() if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]


def test_top_k_cuts_rings_of_clustered_vectors(spark, monkeypatch):
    """With as many pivots as the vectors ask for, most rings hold no vector that could be among the best, and aren't visited."""
    from ledgermill.llm import common, topk

    rng = np.random.default_rng(8)
    centres = rng.integers(-2000, 2000, (60, 12))
    x = np.concatenate([c + rng.integers(-25, 26, (50, 12)) for c in centres])
    table = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(x)], "vec_id long, v array<long>")
    monkeypatch.setattr(topk, "BLOCK", 4)
    seen, save = {}, common.Work.save
    monkeypatch.setattr(common.Work, "save", lambda self, df, name: seen.setdefault(name, save(self, df, name)) if name == "result" else _counted(seen, name, save(self, df, name)))
    got = {}
    for r in topk.top_k(table, table.filter("vec_id % 50 = 0"), k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in range(0, len(x), 50):
        scores = sorted((-int(x[q] @ x[i]), i) for i in range(len(x)) if i != q)[:3]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    cells = seen["cells"]
    assert cells > 50 and seen["visits1"] + seen["visits2"] < 0.5 * 60 * cells, (seen["visits1"], seen["visits2"], cells)


def _counted(seen, name, df):
    if name in ("visits1", "visits2"):
        seen[name] = df.select("query_id", "cell").distinct().count()
    if name == "keyed":
        seen["cells"] = df.select("cell").distinct().count()
    return df
