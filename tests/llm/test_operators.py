"""Each operator against a plain computation on small tables with nulls, empty and repeated rows, and clashing columns."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgermill.llm import brown_lm, common, decontam, langid, packing, secrets, url_filter
from ledgermill.llm.brown_lm import Settings, score_documents
from ledgermill.llm.decontam import find_leaks
from ledgermill.llm.jaccard_join import join_similar
from ledgermill.llm.queries import RULES
from ledgermill.llm.revisits import PERMITTED, resolve_revisits
from ledgermill.llm.token_count import count_tokens
from ledgermill.llm.topk import top_k

WORDS = "the a of stone river bright cloud seven green house walk open märz ünder data table row".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, piece string"


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    rows: list[tuple[int, str | None]] = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 5, 40, 300])))) for i in range(60)]
    rows += [(100, rows[4][1]), (101, rows[4][1]), (102, rows[9][1]), (103, None), (104, ""), (105, " \t\n "), (106, "A"), (107, "x" * 3000)]
    rows += [(108, " ".join(rng.choice(WORDS) for _ in range(20_000))), (109, "it's <|endoftext|> a   TEST\r\n\r\n 12 ｗｉｄｅ 😀!"), (109 + 1, f"pass secret = abcdefgh12 AKIA{'X' * 16} {'0a' * 20} token: short"), (111, "PASSWORD='Zz9/zz.zz' api_key:=12345678 apikey=aaaa")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "xx", "s", len(t or ""), 7, "p") for i, t in texts()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text: str | None) -> list[str]:
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_class_lm(docs, none):
    got = {r.doc_id: r for r in score_documents(docs, common.held_out(7)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts()}
    counts = Counter(w for i, t in texts() if not held[i] for w in [*split(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts():
        own = [*split(t), "\0end"]
        base = sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and -1e7 < got[i].score < 0
    assert len(got) == len(texts()) and score_documents(none, common.held_out(7)).count() == 0


def test_class_lm_rarer_words(spark):
    rng, rows = random.Random(4), []
    # two kinds of words with the same endings and shape, in turn
    kinds = [[f"{k}{i}end" for i in range(40)] for k in "ab"]
    for i in range(400):
        rows.append((i, " ".join(rng.choice(kinds[j % 2]) for j in range(20))))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"first": 30}, {"exchanged": 70}):
        got = score_documents(table, common.held_out(7), Settings(classes=4, **more)).collect()
        assert len(got) == len(rows)
        if "exchanged" not in more:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out) + 0.2 * 20 * sum(r.held_out for r in got)


def test_class_lm_against_plain_model(spark, docs):
    """The model's tables and scores from its classes, counted plainly."""
    s, work = Settings(classes=6, first=10, own=3), common.Work(spark, "test")
    training = [split(t) for i, t in texts() if zlib.crc32(str(i).encode()) % 7 != 2]
    model = brown_lm.train(docs.filter(~common.held_out(7)).select("text"), work, s)
    units = brown_lm.Units(*model["words"])
    counts = Counter(w for t in training for w in t)
    often = {w for w, n in counts.items() if n >= 3}
    unit = lambda w: units[w.encode()]
    assert {w for w in counts if unit(w) < units.shapes} == often and len({unit(w) for w in often}) == len(often)
    of = model["of"]
    cells, class_n, rare_n, rare_v = np.zeros((6, 6)), np.zeros(6), Counter(), Counter()
    for t in training:
        for a, b in zip([0, *map(unit, t)], [*map(unit, t), 0], strict=True):
            cells[of[a], of[b]] += 1
            class_n[of[b]] += 1
    for w, n in counts.items():
        if n < 3:
            rare_n[unit(w)] += n
            rare_v[unit(w)] += 1
    members, total = Counter(of.tolist()), class_n.sum()
    assert model["tokens"] == total

    def score(text):
        out, before = 0.0, 0
        for u, w in [*((unit(w), w) for w in text), (0, None)]:
            c, b = of[u], of[before]
            n_unit = len(training) if u == 0 else rare_n[u] if u >= units.shapes else counts[w]
            out += np.log10((cells[b, c] + 8 * (class_n[c] + 1) / (total + 6)) / (cells[b].sum() + 8))
            out += np.log10((n_unit + 0.5) / (class_n[c] + 0.5 * members[c]))
            if u >= units.shapes:
                out += np.log10((counts[w] + 1) / (rare_n[u] + rare_v[u] + 1))
            before = u
        return out

    got = {r.doc_id: r.score for r in score_documents(docs, common.held_out(7), s).collect()}
    # the exchange is deterministic, so both runs have the same classes
    assert all(got[i] == pytest.approx(score(split(t)), rel=1e-9) for i, t in texts())


def test_class_lm_gains():
    rng = np.random.default_rng(1)
    seq, labels = rng.integers(0, 40, 3000), rng.integers(0, 5, 40)
    seq[rng.random(3000) < 0.3] = 7
    pairs = Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))

    def cells(of):
        m = np.zeros((5, 5))
        for (u, v), n in pairs.items():
            m[of[u], of[v]] += n
        return m

    after, before, loops = np.zeros((40, 5)), np.zeros((40, 5)), np.zeros(40)
    for (u, v), n in pairs.items():
        after[u, labels[v]] += n
        before[v, labels[u]] += n
        loops[u] += n * (u == v)
    total = brown_lm.Gains(cells(labels)).of(labels, after, before, loops)
    for i in range(40):
        for c in range(5):
            moved = labels.copy()
            moved[i] = c
            assert total[i, c] - total[i, labels[i]] == pytest.approx(brown_lm.likelihood(cells(moved)) - brown_lm.likelihood(cells(labels)), abs=1e-6)


def test_class_lm_repeats_and_no_training(spark):
    rows = [(1, "a b a b a"), (1, "a b a b a"), (2, None), (3, "b a b"), (None, "a"), (None, "a")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, h string")
    got = score_documents(table, common.held_out(7)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got) == sorted((str(i), len(split(t)) + 1, len(split(t)) + 1) for i, t in rows)
    same = [r.score for r in got if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
    untaught = score_documents(table, F.lit(True)).collect()
    assert len(untaught) == len(rows) and all(r.score == r.base_score and r.n_known == 0 and r.train_tokens == 0 for r in untaught)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, pieces, sequences = Tokenizer.from_file(path), defaultdict(list), defaultdict(list)
    for r in packing.pack_documents(docs, path, end_id=2).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in texts():
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    full = 0
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        full += at & (at - 1) == 0
    assert len(pieces) == len(texts()) and full >= len(sequences) - 1 and packing.pack_documents(none, path, end_id=2).count() == 0


@pytest.mark.parametrize("lengths", [(3000, 3500), (2049, 4096), (1, 4096), (4000, 4096), (1, 50)])
def test_packing_leaves_less_than_a_window(lengths):
    rng = random.Random(sum(lengths))
    pieces = [(rng.randint(*lengths), i, 0) for i in range(700)]
    out, left = packing.pack(pieces, [4096, 2048, 1024, 512, 256])
    assert sum(n for n, _, _ in left) < 4096 and all(sum(n for n, _, _ in found) == size for size, found in out)
    at = defaultdict(list)
    for _, found in [*out, (0, left)]:
        for n, doc, start in found:
            at[doc].append((start, n))
    for n, doc, _ in pieces:
        place = 0
        for start, part in sorted(at[doc]):
            assert start == place and part > 0
            place += part
        assert place == n


def test_url_filters(spark):
    rows = [(0, "http://A.example.COM/en/x?y#z"), (1, None), (2, "no scheme"), (3, "https://www.example.com/en/"), (4, "http://x.net/es/redstone"), (5, "http://greenhouse.org/es/redstone"), (6, "http://a.net"), (6, "http://a.net"), (7, "http://example.com#/en/"), (8, "http://h/" + "ab" * 5000)]
    pages = spark.createDataFrame([(i, u, "<p>red stone green house</p>", "c", 1) for i, u in rows], "page_id long, url string, html string, host string, n int")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(pages, RULES).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/") and got[1] == got[2] == ("", "", None)
    assert got[3][2] == "www.example.com/en/" and got[4][2] == "net/es/" and got[5] == ("greenhouse.org", "/es/redstone", None) and got[7] == ("example.com", "", "com/" if "".startswith("/") else None)
    found = url_filter.filter_urls(pages, RULES)
    assert found.count() == len(rows) and found.filter("verdict not in ('allow', 'block')").count() == 0
    assert found.filter("rule is not null").select((F.col("verdict") == F.when(F.col("rule").isin("com/", "www.example.com/en/"), "allow").otherwise("block")).alias("x")).filter("not x").count() == 0
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    cut = url_filter.Segmenter({"red": 9, "stone": 7, "green": 5, "house": 5, "reds": 1})
    assert cut.split("redstone") == ("red", "stone") and cut.split("greenhouse") == ("green", "house")


def test_url_verdicts_against_plain_bayes(spark):
    """Every split of every name is tried, and odds are counted plainly."""
    import itertools
    import math

    rng = random.Random(14)
    words = ["red", "stone", "green", "house", "blue", "lake"]
    urls = []
    for i in range(60):
        host = "".join(rng.sample(words, 2)) + rng.choice([".com", ".net", ".org"])
        urls.append((i, f"http://{host}/{rng.choice(['es', 'en', 'fr'])}/{''.join(rng.sample(words, rng.choice([1, 2])))}{rng.choice(['', '7', '1234'])}?q"))
    rows = [(i, u, "<p>" + " ".join(rng.choices(words, k=5)) + " <b>com</b> net org</p><script>ignored words</script>") for i, u in urls] + [(100, None, None), (101, "http://redstone.org/en/x", "")]
    found = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), RULES).collect()}

    counts = Counter(w for _, _, h in rows for w in re.findall(r"[^\W\d_]+", re.sub(r"(?is)<script.*?</script>|<[^>]*>", " ", h or "").lower()))
    total = sum(counts.values()) + 1
    cost = lambda w: math.log(counts[w] / total) if w in counts else -math.log(total) - 3.0 * len(w)

    def split(name):
        ways = []
        for cuts in itertools.product([False, True], repeat=len(name) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(name)]
            parts = [name[a:b] for a, b in itertools.pairwise(at)]
            # a part that is no word is no longer than the longest word
            if all(len(p) <= max(map(len, counts)) for p in parts):
                ways.append((sum(map(cost, parts)), parts))
        return max(ways, key=lambda x: x[0])[1]

    def tokens(r):
        return [m + w for m, text in (("h:", r.host), ("p:", r.path.lower())) for part in re.findall(r"[^\W\d_]+|\d+", text) for w in ([f"#{len(part)}"] if part.isdigit() else split(part))]

    blocked, seen, urls_n = Counter(), Counter(), Counter()
    judged = {"com/": "allow", "www.example.com/en/": "allow"}
    for r in found.values():
        if r.rule:
            v = judged.get(r.rule, "block")
            urls_n[v] += 1
            for t in tokens(r):
                seen[t] += 1
                blocked[t] += v == "block"
    block, allow, v = sum(blocked.values()), sum(seen.values()) - sum(blocked.values()), len(seen) + 1
    odds = lambda t: math.log((blocked[t] + 1) / (block + v)) - math.log((seen[t] - blocked[t] + 1) / (allow + v))
    assert urls_n["block"] and urls_n["allow"] and sum(not r.rule for r in found.values()) > 10
    for r in found.values():
        score = math.log((urls_n["block"] + 1) / (urls_n["allow"] + 1)) + sum(map(odds, tokens(r)))
        assert r.score == pytest.approx(score, abs=1e-9)
        if not r.rule:
            assert r.verdict == ("block" if score > 0 else "allow")


def test_suffix_automaton():
    text = [1, 2, 1, 1, 2, 3, 1, 2]
    states = langid.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for word in [(1, 2, 3), (2, 1, 1), (3, 3), (2, 3, 1, 2), (1, 1, 1)]:
        at = 0
        for x in word:
            at = states[at].get(x, -1) if at >= 0 else -1
        assert (at >= 0) == (word in inside)


def test_cross_parsing_counts():
    """Numbers of greedy phrases of texts of several pieces, against plain search for the longest match."""
    rng = random.Random(11)
    words = ["river", "stone", "strasse", "über", "haus", "the", "and", "und"]
    sample = {x: [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)] for x in ("aa", "bb")}
    sample["cc"] = ["aaaa aaaa aaaaaaaaaaaaaa"]
    parser = langid.Parser(sample)
    texts = [" ".join(rng.choice([*words, "zebra", "a"]) for _ in range(n)) for n in (1, 5, 300, 1500)] + ["a" * 3000, "ä", "aaaa " * 500]

    def plain(text, language):
        inside = langid.suffix_automaton([s for t in sample[language] for s in (*parser.symbols(t.lower()).tolist(), langid.BREAK)])
        phrases, state, symbols = 0, 0, parser.symbols(text).tolist()
        for s in symbols:
            if state and s in inside[state]:
                state = inside[state][s]
            else:
                phrases, state = phrases + 1, inside[0].get(s, 0)
        return phrases

    found = parser.phrases([parser.symbols(t) for t in texts])
    for t, row in zip(texts, found.tolist(), strict=True):
        assert row == [plain(t, x) for x in parser.languages]


def test_language_id_repeats_and_ties(spark):
    rows = [(1, "the river and the stone", "aa"), (1, "the river and the stone", "aa"), (3, "the river and the stone", "bb"), (None, "the river", "aa"), (4, "x" * 5000, None), (5, None, "aa")]
    table = spark.createDataFrame([(i, t, x, 1.0, "s") for i, t, x in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    found = langid.identify_languages(table, F.lit(True)).collect()
    assert len(found) == len(rows) and sum(r.doc_id == 1 for r in found) == 2
    assert all(r.lang_pred == "aa" and r.score == 0 for r in found if r.doc_id in (1, 3))  # both languages know the text alike
    untaught = langid.identify_languages(table, F.lit(False)).collect()
    assert len(untaught) == len(rows) and all(r.lang_pred == "und" and r.score == 0 for r in untaught)


def test_language_id(spark, none):
    said = {"aa": "the stone and the river went there with their mother ", "bb": "der stein und das wasser gehen nicht über die straße "}
    rng, rows = random.Random(3), []
    for i in range(80):
        lang = "ab"[i % 2] * 2
        rows.append((i, " ".join(rng.sample(said[lang].split(), 8)), lang))
    rows += [(200, None, "aa"), (201, "123 !?", "bb"), (202, "", None)]
    found = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ~common.held_out(4)).collect()}
    assert all(found[i].lang_pred == "und" for i in (200, 201, 202)) and all(0 <= r.score <= 1 for r in found.values())
    assert sum(found[i].lang_pred == lang for i, _, lang in rows[:80]) >= 78 and len(found) == len(rows)
    assert langid.identify_languages(none, ~common.held_out(4)).count() == 0


def test_decontamination(spark, docs, none):
    rng = random.Random(8)
    item = [f"w{rng.randrange(500)}" for _ in range(40)]
    edited = [*item[:10], "other", *item[11:30], *item[31:]]
    fill = [f"v{rng.randrange(500)}" for _ in range(300)]
    rows = [(1, " ".join([*fill, *item, *fill])), (2, " ".join([*fill, *edited])), (3, " ".join(fill)), (4, None), (5, " ".join(item[:10] + fill))]
    items = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (9, "", 1)], "item_id long, text string, doc_id long")
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert found == {(1, 7), (2, 7)}
    assert find_leaks(none, items).count() == 0 and find_leaks(docs, items.limit(0)).count() == 0


def test_decontamination_long_items(spark):
    rng, limit = random.Random(12), 0.2
    rows, items, want = [], [], set()
    for n in (9, 15, 50, 80, 150):
        for kinds in ("s", "i", "d", "sid"):
            for more in (0, 0, 0, 2):  # edits over the limit
                k, item = len(items), [f"w{rng.randrange(3000)}" for _ in range(n)]
                text = list(item)
                for at in sorted(rng.sample(range(1, n - 1), int(limit * n) + more), reverse=True):
                    kind = rng.choice(kinds)
                    text[at : at + (kind != "i")] = [] if kind == "d" else [f"x{rng.randrange(3000)}"]
                text = [*(f"v{rng.randrange(500)}" for _ in range(30)), *text, *(f"v{rng.randrange(500)}" for _ in range(30))]
                row = [0] * (len(text) + 1)
                for i, w in enumerate(item, 1):
                    new = [i]
                    for j, x in enumerate(text, 1):
                        new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
                    row = new
                items.append((k, " ".join(item)))
                rows.append((k, " ".join(text)))
                if min(row) <= limit * n:
                    want.add((k, k, min(row), row.index(min(row))))
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) >= 60 and {(r.doc_id, r.item_id, r.edits, r.end_word) for r in found.collect()} == want


@pytest.mark.parametrize("n", [8, 59, 150, 300, 500])
def test_decontamination_recall_at_the_limit(n):
    rng, settings, found, tried = random.Random(n), decontam.Settings(), 0, 0
    walks = {m: decontam.Walks(m, settings).measured(settings) for m in set(decontam.lengths(n, settings))}
    for kinds in ("s", "i", "d", "sid"):
        for _ in range(10):
            item = [f"w{rng.randrange(3000)}" for _ in range(n)]
            text = list(item)
            for at in sorted(rng.sample(range(n), int(0.2 * n)), reverse=True):
                kind = rng.choice(kinds)
                text[at : at + (kind != "i")] = [] if kind == "d" else [f"x{rng.randrange(3000)}"]
            fill = [f"v{rng.randrange(500)}" for _ in range(30)]
            finder = decontam.Finder([(1, " ".join(item)), (2, "absent " * n)], walks, settings)
            tried += 1
            found += [m[0] for m in finder.find(" ".join([*fill, *text, *fill]).encode())] == [1]
    assert found >= 0.95 * tried


def test_decontamination_short_repeated_and_unspaced(spark):
    items = [(1, "two words"), (2, "Two, words!"), (3, "日本語の文章を読む"), (4, "...")]
    rows = [(1, "these two words here"), (1, "these two words here"), (2, "two other words"), (3, "前に日本語の文章を読む人"), (None, "two words"), (5, "a " * 50_000 + "two words")]
    found = find_leaks(spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits) for r in found.collect()), key=str)
    want = [(i, k, a, a + 2, 0) for i, a in ((1, 1), (1, 1), (None, 0), (5, 50_000)) for k in (1, 2)] + [(3, 3, 2, 11, 0)]
    assert got == sorted(want, key=str)
    blocks = decontam.Settings(block_chars=10)
    again = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), blocks)
    assert sorted(((r.doc_id, r.item_id, r.start_word, r.end_word, r.edits) for r in again.collect()), key=str) == got


def test_top_k(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-40, 40, (400, 6))
    x[200:300] = x[7]
    rows = [(i, [int(v) for v in row], 1, 2.0) for i, row in enumerate(x)] + [(1000, None, 1, 2.0), (1001, [1, None], 1, 2.0)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>, cell int, bound double")
    got = defaultdict(list)
    for r in top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 400, 50):
        scores = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:5]
        assert got[q] == [(-s, i) for s, i in scores]
    assert set(got) == set(range(0, 400, 50)) and top_k(vectors.limit(0), vectors, k=5).count() == 0


def test_top_k_large_numbers_few_rows_and_blocks(spark, monkeypatch):
    from ledgermill.llm import topk

    rng = np.random.default_rng(9)
    x = rng.integers(-(2**28), 2**28, (300, 3))
    rows = [(i, [int(v) for v in (r if i % 3 else r[:2])]) for i, r in enumerate(x)] + [(5, [1, 1, 1])]
    own = {i: np.array([*v, 0][:3], object) for i, v in reversed(rows)}
    own[5] = np.array(min(rows[5][1], [1, 1, 1]), object)
    monkeypatch.setattr(topk, "BLOCK", 16)  # many parts and chunks
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = defaultdict(list)
    for r in top_k(vectors, vectors, k=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q in range(0, 300, 7):
        scores = sorted((-int(own[q] @ own[i]), i) for i in own if i != q)[:4]
        assert got[q] == [(-s, i) for s, i in scores]
    two = top_k(vectors.filter("vec_id < 2"), vectors.filter("vec_id < 2"), k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in two) == [(0, 1, 1), (1, 1, 0)]


def test_secrets(docs, none):
    patterns = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    for i, t in texts():
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(patterns) for m in p.finditer(t or "") if ok(m))
        assert [s for s in found[i] if s[0] in ("assign", "access", "hex")] == [(patterns[k][0], a, b) for a, k, b in want]
    assert found[110] and found[111] and secrets.scan_secrets(none).count() == 0
    body = "A" * 30
    n, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        tail = secrets._BASE62[r] + tail
    assert [s[0] for s in secrets.find_secrets(f"x ghp_{body}{tail} ghp_{body}000000")] == ["github"]
    clean = {r.doc_id: r for r in secrets.redact_secrets(docs).collect()}
    assert "abcdefgh12" not in clean[110].text and clean[103].text is None and clean[5].text == texts()[5][1] and len(clean[110].text) == clean[110].n_chars


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, none, size, percent):
    rng, rows = random.Random(2), []
    for i in range(40):
        base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(rng.choice([2, 4, 30, 120]))]
        for k in range(rng.choice([1, 1, 2, 4])):
            changed = list(base)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = rng.choice("xyz")
            rows.append((3 * len(rows), " ".join(changed)))
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE "), (1004, rows[5][1]), (1005, rows[5][1])]

    def grams(t):
        w = split(t)
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in join_similar(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    assert found == {i: (len(sets[i]), top(i)) for i, _ in rows}
    assert join_similar(none, size, percent).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join_large_group(spark, size, percent):
    """Hundreds of near copies of one text about the limit, some of them copies of copies, and words of their own or from a short list."""
    rng, rows = random.Random(size), []
    first = [f"w{rng.randrange(2000)}" for _ in range(150)]
    second = [*first[:60], *(f"s{i}" for i in range(12)), *first[72:]]
    for i in range(400):
        text = list(first if i % 4 else second)
        for at in rng.sample(range(150), rng.choice([0, 2, 3, 4, 5, 6, 9])):
            text[at] = rng.choice([f"u{len(rows)}-{at}", "alpha", "beta"])
        if i % 7 == 0:
            del text[40 : 40 + rng.randrange(20)]
        rows.append((len(rows) + 1, " ".join(text)))
    for i in range(0, 400, 9):
        text = rows[i][1].split()
        text[rng.randrange(len(text))] = "again"
        rows.append((len(rows) + 1, " ".join(text)))

    sets = {}
    for i, t in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in join_similar(table, size, percent).collect()}
    assert found == {i: (len(a), top(i)) for i, a in sets.items()} and len({top(i) for i in sets}) > 20


def test_jaccard_join_repeats(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z w v u"), (2, "x y z w v u"), (3, "A B c d e f"), (None, "a b c"), (4, None)]
    table = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, h long, sig string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join_similar(table, 3, 90).collect()), key=str)
    assert found == sorted([(1, 4, 1), (1, 4, 1), (2, 4, 2), (2, 4, 2), (3, 4, 1), (None, None, None), (4, 0, 4)], key=str)


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for head in (131_072, 3):  # nearly all pre-tokens by broadcast, nearly all by the join
        found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path, 1024, head).collect()}
        for i, text in texts():
            n = len(t.encode(text or "", add_special_tokens=False).ids)
            assert found[i] == (len((text or "").encode()), n, n > 1024)
    twice = count_tokens(docs.filter("doc_id = 4").union(docs.filter("doc_id = 4")), path).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and count_tokens(none, path).count() == 0


def test_revisits(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        tag = f'"{rng.randrange(3)}"'
        headers = {"ETag": rng.choice([tag, "W/" + tag]), "Server": f"s{i}"} if rng.random() < 0.7 else {"last-modified": str(rng.randrange(2)), "X": "1"} if rng.random() < 0.8 else None
        rows.append((i, rng.choice(["http://A.org:80/x?utm_a=1&b=2#f", "https://a.org/x?b=2", "http://b.org", None]), rng.choice([None, *range(30)]), rng.choice([True, False, False, None]), headers))
    rows.append(rows[3])
    keys = {"http://A.org:80/x?utm_a=1&b=2#f": "a.org/x?b=2", "https://a.org/x?b=2": "a.org/x?b=2", "http://b.org": "b.org/", None: None}
    want = []
    for i, url, ts, full, headers in rows:
        own = {k.lower(): v for k, v in (headers or {}).items()}
        best = max(((t, j, h) for j, u, t, f, h in rows if f and url and ts is not None and t is not None and keys[u] == keys[url] and t < ts), key=lambda x: x[:2], default=None)
        outcome, origin = "response", None
        if not full:
            outcome = "no_original"
            if best:
                origin, kept = best[1], {k.lower(): v for k, v in (best[2] or {}).items()}
                if "etag" in own and "etag" in kept:
                    same = own["etag"].removeprefix("W/") == kept["etag"].removeprefix("W/")
                elif "last-modified" in own and "last-modified" in kept:
                    same = own["last-modified"] == kept["last-modified"]
                else:
                    same = None
                outcome = "unvalidated" if same is None else "resolved" if same else "mismatch"
                if same:
                    own = kept | {k: v for k, v in own.items() if k in PERMITTED and k in kept} | {k: v for k, v in own.items() if k in PERMITTED}
        want.append((i, keys[url], bool(full), outcome, origin, tuple(sorted(own.items()))))
    captures = spark.createDataFrame([(*r, "c") for r in rows], "record_id long, url string, ts long, full boolean, headers map<string,string>, stretch string")
    for stretches in (2, 256):
        got = [(r.record_id, r.url_key, r.full, r.outcome, r.original_id, tuple(sorted(r.headers.items()))) for r in resolve_revisits(captures, stretches=stretches).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert resolve_revisits(captures.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        own = ("the and with there mother river stone" if lang == "en" else "der und nicht über straße wasser stein").split()
        rows.append((i, " ".join(rng.choice(own) + " " + f"n{rng.randrange(900)}x" for _ in range(40)), lang, "s"))
    item = " ".join(f"bench{rng.randrange(300)}" for _ in range(40))
    rows += [(100, rows[3][1], "de", "s"), (101, rows[5][1] + " tail", "de", "s"), (102, "the river " + item + " stone", "en", "s"), (103, None, "en", "s"), (104, "12 34", None, "s"), (105, "the key password=abcdefgh99 is there", "en", "s")]
    spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    at = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert sorted(docs.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"]), name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {*range(60), 105} and "abcdefgh99" not in kept[105]
    packed = corpus_pipeline.run(spark, at)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)
