"""Merges by rules, versions with closed snapshots, and remote services."""

import random

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import forms
from ledgermill.operators import links as K
from ledgermill.operators import versions as V
from ledgermill.sources import remote, templates


def test_merge_by_rules(spark):
    base = spark.createDataFrame([(1, "a", None, 5, 7), (2, "b", "x", 5, 7), (None, "n", "y", 1, 1)], "k int, name string, note string, top int, other int")
    changes = spark.createDataFrame([(2, None, "z", 3, 9), (None, "m", None, 4, 9), (3, "c", None, 2, 9)], "k int, name string, note string, top int, other int")
    rules = {"name": V.given, "note": V.new, "top": V.greatest}
    got = {r.k: tuple(r)[1:] for r in V.merge_by_rules(base, changes, ["k"], rules, {"note": F.lit("none")}).collect()}
    assert got == {1: ("a", None, 5, 7, "KEPT"), 2: ("b", "z", 5, 7, "UPDATED"), None: ("m", None, 4, 1, "UPDATED"), 3: ("c", "none", 2, 9, "INSERTED")}
    assert V.merge_by_rules(base, changes.limit(0), ["k"], rules).count() == 3 and V.merge_by_rules(base.limit(0), changes, ["k"], rules).count() == 3


HISTORY = "k int, a string, b int, valid_from int, valid_to int, closed boolean"


def plain(history, changes):
    """Versions of a key by going through time."""
    closed = [h for h in history if h[5]]
    refused = [c for c in changes if any(h[0] == c[0] and h[3] <= c[3] and (h[4] is None or c[3] < h[4]) for h in closed)]
    out = []
    for k in {h[0] for h in history} | {c[0] for c in changes}:
        points = [(h[3], 0, 0, h) for h in history if h[0] == k] + [(c[3], 1, c[4], c) for c in changes if c[0] == k and c not in refused]
        states, now = [], (None, None)
        for at, kind, _, row in sorted(points, key=lambda p: p[:3]):
            now = (row[1], row[2]) if kind == 0 else tuple(new if new is not None else old for new, old in zip(row[1:3], now, strict=True))
            shut = kind == 0 and row[5]
            states = [s for s in states if s[0] != at] + [(at, now, shut, row[4] if shut else None)]
        kept = []
        for s in states:
            before = kept_before[-1] if (kept_before := [x for x in states if x[0] < s[0]]) else None
            if s[2] or before is None or before[2] or before[1] != s[1]:
                kept.append(s)
        for i, (at, values, shut, end) in enumerate(kept):
            out.append((k, *values, at, end if shut else (kept[i + 1][0] if i + 1 < len(kept) else None), shut))
    return sorted(out, key=str), sorted(c[4] for c in refused)


@pytest.mark.parametrize("seed", range(3))
def test_versions_against_plain(spark, seed):
    rng = random.Random(seed)
    history, changes = [], []
    for k in range(12):
        if k % 4 == 0:
            history += [(k, "c", 1, 0, 10, True), (k, "c", 1, 10, None, False)]
        elif k % 4 == 1:
            history += [(k, "d", None, 0, 8, False), (k, None, 2, 8, None, False)]
        elif k % 4 == 2:
            history.append((k, "e", 3, 0, None, True))
        changes += [(k, rng.choice([None, "x", "y", "c"]), rng.choice([None, 1, 2]), rng.randrange(1, 20), 100 * k + i) for i in range(rng.randrange(6))]
    versions, refused = V.apply_changes(spark.createDataFrame(history, HISTORY), spark.createDataFrame(changes, "k int, a string, b int, at int, n long"), ["k"], ["a", "b"], "at", "n")
    want, no = plain(history, changes)
    got = versions.select("k", "a", "b", "valid_from", "valid_to", "closed").collect()
    assert sorted(map(tuple, got), key=str) == want and sorted(r.n for r in refused.collect()) == no
    closed = {tuple(h) for h in history if h[5]}
    assert {tuple(r) for r in got if r.closed} == closed


def pages(args, wanted, offset, limit):
    """A service that fails at the first call of every page."""
    import os

    mark = f"{args['marks']}/{offset}"
    if offset is not None and not os.path.exists(mark):
        open(mark, "w").close()
        raise OSError("try again")
    rows = [{"id": i, "kind": "ab"[i % 2]} for i in range(args["n"])]
    rows = [r for r in rows if all(r[k] == v for k, v in wanted.items())]
    return len(rows) if offset is None else rows[offset : offset + limit]


def test_paged_source(spark, tmp_path):
    from tests import test_versions

    name = f"{test_versions.__name__}:pages"
    read = lambda n, sub: remote.paged(spark, name, "id long, kind string", {"n": n, "marks": str((tmp_path / sub).mkdir() or tmp_path / sub)}, page=40)
    spark.conf.set("spark.sql.pyspark.udf.faulthandler.enabled", "false")
    table = read(250, "a")
    assert sorted(r.id for r in table.collect()) == list(range(250)) and table.rdd.getNumPartitions() == 7
    assert sorted(r.id for r in read(250, "b").filter("kind = 'a'").collect()) == list(range(0, 250, 2))
    assert read(0, "c").count() == 0


def test_lookup(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def client(keys, at=str(calls)):
        import os
        import uuid

        if not os.path.exists(f"{at}/failed"):
            open(f"{at}/failed", "w").close()
            raise OSError("busy")
        for k in keys:
            open(f"{at}/{k}-{uuid.uuid4().hex}", "w").close()
        return {k: {"name": f"n{k}"} for k in keys if k % 3}

    rows = spark.createDataFrame([(i, None if i == 5 else i % 7) for i in range(60)], "i int, k int")
    look = lambda df: remote.looked_up(df, "k", client, "said", f"file://{tmp_path}/cache", at_once=2, batch=3, wait=0.01)
    first = {r.i: r.said for r in look(rows.filter("k < 4")).collect()}
    assert first[8] == '{"name": "n1"}' and first[3] is None
    got = {r.i: r.said for r in look(rows).collect()}
    assert len(got) == 60 and got[5] is None and got[6] is None and got[11] == '{"name": "n4"}'
    asked = sorted(int(p.name.split("-")[0]) for p in calls.iterdir() if p.name != "failed")
    assert asked == list(range(7))  # once each, over both runs


def test_injected_extractors(spark):
    files = spark.createDataFrame([("a", bytearray(b"short")), ("b", bytearray(b"\xff")), ("c", None)], "path string, content binary")
    found = templates.extracted_texts(files, [lambda b: b.decode(), lambda b: b.decode("latin1") * 3])
    told = found.select("path", forms.usable_text(F.col("text_0"), F.col("text_1")).alias("t")).collect()
    assert {r.path: (r.t.text, r.t.text_source) for r in told} == {"a": ("shortshortshort", "secondary"), "b": ("ÿÿÿ", "secondary"), "c": (None, "primary")}


def test_migration(spark):
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], "contact int, company int")
    there = spark.createDataFrame([(2, 20), (3, 30)], "contact int, company int")
    assert {tuple(r) for r in K.migrated(links, there, ["contact", "company"]).collect()} == {(1, 10, "MIGRATED"), (2, 20, "KEPT"), (3, 30, "KEPT")}


def test_operations_in_order(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, t string, n int")
    ops = [(1, "UPDATE", None, 5, 1), (1, "DELETE", None, None, 2), (1, "UPDATE", "lost", 9, 3), (1, "CREATE", None, 7, 4), (1, "UPDATE", "z", None, 5), (2, "DELETE", None, None, 1), (3, "UPDATE", "nobody", 1, 1), (4, "CREATE", None, None, 1)]
    table = spark.createDataFrame(ops, "k int, op string, t string, n int, at int")
    run = lambda o: {r.k: (r.t, r.n) for r in V.apply_operations(base, o, "k", ["t", "n"], "at", {"t": F.lit("new"), "n": F.lit(0)}).collect()}
    assert run(table) == {1: ("z", 7), 4: ("new", 0)} and run(table.limit(0)) == {1: ("a", 1), 2: ("b", None)}


def test_closing_snapshots(spark):
    old = spark.createDataFrame([(1, False), (2, True), (3, False)], "k int, closed boolean").selectExpr("k", "closed", *[f"cast(if(closed, 9, null) as decimal(18,2)) {n}" for n in ("hr_total", "expense_total", "total")])
    rows = spark.createDataFrame([(1, 5, True), (1, 7, False), (2, 8, True)], "k int, amount int, eligible boolean").selectExpr("k", "cast(amount as decimal(18,2)) amount", "eligible")
    got = V.close_snapshots(old, spark.createDataFrame([(1,), (2,), (4,), (1,)], "k int"), rows, rows.limit(0), "k").collect()
    plain = {r.k: (r.closed, *[None if r[n] is None else float(r[n]) for n in ("hr_total", "expense_total", "total")], r.result) for r in got}
    assert plain == {1: (True, 5.0, 0.0, 5.0, "CLOSED"), 2: (True, 9.0, 9.0, 9.0, "REFUSED"), 3: (False, None, None, None, None), 4: (False, None, None, None, "UNKNOWN")}
