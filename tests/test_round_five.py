"""Findings of the fourth round: what failed before its changes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import links as K
from ledgermill.operators import shredding as S
from ledgermill.plans import ORACLE_SQL, QUERIES
from ledgermill.plans import approvals as A
from ledgermill.sources.committed import CommittedTables
from ledgermill.sources.tables import table

AT = "/root/testdata/sf0.001"


@pytest.fixture
def given(spark):
    orders, lineitem = (table(spark, AT, n) for n in ("orders", "lineitem"))
    return A.batches_of(orders), A.items_of(orders, lineitem), A.forms_of(orders)


def rows_of(tables, kind):
    return sorted(tables.table(kind, S.SCHEMAS[kind]).collect(), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_documents_are_made_once(given):
    """no array is made once more to ask for its size, and items of other batches are left out before documents are read."""
    batches, items, _ = given
    winners = batches.select("batch_id", F.col("batch_id").alias("form_id")).filter("batch_id % 2 = 0")
    plan = plan_of(S.shred(S._with_projects(winners, items), True))
    assert not any(" Filter " in x and "size(" in x for x in plan)
    semi = [i for i, x in enumerate(plan) if "LeftSemi" in x]
    assert sum("from_json" in x for x in plan) == 1 and semi[0] > next(i for i, x in enumerate(plan) if "from_json" in x)


def test_a_head_is_enough(spark):
    """what decides on a form is the same if its projects are passed over."""
    texts = ['{"company_id":"5","form_data":{"fiscal_year":"2022","fiscal_summary":{"total_benefit_requested":1.5},"projects":[{"human_resources":["x"]}]},"fiscal_year":"1"}', '{"fiscal_year":2020,"projects":[{"title":"a"}]}', "{", "", None]
    items = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "batch_id long, item_id long, record_data string")
    batches = items.select("batch_id", F.lit(None).cast("long").alias("company_id"))
    whole, head = (S._facts(batches, S._documents(items), counted=c) for c in (True, False))
    assert sorted(whole.drop("number").collect(), key=str) == sorted(head.collect(), key=str)
    assert {r.batch_id: r.number for r in whole.collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_backfill_reads_what_it_writes(spark, given, tmp_path):
    """a backfill that knows the numbers of projects plans without documents, and leaves the same rows."""
    batches, items, forms = given
    placed, resolved = S.place_forms(*given), S.resolve_forms(*given)
    assert not any("from_json" in x for x in plan_of(placed))
    one, two = (CommittedTables(spark, f"file://{tmp_path}/{n}") for n in ("one", "two"))
    told = [S.backfill(one, placed, "all", items=items), S.backfill(two, resolved, "all")]
    assert sorted(told[0].collect()) == sorted(told[1].collect())
    for kind in S.SCHEMAS:
        got = rows_of(one, kind)
        assert got and got == rows_of(two, kind)


def test_tables_are_written_unsorted(spark, tmp_path):
    """F1 to F3: rows aren't sorted by their table, and the session's setting stays."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    tables = CommittedTables(spark, f"file://{tmp_path}/t")
    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), F.col("id").alias("owner"))
    seen = []
    write = rows.sparkSession.conf.set
    try:
        spark.conf.set = lambda k, v: (seen.append((k, v)), write(k, v))
        tables.replace("one", rows, rows.select("owner"))
    finally:
        del spark.conf.set
    assert (name, "16") in seen and spark.conf.get(name) == before
    assert tables.table("a", "owner long").count() == 1000 and tables.table("b", "owner long").count() == 2000


@pytest.fixture
def big(spark):
    """Plans as for large tables, without broadcasts by size."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["-1", "false"], strict=True):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def test_existing_links_stay_where_they_lie(big):
    """neither existing pairs nor lists of them are shuffled, only contacts are."""
    df = QUERIES["links_by_email"](big, AT)
    moved = [x for x in plan_of(df) if " Exchange " in x]
    assert moved and all("id#" in x and ", REPARTITION_BY_NUM" in x or "email" in x or "_at" in x for x in moved) and not any("_block" in x for x in moved)
    duck = duckdb.connect()
    for name in ("customer", "supplier"):
        duck.execute(f"create view {name} as select * from '{AT}/{name}.parquet'")
    assert sorted(tuple(r) for r in df.collect()) == sorted(duck.execute(ORACLE_SQL["links_by_email"]).fetchall())


@pytest.mark.parametrize("most", [0, 1000])
def test_links_of_large_right_sides(spark, most):
    """the same links whether or not the right lists are sent to all; null ids and keys, left ids with several keys."""
    left = [(i, f"m{i % 4}") for i in range(12)] + [(1, "m2"), (20, None), (None, "m1")]
    right = [(c, f"m{c % 3}") for c in range(30)] + [(3, "m2"), (99, None), (98, "m3"), (None, "m0")]
    old = [(i, c) for i in range(12) for c in range(30) if (i + c) % 4 == 0] + [(None, 1), (2, None), (500, 2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = K.new_links(frame(left, "id long, email string"), frame(right, "company int, email string"), "email", ["id", "company"], frame(old, "id long, company int"), block=3, most=most)
    several = lambda m: sum(e == m for _, e in right) > 1
    want = {(i, c, several(m)) for i, m in left for c, n in right if None not in (i, c, m) and m == n and (i, c) not in old}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
