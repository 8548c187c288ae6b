"""Findings of the third round: what failed before its changes."""

import re

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import links as K
from ledgermill.operators import relational as R
from ledgermill.operators import shredding as S
from ledgermill.plans import ORACLE_SQL, QUERIES
from ledgermill.plans import approvals as A
from ledgermill.plans.records import _served_parts, served
from ledgermill.sources.committed import CommittedTables
from ledgermill.sources.tables import table
from ledgermill.streaming.jobs import JobStates

AT = "/root/testdata/sf0.001"


@pytest.fixture
def big(spark):
    """Plans as for large tables, without broadcasts."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["-1", "false"], strict=True):
        spark.conf.set(n, v)
    yield spark
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def exchanged(df):
    """For each exchange of a plan the number of its lines below that make JSON or read it: a shuffle of whole documents has some."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: re.search(r"[A-Za-z*(]", x.replace("+-", "  ").replace(":", " ")).start()
    found = []
    for i, line in enumerate(lines):
        if " Exchange " in line:
            below = []
            for other in lines[i + 1 :]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            found.append(sum("StructsToJson" in x or "from_json" in x for x in below))
    return found


def test_documents_are_not_shuffled(big):
    """what decides on a form is shuffled, not its document."""
    tables = [table(big, AT, n) for n in ("orders", "lineitem")]
    resolved = S.resolve_forms(A.batches_of(tables[0]), A.items_of(*tables), A.forms_of(tables[0]))
    found = exchanged(resolved)
    assert found and not any(found)


def test_rows_of_one_run_meet_no_owners(big, tmp_path):
    """rows of the newest run are visible without a join."""
    tables = CommittedTables(big, f"file://{tmp_path}/t")
    rows = big.range(9).select(F.lit("a").alias("kind"), F.col("id").alias("owner"), F.lit("x").alias("name"))
    tables.replace("one", rows, rows.select("owner"))
    one = tables.table("a", "owner long, name string")
    assert "Join" not in one._jdf.queryExecution().executedPlan().toString() and one.count() == 9
    some = rows.filter("owner < 3").withColumn("name", F.lit("y"))
    tables.replace("two", some, rows.filter("owner < 5").select("owner"))
    got = sorted(tuple(r) for r in tables.table("a", "owner long, name string").collect())
    assert got == [(i, "y") for i in range(3)] + [(i, "x") for i in range(5, 9)]


class Handle:
    """A state handle in memory that counts calls."""

    def __init__(self):
        self.values, self.calls, self.timers = {}, 0, []

    def getValueState(self, name, schema):
        return State(self, name, None)

    def getListState(self, name, schema):
        return State(self, name, [])

    def registerTimer(self, at):
        self.timers.append(at)


class State:
    def __init__(self, handle, name, empty):
        self.handle, self.name, self.empty = handle, name, empty

    def get(self):
        self.handle.calls += 1
        return self.handle.values.get(self.name, self.empty)

    def update(self, value):
        self.handle.calls += 1
        self.handle.values[self.name] = value

    put = update

    def appendList(self, values):
        self.update([*self.get(), *values])

    def clear(self):
        self.handle.values.pop(self.name, None)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_calls_of_a_job_do_not_grow_with_its_events():
    """one timer and a few state calls for a job, however many events it has."""
    handle, states = Handle(), JobStates()
    states.init(handle)
    rows = pd.DataFrame([(i, i * 1000, "JOB_QUEUED", None) for i in range(500)], columns=["event_id", "at", "kind", "current"])
    told = next(states.handleInputRows((1,), iter([rows, rows]), Watermark(0)))
    assert told.moves[0] == 500 and handle.timers == [0] and handle.calls < 8
    told = next(states.handleExpiredTimer((1,), Watermark(99), None))
    assert told.moves[0] == 500 and handle.timers == [0, 100] and len(handle.values["pending"]) == 400 and handle.calls < 16


def test_pages_read_their_own_parts(tmp_path):
    """the number of rows is counted without holding them, and a worker counts once for all pages."""
    path = f"{tmp_path}/orders.parquet"
    pq.write_table(pa.table({"o_orderkey": pa.array(range(-50, 1000), pa.int64()), "o_orderstatus": [("O", "F", None)[i % 3] for i in range(1050)]}), path, row_group_size=100)
    want = [i for i in range(-50, 1000) if i % 2 == 1 and (i + 50) % 3 == 0]
    ask = lambda *at: served({"path": path}, {"status": "O"}, *at)
    before = _served_parts.cache_info().misses
    assert ask(None, None) == len(want)
    assert [r["id"] for at in range(0, len(want) + 30, 30) for r in ask(at, 30)] == want
    assert _served_parts.cache_info().misses == before + 1


def test_keys_that_look_like_years_and_phones(spark, tmp_path):
    """F5 to F8: keys of larger tables within the composed texts."""
    keys = [*range(1990, 2110), *range(100_000, 100_020), *range(5_000_000, 5_000_010)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("date_forms", "form_company", "form_quality", "phone_forms"):
        df = QUERIES[name](spark, f"file://{tmp_path}")
        found = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect()), name


def test_owners_of_equal_keys(spark, tmp_path):
    """customers and suppliers may have the same key in the result."""
    at = f"file://{tmp_path}"
    spark.sql("select 100001L c_custkey, 'c' c_name, 1d c_acctbal union all select 8L, 'd', 2d").coalesce(1).write.parquet(f"{at}/customer.parquet")
    spark.sql("select 1L s_suppkey, 's' s_name, 3d s_acctbal").write.parquet(f"{at}/supplier.parquet")
    spark.sql("select 8L o_custkey, 9d o_totalprice").write.parquet(f"{at}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["upsert_sink"](spark, at).select("owner", "name", "amount").collect())
    assert got == [(8, "changed", 9.0), (100001, "c", 1.0), (100001, "s", 3.0)]


def test_forms_are_shared_by_all_cores(spark):
    """F10, F11, F14 to F16, F18, F20: the rows of a file of one part are spread before the extractors."""
    assert "REPARTITION_BY_NUM" in QUERIES["form_projects"](spark, AT)._jdf.queryExecution().executedPlan().toString()


def test_new_links_in_blocks(spark):
    """lists of few ids, left ids with several keys, existing pairs; pairs themselves are in no exchange."""
    left = [(i, f"m{i % 4}") for i in range(12)] + [(1, "m2"), (1, "m1"), (20, None)]
    right = [(c, f"m{c % 3}") for c in range(30)] + [(3, "m2"), (99, None), (98, "m3")]
    old = [(i, c) for i in range(12) for c in range(30) if (i + c) % 4 == 0]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = K.new_links(frame(left, "id long, email string"), frame(right, "company int, email string"), "email", ["id", "company"], frame(old, "id long, company int"), block=3)
    several = lambda m: sum(e == m for _, e in right) > 1
    want = {(i, c, several(m)) for i, m in left for c, n in right if m is not None and m == n and (i, c) not in old}
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_parts_of_links_grow_with_them(big):
    """a part holds about so many links, whatever the session's number of partitions; pairs named twice and null keys as before."""
    pairs = {(i % 40, i // 40) for i in range(4000)}
    links = big.createDataFrame(pd.DataFrame(sorted(pairs) * 2, columns=["a", "b"])).unionByName(big.createDataFrame([(None, 1), (1, None), (99, 1), (1, 999)], "a long, b long"))
    left, right = big.range(40).select(F.col("id").alias("a"), F.concat(F.lit("x"), "id").alias("x")), big.range(100).select(F.col("id").alias("b"), F.concat(F.lit("y"), "id").alias("y"))
    rows = R.linked(left, links, right, "a", "b", block=500).select("a", "x", "b", "y", F.spark_partition_id().alias("part")).collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted((a, f"x{a}", b, f"y{b}") for a, b in pairs)
    assert len({r.part for r in rows}) > 4 == int(big.conf.get("spark.sql.shuffle.partitions"))


def test_links_are_not_gathered_before_a_shuffle(big):
    """pairs become distinct and suppliers are grouped where their links lie."""
    plan = QUERIES["link_table_join"](big, AT)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("HashAggregate") :]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "REPARTITION_BY_NUM" in below  # nothing is aggregated between the scan and its shuffle
    assert not re.search(r"hashpartitioning\(s_suppkey#\d+L, s_name", plan)
