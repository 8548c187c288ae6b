"""Job states as a stream of several batches, and forms that are shredded into tables that become visible together."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgermill.operators import shredding as S
from ledgermill.sources.committed import CommittedTables
from ledgermill.streaming.jobs import JobStream, job_states

EVENTS = "job long, event_id long, ts timestamp, kind string, current long"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


#: Worked out by hand from the rules: three attempts, five seconds between them, pause and resume, refused moves.
JOBS = {
    1: ([(0, "JOB_QUEUED"), (1, "JOB_STARTED"), (2, "JOB_PROGRESS"), (3, "JOB_COMPLETED"), (4, "JOB_FAILED")], ("DONE", "DONE", 1, 4, 1)),
    2: ([(0, "JOB_STARTED"), (1, "JOB_QUEUED"), (2, "JOB_STARTED"), (3, "JOB_FAILED"), (5, "JOB_STARTED")], ("QUEUED", "QUEUED", 2, 4, 2)),
    3: ([(0, "JOB_QUEUED"), (1, "JOB_STARTED"), (2, "JOB_FAILED"), (8, "JOB_STARTED"), (9, "JOB_FAILED"), (15, "JOB_STARTED"), (16, "JOB_FAILED"), (17, "JOB_STARTED")], ("ERROR", "ERROR", 3, 9, 1)),
    4: ([(0, "JOB_QUEUED"), (1, "PAUSED"), (2, "JOB_STARTED"), (3, "RESUMED"), (4, "JOB_STARTED"), (5, "PAUSED")], ("PAUSED", "PROCESSING", 1, 5, 1)),
    5: ([(0, "JOB_QUEUED"), (1, "JOB_STARTED"), (2, "JOB_FAILED"), (3, "PAUSED"), (9, "RESUMED"), (10, "RETRIED")], ("QUEUED", "QUEUED", 1, 5, 1)),
}


def told(states):
    return {r.job: (r.status, r.intake_status, r.attempt, r.moves, r.rejected) for r in states.collect()}


def test_job_states_by_hand(spark):
    rows = [(job, 100 * job + i, at(s), kind, 7) for job, (events, _) in JOBS.items() for i, (s, kind) in enumerate(events)]
    events = spark.createDataFrame(rows + rows[:9], EVENTS)
    assert told(job_states(events, F.lit(at(10_000)))) == {job: want for job, (_, want) in JOBS.items()}
    # before the wait is over the failed attempt stands
    assert told(job_states(events.filter("job = 2 and ts <= timestamp'2024-01-01 00:00:03'"), F.lit(at(4))))[2] == ("DELAYED", "ERROR", 2, 3, 1)
    assert job_states(events.limit(0), F.lit(START)).count() == 0


def test_stream_of_several_batches(spark, tmp_path):
    """Events out of order within the delay, repeated ones in later batches, and one that comes too late."""
    rng, rows = random.Random(3), []
    kinds = ["JOB_QUEUED", "JOB_STARTED", "JOB_PROGRESS", "JOB_COMPLETED", "JOB_FAILED", "JOB_FAILED", "PAUSED", "RESUMED", "RETRIED", "JOB_STARTED"]
    for i in range(400):
        rows.append((rng.randrange(8), i, at(i * 3 + rng.random()), rng.choice(kinds), i))
    order = sorted(rows, key=lambda r: r[2] + datetime.timedelta(seconds=rng.random() * 50))
    batches = [order[i : i + 100] + rng.sample(order[max(0, i - 10) : i + 1], min(i, 8)) for i in range(0, 400, 100)]
    late = (1, 9_999, at(1), "JOB_QUEUED", 0)
    batches[-1].append(late)
    folder = f"{tmp_path}/in"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/b={i}")
        time.sleep(0.05)
    stream = JobStream(spark, f"file://{tmp_path}/jobs")
    source = spark.readStream.schema(EVENTS + ", b int").option("maxFilesPerTrigger", 1).parquet(folder).drop("b")
    query = stream.run(source, "60 seconds")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == len(batches)
    end = max(r[2] for r in rows) - datetime.timedelta(seconds=60)
    want = job_states(spark.createDataFrame(rows, EVENTS), F.lit(end)).collect()
    assert sorted(stream.states().collect()) == sorted(want)
    # more events go on from the kept states
    more = [(r[0], 1000 + i, r[2] + datetime.timedelta(seconds=2000), r[3], 5) for i, r in enumerate(rows[:60])]
    spark.createDataFrame(more, EVENTS).coalesce(1).write.parquet(f"{folder}/b=9")
    stream.run(source, "60 seconds").awaitTermination()
    end = max(r[2] for r in more) - datetime.timedelta(seconds=60)
    assert sorted(stream.states().collect()) == sorted(job_states(spark.createDataFrame(rows + more, EVENTS), F.lit(end)).collect())


def test_polling(spark, tmp_path):
    """With a processing time the stream goes on by itself."""
    folder = f"{tmp_path}/in"
    write = lambda i, rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)
    write(0, [(1, 1, at(0), "JOB_QUEUED", 0)])
    stream = JobStream(spark, f"file://{tmp_path}/jobs")
    query = stream.run(spark.readStream.schema(EVENTS).parquet(folder), "10 seconds", every="1 second")
    try:
        query.processAllAvailable()
        assert told(stream.states())[1][0] == "QUEUED"
        write(1, [(1, 2, at(1), "JOB_STARTED", 0)])
        query.processAllAvailable()
        assert told(stream.states())[1][0] == "PROCESSING"
    finally:
        query.stop()


# forms


def project(title, expenses=(), staff=(), equipment=(), **more):
    return {"title": title, "human_resources": list(staff), "expenses": [dict(zip(("category", "description", "amount"), e, strict=True)) for e in expenses], "equipment": list(equipment), **more}


BATCHES = [(1, 10), (2, None), (3, 10), (4, None), (5, 77), (6, 11)]
DOCUMENTS = {
    1: {"form_data": {"fiscal_year": 2022, "projects": [project("One", [("Material", "a", "10,00"), ("material", " A ", "10"), ("x", None, "0")], [{"name": " Ana ", "cpf": "1-2", "dedication_type": "EXCLUSIVA"}, {"name": " "}]), None, project("", start_date="3/4/2024")]}},
    2: {"fiscal_year": "2022", "company_id": 10, "projects": [project("Old")]},
    3: {"form_data": {"projects": [project("No year")]}},
    5: {"form_data": {"fiscal_year": 2022, "projects": [project("No form")]}},
    6: {"form_data": {"fiscal_year": 2021, "projects": [project("E", equipment=[{"origin": "Importado", "amount": "1.000,00", "quantity": "3 un"}, {"amount": "0"}])]}},
}
FORMS = [(100, 10, 2022, "X"), (101, 10, 2022, "X"), (200, 11, 2021, "X")]


@pytest.fixture
def given(spark):
    items = [(b, 10 * b, json.dumps(d)) for b, d in DOCUMENTS.items()] + [(1, 11, "{}")]
    return spark.createDataFrame(BATCHES, "batch_id long, company_id long"), spark.createDataFrame(items, "batch_id long, item_id long, record_data string"), spark.createDataFrame(FORMS, "form_id long, company_id long, base_year int, status string")


def rows_of(tables, kind):
    return sorted(tuple(r) for r in tables.table(kind, S.SCHEMAS[kind]).select("owner", "project", *{"projects": ["title", "start_date"], "staff": ["name", "cpf", "is_exclusive_researcher"], "expenses": ["expense_category", "description", "amount"], "equipment": ["origin", "quantity", "total_amount"]}[kind]).collect())


def test_forms_from_batches(given):
    got = {r.batch_id: (r.form_id, r.skipped) for r in S.resolve_forms(*given).collect()}
    assert got == {1: (101, None), 2: (101, None), 3: (None, "NO_COMPANY_OR_YEAR"), 4: (None, "NO_ITEM"), 5: (None, "NO_FORM"), 6: (200, None)}


def test_backfill_modes(spark, given, tmp_path):
    tables, resolved = CommittedTables(spark, f"file://{tmp_path}/t"), S.resolve_forms(*given)
    applies = lambda rows: {r.batch_id for r in rows.collect() if r.applies}
    assert applies(S.backfill(tables, resolved, "dry", apply=False)) == {1, 6} and tables.runs() == [] and rows_of(tables, "projects") == []
    assert applies(S.backfill(tables, resolved, "newest", limit=1)) == {6} and [r[2] for r in rows_of(tables, "projects")] == ["E"]
    assert applies(S.backfill(tables, resolved, "single", batch_id=2)) == {2} and [r[2] for r in rows_of(tables, "projects")] == ["Old", "E"]
    S.backfill(tables, resolved, "all")
    assert rows_of(tables, "projects") == [(101, 1, "One", None), (101, 3, "Projeto sem titulo", datetime.date(2024, 4, 3)), (200, 1, "E", None)]
    assert [r[:5] for r in rows_of(tables, "staff")] == [(101, 1, "Ana", "12", True)]
    assert [float(r[4]) for r in rows_of(tables, "expenses")] == [10.0, 10.0]
    assert [(r[0], r[2], r[3], float(r[4])) for r in rows_of(tables, "equipment")] == [(200, "IMPORTADO", 3, 1000.0)]


def test_broken_off_runs(spark, given, tmp_path):
    """What was staged without a commit isn't seen; the repeated run leaves what one run leaves; a committed run isn't done again."""
    resolved = S.resolve_forms(*given)
    once, tables = (CommittedTables(spark, f"file://{tmp_path}/{n}") for n in ("once", "broken"))
    for t in (once, tables):
        S.backfill(t, resolved, "old", batch_id=2)
    S.backfill(once, resolved, "all")
    before = [rows_of(tables, k) for k in S.SCHEMAS]
    tables.stage("all", S.shred(resolved.filter("batch_id = 6"), False))
    (tmp_path / "broken/manifest/_draft-all").write_text("")
    assert [rows_of(tables, k) for k in S.SCHEMAS] == before and tables.runs() == ["old"]
    S.backfill(tables, resolved, "all")
    after = [rows_of(once, k) for k in S.SCHEMAS]
    assert [rows_of(tables, k) for k in S.SCHEMAS] == after and tables.runs() == ["old", "all"]
    S.backfill(tables, resolved.filter("batch_id = 2"), "all")
    assert [rows_of(tables, k) for k in S.SCHEMAS] == after
    tables.compact("compact", S.SCHEMAS)
    assert [rows_of(tables, k) for k in S.SCHEMAS] == after and tables.runs()[-1] == "compact"


def test_approval(spark, given, tmp_path):
    tables = CommittedTables(spark, f"file://{tmp_path}/t")
    forms, statuses, incentives = S.approve(tables, *given, "first", as_of_year=2024)
    got = {(r.company_id, r.base_year): (r.form_id, r.status) for r in forms.collect() if r.form_id != 100}
    assert {k: v[1] for k, v in got.items()} == {(10, 2022): "EM_PREENCHIMENTO", (11, 2021): "EM_PREENCHIMENTO", (10, 2023): "EM_PREENCHIMENTO", (77, 2022): "EM_PREENCHIMENTO"}
    assert {r.batch_id: r.status for r in statuses.collect()} == {1: "APPROVED", 2: "APPROVED", 3: "APPROVED", 4: None, 5: "APPROVED", 6: "APPROVED"}
    assert len({v[0] for v in got.values()}) == 4 and incentives.count() == 4
    # an approval counts a repeated expense once
    assert [float(r[4]) for r in rows_of(tables, "expenses")] == [10.0]
