"""Queries of approvals, backfills and job states over forms and events that Spark derives from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import columns as C
from ledgermill.operators import shredding as S
from ledgermill.sources.committed import CommittedTables
from ledgermill.sources.tables import scratch
from ledgermill.streaming import jobs as J

from .registry import money, query

KINDS = {"signup": "JOB_QUEUED", "view": "JOB_STARTED", "click": "JOB_PROGRESS", "purchase": "JOB_COMPLETED", "error": "JOB_FAILED"}


def job_events(events):
    told = F.when(F.col("event_id") % 11 == 0, "PAUSED").when(F.col("event_id") % 11 == 1, "RESUMED").when(F.col("event_id") % 11 == 2, "RETRIED")
    return events.select(F.col("user_id").alias("job"), "event_id", "ts", F.coalesce(told, C.mapped(F.col("event_type"), KINDS)).alias("kind"), F.floor("value").alias("current"))


#: The states by an own fold: a step for each event of all jobs at once.
JOB_SQL = """WITH RECURSIVE e AS (SELECT user_id AS job, event_id, epoch_us(ts) AS us, CASE event_id % 11 WHEN 0 THEN 'PAUSED' WHEN 1 THEN 'RESUMED' WHEN 2 THEN 'RETRIED' ELSE
    CASE event_type WHEN 'signup' THEN 'JOB_QUEUED' WHEN 'view' THEN 'JOB_STARTED' WHEN 'click' THEN 'JOB_PROGRESS' WHEN 'purchase' THEN 'JOB_COMPLETED' WHEN 'error' THEN 'JOB_FAILED' ELSE event_type END END AS kind,
    floor(value)::BIGINT AS cur, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
  s AS (
    SELECT DISTINCT job, 0::BIGINT AS r, NULL::VARCHAR AS status, NULL::VARCHAR AS intake, 0 AS attempt, NULL::BIGINT AS retry_at, 0::BIGINT AS progress, 0::BIGINT AS moves, 0::BIGINT AS rejected, NULL::BIGINT AS last_event FROM e
    UNION ALL
    SELECT job, r, coalesce(nxt, status), CASE coalesce(nxt, status) WHEN 'DELAYED' THEN 'ERROR' WHEN 'PAUSED' THEN intake ELSE coalesce(nxt, intake) END,
      CASE WHEN nxt = 'QUEUED' THEN 1 WHEN nxt = 'DELAYED' THEN attempt + 1 ELSE attempt END, CASE WHEN nxt = 'DELAYED' THEN us + 5000000 WHEN nxt IS NULL THEN retry_at END,
      CASE WHEN nxt = 'QUEUED' THEN 0 WHEN kind = 'JOB_PROGRESS' AND nxt IS NOT NULL THEN cur ELSE progress END, moves + (nxt IS NOT NULL)::INT, rejected + (nxt IS NULL)::INT, event_id
    FROM (SELECT *, CASE
        WHEN kind = 'JOB_QUEUED' OR (kind = 'RESUMED' AND status = 'PAUSED') OR (kind = 'RETRIED' AND status = 'ERROR') THEN 'QUEUED'
        WHEN kind = 'PAUSED' AND status IN ('QUEUED', 'PROCESSING', 'DELAYED') THEN 'PAUSED' WHEN kind = 'JOB_STARTED' AND status = 'QUEUED' THEN 'PROCESSING'
        WHEN status = 'PROCESSING' THEN CASE kind WHEN 'JOB_PROGRESS' THEN 'PROCESSING' WHEN 'JOB_COMPLETED' THEN 'DONE' WHEN 'JOB_FAILED' THEN CASE WHEN attempt < 3 THEN 'DELAYED' ELSE 'ERROR' END END END AS nxt
      FROM (SELECT e.job, e.r, e.event_id, e.kind, e.us, e.cur, CASE WHEN s.status = 'DELAYED' AND s.retry_at <= e.us THEN 'QUEUED' ELSE s.status END AS status,
        CASE WHEN s.status = 'DELAYED' AND s.retry_at <= e.us THEN 'QUEUED' ELSE s.intake END AS intake, s.attempt, CASE WHEN s.status = 'DELAYED' AND s.retry_at <= e.us THEN NULL ELSE s.retry_at END AS retry_at,
        s.progress, s.moves + (s.status IS NOT DISTINCT FROM 'DELAYED' AND s.retry_at <= e.us)::INT AS moves, s.rejected FROM s JOIN e ON e.job = s.job AND e.r = s.r + 1))),
  ends AS (SELECT s.*, status IS NOT DISTINCT FROM 'DELAYED' AND retry_at <= (SELECT max(us) FROM e) - 600000000 AS due FROM s WHERE r = (SELECT max(r) FROM e WHERE e.job = s.job))
  SELECT job, CASE WHEN due THEN 'QUEUED' ELSE status END AS status, CASE WHEN due THEN 'QUEUED' ELSE intake END AS intake_status, attempt, CASE WHEN NOT due THEN retry_at END AS retry_at, progress, moves + due::INT AS moves, rejected, last_event FROM ends"""


def _shown(states):
    return states.withColumn("retry_at", F.unix_micros("retry_at"))


@query(JOB_SQL)
def job_state_fold(events):
    end = events.agg(F.max("ts")).first()[0]
    return _shown(J.job_states(job_events(events), F.lit(end).cast("timestamp") - F.make_interval(mins=F.lit(10))))


@query(JOB_SQL)
def job_state_stream(spark, sf_dir):
    only = {"pathGlobFilter": "events.parquet"}
    schema = spark.read.options(**only).parquet(sf_dir).schema
    stream = J.JobStream(spark)
    stream.run(job_events(spark.readStream.schema(schema).options(**only).parquet(sf_dir)), "10 minutes").awaitTermination()
    return _shown(stream.states())


# forms --------------------------------------------------------------------------------------------------------------------------------


def batches_of(orders):
    """A batch an order; every fifth one names no company itself, and of these every second one names it in its document."""
    return orders.select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey")).alias("company_id"))


def items_of(orders, lineitem):
    """The documents of the batches: a project a line, in the order of the lines, with its staff, expenses and equipment."""
    text = lambda c: c.cast("string")
    cents = lambda c: c.cast("decimal(18,2)")

    def project(x):
        staff = F.array(
            F.struct(F.concat(F.lit(" Ana "), text(x["l_suppkey"])).alias("name"), F.concat(F.lit("123.456-"), text(x["l_suppkey"])).alias("cpf"), F.when(x["l_returnflag"] == "R", "Exclusiva").otherwise("Parcial").alias("dedication_type"), C.money_shown(cents(x["l_extendedprice"])).alias("annual_amount")),
            F.struct(F.lit("  ").alias("name"), F.lit(None).cast("string").alias("cpf"), F.lit(None).cast("string").alias("dedication_type"), F.lit("1").alias("annual_amount")),
        )
        spent = F.struct(F.lit("Material de consumo").alias("category"), F.lit("D").alias("description"), text(cents(x["l_quantity"])).alias("amount"))
        expenses = F.array(spent, F.struct(F.lit("Outros").alias("category"), F.lit(None).cast("string").alias("description"), F.lit("0,00").alias("amount")), spent, F.struct(F.lit("TIB").alias("category"), F.lit("").alias("description"), F.lit("R$ 1.000,5").alias("amount")))
        equipment = F.array(F.struct(F.when(x["l_linestatus"] == "O", "importado").alias("origin"), F.lit("2 un").alias("quantity"), text((x["l_tax"] * 100).cast("int")).alias("amount")))
        title = F.when(x["l_linenumber"] % 3 > 0, F.concat(F.lit(" P"), text(x["l_linenumber"]))).otherwise(" ")
        return F.struct(*[x[n].alias(n) for n in line[:4]], title.alias("title"), F.date_format(x["l_shipdate"], "d/M/yyyy").alias("start_date"), staff.alias("human_resources"), expenses.alias("expenses"), equipment.alias("equipment"))

    # lines are gathered as they are; documents are composed where they lie
    line = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_returnflag", "l_quantity", "l_linestatus", "l_tax"]
    lists = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(*line)).alias("lines"))
    form = F.struct(F.when(F.col("o_orderkey") % 7 > 0, F.year("o_orderdate")).alias("fiscal_year"), F.transform(F.array_sort("lines"), project).alias("projects"), F.struct(F.col("o_totalprice").alias("total_benefit_requested"), F.col("o_custkey").alias("total_rnd_expenditure")).alias("fiscal_summary"))
    record = F.to_json(F.struct(form.alias("form_data"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_custkey")).alias("company_id")))
    first = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    items = orders.join(lists, "o_orderkey").select("*", F.explode(first).alias("_n"))
    return items.select(F.col("o_orderkey").alias("batch_id"), (F.col("o_orderkey") * 2 + F.col("_n")).alias("item_id"), F.when(F.col("_n") == 0, record).otherwise("{}").alias("record_data"))


def forms_of(orders):
    known = orders.filter("o_custkey % 4 > 0")
    return known.select(F.col("o_orderkey").alias("form_id"), F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("base_year"), F.lit("ENVIADO").alias("status"))


RESOLVED = """i AS (SELECT DISTINCT l_orderkey FROM lineitem), f AS (SELECT o_custkey AS company, year(o_orderdate) AS y, max(o_orderkey) AS form_id FROM orders WHERE o_custkey % 4 > 0 GROUP BY ALL),
  b AS (SELECT o_orderkey AS batch_id, l_orderkey IS NULL AS none, o_totalprice, o_custkey, CASE WHEN o_orderkey % 5 > 0 OR (o_orderkey % 10 = 0 AND l_orderkey IS NOT NULL) THEN o_custkey END AS company, CASE WHEN o_orderkey % 7 > 0 AND l_orderkey IS NOT NULL THEN year(o_orderdate) END AS y
    FROM orders LEFT JOIN i ON l_orderkey = o_orderkey),
  r AS (SELECT b.*, form_id, CASE WHEN none THEN 'NO_ITEM' WHEN b.company IS NULL OR b.y IS NULL THEN 'NO_COMPANY_OR_YEAR' WHEN form_id IS NULL THEN 'NO_FORM' END AS skipped FROM b LEFT JOIN f ON f.company = b.company AND f.y = b.y),
  w AS (SELECT form_id, min(batch_id) AS batch_id FROM r WHERE skipped IS NULL GROUP BY 1)"""
#: Rows of the four tables: of each project by its form (g), the place of its line, and what is told of it.
ROWS = """p AS (SELECT g.form_id, l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS project FROM g JOIN lineitem l ON l_orderkey = g.batch_id),
  t AS (SELECT 'projects' AS kind, form_id, project, NULL AS n, CASE WHEN l_linenumber % 3 > 0 THEN 'P' || l_linenumber ELSE 'Projeto sem titulo' END || ' ' || l_shipdate::DATE AS label, NULL AS amount FROM p
    UNION ALL SELECT 'staff', form_id, project, 1, 'Ana ' || l_suppkey || ' 123456' || l_suppkey || ' ' || (l_returnflag = 'R'), l_extendedprice FROM p
    UNION ALL SELECT 'expenses', form_id, project, 1, 'MATERIAL_CONSUMO D', l_quantity FROM p WHERE l_quantity > 0
    UNION ALL SELECT 'expenses', form_id, project, 2, 'MATERIAL_CONSUMO D', l_quantity FROM p WHERE l_quantity > 0 AND {again}
    UNION ALL SELECT 'expenses', form_id, project, CASE WHEN {again} THEN 3 ELSE 2 END - (l_quantity <= 0)::INT * CASE WHEN {again} THEN 2 ELSE 1 END, 'TIB TIB', 1000.5 FROM p
    UNION ALL SELECT 'equipment', form_id, project, 1, CASE WHEN l_linestatus = 'O' THEN 'IMPORTADO' ELSE 'NACIONAL' END || ' Equipamento 2', (l_tax * 100)::DECIMAL(18,6)::INT FROM p WHERE trunc((l_tax * 100)::DECIMAL(18,6)) > 0)
  SELECT kind, form_id AS owner, project::INT AS project, n::INT AS n, label, amount::DECIMAL(18,2)::DOUBLE AS amount FROM t"""


def _told(tables):
    """kind, owner, project, n, label and amount of the visible rows."""
    of = lambda kind: tables.table(kind, S.SCHEMAS[kind])
    told = lambda df, kind, n, label, amount: df.select(F.lit(kind).alias("kind"), "owner", "project", n.cast("int").alias("n"), label.alias("label"), amount.cast("double").alias("amount"))
    words = lambda *names: F.concat_ws(" ", *[F.col(x).cast("string") for x in names])
    none = F.lit(None)
    return (
        told(of("projects"), "projects", none, words("title", "start_date"), none)
        .unionByName(told(of("staff"), "staff", F.col("n"), words("name", "cpf", "is_exclusive_researcher"), F.col("annual_amount")))
        .unionByName(told(of("expenses"), "expenses", F.col("n"), words("expense_category", "description"), F.col("amount")))
        .unionByName(told(of("equipment"), "equipment", F.col("n"), words("origin", "description", "quantity"), F.col("total_amount")))
    )


@query(f"WITH {RESOLVED}, g AS (SELECT * FROM w), " + ROWS.format(again="TRUE"))
def form_backfill(spark, orders, lineitem):
    tables = CommittedTables(spark, scratch(spark, "forms"))
    items = items_of(orders, lineitem)
    placed = S.place_forms(batches_of(orders), items, forms_of(orders))
    S.backfill(tables, placed, "old", batch_id=1, items=items)
    S.backfill(tables, placed, "all", items=items)
    S.backfill(tables, placed.filter("batch_id < 0"), "all", items=items)
    return _told(tables)


@query(f"WITH {RESOLVED} SELECT r.batch_id, r.form_id, skipped, CASE WHEN none THEN 0 ELSE (SELECT count(*) FROM lineitem WHERE l_orderkey = r.batch_id) END::INT AS projects, skipped IS NULL AND r.batch_id = w.batch_id AS applies FROM r LEFT JOIN w ON w.form_id = r.form_id")
def form_backfill_plan(spark, orders, lineitem):
    placed = S.place_forms(batches_of(orders), items_of(orders, lineitem), forms_of(orders))
    return S.backfill(CommittedTables(spark, scratch(spark, "forms")), placed, "dry", apply=False)


#: What an approval leaves: forms by company and year, new ones without their ids.
APPROVED = """a AS (SELECT batch_id, company, coalesce(y, 2023) AS y, o_totalprice, o_custkey FROM b WHERE NOT none AND company IS NOT NULL)"""


@query(f"WITH {RESOLVED}, {APPROVED}, k AS (SELECT company, y, max(form_id) AS form_id FROM f GROUP BY ALL), q AS (SELECT a.company, a.y, min(batch_id) AS batch_id FROM a GROUP BY ALL), g AS (SELECT q.company * 10000 + q.y AS form_id, batch_id FROM q), " + ROWS.format(again="FALSE"))
def approved_forms(spark, orders, lineitem):
    tables = CommittedTables(spark, scratch(spark, "forms"))
    forms, _, _ = S.approve(tables, batches_of(orders), items_of(orders, lineitem), forms_of(orders), "first", as_of_year=2024)
    place = forms.select(F.col("form_id").alias("owner"), (F.col("company_id") * 10000 + F.col("base_year")).alias("at"))
    return _told(tables).join(place.hint("shuffle_hash"), "owner").drop("owner").withColumnRenamed("at", "owner")


@query(f"""WITH {RESOLVED}, {APPROVED}, t AS (SELECT company, y, arg_min(o_totalprice, batch_id) AS benefit, arg_min(o_custkey, batch_id) AS spent FROM a GROUP BY ALL)
  SELECT t.company AS company_id, t.y AS base_year, 'EM_PREENCHIMENTO' AS status, f.form_id IS NULL AS created, benefit AS total_benefit, spent::DOUBLE AS total_rnd_expenditure FROM t LEFT JOIN f ON f.company = t.company AND f.y = t.y""")
def approved_incentives(spark, orders, lineitem):
    tables = CommittedTables(spark, scratch(spark, "forms"))
    known = forms_of(orders)
    forms, _, incentives = S.approve(tables, batches_of(orders), items_of(orders, lineitem), known, "first", as_of_year=2024)
    old = known.select("form_id").withColumn("_old", F.lit(True))
    rows = incentives.join(forms, "form_id").join(old, "form_id", "left")
    return rows.select("company_id", "base_year", "status", F.col("_old").isNull().alias("created"), "total_benefit", "total_rnd_expenditure")
