"""Queries of traces, exports, artifacts, reference data and shown names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermill.functions import columns as C
from ledgermill.operators import links as K
from ledgermill.operators import quality as Q
from ledgermill.operators import relational as R
from ledgermill.operators import traces as T
from ledgermill.operators import versions as V
from ledgermill.sources import remote, templates
from ledgermill.sources.committed import CommittedTables
from ledgermill.sources.tables import scratch

from .registry import money, query

LISTS = """e AS (SELECT user_id AS k, count(*) AS n, string_agg(event_type || event_id, ',' ORDER BY ts, event_id) FILTER (r <= 20) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1),
  a AS (SELECT l_orderkey AS k, count(*) AS n, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (r <= 20) AS t FROM
    (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) GROUP BY 1)"""
_micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


@query(f"""WITH {LISTS} SELECT o_orderkey AS job, c_name AS file, n_name AS intake, coalesce(a.n, 0) AS n_artifacts, coalesce(a.t, '') AS artifacts, coalesce(e.n, 0) AS n_events, coalesce(e.t, '') AS events
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND o_orderkey % 3 > 0 LEFT JOIN a ON a.k = o_orderkey LEFT JOIN e ON e.k = o_orderkey""")
def job_trace(orders, customer, nation, lineitem, events):
    jobs = orders.select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") % 3 > 0).alias("taken"))
    files = jobs.join(customer.select("c_custkey", F.col("c_name").alias("file"), "c_nationkey"), "c_custkey", "left")
    whole = files.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("intake")), "c_nationkey", "left").withColumn("intake", F.when(F.col("taken"), F.col("intake")))
    artifacts = lineitem.withColumn("job", F.col("l_orderkey"))
    happened = events.withColumn("job", F.col("user_id"))
    found = T.joined_trace(whole, "job", {
        "artifacts": (artifacts, [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], F.col("l_partkey").cast("string")),
        "events": (happened, [_micros("ts"), F.col("event_id")], F.concat("event_type", F.col("event_id").cast("string"))),
    }, most=20)
    return found.select("job", "file", "intake", "n_artifacts", F.array_join("artifacts", ",").alias("artifacts"), "n_events", F.array_join("events", ",").alias("events"))


@query(f"""WITH {LISTS}, f AS (SELECT o_custkey AS k, count(*) AS n, string_agg(o_orderpriority || '=' || o_orderkey, ',' ORDER BY o_orderkey) FILTER (r <= 20) AS t FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1)
  SELECT c_custkey AS request, c_name AS name, coalesce(f.n, 0) AS n_fields, coalesce(f.t, '') AS fields, coalesce(a.n, 0) AS n_artifacts, coalesce(a.t, '') AS artifacts, coalesce(e.n, 0) AS n_events, coalesce(e.t, '') AS events
  FROM customer LEFT JOIN f ON f.k = c_custkey LEFT JOIN a ON a.k = c_custkey LEFT JOIN e ON e.k = c_custkey""")
def extraction_trace(customer, orders, lineitem, events):
    requests = customer.select(F.col("c_custkey").alias("request"), F.col("c_name").alias("name"))
    kinds = {
        "fields": (orders.withColumn("request", F.col("o_custkey")), [F.col("o_orderkey")], F.concat_ws("=", "o_orderpriority", F.col("o_orderkey").cast("string"))),
        "artifacts": (lineitem.withColumn("request", F.col("l_orderkey")), [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], F.col("l_partkey").cast("string")),
        "events": (events.withColumn("request", F.col("user_id")), [_micros("ts"), F.col("event_id")], F.concat("event_type", F.col("event_id").cast("string"))),
    }
    found = T.joined_trace(requests, "request", kinds, most=20)
    return found.select("request", "name", *[c for k in kinds for c in (F.col(f"n_{k}"), F.array_join(k, ",").alias(k))])


@query("""SELECT user_id AS batch, 'ALL' AS event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM events GROUP BY 1
  UNION ALL SELECT user_id, 'error', count(*), min(event_id), max(event_id) FROM events WHERE event_type = 'error' GROUP BY 1""")
def trace_export(spark, events):
    documents = None
    for kind, rows in (("ALL", events), ("error", events.filter("event_type = 'error'"))):
        at = scratch(spark, "report")
        grouped = rows.groupBy(F.col("user_id").alias("batchId")).agg(F.array_sort(F.collect_list("event_id")).alias("events"))
        templates.write_report(grouped, at, {"eventType": kind, "period": "all"}, F.lit("2024-01-01T00:00:00Z"))
        read = spark.read.schema("batchId long, filters struct<eventType:string,period:string>, generatedAt string, events array<long>").json(at)
        documents = read if documents is None else documents.unionByName(read)
    return documents.select(F.col("batchId").alias("batch"), F.col("filters.eventType").alias("event_type"), F.size("events").cast("long").alias("n"), F.get("events", F.lit(0)).alias("first_event"), F.element_at("events", -1).alias("last_event"))


@query("""SELECT doc_id AS request_id, 'RAW_TEXT' AS artifact_type, 1 AS artifact_version, md5(text) AS digest, NULL AS chars FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'NORMALIZED_JSON', 1, NULL, n_chars FROM documents""")
def artifact_sink(spark, documents):
    at = scratch(spark, "artifacts")
    rows = documents.select(F.col("doc_id").alias("request_id"), F.col("text").alias("raw_text"), F.to_json(F.struct("n_chars", "lang")).alias("payload"))
    templates.write_artifacts(rows, at)
    templates.write_artifacts(rows, at)  # once more in place of the first
    found = spark.read.schema("request_id long, artifact_version int, content_text string, content_json string, artifact_type string").parquet(at)
    return found.select("request_id", "artifact_type", "artifact_version", F.md5("content_text").alias("digest"), F.get_json_object("content_json", "$.n_chars").cast("long").alias("chars"))


@query("""WITH s AS (SELECT event_type AS provider, user_id % 5 AS model, min(value) AS price FROM events GROUP BY ALL), k AS (SELECT event_type AS provider, user_id % 5 AS model, max(value) AS price FROM events WHERE user_id % 2 = 0 GROUP BY ALL)
  SELECT coalesce(k.provider, s.provider) AS provider, coalesce(k.model, s.model) AS model, coalesce(k.price, s.price) AS kept, coalesce(s.price, k.price) AS renewed, CASE WHEN s.provider IS NULL THEN 'KEPT' WHEN k.provider IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action
  FROM s FULL JOIN k ON s.provider = k.provider AND s.model = k.model""")
def seed_upsert(events):
    key = [F.col("event_type").alias("provider"), (F.col("user_id") % 5).alias("model")]
    seeds, known = events.groupBy(*key).agg(F.min("value").alias("price")), events.filter("user_id % 2 = 0").groupBy(*key).agg(F.max("value").alias("price"))
    # prices and first prompts are only created, task settings renewed
    kept = V.merge_by_rules(known, seeds, ["provider", "model"], {"price": V.kept}).withColumnRenamed("price", "kept")
    return kept.join(V.merge_by_rules(known, seeds, ["provider", "model"], {"price": V.new}).drop("action").withColumnRenamed("price", "renewed"), ["provider", "model"])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Receita Líquida' WHEN 1 THEN 'Pesquisa Aplicada' WHEN 2 THEN 'Em preenchimento' WHEN 3 THEN 'Código Postal' ELSE o_orderpriority END AS label FROM orders""")
def shown_labels(orders):
    code = F.element_at(F.array(F.lit("net_revenue"), F.lit("PESQUISA_APLICADA"), F.lit("EM_PREENCHIMENTO"), F.lit("cod_postal"), F.col("o_orderpriority")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return orders.select("o_orderkey", C.mapped(code, Q.LABELS).alias("label"))


@query("""SELECT p_partkey, regexp_matches(lower(p_name), 'bolt|ring') AS has, p_partkey % 4 + 4 * (p_partkey % 3) AS indent, CASE WHEN p_partkey % 2 = 0 THEN printf('%.2f', p_retailprice::DECIMAL(18,2)::DOUBLE) ELSE '0.00' END AS amount_key,
  p_size || '/' || (2000 + p_size) || '/FORM/' || replace(p_brand, '#', '_') || ' x.pdf' AS path, 'pdf' AS ext, (1000 * p_size) || '_' || replace(p_brand, '#', '_') || '_x.PDF' AS stored, split_part(p_name, ' ', 1) AS first_keyword, length(p_name) - length(replace(p_name, ' ', '')) + 1 AS n_keywords FROM part""")
def text_helpers(part):
    key, name = F.col("p_partkey"), F.concat("p_brand", F.lit(" x.PDF"))
    indented = F.concat(F.repeat(F.lit("\t"), (key % 3).cast("int")), F.repeat(F.lit(" "), (key % 4).cast("int")), F.lit("x"))
    words = C.keywords(F.replace("p_name", F.lit(" "), F.lit("; ")))
    return part.select(
        "p_partkey", C.has(F.col("p_name"), "BOLT|ring").alias("has"), C.indent(indented).cast("long").alias("indent"), C.amount_key(F.when(key % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("n")).alias("amount_key"),
        C.target_path(F.col("p_size").cast("string"), 2000 + F.col("p_size"), F.regexp_replace(F.translate("p_brand", "#", "?"), "$", "  x")).alias("path"), C.extension(name).alias("ext"),
        C.storage_name(F.translate(name, "# ", "?*"), F.timestamp_seconds("p_size")).alias("stored"), F.get(words, F.lit(0)).alias("first_keyword"), F.size(words).cast("long").alias("n_keywords"),
    )


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 200")
def page_clamped(customer):
    """A page of more than the most rows, and before the first, is cut to what is allowed."""
    return R.page(customer.select("c_custkey", "c_name"), [F.col("c_custkey")], -3, 10_000)


@query("""WITH o AS (SELECT o_custkey AS file, o_orderstatus AS type, count(*) AS n FROM orders GROUP BY ALL), n AS (SELECT user_id AS file, CASE event_id % 2 WHEN 0 THEN 'O' ELSE 'F' END AS type, min(event_id) AS asked FROM events GROUP BY ALL)
  SELECT coalesce(o.file, n.file) AS file, coalesce(o.type, n.type) AS type, CASE WHEN n.file IS NULL THEN 'DONE' ELSE 'QUEUED' END AS status, CASE WHEN n.file IS NULL THEN o.n ELSE 1 END AS attempt, asked AS idempotency_key,
  CASE WHEN n.file IS NULL THEN 'KEPT' WHEN o.file IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action FROM o FULL JOIN n ON o.file = n.file AND o.type = n.type""")
def job_upsert(orders, events):
    known = orders.groupBy(F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("type")).agg(F.lit("DONE").alias("status"), F.count("*").alias("attempt"), F.lit(None).cast("long").alias("idempotency_key"))
    asked = events.groupBy(F.col("user_id").alias("file"), F.when(F.col("event_id") % 2 == 0, "O").otherwise("F").alias("type")).agg(F.min("event_id").alias("idempotency_key"))
    queued = asked.withColumns({"status": F.lit("QUEUED"), "attempt": F.lit(1).cast("long")})
    # a job of the same file and type is queued anew, from its first attempt
    return V.merge_by_rules(known, queued, ["file", "type"], {"status": V.new, "attempt": V.new, "idempotency_key": V.new})


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS closed, CASE WHEN c_custkey % 3 = 0 THEN 1.5 END AS t FROM customer WHERE c_custkey % 7 > 0), w AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0),
  h AS (SELECT o_custkey AS k, sum(o_totalprice::DECIMAL(18,2)) AS h FROM orders WHERE o_orderpriority < '3' GROUP BY 1), e AS (SELECT user_id AS k, sum(value::DECIMAL(18,2)) AS e FROM events WHERE event_type = 'purchase' GROUP BY 1),
  j AS (SELECT coalesce(s.k, w.k) AS k, s.k IS NOT NULL AS there, w.k IS NOT NULL AS asked, coalesce(closed, FALSE) AS closed, t FROM s FULL JOIN w ON s.k = w.k)
  SELECT j.k, closed OR (asked AND there) AS closed, CASE WHEN asked AND there AND NOT closed THEN coalesce(h, 0) ELSE t END::DOUBLE AS hr_total, CASE WHEN asked AND there AND NOT closed THEN coalesce(e, 0) ELSE t END::DOUBLE AS expense_total,
  CASE WHEN asked AND there AND NOT closed THEN coalesce(h, 0) + coalesce(e, 0) ELSE t END::DOUBLE AS total, CASE WHEN asked AND there AND NOT closed THEN 'CLOSED' WHEN asked AND there THEN 'REFUSED' WHEN asked THEN 'UNKNOWN' END AS result
  FROM j LEFT JOIN h ON h.k = j.k LEFT JOIN e ON e.k = j.k""")
def snapshot_close(customer, orders, events):
    closed = F.col("c_custkey") % 3 == 0
    old = F.when(closed, F.lit(1.5)).cast("decimal(18,2)")
    snapshots = customer.filter("c_custkey % 7 > 0").select(F.col("c_custkey").alias("k"), closed.alias("closed"), *[old.alias(n) for n in ("hr_total", "expense_total", "total")])
    wanted = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).unionByName(customer.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("k")))
    staff = orders.select(F.col("o_custkey").alias("k"), money("o_totalprice").alias("amount"), (F.col("o_orderpriority") < "3").alias("eligible"))
    spent = events.select(F.col("user_id").alias("k"), money("value").alias("amount"), (F.col("event_type") == "purchase").alias("eligible"))
    found = V.close_snapshots(snapshots, wanted, staff, spent, "k")
    return found.select("k", "closed", *[F.col(n).cast("double").alias(n) for n in ("hr_total", "expense_total", "total")], "result")


@query("""SELECT coalesce(c_custkey, s_suppkey + 100000) AS owner, coalesce(CASE WHEN o.k IS NOT NULL THEN 'changed' ELSE c_name END, s_name) AS name, CASE WHEN s_suppkey IS NOT NULL THEN s_acctbal ELSE coalesce(o.p, c_acctbal) END AS amount
  FROM customer FULL JOIN supplier ON FALSE LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS p FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) o ON o.k = c_custkey""")
def upsert_sink(spark, customer, supplier, orders):
    tables = CommittedTables(spark, scratch(spark, "sink"))
    # customers have the even owners, suppliers the odd ones, as their keys may be equal
    row = lambda df, key, name, amount, odd=0: df.select(F.lit("accounts").alias("kind"), (key.cast("long") * 2 + odd).alias("owner"), name.alias("name"), amount.alias("amount"))
    write = lambda run, rows: tables.replace(run, rows, rows.select("owner"))
    write("first", row(customer, F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal")))
    changed = orders.filter("o_custkey % 2 = 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("p"))
    new = row(changed, F.col("o_custkey"), F.lit("changed"), F.col("p")).unionByName(row(supplier, F.col("s_suppkey") + 100_000, F.col("s_name"), F.col("s_acctbal"), odd=1))
    write("second", new)
    return tables.table("accounts", "owner long, name string, amount double").withColumn("owner", F.shiftright("owner", 1))


@query("""SELECT user_id AS file, 'FILE_REGISTERED' AS event_type, min(event_id) AS first_event, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT user_id, 'FILE_REUSED', min(event_id), count(*) FROM events WHERE event_type = 'click' GROUP BY 1""")
def event_log(spark, events):
    """Events are appended to a log by runs, a folder a day, and read again."""
    at = scratch(spark, "log")
    for kind, label in (("view", "FILE_REGISTERED"), ("click", "FILE_REUSED")):
        rows = events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("file"), F.lit(label).alias("event_type"), F.col("event_id"), F.to_json(F.struct("value")).alias("payload"), C.date_folder(F.col("ts")).alias("day"))
        rows.write.mode("append").partitionBy("day").parquet(at)
    return spark.read.parquet(at).groupBy("file", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderkey % 4 > 0")
def filter_not_in_not_null(orders):
    notes = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))
    return orders.filter(R.differs(notes, "1-URGENT", "2-HIGH", "5-LOW")).select("o_orderkey")


@query("""SELECT user_id AS batch, 'waiting' AS state, count(*) AS jobs FROM events WHERE event_type = 'signup' GROUP BY 1 UNION ALL SELECT user_id, 'active', count(*) FROM events WHERE event_type = 'view' GROUP BY 1""")
def waiting_and_active(events):
    queue = lambda kind, state: events.filter(F.col("event_type") == kind).select(F.col("user_id").alias("batch"), F.lit(state).alias("state"))
    return queue("signup", "waiting").unionByName(queue("view", "active")).groupBy("batch", "state").agg(F.count("*").alias("jobs"))


@query("""WITH b AS (SELECT DISTINCT o_custkey AS n, 'said ' || o_custkey AS said FROM orders WHERE o_orderkey % 2 = 0)
  SELECT lpad(n::VARCHAR, 14, '0') AS cnpj, CASE WHEN s_suppkey IS NOT NULL THEN s_name WHEN c_custkey % 4 > 0 THEN c_name WHEN n % 3 > 0 THEN said ELSE 'Empresa ' || lpad(n::VARCHAR, 14, '0') END AS legal_name, s_suppkey IS NULL AS created, 'PENDING_REVIEW' AS status
  FROM b LEFT JOIN supplier ON s_suppkey = n LEFT JOIN customer ON c_custkey = n""")
def company_registration(spark, sf_dir, orders, supplier):
    """Companies of batches by their id: a known one, else what the registry says, else the name in the form, else one made of the id."""
    path = f"{sf_dir}/customer.parquet"

    def registry(keys: list) -> dict:
        import pyarrow.dataset as ds

        found = ds.dataset(path).to_table(columns=["c_custkey", "c_name"], filter=ds.field("c_custkey").isin([int(k) for k in keys])).to_pylist()
        return {f"{r['c_custkey']:014}": {"nome": r["c_name"]} for r in found if r["c_custkey"] % 4 > 0}

    asked = orders.filter("o_orderkey % 2 = 0").select(C.company_id(F.col("o_custkey").cast("string")).alias("cnpj"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("said "), F.col("o_custkey").cast("string"))).alias("said")).distinct()
    known = supplier.select(C.company_id(F.col("s_suppkey").cast("string")).alias("cnpj"), F.col("s_name").alias("known"))
    rows = asked.join(known, "cnpj", "left")
    told = remote.looked_up(rows.filter("known is null"), "cnpj", registry, "answer", scratch(spark, "registry"), batch=1000)
    new = told.select("cnpj", F.coalesce(F.get_json_object("answer", "$.nome"), "said", F.concat(F.lit("Empresa "), F.col("cnpj"))).alias("legal_name"), F.lit(True).alias("created"))
    return rows.filter("known is not null").select("cnpj", F.col("known").alias("legal_name"), F.lit(False).alias("created")).unionByName(new).withColumn("status", F.lit("PENDING_REVIEW"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%m%Y') AS raw, strftime(o_orderdate, '%Y-%m') || '-01' AS mmyyyy, strftime(o_orderdate, '%Y-%m') || '-01' AS yyyy_mm, o_orderpriority AS trimmed, ' ' || o_orderpriority || ' ' AS none FROM orders""")
def date_transforms(orders):
    at, padded = F.col("o_orderdate"), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))
    raw = F.date_format(at, "MMyyyy")
    return orders.select("o_orderkey", raw.alias("raw"), K.transformed(raw, "DATE_MMYYYY").alias("mmyyyy"), K.transformed(F.date_format(at, "yyyy-MM"), "DATE_YYYY_MM").alias("yyyy_mm"), K.transformed(padded, "TRIM").alias("trimmed"), K.transformed(padded, "NONE").alias("none"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey AS at_, CASE o_orderkey % 5 WHEN 0 THEN 'DELETE' WHEN 1 THEN 'CREATE' ELSE 'UPDATE' END AS op, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS amount FROM orders),
  r AS (SELECT c_custkey AS k, -1 AS at_, 'CREATE' AS op, c_name AS title, c_acctbal AS amount, TRUE AS old FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT *, FALSE FROM (SELECT k, at_, op, title, amount FROM o)),
  b AS (SELECT k, arg_max(op, at_) AS op, max(at_) AS born, arg_max(old, at_) AS old FROM r WHERE op <> 'UPDATE' GROUP BY 1)
  SELECT r.k, CASE WHEN b.old THEN arg_max(title, at_) ELSE coalesce(arg_max(title, at_), 'Sem titulo') END AS title, arg_max(amount, at_) AS amount FROM r JOIN b ON b.k = r.k AND b.op = 'CREATE' AND at_ >= born GROUP BY r.k, b.old""")
def project_changes(customer, orders):
    base = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("amount"))
    key = F.col("o_orderkey")
    op = F.when(key % 5 == 0, "DELETE").when(key % 5 == 1, "CREATE").otherwise("UPDATE")
    operations = orders.select(F.col("o_custkey").alias("k"), op.alias("op"), F.when(key % 3 > 0, F.col("o_orderpriority")).alias("title"), F.when(key % 2 == 0, F.col("o_totalprice")).alias("amount"), key.alias("at"))
    return V.apply_operations(base, operations, "k", ["title", "amount"], "at", {"title": F.lit("Sem titulo")})
