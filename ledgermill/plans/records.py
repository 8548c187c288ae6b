"""Queries of entities and links, imports, traces and reference data over the driver's tables."""

from __future__ import annotations

import functools
import os

import pandas as pd
from pyspark.sql import functions as F

from ledgermill.functions import columns as C
from ledgermill.operators import links as K
from ledgermill.operators import merge as M
from ledgermill.operators import relational as R
from ledgermill.operators import traces as T
from ledgermill.operators import versions as V
from ledgermill.sources import remote, templates
from ledgermill.sources.tables import scratch

from .registry import money, query

CONTACTS = "c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN 'm' || c_custkey % 50 END AS email FROM customer)"


def contacts_of(customer):
    return customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("m"), (F.col("c_custkey") % 50).cast("string"))).alias("email"))


@query(f"""WITH {CONTACTS}, s AS (SELECT s_suppkey AS k, 'm' || s_suppkey AS email, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Customer#' || lpad(s_suppkey::VARCHAR, 9, '0') END AS name FROM supplier)
  SELECT k, coalesce((SELECT min(id) FROM c WHERE c.email = s.email), (SELECT min(id) FROM c WHERE c.name = s.name)) AS found FROM s""")
def entity_by_email_or_name(customer, supplier):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise(F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")))
    asked = supplier.select(F.col("s_suppkey").alias("k"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("email"), name.alias("name"))
    others = contacts_of(customer).select(F.col("email").alias("_email"), F.col("name").alias("_name"), "id")
    return K.first_match(asked, others, [("email", "_email"), ("name", "_name")], "id", "found").select("k", "found")


@query(f"""WITH {CONTACTS}, s AS (SELECT s_suppkey AS company, 'm' || s_suppkey % 7 AS email FROM supplier)
  SELECT id, company, (SELECT count(*) FROM s x WHERE x.email = s.email) > 1 AS ambiguous FROM c JOIN s USING (email) WHERE NOT id % 10 = company % 10""")
def links_by_email(customer, supplier):
    companies = supplier.select(F.col("s_suppkey").alias("company"), F.concat(F.lit("m"), (F.col("s_suppkey") % 7).cast("string")).alias("email"))
    # existing links, whose number grows with the square of the tables, are made where their contacts lie, in parts of about half a million
    contacts = contacts_of(customer)
    contacts = contacts.repartition(max(64, contacts.count() * companies.count() // 400_000_000), "id")
    linked = companies.select("company", F.col("email").alias("_email"))
    existing = contacts.join(F.broadcast(linked), (F.col("email") == F.col("_email")) & (F.col("id") % 10 == F.col("company") % 10)).select("id", "company")
    return K.new_links(contacts, companies, "email", ["id", "company"], existing)


@query(f"""WITH {CONTACTS}, n AS (SELECT s_name AS name, 'm' || s_suppkey * 7 AS email FROM supplier UNION ALL SELECT c_name, NULL FROM customer WHERE c_custkey % 40 = 0),
  m AS (SELECT *, coalesce((SELECT min(id) FROM c WHERE c.email = n.email), (SELECT min(id) FROM c WHERE c.name = n.name)) AS found FROM n),
  b AS (SELECT found AS id, arg_max(name, (email IS NOT NULL, coalesce(email, ''), name)) AS n2, max(email) AS e2 FROM m WHERE found IS NOT NULL GROUP BY 1)
  SELECT c.id, coalesce(n2, name) AS name, coalesce(e2, email) AS email, CASE WHEN n2 IS NULL THEN 'KEPT' ELSE 'UPDATED' END AS action FROM c LEFT JOIN b USING (id)
  UNION ALL SELECT DISTINCT NULL, name, email, 'INSERTED' FROM m WHERE found IS NULL""")
def contact_upsert(customer, supplier):
    new = supplier.select(F.col("s_name").alias("name"), F.concat(F.lit("m"), (F.col("s_suppkey") * 7).cast("string")).alias("email"))
    named = customer.filter("c_custkey % 40 = 0").select(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("email"))
    return K.upsert_contacts(contacts_of(customer), new.unionByName(named))


@query("""WITH o AS (SELECT o_custkey AS owner, o_orderkey % 5 AS number, bool_or(o_orderstatus = 'F') AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), n AS (SELECT o_custkey AS owner, o_orderkey % 5 AS number, bool_or(o_orderstatus = 'O') AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
  SELECT owner, number, coalesce(o.p, FALSE) OR coalesce(n.p, FALSE) AS promoted, coalesce(n.p, o.p) AS overwritten FROM o FULL JOIN n USING (owner, number)""")
def phone_sync(orders):
    side = lambda odd, status: orders.filter(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("owner"), (F.col("o_orderkey") % 5).alias("number")).agg(F.bool_or(F.col("o_orderstatus") == status).alias("is_primary"))
    old, new = side(0, "F"), side(1, "O")
    promoted = K.sync_phones(old, new).withColumnRenamed("is_primary", "promoted")
    return promoted.join(K.sync_phones(old, new, overwrite=True).withColumnRenamed("is_primary", "overwritten"), ["owner", "number"])


@query("""WITH p AS (SELECT DISTINCT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'c' || s_nationkey END AS country, s_nationkey AS share FROM supplier), n AS (SELECT name, country, share + 100 AS share FROM p WHERE share % 3 = 0 UNION ALL SELECT 'new', NULL, 1)
  SELECT coalesce(p.name, n.name) AS name, coalesce(p.country, n.country) AS country, coalesce(n.share, p.share) AS share, CASE WHEN n.name IS NULL THEN 'KEPT' WHEN p.name IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action
  FROM p FULL JOIN n ON p.name = n.name AND p.country IS NOT DISTINCT FROM n.country""")
def partner_upsert(spark, supplier):
    old = supplier.select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("c"), F.col("s_nationkey").cast("string"))).alias("country"), F.col("s_nationkey").alias("share")).distinct()
    new = old.filter("share % 3 = 0").withColumn("share", F.col("share") + 100).unionByName(spark.createDataFrame([("new", None, 1)], "name string, country string, share int"))
    return K.upsert_partners(old, new)


@query("""SELECT company, code, min(pos) = 0 AS is_primary FROM (SELECT s_suppkey AS company, unnest(range(4)) AS pos, unnest([s_nationkey + 10, 0, s_nationkey + 11, s_nationkey + 10])::VARCHAR AS code FROM supplier) WHERE code <> '0' GROUP BY ALL""")
def activity_links(supplier):
    raw = lambda n: F.concat(F.lit("n. "), (F.col("s_nationkey") + n).cast("string"))
    companies = supplier.select(F.col("s_suppkey").alias("company"), F.array(raw(10), F.lit("00.00-0-00"), raw(11), raw(10)).alias("activities"))
    return K.activity_links(companies, "activities", lambda c: F.regexp_replace(C.activity_code(c), "^[.]", ""))


@query("""WITH p AS (SELECT n_nationkey % 5 AS task, n_nationkey // 5 + 1 AS version, n_name AS content, n_nationkey >= 20 AS is_active FROM nation)
  SELECT task, version, content, is_active AND task NOT IN (1, 2) AS is_active FROM p UNION ALL SELECT task, max(version) + 1, 'new', TRUE FROM p WHERE task IN (1, 2) GROUP BY task""")
def version_switch(spark, nation):
    prompts = nation.select((F.col("n_nationkey") % 5).alias("task"), (F.floor(F.col("n_nationkey") / 5) + 1).cast("int").alias("version"), F.col("n_name").alias("content"), (F.col("n_nationkey") >= 20).alias("is_active"))
    return K.switch_version(prompts, spark.createDataFrame([(1, "new"), (2, "new")], "task int, content string"))


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'CANCELADO' ELSE 'DELETE' END AS action FROM customer""")
def delete_actions(customer, orders):
    counted = R.relation_counts(customer, "c_custkey", {"orders": (orders, "o_custkey")})
    return counted.select("c_custkey", K.delete_action(F.col("orders")).alias("action"))


OWNERS = """l AS (SELECT o_custkey AS contact, o_orderkey % 50 AS company, min(o_orderkey) AS link FROM orders WHERE o_custkey % 3 > 0 GROUP BY ALL), t AS (SELECT DISTINCT user_id AS contact, event_id % 50 AS company FROM events)"""


@query(f"""WITH {OWNERS} SELECT contact, company, 'MIGRATED' AS action FROM l WHERE (contact, company) NOT IN (SELECT (contact, company) FROM t) UNION ALL SELECT contact, company, 'KEPT' FROM t""")
def migrate_links(orders, events):
    links = orders.filter("o_custkey % 3 > 0").select(F.col("o_custkey").alias("contact"), (F.col("o_orderkey") % 50).alias("company"))
    return K.migrated(links, events.select(F.col("user_id").alias("contact"), (F.col("event_id") % 50).alias("company")).distinct(), ["contact", "company"])


@query(f"""WITH {OWNERS} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT contact FROM l) AND c_custkey NOT IN (SELECT contact FROM t WHERE company < 10)""")
def purge_orphans(customer, orders, events):
    users = [orders.filter("o_custkey % 3 > 0").select(F.col("o_custkey").alias("c_custkey")), events.filter("event_id % 50 < 10").select(F.col("user_id").alias("c_custkey"))]
    return K.purge(customer.select("c_custkey"), "c_custkey", users)


@query("""WITH f AS (SELECT p_partkey % 400 AS hash, min(p_size) AS company_id, max(p_name) AS name, CASE WHEN p_partkey % 400 % 4 = 0 THEN 9 END AS deleted_at FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
  n AS (SELECT p_partkey % 300 AS hash, min(p_size) AS c, max(p_brand) AS n2 FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL)
  SELECT coalesce(f.hash, n.hash) AS hash, coalesce(company_id, c) AS company_id, coalesce(n2, name) AS name, CASE WHEN n.hash IS NULL THEN deleted_at END AS deleted_at,
  CASE WHEN n.hash IS NULL THEN NULL WHEN f.hash IS NULL THEN 'FILE_REGISTERED' ELSE 'FILE_REUSED' END AS event FROM f FULL JOIN n ON f.hash = n.hash""")
def file_dedup(part):
    known = part.filter("p_partkey % 2 = 0").groupBy((F.col("p_partkey") % 400).alias("hash")).agg(F.min("p_size").alias("company_id"), F.max("p_name").alias("name")).withColumn("deleted_at", F.when(F.col("hash") % 4 == 0, 9))
    return K.register_files(known, part.filter("p_partkey % 3 = 0").select((F.col("p_partkey") % 300).alias("hash"), F.col("p_size").alias("company_id"), F.col("p_brand").alias("name")))


@query("""WITH o AS (SELECT user_id AS file, event_type AS type, count(*) AS version, arg_max(value, event_id) AS content FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
  n AS (SELECT user_id AS file, event_type AS type, arg_max(value, event_id) AS content FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
  SELECT coalesce(o.file, n.file) AS file, coalesce(o.type, n.type) AS type, CASE WHEN n.file IS NULL THEN version ELSE coalesce(version, 0) + 1 END AS version, coalesce(n.content, o.content) AS content,
  CASE WHEN n.file IS NULL THEN 'KEPT' WHEN o.file IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action FROM o FULL JOIN n ON o.file = n.file AND o.type = n.type""")
def artifact_upsert(events):
    rows = lambda odd: events.filter(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").alias("file"), F.col("event_type").alias("type"))
    content = F.max_by("value", "event_id").alias("content")
    known = rows(0).agg(F.count("*").alias("version"), content)
    return V.merge_by_rules(known, rows(1).agg(content, F.lit(1).cast("long").alias("version")), ["file", "type"], {"content": V.given, "version": V.added})


@query("""WITH k AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem)
  SELECT s_suppkey, s_name, count(*) AS parts, count(DISTINCT p_brand) AS brands, min(p_name) AS first_part FROM k JOIN supplier ON s_suppkey = supplier JOIN part ON p_partkey = part WHERE s_acctbal > 0 GROUP BY ALL""")
def link_table_join(supplier, lineitem, part):
    # the table of lines names a pair as often as it was delivered
    links = lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    rows = R.linked(supplier.filter("s_acctbal > 0"), links, part, "s_suppkey", "p_partkey")
    return rows.groupBy("s_suppkey", "s_name").agg(F.count("*").alias("parts"), F.count_distinct("p_brand").alias("brands"), F.min("p_name").alias("first_part"))


@query(f"""WITH {CONTACTS} SELECT count(*) AS total, count(email) AS with_email, count(*) FILTER (id IN (SELECT s_suppkey FROM supplier)) AS with_collaborator, count(*) FILTER (id IN (SELECT user_id FROM events)) AS with_user FROM c""")
def contact_stats(customer, supplier, events):
    flag = lambda df, key, name: df.select(F.col(key).cast("long").alias("id")).distinct().withColumn(name, F.lit(True))
    rows = contacts_of(customer).join(flag(supplier, "s_suppkey", "c"), "id", "left").join(flag(events, "user_id", "u"), "id", "left")
    return rows.agg(F.count("*").alias("total"), F.count("email").alias("with_email"), F.count("c").alias("with_collaborator"), F.count("u").alias("with_user"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE s_suppkey END AS company FROM customer LEFT JOIN supplier ON lpad(c_custkey::VARCHAR, 14, '0') = lpad(s_suppkey::VARCHAR, 14, '0')""")
def company_resolution(customer, supplier):
    companies = supplier.select(C.company_id(F.col("s_suppkey").cast("string")).alias("n"), "s_suppkey")
    rows = customer.select("c_custkey", C.company_id(F.concat(F.lit("id "), F.col("c_custkey").cast("string"))).alias("n"), F.when(F.col("c_custkey") % 4 == 0, F.lit(-1)).alias("source"))
    return rows.join(companies, "n", "left").select("c_custkey", F.coalesce("source", "s_suppkey").alias("company"))


# imports


@query("""SELECT o_orderstatus AS batch, count(*) AS total_rows, count(*) FILTER (o_custkey % 5 > 0) AS success_rows, count(*) FILTER (o_custkey % 5 = 0) AS error_rows, min(r)::INT AS first_index, max(r)::INT AS last_index
  FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1""")
def import_batches(spark, orders):
    at = scratch(spark, "rows")
    rows = orders.select(F.col("o_orderstatus").alias("batch_id"), F.col("o_orderkey").alias("position"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("Customer"))
    templates.append_rows(templates.import_rows(rows, "batch_id", "position", {"Customer": "customer"}), at)
    found = templates.batch_counters(spark.read.parquet(at))
    return found.select(F.col("batch_id").alias("batch"), "total_rows", "success_rows", "error_rows", "first_index", "last_index")


@query("""SELECT o_orderstatus AS batch_id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT o_orderstatus, 2 * count(*) FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def reprocess_batch(spark, orders):
    at = scratch(spark, "reprocess")
    rows = orders.select(F.col("o_orderstatus").alias("batch_id"), "o_orderkey")
    rows.unionByName(rows).write.partitionBy("batch_id").parquet(at)
    M.replace_partitions(spark, rows.filter("batch_id = 'P'"), at, "batch_id")
    return spark.read.parquet(at).groupBy("batch_id").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS number, s_name || ' & <x>' AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END AS nation FROM supplier")
def import_workbook(supplier):
    def books(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: templates.workbook([["Relatório"], [None], ["name", "other", "number", "nation"], *([r["name"], None, r["number"], r["nation"]] for r in x)]))

    row = F.struct(F.col("s_suppkey").cast("string").alias("number"), F.concat("s_name", F.lit(" & <x>")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string")).alias("nation"))
    files = supplier.groupBy((F.col("s_suppkey") % 5).alias("path")).agg(F.collect_list(row).alias("rows")).select("path", F.pandas_udf(books, "binary")("rows").alias("content"))
    return templates.read_workbooks(files, ["number", "name", "nation", "missing"], header_row=2).drop("missing")


@query("SELECT s_suppkey::VARCHAR AS number, s_name AS name FROM supplier")
def import_later_header(spark, supplier):
    at = scratch(spark, "late")
    lines = supplier.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), F.col("s_name"), F.lit('"'))).alias("line"))
    templates.write_with_header(lines, at, ["a title", "number,name"])
    return templates.read_csv(spark, at, header_row=1).select("number", "name")


@query("""SELECT s_suppkey, 'name' AS source, 'n' || s_nationkey AS target FROM supplier WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 'E-mail', 'email' FROM supplier WHERE s_suppkey % 3 = 1""")
def column_map_parse(supplier):
    third = F.col("s_suppkey") % 3
    text = F.when(third == 0, "no map").otherwise(F.concat(F.lit('{"name": "n'), F.col("s_nationkey").cast("string"), F.when(third == 1, '", "E-mail": "email"}').otherwise('"}')))
    return supplier.select("s_suppkey", F.explode(templates.parsed_map(text)).alias("source", "target"))


@query("""SELECT DISTINCT 'region=' || n_regionkey AS name, 'directory' AS type FROM nation UNION ALL SELECT '_SUCCESS', 'file'""")
def directory_listing(spark, nation):
    at = scratch(spark, "list")
    nation.withColumn("region", F.col("n_regionkey")).write.partitionBy("region").parquet(at)
    return templates.listing(spark, at)


@functools.lru_cache(maxsize=8)
def _served_parts(path: str, changed: float, wanted: tuple):
    """The parts (row groups) of the orders' file with the condition of the rows that are served, and how many of each part are; kept by a worker, so that pages read their own parts only."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    names = {"id": "o_orderkey", "status": "o_orderstatus"}
    served_ = pc.bit_wise_and(ds.field("o_orderkey"), 1) == 1
    for k, v in wanted:
        served_ &= ds.field(names[k]) == v
    parts = [g for f in ds.dataset(path).get_fragments() for g in f.split_by_row_group()]
    return served_, [(g, g.count_rows(filter=served_)) for g in parts]


def served(args: dict, wanted: dict, offset: int | None, limit: int | None):
    """Stands for a service: pages of the odd orders, read where the task runs."""
    condition, parts = _served_parts(args["path"], os.path.getmtime(args["path"]), tuple(sorted(wanted.items())))
    if offset is None:
        return sum(n for _, n in parts)
    rows, at = [], 0
    for part, n in parts:
        if at < offset + limit and at + n > offset:
            found = part.to_table(columns=["o_orderkey", "o_orderstatus"], filter=condition)
            found = found.slice(max(offset - at, 0), min(offset + limit - at, n) - max(offset - at, 0))
            rows += [{"id": r["o_orderkey"], "status": r["o_orderstatus"]} for r in found.to_pylist()]
        at += n
    return rows


@query("""SELECT 'local' AS source, o_orderkey AS id FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'remote', o_orderkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus = 'O'""")
def remote_pages(spark, sf_dir, orders):
    local = orders.filter("o_orderkey % 2 = 0").select(F.lit("local").alias("source"), F.col("o_orderkey").alias("id"))
    pages = remote.paged(spark, f"{__name__}:served", "id long, status string", {"path": f"{sf_dir}/orders.parquet"}, page=20_000)
    return local.unionByName(pages.filter("status = 'O'").select(F.lit("remote").alias("source"), "id"))


@query("""SELECT o_orderkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def registry_lookup(spark, sf_dir, orders):
    path = f"{sf_dir}/customer.parquet"

    def registry(keys: list) -> dict:
        import pyarrow.dataset as ds

        found = ds.dataset(path).to_table(columns=["c_custkey", "c_name"], filter=ds.field("c_custkey").isin(keys)).to_pylist()
        return {r["c_custkey"]: {"nome": r["c_name"]} for r in found if r["c_custkey"] % 4 > 0}

    cache = scratch(spark, "registry")
    remote.looked_up(orders.filter("o_orderkey % 3 = 0"), "o_custkey", registry, "said", cache, batch=1000).count()
    found = remote.looked_up(orders, "o_custkey", registry, "said", cache, batch=1000)
    return found.select("o_orderkey", F.get_json_object("said", "$.nome").alias("name"))


# filters and projections


@query("""SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND (CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END = 'O' OR o_custkey % 3 = 0)""")
def filter_joined_status(orders, customer):
    kept = customer.filter("c_mktsegment = 'BUILDING'")
    source = F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderstatus"))
    return orders.filter(R.value_or_null(source, "O")).join(kept, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")


@query("""SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN user_id::VARCHAR WHEN event_id % 3 = 1 THEN event_type ELSE '{"event_id":' || event_id || '}' END AS label FROM events""")
def record_labels(events):
    third = F.col("event_id") % 3
    return events.select("user_id", "event_id", C.record_label(F.when(third == 0, F.col("user_id").cast("string")), F.when(third == 1, F.col("event_type")), payload=F.to_json(F.struct("event_id"))).alias("label"))


@query("""SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'name,cpf' ELSE 'a,b' END AS fields FROM supplier""")
def requested_fields(supplier):
    asked = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("name"), F.lit("cpf"), F.lit("name"), F.lit(" "))).when(F.col("s_nationkey") % 3 == 1, F.array(F.lit(" ")))
    return supplier.select("s_suppkey", F.array_join(R.requested(asked, F.array(F.lit("a"), F.lit("b"))), ",").alias("fields"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 15")
def page_allowed_sort(customer):
    allowed = {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}
    return R.page(customer, [R.allowed_sort("dropped; table", allowed, "name"), F.col("c_custkey")], 1, 15).select("c_custkey", "c_name")


@query("""SELECT o_custkey AS owner, arg_min(o_orderkey, (o_orderstatus <> 'O', o_orderdate, o_orderkey)) AS chosen, string_agg(o_orderkey::VARCHAR, ',' ORDER BY (o_orderstatus <> 'O')::INT, o_orderdate, o_orderkey) AS listed FROM orders GROUP BY 1""")
def phone_order(orders):
    key = F.struct((F.col("o_orderstatus") != "O").alias("later"), "o_orderdate", "o_orderkey")
    rows = orders.groupBy(F.col("o_custkey").alias("owner")).agg(F.min_by("o_orderkey", key).alias("chosen"), F.array_sort(F.collect_list(key)).alias("l"))
    return rows.select("owner", "chosen", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("listed"))


# traces


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view') AS current, arg_max(value, (ts, event_id)) FILTER (event_type = 'view') AS total, arg_max(CASE event_type WHEN 'view' THEN 'JOB_PROGRESS' WHEN 'error' THEN 'JOB_FAILED' ELSE 'OTHER' END, (ts, event_id)) AS status FROM events GROUP BY 1""")
def job_progress(events):
    rows = events.select("user_id", "ts", "event_id", C.mapped(F.when(F.col("event_type").isin("view", "error"), F.col("event_type")).otherwise("OTHER"), {"view": "JOB_PROGRESS", "error": "JOB_FAILED"}).alias("kind"), F.col("event_id").alias("current"), F.col("value").alias("total"))
    return T.progress(rows, "user_id")


@query("""SELECT user_id, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS storage_key FROM events WHERE event_type <> 'view' GROUP BY 1""")
def last_usable_path(events):
    payload = F.when(F.col("event_type") != "view", F.col("props")).otherwise('{"other": 1}')
    return T.last_usable(events.withColumn("payload", payload), "user_id", "payload", "$.k")


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (r <= 3) AS t FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1),
  e AS (SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) FILTER (r <= 3) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY 1)
  SELECT c_custkey, coalesce(o.n, 0) AS n_jobs, coalesce(o.t, '') AS jobs, coalesce(e.n, 0) AS n_events, coalesce(e.t, '') AS events FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN e ON user_id = c_custkey""")
def batch_trace(customer, orders, events):
    jobs = orders.withColumnRenamed("o_custkey", "c_custkey")
    happened = events.withColumn("c_custkey", F.col("user_id"))
    found = T.joined_trace(customer.select("c_custkey"), "c_custkey", {"jobs": (jobs, [F.col("o_orderkey")], F.col("o_orderkey").cast("string")), "events": (happened, [F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id")], F.col("event_type"))}, most=3)
    return found.select("c_custkey", "n_jobs", F.array_join("jobs", ",").alias("jobs"), "n_events", F.array_join("events", ",").alias("events"))


@query("SELECT event_type AS topic, count(*) AS n FROM events GROUP BY 1")
def broadcast_events(spark, sf_dir):
    from ledgermill.streaming.states import broadcast_stream

    return broadcast_stream(spark, sf_dir, "events.parquet")


# declared reference data


@query("""SELECT e.event_id, (e.event_id * p.value / 1000000)::DOUBLE AS cost FROM (SELECT * FROM events WHERE event_type = 'click') e
  ASOF JOIN (SELECT ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'signup' GROUP BY ts) p ON e.ts >= p.ts""")
def token_costs(events):
    prices = events.filter("event_type = 'signup'").select("ts", "event_id", F.col("value").alias("price"))
    uses = events.filter("event_type = 'click'").select("ts", "event_id", F.col("event_id").alias("tokens"))
    return T.priced(uses, prices, 1_000_000).select("event_id", "cost")


@query("""SELECT o_custkey AS project, count(DISTINCT l_suppkey) AS researcher_count, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total_hours FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def snapshot_rollups(orders, lineitem):
    rows = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("project"))
    return rows.agg(F.count_distinct("l_suppkey").alias("researcher_count"), F.sum(money("l_quantity")).cast("double").alias("total_hours"))


@query("""SELECT n_nationkey, lpad((n_nationkey % 13)::VARCHAR, 2, '0') || '2024' AS raw, CASE WHEN n_nationkey % 13 BETWEEN 1 AND 12 THEN '2024-' || lpad((n_nationkey % 13)::VARCHAR, 2, '0') || '-01' END AS mmyyyy, CASE n_nationkey % 3 WHEN 0 THEN '3' END AS month, upper(n_name) AS upper FROM nation""")
def value_transforms(nation):
    raw = F.concat(F.lpad((F.col("n_nationkey") % 13).cast("string"), 2, "0"), F.lit("2024"))
    month = F.when(F.col("n_nationkey") % 3 == 0, " Março").otherwise("mar")
    return nation.select("n_nationkey", raw.alias("raw"), K.transformed(raw, "DATE_MMYYYY").alias("mmyyyy"), K.transformed(month, "MONTH_NAME_PT").alias("month"), K.transformed(F.col("n_name"), "UPPER").alias("upper"))


RUBRIC = """WITH r AS (SELECT s_suppkey AS rule, CASE s_suppkey % 4 WHEN 0 THEN 'CODE_EXACT' WHEN 1 THEN 'DESC_EXACT' WHEN 2 THEN 'DESC_LIKE' ELSE 'DESC_REGEX' END AS kind, s_suppkey FROM supplier),
  named AS (SELECT rule, kind, CASE kind WHEN 'CODE_EXACT' THEN s_suppkey::VARCHAR WHEN 'DESC_EXACT' THEN (SELECT min(p_name) FROM part WHERE p_partkey = s_suppkey)
    WHEN 'DESC_LIKE' THEN '%' || (SELECT min(split_part(p_name, ' ', 1)) FROM part WHERE p_partkey = s_suppkey) || '%_' || s_suppkey % 7 || '%'
    ELSE (SELECT min(split_part(p_name, ' ', 2)) FROM part WHERE p_partkey = s_suppkey) || '.*[0-' || s_suppkey % 9 || ']$' END AS pattern FROM r)"""


@query(RUBRIC + """, d AS (SELECT DISTINCT p_name FROM part),
  hit AS (SELECT d.p_name, arg_min(rule, (kind, rule)) AS loose FROM d JOIN named ON (kind = 'DESC_LIKE' AND d.p_name LIKE pattern) OR (kind = 'DESC_REGEX' AND rule <> 3 AND regexp_matches(d.p_name, pattern)) GROUP BY 1)
  SELECT p_partkey, coalesce((SELECT min(rule) FROM named WHERE kind = 'CODE_EXACT' AND pattern = p_size::VARCHAR), (SELECT min(rule) FROM named WHERE kind = 'DESC_EXACT' AND pattern = part.p_name), loose)::VARCHAR AS rubric FROM part LEFT JOIN hit ON hit.p_name = part.p_name""")
def rubric_match(part, supplier):
    own = part.select(F.col("p_partkey").alias("s_suppkey"), "p_name")
    key, word = F.col("s_suppkey"), lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    kind = F.element_at(F.array(*map(F.lit, ("CODE_EXACT", "DESC_EXACT", "DESC_LIKE", "DESC_REGEX"))), (key % 4 + 1).cast("int"))
    like = F.concat(F.lit("%"), word(1), F.lit("%_"), (key % 7).cast("string"), F.lit("%"))
    # one rule is no pattern at all
    regex = F.when(key == 3, "(").otherwise(F.concat(word(2), F.lit(".*[0-"), (key % 9).cast("string"), F.lit("]$")))
    pattern = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.col("p_name")).when(key % 4 == 2, like).otherwise(regex)
    rules = supplier.join(own, "s_suppkey", "left").select(key.alias("rule"), kind.alias("kind"), pattern.alias("pattern"), key.cast("string").alias("rubric"))
    rows = part.select("p_partkey", F.col("p_size").cast("string").alias("code"), F.col("p_name").alias("description"))
    return K.rubric_match(rows, rules).select("p_partkey", "rubric")


@query("SELECT s_suppkey AS rule, CASE WHEN s_suppkey % 10 = 3 THEN 'REGEX_INVALID' END AS error FROM supplier")
def rubric_rules(supplier):
    pattern = F.when(F.col("s_suppkey") % 10 == 3, F.concat(F.lit("["), F.col("s_name"))).otherwise(F.regexp_replace("s_name", "#", "."))
    return K.checked_rules(supplier.select(F.col("s_suppkey").alias("rule"), F.lit("DESC_REGEX").alias("kind"), pattern.alias("pattern"))).select("rule", "error")


# versions and merges by rules


@query("""WITH n AS (SELECT o_custkey AS k, max(o_totalprice) AS price, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 UNION ALL SELECT -1, 5, NULL, 1),
  b AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS top, c_mktsegment AS segment, c_nationkey::BIGINT AS n FROM customer)
  SELECT coalesce(b.k, n.k) AS k, CASE WHEN b.k IS NULL THEN 'none' ELSE name END AS name, CASE WHEN n.k IS NULL THEN top ELSE greatest(top, price) END AS top, CASE WHEN b.k IS NULL THEN NULL ELSE coalesce(last, segment) END AS segment,
  CASE WHEN n.k IS NULL THEN b.n WHEN b.k IS NULL THEN n.n ELSE b.n + n.n END AS n, CASE WHEN n.k IS NULL THEN 'KEPT' WHEN b.k IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action FROM b FULL JOIN n ON b.k = n.k""")
def merge_by_rules(spark, customer, orders):
    base = customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("top"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("n"))
    at = F.struct("o_orderdate", "o_orderkey")
    changes = orders.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("top"), F.max_by("o_orderpriority", at).alias("segment"), F.count("*").alias("n"))
    changes = changes.unionByName(spark.createDataFrame([(-1, 5.0, None, 1)], "k long, top double, segment string, n long"))
    return V.merge_by_rules(base, changes, ["k"], {"top": V.greatest, "segment": V.given, "n": V.added}, {"name": F.lit("none")})


def _history(customer, orders):
    day = lambda text: F.to_date(F.lit(text))
    third, first = F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")
    rows = lambda df, start, end, closed, segment: df.select(F.col("c_custkey").alias("k"), segment.alias("segment"), F.col("c_acctbal").alias("balance"), start.alias("valid_from"), end.alias("valid_to"), F.lit(closed).alias("closed"))
    none = F.lit(None).cast("date")
    history = rows(customer.filter(third), day("1990-01-01"), day("1999-01-01"), True, first).unionByName(rows(customer.filter(third), day("1999-01-01"), none, False, F.lit(None).cast("string"))).unionByName(rows(customer.filter(~third), day("1990-01-01"), none, False, first))
    even, third_order = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 3 == 0
    changes = orders.select(F.col("o_custkey").alias("k"), F.when(third_order, F.col("o_orderpriority")).alias("segment"), F.when(even, F.col("o_totalprice")).alias("balance"), F.to_date("o_orderdate").alias("at"), "o_orderkey")
    return V.apply_changes(history, changes, ["k"], ["segment", "balance"], "at", "o_orderkey")


HISTORY = """h AS (SELECT c_custkey AS k, c_mktsegment AS segment, c_acctbal AS balance, DATE '1990-01-01' AS vf, CASE WHEN c_custkey % 3 = 0 THEN DATE '1999-01-01' END AS vt, c_custkey % 3 = 0 AS closed FROM customer
    UNION ALL SELECT c_custkey, NULL, c_acctbal, DATE '1999-01-01', NULL, FALSE FROM customer WHERE c_custkey % 3 = 0),
  c AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS segment, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS balance, o_orderdate::DATE AS at_, o_orderkey FROM orders),
  no AS (SELECT o_orderkey FROM c JOIN h ON h.k = c.k AND closed AND at_ >= vf AND at_ < vt)"""


@query(f"""WITH {HISTORY},
  p AS (SELECT k, vf AS at_, 0 AS kind, NULL AS o, closed, vt, [segment] AS s, [balance] AS b FROM h UNION ALL
    SELECT k, at_, 1, o_orderkey, FALSE, NULL, CASE WHEN segment IS NOT NULL THEN [segment] END, CASE WHEN balance IS NOT NULL THEN [balance] END FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM no)),
  f AS (SELECT k, at_, kind, o, closed, vt, last_value(s IGNORE NULLS) OVER w AS s, last_value(b IGNORE NULLS) OVER w AS b FROM p WINDOW w AS (PARTITION BY k ORDER BY at_, kind, o ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, row_number() OVER (PARTITION BY k, at_ ORDER BY kind DESC, o DESC) AS r FROM f),
  g AS (SELECT *, lag(s) OVER w AS ps, lag(b) OVER w AS pb, lag(closed) OVER w AS pc FROM l WHERE r = 1 WINDOW w AS (PARTITION BY k ORDER BY at_)),
  v AS (SELECT * FROM g WHERE closed OR pc IS NULL OR pc OR s IS DISTINCT FROM ps OR b IS DISTINCT FROM pb)
  SELECT k, s[1] AS segment, b[1] AS balance, at_ AS valid_from, CASE WHEN closed THEN vt ELSE lead(at_) OVER (PARTITION BY k ORDER BY at_) END AS valid_to, closed FROM v""")
def versions(customer, orders):
    return _history(customer, orders)[0]


@query(f"WITH {HISTORY} SELECT k, o_orderkey FROM c WHERE o_orderkey IN (SELECT o_orderkey FROM no)")
def refused_changes(customer, orders):
    return _history(customer, orders)[1].select("k", "o_orderkey")
