"""The query catalogue over the driver's tables: each entry is a query and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgermill.functions import columns as C
from ledgermill.operators import lines as L
from ledgermill.operators import merge as M
from ledgermill.operators import quality as Q
from ledgermill.operators import relational as R
from ledgermill.operators.forms import adds_up, running_sums
from ledgermill.sources import templates
from ledgermill.sources.tables import scratch
from ledgermill.operators.traces import EVENT_LABELS, is_error, trace
from ledgermill.streaming.states import folded_stream, state_fold

from .registry import ORACLE_SQL, QUERIES, money, query

__all__ = ["ORACLE_SQL", "QUERIES"]

AS_OF = "TIMESTAMP_NTZ'2024-01-30 12:00:00'"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
PRIORITY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(PRIORITIES, 1)) + " ELSE 6 END"


# search, filters and pages


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_name) LIKE '%ma%' OR lower(c_mktsegment) LIKE '%ma%'")
def search_multi_column(customer):
    return customer.filter(R.contains_any(["c_name", "c_mktsegment"], "MA")).select("c_custkey", "c_name", "c_mktsegment")


@query("""SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%77%'
  OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '%URGENT%' AND o_totalprice > 400000)""")
def search_child_exists(customer, orders):
    hits = orders.filter(F.col("o_orderpriority").contains("URGENT") & (F.col("o_totalprice") > 400000)).select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return customer.join(hits, "c_custkey", "left").filter(R.contains_any(["c_name"], "77") | F.col("hit").isNotNull()).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE lower(c_mktsegment) LIKE '%house%' OR lower(c_name) LIKE '%99%' ORDER BY c_name, o_orderkey LIMIT 50""")
def search_parent_relation(orders, customer):
    found = orders.join(customer, orders.o_custkey == customer.c_custkey).filter(R.contains_any(["c_mktsegment", "c_name"], "house") | R.contains_any(["c_name"], "99"))
    return R.page(found, [F.col("c_name"), F.col("o_orderkey")], 1, 50).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def filter_optional_and(orders):
    return orders.filter(R.all_given(o_orderstatus="O", o_orderpriority="2-HIGH", o_custkey=None)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus IS NOT NULL")
def filter_not_equal_not_null(orders):
    return orders.filter(R.differs(F.col("o_orderstatus"), "F")).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def filter_in_list(lineitem):
    return lineitem.filter(R.all_given(l_returnflag=["R", "A"])).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("""SELECT event_id, event_type, ts >= TIMESTAMP '2024-01-29 12:00:00' AS last_day FROM events
  WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' AND ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-30 12:00:00'""")
def filter_relative_period(events):
    as_of = F.expr(AS_OF)
    recent = events.filter((F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") >= F.expr(f"cast(trunc({AS_OF}, 'MM') as timestamp_ntz)")) & (F.col("ts") <= as_of))
    return recent.select("event_id", "event_type", (F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("last_day"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey::VARCHAR LIKE '%7%' OR lower(s_name) LIKE '%7%' OR s_nationkey::VARCHAR LIKE '%7%'")
def filter_any_column_text(supplier):
    return supplier.filter(R.contains_any(["s_suppkey", "s_name", "s_nationkey"], "7")).select("s_suppkey", "s_name")


@query("""SELECT o_orderkey, o_orderdate, (SELECT ceil(count(*) / 15.0)::BIGINT FROM orders) AS total_pages
  FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15 OFFSET 30""")
def page_sorted(orders):
    rows = R.page(orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 15)
    return rows.join(F.broadcast(R.page_count(orders, 15).select("total_pages")))


@query(f"SELECT o_orderkey, o_orderpriority, {PRIORITY_SQL}::INT AS place FROM orders ORDER BY place, o_orderdate DESC, o_orderkey LIMIT 100")
def page_enum_order(orders):
    ranked = orders.withColumn("place", R.ordinal("o_orderpriority", PRIORITIES).cast("int"))
    return R.page(ranked, [F.col("place"), F.desc("o_orderdate"), F.col("o_orderkey")], 1, 100).select("o_orderkey", "o_orderpriority", "place")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 500)::BIGINT AS chunk FROM orders")
def chunk_500(orders):
    return R.chunked(orders.select("o_orderkey"), ["o_orderkey"], 500)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) <= 4""")
def top_n_children(lineitem):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey"))
    return lineitem.withColumn("place", place).filter("place <= 4").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# joins and nested results


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_inner_dim(orders, customer):
    return orders.filter("o_totalprice > 300000").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25
  LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0""")
def join_left_two(lineitem, part, supplier):
    with_part = lineitem.join(part.filter("p_size < 25"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return with_part.join(supplier.filter("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name")


@query("""SELECT o_orderkey, count(l_orderkey)::INT AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS listed
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def include_children(orders, lineitem):
    found = R.include(orders.select("o_orderkey"), lineitem, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"], "lines")
    return found.select("o_orderkey", F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",").alias("listed"))


@query("""WITH n AS (SELECT n_regionkey, n_name || '=' || count(c_custkey) AS t, n_nationkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey
  GROUP BY n_regionkey, n_name, n_nationkey) SELECT r_name, string_agg(t, ',' ORDER BY n_nationkey) AS nations FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY r_name""")
def include_three_levels(region, nation, customer):
    counted = R.relation_counts(nation, "n_nationkey", {"customers": (customer, "c_nationkey")})
    found = R.include(region, counted, "r_regionkey", "n_regionkey", ["n_nationkey", "n_name", "customers"], "nations")
    return found.select("r_name", F.array_join(F.transform("nations", lambda x: F.concat_ws("=", x["n_name"], x["customers"])), ",").alias("nations"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_some(customer, orders):
    return customer.join(orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)")
def semi_two_hop(orders, customer, nation):
    bridge = customer.join(nation.filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.join(bridge, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)""")
def anti_none(customer, orders, supplier):
    rest = customer.join(orders.filter("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rest.join(supplier.filter("s_acctbal > 9000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_anti").select("c_custkey")


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON contains(lpad(c_custkey::VARCHAR, 9, '0'), lpad(s_suppkey::VARCHAR, 6, '0'))""")
def theta_contains(customer, supplier):
    hay = customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("number"))
    return R.contains_join(hay, "number", supplier.select("s_suppkey", F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("part")), "part", []).select("c_custkey", "s_suppkey")


@query("""WITH d AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS text FROM part)
  SELECT p_partkey, text FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.p_size = d.p_size AND length(e.text) < length(d.text) AND contains(d.text, e.text))""")
def theta_parent_child(part):
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.lower("p_type")))
    rows = part.select("p_partkey", "p_size", text.alias("text"))
    texts = rows.select("p_size", "text").distinct()
    parents = R.contains_join(texts, "text", texts.withColumnRenamed("text", "leaf"), "leaf", ["p_size"]).filter(F.length("leaf") < F.length("text")).select("p_size", "text").distinct()
    return rows.join(parents, ["p_size", "text"], "left_anti").select("p_partkey", "text")


@query("""WITH p AS (SELECT user_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to, value AS price FROM events WHERE event_type = 'purchase')
  SELECT e.event_id, p.price FROM events e JOIN p ON p.user_id = e.user_id AND e.ts >= p.valid_from AND (p.valid_to IS NULL OR e.ts < p.valid_to) WHERE e.event_type = 'click'""")
def range_validity(events):
    in_time = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    priced = events.withColumn("price", F.last(F.when(F.col("event_type") == "purchase", F.struct("value")), ignorenulls=True).over(in_time))
    return priced.filter("event_type = 'click' and price is not null").select("event_id", F.col("price.value").alias("price"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
  SELECT c_custkey, coalesce(o_orderkey, -1) AS matched, coalesce(n, 0) > 1 AS ambiguous FROM customer
  LEFT JOIN (SELECT * FROM l WHERE r = 1) USING (c_custkey) LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey""".replace("USING (c_custkey)", "ON o_custkey = c_custkey"))
def resolve_entity(customer, orders):
    best = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("found"), F.count("*").alias("n"))
    return customer.join(best, "c_custkey", "left").select("c_custkey", F.coalesce("found", F.lit(-1)).alias("matched"), (F.coalesce("n", F.lit(0)) > 1).alias("ambiguous"))


# aggregates


@query("""SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS pending,
  count(*) FILTER (o_orderdate >= TIMESTAMP '2001-07-01') AS new_this_month, round(100.0 * count(*) FILTER (o_orderstatus = 'O') / greatest(count(*), 1))::BIGINT AS open_percent FROM orders""")
def stats_single_pass(orders):
    n = lambda c: F.count_if(c)
    o = F.col("o_orderstatus")
    return orders.agg(F.count("*").alias("total"), n(o == "O").alias("open"), n(o == "P").alias("pending"), n(F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ'2001-07-01 00:00:00'")).alias("new_this_month"), R.percent(n(o == "O"), F.count("*")).alias("open_percent"))


@query("""WITH s AS (SELECT o_custkey, sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice::DECIMAL(18,2) END) AS e, sum(l_extendedprice::DECIMAL(18,2)) AS t
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
  SELECT c_custkey, coalesce(e, 0)::DOUBLE AS eligible, coalesce(t, 0)::DOUBLE AS total FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def conditional_sums(customer, orders, lineitem):
    lines = orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey"))
    sums = lines.agg(F.sum(F.when(F.col("l_returnflag") == "N", money("l_extendedprice"))).alias("e"), F.sum(money("l_extendedprice")).alias("t"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("double").alias(n)
    return customer.join(sums, "c_custkey", "left").select("c_custkey", zero("e", "eligible"), zero("t", "total"))


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def relation_counts(nation, customer, supplier):
    return R.relation_counts(nation, "n_nationkey", {"customers": (customer, "c_nationkey"), "suppliers": (supplier, "s_nationkey")}).select("n_nationkey", "customers", "suppliers")


@query("""SELECT o_orderkey, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS quantity, count(l_orderkey) FILTER (l_discount > 0.05)::INT AS discounted
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def nested_sum(orders, lineitem):
    found = R.include(orders.select("o_orderkey"), lineitem, "o_orderkey", "l_orderkey", ["l_linenumber", "l_quantity", "l_discount"], "lines")
    total = F.aggregate("lines", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + F.coalesce(x["l_quantity"], F.lit(0)).cast("decimal(18,2)")).cast("decimal(28,2)"))
    return found.select("o_orderkey", total.cast("double").alias("quantity"), F.size(F.filter("lines", lambda x: x["l_discount"] > 0.05)).alias("discounted"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def status_pivot(events):
    types = ["click", "error", "purchase", "signup", "view"]
    return events.groupBy("user_id").pivot("event_type", types).count().na.fill(0, types)


@query("SELECT DISTINCT event_type FROM events ORDER BY event_type")
def distinct_sorted(events):
    return events.select("event_type").distinct().orderBy("event_type")


@query("""SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'R'), FALSE) AS any_returned, coalesce(bool_and(l_returnflag = 'R'), TRUE) AS all_returned
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def any_all_children(orders, lineitem):
    flags = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("any"), F.bool_and(F.col("l_returnflag") == "R").alias("all"))
    return orders.join(flags, "o_orderkey", "left").select("o_orderkey", F.coalesce("any", F.lit(False)).alias("any_returned"), F.coalesce("all", F.lit(True)).alias("all_returned"))


@query("""SELECT user_id, min(ts) AS first_ts, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id""")
def first_item(events):
    return events.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("event_type", "event_id").alias("first_type"))


@query("""SELECT user_id, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS DECIMAL(18,2)), 0))::DOUBLE AS total FROM events GROUP BY user_id""")
def keyed_amounts(events):
    return events.groupBy("user_id").agg(F.sum(F.coalesce(F.get_json_object("props", "$.k").try_cast("decimal(18,2)"), F.lit(0))).cast("double").alias("total"))


# ordered analytics


@query("SELECT event_id, user_id, event_type, ts::DATE AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) = 1")
def keep_first_dedup(events):
    rows = events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), "ts")
    return M.keep_first(rows, ["user_id", "event_type", "day"], F.struct("ts", "event_id")).select("event_id", "user_id", "event_type", "day")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(events):
    return M.keep_last(events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DECIMAL(18,2) AS amount,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem),
  s AS (SELECT a.l_orderkey, a.r, a.amount, sum(b.amount) OVER (PARTITION BY a.l_orderkey, a.r ORDER BY b.r) AS prefix FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND b.r > a.r)
  SELECT l_orderkey, r::INT AS place, amount::DOUBLE AS amount FROM s WHERE abs(prefix - amount) * 100 < amount * 3 GROUP BY ALL""")
def running_sum_parent(lineitem):
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", money("l_extendedprice").alias("amount"))
    orders = lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sums = orders.withColumn("sums", running_sums(F.col("rows")))
    rows = sums.select("l_orderkey", "sums", F.posexplode("rows").alias("i", "row")).filter(adds_up(F.col("sums"), F.col("row.amount"), F.col("i")))
    return rows.select("l_orderkey", (F.col("i") + 1).alias("place"), F.col("row.amount").cast("double").alias("amount"))


LINES_SQL = r"""l AS (SELECT doc_id, unnest(range(len(x)))::INT AS pos, trim(regexp_replace(unnest(x), '\s+', ' ', 'g')) AS clean
  FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS x FROM documents))"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, section, count(*) AS n FROM (SELECT doc_id, last_value(CASE WHEN length(clean) BETWEEN 1 AND 40 THEN clean END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l) GROUP BY 1, 2""")
def section_fill(documents):
    named = F.transform(L.bare_lines(F.col("text")), lambda x: F.when(F.length(x["clean"]).between(1, 40), x["clean"]))
    filled = documents.select("doc_id", F.explode(L.last_above(named, lambda x: x.isNotNull())).alias("section"))
    return filled.groupBy("doc_id", "section").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos, clean = '' OR coalesce(last_value(CASE WHEN length(clean) BETWEEN 1 AND 40 THEN TRUE WHEN length(clean) > 200 THEN FALSE END IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), FALSE) AS inside FROM l WHERE doc_id % 10 >= 0""".replace("clean = '' OR ", "").replace(" WHERE doc_id % 10 >= 0", ""))
def section_flags(documents):
    size = lambda x: F.length(x["clean"])
    inside = L.in_section(L.bare_lines(F.col("text")), lambda x: size(x).between(1, 40), lambda x: size(x) > 200)
    return documents.select("doc_id", F.posexplode(inside).alias("pos", "inside"))


@query(f"""WITH {LINES_SQL} SELECT doc_id, pos, value FROM (SELECT doc_id, pos, clean, first_value(nullif(clean, '') IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS value FROM l) WHERE length(clean) BETWEEN 1 AND 40""")
def next_value(documents):
    below = lambda of, x, i: F.when(F.length(x["clean"]).between(1, 40), F.struct(i.alias("pos"), L.first_value(F.slice(of, i + 2, F.lit(3))).alias("value")))
    found = L.let(L.bare_lines(F.col("text")), lambda of: F.filter(F.transform(of, lambda x, i: below(of, x, i)), lambda v: v.isNotNull()))
    return documents.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")


@query(f"""WITH {LINES_SQL}, b AS (SELECT *, sum((clean = '')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::INT AS block FROM l)
  SELECT doc_id, block, left(string_agg(clean, ' ' ORDER BY pos), 500) AS value FROM b WHERE clean <> '' GROUP BY doc_id, block""")
def block_concat(documents):
    found = documents.select("doc_id", F.explode(L.let(L.lines(F.col("text")), L.paragraphs)).alias("x"))
    return found.select("doc_id", "x.block", F.substring("x.value", 1, 500).alias("value"))


# sets and merges


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def union_sources(customer, supplier):
    left = customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return left.unionByName(supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), allowMissingColumns=True)


@query("""SELECT p_brand, coalesce(array_to_string(list_sort(list_filter(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], lambda x: NOT list_contains(list(p_type), x))), ','), '') AS missing FROM part GROUP BY p_brand""")
def set_difference(part):
    wanted = F.lit(["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    return part.groupBy("p_brand").agg(F.collect_set("p_type").alias("found")).select("p_brand", F.array_join(F.array_sort(F.array_except(wanted, "found")), ",").alias("missing"))


@query("""WITH c AS (SELECT c_custkey + 100 AS k, c_name || ' new' AS name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS bal FROM customer)
  SELECT coalesce(b.c_custkey, k) AS c_custkey, coalesce(name, c_name) AS c_name, coalesce(c_acctbal, bal) AS c_acctbal,
  CASE WHEN k IS NULL THEN 'KEPT' WHEN b.c_custkey IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action FROM customer b FULL JOIN c ON k = b.c_custkey""")
def upsert_merge(customer):
    changes = customer.select((F.col("c_custkey") + 100).alias("c_custkey"), F.concat("c_name", F.lit(" new")).alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    return M.upsert(customer.select("c_custkey", "c_name", "c_acctbal"), changes, ["c_custkey"], keep_old=("c_acctbal",))


@query("""WITH e AS (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS year FROM orders), w AS (SELECT c_custkey AS o_custkey, 1998 AS year FROM customer)
  SELECT *, FALSE AS created FROM e UNION ALL SELECT *, TRUE FROM (SELECT * FROM w EXCEPT SELECT * FROM e)""")
def get_or_create(orders, customer):
    existing = orders.select("o_custkey", F.year("o_orderdate").alias("year")).distinct()
    return M.get_or_create(existing, customer.select(F.col("c_custkey").alias("o_custkey"), F.lit(1998).alias("year")), ["o_custkey", "year"])


@query("""WITH old AS (SELECT DISTINCT o_custkey AS contact, o_custkey % 7 AS company, o_orderpriority AS role FROM orders WHERE o_orderstatus = 'F'),
  new AS (SELECT DISTINCT o_custkey AS contact, o_custkey % 7 AS company, o_orderpriority AS role FROM orders WHERE o_orderstatus = 'O')
  SELECT contact, company, role, new.contact IS NOT NULL OR role <> '5-LOW' AS is_active, CASE WHEN new.contact IS NULL THEN 'KEPT' WHEN old.contact IS NULL THEN 'INSERTED' ELSE 'UPDATED' END AS action
  FROM old FULL JOIN new USING (contact, company, role)""".replace("new.contact IS NOT NULL OR role <> '5-LOW'", "(new.contact IS NOT NULL OR role <> '5-LOW')"))
def link_upsert(orders):
    links = lambda status, active: orders.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("contact"), (F.col("o_custkey") % 7).alias("company"), F.col("o_orderpriority").alias("role"), active.alias("is_active")).distinct()
    return M.upsert(links("F", F.col("o_orderpriority") != "5-LOW"), links("O", F.lit(True)), ["contact", "company", "role"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders""")
def replace_partition(spark, orders):
    at, rows = scratch(spark, "replace"), orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows.write.partitionBy("o_orderstatus").parquet(at)
    M.replace_partitions(spark, rows.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.lit(0.0)), at, "o_orderstatus")
    return spark.read.parquet(at)


@query("""SELECT CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS code, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE p_name END AS title, NULL::VARCHAR AS note,
  CASE WHEN p_partkey % 3 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM part""")
def project_template_map(part):
    rows = part.select(F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")).alias("p_partkey"), F.when(F.col("p_partkey") % 3 == 1, "").when(F.col("p_partkey") % 3 == 2, F.col("p_name")).alias("p_name"))
    found = templates.map_columns(rows, {"p_partkey": "code", "Title": "title", "p_name": "title", "note": "note"})
    return found.select("code", "title", "note", "status")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name || ' \"x\", y' AS s_name FROM supplier")
def export_csv_quoted(spark, supplier):
    at = scratch(spark, "export")
    templates.write_quoted_csv(supplier.select("s_suppkey", F.concat("s_name", F.lit(' "x", y')).alias("s_name")), at)
    return templates.read_csv(spark, at)


# scalar functions

ID_SQL = "lpad(c_custkey::VARCHAR, 14, '0')"


@query(rf"SELECT c_custkey, {ID_SQL} AS id, regexp_replace({ID_SQL}, '^(\d{{2}})(\d{{3}})(\d{{3}})(\d{{4}})(\d{{2}})$', '\1.\2.\3/\4-\5') AS masked FROM customer")
def digits_pad_mask(customer):
    return customer.select("c_custkey", C.company_id(F.concat(F.lit("no. "), F.col("c_custkey").cast("string"))).alias("id")).withColumn("masked", C.masked_id(F.col("id")))


def _digit_sql(weights: list[int]) -> str:
    rest = "(" + " + ".join(f"{w} * substr(id, {i}, 1)::INT" for i, w in enumerate(weights, 1)) + ") % 11"
    return f"CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END"


_W = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]


@query(f"""WITH i AS (SELECT p_partkey, lpad((p_partkey * 7919 + 11)::VARCHAR, 14, '0') AS id FROM part)
  SELECT p_partkey, substr(id, 13, 1)::INT = {_digit_sql(_W)} AND substr(id, 14, 1)::INT = {_digit_sql([6, *_W])} AS holds FROM i""")
def check_digits(part):
    return part.select("p_partkey", C.check_digits_hold(C.company_id((F.col("p_partkey") * 7919 + 11).cast("string"))).alias("holds"))


@query("""SELECT o_orderkey, 'R$ ' || translate(format('{:,.2f}', o_totalprice::DECIMAL(18,2)), ',.', '.,') AS shown, o_totalprice::DECIMAL(18,2) AS parsed, o_totalprice::DECIMAL(18,2) AS loose FROM orders""")
def money_br(orders):
    shown = orders.select("o_orderkey", C.money_shown(money("o_totalprice")).alias("shown"))
    return shown.withColumn("parsed", C.money_in_text(F.col("shown"))).withColumn("loose", C.loose_money(F.col("shown")))


@query(r"""SELECT o_orderkey, try_cast(regexp_replace(o_orderpriority || '-' || o_orderkey, '[^0-9]', '', 'g') AS BIGINT) AS loose_int, try_cast(left(o_orderpriority, 1) AS INT) AS first_int,
  CASE o_orderstatus WHEN 'O' THEN TRUE WHEN 'F' THEN FALSE END AS loose_bool, o_orderdate::DATE AS loose_date FROM orders""")
def loose_parsers(orders):
    word = F.when(F.col("o_orderstatus") == "O", " Sim").when(F.col("o_orderstatus") == "F", "Não").otherwise("?")
    return orders.select(
        "o_orderkey", C.loose_int(F.concat_ws("-", "o_orderpriority", F.col("o_orderkey").cast("string"))).alias("loose_int"), C.first_int(F.col("o_orderpriority")).alias("first_int"),
        C.loose_bool(word).alias("loose_bool"), C.loose_date(F.date_format("o_orderdate", "d/M/yyyy")).alias("loose_date"),
    )


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(strip_accents(upper(replace(text, 'ß', 'SS'))), '\s+', ' ', 'g'))) AS digest, length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits FROM documents""")
def text_normalise(documents):
    return documents.select("doc_id", F.sha2(C.normal_text(F.col("text")), 256).alias("digest"), F.length(C.only_digits(F.col("text"))).cast("long").alias("digits"))


@query("""SELECT c_custkey, '119' || lpad(c_custkey::VARCHAR, 8, '0') || ':CELULAR:true' || CASE WHEN c_custkey % 2 = 0 THEN ',' || lpad(c_custkey::VARCHAR, 10, '2') || ':FIXO:false' ELSE '' END AS phones FROM customer""")
def phone_split(customer):
    key = F.col("c_custkey").cast("string")
    mobile = F.concat(F.lit("(11) 9"), F.lpad(key, 8, "0"))
    raw = F.concat_ws(" / ", mobile, F.when(F.col("c_custkey") % 2 == 0, F.lpad(key, 10, "2")).otherwise("123"), mobile)
    return customer.select("c_custkey", F.array_join(F.transform(C.phones(raw), lambda p: F.concat_ws(":", p["number"], p["kind"], p["is_primary"].cast("string"))), ",").alias("phones"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 'SERVICO_APOIO_PJ' WHEN p_name LIKE '%bolt%' THEN 'MATERIAL_CONSUMO' ELSE 'DESPESA_OPERACIONAL' END AS class,
  CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 WHEN 'LARGE' THEN 3 END::INT AS research FROM part""")
def classify_keywords(part):
    n, t = F.col("p_name"), F.col("p_type")
    words = F.when(n.contains("widget"), "serviços de terceiros contratados").when(n.contains("bolt"), "Material").otherwise(n)
    kinds = F.when(t == "ECONOMY", "Pesquisa básica").when(t == "PROMO", "(PA)").when(t == "LARGE", "3").otherwise("nota de teste")
    return part.select("p_partkey", C.expense_class(words).alias("class"), C.research_class(kinds).alias("research"))


@query("""SELECT event_id, 'props.k' AS field_path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
  UNION ALL SELECT event_id, 'type', event_type FROM events""")
def registry_kv(events):
    pairs = F.map_concat(F.transform_keys(F.from_json("props", "map<string,string>"), lambda k, _: F.concat(F.lit("props."), k)), F.create_map(F.lit("type"), F.col("event_type")))
    return events.select("event_id", F.explode(pairs).alias("field_path", "value")).filter("value is not null")


@query("""SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events""")
def json_recovery(events):
    damaged = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```"))
    outer = F.regexp_extract(damaged, r"(?s)(\{.*\})", 1)
    return events.select("event_id", F.try_variant_get(F.coalesce(F.try_parse_json(damaged), F.try_parse_json(outer)), "$.k", "int").alias("k"))


# quality


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
  f AS (SELECT o_orderkey, o_totalprice > 0 AS a, coalesce(n, 0) > 0 AS b, coalesce(r, FALSE) AS c, o_orderpriority <> '4-NOT SPECIFIED' AS d FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
  s AS (SELECT o_orderkey, (a::INT + b::INT + c::INT + d::INT) / 4.0::DOUBLE AS complete, (CASE WHEN a THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN d THEN 0.6::DOUBLE ELSE 0 END) / 3 AS conf,
    4 - (a::INT + b::INT + c::INT + d::INT) AS missing FROM f),
  o AS (SELECT *, 0.40::DOUBLE * complete + 0.30::DOUBLE * conf + 0.30::DOUBLE * 0.5::DOUBLE AS overall FROM s)
  SELECT o_orderkey, round(overall, 4) AS overall, CASE WHEN overall >= 0.85 THEN 'HIGH' WHEN overall >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS band,
  CASE WHEN overall >= 0.85 THEN FALSE WHEN overall >= 0.60 THEN missing > 0 ELSE TRUE END AS needs_review, missing::INT AS n_missing FROM o""")
def completeness_score(orders, lineitem):
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    fields = {"total": F.col("o_totalprice") > 0, "lines": F.coalesce("n", F.lit(0)) > 0, "returned": F.coalesce("r", F.lit(False)), "priority": F.col("o_orderpriority") != "4-NOT SPECIFIED"}
    conf = Q.weighted([(fields["total"], 1.0), (fields["lines"], 0.75), (fields["priority"], 0.6)])
    rows = orders.join(lines, "o_orderkey", "left").withColumn("overall", Q.score(Q.completeness(fields), conf, Q.applicable_ratio([F.lit(None).cast("boolean")]))).withColumn("missing", Q.missing(fields))
    return rows.select("o_orderkey", F.round("overall", 4).alias("overall"), Q.band(F.col("overall")).alias("band"), Q.needs_review(F.col("overall"), F.size("missing")).alias("needs_review"), F.size("missing").alias("n_missing"))


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS t, bool_and(l_returnflag IN ('R', 'A', 'N')) AS domain FROM lineitem GROUP BY 1),
  r AS (SELECT o_orderkey, CASE WHEN t IS NULL OR t = 0 OR o_totalprice = 0 THEN NULL ELSE abs(o_totalprice - t) / abs(t) < 0.10 END AS total_ok,
    year(o_orderdate) BETWEEN 1996 AND 2000 AS year_ok, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE coalesce(n, 0) > 0 END AS lines_ok, coalesce(domain, FALSE) AS domain_ok FROM orders LEFT JOIN n ON l_orderkey = o_orderkey)
  SELECT *, round((coalesce(total_ok::INT, 0) + year_ok::INT + coalesce(lines_ok::INT, 0) + domain_ok::INT)::DOUBLE / ((total_ok IS NOT NULL)::INT + 1 + (lines_ok IS NOT NULL)::INT + 1), 4) AS ratio FROM r""")
def cross_validation(orders, lineitem):
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("t"), F.bool_and(F.col("l_returnflag").isin("R", "A", "N")).alias("domain"))
    rules = {"total_ok": C.within(F.col("o_totalprice"), F.col("t"), 0.10), "year_ok": F.year("o_orderdate").between(1996, 2000), "lines_ok": F.when(F.col("o_orderstatus") != "P", F.coalesce("n", F.lit(0)) > 0), "domain_ok": F.coalesce("domain", F.lit(False))}
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", *[v.alias(k) for k, v in rules.items()], F.round(Q.applicable_ratio(list(rules.values())), 4).alias("ratio"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'APPROVED' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'PAUSED' ELSE 'PENDING_REVIEW' END AS status FROM orders""")
def status_moves(orders):
    before = F.when(F.col("o_orderstatus") == "P", "PAUSED").otherwise("PENDING_REVIEW")
    event = F.when(F.col("o_orderpriority") == "1-URGENT", "approved").when(F.col("o_orderpriority") == "2-HIGH", "resumed").otherwise("none")
    return orders.select("o_orderkey", Q.moved(before, event).alias("status"))


# events


@query("""SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'Job enfileirado' WHEN 'view' THEN 'Job iniciado' WHEN 'error' THEN 'Job com falha' ELSE event_type END AS label, row_number() OVER (ORDER BY ts, event_id)::INT AS place, event_type = 'error' OR regexp_matches(lower(props), 'error|falha|failed') AS is_error FROM events""")
def event_timeline(events):
    codes = C.mapped(F.col("event_type"), {"click": "JOB_QUEUED", "view": "JOB_STARTED", "error": "JOB_FAILED"})
    return R.numbered(events, ["ts", "event_id"], "place").select("event_id", "ts", C.mapped(codes, EVENT_LABELS).alias("label"), is_error(codes, F.col("props")).alias("is_error"), F.col("place").cast("int").alias("place"))


@query("SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events WHERE event_type = 'error' OR regexp_matches(lower(props), 'error|falha|failed') GROUP BY user_id")
def error_events(events):
    return events.filter(is_error(F.when(F.col("event_type") == "error", "JOB_FAILED"), F.col("props"))).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


FOLD_SQL = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id, (ts, event_id)) AS last_event_id, count(*) AS n_events FROM events GROUP BY user_id"


@query(FOLD_SQL)
def state_fold_batch(events):
    return state_fold(events)


@query(FOLD_SQL)
def stream_state_fold(spark, sf_dir):
    return folded_stream(spark, sf_dir, "events.parquet")


@query("""WITH t AS (SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY ts DESC, event_id DESC) FILTER (r <= 10) AS trace, count(*) AS n FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id) SELECT c_custkey, n, trace FROM customer JOIN t ON user_id = c_custkey""")
def entity_trace(customer, events):
    found = trace(events, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.concat_ws(":", "event_id", "event_type"), most=10)
    return customer.join(found, F.col("c_custkey") == F.col("user_id")).select("c_custkey", "n", F.array_join("trace", ",").alias("trace"))
