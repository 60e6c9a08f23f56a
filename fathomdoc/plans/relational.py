"""Registered read-only SQL over the star schema: the guard, parameters, row caps, and what SELECT can say."""

import re

from pyspark.sql import functions as F

from fathomdoc.functions import fixed
from fathomdoc.operators import sqltool as Q
from fathomdoc.plans import sql_parts as S
from fathomdoc.plans.registry import query, table
from fathomdoc.session import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def views(spark, folder, sql: str):
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            table(spark, folder, name).createOrReplaceTempView(name)


def register_sql(name: str, sql: str, duckdb: str | None = None, args: dict | None = None):
    """Registers a text that Spark runs through the guard; ``duckdb`` where its dialect differs."""
    @query(name, duckdb or sql)
    def run(spark, folder):
        views(spark, folder, sql)
        return Q.read_only_sql(spark, sql, args)


register_sql("l1_projection_and_predicates", """
SELECT o_orderkey, o_orderpriority, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid'
  ELSE 'low' END AS band FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%-%' AND o_totalprice BETWEEN 1000 AND 400000
  AND o_orderdate IS NOT NULL""")

register_sql("l2_equi_joins", """
SELECT c.c_custkey, n.n_name, r.r_name, o.o_orderkey, s.s_suppkey FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey
RIGHT JOIN region r ON r.r_regionkey = n.n_regionkey
FULL JOIN supplier s ON s.s_suppkey = c.c_custkey""")

# Every line meets the band it can lie in, by an equi-join on the band's number; the range is the further condition.
register_sql("l3_range_join", """
SELECT b.r_name, count(*) AS n, CAST(sum(l.l_quantity) AS BIGINT) AS quantity FROM lineitem l
JOIN (SELECT r_name, r_regionkey AS band, r_regionkey * 10 + 1 AS low, r_regionkey * 10 + 9 AS high FROM region) b
  ON CAST(floor(l.l_quantity / 10) AS INT) = b.band AND l.l_quantity >= b.low AND l.l_quantity < b.high
GROUP BY b.r_name""")

register_sql("l4_semi_and_anti_joins", """
SELECT c_custkey, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)
  AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
  AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)""")

register_sql("l5_lateral_join", """
SELECT c.c_custkey, l.orders_placed, l.spent FROM customer c,
  LATERAL (SELECT count(*) AS orders_placed, round(sum(o.o_totalprice), 2) AS spent
           FROM orders o WHERE o.o_custkey = c.c_custkey) l""")

register_sql("l6_aggregates", """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers,
  count(*) FILTER (WHERE l_discount > 0.05) AS discounted
FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")

register_sql("l7_grouping_sets", """
SELECT n_name, c_mktsegment, count(*) AS customers, CAST(grouping(n_name) AS INT) AS all_nations
FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((n_name, c_mktsegment), (n_name), ())""")

register_sql("l7_cube_and_rollup", """
SELECT 'cube' AS kind, o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders
GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL SELECT 'rollup', l_returnflag, l_linestatus, count(*) FROM lineitem
GROUP BY ROLLUP (l_returnflag, l_linestatus)""")

register_sql("l8_windows", """
SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS nth,
  CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS place,
  lag(o_orderkey) OVER w AS earlier,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last_three
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")

register_sql("l9_top_with_offset", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50 OFFSET 10""")

register_sql("l10_set_operations", """
SELECT 'union' AS kind, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', k FROM (SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT user_id FROM events)
UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'except all', k FROM (SELECT user_id AS k FROM events EXCEPT ALL SELECT c_custkey FROM customer)""")

register_sql("l11_recursive_cte", """
WITH RECURSIVE steps(nation, low, depth) AS (
  SELECT n_nationkey, n_nationkey, 0 FROM nation
  UNION ALL SELECT nation, low - 5, depth + 1 FROM steps WHERE low >= 5),
spent AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY c_nationkey)
SELECT s.nation, CAST(max(depth) AS INT) AS depth, CAST(sum(coalesce(customers, 0)) AS BIGINT) AS customers
FROM steps s LEFT JOIN spent ON c_nationkey = low GROUP BY s.nation""")

register_sql("l12_subqueries", """
SELECT p_partkey, p_retailprice, (SELECT count(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS sold
FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)
  AND p_size = (SELECT max(q.p_size) FROM part q WHERE q.p_brand = p.p_brand)""")

register_sql("l13_functions", """
SELECT event_id, upper(substr(event_type, 1, 3)) AS short, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS month, round(sqrt(abs(value)), 6) AS root,
  CAST(get_json_object(props, '$.k') AS INT) AS k, size(split(event_type, 'c')) AS parts, concat_ws('-', event_type, user_id) AS tag
FROM events""", """
SELECT event_id, upper(substr(event_type, 1, 3)) AS short, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month,
  round(sqrt(abs(value)), 6) AS root, CAST(json_extract(props, '$.k') AS INT) AS k,
  CAST(len(string_split(event_type, 'c')) AS INT) AS parts, concat_ws('-', event_type, user_id) AS tag FROM events""")

PARAMETERS = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= {low} AND o_orderstatus = {status}"
register_sql("l14_named_parameters", PARAMETERS.format(low=":low", status=":status"),
             PARAMETERS.format(low="200000", status="'O'"), {"low": 200000, "status": "O"})

CAPPED = """SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice >= {low} GROUP BY o_custkey
ORDER BY n DESC, o_custkey"""


@query("k6_g7_capped_rows", CAPPED.format(low=1000) + " LIMIT 25")
def capped_rows(spark, folder):
    views(spark, folder, CAPPED)
    return Q.guarded_sql(spark, CAPPED.format(low=":low") + "; -- all", {"low": 1000}, max_rows=25)[0]


@query("e7_g7_cap_summary", f"""SELECT least(count(*), 200) AS row_count, count(*) > 200 AS truncated,
  CAST(200 AS BIGINT) AS max_rows, {S.quoted(CAPPED.format(low=":low"))} AS sql, ['o_custkey', 'n'] AS columns
FROM ({CAPPED.format(low=1000)})""")
def cap_summary(spark, folder):
    views(spark, folder, CAPPED)
    return Q.guarded_sql(spark, CAPPED.format(low=":low") + "; -- all", {"low": 1000}, max_rows=500)[1]


@query("b4_json_safe_rows", """SELECT '{"o_orderkey":' || o_orderkey || ',"price":"' || CAST(o_totalprice AS DECIMAL(12,2)) ||
  '","at":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN '.250000' ELSE '' END ||
  '","o_orderstatus":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}' AS row
FROM orders""")
def json_safe_rows(spark, folder):
    at = F.col("o_orderdate") + F.when(F.col("o_orderkey") % 2 == 0, F.expr("INTERVAL '0.25' SECOND")).otherwise(
        F.expr("INTERVAL '0' SECOND"))
    return Q.json_safe(table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), at.alias("at"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus")))


def reason(text):
    return "'" + text + "'"


@query("c10_i20_guarded_query_log", f"""SELECT o_orderkey,
  CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN {reason(fixed.NOT_READ_ONLY)} WHEN 2 THEN {reason(fixed.MANY_STATEMENTS)}
    WHEN 3 THEN NULL WHEN 4 THEN {reason(fixed.NOT_SELECT)} WHEN 5 THEN {reason(fixed.EMPTY)}
    WHEN 6 THEN {reason(fixed.NOT_ASCII)} ELSE NULL END AS reason,
  CASE o_orderkey % 8 WHEN 0 THEN 'SELECT ' || o_orderkey WHEN 3 THEN 'select   ''-- ' || o_orderpriority || '''   AS x'
    WHEN 7 THEN 'WITH t AS (SELECT ' || o_custkey || ' AS updated_at) SELECT * FROM t' END AS normalised FROM orders""")
def guarded_query_log(spark, folder):
    key, which = F.col("o_orderkey"), F.col("o_orderkey") % 8
    log = (
        F.when(which == 0, F.concat(F.lit("  SELECT "), key, F.lit(" ;\n")))
        .when(which == 1, F.concat(F.lit("SELECT * FROM t WHERE a = 'Update' AND b = "), key))
        .when(which == 2, F.concat(F.lit("SELECT ';' AS "), "o_orderpriority"))
        .when(which == 3, F.concat(F.lit("select /* a /* drop */ "), key, F.lit(" */ '-- "), "o_orderpriority",
                                   F.lit("' -- "), key, F.lit("\n AS x")))
        .when(which == 4, F.concat(F.lit("(SELECT "), key, F.lit(")")))
        .when(which == 5, F.concat(F.lit("-- "), key, F.lit("\n ")))
        .when(which == 6, F.concat(F.lit("SELECT 'é' AS a, "), key))
        .otherwise(F.concat(F.lit("ＷＩＴＨ t AS (SELECT "), "o_custkey", F.lit(" AS updated_at) SELECT * FROM t")))
    )
    queries = spread(table(spark, folder, "orders")).withColumn("sql", log)
    return Q.validate_select(queries).select("o_orderkey", "reason", "normalised")
