"""Ad-hoc SQL over one table, and the relational operators around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.plans.adapters import table
from provena.plans.registry import query
from provena.sources import tabular

#: Name, table and the one statement that both engines run over it as ``data``.
STATEMENTS = (
    ("tabular_groupby", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS price FROM data GROUP BY l_returnflag, l_linestatus"),
    ("tabular_having", "orders", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM data GROUP BY o_custkey HAVING count(*) > 12"),
    ("tabular_case", "orders", "SELECT o_orderpriority, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large, min(o_totalprice) AS least, max(o_totalprice) AS most FROM data GROUP BY o_orderpriority"),
    ("tabular_join_cte", "orders", "WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM data GROUP BY o_custkey), m AS (SELECT avg(total) AS mean FROM t) SELECT d.o_orderkey, d.o_custkey FROM data d JOIN t ON d.o_custkey = t.o_custkey JOIN m ON t.total > 1.5 * m.mean WHERE d.o_orderstatus = 'P'"),
    ("tabular_self_join", "part", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM data a JOIN data b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"),
    ("tabular_left_join", "orders", "SELECT a.o_custkey, count(b.o_orderkey) AS n FROM data a LEFT JOIN data b ON a.o_custkey = b.o_custkey AND b.o_orderstatus = 'P' GROUP BY a.o_custkey"),
    ("tabular_right_full_join", "supplier", "SELECT coalesce(a.s_nationkey, b.s_nationkey) AS nation, count(a.s_suppkey) AS na, count(b.s_suppkey) AS nb FROM (SELECT * FROM data WHERE s_acctbal > 5000) a FULL JOIN (SELECT * FROM data WHERE s_acctbal < 0) b ON a.s_nationkey = b.s_nationkey GROUP BY coalesce(a.s_nationkey, b.s_nationkey)"),
    ("tabular_theta_join", "supplier", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM data a JOIN data b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal < a.s_acctbal + 20"),
    ("tabular_window_rank", "customer", "SELECT c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q FROM data"),
    ("tabular_window_frame", "orders", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS previous, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first FROM data"),
    ("tabular_union", "nation", "SELECT n_name AS name FROM data WHERE n_regionkey = 1 UNION SELECT n_name FROM data WHERE n_nationkey < 8"),
    ("tabular_union_all", "nation", "SELECT n_regionkey, count(*) AS n FROM (SELECT n_regionkey FROM data UNION ALL SELECT n_regionkey FROM data WHERE n_nationkey % 2 = 0) u GROUP BY n_regionkey"),
    ("tabular_intersect", "customer", "SELECT c_nationkey FROM data WHERE c_acctbal > 9900 INTERSECT SELECT c_nationkey FROM data WHERE c_acctbal < -900"),
    ("tabular_except", "customer", "SELECT c_nationkey FROM data EXCEPT SELECT c_nationkey FROM data WHERE c_acctbal > 9900"),
    ("tabular_subquery", "part", "SELECT p_partkey, p_retailprice FROM data d WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM data e WHERE e.p_brand = d.p_brand)"),
    ("tabular_exists", "orders", "SELECT o_orderkey FROM data d WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM data e WHERE e.o_custkey = d.o_custkey AND e.o_orderkey > d.o_orderkey)"),
    ("tabular_in", "lineitem", "SELECT l_orderkey, count(*) AS n FROM data WHERE l_partkey IN (SELECT l_partkey FROM data GROUP BY l_partkey HAVING count(*) > 40) GROUP BY l_orderkey"),
    ("tabular_dates", "orders", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, count(*) AS n FROM data WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY year(o_orderdate), month(o_orderdate)"),
    ("tabular_recursive_cte", "region", "WITH RECURSIVE s(n, t) AS (SELECT 1, 1 UNION ALL SELECT n + 1, t + n + 1 FROM s WHERE n < 20) SELECT n, t FROM s"),
    ("tabular_distinct", "part", "SELECT DISTINCT p_brand, p_size FROM data WHERE p_size BETWEEN 10 AND 12"),
    ("tabular_order_limit", "part", "SELECT p_partkey, p_retailprice FROM data ORDER BY p_retailprice DESC, p_partkey LIMIT 15 OFFSET 5"),
    ("tabular_strings", "customer", "SELECT c_custkey, upper(substr(c_name, 1, 8)) AS head, CAST(length(c_name) AS BIGINT) AS n, trim(c_mktsegment) AS segment, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM data"),
    ("tabular_conditional", "supplier", "SELECT s_suppkey, round(abs(s_acctbal), 1) AS a, CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 1000 THEN 'low' ELSE 'high' END AS level FROM data"),
    ("tabular_count_distinct", "lineitem", "SELECT l_linenumber, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM data GROUP BY l_linenumber"),
)


def _statement(name: str, source: str, sql: str):
    @query(name, f"WITH data AS (SELECT * FROM {source}) SELECT * FROM ({sql}) result")
    def run(spark, sf_dir):
        return tabular.query(spark, table(spark, sf_dir, source), sql)

    return run


for _name, _source, _sql in STATEMENTS:
    _statement(_name, _source, _sql)


@query("tabular_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY ALL")
def tabular_group_concat(spark, sf_dir):
    return tabular.query(spark, table(spark, sf_dir, "nation"), "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM data GROUP BY n_regionkey")


@query("tabular_cube", "SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def tabular_cube(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "n")


@query("tabular_infer_schema", "SELECT * FROM (VALUES ('id', 'INTEGER'), ('name', 'TEXT'), ('balance', 'REAL'), ('col_2024', 'TEXT')) t(name, kind)")
def tabular_infer_schema(spark, sf_dir):
    c = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.col("c_custkey").cast("string"), "c_name", F.replace(F.round("c_acctbal", 2).cast("string"), F.lit("."), F.lit(",")), "c_mktsegment")
    found = tabular.kinds(c.toDF(*tabular.column_names(["Id", "Name", "Balance ", "2024"])))
    return spark.createDataFrame(list(found.items()), "name string, kind string")


@query("tabular_decimal_text", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1234.56 WHEN 1 THEN 1000.5 ELSE 7.25 END::DOUBLE AS v FROM customer""")
def tabular_decimal_text(spark, sf_dir):
    from provena.functions.text import decimal_text

    text = F.element_at(F.array(*map(F.lit, ("1.234,56", "1,000.50", "7,25"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", decimal_text(text).cast("double").alias("v"))


@query("tabular_intent", "SELECT item_id, item_id % 2 = 0 AS asks FROM benchmark")
def tabular_intent(spark, sf_dir):
    q = F.when(F.col("item_id") % 2 == 0, "Qual è la somma dei costi?").otherwise("xyz")
    return table(spark, sf_dir, "benchmark").select("item_id", tabular.tabular_intent(q).alias("asks"))


@query("tabular_star_join", """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY ALL""")
def tabular_star_join(spark, sf_dir):
    li, o, c, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    o = o.where((F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, (F.col("l_suppkey") == s.s_suppkey) & (F.col("s_nationkey") == F.col("c_nationkey")))
    j = j.join(n, F.col("s_nationkey") == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
