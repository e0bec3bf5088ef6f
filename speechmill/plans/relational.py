"""Relational queries on the star schema: Spark built-ins, with no counterpart in the operators of the corpus tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Each is plain SQL that Spark and DuckDB read alike; Catalyst plans it.
SQL = {
    "relational_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "relational_revenue_by_nation": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "relational_top_orders": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""",
    "relational_cube": """
        SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "relational_rollup": """
        SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "relational_grouping_sets": """
        SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())""",
    "relational_semi_join": """
        SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""",
    "relational_anti_join": """
        SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "relational_full_join": """
        SELECT coalesce(s.k, c.k) AS nationkey, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) s
        FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) c ON s.k = c.k""",
    "relational_ranking": """
        SELECT n_name, c_custkey, rk, dr, quart FROM (SELECT c_nationkey, c_custkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quart FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) t
        JOIN nation ON c_nationkey = n_nationkey WHERE rk <= 5""",
    "relational_moving_average": """
        SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders""",
    "relational_intersect": """
        SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier""",
    "relational_except_all": """
        SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier""",
    "relational_having": """
        SELECT l_orderkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150""",
    "relational_case_pivot": """
        SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority""",
    "relational_distinct": """
        SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag""",
    "relational_percent_rank": """
        SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""",
    "relational_range_frame": """
        SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS near FROM orders""",
    "relational_intersect_all": """
        SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _views(spark, sf_dir).sql(sql)

    return run


def _views(spark: SparkSession, sf_dir: str) -> SparkSession:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(sql) for name, sql in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
