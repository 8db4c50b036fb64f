"""Named queries over the driver's tables, each with the SQL that states its result.

The relational queries are written once, in PostgreSQL's spelling: the dialect
rewrites them for Spark, and DuckDB runs them as they stand, but for the few
spellings it lacks. The cache and change queries come from their own modules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import cached
from tidemark.plans.dialect import names, to_spark
from tidemark.sources import TABLES, arguments, run_over, table

_N = "(SELECT c_custkey, nullif(c_nationkey, 3) AS nk, c_acctbal, c_mktsegment FROM customer)"
_BIG = "o_orderstatus = 'F' AND o_totalprice > 400000"

SQL: dict[str, str] = {
    # predicates
    "scan_filter_eq": "SELECT p_partkey, p_name FROM part WHERE p_size = 7",
    "filter_ne": "SELECT s_suppkey FROM supplier WHERE s_nationkey <> 5 AND s_acctbal != 0",
    "filter_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_totalprice <= 400000",
    "filter_flip": "SELECT p_partkey FROM part WHERE 10 < p_size AND 20 >= p_size",
    "filter_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9",
    "filter_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_between_symmetric": "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 9 AND 5",
    "filter_not_between_symmetric": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN SYMMETRIC 45 AND 5",
    "filter_in": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3, 5)",
    "filter_not_in": "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 3, 5)",
    "filter_any_array": "SELECT p_partkey FROM part WHERE p_size = ANY (ARRAY[2, 4, 6])",
    "filter_any_less": "SELECT p_partkey FROM part WHERE p_size < ANY (ARRAY[2, 4])",
    "filter_all_array": "SELECT p_partkey FROM part WHERE p_size > ALL (ARRAY[20, 40])",
    "filter_like": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'B%' AND c_name NOT LIKE '%7'",
    "filter_ilike": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ILIKE 'b%g' AND c_name NOT ILIKE '%9'",
    "filter_null_tests": f"SELECT c_custkey, nk IS NULL AS missing FROM {_N} AS t WHERE nk IS NULL OR (nk IS NOT NULL AND c_acctbal < 0)",
    "filter_bool_tests": f"SELECT c_custkey FROM {_N} AS t WHERE (nk > 10) IS TRUE OR (nk > 10) IS UNKNOWN",
    "filter_bool_false": f"SELECT c_custkey FROM {_N} AS t WHERE (nk > 10) IS NOT FALSE AND (nk > 3) IS NOT UNKNOWN AND (c_acctbal > 0) IS NOT TRUE",
    "filter_or_not": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 200000) AND (o_orderpriority = '1-URGENT' OR o_custkey < 100)",
    "filter_three_valued": f"SELECT c_custkey FROM {_N} AS t WHERE NOT (nk = 5)",
    "filter_bool_column": "SELECT c_custkey FROM (SELECT c_custkey, c_acctbal > 5000 AS rich FROM customer) AS t WHERE rich",
    # projection
    "project_star": "SELECT * FROM nation",
    "project_qualified_star": "SELECT n.*, r.r_name FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey",
    "project_alias": "SELECT r_regionkey AS key, r_name AS label FROM region",
    "project_table_alias": "SELECT t.a, t.b FROM (SELECT r_regionkey, r_name FROM region) AS t(a, b)",
    "project_literals": "SELECT r_regionkey, 'x' AS word, 5 AS five, true AS yes FROM region",
    "distinct_rows": "SELECT DISTINCT p_brand, p_type FROM part",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "values_join": "SELECT n_name, v.tag FROM nation JOIN (VALUES (0, 'a'), (1, 'b'), (2, 'c')) AS v(k, tag) ON n_nationkey = v.k",
    "from_less": "SELECT 1 AS one, 'a' AS letter",
    # derived tables and CTEs
    "derived_table": "SELECT k, n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY l_suppkey) AS t WHERE n > 5",
    "cte_simple": "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey",
    "cte_chain": "WITH a AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, max(o_totalprice) AS top FROM a GROUP BY o_custkey) SELECT o_custkey, top FROM b WHERE top > 450000",
    "cte_materialized": "WITH a AS MATERIALIZED (SELECT n_nationkey, n_regionkey FROM nation), b AS NOT MATERIALIZED (SELECT r_regionkey FROM region) SELECT n_nationkey FROM a JOIN b ON n_regionkey = r_regionkey",
    "cte_column_alias": "WITH a(k, total) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT k, total FROM a WHERE total >= 15",
    "lateral_subquery": "SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS t",
    # joins
    "join_inner": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000",
    "join_left": f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE {_BIG}) AS o ON c_custkey = o_custkey",
    "join_right": f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE {_BIG}) AS o RIGHT JOIN customer ON c_custkey = o_custkey",
    "join_full": f"SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) AS c FULL JOIN (SELECT * FROM orders WHERE {_BIG}) AS o ON c_custkey = o_custkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n",
    "join_comma": "SELECT r_name, n_name FROM region, nation WHERE n_regionkey = r_regionkey",
    "join_self": "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "join_multi": "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name",
    "join_subquery": "SELECT n_name, t.n FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) AS t ON n_nationkey = t.c_nationkey",
    "join_using": "SELECT k, a.n_name, b.s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) AS a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) AS b USING (k)",
    "join_natural": "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) AS a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier) AS b",
    "join_theta": "SELECT a.r_name AS lo, b.r_name AS hi FROM region AS a JOIN region AS b ON a.r_regionkey < b.r_regionkey",
    # aggregation
    "agg_global": "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 2) AS mean FROM orders",
    "agg_group": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 4) AS disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber)::int8 AS s FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "agg_filter_subquery": "SELECT c_mktsegment, count(*) FILTER (WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS n FROM customer GROUP BY c_mktsegment",
    "agg_ordered_string": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "agg_ordered_array": "SELECT n_regionkey, array_agg(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    # windows
    "win_rank": "SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::int8 AS r FROM orders",
    "win_dense_rank": "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_size))::int8 AS r FROM part",
    "win_row_number": "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::int8 AS r FROM orders",
    "win_partition_sum": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders",
    "win_filtered_sum": "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS n FROM orders",
    "win_frame_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s FROM orders",
    "win_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders",
    "win_named": "SELECT o_orderkey, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    # order and limit
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "order_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "order_alias": "SELECT p_partkey AS k, -p_size AS p_size FROM part ORDER BY p_size, k LIMIT 15",
    "topn_group": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "nulls_order": f"SELECT c_custkey, nk FROM {_N} AS t ORDER BY nk DESC, c_custkey LIMIT 20",
    "nulls_order_rising": f"SELECT c_custkey, nk FROM {_N} AS t WHERE c_custkey < 200 ORDER BY nk, c_custkey OFFSET 150",
    # set operations
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_nested": "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20",
    "setop_join_branches": "SELECT c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2",
    "setop_order_limit": "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 12",
    # expressions
    "expr_arith": "SELECT p_partkey, p_size + 1 AS a, p_size - 2 AS b, p_size * 3 AS c, p_size % 7 AS d, round(p_retailprice / 3, 4) AS e FROM part",
    "expr_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s FROM orders",
    "expr_case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS s FROM orders",
    "expr_coalesce_nullif": "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS k, nullif(c_mktsegment, 'BUILDING') AS s FROM customer",
    "expr_greatest_least": "SELECT c_custkey, greatest(c_nationkey, nullif(10, 10), 12) AS g, least(c_nationkey, 12) AS l FROM customer",
    "expr_casts": "SELECT p_partkey, p_size::text AS t, p_size::float8 AS f, CAST(p_partkey AS int4) AS i, p_size::numeric(10,2) AS d, '7'::int2 AS s, (p_size > 5)::bool AS b FROM part",
    "fn_string": "SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS up, trim(c_name) AS tr, length(c_name)::int8 AS n FROM customer",
    "fn_date": "SELECT date_trunc('month', o_orderdate)::timestamp AS m, count(*) AS n FROM orders GROUP BY o_orderdate",
    # subqueries
    "sub_in": f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {_BIG})",
    "sub_any": f"SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE {_BIG})",
    "sub_not_in": f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_BIG})",
    "sub_not_in_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_acctbal > 9000)",
    "sub_all": f"SELECT c_custkey FROM customer WHERE c_custkey <> ALL (SELECT o_custkey FROM orders WHERE {_BIG})",
    "sub_exists": f"SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE {_BIG})",
    "sub_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sub_scalar_select": "SELECT n_name, (SELECT count(*) FROM region) AS n FROM nation",
    "sub_nested": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))",
    "corr_exists": f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_BIG})",
    "corr_not_exists": f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_BIG})",
    "corr_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = s_suppkey)",
    "corr_not_in": "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey = s_suppkey)",
    "corr_scalar_select": f"SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND {_BIG}) AS n FROM customer",
    "corr_scalar_where": "SELECT o_orderkey FROM orders AS o WHERE o_totalprice > (SELECT avg(i.o_totalprice) * 1.8 FROM orders AS i WHERE i.o_custkey = o.o_custkey)",
    "corr_multi": f"SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_BIG}) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    # what the optimizer does
    "pushdown_union": "SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) AS t WHERE k > 3",
    "pushdown_group": "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE k = 7",
    "constfold": "SELECT n_nationkey FROM nation WHERE n_nationkey = 12345 % 10000 - 2340",
    "expr_intdiv": "SELECT p_partkey, p_size / 4 AS q, -p_size / 4 AS neg, (p_size + 1) / 2 * 3 AS c, round(p_retailprice / 4, 4) AS f FROM part WHERE p_size / 2 > 3",
    "filter_distinct_from": f"SELECT c_custkey FROM {_N} AS t WHERE nk IS NOT DISTINCT FROM 5 OR (nk IS DISTINCT FROM 7 AND c_acctbal < 0)",
    "filter_case": "SELECT p_partkey FROM part WHERE CASE WHEN p_size > 25 THEN true ELSE p_retailprice < 1000 END",
    "fn_math": "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 6) AS s, floor(p_retailprice)::int8 AS f, ceil(p_retailprice)::int8 AS c, mod(p_size, 7) AS m FROM part",
    "sub_any_less": "SELECT s_suppkey FROM supplier WHERE s_acctbal < ANY (SELECT c_acctbal FROM customer WHERE c_custkey < 5)",
    "sub_all_greater": "SELECT s_suppkey FROM supplier WHERE s_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_custkey < 4)",
    "sub_all_empty": "SELECT s_suppkey FROM supplier WHERE s_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_custkey < 0)",
    "sub_any_null": "SELECT n_nationkey FROM nation WHERE NOT (n_nationkey > ANY (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_suppkey < 4))",
    "agg_array_desc": "SELECT n_regionkey, array_agg(n_name ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
    "agg_array_keys": "SELECT c_nationkey, array_agg(c_custkey ORDER BY c_mktsegment DESC, c_custkey) AS keys FROM customer GROUP BY c_nationkey",
    "agg_array_distinct": "SELECT c_nationkey, array_agg(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey",
    "corr_exists_empty_list": f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT FROM orders WHERE o_custkey = c_custkey AND {_BIG})",
    "setop_chain": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_custkey FROM customer WHERE c_custkey < 90 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "contradiction": "SELECT n_nationkey FROM nation WHERE n_nationkey = 5 AND n_nationkey = 6",
}

#: DuckDB's own spelling where it lacks PostgreSQL's.
DUCKDB: dict[str, str] = {
    "filter_between_symmetric": SQL["filter_between"],
    "filter_not_between_symmetric": SQL["filter_not_between"],
    "filter_bool_tests": f"SELECT c_custkey FROM {_N} AS t WHERE coalesce(nk > 10, true)",
    "filter_bool_false": f"SELECT c_custkey FROM {_N} AS t WHERE coalesce(nk > 10, true) AND (nk > 3) IS NOT NULL AND NOT coalesce(c_acctbal > 0, false)",
    "expr_intdiv": "SELECT p_partkey, CAST(p_size // 4 AS BIGINT) AS q, CAST(-p_size // 4 AS BIGINT) AS neg, CAST((p_size + 1) // 2 * 3 AS BIGINT) AS c, round(p_retailprice / 4, 4) AS f FROM part WHERE p_size // 2 > 3",
    "corr_exists_empty_list": SQL["corr_exists"],
    "nulls_order": SQL["nulls_order"].replace("nk DESC", "nk DESC NULLS FIRST"),
    "nulls_order_rising": SQL["nulls_order_rising"].replace("ORDER BY nk,", "ORDER BY nk NULLS LAST,"),
}


def run_sql(spark: SparkSession, base: str, sql: str, params: list | None = None) -> DataFrame:
    """One PostgreSQL SELECT over a dataset folder, with ``$n`` parameters."""
    used = names(sql)
    frames, args = {name: table(spark, base, name) for name in TABLES if name in used}, arguments(params)
    run = lambda text: run_over(spark, frames, text, args)
    return run(to_spark(sql, run))


def _relational(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, base: run_sql(spark, base, sql)


def params_bind(spark: SparkSession, base: str) -> DataFrame:
    return run_sql(spark, base, "SELECT p_partkey FROM part WHERE p_size = $1 AND p_brand <> $2", [7, "Brand#11"])


def expr_arith_intdiv(spark: SparkSession, base: str) -> DataFrame:
    from tidemark.plans.dialect import integer_division

    return run_sql(spark, base, f"SELECT p_partkey, {integer_division('p_size', '4')} AS q, {integer_division('-p_size', '4')} AS neg, -p_size % 4 AS r FROM part")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _relational(sql) for name, sql in SQL.items()}
def params_array(spark: SparkSession, base: str) -> DataFrame:
    return run_sql(spark, base, "SELECT p_partkey FROM part WHERE p_size = ANY ($1) AND p_brand <> ALL ($2)", [[2, 4, 6], ["Brand#11", "Brand#12"]])


QUERIES |= {"params_array": params_array, "params_bind": params_bind, "expr_arith_intdiv": expr_arith_intdiv}
ORACLE_SQL: dict[str, str] = {**SQL, **DUCKDB}
ORACLE_SQL |= {
    "params_array": "SELECT p_partkey FROM part WHERE p_size IN (2, 4, 6) AND p_brand NOT IN ('Brand#11', 'Brand#12')",
    "params_bind": "SELECT p_partkey FROM part WHERE p_size = 7 AND p_brand <> 'Brand#11'",
    "expr_arith_intdiv": "SELECT p_partkey, CAST(trunc(p_size / 4) AS BIGINT) AS q, CAST(trunc(-p_size / 4) AS BIGINT) AS neg, -p_size % 4 AS r FROM part",
}

QUERIES |= cached.QUERIES
ORACLE_SQL |= cached.ORACLE_SQL
