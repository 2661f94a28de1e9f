"""Registered queries over the driver's tables: statements of the dialect, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.plans.binder import Binder, Table
from docframe.plans.parser import parse

#: Column that gives the row order of a table.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id",
}


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], Table]:
    """Finds the Parquet tables of a folder, and those derived from them, by name."""

    def resolve(name: str) -> Table:
        if name in DERIVED:
            return DERIVED[name](spark, sf_dir)
        return Table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS.get(name))

    return resolve


def _event_dicts(spark: SparkSession, sf_dir: str) -> Table:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Table(events.withColumn("props", F.from_json("props", "struct<k: bigint>")), "event_id")


def _user_types(spark: SparkSession, sf_dir: str) -> Table:
    """A list column: the sorted kinds of events of each user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Table(events.groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("types")), "user_id")


def _slot_types(spark: SparkSession, sf_dir: str) -> Table:
    """A list column with few kinds: the sorted kinds of events of each user in each minute."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    held = events.groupBy("user_id", slot.alias("slot")).agg(F.min("event_id").alias("first"), F.sort_array(F.collect_set("event_type")).alias("types"))
    return Table(held.select("first", "user_id", "types"), "first")


DERIVED: dict[str, Callable[[SparkSession, str], Table]] = {"event_dicts": _event_dicts, "user_types": _user_types, "slot_types": _slot_types}

#: Views by name: statements of the dialect, in order of definition.
VIEWS = {
    "named_columns": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "big_orders": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000",
    "named_orders": "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "biggest_orders": "SELECT o_orderkey, o_totalprice FROM big_orders WHERE o_totalprice > 450000",
}

#: Names that views give to the columns of their statements.
VIEW_COLUMNS = {"named_columns": ("k", "who", "price")}

#: name: (statement of the dialect, DuckDB SQL)
STATEMENTS: dict[str, tuple[str, str]] = {
    "prj_star_region": ("SELECT * FROM region", "SELECT * FROM region"),
    "prj_columns_alias": ("SELECT c_name AS name, c_acctbal bal FROM customer", "SELECT c_name AS name, c_acctbal AS bal FROM customer"),
    "prj_unknown_null": ("SELECT c_custkey, nosuch FROM customer", "SELECT c_custkey, NULL::VARCHAR AS nosuch FROM customer"),
    "prj_autonames": (
        "SELECT p_partkey, p_size + 1, (p_size + 2) * 3 FROM part",
        'SELECT p_partkey, (p_size + 1)::BIGINT AS "p_size + 1", ((p_size + 2) * 3)::BIGINT AS "p_size + 2 * 3" FROM part',
    ),
    "prj_backtick_case": ("SELECT `p_name` AS `the name`, P_NAME AS upper FROM part", 'SELECT p_name AS "the name", NULL::VARCHAR AS upper FROM part'),
    "prj_dict_access": (
        "SELECT event_id, props.k AS k FROM event_dicts WHERE props.k > 50",
        "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT > 50",
    ),
    "exp_int_div_mod": (
        "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, -p_size AS m, -p_size / 7 AS nq, (0 - p_size) % 7 AS nr, p_size / (p_size - p_size) AS z FROM part",
        "SELECT p_partkey, p_size::BIGINT // 7 AS q, p_size::BIGINT % 7 AS r, -p_size::BIGINT AS m, -(p_size::BIGINT // 7) AS nq, (-p_size::BIGINT) % 7 AS nr, NULL::BIGINT AS z FROM part",
    ),
    "exp_float_div_zero": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_tax AS r, l_extendedprice % l_tax AS m FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / nullif(l_tax, 0) AS r, l_extendedprice % nullif(l_tax, 0) AS m FROM lineitem",
    ),
    "exp_precedence": (
        "SELECT p_partkey, (p_size + 2) * 3 - p_size * 2 AS a, p_size + 2 * 3 - p_size * 2 AS b, p_size - 1 - 2 AS c, p_size*2 AS d FROM part",
        "SELECT p_partkey, ((p_size + 2) * 3 - p_size * 2)::BIGINT AS a, (p_size + 6 - p_size * 2)::BIGINT AS b, (p_size - 3)::BIGINT AS c, (p_size * 2)::BIGINT AS d FROM part",
    ),
    "exp_name_split": (
        "SELECT p_partkey, p_size-1 AS a, p_retailprice/p_size AS b FROM part",
        "SELECT p_partkey, (p_size - 1)::BIGINT AS a, p_retailprice / nullif(p_size, 0) AS b FROM part",
    ),
    "exp_overflow_null": (
        "SELECT p_partkey, p_size * 9000000000000000000 AS x, p_size + 9223372036854775800 AS y FROM part",
        "SELECT p_partkey, TRY(p_size::BIGINT * 9000000000000000000) AS x, TRY(p_size::BIGINT + 9223372036854775800) AS y FROM part",
    ),
    "exp_not_numeric": ("SELECT p_partkey, p_name + 1 AS x FROM part", "SELECT p_partkey, NULL::VARCHAR AS x FROM part"),
    "exp_case": (
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer",
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer",
    ),
    "exp_case_no_else": (
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_nationkey END AS n, CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE 0 END AS m FROM customer",
        "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_nationkey::BIGINT END AS n, CASE WHEN c_acctbal < 0 THEN c_acctbal ELSE 0 END AS m FROM customer",
    ),
    "exp_case_mixed_types": (
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE p_brand END AS x FROM part",
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE p_brand END AS x FROM part",
    ),
    "exp_interval": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + INTERVAL 30 DAYS AS later, l_shipdate - INTERVAL l_linenumber * 2 DAY AS earlier FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + to_days(30) AS later, l_shipdate - to_days((l_linenumber * 2)::INTEGER) AS earlier FROM lineitem",
    ),
    "exp_datediff": (
        "SELECT l.l_orderkey AS k, l.l_linenumber AS n, l.l_partkey AS p, DATEDIFF(l.l_shipdate, o.o_orderdate) AS d FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
        "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, datesub('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "exp_datediff_partial": (
        "SELECT event_id, DATEDIFF(ts, '2024-01-01') AS none, DATEDIFF(ts, ts - INTERVAL 2 DAY) AS two FROM events",
        "SELECT event_id, NULL::VARCHAR AS none, datesub('day', ts - to_days(2), ts) AS two FROM events",
    ),
    "exp_current_date": (
        "SELECT o_orderkey, CASE WHEN CURRENT_DATE > o_orderdate AND CURRENT_TIMESTAMP > o_orderdate THEN 1 ELSE 0 END AS past FROM orders",
        "SELECT o_orderkey, CASE WHEN current_date > o_orderdate THEN 1 ELSE 0 END::BIGINT AS past FROM orders",
    ),
    "prd_eq_ne_range": (
        "SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING' AND c_acctbal >= 100 AND c_acctbal <= 5000.5 AND c_nationkey = 3",
        "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 100 AND c_acctbal <= 5000.5 AND c_nationkey = 3",
    ),
    "prd_and_or_paren": (
        "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND (p_size + 1) * 2 > 4 OR p_brand = 'Brand#11' AND p_size = 10",
        "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND (p_size + 1) * 2 > 4 OR p_brand = 'Brand#11' AND p_size = 10",
    ),
    "prd_both_sides": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice * l_discount > l_quantity * 100 + 1000",
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice * l_discount > l_quantity * 100 + 1000",
    ),
    "prd_in_list": (
        "SELECT p_partkey FROM part WHERE p_size IN (1, '7', 49, NULL) AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'LARGE', 'MEDIUM')",
        "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49) AND p_type IN ('ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'LARGE', 'MEDIUM')",
    ),
    "prd_in_float_on_int": ("SELECT p_partkey FROM part WHERE p_size IN (5.0)", "SELECT p_partkey FROM part WHERE false"),
    "prd_like_ci": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%D_W%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%D_W%'"),
    "prd_not_like": ("SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'BRAND#1%'", "SELECT p_partkey FROM part WHERE p_brand NOT ILIKE 'BRAND#1%'"),
    "prd_like_number": ("SELECT p_partkey FROM part WHERE p_size LIKE '1_'", "SELECT p_partkey FROM part WHERE p_size::VARCHAR LIKE '1_'"),
    "prd_like_newline": ("SELECT doc_id FROM documents WHERE text LIKE '%the%license%'", "SELECT doc_id FROM documents WHERE text ILIKE '%the%license%'"),
    "prd_is_null": (
        "SELECT k, x FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_name END AS x FROM customer) WHERE x IS NULL OR x LIKE '%7'",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_name END AS x FROM customer WHERE NOT c_acctbal > 0 OR c_name LIKE '%7'",
    ),
    "prd_is_not_null_expr": (
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice / l_tax IS NOT NULL",
        "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_tax <> 0",
    ),
    "prd_null_compare": (
        "SELECT k FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS x FROM customer) WHERE x != 3 OR x NOT LIKE '3%'",
        "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND (c_nationkey <> 3 OR c_nationkey::VARCHAR NOT LIKE '3%')",
    ),
    "prd_list_in": (
        "SELECT user_id FROM user_types WHERE types IN ('click', 'purchase')",
        "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type IN ('click', 'purchase'))",
    ),
    "prd_list_like": (
        "SELECT first FROM slot_types WHERE types LIKE 'P%' AND types NOT LIKE '%view%'",
        "SELECT min(event_id) AS first FROM events GROUP BY user_id, floor(epoch_us(ts) / 60000000) HAVING bool_or(event_type ILIKE 'P%') AND NOT bool_or(event_type ILIKE '%view%')",
    ),
    "prd_list_equals_text": (
        "SELECT user_id, COUNT(*) AS n FROM slot_types WHERE types = 'click' GROUP BY user_id",
        "SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events GROUP BY user_id, floor(epoch_us(ts) / 60000000) HAVING array_to_string(list_sort(list(DISTINCT event_type)), ', ') = 'click') GROUP BY user_id",
    ),
    "prd_mixed_string_compare": ("SELECT p_partkey FROM part WHERE p_size > '10'", "SELECT p_partkey FROM part WHERE p_size::VARCHAR > '10'"),
    "prd_float_string_compare": ("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity = '5'", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity = 5"),
    "prd_date_literal": (
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1995-03-01' AND o_orderdate <= '1996-01-01' AND o_orderdate != '1995-06-01T00:00:00'",
        "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderdate <> TIMESTAMP '1995-06-01'",
    ),
    "prd_time_literal": (
        "SELECT event_id FROM events WHERE ts > '2024-01-02T03:04:05' AND ts <= '2024-02-03T04:05:06'",
        "SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') > '2024-01-02T03:04:05' AND strftime(ts, '%Y-%m-%dT%H:%M:%S') <= '2024-02-03T04:05:06'",
    ),
    "join_two": (
        "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000",
        'SELECT c_name AS "c.c_name", o_orderkey AS "o.o_orderkey" FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000',
    ),
    "join_three": (
        "SELECT c.c_custkey AS c, o.o_orderkey AS o, l.l_linenumber AS l, l.l_partkey AS p FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45",
        "SELECT c_custkey AS c, o_orderkey AS o, l_linenumber AS l, l_partkey AS p FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45",
    ),
    "join_star": (
        "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
        'SELECT n_nationkey AS "n.n_nationkey", n_name AS "n.n_name", n_regionkey AS "n.n_regionkey", r_regionkey AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON n_regionkey = r_regionkey',
    ),
    "join_swapped_on": (
        "SELECT n.n_name AS n, r.r_name AS r FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "join_self": (
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    ),
    "join_unqualified": (
        "SELECT c_name AS n, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'",
        "SELECT c_name AS n, o_orderkey AS k FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'",
    ),
    "join_null_key": (
        "SELECT s.k AS k, n.n_name AS name FROM (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 0 THEN s_nationkey END AS nk FROM supplier) s JOIN nation n ON s.nk = n.n_nationkey",
        "SELECT s_suppkey AS k, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0",
    ),
    "join_cross_type_key": (
        "SELECT a.n AS n, b.size AS size FROM (SELECT n_nationkey AS n FROM nation) a JOIN (SELECT p_size * 1.0 AS size, COUNT(*) AS c FROM part GROUP BY p_size) b ON a.n = b.size",
        "SELECT n_nationkey::BIGINT AS n, p_size::DOUBLE AS size FROM nation JOIN (SELECT DISTINCT p_size FROM part) ON n_nationkey = p_size",
    ),
    "join_group": (
        "SELECT r.r_name AS r, COUNT(*) AS n, SUM(c.c_nationkey) AS s FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
        "SELECT r_name AS r, count(*) AS n, sum(c_nationkey::DOUBLE) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "agg_global": (
        "SELECT COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_shipdate) AS first, MAX(l_returnflag) AS flag, COUNT(l_tax) AS t FROM lineitem",
        "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_shipdate) AS first, max(l_returnflag) AS flag, count(l_tax) AS t FROM lineitem",
    ),
    "agg_global_empty": (
        "SELECT COUNT(*) AS n, SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_name) AS m FROM part WHERE p_size < 0",
        "SELECT 0::BIGINT AS n, NULL::DOUBLE AS s, NULL::DOUBLE AS a, NULL::VARCHAR AS m",
    ),
    "agg_group_empty": ("SELECT p_brand, COUNT(*) AS n FROM part WHERE p_size < 0 GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE p_size < 0 GROUP BY p_brand"),
    "agg_group_all_funcs": (
        "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity), MIN(l_quantity), MAX(l_shipdate), AVG(l_linenumber) FROM lineitem GROUP BY l_returnflag, l_linestatus",
        'SELECT l_returnflag, l_linestatus, count(*) AS "COUNT(*)", sum(l_quantity) AS "SUM(l_quantity)", min(l_quantity) AS "MIN(l_quantity)", max(l_shipdate) AS "MAX(l_shipdate)", avg(l_linenumber) AS "AVG(l_linenumber)" FROM lineitem GROUP BY ALL',
    ),
    "agg_sum_case": (
        "SELECT l_shipdate, SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, COUNT(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n FROM lineitem GROUP BY l_shipdate",
        "SELECT l_shipdate, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS n FROM lineitem GROUP BY l_shipdate",
    ),
    "agg_arith": (
        "SELECT p_brand, SUM(p_size) / COUNT(*) AS mean, -COUNT(*) AS m, MAX(p_size) - MIN(p_size) AS spread FROM part GROUP BY p_brand",
        "SELECT p_brand, sum(p_size::DOUBLE) / count(*) AS mean, -count(*) AS m, (max(p_size) - min(p_size))::BIGINT AS spread FROM part GROUP BY p_brand",
    ),
    "agg_sum_not_numeric": ("SELECT COUNT(p_name) AS n, SUM(p_name) AS s FROM part", "SELECT count(p_name) AS n, NULL::DOUBLE AS s FROM part"),
    "agg_min_max_text": ("SELECT p_brand, MIN(p_name) AS a, MAX(p_type) AS b FROM part GROUP BY p_brand", "SELECT p_brand, min(p_name) AS a, max(p_type) AS b FROM part GROUP BY p_brand"),
    "agg_first_row": (
        "SELECT c_mktsegment, c_name, c_custkey + 1 AS k, COUNT(*) AS n FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, arg_min(c_name, c_custkey) AS c_name, min(c_custkey) + 1 AS k, count(*) AS n FROM customer GROUP BY c_mktsegment",
    ),
    "agg_having_alias": ("SELECT p_size, COUNT(*) AS n FROM part GROUP BY p_size HAVING n > 40", "SELECT p_size::BIGINT AS p_size, count(*) AS n FROM part GROUP BY p_size HAVING count(*) > 40"),
    "agg_having_expr": (
        "SELECT p_size, COUNT(*) AS n FROM part GROUP BY p_size HAVING COUNT(*) > 30 AND MAX(p_retailprice) > 997",
        "SELECT p_size::BIGINT AS p_size, count(*) AS n FROM part GROUP BY p_size HAVING count(*) > 30 AND max(p_retailprice) > 997",
    ),
    "having_no_group": ("SELECT p_partkey FROM part HAVING p_size = 7", "SELECT p_partkey FROM part WHERE p_size = 7"),
    "agg_group_alias": (
        "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS band, COUNT(*) AS n FROM part GROUP BY band",
        "SELECT CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS band, count(*) AS n FROM part GROUP BY 1",
    ),
    "agg_group_expr": ("SELECT p_size / 10 AS ten, COUNT(*) AS n FROM part GROUP BY p_size / 10", "SELECT p_size::BIGINT // 10 AS ten, count(*) AS n FROM part GROUP BY 1"),
    "agg_group_dict": (
        "SELECT props.k AS k, COUNT(*) AS n FROM event_dicts GROUP BY props.k",
        "SELECT (props->>'$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1",
    ),
    "agg_group_null": (
        "SELECT x, COUNT(*) AS n FROM (SELECT CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS x FROM customer) GROUP BY x",
        "SELECT CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS x, count(*) AS n FROM customer GROUP BY 1",
    ),
    "agg_case_over_agg": (
        "SELECT p_brand, CASE WHEN COUNT(*) > 80 THEN 'many' ELSE 'few' END AS size, DATEDIFF(CURRENT_DATE, CURRENT_DATE - INTERVAL 3 DAYS) AS d FROM part GROUP BY p_brand",
        "SELECT p_brand, CASE WHEN count(*) > 80 THEN 'many' ELSE 'few' END AS size, 3::BIGINT AS d FROM part GROUP BY p_brand",
    ),
    "srt_multi": (
        "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 37",
        "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 37",
    ),
    "srt_nulls_asc_limit": (
        "SELECT k, x FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer) ORDER BY x, k LIMIT 1450",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer ORDER BY x NULLS LAST, k LIMIT 1450",
    ),
    "srt_nulls_desc_limit": (
        "SELECT k, x FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer) ORDER BY x DESC, k LIMIT 40",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer ORDER BY x DESC NULLS FIRST, k LIMIT 40",
    ),
    "srt_stable": ("SELECT c_custkey FROM customer ORDER BY c_nationkey LIMIT 70", "SELECT c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 70"),
    "srt_expr": (
        "SELECT p_partkey FROM part ORDER BY p_size % 7 DESC, p_retailprice * -1, p_partkey LIMIT 25",
        "SELECT p_partkey FROM part ORDER BY p_size % 7 DESC, -p_retailprice, p_partkey LIMIT 25",
    ),
    "srt_unselected": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 11", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 11"),
    "srt_alias": ("SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 9", "SELECT p_partkey, (p_size * 2)::BIGINT AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 9"),
    "srt_agg_alias": (
        "SELECT o_custkey, SUM(o_totalprice) / COUNT(*) AS mean, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 8",
        "SELECT o_custkey, sum(o_totalprice) / count(*) AS mean, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 8",
    ),
    "srt_ordinal_is_constant": ("SELECT p_partkey FROM part ORDER BY 1 DESC LIMIT 5", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 5"),
    "join_where_after": (
        "SELECT o.o_orderkey AS k, c.c_name AS c FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 300000 OR c.c_acctbal < -900",
        "SELECT o_orderkey AS k, c_name AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 300000 OR c_acctbal < -900",
    ),
    "sub_join_beside": (
        "SELECT t.n AS n, c.c_name AS name FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) t JOIN customer c ON t.k = c.c_custkey WHERE t.n > 5",
        "SELECT n, c_name AS name FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) JOIN customer ON k = c_custkey WHERE n > 5",
    ),
    "agg_first_row_of_join": (
        "SELECT n.n_name AS nation, c.c_name, COUNT(*) AS k FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
        'SELECT n_name AS nation, arg_min(c_name, c_custkey) AS "c.c_name", count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name',
    ),
    "view_columns": ("SELECT k, price FROM named_columns WHERE price > 450000", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_totalprice > 450000"),
    "lim_zero": ("SELECT p_partkey FROM part LIMIT 0", "SELECT p_partkey FROM part LIMIT 0"),
    "sub_derived": (
        "SELECT k FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F') WHERE p > 300000",
        "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000",
    ),
    "sub_derived_agg": (
        "SELECT COUNT(*) AS groups, MAX(n) AS most FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 5",
        "SELECT count(*) AS groups, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 5",
    ),
    "sub_nested": (
        "SELECT b FROM (SELECT a + 1 AS b FROM (SELECT p_size AS a FROM part WHERE p_size < 4) x) y WHERE b > 2",
        "SELECT (p_size + 1)::BIGINT AS b FROM part WHERE p_size < 4 AND p_size + 1 > 2",
    ),
    "sub_alias": ("SELECT s.k FROM (SELECT r_regionkey AS k FROM region) s WHERE s.k > 1", 'SELECT r_regionkey::BIGINT AS "s.k" FROM region WHERE r_regionkey > 1'),
    "sub_limit_inside": (
        "SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 17) WHERE o_orderkey > 0",
        "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 17) WHERE o_orderkey > 0",
    ),
    "view_simple": ("SELECT * FROM big_orders WHERE o_custkey > 700", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_custkey > 700"),
    "view_join": (
        "SELECT c_name, o_totalprice FROM named_orders WHERE o_totalprice > 420000",
        "SELECT c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 420000",
    ),
    "view_on_view": ("SELECT o_orderkey FROM biggest_orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000"),
    "pricing_summary": (
        "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, COUNT(*) AS n, MIN(l_extendedprice) AS low FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, min(l_extendedprice) AS low FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY ALL",
    ),
}


def _view_tables(spark: SparkSession, sf_dir: str) -> Callable[[str], Table]:
    base = tables(spark, sf_dir)

    def resolve(name: str) -> Table:
        if name not in VIEWS:
            return base(name)
        df = Binder(resolve).select(parse(VIEWS[name]))
        return Table(df.toDF(*VIEW_COLUMNS[name]) if name in VIEW_COLUMNS else df)

    return resolve


def _runner(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Binder(_view_tables(spark, sf_dir)).select(parse(sql))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(sql) for name, (sql, _) in STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in STATEMENTS.items()}
