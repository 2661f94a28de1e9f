"""Every registered query of the core against DuckDB, and properties of plans."""

import datetime as dt
import math

import duckdb
import pytest
from conftest import DATA

from docframe import document_queries, queries
from docframe.errors import QueryExecutionError
from docframe.operators.catalog import execute_rows
from docframe.plans.binder import Binder
from docframe.plans.parser import parse

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RUN = queries.queries() | document_queries.queries()
SQL = queries.oracle_sql() | document_queries.oracle_sql()


def _key(row):
    return repr([round(x, 6) if isinstance(x, float) else x for x in row])


def _same(a, b):
    if isinstance(a, float) and isinstance(b, int | float):
        return math.isclose(a, b, rel_tol=1e-9) or a != a and b != b
    return a == b


@pytest.mark.parametrize("name", sorted(RUN))
def test_query_matches_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = RUN[name](spark, DATA)
    wanted = db.execute(SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    mine = sorted((tuple(r[c] for c in names) for r in found.collect()), key=_key)
    theirs = sorted(wanted.fetchall(), key=_key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert all(map(_same, a, b)), (a, b)


def _plan(spark, sql):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df = Binder(queries.tables(spark, DATA)).select(parse(sql))
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 AND o.o_orderdate >= '1995-01-01'")
    assert "GreaterThan(o_totalprice" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "o_orderpriority" not in plan and "c_name" not in plan and "Python" not in plan


def test_top_k_is_not_a_full_sort(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC LIMIT 3")


ROWS = [
    {"name": "a", "n": 10, "x": 1.5, "d": "2024-01-31", "tags": ["u", "v"], "p": {"k": 1}},
    {"name": None, "n": 5, "x": None, "d": "2024-02-01", "tags": None, "p": {"k": 2}},
    {"name": "c", "n": None, "x": 2.0, "d": None, "tags": [], "p": None},
]


@pytest.mark.parametrize(
    "sql, rows",
    [
        ("SELECT n + x FROM t", [{"n + x": 11.5}, {"n + x": None}, {"n + x": None}]),
        ("SELECT n FROM t ORDER BY n DESC", [{"n": None}, {"n": 10}, {"n": 5}]),
        ("SELECT n FROM t ORDER BY n", [{"n": 5}, {"n": 10}, {"n": None}]),
        ("SELECT name FROM t WHERE tags IN ('v', 'w')", [{"name": "a"}]),
        ("SELECT n FROM t WHERE tags LIKE 'U'", [{"n": 10}]),
        ("SELECT n FROM t WHERE tags NOT LIKE 'U'", [{"n": None}]),
        ("SELECT n FROM t WHERE p.k = 2", [{"n": 5}]),
        ("SELECT d + INTERVAL 1 DAY AS e FROM t WHERE name = 'a'", [{"e": dt.date(2024, 2, 1)}]),
        ("SELECT n FROM t WHERE n > '7'", []),
        ("SELECT n FROM t WHERE n < '7'", [{"n": 10}, {"n": 5}]),
        ("SELECT n FROM t WHERE x = '2'", [{"n": None}]),
        ("SELECT COUNT(*) c, SUM(name) s, MIN(tags) m FROM t", [{"c": 3, "s": None, "m": ""}]),
        ("SELECT name, COUNT(*) AS c FROM t WHERE n IS NOT NULL", [{"name": "a", "c": 2}]),
        ("SELECT n / 0 a, n % 0 b, n / 4 c, x / 0.0 e FROM t LIMIT 1", [{"a": None, "b": None, "c": 2, "e": None}]),
        ("SELECT n FROM t WHERE nosuch = 1 OR n = 5", [{"n": 5}]),
        ("SELECT CASE WHEN n > 7 THEN 1 WHEN n > 1 THEN 2.5 END v FROM t", [{"v": 1.0}, {"v": 2.5}, {"v": None}]),
    ],
)
def test_rows_in_memory(spark, sql, rows):
    assert execute_rows(spark, sql, ROWS)[0] == rows


def test_case_sensitive_names(spark):
    rows, _ = execute_rows(spark, "SELECT a, A FROM t", [{"a": 1, "A": 2}])
    assert rows == [{"a": 1, "A": 2}]


@pytest.mark.parametrize("sql", ["SELECT * FROM t GROUP BY n", "SELECT SUM(SUM(n)) FROM t", "SELECT a.n FROM t a JOIN t b ON a.zz = b.n", "SELECT n FROM t a JOIN t b ON a.n = b.n"])
def test_errors(spark, sql):
    with pytest.raises(QueryExecutionError):
        execute_rows(spark, sql, ROWS)


def test_strict_names(spark):
    with pytest.raises(QueryExecutionError):
        Binder(queries.tables(spark, DATA), strict=True).select(parse("SELECT nosuch FROM region"))
