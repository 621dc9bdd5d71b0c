"""The read-only guard: what it refuses as text, and what it refuses as a parsed plan."""

import pytest

from lodestone.errors import UnsafeQueryError
from lodestone.plans.guard import code_only, execute_readonly, guard, is_readonly, lint

REFUSED = [
    "", "   ", "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "DROP TABLE t", "SELECT 1; SELECT 2", "WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x",
    "SELECT pg_sleep(10)", "SELECT load_extension('x')", "EXPLAIN SELECT 1", "SELECT 'open", "SELECT /* open", "SELECT $$x$$", "PRAGMA user_version", "SELECT * INTO t2 FROM t", "WITH x AS (VALUES (1)) VALUES (2)",
    "SELECT 1\x00", "CREATE TABLE t (a int)", "SELECT xp_cmdshell('dir')", "MERGE INTO t USING u ON a = b WHEN MATCHED THEN DELETE", "-- only a comment", "SELECT eval('x')",
]
ACCEPTED = [
    "SELECT 1", "select a from t;", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "SELECT 'DROP TABLE t'", 'SELECT "update" FROM t', "SELECT REPLACE(a, 'x', 'y') FROM t", "SELECT a -- delete\nFROM t", "SELECT a /* drop /* nested */ */ FROM t",
    "(SELECT 1) UNION (SELECT 2)", "SELECT 'it''s; fine'", "SELECT `set` FROM t", "SELECT created, updated_at FROM t",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    assert not is_readonly(sql)


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(sql):
    assert is_readonly(sql)


def test_one_semicolon_goes():
    assert lint("SELECT 1 ;") == "SELECT 1"
    assert "x" not in code_only("SELECT 'x'")


@pytest.mark.parametrize("sql", ["SELECT 'x\\'' AS a, reflect('java.lang.Math', 'abs', -3) AS b -- '", "SELECT * FROM parquet.`/tmp/x`", "SELECT java_method('java.lang.Math', 'random')", "SELECT * FROM unknown_table"])
def test_plan_guard(spark, sql):
    with pytest.raises(UnsafeQueryError):
        guard(spark, sql, {"t"})


def test_execute(spark):
    spark.range(5).createOrReplaceTempView("t")
    r = execute_readonly(spark, "SELECT id FROM t ORDER BY id", 3, {"t"})
    assert r.truncated and [x[0] for x in r.rows] == [0, 1, 2]
    assert execute_readonly(spark, "WITH x AS (SELECT count(*) AS n FROM t) SELECT n FROM x", tables={"t"}).scalar == 5
