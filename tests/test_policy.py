"""Statements of principals who try to see more than they may."""

import pytest
from pyspark.sql import functions as F

from sparkveil.errors import Refused
from sparkveil.policy.model import AGGREGATE_ONLY, FULL, NONE, ColumnPolicy, Context, Entitled, Rule, TablePolicy


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame([(i, i % 3, 100.5 + i) for i in range(60)], "id int, grp int, bal double")
    spark.createDataFrame([(1, 2.5)], "id int, secret double").write.mode("overwrite").saveAsTable("rawt")
    yield {"t": rows}
    spark.sql("DROP TABLE rawt")


def principal(spark, tables, floor=12):
    return Entitled(spark, tables, {"t": TablePolicy(lambda c: F.lit(True), {"bal": ColumnPolicy(otherwise=AGGREGATE_ONLY, floor=floor)})}, Context())


REFUSED = [
    "SELECT id, * FROM t",
    "SELECT * FROM t",
    "SELECT to_json(struct(*)) FROM t",
    "SELECT x.c FROM t AS x(a, b, c)",
    "SELECT sum(x.c) FROM t AS x(a, b, c)",
    "SELECT q.z FROM (SELECT bal AS z FROM t) q",
    "WITH q AS (SELECT * FROM t) SELECT bal FROM q",
    "WITH q AS (SELECT bal AS z FROM t) SELECT max(z) FROM q",
    "SELECT bal + 0 AS x FROM t",
    "SELECT id FROM t WHERE bal > 120",
    "SELECT id FROM t ORDER BY bal",
    "SELECT bal, count(*) FROM t GROUP BY bal",
    "SELECT min(bal) FROM t",
    "SELECT sum(DISTINCT bal) FROM t",
    "SELECT sum(bal * 1) FROM t",
    "SELECT sum(bal) OVER (PARTITION BY id) FROM t",
    "SELECT sum(a.bal) FROM t a JOIN (VALUES (1), (2), (3)) v(n) ON a.id = 5",
    "SELECT sum(bal) FROM t LATERAL VIEW explode(sequence(1, 20)) e AS n WHERE id = 5",
    "SELECT (SELECT max(u.id) FROM t u WHERE u.id < t.bal) FROM t",
    "SELECT a.id FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.bal > a.id)",
    "SELECT id FROM t UNION ALL SELECT bal FROM t",
    "SELECT first(bal) FROM t",
    "SELECT collect_list(bal) FROM t",
    "SELECT array_agg(struct(*)) FROM t",
    "SELECT r.secret FROM t, rawt r",
    "SELECT r.secret FROM t, default.rawt r",
    "SELECT * FROM (TABLE rawt)",
    "SELECT id FROM t WHERE id IN (SELECT id FROM rawt)",
    "WITH q AS (SELECT * FROM spark_catalog.default.rawt) SELECT * FROM q",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM t",
    "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
    "SELECT input_file_name() FROM t",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, tables, sql):
    with pytest.raises(Refused):
        principal(spark, tables).query(sql)


def test_allowed_aggregates_stand_behind_the_floor(spark, tables):
    e = principal(spark, tables)
    got = e.query("SELECT grp, sum(bal) AS s, avg(bal) FILTER (WHERE id < 30) AS few FROM t GROUP BY grp ORDER BY grp").collect()
    assert [r.s for r in got] == [sum(100.5 + i for i in range(60) if i % 3 == g) for g in range(3)]
    assert all(r.few is None for r in got)
    assert e.query("SELECT sum(bal) AS s FROM t WHERE id = 5").first().s is None
    assert e.query("SELECT sum(bal) AS s FROM (SELECT * FROM t) q").first().s == sum(100.5 + i for i in range(60))
    assert e.query("WITH q AS (SELECT * FROM t) SELECT count(bal) AS n FROM q WHERE grp = 0").first().n == 20


def test_a_rule_that_aggregates_only_governs_the_whole_column(spark, tables):
    p = ColumnPolicy((Rule(lambda c: F.col("grp") == 0, AGGREGATE_ONLY), Rule(lambda c: F.col("grp") == 1, FULL)), NONE, floor=5)
    e = Entitled(spark, tables, {"t": TablePolicy(lambda c: F.lit(True), {"bal": p})}, Context())
    with pytest.raises(Refused):
        e.query("SELECT bal FROM t")
    assert e.query("SELECT count(bal) AS n FROM t").first().n == 40


def test_ten_principals_see_their_own_rows_only(spark, tables):
    for who in range(10):
        rule = TablePolicy(lambda c: c.member(F.col("id"), "mine"), {"bal": ColumnPolicy((Rule(lambda c: c.equals(F.col("id"), "self"), FULL),), NONE)})
        e = Entitled(spark, tables, {"t": rule}, Context({"self": who}, {"mine": [who, who + 20]}))
        got = sorted(map(tuple, e.query("SELECT id, bal FROM t").collect()))
        assert got == [(who, 100.5 + who), (who + 20, None)]
        assert e.query("SELECT count(*) AS n FROM t WHERE bal IS NOT NULL").first().n == 1
        for sql in ("SELECT id FROM rawt", "SELECT r.id FROM t CROSS JOIN rawt r", "SELECT id FROM t UNION SELECT id FROM default.rawt"):
            with pytest.raises(Refused):
                e.query(sql)
