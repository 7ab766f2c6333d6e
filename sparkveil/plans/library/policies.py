"""Queries under entitlements: customers belong to nations (tenants); orders and lines hang on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...policy.model import AGGREGATE_ONLY, MASKED, NONE, TEST, ColumnPolicy, Context, Entitled, Grant, Rule, TablePolicy, Tenancy
from ..catalog import query
from ..tables import table

CONTEXT = Context({"subject": 7}, {"nations": [1, 2, 3]})


def _entitled(spark: SparkSession, sf_dir: str, policies: dict[str, TablePolicy], barrier: bool = False, context: Context = CONTEXT) -> Entitled:
    names = ("customer", "orders", "lineitem", "nation")
    return Entitled(spark, {n: table(spark, sf_dir, n) for n in names}, policies, context, barrier)


def _mine(ctx: Context):
    return ctx.member(F.col("c_nationkey"), "nations")


@query("policy_row_filter", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_acctbal > 0")
def _row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entitled(spark, sf_dir, {"customer": TablePolicy(_mine)}).query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")


@query("policy_barrier", "SELECT c_custkey, 10 / c_acctbal > 0 AS p FROM customer WHERE c_nationkey IN (1, 2, 3) AND 10 / c_acctbal > 0")
def _barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entitled(spark, sf_dir, {"customer": TablePolicy(_mine)}, barrier=True)
    return e.query("SELECT c_custkey, 10 / c_acctbal > 0 AS p FROM customer WHERE 10 / c_acctbal > 0")


_MASKS = {
    "c_name": ColumnPolicy((Rule(lambda c: F.col("c_nationkey") == 1),), MASKED, lambda: F.concat(F.substr("c_name", F.lit(1), F.lit(1)), F.lit("***")), disclose=True),
    "c_acctbal": ColumnPolicy((Rule(lambda c: c.equals(F.col("c_custkey"), "subject")),), NONE),
}


@query("policy_mask", "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN c_name ELSE 'C***' END AS c_name, CASE WHEN c_custkey = 7 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey IN (1, 2, 3)")
def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entitled(spark, sf_dir, {"customer": TablePolicy(_mine, _MASKS)}).query("SELECT c_custkey, c_name, c_acctbal FROM customer")


@query("policy_masked_filter", "SELECT count(*) AS n FROM customer WHERE c_nationkey IN (2, 3)")
def _masked_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entitled(spark, sf_dir, {"customer": TablePolicy(_mine, _MASKS)}).query("SELECT count(*) AS n FROM customer WHERE c_name = 'C***'")


@query("policy_disclosure_column", "SELECT CASE WHEN c_nationkey = 1 THEN 'FULL' ELSE 'MASKED' END AS c_name__disclosure, count(*) AS n FROM customer WHERE c_nationkey IN (1, 2, 3) GROUP BY 1")
def _disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entitled(spark, sf_dir, {"customer": TablePolicy(_mine, _MASKS)}).query("SELECT c_name__disclosure, count(*) AS n FROM customer GROUP BY c_name__disclosure")


@query("policy_population_floor", "SELECT c_nationkey, c_mktsegment, count(*) AS n, CASE WHEN count(c_acctbal) >= 12 THEN CAST(sum(CAST(c_acctbal AS decimal(12,2))) AS double) END AS total FROM customer GROUP BY c_nationkey, c_mktsegment")
def _floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TablePolicy(lambda c: F.lit(True), {"c_acctbal": ColumnPolicy(otherwise=AGGREGATE_ONLY, floor=12)})
    e = Entitled(spark, {"customer": table(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))}, {"customer": p}, CONTEXT)
    found = e.query("SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM customer GROUP BY c_nationkey, c_mktsegment")
    return found.withColumn("total", F.col("total").cast("double"))


@query("policy_through_parent", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3))) GROUP BY l_orderkey")
def _parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = lambda c: F.lit(True)
    policies = {
        "customer": TablePolicy(_mine),
        "orders": TablePolicy(everything, parent=("customer", "o_custkey", "c_custkey")),
        "lineitem": TablePolicy(everything, parent=("orders", "l_orderkey", "o_orderkey")),
    }
    return _entitled(spark, sf_dir, policies).query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")


@query("policy_tenancy", "SELECT c_custkey, CASE WHEN c_custkey = 7 OR c_nationkey = 4 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey IN (4, 5) OR c_custkey = 7")
def _tenancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Tenancy("customer", "nation", "c_nationkey", "c_custkey", {"c_acctbal": ColumnPolicy(otherwise=NONE)})
    policy = model.compile([Grant("manager", "nation", (4,), {"c_acctbal": "FULL"}), Grant("agent", "nation", (5,), {"c_acctbal": "NONE"})])
    return _entitled(spark, sf_dir, {"customer": policy}).query("SELECT c_custkey, c_acctbal FROM customer")


@query("policy_test_verdict", "SELECT c_custkey, c_mktsegment = 'BUILDING' AS hit FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _test_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entitled(spark, sf_dir, {"customer": TablePolicy(_mine, {"c_mktsegment": ColumnPolicy(otherwise=TEST)})})
    return e.query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS hit FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")


@query("policy_related_path", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority IN ('1-URGENT'))")
def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = TablePolicy(lambda c: F.lit(True), bridge=("orders", "c_custkey", "o_custkey", "priorities"), bridge_column="o_orderpriority")
    return _entitled(spark, sf_dir, {"customer": p}, context=Context(lists={"priorities": ["1-URGENT"]})).query("SELECT c_custkey FROM customer")
