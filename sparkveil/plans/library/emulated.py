"""Queries over the operators that Spark lacks: as-of joins, time windows, window forms, user functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...functions import scalar as S
from ...functions.udf import Functions, FunctionSpec, series, weighted_average
from ...operators import asof, ranges, timewin, unnest, winext
from ..catalog import query
from ..tables import table


def _asof(name: str, op: str, how: str) -> None:
    kind = "LEFT" if how == "left" else ""
    sql = f"""SELECT a.event_id, a.ts, b.event_id AS b_event_id, b.value AS b_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
    ASOF {kind} JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts {op} b.ts"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = table(spark, sf_dir, "events")
        buys, clicks = events.where("event_type = 'purchase'"), events.where("event_type = 'click'")
        cols = ["user_id", "ts", "event_id", "value"]
        return asof.asof_join(buys.select(*cols), clicks.select(*cols), "ts", "ts", op, ["user_id"], "event_id", how, "b_").select("event_id", "ts", "b_event_id", "b_value")


for _name, _op, _how in (("asof_ge", ">=", "inner"), ("asof_gt_left", ">", "left"), ("asof_le", "<=", "inner"), ("asof_lt_left", "<", "left")):
    _asof(_name, _op, _how)


@query("time_bucket", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, timestamp '1970-01-01') AS b, time_bucket(INTERVAL '7 days', ts, timestamp '2024-01-01') AS w FROM events")
def _time_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    return e.select("event_id", S.time_bucket("15 minutes", F.col("ts")).alias("b"), S.time_bucket("7 days", F.col("ts"), origin).alias("w"))


@query("tumble", "SELECT time_bucket(INTERVAL '1 hour', ts, timestamp '1970-01-01') AS window_start, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def _tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timewin.tumble(table(spark, sf_dir, "events"), "ts", "1 hour").groupBy("window_start", "event_type").agg(F.count("*").alias("n"), F.max("value").alias("top"))


@query("hop", """SELECT user_id, w AS window_start, w + INTERVAL '5 hours' AS window_end, count(*) AS n FROM (
    SELECT user_id, ts, unnest(generate_series(time_bucket(INTERVAL '2 hours', ts, timestamp '1970-01-01') - INTERVAL '6 hours', ts, INTERVAL '2 hours')) AS w FROM events)
    WHERE w > ts - INTERVAL '5 hours' AND w <= ts GROUP BY ALL""")
def _hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timewin.hop(table(spark, sf_dir, "events"), "ts", "2 hours", "5 hours").groupBy("user_id", "window_start", "window_end").agg(F.count("*").alias("n"))


_SESSIONS = """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS o FROM events),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)"""


@query("session_rows", f"{_SESSIONS} SELECT event_id, min(ts) OVER (PARTITION BY user_id, s) AS window_start, max(ts) OVER (PARTITION BY user_id, s) + INTERVAL '6 hours' AS window_end FROM g")
def _session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timewin.session(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"]).select("event_id", "window_start", "window_end")


@query("session_grouped", f"{_SESSIONS} SELECT user_id, min(ts) AS window_start, count(*) AS n FROM g GROUP BY user_id, s")
def _session_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("window_start"), "n")


def _orders_window():
    return Window.partitionBy("o_orderpriority").orderBy("o_custkey", "o_orderkey").rowsBetween(-5, 2)


@query("distinct_over", "SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER w AS n, CAST(sum(DISTINCT o_custkey) OVER w AS bigint) AS s FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_custkey, o_orderkey ROWS BETWEEN 5 PRECEDING AND 2 FOLLOWING)")
def _distinct_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _orders_window()
    return table(spark, sf_dir, "orders").select("o_orderkey", winext.count_distinct_over(F.col("o_orderstatus"), w).alias("n"), winext.sum_distinct_over(F.col("o_custkey"), w).alias("s"))


def _exclude(mode: str) -> None:
    frame = f"(PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING EXCLUDE {mode.upper()})"

    @query("exclude_" + mode.replace(" ", "_"), f"SELECT o_orderkey, count(o_custkey) OVER {frame} AS n, CAST(sum(o_orderkey) OVER {frame} AS bigint) AS s, max(o_orderkey) OVER {frame} AS m FROM orders")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        calls = {"n": ("count", "o_custkey"), "s": ("sum", "o_orderkey"), "m": ("max", "o_orderkey")}
        return winext.exclude_range(orders, ["o_orderpriority"], "o_custkey", -20, 20, mode, calls).select("o_orderkey", *calls)


for _mode in ("current row", "group", "ties", "no others"):
    _exclude(_mode)


@query("inverted_frame", "SELECT o_orderkey, count(*) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 FOLLOWING AND 1 FOLLOWING) AS n, max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN 2 FOLLOWING AND 1 FOLLOWING) AS m FROM orders")
def _inverted_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", winext.empty_frame("count", "bigint").alias("n"), winext.empty_frame("max", "bigint").alias("m"))


@query("array_agg_ordered", "SELECT n_regionkey, array_to_string(array_agg(nullif(n_name, 'CHINA') ORDER BY n_nationkey DESC), ',') AS names, len(array_agg(nullif(n_name, 'CHINA')))::int AS n FROM nation GROUP BY n_regionkey")
def _array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    grouped = n.groupBy("n_regionkey").agg(winext.array_agg(F.nullif(F.col("n_name"), F.lit("CHINA")), -F.col("n_nationkey")).alias("a"))
    return grouped.select("n_regionkey", F.array_join("a", ",").alias("names"), F.size("a").alias("n"))


@query("range_join", "SELECT a.s_suppkey, b.c_custkey FROM supplier a JOIN customer b ON b.c_acctbal BETWEEN a.s_acctbal - 25 AND a.s_acctbal + 25 AND a.s_nationkey = b.c_nationkey")
def _range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") - 25).alias("lo"), (F.col("s_acctbal") + 25).alias("hi"))
    return ranges.range_join(points, bands, "c_acctbal", "lo", "hi", 100.0, ["nation"]).select("s_suppkey", "c_custkey")


@query("unnest_words", "SELECT item_id, word, ord FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word, CAST(generate_subscripts(string_split(text, ' '), 1) AS int) AS ord FROM benchmark)")
def _unnest_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    return unnest.unnest(rows, "words", "word", "ord").drop("words")


@query("float_division", "SELECT n_nationkey, CAST(n_nationkey AS double) / n_regionkey AS q, substring(n_name, 1, greatest(n_regionkey - 1, 0)) AS sub, n_name <> '' AS p, n_nationkey // 4 AS d FROM nation WHERE n_regionkey > 0 UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'nan'::double ELSE 'infinity'::double END, '', true, n_nationkey // 4 FROM nation WHERE n_regionkey = 0")
def _float_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    sub = S.sql_substring(F.col("n_name"), F.lit(0), F.col("n_regionkey"))
    return n.select("n_nationkey", S.float_div(F.col("n_nationkey"), F.col("n_regionkey")).alias("q"), sub.alias("sub"), S.present(F.col("n_name")).alias("p"), S.int_div(F.col("n_nationkey"), F.lit(4), "int").alias("d"))


@query("temporal_ceil", "SELECT event_id, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS up, epoch_us(ts) AS us FROM events")
def _temporal_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.ceil_to("day", F.col("ts")).alias("up"), S.to_micros(F.col("ts")).alias("us"))


@query("item_bounds", "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN ['a', 'b'][n_regionkey] END AS x FROM nation")
def _item_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", S.item(F.array(F.lit("a"), F.lit("b")), F.col("n_regionkey")).alias("x"))


# --- user functions ------------------------------------------------------------------------------
def _session(spark: SparkSession, sf_dir: str, *names: str) -> tuple[SparkSession, Functions]:
    own = spark.newSession()
    for n in names:
        table(own, sf_dir, n).createOrReplaceTempView(n)
    return own, Functions(own)


@query("sql_udf", "SELECT c_custkey, round(c_acctbal * 1.5 + 10, 4) AS v FROM customer")
def _sql_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, f = _session(spark, sf_dir, "customer")
    f.register(FunctionSpec("lifted", "sql", "round(x * factor + 10, 4)", (("x", "double"), ("factor", "double")), "double", defaults={"factor": "1.5"}))
    return own.sql("SELECT c_custkey, lifted(c_acctbal) AS v FROM customer")


@query("sql_macro_aggregate", "SELECT l_returnflag, CAST(sum(l_linenumber * l_partkey) AS bigint) // CAST(sum(l_partkey) AS bigint) AS w FROM lineitem GROUP BY l_returnflag")
def _sql_macro_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, f = _session(spark, sf_dir, "lineitem")
    f.register(FunctionSpec("wavg", "aggregate_macro", "SUM(x * w) DIV SUM(w)", (("x", "bigint"), ("w", "bigint"))))
    return own.sql(f.expand("SELECT l_returnflag, wavg(l_linenumber, l_partkey) AS w FROM lineitem GROUP BY l_returnflag"))


@query("table_macro", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def _table_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, f = _session(spark, sf_dir, "orders")
    f.register(FunctionSpec("orders_for", "table_macro", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c", (("c", "bigint"),), "o_orderkey bigint, o_totalprice double"))
    return own.sql("SELECT * FROM orders_for(c => 7)")


@query("python_udf", "SELECT n_nationkey, reverse(n_name) AS r FROM nation")
def _python_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, f = _session(spark, sf_dir, "nation")
    f.register(FunctionSpec("backwards", "scalar", lambda s: s[::-1], (("s", "string"),), "string"))
    return own.sql("SELECT n_nationkey, backwards(n_name) AS r FROM nation")


@query("vector_udf", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def _vector_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def odd(s: pd.Series) -> pd.Series:
        return s * 2 + 1

    own, f = _session(spark, sf_dir, "part")
    f.register(FunctionSpec("odd_of", "vector", odd, (("x", "int"),), "int"))
    return own.sql("SELECT p_partkey, odd_of(p_size) AS v FROM part")


@query("udaf", "SELECT p_brand, CAST(max(p_size) - min(p_size) AS int) AS spread FROM part GROUP BY p_brand")
def _udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(s: pd.Series) -> int:
        return int(s.max() - s.min())

    own, f = _session(spark, sf_dir, "part")
    f.register(FunctionSpec("spread_of", "aggregate", spread, (("x", "int"),), "int"))
    return own.sql("SELECT p_brand, spread_of(p_size) AS spread FROM part GROUP BY p_brand")


@query("udtf_series", "SELECT CAST(range AS bigint) AS value, CAST(range * range AS bigint) AS square FROM range(3, 11)")
def _udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    class Squares:
        def eval(self, low: int, high: int):
            for i in range(low, high + 1):
                yield i, i * i

    own, f = _session(spark, sf_dir)
    f.register(FunctionSpec("squares", "table", Squares, (("low", "int"), ("high", "int")), "value bigint, square bigint"))
    return own.sql("SELECT * FROM squares(3, 10)")


@query("series_and_weights", "SELECT CAST(range AS bigint) AS value FROM range(1, 21)")
def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, 1, 20)


@query("weighted_average", "SELECT l_linestatus, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS w FROM lineitem GROUP BY l_linestatus")
def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(weighted_average(F.col("l_quantity"), F.col("l_linenumber")), 6).alias("w"))


@query("approx_count_distinct")
def _approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("n"))


@query("fingerprint_join")
def _fingerprint_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(S.fingerprint(F.col("c_custkey"), "k1").alias("f"), "c_mktsegment")
    o = table(spark, sf_dir, "orders").select(S.fingerprint(F.col("o_custkey"), "k1").alias("f"), "o_orderkey")
    return c.join(o, "f").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("udaf_over_window", "SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - min(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS spread FROM supplier")
def _udaf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.pandas_udf(spread, "double")("s_acctbal").over(w).alias("spread"))


@query("udf_composite", "SELECT n_nationkey, substring(n_name, 1, 1) AS head, CAST(length(n_name) AS int) AS size FROM nation")
def _udf_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, f = _session(spark, sf_dir, "nation")
    f.register(FunctionSpec("parts_of", "scalar", lambda s: (s[:1], len(s)), (("s", "string"),), "struct<head:string,size:int>"))
    return own.sql("SELECT n_nationkey, p.head AS head, p.size AS size FROM (SELECT n_nationkey, parts_of(n_name) AS p FROM nation)")
