"""Queries over standing views, streams and federated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.asof import asof_join
from ...sources import embedded
from ...sources.federation import JoinPolicy, PartitionedTable, federated_join, parquet_source
from ...streaming import views as V
from ..catalog import query
from ..engine import Engine
from ..tables import TABLES, table

SPLIT = "2024-01-15"


def _epochs(spark: SparkSession, sf_dir: str) -> tuple[V.Epochs, DataFrame]:
    events = table(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    epochs = V.Epochs(spark)
    epochs.declare("events", events.where(f"ts < timestamp_ntz '{SPLIT}'"))
    return epochs, events.where(f"ts >= timestamp_ntz '{SPLIT}'")


@query("view_incremental_agg", "SELECT user_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS bigint)) AS bigint) AS cents, max(ts) AS last FROM events GROUP BY user_id")
def _agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later = _epochs(spark, sf_dir)
    view = V.AggregateView(epochs, "events", ["user_id"], {"n": ("count", "event_id"), "cents": ("sum", "cents"), "last": ("max", "ts")})
    epochs.refresh(append={"events": later})
    view.update()
    return view.answer


@query("view_recompute_diff", f"SELECT 'upsert' AS op, user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE ts >= timestamp '{SPLIT}') GROUP BY user_id")
def _recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later = _epochs(spark, sf_dir)
    view = V.StandingView(epochs, lambda t: t["events"].groupBy("user_id").agg(F.count("*").alias("n")), ["events"], ["user_id"])
    epochs.refresh(append={"events": later})
    view.update()
    return view.drain(0)[1]


@query("view_incremental_join", "SELECT e.event_id, e.user_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id")
def _join(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later = _epochs(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    epochs.declare("people", people.where("user_id % 2 = 0"))
    view = V.JoinView(epochs, "events", "people", ["user_id"], ["event_id"])
    epochs.refresh(append={"events": later, "people": people.where("user_id % 2 = 1")})
    view.update()
    return view.answer.select("event_id", "user_id", "c_name")


_PEOPLE = "(SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey % 3 <> 0)"


def _changed(spark: SparkSession, sf_dir: str) -> tuple[V.Epochs, DataFrame, DataFrame]:
    epochs, later = _epochs(spark, sf_dir)
    epochs.declare("events", epochs.read("events"), ["event_id"])
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    epochs.declare("people", people, ["user_id"])
    return epochs, later, people


def _kept_join(how: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        epochs, later, people = _changed(spark, sf_dir)
        view = V.KeyedJoinView(epochs, "events", "people", ["user_id"], how, ["event_id"])
        epochs.refresh(append={"events": later}, delete={"people": people.where("user_id % 3 = 0")})
        view.update()
        return view.answer.select(*columns)

    return run


query("view_left_join", f"SELECT e.event_id, e.user_id, c.c_name FROM events e LEFT JOIN {_PEOPLE} c USING (user_id)")(_kept_join("left", ["event_id", "user_id", "c_name"]))
query("view_semi_join", f"SELECT event_id, user_id FROM events e WHERE user_id IN (SELECT user_id FROM {_PEOPLE})")(_kept_join("left_semi", ["event_id", "user_id"]))
query("view_anti_join", f"SELECT event_id, user_id FROM events e WHERE user_id NOT IN (SELECT user_id FROM {_PEOPLE})")(_kept_join("left_anti", ["event_id", "user_id"]))


@query("view_delete", "SELECT user_id, count(*) AS n, avg(CAST(round(value * 100) AS bigint)) AS mean, count(DISTINCT event_type) AS kinds FROM events WHERE event_type <> 'click' OR event_id % 2 = 0 GROUP BY user_id")
def _delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later, _ = _changed(spark, sf_dir)
    aggregates = lambda: [F.count("*").alias("n"), F.avg("cents").alias("mean"), F.count_distinct("event_type").alias("kinds")]
    view = V.ChangingAggregateView(epochs, "events", ["user_id"], aggregates)
    epochs.refresh(append={"events": later})
    epochs.refresh(delete={"events": epochs.read("events").where("event_type = 'click' AND event_id % 2 = 1")})
    view.update()
    return view.answer


@query("view_union", "SELECT event_id, 'big' AS kind FROM events WHERE value > 50 UNION ALL SELECT event_id, event_type AS kind FROM events WHERE event_type = 'purchase'")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later = _epochs(spark, sf_dir)
    big = lambda d: d.where("value > 50").select("event_id", F.lit("big").alias("kind"))
    bought = lambda d: d.where("event_type = 'purchase'").select("event_id", F.col("event_type").alias("kind"))
    view = V.RowView(epochs, [("events", big), ("events", bought)], ["event_id", "kind"])
    epochs.refresh(append={"events": later})
    view.update()
    return view.answer


@query("view_topn", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 15")
def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later = _epochs(spark, sf_dir)
    view = V.TopView(epochs, "events", [F.desc("value"), F.asc("event_id")], 15, ["event_id"])
    epochs.refresh(append={"events": later})
    view.update()
    return view.answer.select("event_id", "value")


@query("view_asof_groups", "SELECT a.event_id, b.event_id AS b_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _asof_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    epochs, later = _epochs(spark, sf_dir)

    def statement(t: dict[str, DataFrame]) -> DataFrame:
        cols = ["user_id", "ts", "event_id"]
        buys, clicks = (t["events"].where(f"event_type = '{k}'").select(*cols) for k in ("purchase", "click"))
        return asof_join(buys, clicks, "ts", "ts", ">=", ["user_id"], "event_id", "inner", "b_").select("user_id", "event_id", "b_event_id")

    view = V.GroupView(epochs, statement, ["events"], ["user_id"], ["event_id"])
    epochs.refresh(append={"events": later})
    view.update()
    return view.answer.select("event_id", "b_event_id")


@query("stream_view", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    epochs = V.Epochs(spark)
    epochs.declare("log", events.where(F.lit(False)))
    view = V.AggregateView(epochs, "log", ["event_type"], {"n": ("count", "event_id")})
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    writer = V.from_stream(stream, epochs, "log", ("ts", "1 day"), view.update)
    run = writer.option("checkpointLocation", f"{epochs.folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return view.answer


@query("partitioned_union_pruned", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderpriority")
def _partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = PartitionedTable("o_orderstatus", {s: (lambda s=s: orders.where(F.col("o_orderstatus") == s)) for s in ("F", "O", "P")})
    return parts.scan(["F", "P"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def _customers(spark: SparkSession, sf_dir: str):
    return parquet_source("crm", lambda: table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "custkey"))


def _dear(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice") > n).select("o_orderkey", F.col("o_custkey").alias("custkey"))


for _name, _strategy in (("lookup_semi_reduction", "auto"), ("broadcast_strategy", "broadcast"), ("local_strategy", "local")):

    def _federated(spark: SparkSession, sf_dir: str, strategy: str = _strategy) -> DataFrame:
        joined = federated_join(_dear(spark, sf_dir, 300_000), _customers(spark, sf_dir), "custkey", JoinPolicy(strategy, broadcast_rows=10_000_000))
        return joined.select("o_orderkey", "c_name")

    query(_name, "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")(_federated)


@query("remote_query", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded.register(spark)
    source = spark.read.format("embedded").schema("n_nationkey int, n_name string, n_regionkey int").option("query", f"SELECT * FROM read_parquet('{sf_dir}/nation.parquet')").load()
    return source.where("n_regionkey = 2").select("n_nationkey", "n_name")


def front(name: str, text: str, oracle: str) -> None:
    """A query that goes through the engine's own SQL front end."""
    words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark, {t: table(spark, sf_dir, t) for t in TABLES if t in words}).query(text)

    query(name, oracle)(run)


_HOUR = "time_bucket(INTERVAL '1 hour', ts, timestamp '1970-01-01')"
front("sql_time_bucket", "SELECT event_id, TIME_BUCKET(INTERVAL '15' MINUTE, ts) AS b, TIME_BUCKET(INTERVAL '7' DAY, ts, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS w FROM events",
      "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, timestamp '1970-01-01') AS b, time_bucket(INTERVAL '7 days', ts, timestamp '2024-01-01') AS w FROM events")
front("sql_tumble", "SELECT window_start, window_end, event_type, count(*) AS n FROM TABLE(TUMBLE(TABLE events, DESCRIPTOR(ts), INTERVAL '1' HOUR)) GROUP BY window_start, window_end, event_type",
      f"SELECT {_HOUR} AS window_start, {_HOUR} + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
front("sql_hop", "SELECT user_id, window_start, window_end, count(*) AS n FROM TABLE(HOP(TABLE events, DESCRIPTOR(ts), INTERVAL '2' HOUR, INTERVAL '5' HOUR)) GROUP BY user_id, window_start, window_end",
      """SELECT user_id, w AS window_start, w + INTERVAL '5 hours' AS window_end, count(*) AS n FROM (
      SELECT user_id, ts, unnest(generate_series(time_bucket(INTERVAL '2 hours', ts, timestamp '1970-01-01') - INTERVAL '6 hours', ts, INTERVAL '2 hours')) AS w FROM events)
      WHERE w > ts - INTERVAL '5 hours' AND w <= ts GROUP BY ALL""")  # fmt: skip
front("sql_session", "SELECT user_id, window_start, window_end, count(*) AS n FROM TABLE(SESSION(TABLE events, DESCRIPTOR(ts), DESCRIPTOR(user_id), INTERVAL '6' HOUR)) GROUP BY user_id, window_start, window_end",
      """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS o FROM events),
      g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
      SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, count(*) AS n FROM g GROUP BY user_id, s""")  # fmt: skip
front("sql_unnest_ordinality", "SELECT b.item_id, w.word, w.ord FROM benchmark b CROSS JOIN UNNEST(split(b.text, ' ')) WITH ORDINALITY AS w(word, ord)",
      "SELECT item_id, unnest(string_split(text, ' ')) AS word, CAST(generate_subscripts(string_split(text, ' '), 1) AS int) AS ord FROM benchmark")
front("sql_array_agg", "SELECT n_regionkey, array_join(ARRAY_AGG(n_name ORDER BY length(n_name) DESC, n_name), ',') AS names FROM nation GROUP BY n_regionkey",
      "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY length(n_name) DESC, n_name), ',') AS names FROM nation GROUP BY n_regionkey")
_BUYS, _CLICKS = ("(SELECT user_id, min(event_id) AS event_id, ts FROM events WHERE event_type = '%s' GROUP BY user_id, ts)" % k for k in ("purchase", "click"))
front("sql_asof", f"SELECT a.event_id, b.event_id AS b_event_id FROM {_BUYS} AS a ASOF JOIN {_CLICKS} AS b MATCH_CONDITION (a.ts >= b.ts) ON a.user_id = b.user_id",
      f"SELECT a.event_id, b.event_id AS b_event_id FROM {_BUYS} a ASOF JOIN {_CLICKS} b ON a.user_id = b.user_id AND a.ts >= b.ts")
front("sql_asof_computed", f"SELECT a.event_id, b.event_id AS b_event_id FROM {_BUYS} AS a LEFT ASOF JOIN {_CLICKS} AS b MATCH_CONDITION (a.ts - INTERVAL '1' HOUR > b.ts) ON a.user_id = b.user_id AND b.event_id % 2 = 0 AND a.event_id % 3 <> 0",
      f"SELECT a.event_id, b.event_id AS b_event_id FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN ts - INTERVAL 1 HOUR END AS t FROM {_BUYS}) a ASOF LEFT JOIN (SELECT * FROM {_CLICKS} WHERE event_id % 2 = 0) b ON a.user_id = b.user_id AND a.t > b.ts")


@query("engine_parameters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def _parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, {"orders": table(spark, sf_dir, "orders")})
    sql = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN @states AND o_totalprice > @least ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 ROWS FETCH NEXT 10 ROWS ONLY"
    return engine.query(sql, {"states": ["F", "P"], "least": 100000})
