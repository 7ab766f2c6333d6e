import datetime as dt

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkveil.errors import Guardrail, LateRow, Refused
from sparkveil.functions import scalar as S
from sparkveil.functions.udf import FunctionError, Functions, FunctionSpec
from sparkveil.operators import asof, ranges, timewin, unnest, winext
from sparkveil.plans import catalog, sqlfront
from sparkveil.plans.engine import Engine
from sparkveil.policy.model import AGGREGATE_ONLY, ColumnPolicy, Context, Entitled, Rule, TablePolicy, fence, guard
from sparkveil.sources.federation import Capabilities, JoinPolicy, PartitionedTable, Source, check_zones, federated_join, parquet_source
from sparkveil.streaming import views as V


def t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


@pytest.mark.parametrize("op", asof.OPERATORS)
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof_nulls_and_ties(spark, op, how):
    left = [(1, "a", t(3)), (2, "a", t(1)), (3, "b", t(2)), (4, None, t(3)), (5, "a", None), (6, "a", t(5))]
    right = [(10, "a", t(1)), (11, "a", t(3)), (12, "a", t(3)), (13, None, t(1)), (14, "a", None), (15, "b", t(4))]
    ls = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    rs = spark.createDataFrame(right, "rid int, k string, ts timestamp_ntz")
    test = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}[op]
    want = []
    for i, k, ts in left:
        fit = [(r, rt) for r, rk, rt in right if None not in (k, ts, rt) and rk == k and test(ts, rt)]
        best = min(fit, key=lambda x: (abs(x[1] - ts), x[0]))[0] if fit else None
        if best is not None or how == "left":
            want.append((i, best))
    got = asof.asof_join(ls, rs, "ts", "ts", op, ["k"], "rid", how, "r_").select("id", "r_rid")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_asof_without_keys_and_refusals(spark):
    ls = spark.createDataFrame([(1, t(2))], "id int, ts timestamp_ntz")
    rs = spark.createDataFrame([(7, t(1)), (8, t(3))], "rid int, ts timestamp_ntz")
    assert asof.asof_join(ls, rs, "ts", "ts", tie="rid", prefix="r_").first()["r_rid"] == 7
    with pytest.raises(ValueError):
        asof.asof_join(ls, rs, "ts", "ts", "=")
    with pytest.raises(ValueError):
        asof.asof_join(ls, rs, "ts", "ts", how="full")


def test_windows_over_time(spark):
    df = spark.createDataFrame([(1, t(0, 5)), (1, t(0, 50)), (1, t(2)), (2, None)], "k int, ts timestamp_ntz")
    assert timewin.hop(df, "ts", "30 minutes", "1 hour").count() == 6
    assert timewin.hop(df, "ts", "1 hour", "10 minutes").count() == 2  # between the windows rows drop
    rows = timewin.session(df, "ts", "1 hour", ["k"]).collect()
    assert {(r.window_start, r.window_end) for r in rows} == {(t(0, 5), t(1, 50)), (t(2), t(3)), (None, None)}
    assert timewin.tumble(df, "ts", "1 hour").where("k = 2").first().window_start is None
    with pytest.raises(ValueError):
        S.micros("0 minutes")


def test_window_forms_on_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, None), (4, None, 7)], "id int, k int, x int")
    w = Window.orderBy(F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    got = {
        mode: [r.v for r in df.select("id", winext.exclude(F.col("x"), F.col("id"), F.col("k"), w, mode, "sum").alias("v")).orderBy("id").collect()]
        for mode in ("current row", "group", "ties", "no others")
    }
    assert got == {"current row": [12, 12, 17, 10], "group": [7, 7, 17, 10], "ties": [12, 12, 17, 17], "no others": [17] * 4}
    assert {r.n for r in df.select(winext.count_distinct_over(F.col("x"), w).alias("n")).collect()} == {2}
    assert df.agg(winext.array_agg(F.col("x"), F.col("id")).alias("a")).first().a == [5, 5, None, 7]


def test_unnest_and_ranges(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id int, xs array<string>")
    assert [(r.id, r.x, r.n) for r in unnest.unnest(df, "xs", "x", "n").collect()] == [(1, "a", 1), (1, None, 2)]
    assert [(r.id, r.n) for r in unnest.unnest(df, "xs", "x", "n", outer=True).collect()] == [(1, 1), (1, 2), (2, None), (3, None)]
    points = spark.createDataFrame([(p,) for p in (-5.0, 0.0, 9.9, 10.0, 25.0)], "p double")
    bands = spark.createDataFrame([(0, -6.0, 0.0), (1, 5.0, 25.0), (2, 9.0, 1.0)], "b int, lo double, hi double")
    assert sorted((r.p, r.b) for r in ranges.range_join(points, bands, "p", "lo", "hi", 10.0).collect()) == [(-5.0, 0), (0.0, 0), (9.9, 1), (10.0, 1), (25.0, 1)]


def test_scalar_functions(spark):
    row = spark.range(1).select(
        S.float_div(F.lit(1), F.lit(0)).alias("inf"), S.float_div(F.lit(-1), F.lit(0)).alias("ninf"), S.int_div(F.lit(-7), F.lit(2), "int").alias("d"),
        S.sql_substring(F.lit("hello"), F.lit(-1), F.lit(4)).alias("sub"), S.item(F.array(F.lit(1)), F.lit(0)).alias("none"), S.present(F.lit("")).alias("p"),
        S.fingerprint(F.lit("x"), "k").alias("f"), S.fingerprint(F.lit(None).cast("string"), "k").alias("fn"),
    ).first()
    assert (row.inf, row.ninf, row.d, row["sub"], row.none, row.p, len(row.f), row.fn) == (float("inf"), float("-inf"), -3, "he", None, False, 32, None)


def test_sql_front():
    r = sqlfront.rewrite
    assert r("SELECT a FROM t ORDER BY a DESC, b") == "SELECT a FROM t ORDER BY a DESC NULLS FIRST, b NULLS LAST"
    assert r("SELECT sum(x) OVER (ORDER BY a ROWS UNBOUNDED PRECEDING) FROM t ORDER BY 1 LIMIT 2").count("NULLS LAST") == 2
    assert r("SELECT a FROM t FETCH FIRST 3 ROWS ONLY") == "SELECT a FROM t LIMIT 3"
    assert r("SELECT a FROM t OFFSET 2 ROWS FETCH NEXT 5 ROWS ONLY") == "SELECT a FROM t LIMIT 5 OFFSET 2"
    assert "IN (SELECT" in r("SELECT a FROM t WHERE a = ANY (SELECT b FROM u)")
    assert r("SELECT a FROM t WHERE a LIKE 'x!%'").endswith("ESCAPE '~'")
    assert r("SELECT ? , ?", [1, "o'x"]).endswith("'o\\'x'")
    assert r("SELECT a FROM t WHERE a IN $1", [[1, 2]]).endswith("( 1, 2)") or "(1, 2)" in r("SELECT a FROM t WHERE a IN $1", [[1, 2]])
    for bad, params in (("DELETE FROM t", None), ("SELECT 1 QUALIFY 1", None), ("SELECT ?", []), ("SELECT ?, $1", [1]), ("SELECT @a", {"b": 1}), ("SELECT ?", [object()]), ("SELECT ?", [1 << 70])):
        with pytest.raises(Refused):
            r(bad, params)
    assert sqlfront.redact("SELECT 'a', 'a' -- secret", "k").count("'~") == 2


def test_engine_is_isolated_and_binds(spark):
    e = Engine(spark, {"t": spark.createDataFrame([(1, "a"), (2, None), (None, "c")], "x int, s string")})
    assert [r.x for r in e.query("SELECT x FROM t ORDER BY x").collect()] == [1, 2, None]
    assert [r.x for r in e.query("SELECT x FROM t WHERE x IN ? ORDER BY x", [[]]).collect()] == []
    assert e.query("SELECT x FROM t WHERE x NOT IN ?", [[]]).count() == 3
    assert e.prepare("SELECT x FROM t").schema().names == ["x"] and "Scan" in e.prepare("SELECT x FROM t").explain()
    assert e.query("SELECT TIME '10:00:00' < TIME '12:00:00' AS b").first().b
    e.functions.register(FunctionSpec("twice", "sql", "x * 2", (("x", "int"),), "int"))
    assert e.query("SELECT twice(x) AS y FROM t WHERE x = 2").first().y == 4
    with pytest.raises(FunctionError):
        Functions(spark).register(FunctionSpec("upper", "sql", "x", (("x", "string"),), "string"))


def test_bound_relations_and_materialised_statements(spark):
    e = Engine(spark, {"t": spark.createDataFrame([(1, "a"), (2, "b")], "x int, s string")})
    e.bind("picked", [(2,)], "x int")
    assert [r.s for r in e.query("SELECT s FROM t JOIN picked USING (x)").collect()] == ["b"]
    with pytest.raises(Refused):
        e.bind("many", [(1,)] * 5, "x int", most=3)
    epochs = V.Epochs(spark)
    epochs.declare("log", spark.createDataFrame([(1, "a"), (2, "a")], "x int, k string"))
    view = e.materialize(epochs, "SELECT k, count(*) AS n, max(x) AS m FROM log WHERE x > @least GROUP BY k", ["k"], {"least": 1})
    epochs.refresh(append={"log": spark.createDataFrame([(5, "a"), (6, "b")], "x int, k string")})
    view.update()
    assert sorted(map(tuple, view.answer.collect())) == [("a", 2, 5), ("b", 1, 6)]
    with pytest.raises(Refused):
        e.materialize(epochs, "SELECT k FROM log LIMIT 1", ["k"])


def people(spark):
    return spark.createDataFrame([(i, i % 3, f"n{i}", i * 10) for i in range(12)] + [(99, None, "lost", 5)], "id int, org int, name string, pay int")


def test_policy_rows_masks_floors_and_refusals(spark):
    p = TablePolicy(
        lambda c: c.member(F.col("org"), "orgs"),
        {"name": ColumnPolicy((Rule(lambda c: c.equals(F.col("id"), "me")),), "MASKED", lambda: F.lit("*"), disclose=True), "pay": ColumnPolicy(otherwise=AGGREGATE_ONLY, floor=5)},
    )
    e = Entitled(spark, {"people": people(spark)}, {"people": p}, Context({"me": 4}, {"orgs": [1, 2]}))
    assert {r.name for r in e.query("SELECT name FROM people").collect()} == {"*", "n4"}
    assert e.query("SELECT count(*) AS n FROM people").first().n == 8
    assert e.query("SELECT sum(pay) AS s FROM people").first().s == sum(i * 10 for i in range(12) if i % 3)
    assert [r.s for r in e.query("SELECT org, sum(pay) AS s FROM people GROUP BY org").collect()] == [None, None]
    assert e.query("SELECT sum(pay) FILTER (WHERE id < 3) AS s FROM people").first().s is None
    for bad in ("SELECT pay FROM people", "SELECT * FROM people", "SELECT max(pay) FROM people", "SELECT sum(pay + 1) FROM people", "SELECT id FROM people WHERE pay > 3", "SELECT sum(pay) OVER () FROM people", "SELECT id FROM other", "SELECT id FROM parquet.`/tmp`"):
        with pytest.raises(Refused):
            e.query(bad)
    assert e.report() == {"people": {"name": "PER_ROW", "pay": AGGREGATE_ONLY}}
    none = Entitled(spark, {"people": people(spark)}, {"people": p}, Context())
    assert none.query("SELECT id FROM people").count() == 0
    assert guard("SELECT 1", {}) == "SELECT 1"


def test_test_only_columns(spark):
    p = TablePolicy(lambda c: F.lit(True), {"name": ColumnPolicy(otherwise="TEST")})
    e = Entitled(spark, {"people": people(spark)}, {"people": p}, Context())
    assert [r.id for r in e.query("SELECT id FROM people WHERE name = 'n4' OR name IN ('n5', 'x') ORDER BY id").collect()] == [4, 5]
    for bad in ("SELECT id FROM people WHERE name LIKE 'n%'", "SELECT id FROM people WHERE name = id", "SELECT name FROM people", "SELECT id FROM people WHERE name IN (SELECT 'n4')"):
        with pytest.raises(Refused):
            e.query(bad)


def test_fence_holds_in_the_optimised_plan(spark):
    df = fence(people(spark).where("org = 1")).where("10 / (id - 3) > 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("id") < plan.index("monotonically_increasing_id")
    assert plan.count("Filter") >= 2


def test_epochs_views_and_late_rows(spark):
    log = spark.createDataFrame([(1, "a", 5, t(1)), (2, "b", 7, t(2))], "id int, k string, x int, ts timestamp_ntz")
    epochs = V.Epochs(spark)
    epochs.declare("log", log, ["id"])
    agg = V.AggregateView(epochs, "log", ["k"], {"n": ("count", "id"), "s": ("sum", "x"), "m": ("max", "x")})
    full = V.StandingView(epochs, lambda s: s["log"].groupBy("k").agg(F.count("*").alias("n")), ["log"], ["k"])
    epochs.refresh(append={"log": spark.createDataFrame([(3, "a", 9, t(4))], log.schema)}, time={"log": ("ts", "1 hour")})
    assert agg.update() == full.update() == 1
    assert sorted(map(tuple, agg.answer.collect())) == [("a", 2, 14, 9), ("b", 1, 7, 7)]
    with pytest.raises(LateRow):
        epochs.refresh(append={"log": spark.createDataFrame([(4, "a", 9, t(1))], log.schema)}, time={"log": ("ts", "1 hour")})
    assert epochs.version == 1
    epochs.refresh(delete={"log": log.where("id = 2")}, upsert={"log": spark.createDataFrame([(1, "c", 1, t(5))], log.schema)})
    full.update()
    cursor, rows = full.drain(0)
    assert cursor == 2 and sorted((r.op, r.k, r.n) for r in rows.collect()) == [("delete", "b", None), ("upsert", "a", 1), ("upsert", "c", 1)]
    assert full.drain(cursor)[1] is None and full.checksum() != 0
    with pytest.raises(Refused):
        V.AggregateView(epochs, "log", ["k"], {"d": ("median", "x")})


def test_federation_limits(spark):
    left = spark.createDataFrame([(i % 5,) for i in range(50)], "k int")
    calls = []

    def scan(lookup):
        calls.append(lookup)
        df = spark.range(20).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v"))
        return df if lookup is None else df.where(F.col("k").isin(lookup["k"]))

    source = Source("s", scan)
    assert federated_join(left, source, "k").count() == 50 and sorted(calls[-1]["k"]) == [0, 1, 2, 3, 4]
    assert federated_join(left, source, "k", JoinPolicy(lookup_keys=2)).count() == 50 and calls[-1] is None
    for policy in (JoinPolicy("lookup", lookup_keys=2), JoinPolicy("broadcast", broadcast_rows=3), JoinPolicy("local", local_rows=3)):
        with pytest.raises(Guardrail):
            federated_join(left, source, "k", policy)
    with pytest.raises(Refused):
        check_zones([source, Source("z", scan, zone="other")])
    opened = []
    parts = PartitionedTable("p", {v: (lambda v=v: opened.append(v) or spark.range(v)) for v in (1, 2, 3)})
    assert parts.scan([3]).count() == 3 and opened == [3] and parts.scan([9]).count() == 0
    assert parquet_source("x", lambda: left, Capabilities(in_size=3)).scan({"k": []}).count() == 0


def test_views_keep_null_keys_and_every_kind_of_change(spark):
    from sparkveil.streaming import views as V

    epochs = V.Epochs(spark)
    schema = "k int, id int, x int"
    epochs.declare("a", spark.createDataFrame([(1, 1, 10), (None, 2, 20), (2, 3, 30)], schema), ["id"])
    epochs.declare("b", spark.createDataFrame([(1, "one"), (3, "three")], "k int, name string"), ["k"])
    groups = V.GroupView(epochs, lambda t: t["a"].groupBy("k").agg(F.count("*").alias("n")), ["a"], ["k"], ["k"])
    averages = V.ChangingAggregateView(epochs, "a", ["k"], lambda: [F.avg("x").alias("m"), F.count_distinct("x").alias("d")])
    joins = {how: V.KeyedJoinView(epochs, "a", "b", ["k"], how, ["id"]) for how in ("inner", "left", "full", "left_semi", "left_anti")}
    union = V.RowView(epochs, [("a", lambda d: d.where("x > 10").select("id")), ("a", lambda d: d.where("x < 30").select("id"))], ["id"])
    epochs.refresh(append={"a": spark.createDataFrame([(None, 4, 40), (1, 5, 50)], schema)})
    groups.update(), union.update()
    assert sorted(map(tuple, groups.answer.collect()), key=str) == sorted([(1, 2), (None, 2), (2, 1)], key=str)
    assert sorted(r.id for r in union.answer.collect()) == [1, 2, 2, 3, 4, 5]
    changes = [
        dict(delete={"a": spark.createDataFrame([(5,), (2,)], "id int")}, upsert={"b": spark.createDataFrame([(2, "two")], "k int, name string")}),
        dict(upsert={"a": spark.createDataFrame([(3, 1, 11)], schema)}),
        dict(delete={"b": spark.createDataFrame([(3,), (1,)], "k int")}),
    ]
    for change in changes:
        epochs.refresh(**change)
        averages.update()
        a, b = epochs.read("a"), epochs.read("b")
        want = a.groupBy("k").agg(F.avg("x").alias("m"), F.count_distinct("x").alias("d"))
        assert sorted(map(tuple, averages.answer.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        for how, view in joins.items():
            view.update()
            assert sorted(map(tuple, view.answer.collect()), key=str) == sorted(map(tuple, a.join(b, ["k"], how).collect()), key=str), how


def test_a_batch_counts_once_and_a_restart_goes_on(spark):
    from sparkveil.streaming import views as V

    epochs = V.Epochs(spark)
    epochs.declare("a", spark.createDataFrame([(1,)], "k int"), ["k"])
    new = spark.createDataFrame([(2,)], "k int")
    assert epochs.refresh(append={"a": new}, batch=("s", 0)) == epochs.refresh(append={"a": new}, batch=("s", 0)) == 1
    again = V.Epochs.open(spark, epochs.folder)
    assert again.refresh(append={"a": new}, batch=("s", 0)) == 1 and again.refresh(append={"a": new}, batch=("s", 1)) == 2
    assert sorted(r.k for r in again.read("a").collect()) == [1, 2, 2]


def test_time_forms_of_the_front_end(spark):
    e = Engine(spark, {"t": spark.createDataFrame([(1, [3, 1]), (2, []), (3, None)], "id int, arr array<int>")})
    got = e.query("SELECT t.id, a.x, a.o FROM t LEFT JOIN UNNEST(t.arr) WITH ORDINALITY AS a(x, o) ON TRUE ORDER BY 1, 3").collect()
    assert [tuple(r) for r in got] == [(1, 3, 1), (1, 1, 2), (2, None, None), (3, None, None)]
    times = "SELECT timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, n) AS ts, n FROM (VALUES (0), (50), (70), (200)) v(n) UNION ALL SELECT NULL, -1"
    e = Engine(spark, {"u": Engine(spark, {}).query(times)})
    rows = e.query("SELECT n, window_start FROM TABLE(SESSION(TABLE u, DESCRIPTOR(ts), INTERVAL '1' MINUTE)) ORDER BY n").collect()
    assert rows[0].window_start is None and len({r.window_start for r in rows[1:]}) == 2
    for sql in (
        "SELECT * FROM TABLE(TUMBLE(TABLE u, DESCRIPTOR(ts), INTERVAL '1' MONTH))",
        "SELECT * FROM u ASOF JOIN u v ON u.n = v.n",
        "SELECT u.n FROM u ASOF JOIN u v MATCH_CONDITION (u.ts = v.ts) ON u.n = v.n",
        "SELECT u.n FROM u ASOF JOIN u v MATCH_CONDITION (u.ts >= v.ts) ON u.n < v.n",
        "SELECT * FROM UNNEST(ARRAY(1)) AS a(x)",
    ):
        with pytest.raises(Refused):
            e.query(sql)


@pytest.mark.parametrize("mode", ["group", "ties", "current row", "no others"])
def test_exclude_over_ranges_deals_out_frames(spark, tmp_path, mode):
    name = "exclude_" + mode.replace(" ", "_")
    keys = [None, None, *range(-45, 46), *range(2545, 2576), 7, 7, 7, 10**12, 10**12 + 20]
    rows = [(None if i % 11 == 3 else i % 90, k, p) for i, (k, p) in enumerate((k, p) for k in keys for p in ("a", "b", None))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    sql = catalog.oracle_sql()[name].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(r) for r in duckdb.connect().sql(sql).fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    frames = [line for line in plan.splitlines() if "RangeFrame" in line]
    assert frames and all("__b" in line for line in frames) and "collect_list" not in plan


def test_exclude_over_ranges_at_the_ends_of_integers(spark):
    top = (1 << 63) - 1
    df = spark.createDataFrame([(1, top, top), (2, top, top), (3, top - 20, 5), (4, -top - 1, -1), (5, -top, -2), (6, None, top)], "id int, k bigint, x bigint")
    calls = {"s": ("sum", "x"), "m": ("max", "x")}
    # the sum of both peers at the top does not fit, and no row asks for it
    got = {r.id: (r.s, r.m) for r in winext.exclude_range(df, [], "k", -19, 19, "group", calls).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (-2, -2), 5: (-1, -1), 6: (None, None)}
    for wrong in ((df, "others"), (df.withColumn("k", F.lit(1.5)), "group")):
        with pytest.raises(ValueError):
            winext.exclude_range(wrong[0], [], "k", -20, 20, wrong[1], calls)
