"""Queries that Spark SQL expresses as they stand: scans, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import query
from ..tables import views


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a SQL query; the other engine runs the same text unless it needs its own spelling."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    query(name, oracle or text)(run)


MONEY = "cast(l_extendedprice as decimal(12,2))"
DISCOUNTED = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"

# --- scans, projections, predicates -------------------------------------------------------------
sql("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_returnflag || l_linestatus AS flags FROM lineitem WHERE l_quantity > 40")
sql("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN timestamp '1995-01-01' AND timestamp '1996-01-01' AND o_totalprice NOT BETWEEN 1000 AND 100000")
sql("comparison_suite", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
sql("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS is_11 FROM part")
sql("in_list", "SELECT s_suppkey, s_nationkey IN (1, 2, 3) AS listed, s_nationkey NOT IN (4, 5) AS unlisted, s_nationkey IN (1, NULL) AS unsure FROM supplier")
sql("like_prefix", r"SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'S%' OR p_brand LIKE '%#_2' ESCAPE '!' OR p_name LIKE '%!%%' ESCAPE '!'")
sql("ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%' OR lower(c_name) LIKE '%9'")
sql("kleene_logic", "SELECT t.a, t.b, t.a AND t.b AS both_, t.a OR t.b AS any_, NOT t.a AS not_a, t.a IS TRUE AS a_true, t.a IS NOT FALSE AS not_false, t.b IS NULL AS b_null FROM (VALUES (true, true), (true, false), (true, NULL), (false, false), (false, NULL), (CAST(NULL AS boolean), CAST(NULL AS boolean))) AS t(a, b)")
sql("null_safe_compare", "SELECT t.a, t.b, t.a IS DISTINCT FROM t.b AS differ, t.a IS NOT DISTINCT FROM t.b AS same FROM (VALUES (1, 1), (1, 2), (1, NULL), (CAST(NULL AS int), CAST(NULL AS int))) AS t(a, b)")
sql("nullif_coalesce", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st, coalesce(nullif(o_orderstatus, 'F'), nullif(o_orderpriority, '1-URGENT'), 'none') AS pick FROM orders")
sql("least_greatest", "SELECT l_orderkey, l_linenumber, greatest(l_quantity, l_tax * 100, NULL) AS g, least(l_quantity, l_discount * 100) AS l FROM lineitem")
sql("cast_suite", "SELECT o_orderkey, CAST(o_orderkey AS string) AS s, CAST(CAST(o_orderkey AS string) AS int) AS i, CAST(CAST(o_orderdate AS date) AS string) AS d, CAST(CAST(CAST(o_totalprice AS decimal(12,2)) AS decimal(12,1)) AS double) AS r, TRY_CAST(o_orderpriority AS int) AS t FROM orders".replace(" AS d,", " AS d,"), "SELECT o_orderkey, CAST(o_orderkey AS varchar) AS s, CAST(o_orderkey AS int) AS i, CAST(CAST(o_orderdate AS date) AS string) AS d, CAST(CAST(CAST(o_totalprice AS decimal(12,2)) AS decimal(12,1)) AS double) AS r, TRY_CAST(o_orderpriority AS int) AS t FROM orders")
sql("arith_suite", "SELECT l_orderkey, l_linenumber, l_partkey + 7 AS a, l_partkey - l_suppkey AS b, l_partkey * 3 AS c, l_partkey div 7 AS d, l_partkey % 7 AS e, -l_linenumber AS f, abs(l_suppkey - l_partkey) AS g, round(l_extendedprice, 1) AS h, CAST(floor(l_quantity / 3) AS bigint) AS i, CAST(ceil(l_quantity / 3) AS bigint) AS j, CAST(sign(l_discount - 0.05) AS int) AS k FROM lineitem", "SELECT l_orderkey, l_linenumber, l_partkey + 7 AS a, l_partkey - l_suppkey AS b, l_partkey * 3 AS c, l_partkey // 7 AS d, l_partkey % 7 AS e, -l_linenumber AS f, abs(l_suppkey - l_partkey) AS g, round(l_extendedprice, 1) AS h, CAST(floor(l_quantity / 3) AS bigint) AS i, CAST(ceil(l_quantity / 3) AS bigint) AS j, CAST(sign(l_discount - 0.05) AS int) AS k FROM lineitem")
sql("math_functions", "SELECT p_partkey, round(power(p_size, 2), 6) AS p, round(sqrt(p_size), 6) AS s, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS lg, round(exp(p_size / 100), 6) AS e FROM part")
sql("string_suite", "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS lo, char_length(c_name) AS n, concat(c_name, '-', c_mktsegment) AS c, substring(c_name, 3, 4) AS sub, position('0' IN c_name) AS p, replace(c_name, '0', 'o') AS r, trim(both 'C' from c_name) AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, startswith(c_name, 'C') AS st, endswith(c_name, '1') AS en FROM customer", "SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS lo, CAST(length(c_name) AS int) AS n, concat(c_name, '-', c_mktsegment) AS c, substring(c_name, 3, 4) AS sub, CAST(position('0' IN c_name) AS int) AS p, replace(c_name, '0', 'o') AS r, trim(c_name, 'C') AS t, ltrim('  x') AS lt, rtrim('x  ') AS rt, starts_with(c_name, 'C') AS st, ends_with(c_name, '1') AS en FROM customer")
sql("star_except", "SELECT * EXCEPT (r_name) FROM region", "SELECT * EXCLUDE (r_name) FROM region")
sql("temporal_suite", "SELECT event_id, CAST(extract(YEAR FROM ts) AS bigint) AS y, CAST(extract(QUARTER FROM ts) AS bigint) AS q, CAST(extract(MONTH FROM ts) AS bigint) AS m, CAST(extract(WEEK FROM ts) AS bigint) AS w, CAST(extract(DAY FROM ts) AS bigint) AS d, CAST(extract(DOW FROM ts) - 1 AS bigint) AS dow, CAST(extract(DOY FROM ts) AS bigint) AS doy, CAST(extract(HOUR FROM ts) AS bigint) AS h, CAST(extract(MINUTE FROM ts) AS bigint) AS mi, CAST(floor(extract(SECOND FROM ts)) AS bigint) AS s, CAST(date_trunc('HOUR', ts) AS timestamp_ntz) AS fl, ts + INTERVAL '90' MINUTE AS later, timestampdiff(HOUR, timestamp_ntz '2024-01-01 00:30:00', ts) AS hours FROM events", "SELECT event_id, extract(YEAR FROM ts) AS y, extract(QUARTER FROM ts) AS q, extract(MONTH FROM ts) AS m, extract(WEEK FROM ts) AS w, extract(DAY FROM ts) AS d, extract(DOW FROM ts) AS dow, extract(DOY FROM ts) AS doy, extract(HOUR FROM ts) AS h, extract(MINUTE FROM ts) AS mi, CAST(floor(extract(SECOND FROM ts)) AS bigint) AS s, date_trunc('hour', ts) AS fl, ts + INTERVAL '90' MINUTE AS later, datesub('hour', timestamp '2024-01-01 00:30:00', ts) AS hours FROM events")
sql("values_inline", "SELECT v.id, v.name FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(id, name)")

# --- sort and limit ------------------------------------------------------------------------------
sql("topn_nulls_last", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 25")
sql("offset_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 30")
sql("order_by_unselected", "SELECT c_name FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 40")
sql("order_by_ordinal", "SELECT p_brand AS b, p_partkey FROM part ORDER BY 1 NULLS LAST, p_partkey DESC NULLS FIRST LIMIT 30")

# --- joins ---------------------------------------------------------------------------------------
sql("inner_join", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000")
sql("left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
sql("right_join", "SELECT n_name, r_name FROM region RIGHT JOIN nation ON r_regionkey = n_regionkey AND r_name <> 'ASIA'")
sql("full_join_whole", "SELECT a.s_suppkey AS s, b.c_custkey AS c FROM supplier a FULL JOIN customer b ON a.s_suppkey = b.c_custkey")
sql("cross_join", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
sql("semi_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
sql("anti_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
sql("not_in_nulls", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 9) FROM region WHERE r_regionkey < 2)")
sql("not_in_with_a_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region)")
sql("null_safe_join", "SELECT a.o_orderkey, b.k FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) a JOIN (VALUES ('F', 1), (CAST(NULL AS string), 2)) AS b(s, k) ON a.s IS NOT DISTINCT FROM b.s", "SELECT a.o_orderkey, b.k FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) a JOIN (VALUES ('F', 1), (NULL, 2)) AS b(s, k) ON a.s IS NOT DISTINCT FROM b.s")
sql("theta_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 5")
sql("scalar_subquery", "SELECT c_custkey, c_acctbal - (SELECT max(c_acctbal) FROM customer) AS gap, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
sql("any_subquery", "SELECT p_partkey FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_retailprice > 1900)", "SELECT p_partkey FROM part WHERE p_size = ANY (SELECT p_size FROM part WHERE p_retailprice > 1900)")
sql("lateral_topn", "SELECT c_custkey, t.o_orderkey, t.o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 2) t WHERE c_nationkey < 5")
sql("lateral_left_agg", "SELECT n_nationkey, t.n, t.top FROM nation LEFT JOIN LATERAL (SELECT count(*) AS n, max(c_acctbal) AS top FROM customer WHERE c_nationkey = n_nationkey) t ON true")
sql("self_join_shared_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey AS x, b.o_custkey AS y FROM big a JOIN big b ON a.n = b.n AND a.o_custkey < b.o_custkey WHERE a.n > 20")

# --- aggregates ----------------------------------------------------------------------------------
sql("tpch_q1", f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS decimal(12,2))) AS double) AS sum_qty, CAST(sum({MONEY}) AS double) AS sum_base_price,
 CAST(sum({DISCOUNTED}) AS double) AS sum_disc_price, CAST(sum({DISCOUNTED} * (1 + CAST(l_tax AS decimal(4,2)))) AS double) AS sum_charge,
 round(CAST(sum(CAST(l_quantity AS decimal(12,2))) AS double) / count(*), 6) AS avg_qty, count(*) AS count_order
 FROM lineitem WHERE l_shipdate <= timestamp '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
sql("tpch_q3", f"""SELECT l_orderkey, CAST(sum({DISCOUNTED}) AS double) AS revenue, o_orderdate FROM customer, orders, lineitem
 WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < timestamp '1995-03-15' AND l_shipdate > timestamp '1995-03-15'
 GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
sql("tpch_q5", f"""SELECT n_name, CAST(sum({DISCOUNTED}) AS double) AS revenue FROM customer, orders, lineitem, supplier, nation, region
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
 AND r_name = 'ASIA' AND o_orderdate >= timestamp '1994-01-01' AND o_orderdate < timestamp '1997-01-01' GROUP BY n_name""")
sql("tpch_q6", "SELECT CAST(sum(CAST(l_extendedprice AS decimal(12,2)) * CAST(l_discount AS decimal(4,2))) AS double) AS revenue FROM lineitem WHERE l_shipdate >= timestamp '1994-01-01' AND l_shipdate < timestamp '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("tpch_q10", f"""SELECT c_custkey, c_name, CAST(sum({DISCOUNTED}) AS double) AS revenue, n_name FROM customer, orders, lineitem, nation
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey AND o_orderdate >= timestamp '1993-10-01' AND o_orderdate < timestamp '1994-10-01'
 GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("count_distinct_mixed", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS bigint) AS lines FROM lineitem GROUP BY l_returnflag")
sql("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("filter_agg", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_totalprice < 1000) AS m, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS bigint) AS o FROM orders GROUP BY o_orderpriority")
sql("sum_of_nothing", "SELECT sum(p_size) AS s, coalesce(sum(p_size), 0) AS s0, count(p_size) AS n, min(p_name) AS lo, max(p_name) AS hi FROM part WHERE p_size < 0", "SELECT CAST(sum(p_size) AS bigint) AS s, CAST(coalesce(sum(p_size), 0) AS bigint) AS s0, count(p_size) AS n, min(p_name) AS lo, max(p_name) AS hi FROM part WHERE p_size < 0")
sql("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 50000")
for _kind, _by in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("grouping_sets", "GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")):
    sql(_kind, f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS bigint) AS gf, CAST(grouping(l_linestatus) AS bigint) AS gs, count(*) AS n FROM lineitem GROUP BY {_by}")
sql("rollup_times_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag), ROLLUP (l_linestatus)")
sql("grouping_id", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS bigint) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("percentile_cont", "SELECT o_orderpriority, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q1, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders GROUP BY o_orderpriority")
sql("percentile_disc", "SELECT o_orderpriority, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS med FROM orders GROUP BY o_orderpriority")
sql("listagg", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("mode_agg", "SELECT o_orderpriority, mode() WITHIN GROUP (ORDER BY o_custkey) AS m FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, arg_min(o_custkey, (-n, o_custkey)) AS m FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderpriority")
sql("bool_and_or", "SELECT o_orderpriority, bool_and(o_totalprice > 1000) AS every_, bool_or(o_totalprice > 400000) AS some_, any_value(o_orderpriority) AS one FROM orders GROUP BY o_orderpriority")
sql("avg_double", "SELECT l_returnflag, round(avg(CAST(l_linenumber AS double)), 9) AS a FROM lineitem GROUP BY l_returnflag")
sql("pivot", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (count(*) AS n, max(o_totalprice) AS m FOR o_orderstatus IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f_n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f_m, count(*) FILTER (WHERE o_orderstatus = 'O') AS o_n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o_m FROM orders GROUP BY o_orderpriority")

# --- windows -------------------------------------------------------------------------------------
W = "PARTITION BY l_suppkey ORDER BY l_orderkey NULLS LAST, l_linenumber NULLS LAST, l_partkey NULLS LAST, l_extendedprice NULLS LAST, l_quantity NULLS LAST"
sql("ranking_family", "SELECT o_orderkey, CAST(row_number() OVER w AS bigint) AS rn, CAST(rank() OVER v AS bigint) AS rk, CAST(dense_rank() OVER v AS bigint) AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey), v AS (PARTITION BY o_orderpriority ORDER BY o_custkey)")
sql("ntile", "SELECT c_custkey, CAST(ntile(7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS bigint) AS nt FROM customer")
sql("lag_lead", f"SELECT l_orderkey, l_linenumber, lag(l_quantity, 2, 0.0) OVER ({W}) AS lg, lead(l_quantity) OVER ({W}) AS ld FROM lineitem", f"SELECT l_orderkey, l_linenumber, lag(l_quantity, 2, 0.0::double) OVER ({W}) AS lg, lead(l_quantity) OVER ({W}) AS ld FROM lineitem")
sql("lag_ignore_nulls", f"SELECT l_orderkey, l_linenumber, lag(nullif(l_returnflag, 'N')) IGNORE NULLS OVER ({W}) AS lg FROM lineitem", f"SELECT l_orderkey, l_linenumber, lag(nullif(l_returnflag, 'N') IGNORE NULLS) OVER ({W}) AS lg FROM lineitem")
sql("first_last_nth", f"SELECT l_orderkey, l_linenumber, first_value(l_partkey) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f, last_value(l_partkey) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l, nth_value(l_partkey, 3) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM lineitem WINDOW w AS ({W})".replace("(w ROWS", f"({W} ROWS").replace(f" WINDOW w AS ({W})", ""))
sql("rows_frame", f"SELECT l_orderkey, l_linenumber, sum(l_linenumber) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS s, max(l_quantity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, count(*) OVER ({W} ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS n FROM lineitem", f"SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS bigint) AS s, max(l_quantity) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m, count(*) OVER ({W} ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS n FROM lineitem")
sql("range_interval_frame", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '24' HOUR PRECEDING AND INTERVAL '1' HOUR PRECEDING) AS m FROM events")
sql("range_numeric_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS n FROM orders")
sql("bool_over", f"SELECT l_orderkey, l_linenumber, bool_and(l_quantity > 5) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b, bool_or(l_quantity > 45) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM lineitem")
sql("window_over_groups", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC, o_custkey) AS bigint) AS r FROM orders GROUP BY o_custkey")
sql("group_over_window", "SELECT t.rn, count(*) AS n FROM (SELECT CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bigint) AS rn FROM orders) t GROUP BY t.rn")
sql("mode_over", "SELECT o_orderkey, mode(o_orderstatus) OVER (PARTITION BY o_custkey) AS whole FROM (SELECT * FROM orders WHERE o_orderstatus = 'F')", "SELECT o_orderkey, mode(o_orderstatus) OVER (PARTITION BY o_custkey) AS whole FROM orders WHERE o_orderstatus = 'F'")

# --- set operations ------------------------------------------------------------------------------
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"{_name}_whole", f"SELECT nullif(c_nationkey, 3) AS k FROM customer {_op} SELECT nullif(s_nationkey, 3) FROM supplier")
sql("union_coerces", "SELECT CAST(n_nationkey AS bigint) AS k, n_name AS v FROM nation UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000")

# --- lists ---------------------------------------------------------------------------------------
WORDS = "split(c_name, '#')"
sql("unnest_cross_whole", "SELECT vec_id, x FROM embeddings LATERAL VIEW explode(embedding) t AS x", "SELECT vec_id, unnest(embedding) AS x FROM embeddings")
sql("unnest_left_ordinality_whole", "SELECT vec_id, CAST(pos + 1 AS int) AS ord, x FROM embeddings LATERAL VIEW OUTER posexplode(CASE WHEN label > 5 THEN embedding END) t AS pos, x", "SELECT vec_id, ord, x FROM (SELECT vec_id, unnest(embedding) AS x, CAST(generate_subscripts(embedding, 1) AS int) AS ord FROM embeddings WHERE label > 5) UNION ALL SELECT vec_id, NULL, NULL FROM embeddings WHERE label <= 5")
sql("cardinality_item", "SELECT vec_id, cardinality(embedding) AS n, CASE WHEN label > 0 THEN try_element_at(embedding, label) END AS item, try_element_at(embedding, 1000) AS none FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS int) AS n, CASE WHEN label > 0 THEN embedding[label] END AS item, embedding[1000] AS none FROM embeddings")
sql("array_to_string", "SELECT n_nationkey, array_join(array(n_name, nullif(n_name, n_name), 'z'), ',') AS s FROM nation", "SELECT n_nationkey, array_to_string([n_name, 'z'], ',') AS s FROM nation")
sql("composite_fields", "SELECT q.c_custkey, q.s.name AS name, q.s.bal AS bal FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN named_struct('name', c_name, 'bal', c_acctbal) END AS s FROM customer) q", "SELECT q.c_custkey, q.s.name AS name, q.s.bal AS bal FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {'name': c_name, 'bal': c_acctbal} END AS s FROM customer) q")

# --- more types and forms ------------------------------------------------------------------------
sql("timestamp_add", "SELECT event_id, timestampadd(DAY, 3, ts) AS d, timestampadd(HOUR, -5, ts) AS h, ts - INTERVAL '1 02:03:04' DAY TO SECOND AS back FROM events", "SELECT event_id, ts + INTERVAL 3 DAY AS d, ts - INTERVAL 5 HOUR AS h, ts - (INTERVAL 1 DAY + INTERVAL 2 HOUR + INTERVAL 3 MINUTE + INTERVAL 4 SECOND) AS back FROM events")
sql("interval_arith", "SELECT event_id, timestampdiff(MINUTE, lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap, ts + INTERVAL '1' MONTH AS m, ts + 2 * INTERVAL '30' SECOND AS s FROM events", "SELECT event_id, datesub('minute', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) AS gap, ts + INTERVAL 1 MONTH AS m, ts + INTERVAL 60 SECOND AS s FROM events")
sql("temporal_text_cast", "SELECT event_id, CAST(CAST(date_trunc('SECOND', ts) AS timestamp_ntz) AS string) AS t, CAST(CAST(ts AS date) AS string) AS d, CAST('2024-03-05 06:07:08' AS timestamp_ntz) AS p FROM events", "SELECT event_id, CAST(date_trunc('second', ts) AS varchar) AS t, CAST(CAST(ts AS date) AS varchar) AS d, CAST('2024-03-05 06:07:08' AS timestamp) AS p FROM events")
sql("floor_to_units", "SELECT event_id, CAST(date_trunc('YEAR', ts) AS timestamp_ntz) AS y, CAST(date_trunc('QUARTER', ts) AS timestamp_ntz) AS q, CAST(date_trunc('WEEK', ts) AS timestamp_ntz) AS w, CAST(date_trunc('MINUTE', ts) AS timestamp_ntz) AS mi FROM events", "SELECT event_id, date_trunc('year', ts)::timestamp AS y, date_trunc('quarter', ts)::timestamp AS q, date_trunc('week', ts)::timestamp AS w, date_trunc('minute', ts)::timestamp AS mi FROM events")
sql("decimal_suite", "SELECT o_orderkey, CAST(CAST(CAST(o_totalprice AS decimal(12,2)) + 1.25 AS decimal(14,2)) AS double) AS a, CAST(CAST(CAST(o_totalprice AS decimal(12,2)) * 3 AS decimal(14,2)) AS double) AS m, CAST(round(CAST(o_totalprice AS decimal(12,2)), 0) AS double) AS r, CAST(abs(-CAST(o_totalprice AS decimal(12,2))) AS double) AS b FROM orders")
sql("group_id_emulated", "SELECT l_returnflag, g, count(*) AS n FROM lineitem LATERAL VIEW explode(array(0L, 1L)) t AS g GROUP BY l_returnflag, g", "SELECT l_returnflag, CAST(g AS bigint) AS g, count(*) AS n FROM lineitem CROSS JOIN (VALUES (0), (1)) t(g) GROUP BY l_returnflag, g")
sql("distinct_agg_in_sets", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
sql("min_max_text_time", "SELECT event_type, min(ts) AS a, max(ts) AS b, min(props) AS c FROM events GROUP BY event_type")
sql("join_on_expression", "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey + 1 = b.r_regionkey + 1 AND length(a.n_name) > length(b.r_name)")
sql("union_limit", "SELECT k FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) t ORDER BY k NULLS LAST LIMIT 9")
sql("exists_with_or", "SELECT p_partkey FROM part WHERE p_size = 1 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)")
sql("listagg_over", "SELECT o_orderkey, listagg(o_orderstatus, '') OVER (PARTITION BY o_custkey) AS w FROM (SELECT * FROM orders WHERE o_orderstatus = 'O')", "SELECT o_orderkey, string_agg(o_orderstatus, '') OVER (PARTITION BY o_custkey) AS w FROM orders WHERE o_orderstatus = 'O'")
