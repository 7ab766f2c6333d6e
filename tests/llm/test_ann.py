from functools import reduce

import numpy as np

from sparkveil.llm import ann


def dot(a, b):
    return reduce(lambda total, xy: total + float(xy[0]) * float(xy[1]), zip(a, b), 0.0)  # sum() compensates


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != 8:
            continue
        good[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q, a in good.items():
        if q % 20 == 0:
            scored = sorted((-dot(a, b), i) for i, b in good.items() if i != q)
            out[q] = [(i, s) for s, i in scored[:k]]
    return out


def test_matches_brute_force_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 2)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[40][1]) for i in range(90)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [None] + [1.0] * 7), (2080, [1.0]), (None, [1.0] * 8), (2100, []), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows, 20)
    assert set(got) == set(want)
    hits = total = 0
    exact = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i in range(2000) and v and len(v) == 8}
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and len({r.vec_id for r in rs}) == 20 and all(r.vec_id != q for r in rs)
        assert all(r.score == dot(exact[q], exact[r.vec_id]) for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        hits += len({r.vec_id for r in rs} & {i for i, _ in want[q]})
        total += 20
    assert hits / total >= 0.95
    assert [r.vec_id for r in got[1000]] == [i for i, _ in want[1000]]  # copies, smallest id first


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.0, 1.0]), (22, [1.0, 0.0])], schema)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect()]
    assert sorted(got) == [(20, 1, 22, 1.0), (20, 2, 21, 0.0)]
    assert ann.nearest(spark.createDataFrame([], schema)).collect() == []
    assert ann.nearest(spark.createDataFrame([(20, [1.0])], schema)).collect() == []


def test_a_few_very_long_vectors_leave_the_others_apart(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[[7, 700, 1400, 2100]] *= np.array([[50.0], [300.0], [300.0], [20000.0]])
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = -(x @ x.T)
    np.fill_diagonal(d, np.inf)
    want = {q: set(np.argsort(d[q])[:20].tolist()) for q in range(0, len(x), 20)}
    assert set(got) == set(want)
    assert sum(len(got[q] & want[q]) for q in want) / (20 * len(want)) >= 0.97


def test_search_ends_only_when_the_whole_beam_is_expanded(spark):
    chain = [(i, [1.0 + 0.1 * i, 0.0]) for i in range(12)]
    away = [(100 + i, [-100.0, float(i)]) for i in range(ann.DEGREE)]  # the longest, where searches also begin
    rows = spark.createDataFrame(chain + away, "id long, v array<double>")
    graph = spark.createDataFrame([(i, [(-1.0, i + 1)] if i < 11 else []) for i in range(12)], f"id long, near {ann._LIST}")
    index = ann.Index(ann.cut(ann._coded(rows, 2e4), "nodes"), rows.selectExpr("id AS vec_id", "id"), graph, 2)
    (found,) = ann.search(index, spark.createDataFrame([(0,)], "id long")).collect()
    assert [e.w for e in found.near[:12]] == list(range(11, -1, -1))


def test_degree_and_beam_follow_the_nodes():
    assert ann.grown(10) == ann.grown(ann.NODES) == (ann.DEGREE, ann.BEAM)
    assert ann.grown(4 * ann.NODES) == (ann.DEGREE + 16, 2 * ann.BEAM)


def test_rounds_and_hops_are_not_spark_jobs(spark):
    x = np.random.default_rng(8).normal(size=(1500, 16)).astype(np.float32).astype(float)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    spark.sparkContext.setJobGroup("op5", "op5")
    got = ann.nearest(df).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("op5")) <= 60
    d = -(x @ x.T)
    np.fill_diagonal(d, np.inf)
    want = {(q, int(w)) for q in range(0, len(x), 20) for w in np.argsort(d[q])[:20]}
    assert len(got) == len(want) and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.97 * len(want)


def test_a_crowded_cell_is_dealt_to_shares_that_are_all_visited(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[:1800] = x[0] + 1e-4 * x[:1800]  # near copies, whose products differ by little
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    index = ann.build(df)
    assert index.cells.shares.max() > 1
    assert sorted(r.id for r in index.graph.select("id").collect()) == list(range(len(x)))
    got = {}
    for r in ann.nearest(df, index=index).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    d = -(x @ x.T)
    np.fill_diagonal(d, np.inf)
    want = {q: set(np.argsort(d[q])[:20].tolist()) for q in range(0, len(x), 20)}
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len(got[q] & want[q]) for q in want) / (20 * len(want)) >= 0.95


def test_lists_hold_a_node_once_and_keep_it_closed():
    near = np.full((2, 3), ann._NONE)
    ann._enter(near, np.array([1, 1, 0]), ann._keys(np.array([-2.0, -1.0, 5.0]), np.array([7, 8, 9])))
    near[1, 0] -= 1  # node 7 is closed
    ann._enter(near, np.array([1, 1, 1]), ann._keys(np.array([-2.0000004, -3.0, -0.5]), np.array([7, 6, 5])))
    assert ann._node(near[1]).tolist() == [6, 7, 8] and (near[1] & 1).tolist() == [1, 0, 1]
    assert ann._node(near[0, :1]).tolist() == [9] and (near[0, 1:] == ann._NONE).all()
