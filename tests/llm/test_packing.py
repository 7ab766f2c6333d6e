import random

from sparkveil.llm import packing as p


def sequential(lengths, sizes, preferred, cost):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] - b[1] >= n]
        if fit:
            b = min(fit, key=lambda b: b[0] - b[1])
        else:
            b = [min((c for c in sizes if c >= n and (c >= preferred or c == sizes[-1])), key=lambda c: (cost(c) / c, c)), 0]
            bins.append(b)
        b[1] += n
    return sum(cost(min(c for c in sizes if c >= b[1])) for b in bins)


def test_plan_costs_what_item_by_item_best_fit_costs():
    rng = random.Random(8)
    sizes = (8, 16, 40)
    cost = lambda c: 3 + c + c * c / 60
    for _ in range(60):
        lengths = [rng.choice([rng.randrange(1, 41), 7, 3]) for _ in range(rng.randrange(1, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        runs, total = p.plan(counts, sizes, cost)
        assert abs(total - min(sequential(lengths, sizes, s, cost) for s in sizes)) < 1e-6
        assert sum(r.items for r in runs) == len(lengths)


def check(rows, sizes):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert {(r.bin_used, r.capacity) for r in members} == {(at, min(c for c in sizes if c >= at))}


def test_every_token_is_placed_once(spark):
    rng = random.Random(6)
    texts = [(i, "w " * rng.choice([0, 3, 3, 3, 50, rng.randrange(200)])) for i in range(500)]
    texts += [(None, "a b"), (None, "a b"), (7, None), (900, ""), (901, "x " * 20000), (901, "x " * 20000)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, length int, bin_id int")
    sizes = (16, 64, 128)
    rows = p.pack(df, capacities=sizes).collect()
    check(rows, sizes)
    assert sum(r.length for r in rows) == sum(len((t or "").split()) + 1 for _, t in texts)
    assert p.pack(df.limit(0)).collect() == []
