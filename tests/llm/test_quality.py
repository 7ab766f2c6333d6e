import numpy as np

from sparkveil.llm import quality as q


def test_isotonic_is_monotone_and_pools():
    knots, values = q.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1, 5, 2, 9]), np.array([10, 10, 10, 10]))
    assert len(knots) == 3 and (np.diff(values) >= 0).all()


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(40)]
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:8] * 5)
        rows.append((i, text, 3, "x"))
        labels.append((i, int(good), 0))
    labels += [(3, None, 1), (None, 0, 0)]
    rows += [(5000, None, 1, ""), (5001, "", 1, ""), (None, "abc def", 1, ""), (5002, "w " * 50000, 1, ""), (5002, "w " * 50000, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, key string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = q.quality(docs, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, y, _ in labels if y is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    odd = {r.doc_id: r.score for r in got}
    assert odd[5000] == odd[5001]
    kept = q.keep_good(docs, lab)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}
    assert q.quality(docs.limit(0), lab).collect() == []
    assert {r.score for r in q.quality(docs, lab.limit(0)).collect()} == {0.5}
