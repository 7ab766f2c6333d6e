"""The quality model's steps against plain ones."""

import numpy as np

from sparkveil.llm import quality


def test_isotonic_equals_a_plain_search_for_the_nearest_rising_values():
    rng = np.random.default_rng(2)
    score, n = np.arange(12.0), rng.integers(1, 9, 12)
    good = np.minimum(n, rng.integers(0, 9, 12))
    centres, values = quality.isotonic(score, good, n)
    rate = good / n
    plain = [max(min((good[a : b + 1].sum() / n[a : b + 1].sum()) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]  # min-max formula
    blocks = np.searchsorted(np.r_[np.flatnonzero(np.r_[True, np.diff(plain) > 1e-12])], np.arange(12), side="right") - 1
    assert len(centres) <= len(values) and len(np.unique(blocks)) == len(values)
    for b in np.unique(blocks):
        mine = blocks == b
        assert np.isclose(centres[b], (score[mine] * n[mine]).sum() / n[mine].sum())
        assert np.isclose(good[mine].sum() / n[mine].sum(), plain[np.flatnonzero(mine)[0]])
    assert (np.diff(values) >= 0).all() and rate.shape == (12,)


def test_spark_scores_equal_the_model_row_by_row(spark):
    rng = np.random.default_rng(6)
    words = "the a of and to in that it was for on with as his they at be this from have".split()
    rows = []
    for i in range(400):
        good = i % 2
        text = " ".join(rng.choice(words, 40)) + "." if good else "".join(rng.choice(list("#$%@ 0189zx"), 120))
        rows.append((i, text, good))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    x = np.array([quality.statistics(t.encode()) for _, t, _ in rows])
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    for k, (i, _, g) in enumerate(rows):
        assert abs(got[i].score - model.score(x[k : k + 1])[0]) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
    held = [got[i].held_out for i, _, _ in rows]
    assert np.mean([got[i].predicted == g for (i, _, g), h in zip(rows, held) if h]) >= 0.95
