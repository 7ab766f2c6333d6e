import itertools

import numpy as np
import pyarrow as pa
import pytest

from sparkveil.llm import toxicity as tx


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes = [1, 4, 6, 2, 5]
    chain = np.repeat(np.arange(len(sizes)), sizes)
    emission, trans = rng.normal(size=len(chain)), rng.normal(size=(2, 2))
    pairs = np.zeros((2, 2))
    got = tx.marginals(emission, chain, trans, pairs)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for n in sizes:
        weight, joint = np.zeros((n, 2)), np.zeros((2, 2))
        total = 0.0
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emission[at + i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            for i, t in enumerate(tags):
                weight[i, t] += w
            for a, b in zip(tags, tags[1:]):
                joint[a, b] += w
        want += list(np.log(weight[:, 1] / weight[:, 0]))
        want_pairs += joint / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_tokens_of_mixed_texts():
    texts = ["Ab cd. Éf!".encode(), b"", b"x" * 500 + b" y"]
    t = tx.tokenize(texts)
    assert list(t.doc) == [0, 0, 0, 2, 2] and list(t.chain) == [0, 0, 1, 2, 2]
    assert t.word[0] == tx.tokenize([b"aB"]).word[0]
    assert tx.tokenize([b"", b""]).features.shape[0] == 0


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        body = list(rng.choice(words, 30))
        if toxic:
            for k in rng.choice(30, 4, replace=False):
                body[k] = "zorgul" + str(rng.choice(["xa", "en", "it", "os"]))
        rows.append((i, " ".join(body) + ".", 1 if toxic else 0, "s"))
        labels.append((i, None, int(toxic)))
    labels += [(1, 1, None), (None, 1, 1), (9999, 0, 1)]
    rows += [(5000, None, 0, ""), (5001, "", 0, ""), (None, "zorgqq", 0, ""), *[(5002, "zorgulma zorgulpe zorgulta fine words", 0, "")] * 2, (5003, "é" * 30000, 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, spans string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = tx.toxicity(docs, lab).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels if t is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    odd = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 5000}
    assert odd[5000].predicted == odd[5001].predicted == odd[5003].predicted == 0 and odd[5000].score == odd[5001].score
    assert odd[5002].predicted == 1 and (0, 8) in [(s.start, s.end) for s in odd[5002].spans]
    assert all(0 <= r.score <= 1 for r in got)
    assert tx.toxicity(docs.limit(0), lab).collect() == []
    assert {r.score for r in tx.toxicity(docs, lab.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("endings,each", [(["xa", "en", "it", "ul"], 4), ([a + b for a in "bcdfghijklnoqrsuvwxyz0123456789" for b in "aeiou"], 1)], ids=["few", "each rare"])
def test_a_root_of_four_bytes_labels_its_forms(spark, endings, each):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        body = list(rng.choice(words, 30))
        if toxic:
            for k in rng.choice(30, each, replace=False):
                body[k] = "zorg" + str(rng.choice(endings))
        rows.append((i, " ".join(body) + "."))
        labels.append((i, int(toxic)))
    rows.append((5002, "zorgma zorgpe zorgta fine words"))
    got = {r.doc_id: r for r in tx.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    assert len(held) > 50 and np.mean([got[i].predicted == dict(labels)[i] for i in held]) > 0.97
    assert got[5002].predicted == 1 and (0, 6) in [(s.start, s.end) for s in got[5002].spans]


@pytest.mark.parametrize("step", ["lexicon", "chains"])
def test_a_fit_takes_long_texts_by_bytes_and_leaves_none_out(monkeypatch, step):
    class Sample:
        """Hands over the function that a step maps over the sample."""

        def select(self, *_):
            return self

        cache = select

        def mapInArrow(self, run, _):
            self.run = run
            raise InterruptedError

    sample, whole, read = Sample(), tx.tokenize, []

    def tokenize(texts):
        read.append((len(texts), sum(map(len, texts))))
        return whole([t[:60] for t in texts])

    monkeypatch.setattr(tx, "tokenize", tokenize)
    monkeypatch.setattr(tx, "labelled_sample", lambda *_: sample)
    if step == "chains":
        monkeypatch.setattr(tx, "lexicon", lambda _: [])
    with pytest.raises(InterruptedError):
        tx.fit(None, None)
    texts = [b"some words " * 10_000] * 300 + [None, b""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array([1, 0] * 151, pa.int32())], names=["text", "y"])
    list(sample.run([batch]))
    assert sum(n for n, _ in read) == 302 and sum(size for _, size in read) == 300 * 110_000
    assert max(size for _, size in read) < 2_500_000
