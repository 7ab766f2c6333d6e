"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample

#: Labelled rows that a fit reads at most (in expectation; chosen by hashed id).
FIT_ROWS = 20_000
#: Partitions whose normal equations are summed.
FIT_PARTS = 12
FREQUENCIES = 384
BINS = 400

_KIND = np.zeros(256, dtype=np.int64)  # 0 other, 1 a-z, 2 A-Z, 3 digit, 4 blank, 5 newline, 6 sentence mark, 7 other mark, 8 non-ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 1, 2, 3, 4, 5, 8
for _b in range(33, 127):
    if not _KIND[_b]:
        _KIND[_b] = 6 if chr(_b) in ".,;:'\"?-" else 7

N_FEATURES = 20


def statistics(text: bytes | None) -> np.ndarray:
    """Statistics of the whole text; of an empty text all zero."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    words = text.split()
    n, nw = len(text), len(words)
    if not nw:
        return out
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=9)
    share = counts[counts > 0] / n
    seen = Counter(words)
    lines = [x for x in text.split(b"\n") if x]
    pairs = sum(map(bytes.__eq__, words, words[1:]))
    out[0] = np.log1p(nw)
    out[1] = n / nw
    out[2:10] = kinds[1:] / n
    out[10] = -(share * np.log2(share)).sum()
    out[11] = len(seen) / nw
    out[12] = np.log(len(seen)) / np.log(nw + 1)
    out[13] = max(seen.values()) / nw
    out[14] = pairs / nw
    out[15] = len(zlib.compress(text, 1)) / n
    out[16] = len(set(lines)) / max(1, len(lines))
    out[17] = np.log1p(n / max(1, len(lines)))
    out[18] = np.log1p(max(map(len, seen)))
    out[19] = kinds[2] / max(1.0, kinds[1] + kinds[2])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([waves, z / 5, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over score bins; returns block centres and smoothed rates."""
    blocks: list[list[float]] = []
    for s, g, k in zip(score, good, n, strict=True):
        blocks.append([s * k, float(g), float(k)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    if not blocks:
        return np.zeros(1), np.full(1, 0.5)
    arr = np.array(blocks)
    return arr[:, 0] / arr[:, 2], np.maximum.accumulate((arr[:, 1] + 0.5) / (arr[:, 2] + 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", ridge: float = 1e-3, seed: int = 7) -> Model:
    """Fit on at most about ``bound`` labelled rows, one in five of them for the calibration.

    Each partition sums its own normal equations; Spark adds them by matrix row and the driver solves
    one system whose size is the number of features, whatever the input.
    """
    sample = labelled_sample(docs, labels, label, bound, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "part"])

    rows = sample.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int").alias("part"))
    rows = rows.mapInArrow(measure, "x array<double>, y int, part int").repartition(FIT_PARTS, F.xxhash64("x")).cache()
    spread = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v"), F.stddev_pop("v")).collect()
    rng = np.random.default_rng(seed)
    freq = rng.normal(size=(N_FEATURES, FREQUENCIES)) / np.sqrt(N_FEATURES) * 1.5
    model = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), freq, rng.uniform(0, 2 * np.pi, FREQUENCIES), np.zeros(FREQUENCIES + N_FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    for i, mean, std in spread:
        model.mean[i], model.scale[i] = mean, std if std > 1e-9 else 1.0

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FREQUENCIES + N_FEATURES + 1
        total = np.zeros((size, size + 1))
        n = 0
        for b in batches:
            y = np.array(b.column(1).to_pylist(), dtype=float)
            x = np.array(b.column(0).to_pylist(), dtype=float).reshape(len(y), N_FEATURES)
            z = model.lift(x)
            total += z.T @ np.hstack([z, y[:, None]])
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    sums = rows.where("part <> 0").mapInArrow(equations, "i int, v array<double>")
    added = F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    system = sums.groupBy("i").agg(F.collect_list("v").alias("all")).select("i", added.alias("v")).orderBy("i").collect()
    if system:
        matrix = np.array([r.v for r in system])
        a, b = matrix[:, :-1], matrix[:, -1]
        model.weights = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) / 100 * np.eye(len(a)), b)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.array(b.column(1).to_pylist(), dtype=np.int64)
            x = np.array(b.column(0).to_pylist(), dtype=float).reshape(len(y), N_FEATURES)
            k = np.clip(np.floor(model.raw(x) * BINS), -BINS, 2 * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(y)], names=["k", "y"])

    bins = rows.where("part = 0").mapInArrow(binned, "k long, y long").groupBy("k").agg(F.sum("y"), F.count("y")).orderBy("k").collect()
    rows.unpersist()
    if bins:
        k, good, n = map(np.array, zip(*bins, strict=True))
        model.knots, model.values = isotonic((k + 0.5) / BINS, good, n)
    return model


def _scored(docs: DataFrame, model: Model, key: Column, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            x = np.array([statistics(t.as_py()) for t in text]).reshape(len(text), N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(model.score(x))], names=b.schema.names)

    rows = docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("text"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(run, rows.schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **fit_options) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.

    Null and empty texts get the score of all-zero statistics. Null labels are ignored; without any
    labelled row every score is 0.5. Other columns, whatever their names, are never inputs.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fit_options)
    scored = _scored(docs, model, F.col(id_col).cast("long"), text_col).drop("text")
    return scored.select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **fit_options) -> DataFrame:
    """The documents that the classifier accepts, with their columns: no shuffle of the texts."""
    model = fit(docs, labels, text_col=text_col, **fit_options)
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col), F.lit(0).alias("__row"))
    kept = _scored(docs, model, others, text_col).where(F.col("score") >= threshold)
    return kept.select(*(F.col("text").cast("string").alias(c) if c == text_col else F.col("key").getField(c).alias(c) for c in docs.columns))
