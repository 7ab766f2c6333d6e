"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample

#: Labelled rows that a fit reads at most (in expectation), and chains of tokens it trains on.
FIT_ROWS = 12_000
FIT_CHAINS = 24_000
#: Tokens in one chain: a chain ends with its sentence or after so many tokens.
CHAIN = 64
BITS = 18
#: Contexts that a token needs before its use in labelled documents says anything.
LEAST_CONTEXTS = 8
#: How many times more frequent in toxic documents its contexts must be; prefixes of four bytes, which
#: clean words share more often, need more.
LEAST_RATIO, SHORT_RATIO = 12, 60
#: Bytes of a token that its hash reads; longer tokens are told apart by their length as well.
WORD_BYTES = 64
#: Rows and bytes of text that a fit takes at a time (a longer text by itself); a byte needs some 85 bytes of memory.
PART_ROWS, PART_BYTES = 256, 1 << 21
#: Lengths of the prefixes that are features (of the suffixes: those up to 4).
AFFIXES = (3, 4, 5, 6, 7, 8)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True
_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """Tokens of a batch of texts: document number, byte span, hash, and chain starts."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    stems: np.ndarray  # (n, 6) hashes of the word and of its prefixes of 4 (the second column) to 8 bytes, or 0
    features: np.ndarray  # (n, k) slots below 1 << BITS
    chain: np.ndarray  # number of the chain
    offsets: np.ndarray  # byte offset of each document


def tokenize(texts: list[bytes]) -> Tokens:
    """Words (letters, digits, non-ASCII) of the texts with A-Z lower-cased; all vectorised."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = np.concatenate([[False], _IS_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    n = len(start)
    doc = np.searchsorted(offsets, start, side="right") - 1
    size = end - start
    with np.errstate(over="ignore"):
        bytes_ = raw.astype(np.uint64) + np.uint64(1)
        word = size.astype(np.uint64)  # the hash covers the length and the first WORD_BYTES bytes
        longest = min(WORD_BYTES, int(size.max())) if n else 0
        alive = np.arange(n)
        for i in range(longest):
            alive = alive[size[alive] > i]
            word[alive] = word[alive] * _P + bytes_[start[alive] + i]
        slots, stems = [word * _MIX], [word]
        for k in AFFIXES:
            fits = size > k
            head, tail = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
            at = np.flatnonzero(fits)
            for i in range(k):
                head[at] = head[at] * _P + bytes_[start[at] + i]
                tail[at] = tail[at] * _P + bytes_[end[at] - k + i]
            slots.append(np.where(fits, (head + np.uint64(7 * k + 1)) * _MIX, np.uint64(0)))
            if k >= 4:
                stems.append(slots[-1])
            if k <= 4:
                slots.append(np.where(fits, (tail + np.uint64(1001 * k + 5)) * _MIX * _P, np.uint64(0)))
        stops = np.concatenate([[0], np.cumsum(_ENDS[raw])])
        sentence = stops[start] if n else np.zeros(0, dtype=np.int64)
        first = np.ones(n, dtype=bool)
        first[1:] = (sentence[1:] != sentence[:-1]) | (doc[1:] != doc[:-1])
        at = np.arange(n)
        place = at - np.maximum.accumulate(np.where(first, at, 0))
        first |= place % CHAIN == 0
        chain = np.cumsum(first) - 1
        for shift, salt in ((1, 0xABCDEF1), (-1, 0x1357911)):
            near = np.roll(word, shift)
            same = np.roll(chain, shift) == chain
            if n:
                same[0 if shift == 1 else -1] = False
            slots.append(np.where(same, (near + np.uint64(salt)) * _MIX, np.uint64(0)))
        features = np.stack([(s >> np.uint64(64 - BITS)).astype(np.int32) for s in slots], axis=1) if n else np.zeros((0, 1), dtype=np.int32)
    return Tokens(doc, start, end, word, np.stack(stems, axis=1), features, chain, offsets)


def marginals(emission: np.ndarray, chain: np.ndarray, transition: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Log-odds of the toxic tag at every token, by forward-backward over all chains at once.

    ``emission``: score of tag 1 against tag 0 for each token. The recursion walks the (at most
    ``CHAIN``) places of a chain, and every chain that is long enough moves along. ``pairs`` (2, 2)
    receives the expected counts of neighbouring tags.
    """
    _logadd = np.logaddexp
    n = len(emission)
    if not n:
        return np.zeros(0)
    starts = np.flatnonzero(np.concatenate([[True], chain[1:] != chain[:-1]]))
    sizes = np.diff(np.append(starts, n))
    out = np.empty(n)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    width = int(sizes[0])
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(width)]  # chains longer than t
    t00, t01, t10, t11 = transition.ravel()
    fwd: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(width):
        k = live[t]
        e = emission[starts[:k] + t]
        if t:
            a0, a1 = fwd[-1][0][:k], fwd[-1][1][:k]
            f0, f1 = _logadd(a0 + t00, a1 + t10), _logadd(a0 + t01, a1 + t11) + e
            fwd.append((np.zeros(k), f1 - f0))  # only the difference matters
        else:
            fwd.append((np.zeros(k), e))
    b0 = b1 = np.zeros(0)
    for t in range(width - 1, -1, -1):
        k = live[t]
        n0, n1 = np.zeros(k), np.zeros(k)
        if len(b0):
            e = emission[starts[: len(b0)] + t + 1]
            n0[: len(b0)] = _logadd(t00 + b0, t01 + e + b1)
            n1[: len(b0)] = _logadd(t10 + b0, t11 + e + b1)
            if pairs is not None:
                f = fwd[t][1][: len(b0)]
                joint = np.stack([t00 + b0, t01 + e + b1, f + t10 + b0, f + t11 + e + b1])
                joint = np.exp(joint - joint.max(axis=0))
                pairs += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        out[starts[:k] + t] = fwd[t][1] + n1 - n0
        b0, b1 = np.zeros(k), n1 - n0
    return out


@dataclass
class Field:
    weights: np.ndarray
    bias: float
    transition: np.ndarray
    calibration: np.ndarray  # intercept, best log-odds, logs of the expected toxic tokens and of their share

    def emission(self, tokens: Tokens) -> np.ndarray:
        return self.weights[tokens.features].sum(axis=1) + self.bias

    def odds(self, tokens: Tokens) -> np.ndarray:
        return marginals(self.emission(tokens), tokens.chain, self.transition)

    def documents(self, tokens: Tokens, odds: np.ndarray, n: int) -> np.ndarray:
        """(n, 3): best log-odds, log of the expected number of toxic tokens, and log of their share."""
        out = np.tile([-12.0, 0.0, 0.0], (n, 1))
        np.maximum.at(out[:, 0], tokens.doc, np.clip(odds, -12, 12))
        expected = np.bincount(tokens.doc, weights=1 / (1 + np.exp(-np.clip(odds, -30, 30))), minlength=n)
        out[:, 1] = np.log1p(expected)
        out[:, 2] = np.log((expected + 0.05) / (np.bincount(tokens.doc, minlength=n) + 10))
        return out

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.calibration[0] + found @ self.calibration[1:])))


def _train(features: np.ndarray, chain: np.ndarray, tag: np.ndarray, rounds: int = 60, rate: float = 0.5, decay: float = 1e-5) -> Field:
    """Maximum likelihood by full-batch Adagrad; the gradient is observed minus expected counts.

    Of four rounds one hides the word itself and its neighbours, so that prefixes and suffixes must
    carry the tag alone, as they will for words that the labels never showed; and one shows only
    prefixes up to four bytes, all that a new form of a short root has in common with the known ones.
    """
    weights, bias, transition = np.zeros(1 << BITS), -3.0, np.array([[0.0, -1.0], [0.0, 0.0]])
    square, square_b, square_t = np.full(1 << BITS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    n = max(1, len(tag))
    linked = np.concatenate([chain[1:] == chain[:-1], [False]])[: len(chain)]
    at = np.flatnonzero(linked)
    seen = np.array([[((tag[at] == a) & (tag[at + 1] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    affixes = features.copy()
    affixes[:, [0, -2, -1]] = 0
    heads = np.zeros_like(features)
    heads[:, [1, 3]] = features[:, [1, 3]]  # prefixes of 3 and 4 bytes, see tokenize
    for turn in range(rounds):
        used = (affixes, features, heads, features)[turn % 4]
        emission = weights[used].sum(axis=1) + bias
        expected = np.zeros((2, 2))
        odds = marginals(emission, chain, transition, expected)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        miss = tag - p
        grad = np.bincount(used.ravel(), weights=np.repeat(miss, used.shape[1]), minlength=1 << BITS) / n - decay * weights
        grad[0] = 0  # the slot of absent features
        square += grad**2
        weights += rate * grad / np.sqrt(square)
        weights[0] = 0
        g = miss.mean()
        square_b += g * g
        bias += rate * g / np.sqrt(square_b)
        g = (seen - expected) / max(1, len(at))
        square_t += g * g
        transition = transition + 0.1 * g / np.sqrt(square_t)
        transition = np.clip(transition, -3, 3)
    return Field(weights, float(bias), transition, np.array([0.0, 1.0, 0.0, 0.0]))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(w)), z.T @ (y - p) - 1e-1 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def lexicon(sample: DataFrame) -> list[int]:
    """Hashes of words and prefixes that label toxic spans: far more contexts in toxic documents.

    A context is the pair of neighbouring tokens and counts once, so copies of a document, and lines
    that many documents share, add nothing.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts, labels in _parts(b):
                t = tokenize(texts)
                y = np.array(labels, dtype=np.int8)
                with np.errstate(over="ignore"):
                    around = np.roll(t.word, 1) * _P + np.roll(t.word, -1)
                stems, at = t.stems.T.ravel().astype(np.int64), np.tile(np.arange(len(t.word)), t.stems.shape[1])
                short = np.repeat(np.arange(t.stems.shape[1]) == 1, len(t.word)).astype(np.int64)
                stems, at, short = stems[stems != 0], at[stems != 0], short[stems != 0]
                rows = np.unique(np.stack([stems, around.astype(np.int64)[at], y[t.doc[at]].astype(np.int64), short]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3])], names=["word", "around", "y", "short"])

    seen = sample.select("text", "y").mapInArrow(contexts, "word long, around long, y long, short long").distinct()
    total = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    ratio = (total[1] or 0) / max(1, total[0] or 0)
    counts = seen.groupBy("word", "short").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("fine"))
    least = F.when(F.col("short") == 1, SHORT_RATIO).otherwise(LEAST_RATIO)
    strong = counts.where((F.col("bad") >= LEAST_CONTEXTS) & (F.col("bad") * ratio > least * (F.col("fine") + 0.5)))
    return [r.word for r in strong.orderBy(F.desc("bad"), "word").limit(20_000).collect()]  # a model size


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most about ``bound`` labelled documents.

    Document labels become token labels through :func:`lexicon`; the field then learns from whole
    words, prefixes, suffixes and neighbours, so it tags inflected and compound forms it never saw.
    """
    sample = labelled_sample(docs, labels, label, bound, id_col, text_col).cache()
    words = np.array(sorted(lexicon(sample)), dtype=np.int64).astype(np.uint64)
    toxic_words = set(words.tolist())

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(toxic_words), dtype=np.uint64)
        for b in batches:
            for texts, labels in _parts(b):
                y = np.array(labels, dtype=np.int64)
                t = tokenize(texts)
                if not len(t.word):
                    continue
                tag = np.isin(t.stems, known).any(axis=1) & (y[t.doc] == 1)
                has = np.zeros(t.chain[-1] + 1, dtype=bool)
                has[t.chain[tag]] = True
                first = np.flatnonzero(np.concatenate([[True], t.chain[1:] != t.chain[:-1]]))
                keys = t.word[first] * _MIX >> np.uint64(40)
                for c in np.flatnonzero(has | ((keys % 16 == 0) & (y[t.doc[first]] == 0))):
                    a = first[c]
                    z = first[c + 1] if c + 1 < len(first) else len(t.word)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t.features[a:z].ravel().tolist()], pa.list_(pa.int32())), pa.array([tag[a:z].astype(np.int8).tolist()], pa.list_(pa.int8())), pa.array([int(keys[c])], pa.int64())],
                        names=["features", "tag", "key"],
                    )

    made = sample.mapInArrow(chains, "features array<int>, tag array<tinyint>, key long").dropDuplicates(["features"])
    rows = made.orderBy(F.desc(F.array_max("tag")), "key", F.xxhash64("features")).limit(FIT_CHAINS).toArrow()
    tags = [np.array(x, dtype=float) for x in rows.column("tag").to_pylist()]
    if not tags:
        sample.unpersist()
        return Field(np.zeros(1 << BITS), -3.0, np.zeros((2, 2)), np.zeros(4))
    width = len(rows.column("features")[0]) // len(tags[0])
    features = rows.column("features").combine_chunks().flatten().to_numpy().reshape(-1, width)
    chain = np.repeat(np.arange(len(tags)), [len(x) for x in tags])
    field = _train(features, chain, np.concatenate(tags))

    found = sample.select("text", F.col("y").alias("key")).mapInArrow(_applied(field), "best double, expected double, share double, key int").toPandas()
    sample.unpersist()
    field.calibration = _logistic(found[["best", "expected", "share"]].to_numpy(), found["key"].to_numpy(dtype=float))
    return field


def _pieces(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[int]]]:
    """Texts and labels of a batch (text, y): all its rows, at most PART_ROWS and about PART_BYTES at a time."""
    for lo in range(0, batch.num_rows, PART_ROWS):
        part = batch.slice(lo, PART_ROWS)
        texts = [x.as_py() or b"" for x in part.column(0)]
        labels = part.column(1).to_pylist()
        for a, b in _pieces(texts, PART_BYTES):
            yield texts[a:b], labels[a:b]


def _applied(field: Field, spans: bool = False):
    """mapInArrow function over (text, key): document figures, and offending byte spans if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = [x.as_py() or b"" for x in part.column(0)]
                for a, b in _pieces(texts):
                    t = tokenize(texts[a:b])
                    odds = field.odds(t)
                    found = field.documents(t, odds, b - a)
                    columns, names = [pa.array(found[:, i]) for i in range(3)], ["best", "expected", "share"]
                    if spans:
                        where: list[list[dict]] = [[] for _ in range(b - a)]
                        for k in np.flatnonzero(odds > 0).tolist():
                            d = t.doc[k]
                            text, base = texts[a + d], t.offsets[d]
                            lead = len(text[: t.start[k] - base].decode("utf-8", "ignore"))
                            size = len(text[t.start[k] - base : t.end[k] - base].decode("utf-8", "ignore"))
                            where[d].append({"start": lead, "end": lead + size, "p": float(1 / (1 + np.exp(-odds[k])))})
                        columns.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
                        names.append("spans")
                    yield pa.RecordBatch.from_arrays([*columns, part.column(1).slice(a, b - a)], names=[*names, "key"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None, **fit_options) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans): one row per row of ``docs``.

    spans: offending tokens as code-point offsets with their marginal probability. Null and empty
    texts have no tokens, no spans, and the score of a text without any toxic evidence. Null labels
    are ignored; with no labelled row every score is 0.5. Other columns are never inputs.
    """
    field = field or fit(docs, labels, id_col=id_col, text_col=text_col, **fit_options)
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("key"))
    found = rows.mapInArrow(_applied(field, spans=True), "best double, expected double, share double, spans array<struct<start:long,end:long,p:double>>, key long")
    w = [float(x) for x in field.calibration]
    score = 1 / (1 + F.exp(-(F.lit(w[0]) + F.lit(w[1]) * F.col("best") + F.lit(w[2]) * F.col("expected") + F.lit(w[3]) * F.col("share"))))
    return found.withColumn("score", score).select(
        F.col("key").alias("doc_id"), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans"
    )
