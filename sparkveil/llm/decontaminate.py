"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of window text that one broadcast may hold; a larger benchmark is searched in blocks.
BLOCK_BYTES = 32 << 20
#: Normalised text is searched in pieces of about this size.
PIECE_BYTES = 4 << 20
#: Lower bounds of the pattern-length classes; each class has tables of its own.
CLASSES = (3, 8, 24)

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return (text or b"").translate(_WORD).split()


def windows_of(words: list[bytes], width: int) -> Iterator[bytes]:
    """Each run of ``width`` words with one blank on both sides; fewer words are one window."""
    for i in range(max(1, len(words) - width + 1) if words else 0):
        yield b" " + b" ".join(words[i : i + width]) + b" "


class _Tables:
    """Shift table, suffix buckets and prefix lists for the patterns of one length class."""

    BITS = 18

    def __init__(self, patterns: list[bytes]):
        self.least = m = min(map(len, patterns))
        self.block = b = min(8, max(2, m // 2))
        self.mask = np.uint64((1 << 8 * b) - 1)
        heads = sorted({p[:m] for p in patterns})
        chars = np.frombuffer(b"".join(heads), dtype=np.uint8).reshape(-1, m).astype(np.uint64)
        self.shift = np.full(1 << self.BITS, m - b + 1, dtype=np.int64)
        for end in range(b, m + 1):
            value = np.zeros(len(heads), dtype=np.uint64)
            for k in range(b):
                value |= chars[:, end - b + k] << np.uint64(8 * k)
            np.minimum.at(self.shift, self._slot(value), m - end)
        self.bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            self.bucket.setdefault(p[:m], []).append(p)

    def _slot(self, value: np.ndarray) -> np.ndarray:
        return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def candidates(self, text: bytes) -> np.ndarray:
        """Ends of the places where the shift table rules nothing out.

        Many lanes walk the text at once, each over its own stretch of window ends, and every lane
        jumps as far as its last block allows.
        """
        n, m, b = len(text), self.least, self.block
        if n < m:
            return np.empty(0, dtype=np.int64)
        blocks = np.ndarray(shape=(n + 1 - b,), dtype="<u8", buffer=text + bytes(8), strides=(1,))
        stretch = 2048
        at = np.arange(m - 1, n, stretch, dtype=np.int64)
        end = np.minimum(at + stretch, n)
        found = []
        while len(at):
            step = self.shift[self._slot(blocks[at - (b - 1)] & self.mask)]
            stop = step == 0
            if stop.any():
                found.append(at[stop])
                step[stop] = 1
            at = at + step
            open_ = at < end
            if not open_.all():
                at, end = at[open_], end[open_]
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        m = self.least
        for last in self.candidates(text).tolist():
            start = last - m + 1
            for pattern in self.bucket.get(text[start : last + 1], ()):
                if text.startswith(pattern, start):
                    yield start, pattern


def _build(patterns: Iterable[bytes]) -> list[_Tables]:
    by_class: dict[int, list[bytes]] = {}
    for p in patterns:
        by_class.setdefault(max(c for c in CLASSES if c <= len(p)), []).append(p)
    return [_Tables(ps) for ps in by_class.values()]


#: The last patterns that this worker met, and their tables; the patterns are held, so none can take their place.
_built: list[tuple[object, list[_Tables]]] = []


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted, disjoint word ranges as start, end, start, end ..."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(tables: list[_Tables], owners: dict[bytes, list[str]], texts: list[list[bytes]]) -> dict[int, tuple[list, set]]:
    """Which documents of a piece hold windows: word ranges and items, by place in ``texts``."""
    parts = [b" " + b" ".join(w) + b" " for w in texts]
    starts = np.cumsum([0] + [len(p) for p in parts])
    whole = b"".join(parts)
    found: dict[int, tuple[list, set]] = {}
    blanks: dict[int, np.ndarray] = {}
    for table in tables:
        for start, pattern in table.occurrences(whole):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            if k not in blanks:
                blanks[k] = np.flatnonzero(np.frombuffer(parts[k], dtype=np.uint8) == 32)
            first = int(np.searchsorted(blanks[k], start - starts[k]))
            spans, items = found.setdefault(k, ([], set()))
            spans.append((first, first + pattern.count(b" ") - 1))
            items.update(owners[pattern])
    return found


def _pieces(texts: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, words in enumerate(texts):
        size += sum(map(len, words)) + len(words) + 1
        if size >= PIECE_BYTES:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _block_pass(rows: DataFrame, patterns) -> DataFrame:
    """Add one block's word ranges and items to ``rows`` (key, text, n_words, spans, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = patterns.value
        if not _built or _built[0][0] is not owners:
            _built[:] = [(owners, _build(owners))]
        tables = _built[0][1]
        for batch in batches:
            spans, items = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            counts: list[int] = []
            text = batch.column(1)
            for lo in range(0, len(text), 512):
                texts = [words_of(t.as_py()) for t in text[lo : lo + 512]]
                counts += map(len, texts)
                for a, b in _pieces(texts):
                    for k, (more, who) in _search(tables, owners, texts[a:b]).items():
                        at = lo + a + k
                        old = spans[at]
                        spans[at] = _merge(more + list(zip(old[::2], old[1::2], strict=True)))
                        items[at] = sorted(who | set(items[at]))
            found = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *found], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _scan(docs: DataFrame, key: Column, text_col: str, benchmark: DataFrame, width: int, item_col: str, item_text: str, block_bytes: int) -> DataFrame:
    """(key, text binary, n_words, spans, items) for every row, read once and never shuffled."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total * width // block_bytes))
    empty = {"n_words": "0L", "spans": "cast(array() as array<bigint>)", "items": "cast(array() as array<string>)"}
    rows = docs.select(key.alias("key"), F.col(text_col).cast("binary").alias("text"), *(F.expr(x).alias(c) for c, x in empty.items()))
    for k in range(blocks):
        owners: dict[bytes, list[str]] = {}
        for item, text in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect():
            for window in windows_of(words_of(bytes(text)), width):
                have = owners.setdefault(window, [])
                if item is not None and item not in have:
                    have.append(item)
        rows = _block_pass(rows, spark.sparkContext.broadcast(owners))
    return rows


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items): one row per row of ``docs``.

    spans: disjoint ranges of hit words, flat (start, end, start, end ...). Every whole text is
    searched where it is read: no shuffle. The windows of the benchmark are broadcast in blocks of at
    most about ``block_bytes``, one pass over the documents for each block, so no size of benchmark
    overruns a worker. Texts without words (null, empty) have zeros; items without words make no
    window; an item without an id marks words but is not listed; repeated items count once by id;
    an empty benchmark hits nothing; other columns are ignored, whatever their names.
    """
    found = _scan(docs, F.col(id_col).cast("long"), text_col, benchmark, width, item_col, item_text, block_bytes)
    ends = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return found.withColumn("n_hit", F.aggregate(ends, F.lit(0).cast("long"), lambda acc, x: acc + x)).select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans", "items",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any benchmark window, with their columns: one pass, no shuffle.

    Rows are never joined back by id, so repeated and null ids keep to themselves.
    """
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col), F.lit(0).alias("__row"))
    found = _scan(docs, others, text_col, benchmark, width, item_col, item_text, BLOCK_BYTES).where(F.size("spans") == 0)
    return found.select(*(F.col("text").cast("string").alias(c) if c == text_col else F.col("key").getField(c).alias(c) for c in docs.columns))
