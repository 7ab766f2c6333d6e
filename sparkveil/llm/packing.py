"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Permitted sequence lengths.
CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Shares of one length that are ranked apart, so that a common length is no single task.
SALTS = 256


def sequence_cost(capacity: int) -> float:
    """Cost of one sequence: its tokens, attention that grows with the square, and a fixed part."""
    return 128 + capacity + capacity * capacity / 32768


@dataclass
class Run:
    """Items ``rank .. rank + items`` of one length: ``each`` per bin from ``bin``, at ``offset``."""

    length: int
    rank: int
    items: int
    each: int
    bin: int
    offset: int
    capacity: int = 0
    used: int = 0


def best_fit(counts: dict[int, int], open_size: dict[int, int]) -> tuple[list[Run], list[tuple[int, int, int]]]:
    """Best-fit decreasing over a histogram; (runs, [(first bin, bins, used)]).

    Equal bins are kept as one group, so the work depends on the number of distinct lengths, not of
    items. Filling the tightest group bin by bin is what best fit does item by item: a bin that has
    just taken an item of a length is the tightest for the next one of it, while it still fits.
    """
    runs: list[Run] = []
    rooms: list[int] = []  # sorted distinct free rooms
    groups: dict[int, list[tuple[int, int, int]]] = {}  # room -> [(first bin, bins, used)]
    next_bin = 0

    def put(room: int, group: tuple[int, int, int]) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append(group)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, bins, used = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, used, first = open_size[length], 0, next_bin
                bins = max(1, left // (room // length))
                next_bin += bins
            each = min(room // length, left)
            taken = min(bins, left // each)
            if taken < bins:
                put(room, (first + taken, bins - taken, used))
            runs.append(Run(length, rank, taken * each, each, first, used))
            put(room - each * length, (first, taken, used + each * length))
            left -= taken * each
            rank += taken * each
    return runs, sorted(g for gs in groups.values() for g in gs)


def plan(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost=sequence_cost) -> tuple[list[Run], float]:
    """The cheapest of the packings that open the bins of each permitted size, after downsizing.

    A packing for a preferred size opens, for an item that no open bin holds, the size of least cost
    per token among those that hold the item and are no smaller than the preferred one. Each bin is
    then cut down to the smallest permitted size that holds its contents. All permitted sizes are tried
    as preferred ones on the histogram, and the total cost decides (ties: the smaller size).
    """
    sizes = sorted(capacities)
    best: tuple[float, list[Run], list[tuple[int, int, int]]] | None = None
    for preferred in sizes:
        open_size = {n: min((c for c in sizes if c >= n and (c >= preferred or c == sizes[-1])), key=lambda c: (cost(c) / c, c)) for n in counts}
        runs, bins = best_fit(counts, open_size)
        total = sum(k * cost(sizes[bisect_left(sizes, used)]) for _, k, used in bins)
        if best is None or total < best[0]:
            best = (total, runs, bins)
    assert best is not None
    total, runs, bins = best
    starts = [b[0] for b in bins]
    final: list[Run] = []
    for r in runs:  # a run may end in bins that were filled differently later
        at, last = bisect_left(starts, r.bin + 1) - 1, r.bin + r.items // r.each
        while at < len(bins) and bins[at][0] < last:
            first, count, used = bins[at]
            lo, hi = max(first, r.bin), min(first + count, last)
            final.append(Run(r.length, r.rank + (lo - r.bin) * r.each, (hi - lo) * r.each, r.each, lo, r.offset, sizes[bisect_left(sizes, used)], used))
            at += 1
    return final, total


def fragments(docs: DataFrame, length: Column, longest: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fragment, start, length): documents cut to at most ``longest`` tokens, none dropped."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.greatest(length.cast("long"), F.lit(1)).alias("tokens"))
    parts = rows.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / longest).cast("long"))).alias("fragment"))
    return parts.select(
        "doc_id", "fragment", (F.col("fragment") * longest).alias("start"), F.least(F.lit(longest), F.col("tokens") - F.col("fragment") * longest).cast("int").alias("length")
    )


def word_tokens(text_col: str = "text") -> Column:
    """Words between blanks, and one end mark."""
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, cost=sequence_cost, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fragment, start, length, bin_id, bin_offset, capacity, bin_used): every token placed once.

    ``length`` defaults to the words of ``text`` and an end mark, so null and empty texts take one
    place. Longer documents than the largest capacity become fragments. Only the histogram of lengths,
    whose size is at most the largest capacity, reaches the driver; the plan that comes back is as
    small, and each fragment finds its bin from its rank among those of its length. Ranks are counted
    in shares of a length, then shifted by the sums of the shares before. Repeated and null ids are
    items of their own; other columns are ignored; an empty table gives no rows.
    """
    longest = max(capacities)
    parts = cut(fragments(docs, word_tokens() if length is None else length, longest, id_col), "fragments")
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacities, cost)
    ordered = sorted(runs, key=lambda r: (r.length, r.rank))
    table = parts.sparkSession.sparkContext.broadcast(
        {
            "key": np.array([(r.length << 44) + r.rank for r in ordered], dtype=np.int64),
            **{f: np.array([getattr(r, f) for r in ordered], dtype=np.int64) for f in ("rank", "each", "bin", "offset", "capacity", "used")},
        }
    )
    salted = parts.withColumn("share", F.pmod(F.xxhash64("doc_id", "fragment"), F.lit(SALTS)).cast("int"))
    cells = salted.groupBy("length", "share").count()
    before = F.coalesce(F.expr("sum(count) over (partition by length order by share rows between unbounded preceding and 1 preceding)"), F.lit(0))
    ranked = salted.withColumn("place", F.expr("row_number() over (partition by length, share order by doc_id, fragment)"))
    ranked = ranked.join(cells.select("length", "share", before.alias("before")), ["length", "share"])
    rows = ranked.select("doc_id", "fragment", "start", "length", (F.col("before") + F.col("place") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        for b in batches:
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            at = np.searchsorted(runs["key"], (length << 44) + rank, side="right") - 1
            within = rank - runs["rank"][at]
            bins = runs["bin"][at] + within // runs["each"][at]
            offset = runs["offset"][at] + within % runs["each"][at] * length
            more = [pa.array(x) for x in (bins, offset, runs["capacity"][at], runs["used"][at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *more], names=[*b.schema.names[:4], "bin_id", "bin_offset", "capacity", "bin_used"])

    added = [T.StructField(c, T.LongType()) for c in ("bin_id", "bin_offset", "capacity", "bin_used")]
    return rows.mapInArrow(place, T.StructType([*rows.schema.fields[:4], *added]))
