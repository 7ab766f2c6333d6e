"""Column functions whose semantics Spark spells differently or lacks."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}


def micros(size: str) -> int:
    """'15 minutes' to microseconds; only units of fixed length."""
    total = 0
    words = size.split()
    for n, unit in zip(words[::2], words[1::2], strict=True):
        total += int(n) * UNITS[unit.lower().rstrip("s")]
    if total <= 0:
        raise ValueError(f"a window size must be positive: {size!r}")
    return total


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(u: Column) -> Column:
    return F.timestamp_micros(u).cast("timestamp_ntz")


def time_bucket(size: str, ts: Column, origin: Column | None = None) -> Column:
    """Start of the bucket that holds ``ts``, floored from ``origin`` (1970 by default); UTC session."""
    shift = to_micros(origin) if origin is not None else F.lit(0)
    u = to_micros(ts) - shift
    return from_micros(u - F.pmod(u, F.lit(micros(size))) + shift)


def present(v: Column) -> Column:
    """Neither null nor the empty string; never null."""
    return F.coalesce(v.cast("string") != "", F.lit(False))


def int_div(a: Column, b: Column, kind: str = "bigint") -> Column:
    """Integer division that keeps the operand type and truncates toward zero; division by zero raises."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint")).cast(kind)


def float_div(a: Column, b: Column) -> Column:
    """Division of doubles by the floating-point standard: by zero it is infinite or not a number."""
    a, b = a.cast("double"), b.cast("double")
    odd = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, odd).otherwise(F.try_divide(a, b))


def sql_substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """SUBSTRING by the SQL rule: positions before the first count, but hold nothing."""
    first = F.greatest(start, F.lit(1))
    if length is None:
        return F.substr(s, first)
    size = F.greatest(start + length - first, F.lit(0))
    return F.when(s.isNull() | start.isNull() | length.isNull(), F.lit(None)).otherwise(F.substr(s, first, size))


def item(values: Column, index: Column) -> Column:
    """1-based element; null outside the list, also for zero and negative indexes."""
    return F.when(index >= 1, F.try_element_at(values, index.cast("int")))


def floor_to(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ceil_to(unit: str, ts: Column) -> Column:
    """The start of the next unit unless ``ts`` is the start of one."""
    low = floor_to(unit, ts)
    step = {"quarter": "3 month"}.get(unit.lower(), f"1 {unit}")
    return F.when(low == ts, low).otherwise(low + F.expr(f"interval {step}"))


def fingerprint(value: Column, key: str) -> Column:
    """HMAC-SHA-256 of the text under ``key``: the first 16 bytes in hex; null for null."""
    secret = key.encode()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else hmac.new(secret, v.encode(), hashlib.sha256).digest()[:16].hex())

    return run(value.cast("string"))
