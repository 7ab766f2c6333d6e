"""Range joins by buckets: an equi-join on bucket numbers with the range as a residual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``low <= point <= high``. Ranges are listed under every bucket of ``width`` they touch.

    A plain range condition has no key and compares all pairs; buckets give the join a key. Each
    point lies in one bucket, so a pair is found once.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    listed = ranges.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("__b", bucket(point)).join(listed, ["__b", *(on or [])]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")
