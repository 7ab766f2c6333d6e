"""UNNEST as a join of each row with the elements of its list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, column: str, name: str, ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """One row per element in order; ``outer`` keeps rows of null and empty lists with nulls."""
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select("*", explode(column).alias("__pos", name))
    return rows.withColumn(ordinality, (F.col("__pos") + 1).cast("int")).drop("__pos") if ordinality else rows.drop("__pos")
