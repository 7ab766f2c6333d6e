"""As-of joins: for each left row the closest right row by time, within equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATORS = (">=", ">", "<=", "<")


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, op: str = ">=", on: list[str] | None = None, tie: str | None = None, how: str = "left", prefix: str = "") -> DataFrame:
    """Join each left row to the right row whose time is closest with ``left_time op right_time``.

    Both sides are shuffled once by key and sorted once by time: a window carries the last right row
    along, so no pair of rows is ever compared. Without keys there is one sequence, as the semantics
    demand. Right rows of equal key and time are reduced first to the one with the smallest ``tie``.
    Null keys and times never match. ``how``: left keeps unmatched rows, inner drops them.
    """
    if op not in OPERATORS:
        raise ValueError(f"an as-of comparison is one of {OPERATORS}")
    if how not in ("left", "inner"):
        raise ValueError("an as-of join is inner or left")
    keys = list(on or [])
    payload = F.struct(*(F.col(c).alias(c) for c in right.columns))
    order = F.col(tie) if tie else F.xxhash64(*right.columns)
    usable = F.col(right_time).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    lone = right.where(usable).groupBy(*keys, F.col(right_time).alias("__t")).agg(F.min_by(payload, order).alias("__p"))
    row = F.struct(*(F.col(c).alias(c) for c in left.columns))
    names = [f"__k{i}" for i in range(len(keys))]
    a = left.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), row.alias("__l"), F.lit(None).cast(lone.schema["__p"].dataType).alias("__p"))
    b = lone.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "__t", F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), "__p")
    direction = "asc" if op in (">=", ">") else "desc"
    side = "asc" if op in (">=", "<=") else "desc"
    by = f"partition by {', '.join(names)} " if names else ""
    last = F.expr(f"last(__p, true) over ({by}order by __t {direction} nulls first, __side {side} rows between unbounded preceding and current row)")
    matched = a.union(b).withColumn("__m", last).where("__side = 1")
    ok = F.col("__t").isNotNull()
    for n in names:
        ok = ok & F.col(n).isNotNull()
    matched = matched.withColumn("__m", F.when(ok, F.col("__m")))
    if how == "inner":
        matched = matched.where(F.col("__m").isNotNull())
    taken = set(left.columns)
    extra = [F.col(f"__m.{c}").alias(f"{prefix}{c}") for c in right.columns if prefix or c not in taken]
    return matched.select(*(F.col(f"__l.{c}").alias(c) for c in left.columns), *extra)
