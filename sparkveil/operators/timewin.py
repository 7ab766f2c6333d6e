"""Time-window table functions: tumbling, hopping and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import from_micros, micros, time_bucket, to_micros


def tumble(df: DataFrame, time: str, size: str) -> DataFrame:
    """Every row with the window that holds it: ``window_start`` and ``window_end``."""
    start = time_bucket(size, F.col(time))
    return df.withColumn("window_start", start).withColumn("window_end", from_micros(to_micros(F.col("window_start")) + micros(size)))


def hop(df: DataFrame, time: str, slide: str, size: str) -> DataFrame:
    """A row for each window of ``size`` that holds it; windows start at multiples of ``slide``.

    Rows without a time drop; with a size under the slide, rows between windows drop too. The windows
    are generated inside the row, so nothing is shuffled.
    """
    s, w = micros(slide), micros(size)
    u = to_micros(F.col(time))
    top = u - F.pmod(u, F.lit(s))
    starts = F.filter(F.sequence(top - (w // s + 1) * s, top, F.lit(s)), lambda x: x > u - w)
    rows = df.where(F.col(time).isNotNull()).withColumn("__s", F.explode(starts))
    return rows.withColumn("window_start", from_micros(F.col("__s"))).withColumn("window_end", from_micros(F.col("__s") + w)).drop("__s")


def session(df: DataFrame, time: str, gap: str, keys: list[str]) -> DataFrame:
    """Every row with its session's bounds: a row at least ``gap`` after the last one opens another.

    Rows without a time keep null bounds.
    """
    g = micros(gap)
    by = ", ".join(keys)
    part = f"partition by {by}" if keys else ""
    rows = df.withColumn("__u", to_micros(F.col(time)))
    timed = rows.where("__u is not null")
    opens = F.expr(f"case when __u - lag(__u) over ({part} order by __u) < {g} then 0 else 1 end")
    numbered = timed.withColumn("__new", opens).withColumn("__id", F.expr(f"sum(__new) over ({part} order by __u rows between unbounded preceding and current row)"))
    each = f"partition by {by + ', ' if keys else ''}__id"
    bounded = numbered.withColumn("window_start", from_micros(F.expr(f"min(__u) over ({each})"))).withColumn("window_end", from_micros(F.expr(f"max(__u) over ({each})") + g))
    none = rows.where("__u is null").withColumn("window_start", F.lit(None).cast("timestamp_ntz")).withColumn("window_end", F.lit(None).cast("timestamp_ntz"))
    cols = [*df.columns, "window_start", "window_end"]
    return bounded.select(*cols).union(none.select(*cols))


def check_lateness(df: DataFrame, time: str, frontier, lateness: str) -> None:
    """Refuse a whole refresh that holds a row later than the frontier allows."""
    first = df.agg(F.min(to_micros(F.col(time)))).first()[0]
    if frontier is not None and first is not None and first < frontier - micros(lateness):
        raise ValueError("LATE_ROW: a row lies before the frontier less the lateness; nothing was published")
