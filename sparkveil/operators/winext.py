"""Window and aggregate forms that Spark refuses: DISTINCT, EXCLUDE, empty frames, ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: A bucket of ordering keys is so many times as wide as a frame.
WIDE = 64
MODES = ("current row", "group", "ties", "no others")


def count_distinct_over(x: Column, window: WindowSpec) -> Column:
    return F.size(F.array_distinct(F.collect_list(x).over(window))).cast("bigint")


def sum_distinct_over(x: Column, window: WindowSpec, kind: str = "bigint") -> Column:
    values = F.array_distinct(F.collect_list(x).over(window))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v.cast(kind)))


def exclude(x: Column, row: Column, peer: Column, frame: WindowSpec, mode: str, function: str) -> Column:
    """``function`` (sum, count, min, max) of ``x`` over ``frame`` less the excluded rows.

    ``row`` identifies a row, ``peer`` is its ordering key. mode: current row, group, ties, no others.
    Any frame will do, but its rows are collected for every row: see :func:`exclude_range`.
    """
    held = F.collect_list(F.struct(row.alias("r"), peer.alias("p"), x.alias("x"))).over(frame)
    keep = {
        "current row": lambda e: ~e["r"].eqNullSafe(row),
        "group": lambda e: ~e["p"].eqNullSafe(peer),
        "ties": lambda e: ~e["p"].eqNullSafe(peer) | e["r"].eqNullSafe(row),
        "no others": lambda e: F.lit(True),
    }[mode]
    values = F.transform(F.filter(held, lambda e: keep(e) & e["x"].isNotNull()), lambda e: e["x"])
    if function == "count":
        return F.size(values).cast("bigint")
    if function in ("min", "max"):
        return {"min": F.array_min, "max": F.array_max}[function](values)
    if function == "sum":
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v))
    raise ValueError(f"{function} has no form with EXCLUDE")


def exclude_range(df: DataFrame, keys: list[str], peer: str, low: int, high: int, mode: str, calls: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` and, for each of ``calls`` (name: function and column), its value over the frame less the excluded rows.

    The frame is PARTITION BY ``keys`` ORDER BY ``peer`` RANGE BETWEEN ``low`` AND ``high``, as signed
    distances; ``peer`` and what is summed are integers. Rows of equal keys and ``peer`` are aggregated
    first and meet their frame as one row. They are dealt to buckets of ``peer``, and those near its ends
    are listed in the next bucket too, so no task holds a whole partition. What lies before the peers and
    after them is aggregated apart, the peers are added as far as ``mode`` lets them.
    """
    kinds = dict(df.dtypes)
    whole = ("tinyint", "smallint", "int", "bigint")
    if mode not in MODES:
        raise ValueError(f"what EXCLUDE leaves out is one of {MODES}")
    if kinds[peer] not in whole:
        raise ValueError("buckets need an ordering key of integers")
    parts, seconds = {}, {}  # name: how values are merged, the value of one row; name: the runner-up among the peers
    for name, (function, x) in calls.items():
        c = F.col(x)
        if function in ("count", "sum"):
            parts[f"__n_{name}"] = ("sum", F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        if function == "sum":
            if kinds[x] not in whole:
                raise ValueError("a sum with EXCLUDE is of integers")
            # in halves, so that only a result that does not fit overflows
            parts[f"__h_{name}"] = ("sum", F.coalesce(F.shiftright(c.cast("bigint"), 32), F.lit(0).cast("bigint")))
            parts[f"__l_{name}"] = ("sum", F.coalesce(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0).cast("bigint")))
        elif function in ("min", "max"):
            parts[f"__m_{name}"] = (function, c)
            if mode == "current row":
                seconds[f"__2_{name}"] = (f"__m_{name}", function, c.desc_nulls_last() if function == "max" else c.asc_nulls_last())
        elif function != "count":
            raise ValueError(f"{function} has no form with EXCLUDE")
    merge = {"sum": F.sum, "min": F.min, "max": F.max}

    def joined(how: str, pieces: list[Column], kind: str) -> Column:
        if how == "sum":
            return sum((F.coalesce(p, F.lit(0).cast("bigint")) for p in pieces), F.lit(0).cast("bigint"))
        return {"min": F.least, "max": F.greatest}[how](*pieces, *[F.lit(None).cast(kind)] * 2)

    # the peers as one row
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)] + [F.col(peer).cast("bigint").alias("__p")]
    by = [*(f"__k{i}" for i in range(len(keys))), "__p"]
    rows = df.select(*named, *(v.alias(n) for n, (_, v) in parts.items()))
    listed = rows
    for n, (of, _, order) in seconds.items():
        ranked = df.select(*named, parts[of][1].alias(n), F.row_number().over(Window.partitionBy(*keys, peer).orderBy(order)).alias("__i"))
        listed = listed.unionByName(ranked.where("__i = 2").drop("__i"), allowMissingColumns=True)
    merges = {n: how for n, (how, _) in parts.items()} | {n: how for n, (_, how, _) in seconds.items()}
    groups = listed.groupBy(*by).agg(*(merge[how](n).alias(n) for n, how in merges.items()))
    # what lies before and after them
    kind = dict(groups.dtypes)
    ends = [(a, b) for a, b in ((low, min(high, -1)), (max(low, 1), high)) if a <= b]
    back, ahead = min(low, 0), max(high, 0)
    width = WIDE * max(ahead - back, 1)
    near = f"""if(__p is null, array(cast(null as bigint)), sequence(coalesce(try_subtract(__p, {ahead}L), {-(1 << 63) + 1}L) div {width}L,
        coalesce(try_add(__p, {-back}L), {(1 << 63) - 1}L) div {width}L))"""
    dealt = groups.withColumn("__b", F.explode(F.expr(near))).withColumn("__r", F.expr(f"__p - __b * {width}L"))
    windows = [Window.partitionBy(*by[:-1], "__b").orderBy("__r").rangeBetween(a, b) for a, b in ends]
    apart = dealt.withColumns({f"{n}_{i}": merge[how](n).over(w) for n, (how, _) in parts.items() for i, w in enumerate(windows)})
    # a null meets its peers alone
    around = {n: joined(how, [F.when(F.col("__p").isNotNull(), F.col(f"{n}_{i}")) for i in range(len(ends))], kind[n]) for n, (how, _) in parts.items()}
    kept = apart.where(F.expr(f"__b <=> (__p div {width}L)")).select(*by, *(around[n].alias(f"{n}_a") for n in parts), *(merges if mode in ("current row", "no others") else ()))
    # and the rows with both
    same = F.col(peer).eqNullSafe(F.col("__p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.lit(True) if low <= 0 <= high else F.col("__p").isNull()

    def value(n: str) -> Column:
        how, own = parts[n]
        if mode == "group":
            return F.col(f"{n}_a")
        if mode == "ties":
            mine = own
        elif mode == "no others":
            mine = F.col(n)
        else:
            mine = F.col(n) - own if how == "sum" else F.when(own.eqNullSafe(F.col(n)), F.col(f"__2{n[3:]}")).otherwise(F.col(n))
        return joined(how, [F.col(f"{n}_a"), F.when(inside, mine)], kind[n])

    def result(name: str, function: str) -> Column:
        if function in ("min", "max"):
            return value(f"__m_{name}")
        if function == "count":
            return value(f"__n_{name}")
        low_half = value(f"__l_{name}")
        high_half = value(f"__h_{name}") + F.shiftright(low_half, 32)
        return F.when(value(f"__n_{name}") > 0, high_half * F.lit(1 << 32) + low_half.bitwiseAND(F.lit(0xFFFFFFFF)))

    return df.join(kept, same).select(*(F.col(c) for c in df.columns), *(result(n, f).alias(n) for n, (f, _) in calls.items()))


def empty_frame(function: str, kind: str) -> Column:
    """What an aggregate gives over a frame whose bounds are the wrong way round."""
    return F.lit(0).cast("bigint") if function == "count" else F.lit(None).cast(kind)


def array_agg(x: Column, *order: Column) -> Column:
    """ARRAY_AGG ordered by ``order``, then the element; null elements stay."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, x.alias("x")))), lambda e: e["x"])
