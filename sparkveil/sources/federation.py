"""Sources with declared capabilities, joins across them, and partitioned tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Guardrail, Refused


@dataclass(frozen=True)
class Capabilities:
    """What a source takes over; what it does not name stays in Spark."""

    predicates: frozenset[str] = frozenset({"=", "<", "<=", ">", ">=", "in"})
    functions: frozenset[str] = frozenset()
    aggregates: frozenset[str] = frozenset()
    sort: bool = False
    limit: bool = False
    in_size: int = 1000


@dataclass
class Source:
    """``scan`` (column -> values to look up, or None) gives rows; ``zone`` is where they may be joined."""

    name: str
    scan: Callable[[dict[str, list] | None], DataFrame]
    capabilities: Capabilities = field(default_factory=Capabilities)
    zone: str = "default"


@dataclass(frozen=True)
class JoinPolicy:
    """Limits of a join across sources; ``strategy``: auto, lookup, broadcast or local."""

    strategy: str = "auto"
    lookup_keys: int = 1000
    broadcast_rows: int = 100_000
    local_rows: int | None = None


def check_zones(sources: list[Source]) -> None:
    if len({s.zone for s in sources}) > 1:
        raise Refused("sources of different zones are in one catalog")


def federated_join(left: DataFrame, source: Source, on: str, policy: JoinPolicy = JoinPolicy(), how: str = "inner") -> DataFrame:
    """Join rows with a source.

    auto: at most ``lookup_keys`` distinct keys (counted with a limit, so the check is cheap) are sent to
    the source as an IN list; beyond that the side joins locally, broadcast only if a bounded count
    shows that it is small.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise Refused(f"{how} is not a join with a looked-up side")
    if policy.strategy in ("auto", "lookup"):
        most = min(policy.lookup_keys, source.capabilities.in_size)
        keys = [r[0] for r in left.select(on).where(F.col(on).isNotNull()).distinct().limit(most + 1).collect()]
        if len(keys) <= most and "in" in source.capabilities.predicates:
            return left.join(source.scan({on: keys}), on, how)
        if policy.strategy == "lookup":
            raise Guardrail(f"{source.name}: more than {most} keys to look up")
    right = source.scan(None)
    if policy.strategy != "local":
        n = right.limit(policy.broadcast_rows + 1).count()
        if n <= policy.broadcast_rows:
            return left.join(F.broadcast(right), on, how)
        if policy.strategy == "broadcast":
            raise Guardrail(f"{source.name}: more than {policy.broadcast_rows} rows to broadcast")
    if policy.local_rows is not None and right.limit(policy.local_rows + 1).count() > policy.local_rows:
        raise Guardrail(f"{source.name}: more than {policy.local_rows} rows to join locally")
    return left.join(right, on, how)


@dataclass
class PartitionedTable:
    """A table whose rows of each value of ``column`` come from their own source."""

    column: str
    parts: dict[object, Callable[[], DataFrame]]

    def scan(self, values: list | None = None) -> DataFrame:
        """The union of the partitions that ``values`` may lie in; the others are never opened."""
        chosen = [v for v in self.parts if values is None or v in values]
        if not chosen:
            first = next(iter(self.parts.values()))()
            return first.where(F.lit(False))
        out = None
        for v in chosen:
            df = self.parts[v]()
            out = df if out is None else out.unionByName(df)
        return out


def parquet_source(name: str, read: Callable[[], DataFrame], capabilities: Capabilities | None = None) -> Source:
    """A parquet table: looked-up keys become a filter that reaches the scan."""

    def scan(lookup: dict[str, list] | None) -> DataFrame:
        df = read()
        condition: Column | None = None
        for column, keys in (lookup or {}).items():
            here = F.col(column).isin(keys) if keys else F.lit(False)
            condition = here if condition is None else condition & here
        return df if condition is None else df.where(condition)

    return Source(name, scan, capabilities or Capabilities())
