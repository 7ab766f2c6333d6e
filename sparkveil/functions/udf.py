"""User functions: SQL bodies, aggregate and table macros, Python bodies, and their registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FunctionError(ValueError):
    code = "FUNCTION"


@dataclass(frozen=True)
class FunctionSpec:
    """A declared function. ``kind``: sql, aggregate_macro, table_macro, scalar, vector, aggregate, table."""

    name: str
    kind: str
    body: object
    parameters: tuple[tuple[str, str], ...] = ()
    returns: str = ""
    strict: bool = True
    volatility: str = "immutable"
    leakproof: bool = False
    defaults: dict[str, str] = field(default_factory=dict)


class Functions:
    """Registry of one session. Names that Spark already has are refused, as are repeats."""

    def __init__(self, spark: SparkSession):
        self.spark, self.specs = spark, {}

    def register(self, spec: FunctionSpec) -> None:
        if spec.name.lower() in self.specs or self.spark.catalog.functionExists(spec.name):
            raise FunctionError(f"the name {spec.name} is taken")
        getattr(self, f"_{spec.kind}")(spec)
        self.specs[spec.name.lower()] = spec

    def _signature(self, spec: FunctionSpec) -> str:
        return ", ".join(f"{n} {t}" + (f" DEFAULT {spec.defaults[n]}" if n in spec.defaults else "") for n, t in spec.parameters)

    def _sql(self, spec: FunctionSpec) -> None:
        self.spark.sql(f"CREATE TEMPORARY FUNCTION {spec.name}({self._signature(spec)}) RETURNS {spec.returns} RETURN {spec.body}")

    def _table_macro(self, spec: FunctionSpec) -> None:
        self.spark.sql(f"CREATE TEMPORARY FUNCTION {spec.name}({self._signature(spec)}) RETURNS TABLE ({spec.returns}) RETURN {spec.body}")

    def _aggregate_macro(self, spec: FunctionSpec) -> None:
        """Expanded into the statement by :meth:`expand`; nothing to tell Spark."""

    def _scalar(self, spec: FunctionSpec) -> None:
        body: Callable = spec.body
        call = (lambda *a: None if any(x is None for x in a) else body(*a)) if spec.strict else body
        made = F.udf(call, spec.returns, useArrow=True)
        self.spark.udf.register(spec.name, made.asNondeterministic() if spec.volatility == "volatile" else made)

    def _vector(self, spec: FunctionSpec) -> None:
        made = F.pandas_udf(spec.body, spec.returns)
        self.spark.udf.register(spec.name, made.asNondeterministic() if spec.volatility == "volatile" else made)

    _aggregate = _vector

    def _table(self, spec: FunctionSpec) -> None:
        self.spark.udtf.register(spec.name, F.udtf(spec.body, returnType=spec.returns))

    def expand(self, sql: str) -> str:
        """Put the bodies of aggregate macros in place of their calls."""
        for spec in self.specs.values():
            if spec.kind != "aggregate_macro":
                continue
            while m := re.search(rf"(?i)\b{spec.name}\s*\(", sql):
                depth, at, parts, start = 1, m.end(), [], m.end()
                while depth:
                    if at >= len(sql):
                        raise FunctionError(f"unclosed call of {spec.name}")
                    c = sql[at]
                    depth += (c == "(") - (c == ")")
                    if (c == "," and depth == 1) or depth == 0:
                        parts.append(sql[start:at].strip())
                        start = at + 1
                    at += 1
                if len(parts) != len(spec.parameters):
                    raise FunctionError(f"{spec.name} takes {len(spec.parameters)} arguments")
                body = str(spec.body)
                given = {n: f"({p})" for (n, _), p in zip(spec.parameters, parts, strict=True)}
                body = re.sub(r"\b(" + "|".join(given) + r")\b", lambda k: given[k[0]], body)
                sql = f"{sql[: m.start()]}({body}){sql[at:]}"
        return sql


def weighted_average(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.sum(w)


def series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """A table function with constant arguments: start to stop inclusive."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")
