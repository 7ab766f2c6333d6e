"""The engine's public surface: prepare, execute, explain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import Refused
from ..functions.udf import Functions
from ..sources.adopt import adopt
from ..streaming.views import Epochs, StandingView
from . import sqlfront, timeforms


def configure(spark: SparkSession) -> SparkSession:
    """Session settings that the semantics rest on."""
    for k, v in {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        "spark.sql.timestampType": "TIMESTAMP_NTZ", "spark.sql.adaptive.enabled": "true", "spark.sql.runSQLOnFiles": "false", "spark.sql.timeType.enabled": "true",
    }.items():
        spark.conf.set(k, v)
    return spark


@dataclass
class Prepared:
    engine: Engine
    sql: str

    def dataframe(self, params: object = None) -> DataFrame:
        text = self.engine.functions.expand(self.sql)
        if any(t.word == "ASOF" for t in sqlfront.tokens(text)):
            bound = sqlfront.text_of(sqlfront.bind(sqlfront.tokens(text), params))
            text, params = timeforms.asof_views(self.engine.spark, bound, self.engine.query), None
        return self.engine.spark.sql(sqlfront.rewrite(timeforms.rewrite_forms(text), params))

    def schema(self, params: object = None) -> StructType:
        return self.dataframe(params).schema

    def explain(self, params: object = None) -> str:
        return self.dataframe(params)._jdf.queryExecution().explainString(self.engine.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def redacted(self, key: str) -> str:
        return sqlfront.redact(self.sql, key)


class Engine:
    """Tables by name over one isolated session; statements are read-only and planned lazily."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Callable[[SparkSession], DataFrame]]):
        self.spark = configure(spark.newSession())
        self.functions = Functions(self.spark)
        self.tables = dict(tables)
        for name, source in tables.items():
            df = source(self.spark) if callable(source) else source
            adopt(self.spark, df).createOrReplaceTempView(name)

    def bind(self, name: str, rows: list[tuple], schema: str, most: int = 10_000) -> None:
        """A relation bound for statements of this engine: few rows, sent along with the plan."""
        if len(rows) > most:
            raise Refused(f"{name}: a bound relation has at most {most} rows; store a table instead")
        bound = F.broadcast(self.spark.createDataFrame(rows, schema))
        bound.createOrReplaceTempView(name)
        self.tables[name] = bound

    def materialize(self, epochs: Epochs, sql: str, key: list[str], params: object = None) -> StandingView:
        """A standing view of a statement over the tables of ``epochs``.

        An unordered LIMIT has no stable answer and is refused.
        """
        words = [t.word for t in sqlfront.tokens(sql)]
        if ("LIMIT" in words or "FETCH" in words) and "ORDER" not in words:
            raise Refused("a standing view needs an order under LIMIT")
        used = [t for t in epochs.parts if t.upper() in words]
        return StandingView(epochs, lambda tables: Engine(self.spark, tables).query(sql, params), used, key)

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def query(self, sql: str, params: object = None) -> DataFrame:
        return self.prepare(sql).dataframe(params)
