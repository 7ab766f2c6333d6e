"""A source over an embedded SQL database, read in Arrow batches; filters go into its statement."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual


def _literal(v: object) -> str | None:
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, int | float):
        return repr(v)
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else None


class EmbeddedReader(DataSourceReader):
    OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}

    def __init__(self, query: str, schema):
        self.query, self.schema, self.conditions = query, schema, []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            column = '"' + ".".join(f.attribute).replace('"', '""') + '"' if hasattr(f, "attribute") else None
            if type(f) in self.OPS and column and (v := _literal(f.value)) is not None:
                self.conditions.append(f"{column} {self.OPS[type(f)]} {v}")
            elif isinstance(f, In) and column and f.value and all(_literal(v) is not None for v in f.value):
                self.conditions.append(f"{column} IN ({', '.join(_literal(v) for v in f.value)})")
            else:
                yield f

    def read(self, partition) -> Iterator:
        import duckdb

        where = f" WHERE {' AND '.join(self.conditions)}" if self.conditions else ""
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        found = duckdb.connect().execute(f"SELECT {names} FROM ({self.query}) q{where}")
        yield from found.to_arrow_reader(10_000) if hasattr(found, "to_arrow_reader") else found.fetch_record_batch(10_000)


class EmbeddedSource(DataSource):
    """``spark.read.format("embedded").schema(...).option("query", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "embedded"

    def reader(self, schema):
        return EmbeddedReader(self.options["query"], schema)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EmbeddedSource)
