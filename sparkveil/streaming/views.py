"""Epochs of versioned tables, and standing views over them that stay current by changes."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import LateRow, Refused
from ..functions.scalar import micros, to_micros

Statement = Callable[[dict[str, DataFrame]], DataFrame]


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared one; a temporary folder only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise Refused("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkveil-views-")
    return f"{base.rstrip('/')}/sparkveil-views/{uuid.uuid4().hex}"


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi and anti joins by keys among which null equals null."""
    names = [f"__m{i}" for i in range(len(keys))]
    theirs = right.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & left[k].eqNullSafe(theirs[n])
    return left.join(theirs, same, how)


class Epochs:
    """Tables that change together: one refresh publishes all its changes as one version, or none.

    Each version of a table is a list of parquet parts; an append adds one and rewrites nothing. A
    manifest in the folder, replaced in one step, names the parts of the latest version and the
    batches of streams that are in it, so that a restarted driver goes on where the last one was
    (:meth:`open`) and a batch that is delivered twice is published once.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or _folder(spark)
        self.version = 0
        self.parts: dict[str, list[tuple[int, str]]] = {}
        self.keys: dict[str, list[str]] = {}
        self.frontier: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Epochs:
        """The tables that the latest manifest of ``folder`` names."""
        found = cls(spark, folder)
        names = [s.getPath().getName() for s in found._files().listStatus(found._path())]
        latest = max((n for n in names if n.startswith("manifest-")), default=None)
        if latest is None:
            raise Refused("the folder holds no manifest")
        stream = found._files().open(found._path(latest))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        state = json.loads(text)
        found.version, found.keys, found.frontier, found.batches = (state[k] for k in ("version", "keys", "frontier", "batches"))
        found.parts = {t: [(v, p) for v, p in parts] for t, parts in state["parts"].items()}
        return found

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _store(self, version: int, parts: dict, frontier: dict, batches: dict) -> None:
        """Write the manifest under another name and rename it: it is there whole or not at all."""
        name, files = f"manifest-{version:012d}.json", self._files()
        out = files.create(self._path(f"{name}.part"), True)
        try:
            out.write(json.dumps({"version": version, "parts": parts, "keys": self.keys, "frontier": frontier, "batches": batches}).encode())
        finally:
            out.close()
        files.delete(self._path(name), False)
        files.rename(self._path(f"{name}.part"), self._path(name))

    def _write(self, df: DataFrame) -> str:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def declare(self, table: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        self.parts[table] = [(self.version, self._write(rows))]
        self.keys[table] = list(keys or [])
        self._store(self.version, self.parts, self.frontier, self.batches)

    def read(self, table: str, since: int | None = None) -> DataFrame:
        paths = [p for v, p in self.parts[table] if since is None or v > since]
        schema = self.spark.read.parquet(self.parts[table][0][1]).schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def refresh(
        self, append: dict[str, DataFrame] | None = None, upsert: dict[str, DataFrame] | None = None, delete: dict[str, DataFrame] | None = None,
        replace: dict[str, DataFrame] | None = None, time: dict[str, tuple[str, str]] | None = None, batch: tuple[str, int] | None = None,
    ) -> int:
        """Publish one epoch. ``time``: table -> (column, lateness); a late row refuses the whole epoch.

        ``batch``: name of a stream and number of its batch; one that was published before is passed over.
        """
        if batch is not None and self.batches.get(batch[0], -1) >= batch[1]:
            return self.version
        frontier = dict(self.frontier)
        for table, (column, lateness) in (time or {}).items():
            low, high = (append or {})[table].agg(F.min(to_micros(F.col(column))), F.max(to_micros(F.col(column)))).first()
            if low is not None and table in frontier and low < frontier[table] - micros(lateness):
                raise LateRow(f"{table}: a row lies before the frontier less the lateness; nothing was published")
            if high is not None:
                frontier[table] = max(high, frontier.get(table, high))
        following = self.version + 1
        planned: dict[str, list[tuple[int, str]]] = {}
        for table, df in (append or {}).items():
            planned[table] = [*self.parts[table], (following, self._write(df))]
        for table, df in (replace or {}).items():
            planned[table] = [(following, self._write(df))]
        for table in {**(upsert or {}), **(delete or {})}:
            keys = self.keys[table]
            if not keys:
                raise Refused(f"{table} has no key to change rows by")
            rows = self.read(table)
            for change in (upsert or {}).get(table), (delete or {}).get(table):
                if change is not None:
                    rows = _match(rows, change, keys, "left_anti")
            if (new := (upsert or {}).get(table)) is not None:
                rows = rows.unionByName(new)
            planned[table] = [(following, self._write(rows))]
        batches = {**self.batches, batch[0]: batch[1]} if batch is not None else self.batches
        self._store(following, self.parts | planned, frontier, batches)
        self.parts |= planned  # the epoch becomes visible here, for all its tables at once
        self.version, self.frontier, self.batches = following, frontier, batches
        return following


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Change rows that turn ``before`` into ``after``: op (upsert, delete) and the latest row per key."""
    cols = after.columns
    b = before.select(*(F.col(k).alias(f"__b_{k}") for k in key), F.struct(*cols).alias("__before"))
    a = after.select(*(F.col(k).alias(f"__a_{k}") for k in key), F.struct(*cols).alias("__after"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"__b_{k}").eqNullSafe(F.col(f"__a_{k}"))
    both = b.join(a, same, "full")
    changed = both.where(~F.col("__before").eqNullSafe(F.col("__after")))
    pick = lambda c: F.when(F.col("__after").isNotNull(), F.col(f"__after.{c}")).otherwise(F.col(f"__before.{c}") if c in key else F.lit(None))
    return changed.select(F.when(F.col("__after").isNull(), "delete").otherwise("upsert").alias("op"), *(pick(c).alias(c) for c in cols))


class StandingView:
    """A statement's answer, one row per key, kept current over epochs by recomputing and diffing."""

    def __init__(self, epochs: Epochs, statement: Statement, tables: list[str], key: list[str]):
        self.epochs, self.statement, self.tables, self.key = epochs, statement, tables, key
        self.version = epochs.version
        self.answer = epochs.spark.read.parquet(epochs._write(statement(self._inputs())))
        self.log: list[tuple[int, DataFrame]] = []

    def _inputs(self) -> dict[str, DataFrame]:
        return {t: self.epochs.read(t) for t in self.tables}

    def _advance(self) -> DataFrame:
        return self.statement(self._inputs())

    def update(self) -> int:
        """Catch up with the latest epoch; unchanged inputs move the version and compute nothing."""
        if self.version == self.epochs.version:
            return self.version
        if any(v > self.version for t in self.tables for v, _ in self.epochs.parts[t]):
            spark = self.epochs.spark
            following = spark.read.parquet(self.epochs._write(self._advance()))
            changes = spark.read.parquet(self.epochs._write(diff(self.answer, following, self.key)))
            self.log.append((self.epochs.version, changes))
            self.answer = following
        self.version = self.epochs.version
        return self.version

    def drain(self, cursor: int) -> tuple[int, DataFrame | None]:
        """Changes after ``cursor``: each key once, with its latest row or a delete."""
        found = [(v, df) for v, df in self.log if v > cursor]
        if not found:
            return self.version, None
        rows = None
        for v, df in found:
            tagged = df.withColumn("__v", F.lit(v))
            rows = tagged if rows is None else rows.unionByName(tagged)
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*found[0][1].columns), "__v").alias("r"))
        return self.version, last.select("r.*")

    def checksum(self) -> int:
        return self.answer.agg(F.bit_xor(F.xxhash64(*self.answer.columns))).first()[0] or 0


class AggregateView(StandingView):
    """Counts, sums, minima and maxima over an append-only table: only new rows are read.

    The partial result of the new rows is merged into the state; groups that the epoch did not touch are
    carried over. Sums of floating point are refused unless rounded by the caller, as their result
    would depend on the order of the epochs.
    """

    MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}

    def __init__(self, epochs: Epochs, table: str, key: list[str], measures: dict[str, tuple[str, str]]):
        self.table, self.measures = table, measures
        kinds = dict(epochs.read(table).dtypes)
        for name, (function, column) in measures.items():
            if function not in self.MERGE:
                raise Refused(f"{name}: {function} can't be maintained from new rows alone")
            if function == "sum" and kinds.get(column) in ("float", "double"):
                raise Refused(f"{name}: a sum of floating point depends on order; cast to decimal or round")
        super().__init__(epochs, lambda t: self._partial(t[table]), [table], key)

    def _partial(self, rows: DataFrame) -> DataFrame:
        call = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
        return rows.groupBy(*self.key).agg(*(call[f](c).alias(n) for n, (f, c) in self.measures.items()))

    def _advance(self) -> DataFrame:
        new = self._partial(self.epochs.read(self.table, self.version))
        merged = self.answer.unionByName(new).groupBy(*self.key).agg(*(self.MERGE[f](n).alias(n) for n, (f, _) in self.measures.items()))
        kinds = dict(self.answer.dtypes)
        return merged.select(*(F.col(c).cast(kinds[c]).alias(c) for c in self.answer.columns))


class JoinView(StandingView):
    """An inner equi-join of two append-only tables: new left with all right, and old left with new right."""

    def __init__(self, epochs: Epochs, left: str, right: str, on: list[str], key: list[str]):
        self.left, self.right, self.on = left, right, on
        super().__init__(epochs, lambda t: t[left].join(t[right], on), [left, right], key)

    def _advance(self) -> DataFrame:
        read, since = self.epochs.read, self.version
        fresh = read(self.left, since).join(read(self.right), self.on)
        old_left = self.epochs.spark.read.parquet(*[p for v, p in self.epochs.parts[self.left] if v <= since])
        return self.answer.unionByName(fresh).unionByName(old_left.join(read(self.right, since), self.on))


class TopView(StandingView):
    """The first ``n`` rows of an append-only table by a total order: kept rows compete with new ones."""

    def __init__(self, epochs: Epochs, table: str, order: list, n: int, key: list[str]):
        self.table, self.order, self.n = table, order, n
        super().__init__(epochs, lambda t: t[table].orderBy(*order).limit(n), [table], key)

    def _advance(self) -> DataFrame:
        return self.answer.unionByName(self.epochs.read(self.table, self.version)).orderBy(*self.order).limit(self.n)


class GroupView(StandingView):
    """Any statement that works group by group (windows, as-of, holistic aggregates) over append-only
    tables: groups that new rows touch are recomputed, the others kept."""

    def __init__(self, epochs: Epochs, statement: Statement, tables: list[str], group: list[str], key: list[str]):
        self.group = group
        super().__init__(epochs, statement, tables, key)

    def _advance(self) -> DataFrame:
        touched = None
        for t in self.tables:
            keys = self.epochs.read(t, self.version).select(*self.group)
            touched = keys if touched is None else touched.union(keys)
        touched = touched.distinct()
        again = self.statement({t: _match(self.epochs.read(t), touched, self.group, "left_semi") for t in self.tables})
        return _match(self.answer, touched, self.group, "left_anti").unionByName(again)


class RowView(StandingView):
    """Filters, projections and UNION ALL over append-only tables: new rows go through, old ones stay.

    ``branches``: table -> what its rows become; a table may stand in several.
    """

    def __init__(self, epochs: Epochs, branches: list[tuple[str, Callable[[DataFrame], DataFrame]]], key: list[str]):
        self.branches = branches
        super().__init__(epochs, lambda t: self._through(lambda name: t[name]), list(dict.fromkeys(n for n, _ in branches)), key)

    def _through(self, read: Callable[[str], DataFrame]) -> DataFrame:
        out = None
        for name, step in self.branches:
            out = step(read(name)) if out is None else out.unionByName(step(read(name)))
        return out

    def _advance(self) -> DataFrame:
        return self.answer.unionByName(self._through(lambda name: self.epochs.read(name, self.version)))


class KeyedJoinView(StandingView):
    """An equi-join of any kind (inner, left, full, left_semi, left_anti) over tables that may change in
    every way: the answers of keys that either side's changes touch are made anew, the others stay.

    What changed is found from the parts that came or went since the last update; null keys match
    only themselves when answers are replaced, and nothing when rows are joined.
    """

    def __init__(self, epochs: Epochs, left: str, right: str, on: list[str], how: str, key: list[str]):
        if how not in ("inner", "left", "full", "left_semi", "left_anti"):
            raise Refused(f"{how} is not a join that a view keeps")
        self.left, self.right, self.on, self.how = left, right, on, how
        self.known = {t: list(epochs.parts[t]) for t in (left, right)}
        super().__init__(epochs, lambda t: t[left].join(t[right], on, how), [left, right], key)

    def _advance(self) -> DataFrame:
        touched = None
        for t in dict.fromkeys((self.left, self.right)):
            now = self.epochs.parts[t]
            came, went = ([p for p in a if p not in b] for a, b in ((now, self.known[t]), (self.known[t], now)))
            schema = self.epochs.read(t).schema
            rows = [self.epochs.spark.read.schema(schema).parquet(*(p for _, p in some)) if some else self.epochs.spark.createDataFrame([], schema) for some in (came, went)]
            # a rewritten part holds mostly rows that did not change: what differs between the two touches
            keys = rows[0].select(*self.on).distinct() if not went else rows[0].exceptAll(rows[1]).union(rows[1].exceptAll(rows[0])).select(*self.on).distinct()
            touched = keys if touched is None else touched.union(keys).distinct()
            self.known[t] = list(now)
        a, b = (_match(self.epochs.read(t), touched, self.on, "left_semi") for t in (self.left, self.right))
        return _match(self.answer, touched, self.on, "left_anti").unionByName(a.join(b, self.on, self.how))


class ChangingAggregateView(StandingView):
    """Any aggregates (AVG, DISTINCT, percentiles) of groups over a table with upserts and deletes: the
    groups of rows that came or went are made anew, the others stay."""

    def __init__(self, epochs: Epochs, table: str, group: list[str], aggregates: Callable[[], list]):
        self.table, self.group, self.aggregates = table, group, aggregates
        self.known = list(epochs.parts[table])
        super().__init__(epochs, lambda t: t[table].groupBy(*group).agg(*aggregates()), [table], group)

    def _advance(self) -> DataFrame:
        read, now = self.epochs.spark.read, self.epochs.parts[self.table]
        rows = self.epochs.read(self.table)
        came, went = ([p for _, p in (x for x in a if x not in b)] for a, b in ((now, self.known), (self.known, now)))
        new, old = (read.schema(rows.schema).parquet(*some) if some else rows.limit(0) for some in (came, went))
        changed = new if not went else new.exceptAll(old).union(old.exceptAll(new))
        self.known = list(now)
        touched = changed.select(*self.group).distinct()
        again = _match(rows, touched, self.group, "left_semi").groupBy(*self.group).agg(*self.aggregates())
        return _match(self.answer, touched, self.group, "left_anti").unionByName(again)


def from_stream(stream: DataFrame, epochs: Epochs, table: str, time: tuple[str, str] | None = None, after: Callable[[], object] | None = None):
    """Feed a table from a stream: each micro-batch is an epoch, once. Returns a writer to start."""

    def publish(batch: DataFrame, number: int) -> None:
        epochs.refresh(append={table: batch}, time={table: time} if time else None, batch=(table, number))
        if after is not None:
            after()

    return stream.writeStream.foreachBatch(publish)
