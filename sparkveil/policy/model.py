"""Entitlements: what a principal sees of a table's rows and columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..plans import sqlfront
from ..sources.adopt import adopt
from .trace import Trace

FULL, MASKED, AGGREGATE_ONLY, NONE, TEST = "FULL", "MASKED", "AGGREGATE_ONLY", "NONE", "TEST"


@dataclass(frozen=True)
class Context:
    """What a principal carries: scalars and lists by name."""

    scalars: dict[str, object] = field(default_factory=dict)
    lists: dict[str, list] = field(default_factory=dict)

    def member(self, column: Column, name: str) -> Column:
        values = [v for v in self.lists.get(name, []) if v is not None]
        return column.isin(values) if values else F.lit(False)

    def equals(self, column: Column, name: str) -> Column:
        return F.coalesce(column == F.lit(self.scalars.get(name)), F.lit(False))


Predicate = Callable[[Context], Column]


@dataclass(frozen=True)
class Rule:
    """The first rule whose condition holds decides a column's disclosure in a row."""

    when: Predicate
    level: str = FULL
    mask: Callable[[], Column] | None = None


@dataclass(frozen=True)
class ColumnPolicy:
    rules: tuple[Rule, ...] = ()
    otherwise: str = NONE
    mask: Callable[[], Column] | None = None
    floor: int = 0
    aggregates: tuple[str, ...] = ("count", "sum", "avg")
    disclose: bool = False

    @property
    def population(self) -> bool:
        """Whether any row shows the column to aggregates only: then statements may ask for no more."""
        return AGGREGATE_ONLY in (self.otherwise, *(r.level for r in self.rules))


@dataclass(frozen=True)
class TablePolicy:
    rows: Predicate
    columns: dict[str, ColumnPolicy] = field(default_factory=dict)
    parent: tuple[str, str, str] | None = None  # (table, own column, parent's column)
    bridge: tuple[str, str, str, str] | None = None  # (bridge table, own column, bridge's column for it, context list its other column must meet): see bridged_rows
    bridge_column: str = ""

    def digest(self) -> str:
        shape = sorted((c, p.otherwise, p.floor, len(p.rules), p.aggregates) for c, p in self.columns.items())
        return hashlib.sha256(repr((shape, self.parent)).encode()).hexdigest()


def fence(df: DataFrame) -> DataFrame:
    """Keep what stands above from being evaluated on rows that the policy hides.

    Catalyst moves no predicate below a filter on a nondeterministic id.
    """
    return df.where(F.monotonically_increasing_id() >= 0)


def bridged_rows(df: DataFrame, bridge: DataFrame, own: str, theirs: str, endpoint: str, allowed: list) -> DataFrame:
    """Rows that some bridge row connects with an allowed endpoint: EXISTS over the bridge."""
    good = bridge.where(F.col(endpoint).isin(allowed) if allowed else F.lit(False)).select(F.col(theirs).alias("__bridge")).distinct()
    return df.join(good, df[own] == good["__bridge"], "left_semi")


def sanitised(df: DataFrame, policy: TablePolicy, context: Context, barrier: bool = False) -> DataFrame:
    """The rows a principal may see, each column as disclosed, with ``<name>__disclosure`` where asked for.

    A row predicate that is null or cannot be decided does not admit the row. Statements filter, sort and
    join on the masked value, since nothing else leaves this projection.
    """
    rows = df.where(F.coalesce(policy.rows(context), F.lit(False)))
    if barrier:
        rows = fence(rows)
    out: list[Column] = []
    for f in df.schema.fields:
        p = policy.columns.get(f.name)
        if p is None:
            out.append(F.col(f.name))
            continue
        null = F.lit(None).cast(f.dataType)

        def shown(level: str, mask, name: str = f.name, kind=f.dataType, null: Column = null) -> Column:
            if level in (FULL, AGGREGATE_ONLY):
                return F.col(name)
            return mask().cast(kind) if level == MASKED and mask is not None else null

        value, label = shown(p.otherwise, p.mask), F.lit(p.otherwise)
        for r in reversed(p.rules):
            condition = F.coalesce(r.when(context), F.lit(False))
            value, label = F.when(condition, shown(r.level, r.mask or p.mask)).otherwise(value), F.when(condition, F.lit(r.level)).otherwise(label)
        out.append(value.alias(f.name))
        if p.disclose:
            out.append(label.alias(f"{f.name}__disclosure"))
    return rows.select(*out)


class Entitled:
    """A principal's view of the tables: a session that holds sanitised views and nothing else."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], policies: dict[str, TablePolicy], context: Context, barrier: bool = False):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.policies, self.context = policies, context
        self.visible: dict[str, DataFrame] = {}
        self.barrier, self.admitted = barrier, {}
        pending = dict(tables)
        while pending:
            ready = [n for n in pending if n not in policies or policies[n].parent is None or policies[n].parent[0] in self.visible]
            if not ready:
                raise Refused("the parents of tables form a circle")
            for n in ready:
                df = pending.pop(n)
                p = policies.get(n)
                if p is not None:
                    if p.parent is not None:
                        table, own, theirs = p.parent
                        keys = self.visible[table].select(F.col(theirs).alias("__parent")).distinct()
                        df = df.join(keys, df[own] == keys["__parent"], "left_semi")
                    if p.bridge is not None:
                        table, own, theirs, allowed = p.bridge
                        df = bridged_rows(df, tables[table], own, theirs, p.bridge_column, self.context.lists.get(allowed, []))
                    self.admitted[n] = df
                    df = sanitised(df, p, context, barrier)
                self.visible[n] = df
                adopt(self.spark, df).createOrReplaceTempView(n)

    def population(self) -> dict[str, ColumnPolicy]:
        return {c: p for t in self.policies.values() for c, p in t.columns.items() if p.population}

    def prepare(self, sql: str) -> str:
        """The text that runs: population-only columns in allowed aggregates stand behind floors."""
        return guard(sql, self.population())

    def query(self, sql: str, params: object = None) -> DataFrame:
        """The statement over the visible tables. What it reads and shows is decided on its analysed plan."""
        text = sqlfront.rewrite(self.prepare(self._lift_tests(sql)), params)
        try:
            df = self.spark.sql(text)
        except AnalysisException as e:
            if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                raise Refused("the statement names a relation that is not there") from None
            raise
        columns = {t: {c: (cp.floor, cp.aggregates) for c, cp in p.columns.items() if cp.population} for t, p in self.policies.items()}
        Trace(set(self.visible), columns).check(df)
        return df

    def _lift_tests(self, sql: str) -> str:
        """Comparisons of test-only columns with constants become booleans computed in the leaf.

        ``column = constant``, ``<>`` and ``IN (constants)`` are all a statement may ask of such a column.
        """
        governed = {c.lower(): t for t, p in self.policies.items() for c, cp in p.columns.items() if cp.otherwise == TEST}
        if not governed:
            return sql
        found, out, i = sqlfront.tokens(sql), [], 0
        tests: dict[str, list[str]] = {}
        while i < len(found):
            name = found[i].text.strip('"').lower()
            if found[i].kind not in ("word", "quoted") or name not in governed:
                out.append(found[i])
                i += 1
                continue
            if i + 2 < len(found) and found[i + 1].text in ("=", "<>") and found[i + 2].kind in ("string", "number"):
                end = i + 3
            elif i + 2 < len(found) and found[i + 1].word == "IN" and found[i + 2].text == "(":
                end = sqlfront._closing(found, i + 2) + 1
                if any(t.kind not in ("string", "number") and t.text not in ",()" for t in found[i + 2 : end]):
                    raise Refused("a test-only column is compared with something else than constants")
            else:
                raise Refused("a test-only column may only be compared with constants")
            listed = tests.setdefault(governed[name], [])
            listed.append(sqlfront.text_of(found[i:end]))
            out.append(sqlfront.Token("word", f"__test_{governed[name]}_{len(listed) - 1}"))
            i = end
        for table, listed in tests.items():
            df = self.admitted[table]
            for k, text in enumerate(listed):
                df = df.withColumn(f"__test_{table}_{k}", F.expr(text))
            adopt(self.spark, sanitised(df, self.policies[table], self.context, self.barrier)).createOrReplaceTempView(table)
        return sqlfront.text_of(out)

    def report(self) -> dict[str, dict[str, str]]:
        """Disclosure of each governed column: one level, or PER_ROW where rules decide."""
        return {t: {c: "PER_ROW" if cp.rules else cp.otherwise for c, cp in p.columns.items()} for t, p in self.policies.items()}


def guard(sql: str, columns: dict[str, ColumnPolicy]) -> str:
    """Put allowed aggregates of population-only columns behind their floors.

    The guard carries the same FILTER clause, so the group it counts is the one that is aggregated.
    This only writes the floors: that none is missing, and that the values go nowhere else, is checked
    on the analysed plan (:mod:`trace`).
    """
    if not columns:
        return sql
    lowered = {c.lower(): p for c, p in columns.items()}
    found = sqlfront.tokens(sql)
    out: list[str] = []
    i = 0
    while i < len(found):
        t = found[i]
        window = found[i : i + 4]
        if len(window) == 4 and window[1].text == "(" and window[3].text == ")" and window[2].text.strip('"').lower() in lowered:
            p = lowered[window[2].text.strip('"').lower()]
            if t.text.lower() not in p.aggregates:
                raise Refused(f"{t.text.upper()} is not allowed on a population-only column")
            end = i + 4
            tail = ""
            if end + 1 < len(found) and found[end].word == "FILTER":
                close = sqlfront._closing(found, end + 1)
                inner = found[end : close + 1]
                if any(x.text.strip('"').lower() in lowered for x in inner):
                    raise Refused("a population-only column stands in a FILTER")
                tail, end = " " + sqlfront.text_of(inner), close + 1
            if end < len(found) and found[end].word == "OVER":
                raise Refused("a population-only column stands in a window")
            col = window[2].text
            out.append(f"CASE WHEN count({col}){tail} >= {p.floor} THEN {t.text}({col}){tail} END")
            i = end
            continue
        out.append(t.text)
        i += 1
    return sqlfront.text_of([sqlfront.Token("raw", x) for x in out])


# --- tenancy: roles and grants compiled to descriptors --------------------------------------------
@dataclass(frozen=True)
class Grant:
    role: str
    scope: str  # the kind of tenant
    tenants: tuple
    levels: dict[str, str] = field(default_factory=dict)  # column -> level


@dataclass(frozen=True)
class Tenancy:
    """Declares which column of a table names its tenant, and which its subject or owner."""

    table: str
    scope: str
    column: str
    subject: str | None = None
    governed: dict[str, ColumnPolicy] = field(default_factory=dict)

    def compile(self, grants: list[Grant]) -> TablePolicy:
        mine = [g for g in grants if g.scope == self.scope]
        everyone = tuple(dict.fromkeys(t for g in mine for t in g.tenants))

        def rows(context: Context) -> Column:
            inside = F.col(self.column).isin(list(everyone)) if everyone else F.lit(False)
            return inside | context.equals(F.col(self.subject), "subject") if self.subject else inside

        columns = {}
        for name, base in self.governed.items():
            rules = tuple(
                Rule((lambda ctx, ts=g.tenants: F.col(self.column).isin(list(ts)) if ts else F.lit(False)), g.levels[name]) for g in mine if name in g.levels
            )
            own = (Rule(lambda ctx: ctx.equals(F.col(self.subject), "subject"), FULL),) if self.subject else ()
            columns[name] = ColumnPolicy(own + rules + base.rules, base.otherwise, base.mask, base.floor, base.aggregates, base.disclose)
        return TablePolicy(rows, columns)


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise Refused("not an identifier")
    return name
