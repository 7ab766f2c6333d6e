"""Time-series forms of the SQL dialect, written as SQL that Spark runs.

``TIME_BUCKET``, ``TABLE(TUMBLE|HOP|SESSION(...))``, ``UNNEST(...) [WITH ORDINALITY]``,
``ARRAY_AGG(x ORDER BY ...)`` are rewritten in place. ``ASOF JOIN`` needs the columns of its sides, so it
becomes a view of :func:`~sparkveil.operators.asof.asof_join` with one struct column for each side.
"""

from __future__ import annotations

import itertools

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.scalar import micros
from ..operators.asof import OPERATORS, asof_join
from .sqlfront import Token, _closing, text_of, tokens

_NUMBER = itertools.count()
_ENDS = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "FETCH", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "ASOF", "OUTER"}


def _arguments(found: list[Token], start: int) -> tuple[list[list[Token]], int]:
    """Arguments between the parenthesis at ``start`` and its end, and the place after it."""
    end, depth, parts = _closing(found, start), 0, [[]]
    for t in found[start + 1 : end]:
        depth += (t.text in "([") - (t.text in ")]")
        if t.text == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts, end + 1


def _interval(found: list[Token]) -> int:
    """Microseconds of INTERVAL '15' MINUTE or INTERVAL '15 minutes'."""
    if len(found) not in (2, 3) or found[0].word != "INTERVAL" or found[1].kind != "string":
        raise Refused("a window size is an INTERVAL of fixed length")
    try:
        return micros(f"{found[1].text.strip(chr(39))} {found[2].text if len(found) == 3 else ''}")
    except (KeyError, ValueError):
        raise Refused("a window size is an INTERVAL of fixed length") from None


def _long(n: int) -> str:
    return f"CAST({n} AS BIGINT)"


def _at(u: str) -> str:
    return f"CAST(timestamp_micros({u}) AS TIMESTAMP_NTZ)"


def _micros(expression: str) -> str:
    return f"unix_micros(CAST({expression} AS TIMESTAMP_LTZ))"


def _bucket(size: int, expression: str, origin: str | None = None) -> str:
    shift = _micros(origin) if origin else _long(0)
    return _at(f"{_micros(expression)} - pmod({_micros(expression)} - {shift}, {_long(size)})")


def _relation(found: list[Token]) -> str:
    if found and found[0].word == "TABLE":
        found = found[1:]
    if not found:
        raise Refused("a window function reads TABLE name or a subquery")
    return text_of(found)


def _descriptor(found: list[Token]) -> list[str]:
    if not found or found[0].word != "DESCRIPTOR":
        raise Refused("a window function names its columns by DESCRIPTOR")
    return [text_of(a) for a in _arguments(found, 1)[0]]


def _windowed(name: str, arguments: list[list[Token]]) -> str:
    keys: list[str] = []
    source = arguments[0]
    split = next((i for i, t in enumerate(source) if t.word == "PARTITION"), None)
    if split is not None:
        keys, source = [text_of(a) for a in _arguments([Token("op", "("), *source[split + 2 :], Token("op", ")")], 0)[0]], source[:split]
        keys = [k.strip("()") for k in keys]
    relation, (time,) = _relation(source), _descriptor(arguments[1])
    rest = arguments[2:]
    u = _micros(time)
    if name == "TUMBLE":
        size = _interval(rest[0])
        start = f"{u} - pmod({u}, {_long(size)})"
        return f"(SELECT *, {_at(start)} AS window_start, {_at(f'{start} + {_long(size)}')} AS window_end FROM {relation})"
    if name == "HOP":
        slide, size = _interval(rest[0]), _interval(rest[1])
        top = f"({u} - pmod({u}, {_long(slide)}))"
        starts = f"filter(sequence({top} - {_long((size // slide + 1) * slide)}, {top}, {_long(slide)}), x -> x > {u} - {_long(size)})"
        inner = f"(SELECT *, explode({starts}) AS __s FROM {relation} WHERE {time} IS NOT NULL)"
        return f"(SELECT * EXCEPT (__s), {_at('__s')} AS window_start, {_at(f'__s + {_long(size)}')} AS window_end FROM {inner})"
    if rest[0] and rest[0][0].word == "DESCRIPTOR":
        keys, rest = _descriptor(rest[0]), rest[1:]
    gap = _interval(rest[0])
    by = f"PARTITION BY {', '.join(keys)}" if keys else ""
    more = f"PARTITION BY {', '.join([*keys, '__n'])}, __u IS NULL"  # rows without a time have no bounds
    opened = f"(SELECT *, {u} AS __u, CASE WHEN {u} - lag({u}) OVER ({by} ORDER BY {u}) < {_long(gap)} THEN 0 ELSE 1 END AS __o FROM {relation})"
    numbered = f"(SELECT *, sum(__o) OVER ({by} ORDER BY __u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __n FROM {opened})"
    bounds = f"{_at(f'min(__u) OVER ({more})')} AS window_start, {_at(f'max(__u) OVER ({more}) + {_long(gap)}')} AS window_end"
    return f"(SELECT * EXCEPT (__u, __o, __n), {bounds} FROM {numbered})"


def _ordered_array(found: list[Token], start: int) -> tuple[str, int] | None:
    """ARRAY_AGG(x ORDER BY k [ASC|DESC] [NULLS FIRST|LAST], ...): sorted after the elements are collected."""
    end = _closing(found, start)
    split = next((i for i in range(start + 1, end) if found[i].word == "ORDER" and found[i + 1].word == "BY"), None)
    if split is None:
        return None
    value = text_of(found[start + 1 : split])
    keys, rules = [], []
    for k, part in enumerate(_arguments([Token("op", "("), *found[split + 2 : end], Token("op", ")")], 0)[0]):
        words = [t.word for t in part]
        down = "DESC" in words
        first = words[-2:] == ["NULLS", "FIRST"] or (down and words[-2:] != ["NULLS", "LAST"])  # nulls are high
        keys.append(text_of([t for t in part if t.word not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]))
        a, b, low = f"l.k{k}", f"r.k{k}", -1 if first else 1
        rules.append(
            f"WHEN {a} IS NULL AND {b} IS NOT NULL THEN {low} WHEN {b} IS NULL AND {a} IS NOT NULL THEN {-low} "
            f"WHEN {a} < {b} THEN {1 if down else -1} WHEN {a} > {b} THEN {-1 if down else 1}"
        )
    fields = ", ".join([*(f"{key} AS k{k}" for k, key in enumerate(keys)), f"{value} AS x"])
    return f"transform(array_sort(collect_list(struct({fields})), (l, r) -> CASE {' '.join(rules)} ELSE 0 END), e -> e.x)", end + 1


def _unnest(found: list[Token], i: int, before: list[Token]) -> tuple[list[Token], int]:
    """UNNEST(list) [WITH ORDINALITY] [AS] a(x[, o]) as a lateral table of the list's elements."""
    arguments, at = _arguments(found, i + 1)
    counted = [t.word for t in found[at : at + 2]] == ["WITH", "ORDINALITY"]
    at += 2 * counted
    at += at < len(found) and found[at].word == "AS"
    if at + 1 >= len(found) or found[at + 1].text != "(":
        raise Refused("UNNEST names its columns: UNNEST(list) AS a(x)")
    names, after = _arguments(found, at + 1)
    value = text_of(arguments[0])
    fields = "x AS x, i + 1 AS o" if counted else "x AS x"
    table = f"LATERAL inline(transform({value}, (x, i) -> struct({fields}))) AS {found[at].text}({', '.join(text_of(n) for n in names)})"
    if not before or before[-1].word in ("FROM", "(") or len(arguments) != 1:
        raise Refused("UNNEST stands after the table whose list it opens")
    return [Token("raw", table)], after


def rewrite_forms(sql: str) -> str:
    """All forms that need no schema; other text is left as it is."""
    found = tokens(sql)
    if not {t.word for t in found} & {"TIME_BUCKET", "TUMBLE", "HOP", "SESSION", "UNNEST", "ARRAY_AGG"}:
        return sql
    out: list[Token] = []
    i = 0
    while i < len(found):
        t, called = found[i], i + 1 < len(found) and found[i + 1].text == "("
        if t.word == "TIME_BUCKET" and called:
            arguments, i = _arguments(found, i + 1)
            texts = [rewrite_forms(text_of(a)) for a in arguments[1:]]
            out.append(Token("raw", _bucket(_interval(arguments[0]), *texts)))
        elif t.word == "TABLE" and called and i + 2 < len(found) and found[i + 2].word in ("TUMBLE", "HOP", "SESSION"):
            arguments, _ = _arguments(found, i + 3)
            out.append(Token("raw", _windowed(found[i + 2].word, arguments)))
            i = _closing(found, i + 1) + 1
        elif t.word == "UNNEST" and called:
            table, i = _unnest(found, i, out)
            out += table
        elif t.word == "ARRAY_AGG" and called and (made := _ordered_array(found, i + 1)) is not None:
            out.append(Token("raw", made[0]))
            i = made[1]
        else:
            out.append(t)
            i += 1
    return text_of(out)


def _side(found: list[Token], at: int) -> tuple[str, str, int]:
    """(relation, alias, place after) of a table or subquery with its alias."""
    end = _closing(found, at) + 1 if found[at].text == "(" else at + 1
    relation, alias = text_of(found[at:end]), found[at].text
    end += end < len(found) and found[end].word == "AS"
    if end < len(found) and found[end].kind in ("word", "quoted") and found[end].word not in _ENDS | {"ON", "MATCH_CONDITION"}:
        alias, end = found[end].text, end + 1
    return relation, alias, end


def _conjuncts(found: list[Token]) -> list[list[Token]]:
    parts, depth = [[]], 0
    for t in found:
        depth += (t.text == "(") - (t.text == ")")
        if t.word == "AND" and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _reads(part: list[Token]) -> set[str]:
    """Qualifiers of the columns that an expression names."""
    return {a.text.lower() for a, b in zip(part, part[1:]) if b.text == "." and a.kind in ("word", "quoted")}


def _split(part: list[Token], operators: tuple[str, ...]) -> tuple[list[Token], str, list[Token]] | None:
    depth = 0
    for i, t in enumerate(part):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.text in operators:
            return part[:i], t.text, part[i + 1 :]
    return None


def asof_views(spark: SparkSession, sql: str, run) -> str:
    """Replace ``a [LEFT] ASOF JOIN b MATCH_CONDITION (a.t >= b.t) ON a.k = b.k`` by a view of the result.

    Columns are named by their side (a.x, b.y). Times may be computed; conditions of ON that read one side
    only decide which of its rows may match. ``run`` gives the DataFrame of a statement.
    """
    found = tokens(sql)
    while (at := next((i for i, t in enumerate(found) if t.word == "ASOF"), None)) is not None:
        outer = found[at - 1].word == "LEFT"
        depth, start = 0, None
        for i in range(at - 1, -1, -1):
            depth += (found[i].text == ")") - (found[i].text == "(")
            if depth < 0:
                break
            if depth == 0 and found[i].word == "FROM":
                start = i
                break
        if start is None or found[at + 1].word != "JOIN":
            raise Refused("ASOF JOIN stands between two tables after FROM")
        relation, a, after = _side(found, start + 1)
        if after != at - outer:
            raise Refused("the left side of ASOF JOIN is one table or subquery")
        other, b, after = _side(found, at + 2)
        if after >= len(found) or found[after].word != "MATCH_CONDITION":
            raise Refused("ASOF JOIN needs a MATCH_CONDITION")
        close = _closing(found, after + 1)
        match, end = found[after + 2 : close], close + 1
        conditions: list[Token] = []
        if end < len(found) and found[end].word == "ON":
            begin = end = end + 1
            depth = 0
            while end < len(found) and not (depth == 0 and (found[end].word in _ENDS or found[end].text == ")")):
                depth += (found[end].text == "(") - (found[end].text == ")")
                end += 1
            conditions = found[begin:end]
        left, right = a.lower(), b.lower()
        parts = _split(match, OPERATORS)
        if parts is None:
            raise Refused("MATCH_CONDITION compares a time of each side")
        times, op = {}, parts[1]
        for part, flipped in ((parts[0], False), (parts[2], True)):
            (side,) = _reads(part) or {""}
            times[side] = text_of(part)
            if flipped and side == left:
                op = {">=": "<=", "<=": ">=", ">": "<", "<": ">"}[op]
        if set(times) != {left, right}:
            raise Refused("MATCH_CONDITION compares a time of each side")
        keys, only = {left: [], right: []}, {left: [], right: []}
        for part in _conjuncts(conditions):
            sides, halves = _reads(part), _split(part, ("=",))
            if len(sides) == 1 and sides <= {left, right}:
                only[sides.pop()].append(text_of(part))
            elif halves and {frozenset(_reads(halves[0])), frozenset(_reads(halves[2]))} == {frozenset({left}), frozenset({right})}:
                for half in (halves[0], halves[2]):
                    keys[next(iter(_reads(half)))].append(text_of(half))
            else:
                raise Refused("ON of an ASOF JOIN holds equalities and conditions of one side")

        def prepared(relation: str, alias: str, name: str):
            good = " AND ".join(f"({c})" for c in only[name]) or "TRUE"
            extra = [f"CASE WHEN {good} THEN {times[name]} END AS __t", *(f"{k} AS __k{i}" for i, k in enumerate(keys[name]))]
            return run(f"SELECT {alias}.*, {', '.join(extra)} FROM {relation} AS {alias}")

        x, y = prepared(relation, a, left), prepared(other, b, right)
        joined = asof_join(x, y, "__t", "__t", op, [f"__k{i}" for i in range(len(keys[left]))], None, "left" if outer else "inner", "__r_")
        mine, theirs = ([c for c in df.columns if not c.startswith("__")] for df in (x, y))
        rows = joined.select(F.struct(*mine).alias(a.strip('"')), F.struct(*(F.col(f"__r_{c}").alias(c) for c in theirs)).alias(b.strip('"')))
        name = f"__asof_{next(_NUMBER)}"
        rows.createOrReplaceTempView(name)
        found = [*found[: start + 1], Token("word", name), *found[end:]]
    return text_of(found)
