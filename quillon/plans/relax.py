"""Wider forms of a statement that gives no rows, from its parsed condition.

The parser tells the conjuncts of the condition and where they stand in the text, so each is changed by itself: texts match anywhere in any case, ranges
of numbers grow, conjuncts go, a text may stand in any column of its table, or in a table that shares a key. How many rows each form
would give is counted in one scan of the statement's tables, and the form with the fewest is the nearest one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import DataFrame

from . import guard
from .federation import QUOTED, Federation, identifiers

#: By which share of its size a number's range grows.
WIDER = (0.1, 0.5)
#: Plan nodes above the condition of a statement.
ABOVE = ("GlobalLimit", "LocalLimit", "Offset", "Sort", "Project", "Aggregate", "Distinct", "UnresolvedHaving")
INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Names of columns, without the letters in front that name the table, that are keys.
KEY = re.compile(r"(?:^|_)(?:\w*key|id|\w+_id)$", re.I)


@dataclass(frozen=True)
class Conjunct:
    """A part of the condition at text[first:last]: `kind` text (column equals or is like a text), range (column against a number), or other."""

    text: str
    first: int
    last: int
    kind: str = "other"
    column: str = ""
    operator: str = ""
    value: str = ""


@dataclass(frozen=True)
class Form:
    """A statement, the conjuncts that make up its condition, and how it came about."""

    kind: str
    sql: str
    where: tuple[str, ...]
    rows: int | None = None


_TEXT = re.compile(r"""^\s*([\w.`]+)\s*(=|(?:i?like))\s*'((?:[^']|'')*)'\s*$""", re.I)
_NUMBER = re.compile(r"^\s*([\w.`]+)\s*(<=|>=|<|>|=)\s*(-?\d+(?:\.\d+)?)\s*$")
_BETWEEN = re.compile(r"^\s*([\w.`]+)\s+between\s+(-?\d+(?:\.\d+)?)\s+and\s+(-?\d+(?:\.\d+)?)\s*$", re.I)


def conjuncts(fed: Federation, sql: str) -> list[Conjunct]:
    """The conjuncts of the statement's own condition, in order; none where it has no condition."""
    node = fed.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    while node.getClass().getSimpleName() in ABOVE:
        node = node.children().apply(0)
    if node.getClass().getSimpleName() != "Filter":
        return []
    out: list[Conjunct] = []

    def split(e) -> None:
        if e.getClass().getSimpleName() == "And":
            for i in range(e.children().size()):
                split(e.children().apply(i))
            return
        first, last = _span(e)
        depth = [sum((x == "(") - (x == ")") for x in QUOTED.sub("", sql[first:last]))]
        while depth[-1] < 0 and first:  # a bracket opened before what it holds
            first -= 1
            depth.append(depth[-1] + (sql[first] == "("))
        text = sql[first:last]
        if m := _TEXT.match(text):
            out.append(Conjunct(text, first, last, "text", m[1], m[2].lower(), m[3]))
        elif m := _NUMBER.match(text):
            out.append(Conjunct(text, first, last, "range", m[1], m[2], m[3]))
        elif m := _BETWEEN.match(text):
            out.append(Conjunct(text, first, last, "range", m[1], "between", f"{m[2]} {m[3]}"))
        else:
            out.append(Conjunct(text, first, last))

    split(node.condition())
    return out


def _span(e) -> tuple[int, int]:
    """Where an expression stands; that of IN, LIKE and the like begins behind what they test."""
    spans = [_span(e.children().apply(i)) for i in range(e.children().size())]
    if e.origin().startIndex().isDefined():
        spans.append((e.origin().startIndex().get(), e.origin().stopIndex().get() + 1))
    return min(a for a, _ in spans), max(b for _, b in spans)


def softened(c: Conjunct) -> str:
    return f"{c.column} ILIKE '%{c.value.strip('%')}%'" if c.kind == "text" else c.text


def widened(c: Conjunct, share: float) -> str:
    if c.kind != "range":
        return softened(c)
    low, high = (float(x) for x in (c.value.split() * 2)[:2])
    low, high = low - abs(low) * share, high + abs(high) * share
    if c.operator in ("=", "between"):
        return f"{c.column} BETWEEN {low} AND {high}"
    return f"{c.column} {c.operator} {low if '>' in c.operator else high}"


def _assembled(sql: str, parts: list[Conjunct], where: list[str | None]) -> str:
    for c, text in sorted(zip(parts, where), key=lambda x: -x[0].first):
        sql = sql[: c.first] + (text or "true") + sql[c.last :]
    return sql


def _tables(fed: Federation, sql: str) -> list[tuple[str, str, str]]:
    """(database, table, qualifier) of the tables of the statement."""
    said = guard.check(fed.spark, sql)
    alias = {v.lower(): k for k, v in said.aliases.items()}
    found = [(parts, fed.resolve(parts)) for parts in said.tables]
    return [(*at, alias.get(".".join(parts).lower(), ".".join(parts))) for parts, at in found if at]


def _texts_of(fed: Federation, db: str, table: str) -> list[str]:
    return [c for c, t in fed.databases[db][table].dtypes if t == "string"]


def _bare(name: str) -> str:
    return re.sub(r"^[a-z]{1,3}_", "", name.lower())


def shared_keys(fed: Federation, db: str, table: str) -> list[tuple[str, str, str, str]]:
    """(own column, other database, other table, its column) of integer keys whose names, but for letters that name the table, agree."""
    own = [(c, _bare(c)) for c, t in fed.databases[db][table].dtypes if t in INTEGERS and KEY.search(c)]
    out = []
    for other, tables in fed.databases.items():
        for name, df in tables.items():
            if (other, name) != (db, table):
                out += [(c, other, name, o) for o, t in df.dtypes if t in INTEGERS for c, bare in own if _bare(o) == bare]
    return out


def forms(fed: Federation, sql: str) -> list[Form]:
    """Wider forms, the nearest first: texts softened, ranges grown, conjuncts dropped (one, then more; not all), texts in any column of the
    statement's tables, texts in related tables."""
    sql = identifiers(sql.strip().rstrip(";"))
    parts = conjuncts(fed, sql)
    out: list[Form] = []

    def add(kind: str, where: list[str | None]) -> None:
        form = Form(kind, _assembled(sql, parts, where), tuple(w or "true" for w in where))
        if form.sql != sql and form.where not in {f.where for f in out}:
            out.append(form)

    if not parts:
        return out
    soft = [softened(c) for c in parts]
    add("softened", list(soft))
    for share in WIDER:
        add(f"widened {share}", [widened(c, share) for c in parts])
    for n in range(1, len(parts)):
        for gone in combinations(range(len(parts)), n):
            add("dropped", [None if i in gone else s for i, s in enumerate(soft)])
    tables = _tables(fed, sql)
    told = [c for c in parts if c.kind == "text" and c.value.strip("%")]
    for c in told:
        columns = [f"{q}.{x}" for db, t, q in tables for x in _texts_of(fed, db, t)]
        anywhere = " OR ".join(f"{x} ILIKE '%{c.value.strip('%')}%'" for x in columns)
        add("any column", [f"({anywhere})" if d is c and anywhere else s for d, s in zip(parts, soft)])
    for c in told:
        for db, t, q in tables:
            for n, (own, other_db, other, key) in enumerate(shared_keys(fed, db, t)):
                if texts := _texts_of(fed, other_db, other):
                    has = " OR ".join(f"r{n}.{x} ILIKE '%{c.value.strip('%')}%'" for x in texts)
                    exists = f"EXISTS (SELECT 1 FROM {other_db}.{other} r{n} WHERE r{n}.{key} = {q}.{own} AND ({has}))"
                    add("related table", [exists if d is c else s for d, s in zip(parts, soft)])
    return out


def _from(sql: str, before: int) -> str | None:
    """The text between FROM and the WHERE in front of a place, outside of brackets."""
    plain = QUOTED.sub(lambda m: " " * len(m[0]), sql)
    depth, at = 0, {}
    for m in re.finditer(r"[()]|\b(?:from|where|with)\b", plain[:before], re.I):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth:
            at[m[0].lower()] = m
    return None if "with" in at or len(at) < 2 or at["from"].end() > at["where"].start() else sql[at["from"].end() : at["where"].start()]


def counted(fed: Federation, sql: str, found: list[Form]) -> list[Form]:
    """The forms with the rows that their conditions let through: all in one scan, but for those with related tables, which are only counted where no
    other lets a row through."""
    clean = identifiers(sql.strip().rstrip(";"))
    parts = conjuncts(fed, clean)
    tables = _from(clean, parts[0].first) if parts else None
    plain = [f for f in found if f.kind != "related table"]
    if tables is None:  # no list of tables to count over
        return [replace(f, rows=fed.query(f.sql).count()) for f in found]
    sums = ", ".join(f"count_if({' AND '.join(f'({w})' for w in f.where)}) AS f{n}" for n, f in enumerate(plain))
    rows = fed.query(f"SELECT {sums} FROM {tables}").first() if plain else ()
    out = [replace(f, rows=n) for f, n in zip(plain, rows)]
    if any(rows):
        return out
    return out + [replace(f, rows=fed.query(f.sql).count()) for f in found if f.kind == "related table"]


def widen(fed: Federation, sql: str, attempts: int = 100) -> tuple[Form, DataFrame] | None:
    """The form with the fewest rows, but some (of equals the first), and what it gives; None where none gives any."""
    some = [f for f in counted(fed, sql, forms(fed, sql)[:attempts]) if f.rows]
    if not some:
        return None
    best = min(some, key=lambda f: f.rows)
    return best, fed.query(best.sql)
