"""Guarded, read-only SQL over several databases that are all just relations here."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SCHEMAS, extract_sql
from . import guard

NAME = re.compile(r"^[a-zA-Z0-9_-]+$")
#: Literals, comments and quoted identifiers.
QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|--[^\n]*|/\*.*?\*/|`(?:[^`]|``)*`|"(?:[^"]|"")*\"""", re.S)


def identifiers(sql: str) -> str:
    """The statement with identifiers in double quotes, as PostgreSQL writes them, in backquotes."""

    def swap(m: re.Match) -> str:
        return m[0] if m[0][0] != '"' else "`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`"

    return QUOTED.sub(swap, sql)


class Unsafe(ValueError):
    """The statement isn't one that only reads."""


@dataclass
class Federation:
    """Named databases, each a dict of table names to DataFrames. The order in which they were added decides where a table
    is found that several have."""

    spark: SparkSession
    databases: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    blocking: bool = True

    def add(self, name: str, tables: dict[str, DataFrame], real_name: str | None = None) -> None:
        if not NAME.match(name):
            raise ValueError(f"bad database name: {name}")
        self.databases[name] = tables
        if real_name:
            self.aliases[name] = real_name

    def remove(self, name: str) -> bool:
        self.aliases.pop(name, None)
        return self.databases.pop(name, None) is not None

    def list(self) -> list[str]:
        return list(self.databases)

    def test(self, name: str) -> bool:
        """Whether the database is known and its tables' schemas can be read; runs no job."""
        return name in self.databases and all(df.schema is not None for df in self.databases[name].values())

    def reload(self, wanted: dict[str, dict[str, DataFrame]]) -> tuple[list[str], list[str]]:
        """Makes the databases those wanted; gives the names added and removed."""
        added, gone = sorted(set(wanted) - set(self.databases)), sorted(set(self.databases) - set(wanted))
        for name in gone:
            self.remove(name)
        for name in added:
            self.add(name, wanted[name])
        return added, gone

    def catalog(self) -> DataFrame:
        """(db, real_db, table_name, column_name, ordinal, data_type, nullable, comment)."""
        rows = [
            (db, self.aliases.get(db, db), t, f.name, i, f.dataType.simpleString(), f.nullable, f.metadata.get("comment", ""))
            for db, tables in self.databases.items() for t, df in tables.items() if NAME.match(t) for i, f in enumerate(df.schema)
        ]
        return self.spark.createDataFrame(rows, "db string, real_db string, table_name string, column_name string, ordinal int, data_type string, nullable boolean, comment string")

    def resolve(self, parts: tuple[str, ...]) -> tuple[str, str] | None:
        """(database, table) of a name with up to three parts; names aren't case-sensitive. A first part that is a schema's
        name, not a database's, is passed over."""
        low = [p.strip('"`').lower() for p in parts]
        dbs = {d.lower(): d for d in [*self.databases]} | {r.lower(): d for d, r in self.aliases.items()}
        if len(low) > 1 and low[0] in dbs:
            named = [dbs[low[0]]]
        elif len(low) == 1 or low[0] in SCHEMAS:
            named = list(self.databases)
        else:
            return None
        for db in named:
            for t in self.databases[db]:
                if t.lower() == low[-1]:
                    return db, t
        return None

    def holders(self, table: str) -> list[str]:
        return [db for db, tables in self.databases.items() if table.lower() in (t.lower() for t in tables)]

    def _run(self, sql: str, said: guard.Verdict, at: dict[tuple[str, ...], tuple[str, str]]) -> DataFrame:
        """The statement with each table replaced by a view of a name of its own, where the parser says that it stands. Columns
        behind a table's full or last name are qualified by the view instead, so that tables of one name in several databases keep apart."""
        mark, views = uuid.uuid4().hex[:8], {}
        for n, found in enumerate(dict.fromkeys(at[parts] for parts in said.tables)):
            views[found] = f"q{mark}_{n}"
        aliases = {a.lower() for a in said.aliases} | said.local
        edits = [(first, last, views[at[parts]]) for parts, first, last in said.relations]
        for parts, first, last in said.columns:
            low = tuple(p.lower() for p in parts)
            if low[0] in aliases:
                continue
            for n in range(len(parts) - 1, 0, -1):
                named = {found for p, found in at.items() if tuple(x.lower() for x in p[-n:]) == low[:n]}
                if n > 1 and not named and (found := self.resolve(parts[:n])) in views:
                    named = {found}
                if len(named) > 1:
                    raise LookupError(f"{'.'.join(parts[:n])} may be a table of {' or '.join(sorted(db for db, _ in named))}")
                if named:
                    rest = [p if p == "*" else "`" + p.replace("`", "``") + "`" for p in parts[n:]]
                    edits.append((first, last, ".".join([views[named.pop()], *rest])))
                    break
        for first, last, text in sorted(set(edits), reverse=True):
            sql = sql[:first] + text + sql[last:]
        for (db, t), view in views.items():
            self.databases[db][t].createOrReplaceTempView(view)
        try:
            return self.spark.sql(sql)
        finally:  # the plan is analysed; its views needn't stay
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def query(self, sql: str, limit: int | None = None, anywhere: bool = False) -> DataFrame:
        """Guards, resolves and runs one statement, with joins across databases where it names several. Unknown tables and
        columns fail before any job runs; with anywhere, a table that isn't where the statement says is looked for in all databases."""
        sql = identifiers(sql.strip().rstrip(";"))
        said = guard.check(self.spark, sql)
        if self.blocking and not said.safe:
            raise Unsafe("; ".join(said.issues))
        at = {}
        for parts in said.tables:
            if (found := self.resolve(parts) or (self.resolve(parts[-1:]) if anywhere else None)) is None:
                raise LookupError(f"no such table: {'.'.join(parts)}")
            at[parts] = found
        df = self._run(sql, said, at)
        return df if limit is None else df.limit(limit)

    def everywhere(self, sql: str) -> DataFrame:
        """The statement on each database that has all its tables, united, with the column _source_database; columns that
        some lack are null there."""
        sql = identifiers(sql.strip().rstrip(";"))
        said = guard.check(self.spark, sql)
        if self.blocking and not said.safe:
            raise Unsafe("; ".join(said.issues))
        names = [parts[-1] for parts in said.tables]
        parts = []
        for db in self.databases:
            if all(db in self.holders(n) for n in names):
                at = {p: (db, next(t for t in self.databases[db] if t.lower() == p[-1].lower())) for p in said.tables}
                parts.append(self._run(sql, said, at).withColumn("_source_database", F.lit(db)))
        if not parts:
            raise LookupError("no database has all tables")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def validate(self, sql: str) -> list[str]:
        """What keeps a statement from running: guard findings, unknown tables, unknown columns. Errors count as findings."""
        try:
            self.query(sql).schema
        except (Unsafe, LookupError) as e:
            return [str(e)]
        except Exception as e:  # analysis errors come through the gateway
            return [str(e).strip().splitlines()[0]]
        return []

    def generate(self, question: str, model) -> str:
        """The statement in a model's reply to a question with the schema; one that isn't safe is refused."""
        schema = "\n".join(f"{db}.{t}({', '.join(df.columns)})" for db, tables in self.databases.items() for t, df in tables.items())
        reply = model.complete("sql", f"{schema}\n\n{question}")
        sql = self.spark.createDataFrame([(reply,)], "r string").select(extract_sql(F.col("r"))).first()[0]
        if not sql:
            raise ValueError("the reply holds no statement")
        if self.blocking and not (said := guard.check(self.spark, identifiers(sql))).safe:
            raise Unsafe("; ".join(said.issues))
        return sql

    def execute(self, action: str, **params) -> dict:
        """Service-style entry: generate (by the model given), execute, validate, get_schema or list, in an envelope with success,
        result and error."""
        actions = {
            "execute": lambda: self.query(params["sql"], params.get("limit")),
            "validate": lambda: self.validate(params["sql"]),
            "get_schema": self.catalog,
            "list": self.list,
            "generate": lambda: self.generate(params["question"], params["model"]),
        }
        if action not in actions:
            return {"success": False, "result": None, "error": f"unknown action: {action}"}
        try:
            return {"success": True, "result": actions[action](), "error": None}
        except Exception as e:
            return {"success": False, "result": None, "error": str(e).strip().splitlines()[0]}


def route_tables(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each wanted table (query_table) with the first database that has it, by db_ordinal; case doesn't matter; null
    where none has."""
    first = catalog.groupBy(F.lower("table_name").alias("__key")).agg(F.min(F.struct("db_ordinal", "db")).alias("f"))
    return wanted.join(first, F.lower("query_table") == F.col("__key"), "left").select(*wanted.columns, F.col("f.db").alias("db"))


RELAXED = re.compile(r"(\w+)\s*=\s*'([^']*)'")


def relaxations(sql: str) -> list[str]:
    """Wider forms of a statement without results, in order: equality of texts as ILIKE with wildcards, then its
    conjuncts dropped from the last on."""
    out = []
    if (soft := RELAXED.sub(r"\1 ILIKE '%\2%'", sql)) != sql:
        out.append(soft)
    m = re.search(r"\bwhere\b(.*?)(\bgroup by\b|\border by\b|\blimit\b|$)", soft, re.I | re.S)
    if m:
        parts = re.split(r"\s+and\s+", m[1].strip(), flags=re.I)
        for n in range(len(parts) - 1, -1, -1):
            where = f" WHERE {' AND '.join(parts[:n])} " if n else " "
            out.append((soft[: m.start()].rstrip() + where + soft[m.start(2) :]).strip())
    return out
