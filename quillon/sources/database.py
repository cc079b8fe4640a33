"""Databases behind JDBC: discovery of their tables, parallel scans, and pushdown into them.

A database is registered as a catalog of the session, so that filters, projections, aggregates, sorts and limits of a plan reach it as SQL.
Tables are found through the connection's metadata. Large ones are read in parts, bounded by the least and largest value of an integer key,
which the database itself computes.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import databases_from_env
from .store import scratch

#: Rows that one task reads of a table.
ROWS_A_PART = 1_000_000
#: Parts of a table, and so connections at once, at most.
PARTS = 64
CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
INTEGERS = ("smallint", "int", "bigint", "tinyint")
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@dataclass
class Column:
    name: str
    type: str
    nullable: bool
    comment: str


@dataclass
class Table:
    schema: str
    name: str
    columns: list[Column]
    #: Columns of the primary key, in its order.
    key: list[str] = field(default_factory=list)
    comment: str = ""


class Database:
    """One database by its JDBC URL. name: a catalog name of the session; options: user, password, driver and the like."""

    def __init__(self, spark: SparkSession, name: str, url: str, **options: str):
        if not re.fullmatch(r"[A-Za-z]\w*", name):
            raise ValueError(f"bad catalog name: {name}")
        if spark.conf.get(f"spark.sql.catalog.{name}.url", url) != url:  # the session keeps a catalog that was used, and would go on reading it
            raise ValueError(f"the session has a catalog {name} of another database")
        self.spark, self.name, self.url, self.options = spark, name, url, options
        conf = {"": CATALOG, ".url": url, ".pushDownAggregate": "true", ".pushDownLimit": "true", ".pushDownOffset": "true"}
        for k, v in (conf | {f".{k}": v for k, v in options.items()}).items():
            spark.conf.set(f"spark.sql.catalog.{name}{k}", v)

    def _connection(self):
        jvm = self.spark._jvm
        if driver := self.options.get("driver"):
            jvm.java.lang.Class.forName(driver)
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, properties)

    def tables(self, schema: str | None = None) -> list[Table]:
        """The tables of a schema (None: of all but the system's), with columns, keys and comments; reads metadata only."""
        con = self._connection()
        try:
            meta = con.getMetaData()

            def rows(result, *names: str):
                try:
                    while result.next():
                        yield tuple(result.getString(n) for n in names)
                finally:
                    result.close()

            jvm = self.spark._jvm
            kinds = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
            kinds[0] = "TABLE"
            found = []
            for s, t, note in sorted(rows(meta.getTables(None, schema, "%", kinds), "TABLE_SCHEM", "TABLE_NAME", "REMARKS")):
                columns = [Column(c, kind, null != "NO", text or "") for c, kind, null, text in rows(meta.getColumns(None, s, t, "%"), "COLUMN_NAME", "TYPE_NAME", "IS_NULLABLE", "REMARKS")]
                keyed = sorted((int(n), c) for c, n in rows(meta.getPrimaryKeys(None, s, t), "COLUMN_NAME", "KEY_SEQ"))
                found.append(Table(s, t, columns, [c for _, c in keyed], note or ""))
            return found
        finally:
            con.close()

    def scan(self, table: Table, rows_a_part: int = ROWS_A_PART) -> DataFrame:
        """A table, whose columns have the metadata's comments. One with an integer first key column and more than rows_a_part rows is
        read in parts of its range (at most PARTS); others by one task. Names are lower-case where they would be without quotes."""
        full = ".".join(f"`{x}`" for x in (self.name, table.schema, table.name))
        whole = self.spark.read.table(full)
        reader = self.spark.read
        if table.key and dict(whole.dtypes)[table.key[0]] in INTEGERS:
            key = F.col(f"`{table.key[0]}`")
            low, high, n = whole.agg(F.min(key), F.max(key), F.count("*")).first()  # computed by the database
            if (parts := min(PARTS, -(-n // rows_a_part), (high or 0) - (low or 0) + 1)) > 1:
                reader = reader.options(partitionColumn=table.key[0], lowerBound=low, upperBound=high + 1, numPartitions=parts)
        notes = {c.name: c.comment for c in table.columns}
        named = [F.col(f"`{c}`").alias(c.lower() if c == c.upper() else c, metadata={"comment": notes.get(c, "")}) for c in whole.columns]
        return reader.table(full).select(named)

    def load(self, schema: str | None = None, rows_a_part: int = ROWS_A_PART) -> dict[str, DataFrame]:
        """All tables by name, as a federation takes them. Tables of one name in several schemas are named schema_table."""
        found = self.tables(schema)
        low = lambda x: x.lower() if x == x.upper() else x
        often = {t.name for t in found if sum(t.name == o.name for o in found) > 1}
        return {low(f"{t.schema}_{t.name}" if t.name in often else t.name): self.scan(t, rows_a_part) for t in found}

    def save(self, df: DataFrame, table: str, key: str | None = None, mode: str = "overwrite", text_length: int | None = None) -> None:
        """df as a table of the database, with a primary key where one is named (of a column without nulls). Texts are of the database's
        unbounded type, which some can't compare, or of text_length characters at most."""
        writer = df.write.mode(mode)
        if text_length and (texts := [c for c, t in df.dtypes if t == "string"]):
            writer = writer.option("createTableColumnTypes", ", ".join(f"`{c}` VARCHAR({text_length})" for c in texts))
        writer.jdbc(self.url, table, properties=self.options)
        if key:
            self._execute(f'ALTER TABLE {table} ALTER COLUMN "{key}" NOT NULL', f'ALTER TABLE {table} ADD PRIMARY KEY ("{key}")')

    def _execute(self, *statements: str) -> None:
        con = self._connection()
        try:
            for sql in statements:
                con.createStatement().execute(sql)
        finally:
            con.close()


def embedded(spark: SparkSession, name: str, tables: dict[str, tuple[DataFrame, str | None]], text_length: int = 256) -> Database:
    """An embedded (Derby) database of tables, each with its primary key (or None), that the driver and all executors can read.

    An embedded database lives in one process, and executors are others. So tasks write the tables as files, the driver's database imports
    these one by one (it holds some pages of them, never a table), and is closed and stored in one file of the shared folder, where any number
    of processes may open it at once, for reading only. Texts have text_length characters at most; a longer one is an error."""
    shared = scratch(spark)
    place = re.sub("^file:/*", "/", shared)
    if re.match(r"[a-z0-9]+:", place):
        raise ValueError(f"an embedded database is read from a file system, not from {shared}")
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    with tempfile.TemporaryDirectory(prefix="quillon-db-") as own:
        made = Database(spark, f"made_{uuid.uuid4().hex}", f"jdbc:derby:{own}/db;create=true", driver=DERBY)
        for table, (df, key) in tables.items():
            made.save(spark.createDataFrame([], df.schema), table, text_length=text_length)  # no rows, so no task
            df.write.csv(f"{shared}/{table}", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue='""')
            for part in sorted(x for x in os.listdir(f"{place}/{table}") if x.startswith("part-")):
                made._execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, {quoted(table.upper())}, {quoted(f'{place}/{table}/{part}')}, NULL, NULL, 'UTF-8', 0)")
            shutil.rmtree(f"{place}/{table}")
            if key:
                made._execute(f'ALTER TABLE {table} ALTER COLUMN "{key}" NOT NULL', f'ALTER TABLE {table} ADD PRIMARY KEY ("{key}")')
        try:
            spark._jvm.java.sql.DriverManager.getConnection(f"jdbc:derby:{own}/db;shutdown=true")
        except Py4JJavaError as e:
            if e.java_exception.getSQLState() != "08006":  # what it throws when it has closed the database
                raise
        with zipfile.ZipFile(f"{place}/db.jar", "w", zipfile.ZIP_STORED) as jar:  # stored, so that a page is found without reading those before
            for folder, _, files in os.walk(f"{own}/db"):
                for f in files:
                    if not f.endswith(".lck"):
                        jar.write(full := os.path.join(folder, f), os.path.relpath(full, own))
    return Database(spark, name, f"jdbc:derby:jar:({place}/db.jar)db", driver=DERBY)


def jdbc_url(url: str) -> tuple[str, dict[str, str]]:
    """A database URL (scheme://user:password@host:port/name, or JDBC already) for JDBC, and its credentials as options."""
    if url.startswith("jdbc:"):
        return url, {}
    parts = urlsplit(url)
    scheme = {"postgres": "postgresql"}.get(kind := parts.scheme.split("+")[0], kind)
    if not scheme:
        raise ValueError("a database URL has a scheme")
    if scheme == "sqlite":
        return f"jdbc:sqlite:{parts.path}", {}
    place = (parts.hostname or "localhost") + (f":{parts.port}" if parts.port else "")
    said = {"user": parts.username, "password": parts.password}
    return f"jdbc:{scheme}://{place}{parts.path}" + (f"?{parts.query}" if parts.query else ""), {k: unquote(v) for k, v in said.items() if v}


def from_env(spark: SparkSession, env: Mapping[str, str]) -> dict[str, Database]:
    """The databases that settings name (see databases_from_env), by name."""
    made = {name: jdbc_url(url) for name, url in databases_from_env(env).items()}
    return {name: Database(spark, re.sub(r"\W", "_", name), url, **options) for name, (url, options) in made.items()}
