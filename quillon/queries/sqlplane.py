"""Statements as data, and statements run over a federation of two databases."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import table_names
from ..operators import profile as P
from ..plans import guard
from ..plans.agent import wider_search
from ..plans.federation import Federation, route_tables
from ..sources.database import embedded
from .common import STATEMENT, Registry, table

REGISTRY = Registry()
add = REGISTRY.add

SALES = ("customer", "orders", "lineitem")
SUPPLY = ("supplier", "part", "nation", "region")


def federation(spark, d) -> Federation:
    fed = Federation(spark)
    fed.add("sales", {t: table(spark, d, t) for t in SALES}, "sales_real")
    fed.add("supply", {t: table(spark, d, t) for t in SUPPLY})
    return fed


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LOW = "lower(trim(x))"
EXECUTOR = ", ".join(
    [f"CASE WHEN NOT starts_with({LOW}, 'select') THEN {_quoted(guard.NOT_SELECT)} END"]
    + [f"CASE WHEN contains({LOW}, '{w}') THEN 'Contains potentially harmful command: {w}' END" for w in guard.EXECUTOR_WORDS]
    + [f"CASE WHEN contains({LOW}, '{p}') THEN 'Contains potentially harmful pattern: {p}' END" for p in guard.EXECUTOR_PATTERNS]
)
GRAPH = " ".join(
    [f"WHEN contains({LOW}, '{w}') THEN 'Potentially harmful SQL detected: {w}'" for w in guard.GRAPH_WORDS]
    + [f"WHEN NOT (starts_with({LOW}, 'select') OR starts_with({LOW}, 'with')) THEN {_quoted(guard.NOT_READING)}"]
    + [f"WHEN regexp_matches({LOW}, {_quoted(p)}) THEN {_quoted('Potentially dangerous SQL pattern detected: ' + p)}" for p in guard.GRAPH_PATTERNS]
    + [f"WHEN length(x) - length(replace(x, ';', '')) > 1 THEN {_quoted(guard.MULTIPLE)}"]
    + [f"WHEN contains(x, '/*') OR contains(x, '--') OR contains(x, '#') THEN {_quoted(guard.COMMENTS)}"]
    + [f"WHEN regexp_matches({LOW}, '''0x[0-9a-f]+') THEN {_quoted(guard.HEXADECIMAL)}"]
)


@add("guard_executor", f"SELECT p_partkey, array_to_string(list_filter([{EXECUTOR}], lambda i: i IS NOT NULL), '|') AS issues FROM (SELECT p_partkey, {STATEMENT} AS x FROM part)")
def guard_executor(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{STATEMENT} AS x")
    return rows.select("p_partkey", F.array_join(guard.executor_issues(F.col("x")), "|").alias("issues"))


@add("guard_graph", f"SELECT p_partkey, CASE {GRAPH} END AS issue FROM (SELECT p_partkey, {STATEMENT} AS x FROM part)")
def guard_graph(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{STATEMENT} AS x")
    return rows.select("p_partkey", guard.graph_issue(F.col("x")).alias("issue"))


#: Statements that name tables in every place.
NAMING = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('SELECT a FROM sales.customer JOIN orders o ON x = ', CAST(p_size AS VARCHAR(9))) "
    "WHEN 1 THEN concat('WITH t AS (SELECT * FROM part) SELECT * FROM t WHERE x IN (SELECT y FROM t', CAST(p_size AS VARCHAR(9)), ')') "
    "WHEN 2 THEN 'insert into log_table select 1' WHEN 3 THEN concat('UPDATE Part SET a = ', chr(39), 'from nowhere', chr(39)) "
    "WHEN 4 THEN concat('SELECT * FROM (SELECT 1) z -- from remark', chr(10), 'JOIN nation ON 1 = 1') ELSE 'SELECT 1' END"
)
#: The same patterns as in table_names(), in the other engine's spelling.
BARE = r"regexp_replace(x, '(?s)''(?:[^'']|'''')*''|--[^\n]*|/\*.*?\*/', ' ', 'g')"
FOUND = rf"regexp_extract_all({BARE}, '(?i)\b(?:from|join|into|update)\s+([a-z_][\w.]*)', 1)"


@add("extract_tables", f"SELECT p_partkey, array_to_string(list_sort(list_distinct({FOUND})), ',') AS tables FROM (SELECT p_partkey, {NAMING} AS x FROM part)")
def extract_tables(spark, d):
    """Tables that statements name, a statement per part; the names are sorted here, as the other engine's array has no order."""
    rows = table(spark, d, "part").selectExpr("p_partkey", f"{NAMING} AS x")
    return rows.select("p_partkey", F.array_join(F.array_sort(table_names(F.col("x"))), ",").alias("tables"))


@add("validate_columns", "SELECT n_nationkey, n_nationkey % 5 IN (0, 4) AS valid FROM nation")
def validate_columns(spark, d):
    """A statement per nation (25 rows, whatever the scale): known and unknown columns and tables, and a write."""
    fed = federation(spark, d)
    forms = (
        "SELECT c_name FROM sales.customer WHERE c_nationkey = {}", "SELECT nope{} FROM sales.customer", "SELECT {} FROM absent",
        "DELETE FROM customer WHERE c_nationkey = {}", "SELECT s_name FROM supplier WHERE s_nationkey = {} AND s_name LIKE '%drop%'",
    )
    keys = [r[0] for r in table(spark, d, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, not fed.validate(forms[k % 5].format(k))) for k in keys], "n_nationkey int, valid boolean")


@add("federated_query", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def federated_query(spark, d):
    """Extracted, guarded, resolved and run, with a join across databases."""
    return federation(spark, d).query(
        "SELECT n.n_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM sales.customer c JOIN supply.public.nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal > 0 GROUP BY n.n_name;"
    )


@add("cross_db_join", "SELECT p_brand, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_returnflag")
def cross_db_join(spark, d):
    return federation(spark, d).query("SELECT part.p_brand, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM sales.lineitem, supply.part WHERE l_partkey = supply.part.p_partkey GROUP BY part.p_brand, l_returnflag")


@add("federated_union", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, 'sales' AS _source_database FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supply' FROM supplier")
def federated_union(spark, d):
    """One view name in two databases, with columns that one of them lacks."""
    fed = Federation(spark)
    fed.add("sales", {"party": table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS segment")})
    fed.add("supply", {"party": table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")})
    return fed.everywhere("SELECT * FROM party")


@add(
    "federated_namesakes",
    "SELECT c_nationkey AS k, count(*) AS pairs, round(sum(c_acctbal - s_acctbal), 2) AS gap FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal > s_acctbal WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 4) GROUP BY c_nationkey",
)
def federated_namesakes(spark, d):
    """Tables of one name in two databases, compared by their full names, in quotes and not, also from a subquery. Pairs aren't made, since there are as many as
    the product of both tables: along the balances of a nation, a customer has as many pairs as suppliers stand before it (equal balances: customers first)."""
    fed = federation(spark, d)
    fed.databases["sales"] |= {"party": table(spark, d, "customer").selectExpr("c_nationkey AS k", "c_acctbal AS balance")}
    fed.databases["supply"] |= {"party": table(spark, d, "supplier").selectExpr("s_nationkey AS k", "s_acctbal AS balance")}
    return fed.query(
        "SELECT k, sum(below) AS pairs, round(sum(balance * below - owed), 2) AS gap FROM (SELECT k, balance, side, "
        "sum(side) OVER (PARTITION BY k ORDER BY balance, side ROWS UNBOUNDED PRECEDING) AS below, "
        "sum(CASE WHEN side = 1 THEN balance END) OVER (PARTITION BY k ORDER BY balance, side ROWS UNBOUNDED PRECEDING) AS owed FROM ("
        'SELECT sales.party.k, sales.party.balance, 0L AS side FROM "sales"."party" WHERE sales.party.balance IS NOT NULL '
        'UNION ALL SELECT supply.public.party.k, "supply"."public"."party"."balance", 1L FROM supply.public.party WHERE supply.public.party.balance IS NOT NULL) both_sides '
        "WHERE EXISTS (SELECT 1 FROM nation WHERE nation.n_nationkey = k AND n_regionkey < 4)) ranked WHERE side = 0 AND below > 0 GROUP BY k"
    )


@add(
    "jdbc_federated_join",
    "SELECT c_mktsegment, c_nationkey, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 100 AND c_mktsegment <> 'BUILDING' GROUP BY ALL",
)
def jdbc_federated_join(spark, d):
    """All customers in a database behind JDBC (an embedded one, in a file that all executors read), found through its metadata and joined with Parquet."""
    db = embedded(spark, f"branch_{uuid.uuid4().hex}", {"customer": (table(spark, d, "customer"), "c_custkey")})
    fed = federation(spark, d)
    fed.add("branch", db.load())
    return fed.query(
        'SELECT c.c_mktsegment, c.c_nationkey, count(*) AS orders, round(sum(o_totalprice), 2) AS price FROM "branch"."customer" c JOIN sales.orders ON c.c_custkey = sales.orders.o_custkey '
        "WHERE c.c_acctbal > 100 AND c.c_mktsegment <> 'BUILDING' GROUP BY c.c_mktsegment, c.c_nationkey"
    )


@add(
    "wider_forms",
    "SELECT 'part' AS source, p_partkey AS k FROM part WHERE p_name ILIKE '%ring%' AND p_size > 30 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderpriority ILIKE '%urgent%' AND o_totalprice > 100000 "
    "UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_acctbal BETWEEN -15000 AND -5000 OR (NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal BETWEEN -15000 AND -5000) AND c_mktsegment ILIKE '%building%')",
)
def wider_forms(spark, d):
    """Statements that give nothing: a conjunct of the first has to go, a text of the second to match in part, a range of the third to go."""
    fed = federation(spark, d)
    statements = {
        "part": "SELECT p_partkey AS k FROM supply.part WHERE p_name = 'ring' AND p_type = 'absent' AND p_size > 30",
        "orders": "SELECT o_orderkey AS k FROM sales.orders WHERE o_orderpriority = 'urgent' AND o_totalprice > 100000",
        "customer": "SELECT c_custkey AS k FROM sales.customer WHERE c_mktsegment = 'building' AND c_acctbal = -10000",
    }
    found = [wider_search(fed, sql)[1].select(F.lit(source).alias("source"), "k") for source, sql in statements.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@add("sql_ilike_concat", "SELECT c_custkey, c_name || ' / ' || c_mktsegment AS label FROM customer WHERE c_name ILIKE '%CUSTOMER#00000012%' AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def sql_ilike_concat(spark, d):
    return federation(spark, d).query("SELECT c_custkey, c_name || ' / ' || c_mktsegment AS label FROM customer WHERE c_name ILIKE '%CUSTOMER#00000012%' AND c_mktsegment IN ('BUILDING', 'MACHINERY')")


COLUMNS = {
    "region": ("r_regionkey int", "r_name string"),
    "nation": ("n_nationkey int", "n_name string", "n_regionkey int"),
    "supplier": ("s_suppkey bigint", "s_name string", "s_nationkey int", "s_acctbal double"),
}


def _catalog_sql() -> str:
    rows = ", ".join(f"('{t}', '{c.split()[0]}', {i}, '{c.split()[1]}')" for t, cols in COLUMNS.items() for i, c in enumerate(cols))
    return f"(VALUES {rows}) v(table_name, column_name, ordinal, data_type)"


@add("format_schema", f"SELECT table_name, 'Table: ' || table_name || chr(10) || string_agg('  - ' || column_name || ' (' || data_type || ')', chr(10) ORDER BY ordinal) AS text FROM {_catalog_sql()} GROUP BY table_name")
def format_schema(spark, d):
    return P.schema_text(P.catalog({t: table(spark, d, t) for t in COLUMNS}, spark))


ALL = {"sales": SALES, "supply": SUPPLY}


@add("tables_by_db", "SELECT * FROM (VALUES ('sales', 'customer, lineitem, orders'), ('supply', 'nation, part, region, supplier')) v(db, tables)")
def tables_by_db(spark, d):
    return P.tables_by_db(federation(spark, d).catalog())


@add("catalog_alias", "SELECT * FROM (VALUES ('sales', 'sales_real', 'customer'), ('sales', 'sales_real', 'orders'), ('sales', 'sales_real', 'lineitem'), ('supply', 'supply', 'supplier'), ('supply', 'supply', 'part'), ('supply', 'supply', 'nation'), ('supply', 'supply', 'region')) v(db, real_db, table_name)")
def catalog_alias(spark, d):
    """Databases by their real names; those without one keep the alias."""
    fed = federation(spark, d)
    names = spark.createDataFrame(list(fed.aliases.items()), "alias string, real string")
    tables = fed.catalog().select("db", "table_name").distinct()
    return tables.join(names, F.col("db") == F.col("alias"), "left").select("db", F.coalesce("real", "db").alias("real_db"), "table_name")


@add("table_routing", "SELECT * FROM (VALUES ('CUSTOMER', 'sales'), ('part', 'supply'), ('Nation', 'supply'), ('absent', NULL)) v(query_table, db)")
def table_routing(spark, d):
    fed = federation(spark, d)
    order = spark.createDataFrame(list(enumerate(fed.list())), "db_ordinal int, db string")
    catalog = fed.catalog().select("db", "table_name").distinct().join(order, "db")
    wanted = spark.createDataFrame([("CUSTOMER",), ("part",), ("Nation",), ("absent",)], "query_table string")
    return route_tables(wanted, catalog)


@add("db_reload_diff", "SELECT * FROM (VALUES ('added', 'archive'), ('removed', 'supply')) v(change, db)")
def db_reload_diff(spark, d):
    fed = federation(spark, d)
    added, gone = fed.reload({"sales": fed.databases["sales"], "archive": {}})
    return spark.createDataFrame([("added", x) for x in added] + [("removed", x) for x in gone], "change string, db string")


@add("classify_columns", f"SELECT table_name, column_name, CASE WHEN regexp_matches(c, 'email') THEN 'email' WHEN regexp_matches(c, 'phone|tel|mobile|contact') THEN 'phone' WHEN regexp_matches(c, 'date|created|updated|modified|timestamp') THEN 'date' END AS class, contains(c, 'name') AS is_name FROM (SELECT *, lower(column_name) AS c FROM {_catalog_sql()} UNION ALL SELECT 'orders', x, 0, '', x FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) o(x))")
def classify_columns(spark, d):
    cat = P.catalog({t: table(spark, d, t) for t in (*COLUMNS, "orders")}, spark)
    return cat.select("table_name", "column_name", P.column_class(F.col("column_name")).alias("class"), P.is_name(F.col("column_name")).alias("is_name"))


@add("profile_dates", "SELECT 'o_orderdate' AS column_name, CAST(min(o_orderdate) AS VARCHAR) AS min_value, CAST(max(o_orderdate) AS VARCHAR) AS max_value, count(o_orderdate) AS non_null FROM orders")
def profile_dates(spark, d):
    return P.date_ranges(table(spark, d, "orders"), ["o_orderdate"])


@add("profile_names", "SELECT name FROM (SELECT name, min(pos) AS pos FROM ((SELECT DISTINCT c_name AS name, 0 AS pos FROM customer ORDER BY c_name LIMIT 50) UNION ALL (SELECT DISTINCT c_mktsegment, 1 FROM customer ORDER BY c_mktsegment LIMIT 50)) GROUP BY name) ORDER BY pos, name LIMIT 20")
def profile_names(spark, d):
    return P.sample_names(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


MAIL = "CASE c_custkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN concat(c_name, '@') WHEN 2 THEN concat('a@', lower(c_mktsegment), '.org@x') ELSE concat('u@host', CAST(c_nationkey AS VARCHAR(9)), '.com') END"


@add("profile_email_domains", f"SELECT DISTINCT split_part(m, '@', 2) AS domain FROM (SELECT {MAIL} AS m FROM customer) WHERE split_part(m, '@', 2) <> ''")
def profile_email_domains(spark, d):
    return P.email_domains(table(spark, d, "customer").selectExpr(f"{MAIL} AS m"), "m")
