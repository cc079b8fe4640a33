"""Registry, tables, and expressions that both engines read alike: they make inputs of the needed shape from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def put(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Service ids of all kinds, from events.
SERVICE = (
    "CASE event_id % 9 WHEN 0 THEN 'sql-server' WHEN 1 THEN 'Main-Database' WHEN 2 THEN 'brave-search' WHEN 3 THEN 'Web-Fetch' "
    "WHEN 4 THEN 'rag-store' WHEN 5 THEN 'dns-resolver' WHEN 6 THEN 'download-svc' WHEN 7 THEN 'vector-index' ELSE 'misc-tool' END"
)
#: Metadata of documents: upload method (some unknown), file id (some missing), stored path (some empty).
METHOD = "CASE doc_id % 4 WHEN 0 THEN 'Web upload' WHEN 1 THEN 'Local' WHEN 2 THEN 'Processed JSON Import' END"
FILE_ID = "CASE WHEN doc_id % 3 <> 1 THEN concat('f', CAST(doc_id AS VARCHAR(20))) END"
STORED = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('store/', source, '/', CAST(doc_id AS VARCHAR(20)), '.txt') END"
#: Statements, safe and unsafe, from parts.
STATEMENT = (
    "CASE p_partkey % 12 WHEN 0 THEN concat('SELECT p_name FROM part WHERE p_partkey = ', CAST(p_partkey AS VARCHAR(20))) "
    "WHEN 1 THEN 'DROP TABLE part' WHEN 2 THEN 'select * from orders where created_at > 1' "
    "WHEN 3 THEN 'WITH x AS (SELECT 1 AS a) SELECT a FROM x' WHEN 4 THEN 'SELECT a FROM t UNION SELECT b FROM u; DELETE FROM t;' "
    "WHEN 5 THEN 'SELECT concat(a, b) FROM t -- tail' WHEN 6 THEN 'SELECT * FROM information_schema.tables' "
    "WHEN 7 THEN 'UPDATE part SET p_size = 1' WHEN 8 THEN 'EXPLAIN SELECT 1' WHEN 9 THEN 'SELECT a /* note */ FROM t' "
    "WHEN 10 THEN concat('SELECT a FROM t WHERE b = ', chr(39), '0xFF', chr(39)) ELSE 'SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey' END"
)
#: Replies that hold a statement, in every form.
REPLY = (
    "CASE p_partkey % 9 WHEN 0 THEN concat('Sure. <sql_generated> SELECT ', CAST(p_partkey AS VARCHAR(20)), '; </sql_generated> done') "
    "WHEN 1 THEN concat('###ponder### SELECT 0 ###/ponder###', chr(10), '<sql_query>SELECT ', CAST(p_size AS VARCHAR(20)), ' FROM part</sql_query>') "
    "WHEN 2 THEN '<sql>SELECT a FROM t -- why</sql> and <sql_code>SELECT * FROM orders LIMIT 10;</sql_code>' "
    "WHEN 3 THEN concat('Here: {\"sql_query\": \"SELECT ', CAST(p_partkey AS VARCHAR(20)), ' AS k\", \"note\": \"x\"} bye') "
    "WHEN 4 THEN '{\"plan\": {\"sql_query\": \"no\", \"deep\": {\"a\": {}}}, \"sql_query\": \" SELECT 4; \"}' "
    "WHEN 5 THEN concat('Try', chr(10), '```sql', chr(10), 'SELECT p_brand FROM part', chr(10), '```', chr(10), 'ok') "
    "WHEN 6 THEN concat('<thinking>SELECT 1</thinking>  SELECT p_name FROM part WHERE p_name = ', chr(92), chr(39), 'red', chr(92), chr(39), ' ;; ') "
    "WHEN 7 THEN 'SELECT a; SELECT b;' ELSE concat('SELECT p_type /* all */ FROM part', chr(10), ';') END"
)
