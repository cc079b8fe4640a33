"""Relational operators that statements ask for."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.matching import holding
from .common import Registry, table

REGISTRY = Registry()
add = REGISTRY.add


@add("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def join_inner(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.join(table(spark, d, "customer"), o.o_custkey == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@add("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY c_custkey")
def join_left(spark, d):
    """The big side is aggregated first: a row per customer meets the customers."""
    n = table(spark, d, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@add("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000")
def join_right(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000")
    return s.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


@add("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 1450")
def join_full(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") + 1450).alias("k"))
    return table(spark, d, "customer").join(s, F.col("c_custkey") == F.col("k"), "full").select("c_custkey", "s_suppkey")


@add("fuzzy_name_join", "SELECT DISTINCT p_partkey, c FROM part, (SELECT DISTINCT split_part(p_name, ' ', 1) AS c FROM part) n WHERE lower(p_name) LIKE concat('%', lower(c), '%')")
def fuzzy_name_join(spark, d):
    part = table(spark, d, "part")
    names = part.select(F.split("p_name", " ")[0].alias("c"))
    return holding(part.select("p_partkey", "p_name"), "p_name", names, "c").select("p_partkey", "c")


@add(
    "indexed_name_join",
    "SELECT item_id, name FROM (SELECT item_id, lower(text) AS t FROM benchmark) b, (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part UNION SELECT DISTINCT substr(text, 1 + item_id % 40, 2 + item_id % 9) FROM benchmark) n WHERE contains(t, lower(name))",
)
def indexed_name_join(spark, d):
    """By an inverted index of grams, whatever the list's length: pieces of texts, from two to ten characters, and words."""
    b = table(spark, d, "benchmark")
    pieces = b.select(F.expr("substr(text, cast(1 + item_id % 40 as int), cast(2 + item_id % 9 as int))").alias("name"))
    names = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("name")).unionAll(pieces)
    return holding(b.select("item_id", "text"), "text", names, "name", short=0).select("item_id", "name")


@add("concat_key_join", "SELECT a.p_partkey, b.l_orderkey FROM part a JOIN lineitem b ON a.p_brand || '-' || a.p_partkey = 'Brand#' || (b.l_partkey % 25 + 1) || '-' || b.l_partkey")
def concat_key_join(spark, d):
    a = table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("k"))
    b = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("Brand#"), (F.col("l_partkey") % 25 + 1).cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("k"))
    return a.join(b, "k").select("p_partkey", "l_orderkey")


@add("join_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def join_semi_anti(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey")
    cond = F.col("c_custkey") == F.col("o_custkey")
    return c.join(o, cond, "left_semi").withColumn("has_orders", F.lit(True)).unionAll(c.join(o, cond, "left_anti").withColumn("has_orders", F.lit(False)))


@add("join_asof", "SELECT a.event_id, b.event_id AS before_id FROM events a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'error'")
def join_asof(spark, d):
    """The last purchase of the user up to each error: both kinds are sorted once per user, none is joined."""
    e = table(spark, d, "events").where("event_type in ('error', 'purchase')")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "purchase", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("before_id", last).where("event_type = 'error'").select("event_id", "before_id")


@add("agg_basic", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS discount, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def agg_basic(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@add("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
def agg_group(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    got = rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return got.where("n > 10")


@add("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@add("distinct_basic", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_basic(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@add("sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def sort_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@add("sort_random")
def sort_random(spark, d):
    return table(spark, d, "nation").orderBy(F.rand(7)).limit(1)


@add("window_rank", "SELECT o_orderkey, o_custkey, CAST(rank() OVER w AS INT) AS r, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def window_rank(spark, d):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.rank().over(w).alias("r"), F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("running"))


@add("set_operations", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return both.subtract(table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey"))
