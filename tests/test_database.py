import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from quillon.plans.federation import Federation
from quillon.sources.database import Database, embedded, from_env, jdbc_url


@pytest.fixture(scope="module")
def branch(spark):
    db = Database(spark, "branch_test", f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    people = spark.range(1, 1001).select(F.col("id").alias("k"), (F.col("id") % 7).cast("int").alias("town"), F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 1.5).alias("paid"))
    db.save(people, "people", "k", text_length=20)
    db.save(spark.createDataFrame([(None, "x")], "a int, b string"), "loose")
    return db


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_found_with_keys_and_types(branch):
    found = {t.name: t for t in branch.tables("APP")}
    assert set(found) == {"PEOPLE", "LOOSE"} and found["PEOPLE"].key == ["k"] and found["LOOSE"].key == []
    assert [(c.name, c.type, c.nullable) for c in found["PEOPLE"].columns] == [("k", "BIGINT", False), ("town", "INTEGER", True), ("name", "VARCHAR", False), ("paid", "DOUBLE", False)]
    assert set(branch.load()) == {"people", "loose"}


def test_large_tables_are_read_in_parts_of_their_key(branch):
    tables = {t.name: t for t in branch.tables()}
    df = branch.scan(tables["PEOPLE"], rows_a_part=300)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("k"), F.count("*")).first() == (500_500, 1000)
    sizes = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 251
    assert branch.scan(tables["PEOPLE"]).rdd.getNumPartitions() == branch.scan(tables["LOOSE"]).rdd.getNumPartitions() == 1
    assert branch.scan(tables["LOOSE"]).collect() == [(None, "x")]


def test_filters_columns_and_aggregates_reach_the_database(branch):
    people = branch.load()["people"]
    few = people.where("town = 3 AND name <> 'n3'").select("k")
    assert few.count() == 142
    text = plan(few)
    assert "town = 3, NOT (name = 'n3')" in text and "ReadSchema: struct<k:bigint>" in text
    sums = people.groupBy("town").agg(F.sum("paid").alias("s"))
    assert "PushedAggregates: [SUM(paid)]" in plan(sums)
    assert sums.where("town = 0").first()["s"] == sum(1.5 * k for k in range(7, 1001, 7))


def test_one_statement_over_a_database_and_files(spark, branch, tmp_path):
    spark.range(500, 1500).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "seen"))
    fed = Federation(spark)
    fed.add("branch", branch.load())
    fed.add("lake", {"people": spark.read.parquet(str(tmp_path / "seen"))})
    df = fed.query('SELECT count(*) AS n FROM "branch".people JOIN lake.people ON branch.people.k = lake.people.k WHERE branch.people.town = 2')
    assert df.first()["n"] == sum(k % 7 == 2 for k in range(500, 1001))
    assert "town = 2" in plan(df).split("PushedFilters")[1]
    assert fed.catalog().where("db = 'branch' AND table_name = 'people'").count() == 4


def test_urls():
    assert jdbc_url("postgresql://me:p%40ss@host:5433/shop?ssl=true") == ("jdbc:postgresql://host:5433/shop?ssl=true", {"user": "me", "password": "p@ss"})
    assert jdbc_url("postgres+x://host/shop") == ("jdbc:postgresql://host/shop", {})
    assert jdbc_url("sqlite:///data/a.db") == ("jdbc:sqlite:/data/a.db", {})
    assert jdbc_url("jdbc:derby:memory:x") == ("jdbc:derby:memory:x", {})
    with pytest.raises(ValueError):
        jdbc_url("nothing")


def test_databases_of_settings(spark):
    found = from_env(spark, {"DB_SALES_URL": "postgresql://u:p@h:1/s", "DB_SHOP_TYPE": "mysql", "DB_SHOP_USERNAME": "a", "DB_SHOP_NAME": "b", "OTHER": "x"})
    assert {k: v.url for k, v in found.items()} == {"sales": "jdbc:postgresql://h:1/s", "shop": "jdbc:mysql://localhost:5432/b"}
    assert found["sales"].options == {"user": "u", "password": "p"}
    with pytest.raises(ValueError):
        Database(spark, "a b", "jdbc:x:y")


CLUSTER = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1])
    .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__
for sf in sys.argv[2:]:
    rows = __spark_entry__.queries()["jdbc_federated_join"](spark, sf).collect()
    print("FOUND", sum(r["orders"] for r in rows))
"""


def test_a_cluster_reads_the_embedded_database(tmp_path, duck):
    """Executors are other processes than the driver; and a second run in one session reads its own customers."""
    sfs = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path), *sfs], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": root})
    expected = [duck.execute(f"SELECT count(*) FROM '{sf}/customer.parquet' JOIN '{sf}/orders.parquet' ON c_custkey = o_custkey WHERE c_acctbal > 100 AND c_mktsegment <> 'BUILDING'").fetchone()[0] for sf in sfs]
    assert [int(x.split()[1]) for x in done.stdout.splitlines() if x.startswith("FOUND")] == expected, done.stderr[-2000:]


def test_an_embedded_database_keeps_values(spark):
    rows = [(1, " a,b ", 0.1), (2, 'say "x"', None), (3, "", -1e300), (4, None, 5.0), (5, "line\nnext é", 1 / 3)]
    db = embedded(spark, f"kept_{uuid.uuid4().hex}", {"loose": (spark.createDataFrame(rows, "k long, t string, x double").repartition(3), "k")}, text_length=20)
    assert sorted(map(tuple, db.load()["loose"].collect())) == rows
    assert [t.key for t in db.tables()] == [["k"]]
    with pytest.raises(ValueError, match="another database"):
        Database(spark, db.name, "jdbc:x:y")
