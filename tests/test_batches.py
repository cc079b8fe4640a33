import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.functions.batches import BYTES, ROWS, bounded

KEYS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES}


@pytest.mark.parametrize("name", ["html_to_text", "web_search_offline", "topk_each", "hash_embed", "enhanced_search_many"])
def test_workers_hold_bounded_batches(spark, name):
    for key in KEYS:
        spark.conf.unset(key)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    sizes = spark.range(4 * ROWS).coalesce(1).mapInPandas(lambda batches: ((pdf.assign(id=len(pdf))) for pdf in batches), "id long").agg(F.max("id")).first()[0]
    assert sizes == ROWS and all(int(spark.conf.get(k).removesuffix("b")) == most for k, most in KEYS.items())


def test_smaller_bounds_stay(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    bounded(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["html_to_text", "web_search_offline", "enhanced_search", "enhanced_search_many"])
def test_bounds_go_to_the_session_of_the_tables(spark, name):
    other = spark.newSession()
    queries.QUERIES[name](other, "/root/testdata/sf0.001")
    assert all(int(other.conf.get(k).removesuffix("b")) == most for k, most in KEYS.items())
