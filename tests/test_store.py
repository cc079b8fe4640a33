import pytest
from pyspark.sql import functions as F

from quillon.sources.files import Collection
from quillon.sources.store import Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "s"), "k", buckets=4)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string")


def held(df):
    return dict(map(tuple, df.select("k", "v").collect()))


def test_repeated_upserts_leave_one_row_for_each_key(spark, store):
    with pytest.raises(LookupError):
        store.read()
    assert store.upsert(rows(spark, [(i, "a") for i in range(40)])) == 1
    assert store.upsert(rows(spark, [(i, "b") for i in range(30, 60)])) == 2
    assert store.upsert(rows(spark, [(7, "c"), (7, "d"), (99, None)]), order="v") == 3
    want = {i: "a" for i in range(30)} | {i: "b" for i in range(30, 60)} | {7: "d", 99: None}
    assert held(store.read()) == want and store.read().count() == 61
    assert held(store.read(1)) == {i: "a" for i in range(40)}
    assert held(store.find([7, 99, 1000])) == {7: "d", 99: None}
    assert store.delete(rows(spark, [(7, ""), (8, ""), (5000, "")])) == 4 and len(held(store.read())) == 59


def test_only_touched_buckets_are_written(spark, store):
    store.upsert(rows(spark, [(i, "a") for i in range(100)]))
    before = store.manifest()["buckets"]
    store.upsert(rows(spark, [(1, "z")]))
    after = store.manifest()["buckets"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert store.upsert(rows(spark, [])) == 2 and store.versions() == [1, 2]
    assert len(store.find([1]).inputFiles()) < len(store.read().inputFiles())


def test_a_killed_change_is_never_seen(spark, store):
    store.upsert(rows(spark, [(i, "a") for i in range(20)]))
    reader = store.read()
    broken = rows(spark, [(i, "b") for i in range(20)]).withColumn("v", F.when(F.col("k") == 13, F.raise_error(F.lit("killed"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        store.upsert(broken)
    assert store.versions() == [1] and set(held(store.read()).values()) == {"a"}
    store.upsert(rows(spark, [(i, "c") for i in range(20)]))
    assert set(held(reader).values()) == {"a"} and set(held(store.read()).values()) == {"c"}  # a reader keeps its version
    assert store.vacuum() >= 1 and set(held(store.read()).values()) == {"c"} and store.versions() == [2]


def test_of_two_changes_from_one_version_the_second_fails(spark, store):
    store.upsert(rows(spark, [(1, "a")]))
    old = store.manifest()
    other = Store(spark, store.path, "k", buckets=4)
    other.manifest = lambda version=None: old
    store.upsert(rows(spark, [(1, "b")]))
    with pytest.raises(Conflict):
        other.upsert(rows(spark, [(1, "c")]))
    assert held(store.read()) == {1: "b"}


def test_keys_and_columns_are_checked(spark, store):
    with pytest.raises(Exception, match="k is null"):
        store.upsert(rows(spark, [(None, "a")]))
    assert store.versions() == []
    store.upsert(rows(spark, [(1, "a")]))
    with pytest.raises(ValueError, match="columns"):
        store.upsert(spark.createDataFrame([(1, 2)], "k long, w int"))
    assert store.upsert(spark.createDataFrame([("x", 2)], "v string, k int")) == 2


def test_collections_with_ids_upsert(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), 2, key="id")
    v = lambda *r: spark.createDataFrame(list(r), "id string, embedding array<double>")
    assert c.count() == 0
    c.add(v(("a", [1.0, 0.0]), ("b", [0.0, 1.0])))
    c.add(v(("a", [0.5, 0.5])))
    c.add(v(("x", [2.0, 2.0])).drop("id"))
    assert c.count() == 3 and c.read().where("id = 'a'").first()["embedding"] == [0.5, 0.5]
    with pytest.raises(Exception, match="dimension must be 2"):
        c.add(v(("a", [1.0])))
    c.clear()
    assert c.count() == 0
    c.add(v(("z", [1.0, 1.0])), recreate=True)
    assert c.count() == 1
    c.drop()
    assert not c.exists()
