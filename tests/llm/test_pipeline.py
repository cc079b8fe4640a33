import corpus_pipeline
from conftest import SF
from helpers import AWKWARD, docs

from quillon.llm import queries


def test_stages(spark, tmp_path):
    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = kept.columns, kept.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == columns
            m = out.count()
            assert m == n if name in ("line_dedup", "substring_dedup") else 0.5 * n < m < n
            kept, n = out, m
    assert set(r[0] for r in out.select("doc_id").distinct().collect()) == set(r[0] for r in kept.select("doc_id").collect())
    again = corpus_pipeline.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert again.select(cols).exceptAll(out.select(cols)).count() == 0 and again.count() == out.count()


def test_stages_on_awkward_documents(spark):
    for data in (AWKWARD, []):
        kept = docs(spark, data)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, kept, SF)
            kept = spark.createDataFrame(out.collect(), out.schema)
        assert kept.count() >= len(data) // 3


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
