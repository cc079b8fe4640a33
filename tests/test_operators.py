"""Edges of the core operators on small inline rows: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from quillon.operators import documents as D
from quillon.operators import normalize as N
from quillon.operators import profile as P
from quillon.operators import retrieval as R
from quillon.operators import routing as G
from quillon.operators import toolcalls as C
from quillon.operators.validation import errors

VECTORS = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.9, 0.1]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [-1.0, 0.0])]


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")


def test_top_k_ties_and_missing_vectors(vectors):
    scored = R.scored(vectors, vectors.where("vec_id = 1"))
    assert [r["vec_id"] for r in R.top_k(scored, 3).collect()] == [1, 2, 3]
    assert [r["vec_id"] for r in R.over_threshold(R.top_k(scored, 7), 0.3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        R.scored(vectors, vectors)


def test_rerank_and_relevance(spark, vectors):
    ranked = vectors.withColumn("original_rank", 10 - F.col("vec_id"))
    assert [r["vec_id"] for r in R.rerank(ranked, vectors.where("vec_id = 4"), 3).collect()] == [4, 3, 2]
    none = spark.createDataFrame([], "score double")
    assert tuple(R.mean_relevance(none).first()) == (0.0, 0)
    assert tuple(R.mean_relevance(spark.createDataFrame([(1.0,), (None,)], "score double")).first()) == (0.5, 2)


def test_mmr_prefers_what_is_new(vectors):
    scored = R.scored(vectors, vectors.where("vec_id = 1"))
    picked = [r["vec_id"] for r in R.diverse(scored.where("vec_id <= 4"), 3, weight=0.3).orderBy("mmr_rank").collect()]
    assert picked[0] == 1 and len(set(picked)) == 3 and 4 in picked
    assert R.diverse(scored.where("false"), 3).count() == 0


def test_many_queries_in_blocks(vectors):
    queries = vectors.where("vec_id in (1, 4)").selectExpr("vec_id AS query_id", "embedding AS vector")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.top_k_each(vectors, queries, 2, rows=2, asked=1).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (4, 1): 4, (4, 2): 2}
    assert R.top_k_each(vectors, queries.where("false")).count() == 0


def test_hits_meet_documents(spark, vectors):
    docs = spark.createDataFrame([(1, "a"), (9, "b")], "doc_id long, t string")
    got = R.with_documents(vectors.select("vec_id").limit(2), docs).orderBy("vec_id").collect()
    assert [(r["vec_id"], r["t"]) for r in got] == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        R.with_documents(vectors, docs, most=3)


def test_merges_keep_what_has_no_original(spark):
    o = spark.createDataFrame([(1, "u", "c", "T1"), (2, "u", "c", "T2"), (3, None, None, "T3")], "ordinal long, url string, content string, title string")
    by_url = R.merge_by_url(spark.createDataFrame([("u", 1.0), ("x", 0.5), (None, 0.1)], "url string, score double"), o)
    assert {(r["url"], r["title"]) for r in by_url.collect()} == {("u", "T2"), ("x", ""), (None, "")}
    by_content = R.merge_by_content(spark.createDataFrame([("c", 1), ("x", 2)], "content string, rank int"), o.withColumnRenamed("url", "source"))
    assert {(r["rank"], r["title"]) for r in by_content.collect()} == {(1, "T1"), (2, None)}


def test_document_metadata(spark):
    rows = spark.createDataFrame([("", None, None), ("s", "t", "m"), (None, "", "")], "source string, title string, upload_method string")
    assert {tuple(r) for r in D.fill_metadata(rows).collect()} == {("unknown", "Untitled Document", "Local"), ("s", "t", "m")}
    names = spark.createDataFrame([("a.PDF", 1), ("a.exe", 1), ("b.txt", D.MAX_BYTES + 1), ("none", 1)], "n string, s long")
    assert [r[0] for r in names.select(D.upload_reason(F.col("n"), F.col("s"))).collect()] == [None, "extension not allowed", "file too large", "extension not allowed"]


def test_imports_are_split_from_rejects(spark):
    rows = spark.createDataFrame([('{"document":"d","chunks":[{"content":"c","x":1}]}',), ('{"chunks":[]}',), ('{"document":"d"}',), ("junk",), (None,), ('{"document":"d","chunks":[{}]}',)], "payload string")
    good, bad = D.import_chunks(rows)
    [r] = good.collect()
    assert (r["document"], r["content"], r["title"], r["chunk_id"], r["extra"]) == ("d", "c", "d", 0, {"x": "1"})
    assert sorted(r["reason"] for r in bad.collect()) == ["a chunk has no content", "chunks are missing", "document is missing", "document is missing", "document is missing"]


def test_calls(spark):
    services = "sql-a Search rag dns DOWNLOAD other".split() + [None]
    df = spark.createDataFrame([(s,) for s in services], "s string")
    flags = {"sql": False, "download": False, "rag": False}
    assert [r[0] for r in df.select(C.enabled(F.col("s"), flags)).collect()] == [False, True, True, True, False, True, True]
    assert [r[0] for r in df.select(C.enabled(F.col("s"), flags, with_rag=True)).collect()][2] is False
    assert [r[0] for r in df.select(C.priority(F.col("s"))).collect()] == [2, 0, 1, 3, 4, 4, 4]
    bad = spark.createDataFrame([("{broken",), ("",), (None,), ("7",)], "j string")
    assert {r[0] for r in bad.select(C.validated(F.col("j"))).collect()} == {None}
    assert {r[0] for r in bad.select(C.wrapped(F.col("j"))).collect()} == {None}
    done = spark.createDataFrame([("success", "x"), ("success", ""), ("success", None), ("error", "x"), (None, None)], "status string, result string")
    assert tuple(C.outcomes(done).first()) == (1, 4, 5)


def test_unified_rows_never_drop_one(spark):
    raws = ["junk", None, "[]", "{}", '{"service_id":"web-1","results":[{"url":"http://a/x"}]}', '{"service_id":"rag","content":"c"}', '{"service_id":"file-get","status":"error"}']
    df = N.normalized(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "n int, raw string")).orderBy("n")
    got = df.collect()
    assert [r["source_type"] for r in got] == ["generic", "generic", "generic", "generic", "web_search", "local_document", "download_result"]
    assert [r["title"] for r in got[:4]] == ["Error Processing Result"] * 3 + ["Generic Result"]
    assert got[4]["source"] == "a" and got[6]["content"] == "Download failed: Unknown error" and got[5]["metadata"]["service_used"] == "rag"


def test_profiles(spark):
    df = spark.createDataFrame([("a@x.org", None), ("b", "n"), (None, "n")], "email string, name string")
    assert [r[0] for r in P.email_domains(df, "email").collect()] == ["x.org"]
    assert [r[0] for r in P.sample_names(df, ["name", "email"]).collect()] == ["n", "a@x.org", "b"]
    empty = P.date_ranges(df.where("false"), ["name"]).first()
    assert tuple(empty) == ("name", None, None, 0)


def test_reducers(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1), (1, 2, None, None), (1, 3, "b", 2), (2, 1, None, None)], "k int, seq int, v string, n int")
    deltas = rows.select("k", "seq", F.col("v").alias("last"), F.col("v").alias("every"), F.col("n").alias("sum"), F.col("v").alias("first"))
    got = {r["k"]: (r["last"], r["every"], r["sum"], r["first"]) for r in G.reduce_states(deltas, "k", "seq", ["last"], ["every"], ["sum"], ["first"]).collect()}
    assert got == {1: ("b", ["a", "b"], 3, "a"), 2: (None, [], None, None)}


def test_last_failure_counts(spark):
    rules = {"q": {"required": True, "min_length": 2, "max_length": 3}, "n": {"max_value": 5}}
    df = spark.createDataFrame([("ab", 1), ("abcd", 9), (None, None), ("", 6)], "q string, n int")
    got = [r[0] for r in df.select(errors({"q": F.col("q"), "n": F.col("n")}, rules)).collect()]
    assert got == [{}, {"q": "Maximum length is 3", "n": "Maximum value is 5"}, {"q": "Field is required"}, {"q": "Minimum length is 2", "n": "Maximum value is 5"}]


def test_block_join_as_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[200:] = x[:100]  # ties
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, [1.0, 2.0]), (901, None), (902, [3.0, 6.0])], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 3 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 9)
    want = {(q, r): v for q in range(0, 300, 3) for r, v in enumerate(sorted(range(300), key=lambda v: (-near[q, v], v))[:4], 1)} | {(900, 1): 900, (900, 2): 902}
    for rows, per in ((1 << 18, 1 << 15), (40, 30)):
        got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.top_k_each(frame, asked, 4, rows=rows, asked=per).collect()}
        assert got == want


def test_grams_grow_as_the_text(spark):
    from quillon.operators.matching import GRAM, grams, holding

    text = "".join(chr(0x4E00 + (i * 7919) % 15000) for i in range(8000))
    rows = spark.createDataFrame([(n, text[:n]) for n in (1000, 2000, 4000, 8000)], "n int, t string")
    every = F.aggregate(F.array(*(F.size(grams(F.col("t"), k)) for k in range(1, GRAM + 1))), F.lit(0), lambda a, b: a + b)
    assert all(r["e"] <= GRAM * r["n"] for r in rows.select("n", every.alias("e")).collect())
    names = spark.createDataFrame([(text[i : i + 40],) for i in range(0, 7900, 10)] + [("absent",), ("zz",)], "name string")
    got = {r["n"]: r["c"] for r in holding(rows, "t", names, "name", short=0).groupBy("n").agg(F.count("*").alias("c")).collect()}
    assert got == {n: sum(text[i : i + 40] in text[:n] for i in range(0, 7900, 10)) for n in (1000, 2000, 4000, 8000)}


def test_enhancers_may_be_added(spark):
    rows = spark.createDataFrame([("my-sql", '{"rows": [1, 2, 3]}'), ("thing", '{"size": 7}'), ("dns-a", "x"), (None, None)], "service_id string, raw string")
    got = N.enhance(rows, F.lit("now"), enhancers={"generic": lambda raw: {"size": F.get_json_object(raw, "$.size").cast("int")}}).collect()
    assert [(r["type"], r["row_count"], r["size"], r["error"] is None) for r in got] == [("sql_enhanced", 3, None, True), ("generic_enhanced", None, 7, True), ("enhancement_error", None, None, False), ("enhancement_error", None, None, False)]


def test_verdicts_fail_closed(spark):
    from quillon.plans.judge import judged, verdict

    whole = '{"is_safe": true, "security_issues": [], "confidence_level": "high", "explanation": "e"}'
    cases = [
        (whole, None, True, "high"), (f"x {whole} y", None, True, "high"), (whole.replace("true", '"yes"'), None, False, "high"), (whole.replace("true", "false"), None, False, "high"),
        (whole[:-20], None, False, "low"), ('{"is_safe": true}', None, False, "low"), ("fine, high confidence", None, True, "high"), ("an issue, medium confidence", None, False, "medium"),
        ("Unsafe", None, False, "low"), ("", None, True, "low"), (None, None, False, "low"), (whole, "late", False, "low"), ("{x}", None, False, "low"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, reply string, failure string, safe boolean, sure string")
    got = rows.withColumn("v", verdict(F.col("reply"), F.col("failure"))).orderBy("i").collect()
    assert [(r["v"]["is_safe"], r["v"]["confidence"]) for r in got] == [c[2:] for c in cases]
    missing = judged(spark.createDataFrame([(None,)], "s string"), "s", None).first()
    assert not missing["is_safe"] and missing["explanation"] == "no statement"
