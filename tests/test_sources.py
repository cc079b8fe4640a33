import io
import zipfile

import pytest

from quillon.embedding import provider
from quillon.sources import files, web


def test_load_by_extension(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("plain ü")
    (tmp_path / "sub/b.html").write_text("<p>hi</p>")
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(buf.getvalue())
    got = {r["name"]: (r["text"], r["error"]) for r in files.load(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("plain ü", None) and got["b.html"] == ("hi", None) and got["d.docx"] == ("one\ntwo", None)
    assert got["c.bin"] == (None, "unsupported extension: bin") and got["bad.txt"][1].startswith("UnicodeDecodeError")


def test_prompts(spark, tmp_path):
    (tmp_path / "greet.txt").write_text("hello\nthere")
    assert files.prompts(spark, str(tmp_path)) == {"greet": "hello\nthere"}


def test_prompt_store(tmp_path):
    store = files.PromptStore(tmp_path)
    store.create("a", "x")
    with pytest.raises(FileExistsError):
        store.create("a", "y")
    store.update("a", "z")
    assert store.list() == ["a"] and store.get("a") == "z" and store.delete("a") and not store.delete("a")
    with pytest.raises(FileNotFoundError):
        store.update("a", "z")
    with pytest.raises(ValueError):
        store.get("../a")


def test_collection(spark, tmp_path):
    c = files.Collection(spark, str(tmp_path / "c"), 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    assert c.count() == 0
    c.add(rows)
    c.add(rows)
    assert c.count() == 2
    with pytest.raises(Exception, match="dimension must be 2"):
        c.add(spark.createDataFrame([(1, [1.0])], rows.schema))
    c.clear()
    assert c.count() == 0


def test_offline_web(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<title>T</title><p>red ring</p>"), (2, "http://b/", "<p>red</p>"), (3, "http://c/", None)], "page_id long, url string, html string")
    assert [r["page_id"] for r in web.search(pages, ["red", "ring"]).collect()] == [1, 2]
    wanted = spark.createDataFrame([("http://a/x",), ("nope",), ("http://z/",), (None,)], "url string")
    assert {r["url"]: r["error"] for r in web.download(wanted, pages).collect()} == {"http://a/x": None, "nope": "invalid URL", "http://z/": "not found", None: "invalid URL"}
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    records = spark.createDataFrame([("a", 1, "1.1.1.1"), ("a", 2, "1.1.1.1"), ("a", 0, "2.2.2.2")], "name string, ordinal int, address string")
    assert {r["name"]: r["addresses"] for r in web.resolve(names, records).collect()} == {"a": ["2.2.2.2", "1.1.1.1"], "b": None}


def test_searches_read_each_text_once(spark):
    from quillon.plans import rag

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    reads = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [_html_series")
    assert reads(web.search(pages, ["the", "ring"])) == reads(web.search_many(pages, {"a": ["the"], "b": ["ring"]})) == 1
    assert reads(rag.enhanced_search(pages, ["the", "ring"])) == 2  # that of the search, and the hits' own


def test_search_gives_the_best_pages(spark):
    from quillon.functions.web import html_text

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(-1, "http://n/", None), (-2, "http://e/", "")], "page_id long, url string, html string"))
    texts = {r["page_id"]: (html_text(r["html"]) or "").lower() for r in pages.collect()}
    for words, k in ((["the", "and", "ring"], 10), (["The", "de"], 10_000), (["the"], 3), (["absent-everywhere"], 5), ([], 5)):
        scores = sorted((-sum(w.lower() in t for w in words), n) for n, t in texts.items())
        expected = [(n, texts[n][:200], -s) for s, n in scores if s][:k]
        assert [(r["page_id"], r["description"], r["score"]) for r in web.search(pages, words, k).collect()] == expected
        many = {(r["page_id"], r["description"], r["score"]) for r in web.search_many(pages, {"q": words}, k).collect()}
        assert many == set(expected)


def test_hashing_embeddings(spark):
    df = provider("hashing", dimensions=8).embed(spark.createDataFrame([("a b",), ("A  b",), (" ",), (None,)], "t string"), "t")
    v = [r["embedding"] for r in df.collect()]
    assert v[0] == v[1] and len(v[0]) == 8 and v[2] is None and v[3] is None


def test_pdf_falls_back(spark, tmp_path):
    import time

    (tmp_path / "a.pdf").write_bytes(b"x")
    load = lambda **how: files.load(spark, str(tmp_path), **how).first()
    assert load()["error"] == "unsupported extension: pdf"
    assert load(pdf=lambda b: "rich")["text"] == "rich"
    assert load(pdf=lambda b: 1 / 0, pdf_plain=lambda b: "plain")["text"] == "plain"
    assert load(pdf=lambda b: " ", pdf_plain=lambda b: "plain")["text"] == "plain"
    assert load(pdf=lambda b: time.sleep(3) or "late", pdf_plain=lambda b: "plain", pdf_timeout_s=0.2)["text"] == "plain"
    assert load(pdf=lambda b: 1 / 0)["error"].startswith("ZeroDivisionError")


def test_docx_without_its_main_part(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("other", "")
    assert files.load(spark, str(tmp_path)).first()["error"].startswith("KeyError")


def test_uploads(spark, tmp_path):
    store = files.UploadStore(spark, f"file://{tmp_path}/up")
    ident, path = store.put("../x/a b.txt", b"data")
    assert path.endswith(f"/{ident}/a b.txt") and store.find(ident).endswith("/a b.txt") and (tmp_path / "up" / ident / "a b.txt").read_bytes() == b"data"
    assert store.find("../etc") is None and store.delete(ident) and store.find(ident) is None
    with pytest.raises(ValueError):
        store.put("..", b"")


def test_history_is_saved_and_limited(spark, tmp_path):
    states = spark.createDataFrame([(k, i, f"s{i}") for k in (1, 2) for i in range(5)], "session int, at int, state string")
    files.save_history(states, f"{tmp_path}/h", "session", "at", 2)
    assert sorted(map(tuple, files.load_history(spark, f"{tmp_path}/h", states.schema).collect())) == [(k, i, f"s{i}") for k in (1, 2) for i in (3, 4)]


def test_databases_from_env():
    env = {"DB_SALES_URL": "u1", "DB__URL": "", "DB_A_B_TYPE": "postgresql", "DB_A_B_USERNAME": "me", "DB_A_B_NAME": "n", "DB_C_TYPE": "x", "PATH": "/"}
    assert files.databases_from_env(env) == {"sales": "u1", "a_b": "postgresql://me:@localhost:5432/n"}
    assert files.databases_from_env(env | {"DISABLE_DATABASES": "true"}) == {}


def test_collection_drop(spark, tmp_path):
    c = files.Collection(spark, f"{tmp_path}/c", 1)
    c.add(spark.createDataFrame([(1, [1.0])], "id int, embedding array<double>"))
    c.drop()
    assert not c.exists() and c.count() == 0


def test_rerank_size():
    from quillon.operators.retrieval import rerank_size

    assert [rerank_size(*x) for x in ((None, 9), (9, 9), (3, 9), (5, 2), (None, 2))] == [5, 5, 3, 2, 2]


def test_unknown_providers_are_errors():
    with pytest.raises(ValueError, match="hashin"):
        provider("hashin")


def test_fitted_embeddings(spark, tmp_path):
    import math

    from quillon.embedding import FittedProvider

    texts = spark.createDataFrame([("the red ring",), ("The blue BOLT",), ("the the",), ("",), (None,)], "t string")
    whole = FittedProvider.fit(texts, "t", dimensions=256)
    parts = FittedProvider.fit(texts.limit(0), "t").merge(FittedProvider.fit(texts, "t", dimensions=256))
    parts.dimensions = 256
    parts.save(str(tmp_path / "m"))
    again = FittedProvider.load(spark, str(tmp_path / "m"), 256)
    assert sorted(whole.weights().collect()) == sorted(again.weights().collect())
    assert sorted(round(r["weight"], 9) for r in whole.weights().collect()) == sorted(round(math.log(4 / (1 + n)) + 1, 9) for n in (3, 1, 1, 1, 1))
    v = [r["embedding"] for r in again.embed(texts.union(spark.createDataFrame([("RED ring",), ("unseen",)], "t string")), "t").collect()]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert v[3] is None and v[4] is None and abs(dot(v[0], v[0]) - 1) < 1e-6 and len(v[6]) == 256
    assert dot(v[0], v[5]) > dot(v[0], v[2]) > 0  # rare words weigh more than one that is everywhere


def test_fan_out_is_bounded_and_tries_again(spark, tmp_path):
    from quillon.sources.fanout import fan_out

    log = tmp_path / "calls"
    log.mkdir()

    def call(row):
        import os
        import time
        import uuid

        mine = log / f"{row['k']}-{uuid.uuid4().hex}"
        mine.touch()
        time.sleep(0.05)
        tries = len([x for x in os.listdir(log) if x.startswith(f"{row['k']}-")])
        if row["k"] == 3 or row["k"] == 4 and tries < 2:
            raise OSError("down")
        if row["k"] == 5:
            raise ValueError("never")
        return f"got {row['k']}"

    rows = spark.range(8).withColumnRenamed("id", "k").coalesce(1)
    got = {r["k"]: (r["out"], r["error"], r["tries"]) for r in fan_out(rows, call, "out", parallel=2, attempts=3, base_s=0.01, fatal=(ValueError,)).collect()}
    assert got[0] == ("got 0", None, 1) and got[3] == (None, "OSError: down", 3) and got[4] == ("got 4", None, 2) and got[5] == (None, "ValueError: never", 1)
    assert fan_out(rows.limit(0), call, "out").count() == 0


def test_failing_pages_become_their_descriptions(spark):
    from quillon.plans import rag

    pages = spark.createDataFrame([(n, f"http://h/{n}", f"<title>T{n}</title><p>red ring {'x ' * n}</p>") for n in range(6)] + [(9, "http://h/9", None)], "page_id long, url string, html string")

    def fetch(row):
        if row["page_id"] % 2:
            raise TimeoutError("slow")
        return "full text with red and ring"

    got = rag.enhanced_search_many(pages, {"q": ["red", "ring"], "none": ["absent"]}, fetch, k=4, attempts=2, base_s=0.0).collect()
    assert len(got) == 4 and {r["query"] for r in got} == {"q"} and [r["rank"] for r in got] == [1, 2, 3, 4]
    for r in got:
        assert (r["error"], r["summary"][:9]) == (("TimeoutError: slow", f"t{r['page_id']}\nred ri"[:9]) if r["page_id"] % 2 else (None, "full text"))
    from quillon.sources import web

    many = web.search_many(pages, {"q": ["red", "x"]}, 3)
    assert [tuple(r) for r in many.select("page_id", "score").orderBy("page_id").collect()] == [tuple(r) for r in web.search(pages, ["red", "x"], 3).select("page_id", "score").orderBy("page_id").collect()]


def test_a_fitted_model_reads_its_corpus_once(spark):
    from quillon.embedding import Buckets, FittedProvider

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    texts = ["Red ring", "red-hot RING 7", "été_Été", "--", "", None]
    corpus = spark.createDataFrame([(t,) for t in texts], "t string").mapInPandas(seen, "t string")
    model = FittedProvider.fit(corpus, "t")
    for text in ("red ring", "blue"):
        model.embed(spark.createDataFrame([(text,)], "q string"), "q").collect()
    assert read.value == len(texts)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(
        r"transform(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)', 1), w -> cast(conv(substring(md5(w), 1, 4), 16, 10) as int)) AS b"
    )
    expected = [r["b"] or [] for r in rows.collect()]
    assert [Buckets().of(t) for t in texts] == [Buckets(most=1).of(t) for t in texts] == expected and len(expected[1]) == 4
