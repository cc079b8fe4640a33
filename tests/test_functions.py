import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import jsontext, text, web
from quillon.functions.vectors import cosine
from quillon.operators.documents import split_text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("reply", "sql"),
    [
        ("Sure <sql_generated> SELECT 1 </sql_generated> ok", "SELECT 1"),
        ("###ponder###<sql>no</sql>###/ponder###<sql_query>SELECT 2</sql_query>", "SELECT 2"),
        ("<sql_code>SELECT * FROM orders LIMIT 10;</sql_code>", "SELECT * FROM orders LIMIT 10;"),
        ('x {"sql_query": "SELECT 3"} y', "SELECT 3"),
        ("content='{\"sql_query\": \"SELECT 5\"}'", "SELECT 5"),
        ("```sql\nSELECT 6\n```", "SELECT 6"),
        ("  SELECT 7  ", "SELECT 7"),
        ("SELECT 8; SELECT 9;", "SELECT 8; SELECT 9"),
        ("", ""),
        (None, None),
    ],
)
def test_extract_sql(spark, reply, sql):
    assert one(spark, text.extract_sql, reply) == sql


@pytest.mark.parametrize(("given_", "clean"), [("\\'John\\'", "'John'"), ("a /* b\nc */ d", "a  d"), ("a -- b\nc", "a \nc"), (";a;;", "a"), (None, None)])
def test_sanitize(spark, given_, clean):
    assert one(spark, text.sanitize_executor, given_) == clean


@pytest.mark.parametrize(("name", "short"), [("mydb.public.users", "public.users"), ('"mydb"."users"', '"users"'), ('"public"."users"', '"public"."users"'), ("t", "t"), (None, None)])
def test_strip_prefix(spark, name, short):
    assert one(spark, text.strip_db_prefix, name) == short


def test_file_names_keep_letters(spark):
    assert one(spark, text.filename_secure, "C:\\x\\отчёт 1?.pdf") == "отчёт_1_.pdf"
    assert one(spark, text.filename_secure, "...") == "unnamed_file"
    assert one(spark, text.filename_secure, None) == ""
    assert len(one(spark, text.filename_store, "a" * 300 + ".docx")) == 255


def test_first_object():
    assert jsontext.first_object('x {"a": "}{", "b": {}} y}') == '{"a": "}{", "b": {}}'
    assert jsontext.first_object("{") is None and jsontext.first_object(None) is None


def test_html_text():
    assert web.html_text("<head><title>t</title></head><p>a <b>b</b></p><script>x</script><div>c&amp;d</div>") == "a b\nc&d"
    assert web.html_text(None) is None


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [1.0, None, None, None]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 40), st.integers(0, 4))
@example("aaaaaa", 5, 1)
def test_chunks_cover_the_text(value, size, overlap):
    """By positions: every chunk starts where the one before ended, or up to overlap before that."""
    parts = split_text(value, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    assert bool(parts) == bool(value.strip())
    ends = {0}
    for p in parts:
        ends = {s + len(p) for e in ends for s in range(max(0, e - overlap), e + 1) if value.startswith(p, s)}
        assert ends
    assert not parts or len(value) in ends


def test_overlap_without_separators():
    assert split_text("abcdefghij", 5, 1) == ["abcde", "efghi", "ij"]
    assert split_text("ab cdefghij", 5, 2) == ["ab cd", "cdefg", "fghij"]


def test_chunker_edges():
    assert split_text(None) == [] and split_text("   ") == []
    assert split_text("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 700]  # 100 of each are those of the one before
