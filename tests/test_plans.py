import pytest
from pyspark.sql import functions as F

from quillon.plans import guard, rag, relax
from quillon.operators.matching import holding
from quillon.plans.agent import Agent, TemplateModel, Tool, wider_everywhere, wider_search
from quillon.plans.federation import Federation, Unsafe, relaxations, route_tables


@pytest.fixture
def fed(spark):
    f = Federation(spark)
    f.add("left", {"contacts": spark.createDataFrame([(1, "Jane Smith", "555-5678"), (2, "Bob Ray", "555-1")], "id int, name string, phone string")})
    f.add("right", {"arrest_data": spark.createDataFrame([(1, "Jane", "Smith"), (2, "Al", "Poe")], "id int, first_name string, last_name string"), "contacts": spark.createDataFrame([(9,)], "id int")})
    return f


@pytest.mark.parametrize(
    "sql",
    ["SELECT created_at, 'drop table' FROM t", "WITH a AS (SELECT 1 AS x) SELECT * FROM a", "SELECT * FROM a WHERE x IN (SELECT y FROM b)", "SELECT a FROM t UNION ALL SELECT b FROM u ORDER BY 1 LIMIT 3", "SELECT sum(x) OVER (PARTITION BY y) FROM t"],
)
def test_reading_is_safe(spark, sql):
    assert guard.check(spark, sql).safe


@pytest.mark.parametrize("sql", ["DROP TABLE t", "INSERT INTO t VALUES (1)", "SELECT 1; DROP TABLE x", "CREATE VIEW v AS SELECT 1", "DELETE FROM t", "SET a = 1", "not sql", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", ""])
def test_writing_is_not(spark, sql):
    assert not guard.check(spark, sql).safe


def test_tables_and_aliases(spark):
    said = guard.check(spark, "WITH t AS (SELECT * FROM z) SELECT * FROM t JOIN d.s.u AS k ON 1 = 1 WHERE EXISTS (SELECT 1 FROM w)")
    assert sorted(said.tables) == [("d", "s", "u"), ("w",), ("z",)]
    assert said.aliases["k"] == "d.s.u"


def test_fuzzy_join_across_databases(fed):
    df = fed.query("SELECT DISTINCT c.name, c.phone FROM left.contacts c, right.public.arrest_data a WHERE lower(c.name) LIKE concat('%', lower(a.first_name), '%') AND lower(c.name) LIKE concat('%', lower(a.last_name), '%')")
    assert [tuple(r) for r in df.collect()] == [("Jane Smith", "555-5678")]


def test_literals_stay(fed):
    assert fed.query("SELECT 'left.contacts' AS a, count(*) AS n FROM left.contacts WHERE name <> 'contacts -- x'").first()["a"] == "left.contacts"


def test_blocked_and_unknown(fed):
    with pytest.raises(Unsafe):
        fed.query("DROP TABLE contacts")
    with pytest.raises(LookupError):
        fed.query("SELECT 1 FROM nowhere")
    assert fed.validate("SELECT nope FROM left.contacts") and not fed.validate("SELECT name FROM left.contacts")
    assert fed.execute("validate", sql="SELECT 1")["result"] == []
    assert not fed.execute("execute", sql="DELETE FROM contacts")["success"]
    assert not fed.execute("fly")["success"]


def test_first_database_wins_and_union_has_lineage(fed):
    assert fed.query("SELECT * FROM CONTACTS").columns == ["id", "name", "phone"]
    df = fed.everywhere("SELECT * FROM contacts")
    assert {(r["_source_database"], r["name"]) for r in df.collect()} == {("left", "Jane Smith"), ("left", "Bob Ray"), ("right", None)}
    with pytest.raises(LookupError):
        fed.everywhere("SELECT 1 FROM nowhere")


def test_registration(fed):
    with pytest.raises(ValueError):
        fed.add("bad name", {})
    assert fed.test("left") and not fed.test("none") and fed.list() == ["left", "right"]
    assert fed.reload({"left": {}, "new": {}}) == (["new"], ["right"])


def test_routing_without_match(spark, fed):
    wanted = spark.createDataFrame([("x",), (None,)], "query_table string")
    catalog = spark.createDataFrame([("d", "T", 0)], "db string, table_name string, db_ordinal int")
    assert {r["db"] for r in route_tables(wanted, catalog).collect()} == {None}


def test_relaxations():
    forms = relaxations("SELECT * FROM t WHERE a = 'x' AND b = 2 LIMIT 5")
    assert forms[0] == "SELECT * FROM t WHERE a ILIKE '%x%' AND b = 2 LIMIT 5"
    assert forms[1] == "SELECT * FROM t WHERE a ILIKE '%x%' LIMIT 5" and forms[-1] == "SELECT * FROM t LIMIT 5"


def test_wider_search(fed):
    form, df = wider_search(fed, "SELECT name FROM left.contacts WHERE name = 'jane'")
    assert "ILIKE" in form and [r[0] for r in df.collect()] == ["Jane Smith"]


def test_agent(spark):
    agent = Agent({"a": Tool({"n": int}, lambda n: spark.range(n))}, {"sql": False})
    done = agent.run([{"service_id": "a", "params": {"n": 3}}, {"service_id": "a", "params": {"n": "x"}}, {"service_id": "my-sql"}, {"service": "gone"}])
    assert [r["status"] for r in done] == ["success", "error", "error"] and done[0]["result"].count() == 3
    assert TemplateModel({"sql": "Q: {prompt}"}).complete("sql", "x") == "Q: x"


def test_rag_path(spark):
    docs = spark.createDataFrame([(1, "red apples and pears"), (2, "blue cars"), (3, None)], "doc_id long, text string")
    assert rag.applicable(spark, "what is red?") and not rag.applicable(spark, "count the rows")
    assert rag.retrieve(docs, "red apples", threshold=0.1).first()["doc_id"] == 1
    said = rag.answer(docs, "red apples", TemplateModel(), threshold=0.1)
    assert said.startswith("Use the following context") and "Context 1:\nred apples and pears" in said and said.endswith("Question: red apples")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'setProperty', 'a', 'b')", "SELECT 1 + length(try_reflect('java.lang.System', 'exit', 0))",
        "WITH a AS (SELECT REFLECT('java.lang.Runtime', 'getRuntime') AS x) SELECT * FROM a", "SELECT * FROM t WHERE EXISTS (SELECT java_method('a', 'b'))", "SELECT * FROM read_anything('/etc')",
        "SELECT my_udf(a) FROM t", "SELECT x.y.count(a) FROM t", "SELECT * FROM t LATERAL VIEW my_rows(a) v AS b", "SELECT sum(a) FROM t GROUP BY reflect('a', 'b', c)",
    ],
)
def test_running_code_is_not_reading(spark, sql):
    assert not guard.check(spark, sql).safe


def test_functions_that_read(spark):
    for sql in ("SELECT count(*), upper(a), CAST(b AS int), a || b, CASE WHEN a THEN 1 END FROM t", "SELECT * FROM t LATERAL VIEW explode(a) v AS b", "SELECT * FROM range(3)", "SELECT explode(array(1, 2))", "SELECT row_number() OVER (ORDER BY a), date_add(d, 1), d + INTERVAL 1 DAY FROM t"):
        assert guard.check(spark, sql).issues == [], sql
    assert guard.check(spark, "SELECT my_udf(a) FROM t", frozenset(["my_udf"])).safe


def test_statement_inside_json(spark):
    df = spark.createDataFrame([('{"sql_query": "SELECT 1"}',), ('{"sql_query": "DROP TABLE t"}',), ('{"other": 1}',)], "s string").select(guard.executor_issues(F.col("s")).alias("i"))
    got = [r["i"] for r in df.collect()]
    assert got[0] == [] and guard.NOT_SELECT in got[1] and got[2] == [guard.NOT_SELECT]


def test_calls_run_at_once(spark):
    import threading

    both = threading.Barrier(2, timeout=60)
    agent = Agent({n: Tool({}, lambda: both.wait() and None or spark.range(2)) for n in "ab"} | {"bad": Tool({}, lambda: 1 / 0)})
    done = agent.run([{"service_id": "a"}, {"service_id": "bad"}, {"service_id": "b"}], lambda df: df.count())
    assert [(r["status"], r.get("result")) for r in done] == [("success", 2), ("error", None), ("success", 2)]


def test_agent_end_to_end(spark):
    agent = Agent({"sql-a": Tool({}, lambda: spark.range(2)), "web-search": Tool({}, lambda: spark.range(1)), "off-dns": Tool({}, lambda: 1 / 0)}, {"dns": False})
    plan = '{{"tool_calls": [{{"service_id": "sql-a"}}, {{"service_id": "off-dns"}}, {{"service_id": "web-search"}}, {{"service_id": "gone"}}]}}'
    said = agent.answer("how many?", TemplateModel({"plan": plan, "response": "R {prompt}"}))
    assert [r["service_id"] for r in said["results"]] == ["web-search", "sql-a"] and said["errors"] == ["Service gone not found"] and said["answered"]
    assert said["response"].startswith("R [web-search]") and said["response"].endswith("how many?")
    said = agent.answer("x", TemplateModel({"plan": '[{{"service_id": "gone"}}]', "failure": "F {prompt}"}))
    assert said["response"] == "F Service gone not found" and not said["answered"]
    assert agent.plan("x", TemplateModel({"plan": "no json"})) == []


def test_wider_on_every_database(fed):
    got = {r["database"]: r for r in wider_everywhere(fed, "SELECT name FROM contacts WHERE name = 'jane'")}
    assert got["left"]["status"] == "success" and "ILIKE" in got["left"]["statement"]
    assert got["right"]["status"] == "error" and got["right"]["error"]


def test_rerouted_generated_and_clean(fed):
    with pytest.raises(LookupError):
        fed.query("SELECT id FROM left.arrest_data")
    assert fed.query("SELECT id FROM left.arrest_data", anywhere=True).count() == 2
    assert not [t for t in fed.spark.catalog.listTables() if t.name.startswith("q") and "arrest_data" in t.name]
    good = fed.execute("generate", question="all?", model=TemplateModel({"sql": "<sql>SELECT id FROM contacts</sql>"}))
    assert good["success"] and good["result"].startswith("SELECT id FROM contacts")
    assert not fed.execute("generate", question="all?", model=TemplateModel({"sql": "<sql>DROP TABLE contacts</sql>"}))["success"]
    assert not fed.execute("nothing")["success"] and fed.execute("list")["result"] == ["left", "right"]


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, "Red apple red"), (2, "applet"), (3, None), (4, "")], "id int, t string")
    names = spark.createDataFrame([("red",), ("Apple",), ("apple",), ("pp",), (None,), ("",), ("zebra",)], "n string")
    want = sorted((i, n) for i, t in ((1, "red apple red"), (2, "applet"), (4, "")) for n in ("red", "Apple", "apple", "pp", "", "zebra") if n.lower() in t)
    for short in (500, 2):
        assert sorted((r["id"], r["n"]) for r in holding(texts, "t", names, "n", short).collect()) == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')", "SELECT IDENTIFIER('re' || 'flect')('java.lang.System', 'getProperty', 'user.home')",
        "SELECT a FROM t WHERE b = (SELECT IDENTIFIER('java_method')('java.lang.System', 'nanoTime'))", "WITH x AS (SELECT IDENTIFIER('reflect')('a', 'b') AS y) SELECT y FROM x",
        "SELECT sum(a) OVER (ORDER BY IDENTIFIER('reflect')('a', 'b')) FROM t", "SELECT * FROM IDENTIFIER('t')", "SELECT IDENTIFIER('a') FROM t", "SELECT a FROM t WHERE b = :p", "SELECT ? FROM t",
        "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`s3a://b/c`", "SELECT * FROM json.data", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM csv.`x.csv`)",
    ],
)
def test_hidden_names_and_paths_are_refused(fed, spark, sql):
    assert not guard.check(spark, sql).safe
    with pytest.raises(Unsafe):
        fed.query(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a + b - c * d / e % f, -a, ~a, a & b | c ^ d, a || b, a DIV b, CAST(a AS int), a::string, TRY_CAST(a AS int), a >> 1, a << 1 FROM t",
        "SELECT CASE WHEN a = 1 THEN 2 ELSE 3 END, a BETWEEN 1 AND 2, a NOT IN (1, 2), a IN (SELECT b FROM u), a IS NULL, a IS NOT TRUE, a IS DISTINCT FROM b, NOT a AND b OR c FROM t",
        "SELECT a LIKE 'x', a ILIKE ANY ('x', 'y'), a RLIKE 'x', a NOT LIKE ALL ('a', 'b'), a ILIKE ALL ('x'), a NOT ILIKE ANY ('x') FROM t",
        "SELECT lag(a) IGNORE NULLS OVER (ORDER BY c DESC NULLS LAST), sum(a) OVER w FROM t WINDOW w AS (ORDER BY a ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING)",
        "SELECT extract(year FROM a), position('a' IN b), substring(a FROM 1 FOR 2), trim(BOTH 'x' FROM a), trim(TRAILING FROM a), overlay(a PLACING 'x' FROM 1), current_date, INTERVAL '1' DAY, DATE '2020-01-01', timestampadd(DAY, 1, a) FROM t",
        "SELECT a, grouping(a), count(DISTINCT b) FILTER (WHERE c > 1) FROM t GROUP BY GROUPING SETS ((a), ()) HAVING count(*) > 1", "SELECT a FROM t GROUP BY CUBE(a, b)", "SELECT a FROM t GROUP BY ALL ORDER BY 1",
        "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY a), first(a), last(a, true), any_value(a), listagg(a, ',') WITHIN GROUP (ORDER BY b) FROM t",
        "SELECT transform(a, x -> x + 1), a[0], b.c.d, struct(a, b), (a, b), array(1, 2), map(1, 2) FROM t", "SELECT * EXCEPT (a) FROM t", "SELECT a FROM t, LATERAL (SELECT a + 1)", "SELECT a FROM t TABLESAMPLE (10 PERCENT)",
    ],
)
def test_what_reads_stays_allowed(spark, sql):
    assert guard.check(spark, sql).issues == []


@pytest.fixture
def namesakes(spark):
    f = Federation(spark)
    f.add("sales", {"party": spark.createDataFrame([(1, "Ann"), (2, "Bob")], "k int, name string")})
    f.add("supply", {"party": spark.createDataFrame([(2, "Zed"), (3, "Yan")], "k int, name string"), "other": spark.createDataFrame([(2,)], "k int")})
    return f


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT sales.party.name AS a, supply.party.name AS b FROM sales.party JOIN supply.party ON sales.party.k = supply.party.k",
        'SELECT "sales"."party"."name" AS a, supply.party.name AS b FROM "sales"."party", "supply"."party" WHERE sales.party.k = supply.party.k',
        "SELECT p.name AS a, supply.public.party.name AS b FROM sales.party p JOIN supply.public.party ON p.k = supply.public.party.k",
        "SELECT SALES.PARTY.name AS a, q.name AS b FROM Sales.Party TABLESAMPLE (100 PERCENT) JOIN supply.party AS q ON sales.party.k = q.k /* sales.party.k */",
        "WITH s AS (SELECT sales.party.* FROM sales.party) SELECT s.name AS a, b FROM s JOIN (SELECT party.k, party.name AS b FROM supply.party AS party) z ON s.k = z.k WHERE 'sales.party' <> s.name",
        "SELECT sales.party.name AS a, (SELECT max(supply.party.name) FROM supply.party WHERE supply.party.k = sales.party.k) AS b FROM sales.party WHERE EXISTS (SELECT 1 FROM other WHERE other.k = sales.party.k)",
        "SELECT '😀' AS e, sales.party.name AS a, supply.party.name AS b FROM sales.party JOIN supply.party USING (k)",
    ],
)
def test_tables_of_one_name_keep_apart(namesakes, sql):
    assert [(r["a"], r["b"]) for r in namesakes.query(sql).collect()] == [("Bob", "Zed")]


def test_a_qualifier_that_fits_two_tables_is_refused(namesakes):
    with pytest.raises(LookupError, match="sales or supply"):
        namesakes.query("SELECT party.k FROM sales.party JOIN supply.party ON true")
    assert namesakes.query("SELECT party.k, party.* FROM supply.party").count() == 2


def test_stars_and_struct_fields(namesakes):
    df = namesakes.query("SELECT supply.party.*, s.x.y FROM supply.party, (SELECT named_struct('y', 5) AS x) s ORDER BY k")
    assert df.columns == ["k", "name", "y"] and df.first()["y"] == 5


@pytest.fixture
def shop(spark):
    f = Federation(spark)
    f.add("sales", {"orders": spark.createDataFrame([(1, 7, "urgent", 100.0), (2, 8, "low (5)", 250.0), (3, 9, "low", 90.0)], "o_orderkey int, o_partkey int, o_priority string, o_price double")})
    f.add("supply", {"part": spark.createDataFrame([(7, "red ring", 5), (8, "blue bolt", 20), (9, "Hot Gear", 30)], "p_partkey int, p_name string, p_size int")})
    return f


@pytest.mark.parametrize(
    "sql, kind, keys",
    [
        ("SELECT p_partkey FROM supply.part WHERE p_name = 'GEAR' AND p_size = 30", "softened", [9]),
        ("SELECT p_partkey FROM supply.part WHERE p_size BETWEEN 21 AND 22 LIMIT 5", "widened 0.1", [8]),
        ("SELECT p_partkey FROM supply.part p WHERE p.p_name = 'bolt' AND p.p_size > 25", "widened 0.5", [8]),
        ("SELECT p_partkey FROM supply.part WHERE p_name LIKE 'ring' AND p_size > 1000 AND p_partkey IN (7, 8)", "dropped", [7]),
        ("SELECT o_orderkey FROM sales.orders WHERE o_priority = 'bolt'", "related table", [2]),
        ("SELECT o_orderkey FROM sales.orders, supply.part p WHERE o_priority = 'gear' AND o_partkey = p_partkey", "any column", [3]),
        ("SELECT max(p_partkey) FROM supply.part WHERE p_name = 'rin' GROUP BY p_size ORDER BY 1", "softened", [7]),
        ("WITH x AS (SELECT * FROM supply.part) SELECT p_partkey FROM x", None, None),
    ],
)
def test_wider_forms(shop, sql, kind, keys):
    found = relax.widen(shop, sql)
    assert (found and found[0].kind) == kind
    if kind:
        assert [r[0] for r in found[1].collect()] == keys and found[0].rows == len(keys)


def test_forms_are_counted_in_one_scan(shop, monkeypatch):
    ran, query = [], Federation.query
    monkeypatch.setattr(Federation, "query", lambda self, sql, *a, **k: (ran.append(sql), query(self, sql, *a, **k))[1])
    found = relax.forms(shop, "SELECT p_partkey FROM supply.part WHERE p_name = 'ring' AND p_size > 1000 AND p_partkey < 0")
    rows = relax.counted(shop, "SELECT p_partkey FROM supply.part WHERE p_name = 'ring' AND p_size > 1000 AND p_partkey < 0", found)
    assert len(ran) == 1 and len(rows) > 6 and {f.rows for f in rows} >= {0, 1}


def test_namesakes_compare_without_making_pairs(spark, duck, tmp_path):
    """Ties and nulls of balances, nations without partners; and no join but the one with the nations."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from conftest import SF, rows_of
    from quillon.queries import ORACLE_SQL, QUERIES

    sold = [5.0, 5.0, 7.25, None, -3.0, 0.0, 1e9, 1.0]
    owed = [5.0, 4.0, None, -3.0, -0.0, 7.25]
    frames = {
        "customer": {"c_custkey": range(40), "c_nationkey": [k % 5 if k else None for k in range(40)], "c_acctbal": [sold[k % 8] if k % 5 else abs(sold[k % 8] or 0) % 9 for k in range(40)]},
        "supplier": {"s_suppkey": range(24), "s_nationkey": [k % 4 for k in range(24)], "s_acctbal": [owed[k % 6] for k in range(24)]},
    }
    for name, columns in frames.items():
        pq.write_table(pa.table({c: list(v) for c, v in columns.items()}), tmp_path / f"{name}.parquet")
    for name in ("nation", "region", "orders", "lineitem", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    df = QUERIES["federated_namesakes"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("customer", "supplier", "nation"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    cur = con.execute(ORACLE_SQL["federated_namesakes"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())
    assert "Inner" not in df._jdf.queryExecution().optimizedPlan().toString()
