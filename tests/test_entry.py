import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "score", "source", "label"]
    assert [r[0] for r in df.orderBy("score", ascending=False).collect()] == [0, 17, 225, 12, 483]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_llm():
    code = "import sys; sys.modules['quillon.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_llm():
    files = [p for p in (ROOT / "quillon").rglob("*.py") if "llm" not in p.parts]
    assert files and not [p for p in files if re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M)]
