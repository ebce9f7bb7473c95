"""Every query against its SQL at the smallest scale, and the package without its llm parts."""

import glob
import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, query, sql):
    rows = [r.asDict() for r in query(spark, SF).collect()]
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = sorted(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in result.fetchall())
    assert not rows or set(rows[0]) == set(names)
    assert sorted(tuple(plain(r[n]) for n in sorted(names)) for r in rows) == want


def test_queries_equal_their_sql(spark, duck):
    from factloom.plans.queries import QUERIES, SQL

    assert len(QUERIES) > 40
    for name, query in QUERIES.items():
        if name in SQL:
            try:
                compare(spark, duck, query, SQL[name])
            except AssertionError as e:
                raise AssertionError(name) from e


def test_queries_without_sql_run(spark):
    from factloom.plans.queries import QUERIES, SQL

    for name in QUERIES.keys() - SQL.keys():
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_llm(tmp_path):
    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


@pytest.mark.parametrize("llm", [True, False])
def test_entry_with_the_pipeline_alone_or_without_a_dependency(tmp_path, llm):
    """The pipeline's file without the subpackage, and the subpackage without a module that it needs."""
    shutil.copytree(ROOT / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("__pycache__", *([] if llm else ["llm"])))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path)
    # the stages themselves don't need that module
    code = f"import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') for n in q) and ('pipeline' in q) == {llm}, list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for path in (ROOT / "factloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
