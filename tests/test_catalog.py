"""Every registered core query against DuckDB on the smallest tables, where they exist."""

import os
import subprocess
import sys

import pytest

from loomdex import queries as core

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = core.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    con.execute(core.SQL[name])
    names = [d[0] for d in con.description]
    want = sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in con.fetchall())
    assert sorted(names) == cols and got == want


def test_core_without_llm():
    """The rest imports and registers when the llm package is missing."""
    code = "import sys; sys.modules['loomdex.llm'] = None; import __spark_entry__ as e; assert 'bm25_best_fields' in e.queries() and not any(k[0] == 'p' and k[1].isdigit() for k in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
