"""Every query with SQL against DuckDB, and every query for rows, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NO_LLM = {n: q for m in entry._MODULES for n, q in __import__(m, fromlist=["QUERIES"]).QUERIES.items()}
SQL = {n: q for m in entry._MODULES for n, q in __import__(m, fromlist=["SQL"]).SQL.items()}


def plain(v):
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in sorted(Path(SF).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = NO_LLM[name](spark, SF)
    columns = sorted(df.columns)
    relation = con.sql(SQL[name])
    assert columns == sorted(relation.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((plain(r) for r in relation.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(NO_LLM) - set(SQL) - {"p1_found"}))
def test_gives_rows(spark, name):
    assert NO_LLM[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["k", "value", "props"]


def test_nothing_outside_names_the_text_package():
    root = Path(entry.__file__).parent / "tidemark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text(), p
