"""The driver's contract, and every core query with SQL against DuckDB on the smallest tables."""

import ast
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from twinloom.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(normal, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for t in os.listdir(SF):
        c.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


def test_core_imports_nothing_optional():
    for f in (ROOT / "twinloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names)


def test_contract(spark):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and all(map(callable, q.values()))
    assert __spark_entry__.entry(spark).limit(1).count() == 1


SLOW = {"classifier_fold_scores", "permutation_importance"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.ORACLE:
        x = duck.execute(catalogue.ORACLE[name])
        names = [d[0] for d in x.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(normal(r[names.index(c)]) for c in cols) for r in x.fetchall()), key=repr)
    else:
        assert got
