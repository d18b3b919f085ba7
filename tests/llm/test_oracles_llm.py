"""Queries of this subpackage against their DuckDB SQL, and the registry's shape."""

import glob
import os

import duckdb
import pytest

from seekloom.llm import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    rel = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(x)]) for x in columns) for r in rel.fetchall())


def test_ten_operators_and_the_pipeline_are_registered():
    names = registry.queries()
    assert {n.split("_")[0] for n in names if n != "pipeline"} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names
