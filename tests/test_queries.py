"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from presslens.plans import registry

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracles()


def norm(rows):
    return sorted(repr(tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r)) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in cols)).collect()
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert norm(got) == norm([tuple(r[i] for i in at) for r in rel.fetchall()])


def test_the_rest_stands_without_the_subpackage():
    for folder, _, files in os.walk(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "presslens")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as x:
                    assert "presslens.llm" not in x.read(), f
