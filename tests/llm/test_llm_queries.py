"""Queries that SQL can express, against DuckDB; and that every query runs with the columns asked for."""

import glob
import math
import os

import duckdb
import pytest

from presslens.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": {"source_a", "source_b"}, "p2_found": {"name_a", "name_b"}, "p3_found": {"url", "line_no"}, "p4_found": {"source_domain", "term"}, "p5_found": {"url_a", "url_b"},
    "p6_found": {"field", "item"}, "p7_found": {"ngram", "mark"}, "p8_ids": {"doc_id", "ids"}, "p9_found": {"doc_id", "item_id"}, "p10_found": {"doc_id"},
}


def norm(rows):
    return sorted(repr(tuple(round(x, 5) if isinstance(x, float) and not math.isnan(x) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.execute(registry.oracles()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert norm(df.select(*cols).collect()) == norm([tuple(r[i] for i in at) for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(map(str, r)) for r in df.collect()]
    assert set(df.columns) == COLUMNS[name] and len(got) == len(set(got))
