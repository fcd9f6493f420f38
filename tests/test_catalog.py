"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from loomwright.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings docs chunks workflows nodes terms".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool | str):
        return v
    try:
        return round(float(v), 4)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    wanted = Counter(tuple(map(cell, r)) for r in found.fetchall())
    df = catalog.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(cell(r[c]) for c in names) for r in df.collect()) == wanted


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).columns == ["question_id", "workflow_id", "confidence", "explanation"]
