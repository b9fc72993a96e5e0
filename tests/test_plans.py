"""Every registered core query against its SQL on the smallest tables."""

import math
import os

import pytest

from litquarry.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    found = rows(got.columns, got.collect())
    if name not in SQL:
        return
    with duckdb.connect() as c:
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        c.execute(SQL[name])
        wanted = rows([d[0] for d in c.description], c.fetchall())
    assert found == wanted
