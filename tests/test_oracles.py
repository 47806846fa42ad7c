"""Each query against its SQL on the smallest tables."""

import math
import os

import pytest

from equilens import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.exists(SF):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.5g}" if v else "0"
    return str(v)[:26] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    r = con.sql(plans.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    at = [r.columns.index(c) for c in cols]
    assert sorted(tuple(norm(x[c]) for c in cols) for x in df.collect()) == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
