"""Every registered query of the engine's own operators against its SQL counterpart, at the smallest size."""

import glob
import os

import duckdb
import pytest

from lodestar.plans import fact_queries, report_queries, structure_queries  # noqa: F401  register their queries with the others
from lodestar.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a, b = (x[columns].astype(str).sort_values(columns).to_numpy().tolist() for x in (got, want))
    assert a == b
