"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math

import duckdb
import pytest

from assaykit.plans import catalog
from assaykit.sources.tables import TABLES
from conftest import SF_SMALL
from tools.oracle_check import rows_of

catalog.load_all()
QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLE[name])
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert len(s_rows) == len(d_rows)
    assert rows_of(sdf.columns, s_rows) == rows_of(rel.columns, d_rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_model_queries(spark, duck, name):
    """One finite prediction, with its true label, for each molecule of the validation split."""
    labels = QUERIES["training_set_labels"](spark, SF_SMALL).where("split = 'val'")
    expected = {r.molregno: r.pIC for r in labels.collect()}
    got = QUERIES[name](spark, SF_SMALL).collect()
    assert {r.molregno for r in got} == set(expected) and len(got) == len(expected) > 0
    assert all(r.pIC == pytest.approx(expected[r.molregno], abs=1e-6) and math.isfinite(r.predicted_pIC) for r in got)
    low, high = min(expected.values()), max(expected.values())
    assert all(low - 2 <= r.predicted_pIC <= high + 2 for r in got)


def test_every_query_named_and_registered():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) >= 70
