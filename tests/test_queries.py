"""Every registered query runs at the smallest scale and agrees with its SQL."""

import pytest

from docsentry.plans import catalogue
from tests.oracle_check import compare, duck


#: Queries that SQL cannot express; any other query without SQL fails.
NO_SQL = {"isolation_forest", "forest_grid", "anomaly_findings", "fp_classifier", "fp_likelihoods", "fp_grid_search"}


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf, name):
    status, _, _, detail = compare(spark, con, sf, name, catalogue.QUERIES[name], catalogue.ORACLES.get(name))
    assert status in ("ok", "EMPTY") or (status == "rows-only" and name in NO_SQL), detail


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
