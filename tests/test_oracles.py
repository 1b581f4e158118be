"""Every registered query against its SQL on the smallest driver tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
Q, O = queries(), oracle_sql()
SLOW = {"G01_clusters", "G01_cluster_invariants"}  # the clusters have their own tests


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in Q if n not in SLOW])
def test_query_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF, Q, O)
    assert ok, note


def test_names_and_schemas():
    assert set(O) <= set(Q)
