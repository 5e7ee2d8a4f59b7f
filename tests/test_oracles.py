"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import pytest
from oracle import compare, connect

from quern.plans.catalogue import QUERIES
from quern.plans.oracles import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert compare(frame, con, ORACLE_SQL[name]) is None
    else:
        assert frame.count() >= 0 and name in ("kg_dfs", "scalable_bloom_add_if_new", "ivf_ip_batch")


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
