"""Registered queries of this subpackage that SQL states, against DuckDB."""

import sys
from pathlib import Path

import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None


def test_every_operator_is_registered():
    assert sorted({int(name[2:].split("_")[0]) for name in QUERIES}) == list(range(1, 14))
