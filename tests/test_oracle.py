"""Every registered query against its SQL on the smallest data."""

import pytest
from compare import compare, duck

from equispark.registry.all import QUERIES

FOLDER = "/root/testdata/sf0.001"
ORACLES = {name: query.oracle() for name, query in QUERIES.items() if query.sql is not None}
RUNS = {name: query.frame for name, query in QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_an_oracle():
    assert set(RUNS) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_matches_oracle(spark, con, name):
    problem = compare(RUNS[name](spark, FOLDER), con, ORACLES[name])
    assert problem in ("", "EMPTY on both sides"), problem
