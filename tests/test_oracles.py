"""Every registered query against its SQL on the smallest tables; without SQL, rows only."""

import os

import pytest

import check_oracles as C
from crowdtide.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return C.database(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, problem = C.compare(spark, con, FOLDER, name, QUERIES[name], SQL.get(name))
    assert problem is None, problem
    if name not in ("filter_posts_window", "extract_mentions"):
        assert rows > 0
