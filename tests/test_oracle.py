"""Every query against its SQL text. Of the model queries, whose time is fits, four stand for all;
``python tests/oracle.py`` compares the rest too."""

import pytest

import __spark_entry__ as entry
from muniframe.workload import model_queries
from oracle import connect, difference

DIRECTORY = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
FITTED = {"poisson_glm_cv", "tree_eval", "permutation_importance", "backward_elimination"}
COMPARED = sorted(set(SQL) - (set(model_queries.NAMES) - FITTED))


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", COMPARED)
def test_query_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, DIRECTORY), con, SQL[name]) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "WAPE" in df.columns
