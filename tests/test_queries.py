"""Every registered query against its SQL, on the smallest data set."""

import check
import pytest

from sparkdraft.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, con, name):
    problem, _ = check.compare(spark, con, FOLDER, QUERIES[name])
    assert problem is None, problem


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2048
    assert set(entry.oracle_sql()) <= set(entry.queries())
