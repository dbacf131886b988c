"""Registered queries against SQL where it can say the same, and rows for the others."""

import check
import pytest

from sparkdraft.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.duck(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    problem, _ = check.compare(spark, con, FOLDER, QUERIES[name])
    assert problem is None, problem


def test_every_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_pack_sequences", "op3_mix_sources", "op5_language_id"])
def test_reruns_agree(spark, name):
    run = QUERIES[name].run
    first, second = (sorted(map(repr, run(spark, FOLDER).collect())) for _ in range(2))
    assert first == second
