"""Every query against its checking SQL on the smallest tables; queries without SQL must run and give rows."""

from __future__ import annotations

import pytest
from lectern.plans import q_corpus, q_grading, q_mastery, q_reports, q_retrieval, q_streams  # noqa: F401
from lectern.registry import ORACLES, QUERIES

from .oracle import connect, rows

#: The smallest tables may leave these empty.
MAY_BE_EMPTY = {"u2_removed_topics", "w19_smoothed_scores"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got) > 0 or name in MAY_BE_EMPTY
