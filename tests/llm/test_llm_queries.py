"""Queries of this subpackage: as their SQL where there is one, and that the others run."""

from collections import Counter

import pytest

from tallyloom.llm.queries import QUERIES, SQL
from tests.test_queries import DATA, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    r = duck.execute(SQL[name])
    names = [c[0] for c in r.description]
    order = sorted(names)
    assert order == sorted(df.columns)
    at = [names.index(c) for c in order]
    assert Counter(tuple(plain(x[c]) for c in order) for x in got) == Counter(tuple(plain(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
