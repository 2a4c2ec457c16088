"""Every query of the library against its SQL twin; those without one run and give rows."""

from __future__ import annotations

import pytest

from tessera import plans
from tests.conftest import canon

R = plans.loaded()


@pytest.mark.parametrize("name", sorted(R.ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    mine, theirs = canon(R.QUERIES[name](spark, sf).toPandas()), canon(duck.execute(R.ORACLE_SQL[name]).df())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(R.QUERIES) - set(R.ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert R.QUERIES[name](spark, sf).schema.names
    R.QUERIES[name](spark, sf).toPandas()
