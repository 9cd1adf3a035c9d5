"""Every registered query of the package against its SQL form, on the smallest data."""

import pytest

from gridwake.plans import REGISTRY

from .oracle import DATA, by_sql, differences


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if q.sql))
def test_matches_sql(spark, name):
    q = REGISTRY[name]
    assert not differences(q.run(spark, DATA).toPandas(), by_sql(q.sql))


@pytest.mark.parametrize("name", sorted(n for n, q in REGISTRY.items() if not q.sql))
def test_runs(spark, name):
    assert REGISTRY[name].run(spark, DATA).columns
