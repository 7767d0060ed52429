"""Every registered query of the relational part against its SQL, and the invariants of the random ones."""

import pytest

from loomkin.plans import catalog
from tests.compare import check, connect

SQL = catalog.oracle_sql()
INVARIANT = sorted(set(catalog.queries()) - set(SQL))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    check(catalog.queries()[name](spark, sf), con, SQL[name])


def test_match_by_model_with_one_large_group(spark):
    from loomkin.model.domain import Domain
    from loomkin.model.group import GroupSettings, fit_groups, long_types
    from loomkin.operators import marginals as M
    from loomkin.operators import matching as J

    rows = [(i, i % 30 if i < 200 else 30, i % 2, i % 3) for i in range(300)]
    c, own = spark.createDataFrame(rows, "id long, fk long, a int, b int"), Domain({"a": 2, "b": 3})
    model = fit_groups(c.select("fk", "a", "b"), "fk", own, GroupSettings(types=2, steps=1))
    types = M.argmax_types(long_types(model.q, "fk"), "fk", ["y"]).withColumnRenamed("fk", "pk")
    for some, n in ((c, 300), (c.where("id < 20"), 20)):
        got = J.match_by_model(model, some.select("id", "a", "b"), types, "id", "pk", "y").collect()
        assert len(got) == len({r.id for r in got}) == n and {r.pk for r in got} <= set(range(31))


def test_every_query_has_sql():
    assert INVARIANT == []
