"""Registered queries of the subpackage against their SQL, and on every table for their shape."""

import pytest

from loomkin.llm import registry
from tests.compare import check, connect

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert check(registry.queries()[name](spark, sf), con, SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_all_documents_come_out(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    table, key = {"op2": ("pages", "page_id"), "op5": (None, None)}.get(name.split("_")[0], ("documents", "doc_id"))
    if table:
        want = {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()}
        assert {r[0] for r in df.select(key).collect()} == want


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_benchmark_decontamination", "op5_chat_preference", "op7_quality_rules"])
def test_native_operators_run_no_python(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
