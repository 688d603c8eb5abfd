"""Every registered query against DuckDB on the smallest tables."""

import pytest
from compare import connect, differences

from faultsift.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, sf_dir, duck):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


# Python workers only where a model library asks for them; products of tables never, but for
# single values.
@pytest.mark.parametrize("name", ["localize_lexical", "prior_activity", "hit_at_k", "sampled_wrong_files", "tfidf_cosine"])
def test_plan_stays_in_the_jvm(name, spark, sf_dir):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for word in ("ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_scan_reads_needed_columns_only(spark, sf_dir):
    plan = QUERIES["prior_activity"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint>" in plan
    assert "l_extendedprice" not in plan
