"""Every registered query with an oracle equals its DuckDB SQL (sf0.001)."""

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

from wattline.plans.catalog import QUERIES
from wattline.plans.oracle import ORACLE

SLOW = {"kwh_model_metrics", "top_features", "predict_range_model", "model_registry", "kwh_model_check", "predict_model_check"}
NAMES = sorted(set(ORACLE) - {"kwh_model_check", "predict_model_check"})  # these train whole models


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF_SMALL).toPandas()
    dk = con.execute(ORACLE[name]).df()
    assert compare(sp, dk) == []


def test_every_query_runs(spark):
    for name, fn in QUERIES.items():
        if name in SLOW or name in ORACLE:
            continue
        assert fn(spark, SF_SMALL).count() >= 0


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0
