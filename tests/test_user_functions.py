"""Functions of groups on keys and values that the test tables lack."""

import os

import pytest
from comparing import DATA, same

from brindle import catalog
from brindle.tables import NAMES

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null keys on both sides, orders by the hour, weights of zero."""
    home = tmp_path_factory.mktemp("odd")
    for name in set(NAMES) - {"orders", "events", "lineitem"}:
        os.symlink(f"{DATA}/sf0.001/{name}.parquet", home / f"{name}.parquet")
    dates = ["1996-01-01 23:00:00", "1996-01-02 01:00:00", "1996-01-02 02:00:00", None]
    orders = [(k, [1, 2, None, 2**60 + 1][k % 4], dates[k // 4 % 4]) for k in range(15)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "'F' o_orderstatus", "1.0D o_totalprice", "CAST(d AS timestamp_ntz) o_orderdate", "'x' o_orderpriority").coalesce(1).write.parquet(f"{home}/orders.parquet")
    users = [1, None, None, 7, 2**60]
    spark.createDataFrame([(k, users[k % 5]) for k in range(23)], "event_id long, user_id long").selectExpr("event_id", "timestamp_ntz'2024-01-01' ts", "user_id", "'view' event_type", "1.0D value", "'{}' props").coalesce(1).write.parquet(f"{home}/events.parquet")
    lines = [(1, 0.1, 0.0), (1, 0.2, 0.0), (2, 0.1, 3.0), (2, None, 1.0), (3, None, None), (None, 0.5, 2.0), (None, 0.1, 2.0), (2**60 + 1, 0.07, 5.0), (2**60, 0.01, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_discount double, l_quantity double").coalesce(1).write.parquet(f"{home}/lineitem.parquet")
    return str(home)


@pytest.mark.parametrize("name", ["udf_pandas_aggregate", "apply_in_pandas", "cogroup_in_pandas"])
@pytest.mark.parametrize("rows", [2, 8192])
def test_odd_keys(spark, odd, monkeypatch, name, rows):
    from brindle.plans import user_functions

    monkeypatch.setattr(user_functions, "GROUP_ROWS", rows, raising=False)
    same(catalog.queries()[name](spark, odd), odd, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["udf_pandas_aggregate", "apply_in_pandas", "cogroup_in_pandas"])
def test_a_call_gets_many_keys(spark, name):
    plan = catalog.queries()[name](spark, f"{DATA}/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(" in plan
