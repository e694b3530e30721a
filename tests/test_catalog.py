"""Every query that SQL can express, against DuckDB."""

import pytest
from comparing import DATA, same
from pyspark.sql import functions as F

from brindle import catalog

SQL = catalog.oracle_sql()

@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    sf_dir = f"{DATA}/sf0.01"
    same(catalog.queries()[name](spark, sf_dir), sf_dir, SQL[name])

@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_others_have_rows(spark, name):
    assert catalog.queries()[name](spark, f"{DATA}/sf0.001").count() > 0

def test_sketches_come_near(spark):
    lines = spark.read.parquet(f"{DATA}/sf0.01/lineitem.parquet").groupBy("l_returnflag")
    exact = {r.l_returnflag: r for r in lines.agg(F.count_distinct("l_partkey").alias("parts"), F.median("l_extendedprice").alias("middle")).collect()}
    for r in catalog.queries()["agg_sketches"](spark, f"{DATA}/sf0.01").collect():
        want = exact[r.l_returnflag]
        for parts in (r.parts_hll_pp, r.parts_hll, r.parts_theta):
            assert abs(parts - want.parts) <= 0.05 * want.parts
        for middle in (r.middle_approx, r.middle_kll):
            assert abs(middle - want.middle) <= 0.03 * want.middle
        assert len(r.top_lines) == 3


def test_sample_is_of_its_size(spark):
    """A seeded sample, the same on a second run."""
    orders = spark.read.parquet(f"{DATA}/sf0.01/orders.parquet")
    n = orders.count()
    found = [{r.o_orderkey for r in orders.sample(fraction=0.1, seed=7).collect()} for _ in range(2)]
    assert found[0] == found[1] and abs(len(found[0]) - 0.1 * n) < 5 * (0.09 * n) ** 0.5


def test_percentiles_of_ties_and_nulls(spark):
    from brindle.operators.selection import quantiles

    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("a", None), ("b", 7.0), ("c", None)], "k string, v double")
    got = {r.k: (r.low, r.mid, r.top) for r in quantiles(rows, "k", "v", [("low", 0.0), ("mid", 0.75), ("top", 1.0)]).collect()}
    assert got == {"a": (1.0, 2.5, 4.0), "b": (7.0, 7.0, 7.0)}


def test_unions_of_sketches_lose_nothing(spark):
    """A union is as fine as its parts: of a sketch and of one of a part of its values, it is that sketch."""
    from brindle.operators import sketches

    rows = spark.range(90_000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), (F.col("id") % 3).alias("part"))
    agg = lambda c: F.theta_sketch_agg(c, sketches.LG)
    pair = rows.agg(agg("k").alias("a"), agg(F.when(F.col("part") == 0, F.col("k"))).alias("b"), F.theta_sketch_estimate(agg("k")).alias("n"))
    got = pair.select("n", sketches.overlap(F.col("a"), F.col("b"))["either"].alias("either")).first()
    assert got.either == got.n
    united = sketches.united(sketches.by_part(rows, ["part"], "k", "x"), []).select(F.theta_sketch_estimate("theta").alias("n")).first()
    assert united.n == got.n
