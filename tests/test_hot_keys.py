"""Order, ranks, percentiles and as-of joins where one key has most rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.operators import ranges, sampling, selection
from brindle.operators.joins import as_of
from brindle.operators.ranking import KINDS, ranks


@pytest.fixture
def spread(spark):
    """Small tables stay in several partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _rows(n=3000, seed=1):
    """A hot group, a null one, small ones; many ties, nulls among the values."""
    rng = random.Random(seed)
    groups = ["hot"] * 8 + [None, "a", "b", "c"]
    return [(k, rng.choice(groups), rng.choice([None, *range(40)]), rng.random()) for k in range(n)]


def test_places_in_groups(spread):
    df = spread.createDataFrame(_rows(), "id long, g string, v long, x double").repartition(6)
    ordered = ranges.in_order(df, ["g"], [F.col("v").asc_nulls_first(), F.col("id")])
    parts = ordered.groupBy("g", "_part").count().collect()
    # The hot group lies in several partitions, and none has most of it.
    hot = [r["count"] for r in parts if r.g == "hot"]
    assert len(hot) >= 4 and max(hot) < 0.5 * sum(hot)
    got = {r.id: (r.place, r.size) for r in ranges.numbered(ordered, ["g"], "place", size="size").collect()}
    w = Window.partitionBy("g")
    want = df.withColumn("place", F.row_number().over(w.orderBy(F.col("v").asc_nulls_first(), "id")) - 1).withColumn("size", F.count("*").over(w))
    assert got == {r.id: (r.place, r.size) for r in want.collect()}


@pytest.mark.parametrize("tiles", [1, 4, 5000])
def test_ranks_as_windows_give_them(spread, tiles):
    df = spread.createDataFrame(_rows(), "id long, g string, v long, x double").repartition(6)
    got = ranks(df, ["g"], ["v"], {k: k for k in KINDS}, ties=["id"], tiles=tiles)
    peers, rows = Window.partitionBy("g").orderBy("v"), Window.partitionBy("g").orderBy("v", "id")
    want = df.select(
        *df.columns, F.row_number().over(rows).alias("row_number"), F.rank().over(peers).alias("rank"), F.dense_rank().over(peers).alias("dense_rank"),
        F.percent_rank().over(peers).alias("percent_rank"), F.cume_dist().over(peers).alias("cume_dist"), F.ntile(tiles).over(rows).alias("ntile"),
    )
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_ranks_of_ties_only_and_of_nothing(spread):
    df = spread.range(500).withColumn("g", F.lit("x")).withColumn("v", F.lit(3))
    got = ranks(df, ["g"], ["v"], {"rank": "r", "dense_rank": "d", "cume_dist": "c", "percent_rank": "p"}, ties=["id"]).select("r", "d", "c", "p").distinct().collect()
    assert [tuple(r) for r in got] == [(1, 1, 1.0, 0.0)]
    assert ranks(df.limit(0), ["g"], ["v"], {"rank": "r"}).collect() == []
    with pytest.raises(ValueError):
        ranks(df, ["g"], ["v"], {"median": "m"})


def _as_of(left, right, strict, forward=False, tolerance=None):
    out, sign = Counter(), -1 if forward else 1
    for k, t, i in left:
        fits = [(sign * s, v) for g, s, v in right if None not in (k, t, g, s) and g == k and (sign * s < sign * t or s == t and not strict)]
        if fits and tolerance is not None and abs(t - sign * max(fits)[0]) > tolerance:
            fits = []
        out[k, t, i, max(fits)[1] if fits else None] += 1
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_as_of_over_buckets(spread, strict, width):
    """One key with nearly all rows; equal times on both sides and within one, nulls, empty buckets."""
    rng = random.Random(width)
    keys = ["hot"] * 9 + ["b", None]
    left = [(rng.choice(keys), rng.choice([None, *range(-60, 200)]), i) for i in range(700)]
    right = [(rng.choice(keys), rng.choice([None, *range(-20, 60), 150]), i) for i in range(120)]
    a = spread.createDataFrame(left, "k string, t long, i long")
    b = spread.createDataFrame(right, "k string, t long, v long")
    for forward, tolerance in ((False, None), (True, None), (True, 5), (False, 0)):
        got = as_of(a, b, ["k"], "t", ["v"], strict, width, forward, tolerance)
        assert Counter(map(tuple, got.collect())) == _as_of(left, right, strict, forward, tolerance), (forward, tolerance)
    none = as_of(a, b.limit(0), ["k"], "t", ["v"], strict, width)
    assert none.filter("v IS NOT NULL").count() == 0 and none.count() == len(left)


def test_as_of_spreads_a_hot_key(spread):
    """No task of the window has a large share of the one key."""
    df = spread.range(10_000).select(F.lit("x").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    found = as_of(df.select("k", "t"), df, ["k"], "t", ["v"], width=100)
    assert "hashpartitioning(k" in found._jdf.queryExecution().executedPlan().toString()
    sizes = df.withColumn("p", F.pmod(F.hash("k", F.floor(F.col("t") / 100)), F.lit(7))).groupBy("p").count().collect()
    assert len(sizes) == 7 and max(r["count"] for r in sizes) < 3_000
    assert found.filter("v <> t").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_by_selection(spread, monkeypatch, seed):
    """Against Spark's own percentile: few bins, so that there are several rounds; extreme, tied, null values."""
    monkeypatch.setattr(selection, "BINS", 4)
    rng = random.Random(seed)
    odd = [None, 0.0, -0.0, 1e-300, -1e300, 1.7e308, -1.7e308, 5e-324, 7.5]
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), rng.choice(odd) if rng.random() < 0.3 else rng.gauss(0, 1)) for _ in range(900)]
    rows += [("one", 2.0), ("none", None), ("nan", float("nan")), ("nan", float("inf")), ("nan", 4.0)]
    df = spread.createDataFrame(rows, "k string, v double")
    places = [("low", 0.0), ("some", 0.137), ("mid", 0.5), ("top", 1.0)]
    got = {r.k: (r.low, r.some, r.mid, r.top) for r in selection.quantiles(df, "k", "v", places).collect()}
    finite = df.filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')").groupBy("k")
    want = finite.agg(*(F.percentile("v", F.lit(s)).alias(n) for n, s in places)).collect()
    assert set(got) == {r.k for r in want}
    for r in want:
        assert got[r.k] == pytest.approx((r.low, r.some, r.mid, r.top), rel=1e-12, abs=1e-12)


def test_percentiles_read_no_group_in_order(spread):
    """Windows are over bins alone, never over values."""
    df = spread.range(1000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    left = selection.cut(df.groupBy("k").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    left = left.select(F.col("k").alias("_k"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.array(F.lit(500).cast("long")).alias("_ranks"))
    plan = selection._refined(df.select(F.col("k").alias("_k"), F.col("v").alias("_v")), F.broadcast(left))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_k" in plan and "_bin" in plan.split("windowspecdefinition")[1].split(")")[0]
    assert selection.quantiles(df, "k", "v", [("m", 0.5)]).first().m == 499.5


def test_samples(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 4).cast("string").alias("s"), F.lit(1).alias("x"))
    a = {r.k for r in sampling.by_key(df, "k", 0.1, "one").collect()}
    b = {r.k for r in sampling.by_key(df.repartition(9), "k", 0.1, "one").collect()}
    c = {r.k for r in sampling.by_key(df, "k", 0.1, "two").collect()}
    assert a == b != c and abs(len(a) - 2000) < 220 and a < {r.k for r in sampling.by_key(df, "k", 0.3, "one").collect()}
    n = Counter(r.s for r in sampling.stratified(df, "k", "s", {"0": 1.0, "1": 0.5}, "one").collect())
    assert n["0"] == 5000 and abs(n["1"] - 2500) < 200 and set(n) == {"0", "1"}
    odd = spark.createDataFrame([(None, None), (1, None), (None, "0")], "k long, s string")
    assert sampling.by_key(odd, "k", 1.0, "x").count() == 1 and sampling.stratified(odd, "k", "s", {"0": 1.0}, "x").count() == 0


def test_ranks_look_ahead_once(spread):
    """A frame that ends a group is read anew for each row, so none is used."""
    df = spread.createDataFrame(_rows(), "id long, g string, v long, x double")
    plan = ranks(df, ["g"], ["v"], {k: k for k in KINDS}, ties=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
