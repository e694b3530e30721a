"""Aggregations, pivots and window functions, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sketches
from ..operators.grouping import sessions
from ..operators.ranking import ranks as ranked
from ..operators.selection import quantiles
from ..shared_folder import cut
from ..tables import table
from .relational import money


def pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate <= '1998-09-02'")
    net = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum(money("l_extendedprice")).cast("double").alias("sum_base"),
        F.sum(net).cast("double").alias("sum_net"),
        F.min("l_quantity").alias("min_qty"),
        F.max("l_quantity").alias("max_qty"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("n"),
    )


PRICING = """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_net,
       min(l_quantity) AS min_qty, max(l_quantity) AS max_qty, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL
"""


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.count_distinct("l_partkey").alias("parts"),
            F.sum_distinct("l_linenumber").cast("long").alias("numbers"),
            F.count_if(F.col("l_quantity") > 25).alias("large"),
        )
        .filter("parts > 10")
    )


DISTINCT = """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers,
       count(*) FILTER (WHERE l_quantity > 25) AS large
FROM lineitem GROUP BY l_returnflag HAVING count(DISTINCT l_partkey) > 10
"""


def _levels(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "lineitem")
        keys = ("l_returnflag", "l_linestatus")
        if kind == "sets":
            grouped = lines.groupingSets([[F.col(keys[0])], [F.col(keys[1])], []], *map(F.col, keys))
        else:
            grouped = getattr(lines, kind)(*keys)
        return grouped.agg(
            F.grouping("l_returnflag").cast("long").alias("over_flag"), F.grouping("l_linestatus").cast("long").alias("over_status"),
            F.sum("l_quantity").alias("qty"), F.count("*").alias("n"),
        )

    return run


def _levels_sql(clause: str) -> str:
    return f"""
SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS over_flag, grouping(l_linestatus) AS over_status,
       sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY {clause}
"""


def pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter("l_linestatus IN ('F', 'O')")
    return lines.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


PIVOTED = """
SELECT l_returnflag, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS F,
       sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS O FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY l_returnflag
"""


def unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return lines.unpivot(["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "what", "rate")


UNPIVOTED = """
SELECT l_orderkey, l_linenumber, 'l_discount' AS what, l_discount AS rate FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
"""


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def near(c, name):
        return F.round(c, 6).alias(name)

    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            near(F.stddev_samp("l_quantity"), "deviation"),
            near(F.var_pop("l_quantity"), "variance"),
            near(F.covar_samp("l_quantity", "l_discount"), "covariance"),
            near(F.corr("l_quantity", "l_extendedprice"), "correlation"),
            near(F.skewness("l_quantity"), "skewness"),
            near(F.kurtosis("l_quantity"), "kurtosis"),
        )
    )


MOMENTS = """
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_quantity), 6) AS variance,
       round(covar_samp(l_quantity, l_discount), 6) AS covariance, round(corr(l_quantity, l_extendedprice), 6) AS correlation,
       round(avg(power((l_quantity - mu) / sd, 3)), 6) AS skewness, round(kurtosis_pop(l_quantity), 6) AS kurtosis
FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_quantity) AS mu, stddev_pop(l_quantity) AS sd FROM lineitem GROUP BY 1) ON f = l_returnflag
GROUP BY l_returnflag
"""


def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    facts = orders.groupBy("o_orderpriority").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"),
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest"),
        F.bool_and(F.col("o_totalprice") > 0).alias("all_positive"),
        F.bool_or(F.col("o_orderstatus") == "F").alias("any_closed"),
    )
    middle = quantiles(orders, "o_orderpriority", "o_totalprice", [("middle", 0.5), ("p90", 0.9)])
    return facts.join(middle, "o_orderpriority").withColumn("p90", F.round("p90", 6)).withColumn("middle", F.round("middle", 6))


ORDER_STATISTICS = """
SELECT o_orderpriority, round(median(o_totalprice), 6) AS middle, round(quantile_cont(o_totalprice, 0.9), 6) AS p90,
       max_by(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS dearest, min_by(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS cheapest,
       bool_and(o_totalprice > 0) AS all_positive, bool_or(o_orderstatus = 'F') AS any_closed FROM orders GROUP BY o_orderpriority
"""


def small_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates that keep a group's distinct values, of a column that has few: 50 sizes."""
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_type")
        .agg(
            F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("low"),
            F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size)").alias("middle"),
            F.mode(F.when(F.col("p_size") <= 3, F.lit("small")).otherwise("large")).alias("commonest"),
            F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"),
            F.round(F.regr_r2("p_retailprice", "p_size"), 6).alias("r2"),
            F.any_value(F.when(F.col("p_size") > 0, F.lit("yes"))).alias("any_size"),
            F.count_if(F.col("p_size") > 25).alias("n_large"),
            F.bit_or("p_size").alias("bits"),
        )
    )


SMALL_DOMAIN = """
SELECT p_type, quantile_disc(p_size, 0.25) AS low, CAST(quantile_cont(p_size, 0.5) AS DOUBLE) AS middle,
       mode(CASE WHEN p_size <= 3 THEN 'small' ELSE 'large' END) AS commonest,
       round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_r2(p_retailprice, p_size), 6) AS r2,
       any_value(CASE WHEN p_size > 0 THEN 'yes' END) AS any_size, count(*) FILTER (p_size > 25) AS n_large, bit_or(p_size) AS bits
FROM part GROUP BY p_type
"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of a nation, at most a few in a thousand of all, listed in SQL."""
    return spark.sql(
        "SELECT s_nationkey, listagg(s_name, ';') WITHIN GROUP (ORDER BY s_name) AS names FROM {supplier} GROUP BY ALL",
        supplier=table(spark, sf_dir, "supplier"),
    )


LISTED = "SELECT s_nationkey, string_agg(s_name, ';' ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey"


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region by name; a region has a few."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey")
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    return nations.agg(names.alias("names"), F.size(F.collect_set("n_nationkey")).cast("long").alias("n"))


COLLECTED = """
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_nationkey) AS n FROM nation GROUP BY n_regionkey
"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are 25 nations, whatever the number of customers."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    by_balance = {"row_number": "n", "ntile": "quarter", "percent_rank": "percent", "cume_dist": "share"}
    found = ranked(customers, ["c_nationkey"], ["c_acctbal", "c_custkey"], by_balance)
    found = ranked(found, ["c_nationkey"], ["c_mktsegment"], {"rank": "r", "dense_rank": "d"}, ties=["c_custkey"])
    return found.select("c_custkey", "n", "r", "d", "quarter", F.round("percent", 9).alias("percent"), F.round("share", 9).alias("share"))


RANKS = """
SELECT c_custkey, row_number() OVER w AS n, rank() OVER s AS r, dense_rank() OVER s AS d, ntile(4) OVER w AS quarter,
       round(percent_rank() OVER w, 9) AS percent, round(cume_dist() OVER w, 9) AS share
FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), s AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)
"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lag("event_type").over(w).alias("before"),
        F.lead("event_type", 1, "none").over(w).alias("after"),
        F.first("event_id").over(whole).alias("first_id"),
        F.last("event_id").over(whole).alias("last_id"),
        F.nth_value("event_id", 2).over(whole).alias("second_id"),
        F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w).alias("click_id"),
    )


NEIGHBOURS = """
SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 1, 'none') OVER w AS after,
       first_value(event_id) OVER a AS first_id, last_value(event_id) OVER a AS last_id, nth_value(event_id, 2) OVER a AS second_id,
       last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS click_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
     a AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = F.col("value").cast("decimal(12,2)")
    seconds = F.col("ts").cast("timestamp").cast("long")
    day = Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-86400, 0)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.sum(value).over(order.rowsBetween(-2, 0)).cast("double").alias("last_three"),
        F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("so_far"),
        F.count("*").over(day).alias("in_a_day"),
    )


FRAMES = """
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (w ROWS 2 PRECEDING) AS DOUBLE) AS last_three,
       CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS so_far,
       count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_a_day
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.col("value").cast("decimal(12,2)")).cast("double")
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", 1800, {"total": total}).drop("session")


USER_SESSIONS = """
WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM n GROUP BY user_id, session
"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return hours.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


HOURLY = "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def approximations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of bounded size; tests hold them against the exact figures."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.01).alias("parts_hll_pp"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("parts_hll"),
        F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey, 14))").alias("parts_theta"),
        F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("middle_approx"),
        F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(l_extendedprice), 0.5)").alias("middle_kll"),
        F.expr("approx_top_k(l_linenumber, 3)").getField("item").alias("top_lines"),
        F.count("*").alias("n"),
    )


def distinct_by_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts of each flag from bitmaps that are merged, exactly."""
    lines = table(spark, sf_dir, "lineitem")
    bucket = F.bitmap_bucket_number("l_partkey").alias("bucket")
    parts = lines.groupBy("l_returnflag", bucket).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("l_partkey"))).alias("n"))
    return parts.groupBy("l_returnflag").agg(F.sum("n").alias("parts"))


DISTINCT_BY_BITMAP = "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag"


#: How far estimates from united sketches may be off: distinct values by share (their standard error is 0.008), ranks by
#: share of rows (0.0165 in 99 of 100 cases; KLL sketches toss coins).
NEAR, RANK = 0.03, 0.035


def _close(estimate, exact):
    return F.abs(estimate - exact) <= NEAR * exact


def united_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by flag and month are kept, then united by flag: the exact figures, and whether the sketches' come near."""
    lines = table(spark, sf_dir, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    kept = cut(sketches.by_part(lines, ["l_returnflag", "month"], "l_orderkey", "l_extendedprice"))
    whole = sketches.united(kept, ["l_returnflag"])
    middle = F.kll_sketch_get_quantile_double("kll", F.lit(0.5))
    whole = whole.select("l_returnflag", "n", F.hll_sketch_estimate("hll").alias("hll"), F.theta_sketch_estimate("theta").alias("theta"), middle.alias("middle"))
    # Three flags: the estimates are broadcast to count the rows up to them.
    exact = lines.join(F.broadcast(whole.select("l_returnflag", "middle")), "l_returnflag").groupBy("l_returnflag")
    exact = exact.agg(F.count_distinct("l_orderkey").alias("orders"), F.avg((F.col("l_extendedprice") <= F.col("middle")).cast("double")).alias("up_to"))
    return exact.join(whole, "l_returnflag").select(
        "l_returnflag", "n", "orders", _close(F.col("hll"), F.col("orders")).alias("hll_near"), _close(F.col("theta"), F.col("orders")).alias("theta_near"),
        (F.abs(F.col("up_to") - 0.5) <= RANK).alias("middle_near"),
    )


UNITED_SKETCHES = """
SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, true AS hll_near, true AS theta_near, true AS middle_near
FROM lineitem GROUP BY l_returnflag
"""


def sketch_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of two years, from one theta sketch a year: how many bought in both, the first only, either. The
    exact figures, and whether the estimates come near (by NEAR of all in either)."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate")).filter("year IN (1996, 1997)")
    years = orders.groupBy("year").agg(F.theta_sketch_agg("o_custkey", sketches.LG).alias("theta"))
    pair = years.agg(*(F.any_value(F.when(F.col("year") == y, F.col("theta")), ignoreNulls=True).alias(f"y{y}") for y in (1996, 1997)))
    guess = pair.select(*(c.alias(f"{n}_guess") for n, c in sketches.overlap(F.col("y1996"), F.col("y1997")).items()))
    each = orders.groupBy("o_custkey").agg(F.bool_or(F.col("year") == 1996).alias("a"), F.bool_or(F.col("year") == 1997).alias("b"))
    exact = each.agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND NOT b")).alias("only"), F.count("*").alias("either"))
    # One row each.
    near = [(F.abs(F.col(f"{n}_guess") - F.col(n)) <= NEAR * F.col("either")).alias(f"{n}_near") for n in ("both", "only", "either")]
    return exact.join(F.broadcast(guess)).select("both", "only", "either", *near)


SKETCH_OVERLAP = """
WITH c AS (SELECT o_custkey, bool_or(year(o_orderdate) = 1996) AS a, bool_or(year(o_orderdate) = 1997) AS b
           FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1)
SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only, count(*) AS either,
       true AS both_near, true AS only_near, true AS either_near FROM c
"""


def count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each part from count-min sketches by flag, united: none is under the exact count, and few are far over."""
    lines = table(spark, sf_dir, "lineitem")
    kept = cut(sketches.count_min(lines, "l_partkey", ["l_returnflag"]))
    exact = lines.groupBy("l_partkey").agg(F.count("*").alias("n"))
    guess = sketches.estimated(exact, "l_partkey", kept)
    rows = kept.filter("row = 0").agg(F.sum("n").alias("rows"))
    over = F.col("estimate") - F.col("n")
    both = exact.join(guess, "l_partkey").join(F.broadcast(rows))
    found = both.agg(F.count("*").alias("parts"), F.count_if(over < 0).alias("under"), F.avg((over > 2.72 / sketches.WIDTH * F.col("rows")).cast("double")).alias("far"))
    return found.select("parts", "under", (F.col("far") <= 0.01).alias("far_are_few"))


COUNT_MIN = "SELECT count(DISTINCT l_partkey) AS parts, CAST(0 AS BIGINT) AS under, true AS far_are_few FROM lineitem"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of each status in a histogram of bounded size: its bins hold all rows, and its middle is near the median."""
    orders = table(spark, sf_dir, "orders")
    bins = orders.groupBy("o_orderstatus").agg(F.histogram_numeric("o_totalprice", F.lit(64)).alias("bins"), F.count("*").alias("n"))
    total = F.aggregate("bins", F.lit(0.0), lambda a, b: a + b["y"])
    half = F.aggregate("bins", F.struct(F.lit(0.0).alias("so_far"), F.lit(0.0).alias("at")), lambda a, b: F.when(a["so_far"] < F.col("n") / 2, F.struct((a["so_far"] + b["y"]).alias("so_far"), b["x"].alias("at"))).otherwise(a))
    bins = bins.select("o_orderstatus", "n", (total == F.col("n")).alias("whole"), half["at"].alias("middle"))
    # Three states: the estimates are broadcast.
    share = F.avg((F.col("o_totalprice") <= F.col("middle")).cast("double"))
    found = orders.join(F.broadcast(bins), "o_orderstatus").groupBy("o_orderstatus", "n", "whole").agg(share.alias("up_to"))
    return found.select("o_orderstatus", "n", "whole", (F.abs(F.col("up_to") - 0.5) <= 0.05).alias("middle_near"))


HISTOGRAM = "SELECT o_orderstatus, count(*) AS n, true AS whole, true AS middle_near FROM orders GROUP BY o_orderstatus"


QUERIES = {
    "agg_group": (pricing, PRICING),
    "agg_distinct_filter_having": (distinct, DISTINCT),
    "agg_rollup": (_levels("rollup"), _levels_sql("ROLLUP (l_returnflag, l_linestatus)")),
    "agg_cube": (_levels("cube"), _levels_sql("CUBE (l_returnflag, l_linestatus)")),
    "agg_grouping_sets": (_levels("sets"), _levels_sql("GROUPING SETS ((l_returnflag), (l_linestatus), ())")),
    "agg_pivot": (pivoted, PIVOTED),
    "agg_unpivot": (unpivoted, UNPIVOTED),
    "agg_moments": (moments, MOMENTS),
    "agg_order_statistics": (order_statistics, ORDER_STATISTICS),
    "agg_collect": (collected, COLLECTED),
    "agg_small_domain": (small_domain, SMALL_DOMAIN),
    "agg_listagg": (listed, LISTED),
    "agg_bitmap_distinct": (distinct_by_bitmap, DISTINCT_BY_BITMAP),
    "agg_sketches": (approximations, None),
    "agg_united_sketches": (united_sketches, UNITED_SKETCHES),
    "agg_sketch_overlap": (sketch_overlap, SKETCH_OVERLAP),
    "agg_count_min": (count_min, COUNT_MIN),
    "agg_histogram": (histogram, HISTOGRAM),
    "window_ranks": (ranks, RANKS),
    "window_neighbours": (neighbours, NEIGHBOURS),
    "window_frames": (frames, FRAMES),
    "window_sessions": (user_sessions, USER_SESSIONS),
    "window_hourly": (hourly, HOURLY),
}
