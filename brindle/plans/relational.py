"""Scans, projections, filters, joins, set operations, sorts and recursion, with the SQL that gives
the same rows. Money is cast to decimal before it is summed, so that sums don't depend on order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import top_k
from ..operators.joins import as_of, interval
from ..tables import table


def money(column: str):
    return F.col(column).cast("decimal(12,2)")


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of orders placed in 1996, by the customer's nation."""
    orders = table(spark, sf_dir, "orders").filter("o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'")
    net = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name")
        .agg(F.sum(net).cast("double").alias("revenue"))
    )


REVENUE_BY_NATION = """
SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))
       * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY n_name
"""


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = money("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (price * F.col("l_quantity").cast("int")).cast("double").alias("total")
    )


PROJECTED = """
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_quantity AS INTEGER) AS DOUBLE) AS total FROM lineitem
"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_quantity").between(10, 20) & ((F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.05)))
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    )


FILTERED = """
SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND (l_returnflag = 'R' OR l_discount > 0.05)
"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .filter(F.col("p_name").like("%a%") & F.col("p_size").isin(1, 5, 9, 13))
        .select("p_partkey", "p_name", F.when(F.col("p_size") > 8, "large").otherwise("small").alias("size_class"))
    )


PATTERNS = """
SELECT p_partkey, p_name, CASE WHEN p_size > 8 THEN 'large' ELSE 'small' END AS size_class
FROM part WHERE p_name LIKE '%a%' AND p_size IN (1, 5, 9, 13)
"""


def null_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(segment, F.lit("none")).alias("segment"))


NULL_HANDLING = "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer"


def _orders_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey")
    return orders, lines


def _join(how: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders, lines = _orders_lines(spark, sf_dir)
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), how)

    return run


def _join_sql(kind: str) -> str:
    return f"""
SELECT * FROM (SELECT o_orderkey, o_orderpriority FROM orders) {kind} JOIN
  (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey
"""


def crossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two tables of 5 and 25 rows at any scale."""
    regions = table(spark, sf_dir, "region").select("r_name")
    return regions.crossJoin(table(spark, sf_dir, "nation").select("n_name"))


def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey")
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orders.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


EXISTS = """
SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderstatus = 'F'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 45)
"""


def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, as a join with an aggregate."""
    lines = table(spark, sf_dir, "lineitem")
    mean = lines.groupBy(F.col("l_partkey").alias("part")).agg(F.avg("l_quantity").alias("mean"))
    joined = lines.join(mean, F.col("l_partkey") == F.col("part")).filter(F.col("l_quantity") > 1.5 * F.col("mean"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


ABOVE_AVERAGE = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem a
WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)
"""


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within ten minutes after a click of the same user."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    clicks = events.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("at").alias("click_at"))
    buys = events.filter("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase_id"), F.col("at").alias("buy_at"))
    apart = F.col("buy_at") - F.col("click_at")
    pairs = interval(clicks, buys, F.col("user_id") == F.col("buyer"), "click_at", "buy_at", 600, (apart >= 0) & (apart < 600))
    return pairs.select("user_id", "click_id", "purchase_id")


THETA = """
SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b
ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 10 MINUTE
WHERE a.event_type = 'click' AND b.event_type = 'purchase'
"""


def last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    buys = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return as_of(buys, clicks, ["user_id"], "ts", ["click_id"])


LAST_CLICK = """
SELECT b.user_id, b.ts, b.event_id, a.event_id AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') b
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') a ON a.user_id = b.user_id AND a.ts <= b.ts
"""


def next_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the same user's next click, if it comes within a day."""
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    buys = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return as_of(buys, clicks, ["user_id"], "ts", ["click_id"], forward=True, tolerance=86_400)


NEXT_CLICK = """
SELECT b.user_id, b.ts, b.event_id, CASE WHEN a.ts <= b.ts + INTERVAL 1 DAY THEN a.event_id END AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') b
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') a ON a.user_id = b.user_id AND a.ts >= b.ts
"""


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer."""
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    ranked = top_k(table(spark, sf_dir, "orders"), ["o_custkey"], order, 3)
    return ranked.select("o_custkey", "o_orderkey", "rank")


TOP_ORDERS = """
SELECT o_custkey, o_orderkey, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= 3
"""


def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places 11 to 30 of all orders by price."""
    ordered = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return ordered.offset(10).limit(20).select("o_orderkey", "o_totalprice")


PAGE_OF_ORDERS = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10"


def nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status")
    ordered = table(spark, sf_dir, "orders").select(status, "o_orderkey").orderBy(F.col("status").asc_nulls_last(), F.col("o_orderkey").desc())
    return ordered.limit(100)


NULLS_LAST = """
SELECT nullif(o_orderstatus, 'F') AS status, o_orderkey FROM orders ORDER BY status ASC NULLS LAST, o_orderkey DESC LIMIT 100
"""


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.filter("o_orderpriority < '3'").select(F.col("o_orderkey").alias("k"))
    return a, lines.filter("l_quantity < 10").select(F.col("l_orderkey").alias("k"))


_KEYS_SQL = (
    "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority < '3'",
    "SELECT l_orderkey AS k FROM lineitem WHERE l_quantity < 10",
)

_SETS = {
    "union": (lambda a, b: a.union(b).distinct(), "UNION"),
    "union_all": (lambda a, b: a.union(b), "UNION ALL"),
    "intersect": (lambda a, b: a.intersect(b), "INTERSECT"),
    "intersect_all": (lambda a, b: a.intersectAll(b), "INTERSECT ALL"),
    "except": (lambda a, b: a.subtract(b), "EXCEPT"),
    "except_all": (lambda a, b: a.exceptAll(b), "EXCEPT ALL"),
}


def _set_query(operation):
    return lambda spark, sf_dir: operation(*_keys(spark, sf_dir))


def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powers of two below 10,000 that are keys of suppliers or beyond them."""
    return spark.sql(
        """
        WITH RECURSIVE p(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n * 2 FROM p WHERE n < 10000)
        SELECT n, s_name FROM p LEFT JOIN {supplier} ON s_suppkey = n""",
        supplier=table(spark, sf_dir, "supplier"),
    )


RECURSIVE = """
WITH RECURSIVE p(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n * 2 FROM p WHERE n < 10000)
SELECT n, s_name FROM p LEFT JOIN supplier ON s_suppkey = n
"""


def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in no nation of a list without nulls, and none at all for a list with one. Under OR, NOT IN would become
    nested loops; each at the top of a branch is a null-aware hash join."""
    sql = """
        SELECT c_custkey, 'plain' AS list FROM {customer} WHERE c_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 4)
        UNION ALL
        SELECT c_custkey, 'null' AS list FROM {customer} WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM {nation})"""
    return spark.sql(sql, customer=table(spark, sf_dir, "customer"), nation=table(spark, sf_dir, "nation"))


NOT_IN = """
SELECT c_custkey, list FROM customer, (VALUES ('plain'), ('null')) AS l(list)
WHERE (list = 'plain' AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4))
   OR (list = 'null' AND c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation))
"""


def lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two richest customers of each nation, by a subquery for each."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    own = customers.filter(F.col("c_nationkey") == F.col("n_nationkey").outer())
    best = own.orderBy(F.desc("c_acctbal"), "c_custkey").limit(2).select("c_custkey", "c_acctbal")
    return nations.lateralJoin(best).select("n_name", "c_custkey", "c_acctbal")


LATERAL = """
SELECT n_name, c_custkey, c_acctbal
FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2)
"""


def piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL written as a pipe."""
    return spark.sql(
        """
        FROM {orders} |> WHERE o_orderstatus <> 'P'
        |> AGGREGATE count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS total GROUP BY o_custkey
        |> WHERE n >= 5 |> EXTEND n * 2 AS twice |> SELECT o_custkey, n, twice, total""",
        orders=table(spark, sf_dir, "orders"),
    )


PIPED = """
SELECT o_custkey, count(*) AS n, count(*) * 2 AS twice, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS total
FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) >= 5
"""


def _hinted(hint: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name").hint(hint)
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")

    return run


HINTED = "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"

QUERIES = {
    "q_revenue_by_nation": (revenue_by_nation, REVENUE_BY_NATION),
    "scan_project": (projected, PROJECTED),
    "filter_predicates": (filtered, FILTERED),
    "filter_like_in_case": (patterns, PATTERNS),
    "null_functions": (null_handling, NULL_HANDLING),
    "join_inner": (_join("inner"), _join_sql("INNER")),
    "join_left": (_join("left"), _join_sql("LEFT")),
    "join_right": (_join("right"), _join_sql("RIGHT")),
    "join_full": (_join("full"), _join_sql("FULL")),
    "join_semi": (_join("left_semi"), _join_sql("SEMI")),
    "join_anti": (_join("left_anti"), _join_sql("ANTI")),
    "join_cross": (crossed, "SELECT r_name, n_name FROM region, nation"),
    "join_exists": (exists, EXISTS),
    "join_scalar_subquery": (above_average, ABOVE_AVERAGE),
    "join_interval": (theta, THETA),
    "join_as_of": (last_click, LAST_CLICK),
    "join_as_of_forward": (next_click, NEXT_CLICK),
    "top_k_by_group": (top_orders, TOP_ORDERS),
    "sort_offset_limit": (page_of_orders, PAGE_OF_ORDERS),
    "sort_nulls_last": (nulls_last, NULLS_LAST),
    **{f"set_{n}": (_set_query(f), f"{_KEYS_SQL[0]} {sql} {_KEYS_SQL[1]}") for n, (f, sql) in _SETS.items()},
    "recursive": (recursive, RECURSIVE),
    "join_not_in": (not_in, NOT_IN),
    "join_lateral": (lateral, LATERAL),
    "pipe": (piped, PIPED),
    "join_hint_merge": (_hinted("merge"), HINTED),
    "join_hint_shuffle_hash": (_hinted("shuffle_hash"), HINTED),
}
