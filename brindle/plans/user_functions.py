"""Functions written in Python or SQL by a user, in each form that Spark runs, with the SQL that gives the
same rows. Columns go to Python in Arrow batches. Functions of groups get many keys at once, dealt by hash to groups of
about GROUP_ROWS rows, since a call costs a millisecond or more; all rows of one key come in one call."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table

#: Rows that a function of groups gets in one call, about.
GROUP_ROWS = 8192


def pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in Unicode's composed form, which no built-in function gives."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    # An accent after its letter, as decomposed texts have it.
    text = F.concat(F.left("role", F.lit(1)), F.lit("e\u0301"), F.left("text", F.lit(20)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", composed(text).alias("composed"))


PANDAS_SCALAR = "SELECT conv_id, turn, nfc_normalize(left(role, 1) || 'e' || chr(769) || left(text, 20)) AS composed FROM conversations"


def arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("long")
    def gap(a: pa.Array, b: pa.Array) -> pa.Array:
        return pc.abs(pc.subtract(a, b))

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gap("l_partkey", "l_suppkey").alias("gap"))


ARROW_SCALAR = "SELECT l_orderkey, l_linenumber, abs(l_partkey - l_suppkey) AS gap FROM lineitem"


def python_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udf("string", useArrow=True)
    def initials(name: str | None) -> str | None:
        return None if name is None else "".join(w[0] for w in name.split())

    return table(spark, sf_dir, "part").select("p_partkey", initials("p_name").alias("initials"))


PYTHON_SCALAR = r"""
SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: w <> ''), lambda w: left(w, 1)), '') AS initials FROM part
"""


def _groups(*tables: DataFrame) -> int:
    """How many groups of keys tables are dealt to, some GROUP_ROWS rows each. Parquet knows its counts."""
    return max(1, sum(t.count() for t in tables) // GROUP_ROWS)


def _group(key: str, n: int) -> Column:
    """The group of a key among n. Rows without a key are a group of their own."""
    return F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(n)))


def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average weighted by another column, of each order's lines: those of a group of orders in one call."""

    @F.pandas_udf("array<struct<l_orderkey: long, discount: double, known: boolean>>")
    def weighted(keys: pd.Series, values: pd.Series, weights: pd.Series) -> list:
        sums = pd.DataFrame({"product": values * weights, "weight": weights}).groupby(keys, dropna=False, sort=False).sum(min_count=1)
        rows = zip(sums.index, sums["product"] / sums["weight"], sums.notna().all(axis=1), strict=True)
        return [{"l_orderkey": None if pd.isna(k) else int(k), "discount": v, "known": known} for k, v, known in rows]

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_quantity")
    found = lines.groupBy(_group("l_orderkey", _groups(lines))).agg(weighted("l_orderkey", "l_discount", "l_quantity").alias("orders"))
    # What is no number comes back as null, as 0 / 0 does.
    discount = F.when(F.col("known"), F.coalesce(F.round("discount", 9), F.lit(float("nan"))))
    return found.select(F.inline("orders")).select("l_orderkey", discount.alias("discount"))


PANDAS_AGGREGATE = "SELECT l_orderkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS discount FROM lineitem GROUP BY l_orderkey"


def in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since the order before, of each customer's orders: a group of customers in one call."""

    def gaps(orders: pd.DataFrame) -> pd.DataFrame:
        orders = orders.sort_values(["o_custkey", "o_orderdate", "o_orderkey"])
        days = orders["o_orderdate"].dt.normalize().groupby(orders["o_custkey"], dropna=False).diff().dt.days
        return pd.DataFrame({"o_orderkey": orders["o_orderkey"], "days": days.astype("Int64")})

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return orders.groupBy(_group("o_custkey", _groups(orders))).applyInPandas(gaps, "o_orderkey long, days long")


IN_PANDAS = """
SELECT o_orderkey, datediff('day', lag(o_orderdate) OVER w, o_orderdate) AS days
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
"""


def cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events of each customer, side by side: a group of customers in one call. As in a join, what has no key
    has no counterpart."""

    def both(orders: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
        n = {"n_orders": orders["key"].value_counts(), "n_events": events["key"].value_counts()}
        known = pd.DataFrame(n).fillna(0).astype("int64").rename_axis("key").reset_index().astype({"key": "Int64"})
        without = [{"key": pd.NA, "n_orders": o, "n_events": e} for o, e in ((orders["key"].isna().sum(), 0), (0, events["key"].isna().sum())) if o + e]
        return pd.concat([known, pd.DataFrame(without).astype({"key": "Int64"})]) if without else known

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"))
    group = _group("key", _groups(orders, events))
    return orders.groupBy(group).cogroup(events.groupBy(group)).applyInPandas(both, "key long, n_orders long, n_events long")


COGROUPED = """
SELECT coalesce(o.key, e.key) AS key, coalesce(n_orders, 0) AS n_orders, coalesce(n_events, 0) AS n_events
FROM (SELECT o_custkey AS key, count(*) AS n_orders FROM orders GROUP BY 1) o
FULL JOIN (SELECT user_id AS key, count(*) AS n_events FROM events GROUP BY 1) e ON o.key = e.key
"""


@F.udtf(returnType="place long, word string")
class WordsOf:
    """The words of a text, numbered."""

    def eval(self, text: str):
        for place, word in enumerate((text or "").split()):
            yield place, word


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.lateralJoin(WordsOf(F.col("p_name").outer())).select("p_partkey", "place", "word")


TABLE_FUNCTION = r"""
SELECT p_partkey, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS place, unnest(w) AS word
FROM (SELECT p_partkey, regexp_extract_all(p_name, '\S+') AS w FROM part)
"""


def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION brindle_net(price DOUBLE, rate DOUBLE) RETURNS DOUBLE RETURN price * (1 - rate)")
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.round(F.call_function("brindle_net", "l_extendedprice", "l_discount"), 4).alias("net"))


SQL_FUNCTION = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"


def in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of rows in, batches of other rows out."""

    def large(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield batch.filter(pc.greater(batch.column("o_totalprice"), 200_000.0)).select(["o_orderkey"])

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(large, "o_orderkey long")


IN_ARROW = "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"

QUERIES = {
    "udf_pandas": (pandas_scalar, PANDAS_SCALAR),
    "udf_arrow": (arrow_scalar, ARROW_SCALAR),
    "udf_python": (python_scalar, PYTHON_SCALAR),
    "udf_pandas_aggregate": (pandas_aggregate, PANDAS_AGGREGATE),
    "apply_in_pandas": (in_pandas, IN_PANDAS),
    "cogroup_in_pandas": (cogrouped, COGROUPED),
    "udtf_lateral": (table_function, TABLE_FUNCTION),
    "udf_sql": (sql_function, SQL_FUNCTION),
    "map_in_arrow": (in_arrow, IN_ARROW),
}
