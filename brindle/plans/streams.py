"""Streams and files as queries: each runs to the end of its input and returns what the sink holds, with the
SQL that gives the same rows.

Events are delivered in several arrivals, one a micro-batch, so state passes from batch to batch, the watermark moves and
evicts. Sinks, arrivals and checkpoints of a stream are in a folder of its own beneath the one named in
spark.checkpoint.dir; its rows are cut from it and the folder goes when it has ended."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..shared_folder import cut, delete, folder
from ..operators import sampling
from ..sources import calendar, files, jdbc, ledger, replay
from ..streaming import windows
from ..tables import table

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def slot() -> Column:
    """Five days of events are an arrival."""
    return F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 5)


def late_slot() -> Column:
    """Some come an arrival late, some two."""
    return slot() + F.when(F.col("event_id") % 17 == 0, 2).when(F.col("event_id") % 13 == 0, 1).otherwise(0)


def _append(stream: DataFrame, home: str) -> DataFrame:
    """What a stream appends to Parquet files."""
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", f"{home}/state").start(f"{home}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")


def _by_batch(stream: DataFrame, home: str, mode: str, keep: Callable) -> None:
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).foreachBatch(keep)
    query.option("checkpointLocation", f"{home}/state").start().awaitTermination()


def _complete(stream: DataFrame, home: str) -> DataFrame:
    """The last of the whole results that a stream hands to a function for each batch."""
    _by_batch(stream, home, "complete", lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/rows"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/rows")


def _upsert(*keys: str) -> Callable:
    """Of what a stream changes, batch by batch, the last version of each key. A batch that is repeated after a failure
    replaces its own folder."""

    def sink(stream: DataFrame, home: str) -> DataFrame:
        _by_batch(stream, home, "update", lambda batch, number: batch.write.mode("overwrite").parquet(f"{home}/rows/_batch={number}"))
        schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])
        rows = stream.sparkSession.read.schema(schema).parquet(f"{home}/rows")
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in stream.columns if c not in keys)), "_batch").alias("_last"))
        return last.select(*keys, "_last.*")

    return sink


def _streamed(build: Callable, sink: Callable = _append, arrival: Callable = slot, delivered: Callable | None = None, store: str | None = None) -> Callable:
    """A query of events as a stream: build gets a function that opens the stream (with a watermark of ten minutes, or
    another) and returns a streaming DataFrame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        home = folder(spark)
        events = table(spark, sf_dir, "events")
        replay.deliver(delivered(events) if delivered else events, f"{home}/arrivals", F.col("_at_slot") if delivered else arrival())

        def opened(late: str = "10 minutes") -> DataFrame:
            return windows.timed(replay.stream(spark, f"{home}/arrivals", events.schema), late=late)

        before = spark.conf.get(_STORE, None)
        if store:
            spark.conf.set(_STORE, store)
        try:
            rows = cut(sink(build(spark, sf_dir, opened), home))
        finally:
            if store:
                spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)
        delete(spark, home)
        return rows

    return run


def _measures() -> dict:
    return {"n": F.count("*"), "most": F.max("value")}


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz")).drop("end")


def _tumbling(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    return _plain(windows.tumbling(events(), "1 hour", ["event_type"], _measures()))


tumbling = _streamed(_tumbling, _upsert("start", "event_type"))

TUMBLING = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2"


def _sliding(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    return _plain(windows.tumbling(events(), "2 hours", [], _measures(), slide="1 hour"))


sliding = _streamed(_sliding, _upsert("start"))

SLIDING = """
SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR * back AS start, count(*) AS n, max(value) AS most
FROM events, (VALUES (0), (1)) AS b(back) GROUP BY 1
"""


def _sessions(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """All sessions, open ones too. Spark has no update mode for them, so each batch gives the whole result: timed_sessions
    is the one for results that grow."""
    return _plain(windows.sessions(events(), "30 minutes", ["user_id"], _measures()))


sessions = _streamed(_sessions, _complete)

SESSIONS = """
WITH s AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM s)
SELECT user_id, min(ts) AS start, count(*) AS n, max(value) AS most FROM n GROUP BY user_id, session
"""


def _deduplicated(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """The keys that ever came, each once; state is these keys."""
    return events().select("user_id", "event_type").dropDuplicates()


deduplicated = _streamed(_deduplicated)
DEDUPLICATED = "SELECT DISTINCT user_id, event_type FROM events"


def _twice(events: DataFrame) -> DataFrame:
    """Events of which some are delivered again, an arrival later."""
    again = events.filter("event_id % 10 = 0").withColumn("_at_slot", slot() + 1)
    return events.withColumn("_at_slot", slot()).unionByName(again)


def _redelivered(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """Each event once, however often it is delivered within the watermark; state is as long as that."""
    return windows.first_of_each(events("6 days"), ["event_id"]).select("event_id", "user_id", "event_type")


redelivered = _streamed(_redelivered, delivered=_twice)
REDELIVERED = "SELECT event_id, user_id, event_type FROM events"


def _with_table(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """A stream joined with a table."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return events().join(customers, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment")


with_table = _streamed(_with_table)
WITH_TABLE = "SELECT event_id, c_mktsegment FROM events JOIN customer ON user_id = c_custkey"


def with_stream(how: str) -> Callable:
    """Clicks, and the same user's purchases within a day after."""

    def build(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
        def of(kind: str, name: str) -> DataFrame:
            own = events().filter(F.col("event_type") == kind)
            return own.select(F.col("event_id").alias(name), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_at"))

        pairs = windows.within(of("click", "click"), of("purchase", "purchase"), F.col("click_user") == F.col("purchase_user"), "click_at", "purchase_at", "1 day", how)
        return pairs.select(*(["click"] if how == "left_semi" else ["click", "purchase"]))

    return _streamed(build)


_PAIRED = """
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS mark)
"""
_ON = "c.user_id = p.user_id AND p.ts >= c.ts AND p.ts < c.ts + INTERVAL 1 DAY"
WITH_STREAM = f"{_PAIRED} SELECT c.event_id AS click, p.event_id AS purchase FROM c JOIN p ON {_ON}"
#: Without events that may still find a partner after the last watermark.
LEFT_STREAM = f"{_PAIRED} SELECT c.event_id AS click, p.event_id AS purchase FROM w, c LEFT JOIN p ON {_ON} WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 1 DAY <= mark"
FULL_STREAM = f"""{_PAIRED} SELECT c.event_id AS click, p.event_id AS purchase FROM c FULL JOIN p ON {_ON} CROSS JOIN w
WHERE c.event_id IS NOT NULL AND p.event_id IS NOT NULL OR c.ts + INTERVAL 1 DAY <= mark OR p.ts <= mark"""
SEMI_STREAM = f"{_PAIRED} SELECT c.event_id AS click FROM c WHERE EXISTS (SELECT 1 FROM p WHERE {_ON})"

#: Events that come before the watermark has passed their hour: it is that of the newest event of all arrivals but the two
#: latest ones, less ten minutes. mark is the last watermark.
_KEPT = """
WITH e AS (
  SELECT *, CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 5) AS BIGINT)
            + CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS batch FROM events),
w AS (
  SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM e GROUP BY batch),
k AS (
  SELECT date_trunc('hour', ts) AS hour, event_type, value FROM e JOIN w USING (batch)
  WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark),
h AS (SELECT hour, event_type, count(*) AS n, max(value) AS most FROM k GROUP BY ALL),
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
"""


def _late(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """Hours that are over, without the events that came too late for them."""
    return _plain(windows.tumbling(events(), "1 hour", ["event_type"], _measures()))


late_data = _streamed(_late, arrival=late_slot)
LATE_DATA = f"{_KEPT} SELECT hour AS start, event_type, n, most FROM h, m WHERE hour + INTERVAL 1 HOUR <= mark"


def _chained(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """Days that are over, from hours that are."""
    hours = windows.narrow_windows(events(), "1 hour", ["event_type"], _measures())
    days = windows.rolled_up(hours, "1 day", ["event_type"], {"n": F.sum("n"), "most": F.max("most"), "busiest": F.max("n"), "hours": F.count("*")})
    return _plain(days)


chained = _streamed(_chained, arrival=late_slot)
CHAINED = f"""{_KEPT},
d AS (SELECT date_trunc('day', hour) AS start, event_type, CAST(sum(n) AS BIGINT) AS n, max(most) AS most, max(n) AS busiest, count(*) AS hours FROM h GROUP BY 1, 2)
SELECT d.* FROM d, m WHERE start + INTERVAL 1 DAY <= mark
"""


def _closed(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """Sessions that are over, closed by timers."""
    found = windows.timed_sessions(events(), 1800, "user_id", "value")
    return found.select(F.col("key").alias("user_id"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "last")), "n", "most")


closed_sessions = _streamed(_closed, store=_ROCKS)
CLOSED_SESSIONS = f"""
{SESSIONS.replace("min(ts) AS start,", "min(ts) AS start, max(ts) AS last,")}
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
"""


def _limited(spark: SparkSession, sf_dir: str, events: Callable) -> DataFrame:
    """The first events that come, in any batch."""
    return events().limit(FIRST).select("event_id")


FIRST = 700


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct ones of the events a limit over several batches let through."""
    first = _streamed(_limited)(spark, sf_dir)
    return table(spark, sf_dir, "events").join(first, "event_id").agg(F.count_distinct("event_id").alias("n"))


LIMITED = f"SELECT least(count(*), {FIRST}) AS n FROM events"


def _round_trip(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts, path = table(spark, sf_dir, "part"), folder(spark)
        files.write(parts, path, fmt)
        back = cut(files.read(spark, path, fmt, parts.schema).select(*parts.columns))
        delete(spark, path)
        return back

    return run


def one_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of a table written in folders by status."""
    path = folder(spark)
    files.write(table(spark, sf_dir, "orders"), path, partition_by=["o_orderstatus"])
    some = cut(files.read(spark, path).filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    delete(spark, path)
    return some


def orders_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each day of a quarter, days without any too."""
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    days = calendar.read(spark, "1995-12-20", "1996-03-31")
    return days.join(orders, "day", "left").select("day", "week", "weekday", "quarter", F.coalesce("n", F.lit(0)).alias("n"))


ORDERS_BY_DAY = """
SELECT CAST(d AS DATE) AS day, week(d) AS week, isodow(d) AS weekday, quarter(d) AS quarter,
       (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = CAST(d AS DATE)) AS n
FROM generate_series(TIMESTAMP '1995-12-20', TIMESTAMP '1996-03-31', INTERVAL 1 DAY) AS g(d)
"""

def through_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, an arrival a batch, written to a ledger by one stream and read from it by another."""
    home = folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    replay.deliver(events, f"{home}/arrivals", slot())
    ledger.append(replay.stream(spark, f"{home}/arrivals", events.schema), f"{home}/ledger", f"{home}/written").awaitTermination()
    rows = cut(_append(ledger.read_stream(spark, f"{home}/ledger", events.schema), home))
    delete(spark, home)
    return rows


THROUGH_LEDGER = "SELECT event_id, user_id, ts, value FROM events"


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' addresses written as lines of text and read again, counted by scheme and length."""
    path = folder(spark)
    files.write(table(spark, sf_dir, "pages").select("url"), path, "text")
    lines = files.read(spark, path, "text")
    counted = cut(lines.groupBy(F.substring_index("value", ":", 1).alias("scheme"), F.char_length("value").cast("long").alias("length")).agg(F.count("*").alias("n")))
    delete(spark, path)
    return counted


TEXT_LINES = "SELECT split_part(url, ':', 1) AS scheme, length(url) AS length, count(*) AS n FROM pages GROUP BY ALL"


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the customers with all their orders; of urgent ones a half of these."""
    orders = sampling.by_key(table(spark, sf_dir, "orders"), "o_custkey", 0.1, "customers")
    some = sampling.stratified(orders, "o_orderkey", "o_orderpriority", {"1-URGENT": 0.5}, "orders", other=1.0)
    return some.select("o_orderkey", "o_custkey", "o_orderpriority")


_DRAW = "CAST('0x' || substr(md5('{}:' || CAST({} AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0"
SAMPLED = f"""
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE {_DRAW.format("customers", "o_custkey")} < 0.1
  AND {_DRAW.format("orders", "o_orderkey")} < CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 1.0 END
"""

_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def from_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over 100,000 from databases that hold all orders, one query for each; four tasks at least fill them. They
    are of the kind that Spark ships with."""
    home = folder(spark).removeprefix("file:")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    urls = jdbc.fill(orders, home, "orders")
    dear = jdbc.read_filled(spark, urls, orders, "orders", _DERBY).filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    rows = cut(dear)
    delete(spark, home)
    return rows


FROM_DATABASE = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000"


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their orders, from two tables stored in buckets by order: neither side is shuffled."""
    suffix = uuid.uuid4().hex
    orders, lines = f"orders_{suffix}", f"lines_{suffix}"
    left = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    right = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    n = files.buckets(left, right)
    files.write_bucketed(right, orders, ["o_orderkey"], n)
    files.write_bucketed(left, lines, ["l_orderkey"], n)
    joined = bucketed_join(spark, lines, orders)
    rows = cut(joined)
    for name in (orders, lines):
        spark.sql(f"DROP TABLE {name} PURGE")
    return rows


def bucketed_join(spark: SparkSession, lines: str, orders: str) -> DataFrame:
    joined = spark.table(lines).hint("merge").join(spark.table(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "o_orderpriority").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


BUCKETED = """
SELECT l_orderkey, o_orderpriority, sum(l_quantity) AS quantity, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
"""

QUERIES = {
    "stream_tumbling": (tumbling, TUMBLING),
    "stream_sliding": (sliding, SLIDING),
    "stream_sessions": (sessions, SESSIONS),
    "stream_deduplicated": (deduplicated, DEDUPLICATED),
    "stream_with_table": (with_table, WITH_TABLE),
    "stream_with_stream": (with_stream("inner"), WITH_STREAM),
    "stream_left_join": (with_stream("left_outer"), LEFT_STREAM),
    "stream_full_join": (with_stream("full_outer"), FULL_STREAM),
    "stream_semi_join": (with_stream("left_semi"), SEMI_STREAM),
    "stream_redelivered": (redelivered, REDELIVERED),
    "stream_late_data": (late_data, LATE_DATA),
    "stream_chained": (chained, CHAINED),
    "stream_closed_sessions": (closed_sessions, CLOSED_SESSIONS),
    "stream_limit": (limited, LIMITED),
    **{f"file_{fmt}": (_round_trip(fmt), "SELECT * FROM part") for fmt in files.FORMATS if fmt != "text"},
    "file_partitions": (one_partition, "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'"),
    "stream_ledger": (through_ledger, THROUGH_LEDGER),
    "file_text": (text_lines, TEXT_LINES),
    "sample_by_key": (sampled, SAMPLED),
    "file_buckets": (bucketed, BUCKETED),
    "source_jdbc": (from_database, FROM_DATABASE),
    "source_calendar": (orders_by_day, ORDERS_BY_DAY),
}
