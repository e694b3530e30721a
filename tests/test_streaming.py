"""Streams against the same operators on a batch."""

from collections import Counter

import pytest
from comparing import DATA
from pyspark.sql import functions as F

from brindle.sources import files
from brindle.streaming import windows

EVENTS = f"{DATA}/sf0.001/events.parquet"
#: Far after all others, so that the watermark passes every window before it.
SENTINEL = "2030-01-01"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in four files in the order of time, and a last one far in the future."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(EVENTS)
    for k in range(4):
        part = events.filter((F.col("event_id") >= k * 250) & (F.col("event_id") < (k + 1) * 250) if k < 3 else F.col("event_id") >= 750)
        part.coalesce(1).write.mode("append").parquet(path)
    last = events.limit(1).withColumn("ts", F.lit(SENTINEL).cast("timestamp_ntz")).withColumn("event_id", F.lit(-1).cast("long"))
    last.write.mode("append").parquet(path)
    return path


@pytest.fixture
def events(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch = spark.read.parquet(EVENTS)
    stream = files.read_stream(spark, folder, batch.schema)
    return batch, windows.timed(stream)


def run(df, tmp_path, mode="append"):
    name = f"out_{abs(hash(str(tmp_path)))}_{mode}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path)).start()
    query.awaitTermination(120)
    assert not query.isActive
    return df.sparkSession.table(name)


def rows(df):
    return Counter(tuple(r) for r in df.collect() if "2030" not in str(tuple(r)))


def test_tumbling_and_sliding(events, tmp_path):
    batch, stream = events
    measures = {"n": F.count("*"), "most": F.max("value")}
    for slide in (None, "30 minutes"):
        got = run(windows.tumbling(stream, "1 hour", ["event_type"], measures, slide=slide), tmp_path / str(slide))
        want = windows.tumbling(batch.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", ["event_type"], measures, slide=slide)
        assert rows(got) == rows(want) and want.count()


def test_sessions(events, tmp_path):
    batch, stream = events
    measures = {"n": F.count("*")}
    got = run(windows.sessions(stream, "30 minutes", ["user_id"], measures), tmp_path)
    want = windows.sessions(batch.withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes", ["user_id"], measures)
    assert rows(got) == rows(want)


def test_first_of_each(events, tmp_path):
    batch, stream = events
    got = run(windows.first_of_each(stream, ["event_id"]).select("event_id"), tmp_path).filter("event_id >= 0")
    assert rows(got) == rows(batch.select("event_id"))


def test_interval_join(events, tmp_path):
    batch, stream = events

    def joined(source):
        left = source.filter("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"), "event_id")
        right = source.filter("event_type = 'purchase'").select(F.col("user_id").alias("v"), F.col("ts").alias("s"), F.col("event_id").alias("bought"))
        return windows.within(left, right, F.col("u") == F.col("v"), "t", "s", "6 HOURS").select("event_id", "bought")

    want = joined(batch.withColumn("ts", F.col("ts").cast("timestamp")))
    assert rows(run(joined(stream), tmp_path)) == rows(want) and want.count()


def test_running_totals(events, tmp_path):
    batch, stream = events
    got = run(windows.running_totals(stream.filter("event_id >= 0"), "user_id", "value"), tmp_path, "update")
    last = {r.key: (r.n, r.total) for r in got.orderBy("n").collect()}
    want = {r.user_id: (r.n, r.total) for r in batch.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert {k: n for k, (n, _) in last.items()} == {k: n for k, (n, _) in want.items()}
    assert all(last[k][1] == pytest.approx(want[k][1]) for k in want)


SF = f"{DATA}/sf0.001"


@pytest.fixture
def kept(monkeypatch):
    """Folders of streams aren't deleted, and are listed."""
    from brindle.plans import streams

    held = []
    monkeypatch.setattr(streams, "delete", lambda spark, path: held.append(path))
    return held


def _batches(home):
    """Numbers of rows of the batches of a stream, from its checkpoint's offsets and commits."""
    import os

    return sorted(int(n) for n in os.listdir(f"{home.removeprefix('file:')}/state/commits") if n.isdigit())


@pytest.mark.parametrize("name", ["tumbling", "sliding", "sessions", "late_data", "chained", "closed_sessions", "redelivered"])
def test_streams_run_over_several_batches(spark, kept, name):
    from brindle.plans import streams

    getattr(streams, name)(spark, SF).count()
    # Six arrivals of five days, two more of late ones; one after them without rows.
    assert len(_batches(kept[0])) >= 6


def test_late_events_are_lost_and_only_those(spark):
    """There are late events that are dropped, and some that come an arrival late and aren't."""
    from comparing import oracle

    from brindle.plans import streams

    got = {(r.start, r.event_type): r.n for r in streams.late_data(spark, SF).collect()}
    names, plain = oracle(SF, streams.TUMBLING)
    at = [names.index(c) for c in ("start", "event_type", "n")]
    whole = {(r[at[0]], r[at[1]]): r[at[2]] for r in plain}
    assert all(n <= whole[k] for k, n in got.items()) and sum(got.values()) < sum(whole.values())
    _, rows = oracle(SF, f"{streams._KEPT} SELECT count(*) FILTER (mark IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark), count(*) FILTER (event_id % 13 = 0 AND event_id % 17 <> 0) FROM e JOIN w USING (batch)")
    assert rows[0][0] > 0 and rows[0][1] > 0


def test_folders_of_streams_go(spark):
    import os

    from brindle import shared_folder
    from brindle.plans import streams

    top = shared_folder.root(spark).removeprefix("file:")
    before = set(os.listdir(top))
    streams.with_table(spark, SF).count()
    new = set(os.listdir(top)) - before
    # What is left are checkpoints that results are read from.
    assert all(n.startswith("rdd-") for n in new)


def test_sessions_that_join(spark, tmp_path):
    """A late event closes the gap between two open sessions; another key's timer is of no concern to it."""
    from brindle.sources import replay

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = 1_704_067_200
    rows = [  # seconds, user, value, arrival
        (0, 1, 1.0, 0), (1700, 1, 2.0, 0), (5000, 1, 9.0, 0), (100, 2, 4.0, 0),
        (3300, 1, 7.0, 1), (5100, 2, 1.0, 1), (5200, 2, 3.0, 1),
        (90_000, 3, 0.5, 2), (90_001, 3, 0.25, 3),
    ]
    df = spark.createDataFrame(rows, "s long, user_id long, value double, a long").withColumn("ts", F.timestamp_seconds(F.col("s") + base))
    n = replay.deliver(df.select("ts", "user_id", "value", "a"), f"{tmp_path}/in", F.col("a"))
    assert n == 4
    stream = windows.timed(replay.stream(spark, f"{tmp_path}/in", "ts timestamp, user_id long, value double, a long"), late="1 hour")
    got = run(windows.timed_sessions(stream, 1800, "user_id", "value"), tmp_path / "state").collect()
    found = sorted((r.key, r.start.timestamp() - base, r["last"].timestamp() - base, r.n, r.most) for r in got)
    # 0, 1700, 3300 and 5000 are one session; user 3's is open.
    assert found == [(1, 0, 5000, 4, 9.0), (2, 100, 100, 1, 4.0), (2, 5100, 5200, 2, 3.0)]


def test_timed_sessions_of_many_keys(spark, tmp_path):
    """A session grows over arrivals, one without a key is one key's; few calls, many keys in one group."""
    from brindle.sources import replay

    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [(k, at(m), float(v), n) for k in (None, *range(40)) for m, v, n in ((0, 1, 0), (29, 5, 1), (58, 2, 0), (150, 7, 1), (300, 0, 2))]
    df = spark.createDataFrame(rows, "user_id long, t string, value double, n long").withColumn("ts", F.to_timestamp("t"))
    replay.deliver(df.drop("t"), f"{tmp_path}/in", F.col("n"))
    stream = replay.stream(spark, f"{tmp_path}/in", df.drop("t").schema).withWatermark("ts", "60 minutes")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = windows.timed_sessions(stream, 1800, "user_id", "value", groups=3)
        found.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {(r.key, str(r.start)[11:16], str(r["last"])[11:16], r.n, r.most) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(k, s, e, n, m) for k in (None, *range(40)) for s, e, n, m in (("00:00", "00:58", 3, 5.0), ("02:30", "02:30", 1, 7.0))}
