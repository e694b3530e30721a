"""Round trips through files, partitions and buckets."""

import os
import subprocess
import sys

import pyspark
import pytest
from comparing import DATA, rows, same
from pyspark.sql import functions as F

from brindle.functions.vectors import cosine
from brindle.sources import files

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("fmt", [f for f in files.FORMATS if f != "text"])
def test_round_trip(spark, tmp_path, fmt):
    df = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_type", F.nullif(F.col("event_type"), F.lit("click")))
    files.write(df, f"{tmp_path}/{fmt}", fmt)
    back = files.read(spark, f"{tmp_path}/{fmt}", fmt, df.schema)
    assert rows(df.columns, df.collect()) == rows(back.columns, back.collect())


def test_csv_keeps_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc,d'), (2, None)], "k long, text string")
    files.write(df, f"{tmp_path}/x", "csv")
    assert sorted(files.read(spark, f"{tmp_path}/x", "csv", df.schema).collect()) == sorted(df.collect())


def test_unknown_formats_and_missing_schemas_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "avro")
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "csv")


def test_partitions_are_pruned(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    files.write(df, f"{tmp_path}/p", partition_by=["o_orderstatus"])
    some = files.read(spark, f"{tmp_path}/p").filter("o_orderstatus = 'F'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan
    assert some.count() == df.filter("o_orderstatus = 'F'").count()


def test_bucketed_join_has_no_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files.write_bucketed(spark.read.parquet(f"{SF}/orders.parquet"), "b_orders", ["o_orderkey"], 4)
        files.write_bucketed(spark.read.parquet(f"{SF}/lineitem.parquet"), "b_lines", ["l_orderkey"], 4)
        joined = spark.table("b_lines").join(spark.table("b_orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        assert joined.count() == 6000
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("b_orders", "b_lines"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[0] == pytest.approx(0.5**0.5) and got[1] is None


def test_ledger_repeats_and_loses_nothing(spark, tmp_path):
    """The last batch is done again, as after a crash between its commit to the ledger and Spark's own, and files of
    attempts that never got to a commit lie about."""
    import json
    import os

    from brindle.sources import ledger, replay

    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "value")
    replay.deliver(events, f"{tmp_path}/in", F.col("event_id") % 5)
    home = str(tmp_path)

    def write():
        ledger.append(replay.stream(spark, f"{home}/in", events.schema), f"{home}/ledger", f"{home}/state").awaitTermination()

    write()
    manifests = sorted(os.listdir(f"{home}/ledger/commits"))
    assert len(manifests) == 5
    want = rows(events.columns, events.collect())
    assert rows(events.columns, ledger.read(spark, f"{home}/ledger", events.schema).collect()) == want
    last = max(int(n) for n in os.listdir(f"{home}/state/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{home}/state/commits/{name}"):
            os.remove(f"{home}/state/commits/{name}")
    (tmp_path / "ledger" / "data" / "orphan.arrow").write_bytes(b"of an attempt that failed")
    files_before = {n: json.load(open(f"{home}/ledger/commits/{n}")) for n in manifests}
    write()
    assert last in {int(n) for n in os.listdir(f"{home}/state/commits") if n.isdigit()}
    assert {n: json.load(open(f"{home}/ledger/commits/{n}")) for n in sorted(os.listdir(f"{home}/ledger/commits"))} == files_before
    assert rows(events.columns, ledger.read(spark, f"{home}/ledger", events.schema).collect()) == want

    def read():
        stream = ledger.read_stream(spark, f"{home}/ledger", events.schema)
        query = stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{home}/read")
        query.start(f"{home}/rows").awaitTermination()
        return rows(events.columns, spark.read.schema(events.schema).parquet(f"{home}/rows").select(*events.columns).collect())

    assert read() == want
    # More comes, and a reader that starts again goes on where it was.
    more = events.limit(3).withColumn("event_id", F.col("event_id") + 1_000_000)
    more.withColumn("_arrival", F.lit(9)).coalesce(1).write.mode("append").partitionBy("_arrival").parquet(f"{home}/in")
    write()
    assert read() == want + rows(events.columns, more.collect())


def test_ledger_without_rows(spark, tmp_path):
    from brindle.sources import ledger

    assert ledger.read(spark, f"{tmp_path}/none", "a long").collect() == []


def test_database_gets_filters_and_partitions(spark, tmp_path):
    from brindle.plans.streams import _DERBY
    from brindle.sources import jdbc

    url = f"jdbc:derby:directory:{tmp_path}/db;create=true"
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    jdbc.write(orders, url, "orders", _DERBY)
    back = jdbc.read(spark, url, "orders", _DERBY, "o_orderkey", 4)
    assert back.rdd.getNumPartitions() == 4
    assert rows(back.columns, back.collect()) == rows(orders.columns, orders.collect())
    some = back.filter("o_totalprice > 200000").select("o_orderkey")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(O_TOTALPRICE), *GreaterThan(O_TOTALPRICE,200000.0)]" in plan or "GreaterThan(o_totalprice,200000.0)" in plan
    assert some.count() == orders.filter("o_totalprice > 200000").count()
    jdbc.write(orders.limit(0), url, "nothing", _DERBY)
    assert jdbc.read(spark, url, "nothing", _DERBY, "o_orderkey").count() == 0


_ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.checkpoint.dir": sys.argv[2], "spark.ui.enabled": "false"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
__spark_entry__.queries()["source_jdbc"](spark, sys.argv[1]).write.parquet(sys.argv[3])
"""


def test_database_query_on_a_cluster(spark, tmp_path):
    """Driver and executors are processes of their own; they log to a Spark home of links."""
    from brindle.plans.streams import FROM_DATABASE

    home, here = tmp_path / "home", os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    (home / "work").mkdir(parents=True)
    for name in os.listdir(os.path.dirname(pyspark.__file__)):
        if name != "work":
            (home / name).symlink_to(f"{os.path.dirname(pyspark.__file__)}/{name}")
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    env |= {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": here, "PYSPARK_PYTHON": sys.executable}
    args = [sys.executable, "-c", _ON_A_CLUSTER, SF, f"{tmp_path}/shared", f"{tmp_path}/out"]
    done = subprocess.run(args, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    same(spark.read.parquet(f"{tmp_path}/out"), SF, FROM_DATABASE)


def test_databases_of_tasks_hold_all_rows(spark, tmp_path, monkeypatch):
    from brindle.plans.streams import _DERBY
    from brindle.sources import jdbc

    monkeypatch.setattr(jdbc, "DATABASE_ROWS", 20)
    some = ["id AS `a \"key\"`", "CAST(id % 7 - 3 AS int) AS small", "CAST(nullif(id % 5, 0) AS int) AS gone"]
    df = spark.range(110).selectExpr(*some, "pow(-3, id) / 7 AS x", "date_add(DATE'1969-12-28', CAST(nullif(id, 9) AS int)) AS day")
    df = df.union(spark.sql("SELECT 9223372036854775807L, NULL, NULL, 1.7976931348623157E308D, NULL"))
    urls = jdbc.fill(df, f"{tmp_path}/filled", "nums")
    assert len(urls) == 6
    back = jdbc.read_filled(spark, urls, df, "nums", _DERBY)
    assert back.dtypes == df.dtypes and back.rdd.getNumPartitions() == 6
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    few = back.filter("small > 1")
    assert few._jdf.queryExecution().executedPlan().toString().count("GreaterThan(small,1)") == 6
    assert few.count() == df.filter("small > 1").count()
    assert jdbc.fill(df.limit(0), f"{tmp_path}/none", "nums") == []
    assert jdbc.read_filled(spark, [], df, "nums", _DERBY).collect() == []


def test_databases_of_tasks_refuse_what_they_would_change(spark, tmp_path):
    from brindle.sources import jdbc

    with pytest.raises(ValueError, match="text"):
        jdbc.fill(spark.sql("SELECT 1 AS k, 'a' AS text"), str(tmp_path), "t")
    with pytest.raises(ValueError, match="local paths"):
        jdbc.fill(spark.range(1), "hdfs://host/x", "t")


def test_bucketed_query_has_no_shuffle(spark):
    from brindle.plans.streams import bucketed_join

    files.write_bucketed(spark.read.parquet(f"{SF}/orders.parquet"), "q_orders", ["o_orderkey"], 4)
    files.write_bucketed(spark.read.parquet(f"{SF}/lineitem.parquet"), "q_lines", ["l_orderkey"], 4)
    try:
        plan = bucketed_join(spark, "q_lines", "q_orders")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan.replace("ReusedExchange", "").split("SortMergeJoin")[1]
    finally:
        for name in ("q_orders", "q_lines"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_text_lines(spark, tmp_path):
    df = spark.createDataFrame([("a b",), ("",), ("é ,",)], "value string")
    files.write(df, f"{tmp_path}/t", "text")
    assert sorted(files.read(spark, f"{tmp_path}/t", "text").collect()) == sorted(df.collect())


@pytest.mark.parametrize("fmt", ["csv", "xml"])
def test_files_that_are_read_whole_are_small(spark, tmp_path, monkeypatch, fmt):
    """Rows of one task become many files, with and without folders."""
    monkeypatch.setattr(files, "FILE_BYTES", 1 << 16, raising=False)
    df = spark.read.parquet(f"{SF}/lineitem.parquet").coalesce(1)
    for name, by in (("plain", None), ("folders", ["l_returnflag"])):
        files.write(df, f"{tmp_path}/{name}", fmt, partition_by=by)
        sizes = [f.stat().st_size for f in (tmp_path / name).rglob("part-*") if not f.name.endswith(".crc")]
        assert len(sizes) > 4 and max(sizes) < 2 * (1 << 16)
        back = files.read(spark, f"{tmp_path}/{name}", fmt, df.schema)
        assert rows(df.columns, df.collect()) == rows(df.columns, back.select(*df.columns).collect())


def test_buckets_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(files, "BUCKET_ROWS", 100)
    assert files.buckets(spark.range(5000), spark.range(90)) == 50 and files.buckets(spark.range(3), spark.range(9)) == 8
