"""A table delivered as a stream in a stated order: one file for each arrival, one arrival a trigger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST, _STEP = 1_000_000_000_000, 60_000


def deliver(rows: DataFrame, path: str, arrival: Column) -> int:
    """Writes rows to path, those of each arrival number (from 0, without null) in a file of its own. A stream of files
    takes them by their time of change, so files get times in the order of arrivals. Returns how many there are."""
    spark = rows.sparkSession
    numbered = rows.withColumn("_arrival", arrival.cast("long"))
    numbered.repartition("_arrival").write.partitionBy("_arrival").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(conf)
    n = 0
    # One call a file: there are as many as arrivals.
    for entry in system.listStatus(top):
        at = entry.getPath().getName().partition("=")[2]
        if at:
            for file in system.listStatus(entry.getPath()):
                system.setTimes(file.getPath(), _FIRST + int(at) * _STEP, -1)
                n += file.getPath().getName().startswith("part-")
    return n


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """What was delivered, an arrival for each trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/_arrival=*")
