"""Lineage cuts, key filters and column helpers the operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that goes to Python at once; a longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20
#: Bits of a key filter: 2 ** 26, so its broadcast side has 2,048 rows of 4 KB at most, whatever the input.
FILTER_BITS = 26


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named in ``spark.checkpoint.dir``. Where none is named, a local session makes one
    of its own; a cluster is refused, since its executors would not share it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not sc.master.partition("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder: computed once, safe from
    a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, to be sent to Python in Arrow batches of bounded size: Spark's own bound, tens of megabytes, is
    held in the JVM and in Python several times over by every task. Sets it for the session, where no smaller
    one is set."""
    conf = rows.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(conf.get(name).removesuffix("b"))
        if not 0 < now <= most:
            conf.set(name, str(most))
    return rows


def _spot(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(1 << FILTER_BITS))


def flagged(rows: DataFrame, keys: DataFrame, on: str, flag: str = "_flag") -> DataFrame:
    """rows with a boolean: true for each whose key is among ``keys`` and for some others, found without
    a shuffle of ``rows``. The keys set bits by hash; an exact join must follow. The share of others
    grows with the number of keys over 2 ** FILTER_BITS."""
    spot = _spot(on)
    bits = keys.groupBy(F.bitmap_bucket_number(spot).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("_bits"))
    both = rows.withColumn("_bucket", F.bitmap_bucket_number(spot)).withColumn("_at", F.bitmap_bit_position(spot))
    both = both.join(F.broadcast(bits), "_bucket", "left")
    found = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(_at DIV 8 AS int) + 1, 1)), 16, 10) AS int), cast(_at % 8 AS int)) & 1 = 1")
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(found, F.lit(False)).alias(flag))


def thin(wide: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``wide`` whose key may be among ``keys``: all that are and some others."""
    return flagged(wide, keys, on).filter("_flag").drop("_flag")


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not among ``keys``; a null key stays. Only rows that may be among them
    are shuffled, with all their columns."""
    marked = flagged(rows, keys, on)
    near = marked.filter("_flag").join(keys.select(on).distinct(), on, "left_anti")
    return marked.filter("NOT _flag").unionByName(near).select(*(F.col(f"`{c}`") for c in rows.columns))
