"""Reading and writing tables of files: formats, partitions, buckets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: text has one string column, a line a row.
FORMATS = ("parquet", "orc", "json", "csv", "xml", "text")

#: What each format needs so that a schema that is given comes back as it was written.
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_OPTIONS = {
    "csv": {"header": "true", "escape": '"', "multiLine": "true", **_TIMES},
    "xml": {"rowTag": "row", **_TIMES},
    "json": {"ignoreNullFields": "false", **_TIMES},
}

#: Formats whose files can't be split, so that one task reads a file whole, with the bytes that they take for one of
#: JSON at most, about; and the bytes of such a file, about.
_WHOLE, FILE_BYTES = {"csv": 1, "xml": 2}, 32 << 20
#: Rows of a bucket, about: one task reads, sorts and joins it. Spark's limit of buckets.
BUCKET_ROWS, MOST_BUCKETS = 500_000, 100_000


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> None:
    """One file for each task; with partition_by, rows are first brought together by those columns so
    that a folder gets few files, and AQE splits those of a hot value. Where one task will read a file whole, rows are
    measured first, in a pass of its own, and files get about FILE_BYTES each."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {FORMATS}")
    rows, options = df, dict(_OPTIONS.get(fmt, {}))
    if fmt in _WHOLE:
        width = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}))
        n, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0)) * _WHOLE[fmt]).first()
        parts = -(-size // FILE_BYTES)
        if parts > 1:
            rows = rows.repartition(parts)
            # A task of repartition() has n / parts rows, give or take a few; one of a folder may have all.
            options["maxRecordsPerFile"] = -(-n // parts) * (1 if partition_by else 2)
    rows = rows.hint("rebalance", *partition_by) if partition_by else rows
    writer = rows.write.format(fmt).options(**options).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    """Formats without types of their own need a schema."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {FORMATS}")
    if schema is None and fmt in ("json", "csv", "xml"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**_OPTIONS.get(fmt, {}))
    return (reader.schema(schema) if schema is not None else reader).load(path)


def buckets(*tables: DataFrame, least: int = 8) -> int:
    """How many buckets tables that are to be joined need, so that none has many more than BUCKET_ROWS rows of a table."""
    return min(MOST_BUCKETS, max(least, *(-(-t.count() // BUCKET_ROWS) for t in tables)))


def write_bucketed(df: DataFrame, name: str, by: list[str], buckets: int) -> None:
    """A table that joins and groups on ``by`` without a shuffle. Rows are shuffled once, here."""
    rows = df.repartition(buckets, *by)
    rows.write.format("parquet").bucketBy(buckets, *by).sortBy(*by).mode("overwrite").saveAsTable(name)


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**_OPTIONS.get(fmt, {}))
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)
