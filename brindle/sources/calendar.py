"""A data source of days, read in parallel: one row for each day from start to end, a partition a year."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "day date, week long, weekday long, quarter long"


class _Days(InputPartition):
    def __init__(self, first: datetime.date, last: datetime.date) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.first, self.last = (datetime.date.fromisoformat(options[k]) for k in ("start", "end"))

    def partitions(self) -> list[_Days]:
        years = range(self.first.year, self.last.year + 1)
        return [_Days(max(self.first, datetime.date(y, 1, 1)), min(self.last, datetime.date(y, 12, 31))) for y in years]

    def read(self, partition: _Days) -> Iterator[pa.RecordBatch]:
        days = [partition.first + datetime.timedelta(n) for n in range((partition.last - partition.first).days + 1)]
        yield pa.RecordBatch.from_pydict(
            {"day": days, "week": [d.isocalendar().week for d in days], "weekday": [d.isoweekday() for d in days], "quarter": [(d.month + 2) // 3 for d in days]}
        )


class Calendar(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Days from start to end (ISO dates, both included)."""
    spark.dataSource.register(Calendar)
    return spark.read.format("calendar").options(start=start, end=end).load()
