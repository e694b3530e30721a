"""Tables of a database: written and read by several connections at once, or filled by tasks, a database each."""

from __future__ import annotations

import glob
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Rows of a database that a task fills, about: one task loads it, one query reads it.
DATABASE_ROWS = 1_000_000
#: Types that come back from Derby as they were.
_DERBY_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "date": "DATE"}


def write(df: DataFrame, url: str, name: str, driver: str, connections: int = 4, mode: str = "error") -> None:
    """One connection for each of at most so many tasks."""
    df.coalesce(connections).write.format("jdbc").options(url=url, dbtable=name, driver=driver, batchsize=10_000).mode(mode).save()


def read(spark: SparkSession, url: str, name: str, driver: str, by: str | None = None, parts: int = 4) -> DataFrame:
    """name as a DataFrame, whose filters and columns the database computes as far as it can. by, a
    number or a time, divides the rows among parts queries between its least and greatest value, which one query finds
    first; rows beyond these and nulls fall to the outer parts, so none is lost if the table grows meanwhile."""
    reader = spark.read.format("jdbc").options(url=url, driver=driver)
    if by is None:
        return reader.option("dbtable", name).load()
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(by)
    low, high = reader.option("query", f"SELECT min({quoted}) AS lo, max({quoted}) AS hi FROM {name}").load().first()
    plain = spark.read.format("jdbc").options(url=url, driver=driver, dbtable=name)
    if low is None:
        return plain.load()
    return plain.options(partitionColumn=by, lowerBound=str(low), upperBound=str(high), numPartitions=parts).load()


def fill(df: DataFrame, home: str, name: str, least: int = 4) -> list[str]:
    """URLs of Derby databases beneath home, a local path that driver and executors share. Their tables name hold df's
    rows, numbers and days only, each table DATABASE_ROWS or so; least tasks fill them at least. One process alone may
    write a Derby database, so each task's is loaded by a process of its own and put into a jar: from there any number
    of processes read it at once. A task without rows makes none; one that is repeated makes a new one."""
    kinds = dict(df.dtypes)
    if not kinds or not set(kinds.values()) <= set(_DERBY_TYPES):
        raise ValueError(f"columns may be {', '.join(_DERBY_TYPES)}, not {kinds}")
    if not os.path.isabs(home):
        raise ValueError(f"Derby reads local paths only, not {home}")
    columns = ", ".join('"{}" {}'.format(c.replace('"', '""'), _DERBY_TYPES[kind]) for c, kind in kinds.items())

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        url = _database(batches, home, name, columns)
        if url:
            yield pa.RecordBatch.from_pydict({"url": [url]})

    parts = max(least, -(-df.count() // DATABASE_ROWS))
    return [r.url for r in df.repartition(parts).mapInArrow(made, "url string").collect()]


def read_filled(spark: SparkSession, urls: list[str], like: DataFrame, name: str, driver: str) -> DataFrame:
    """The rows of like that fill() put into the databases, one query for each of these, with filters and columns as read()."""
    if not urls:
        return spark.createDataFrame([], like.schema)
    return reduce(DataFrame.union, (read(spark, url, name, driver).select(like.columns) for url in urls))


def _database(batches: Iterator, home: str, name: str, columns: str) -> str | None:
    """The URL of a new database of the batches' rows, if there are any."""
    from pyarrow import csv

    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return None
    # Absolute for both processes: the folder for temporary files may be named relative to the worker's own.
    with tempfile.TemporaryDirectory(dir=os.path.realpath(tempfile.gettempdir())) as own:
        rows, base = f"{own}/rows.csv", f"{own}/base"
        with csv.CSVWriter(rows, first.schema, write_options=csv.WriteOptions(include_header=False)) as out:
            out.write_batch(first)
            for batch in batches:
                out.write_batch(batch)
        _load(base, own, rows, name, columns)
        os.remove(rows)
        os.makedirs(home, exist_ok=True)
        jar = f"{home}/{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(jar, "w", zipfile.ZIP_STORED) as packed:  # stored, so that a page is found by its place
            for folder, _, names in os.walk(base):
                for x in names:
                    packed.write(f"{folder}/{x}", f"base/{os.path.relpath(f'{folder}/{x}', base)}")
    return f"jdbc:derby:jar:({jar})base"


def _load(base: str, own: str, rows: str, name: str, columns: str) -> None:
    """A new database at base with a table of the rows, by Derby's import, and closed again."""
    from py4j.protocol import Py4JJavaError

    with _java(own) as jvm:
        connect = jvm.java.sql.DriverManager.getConnection
        connection = connect(f"jdbc:derby:directory:{base};create=true")
        statement = connection.createStatement()
        # Whoever reads the database keeps few of its pages: its queries read the table once.
        statement.execute("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.pageCacheSize', '100')")
        statement.execute(f"CREATE TABLE {name} ({columns})")
        load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
        load.setString(1, name.upper())
        load.setString(2, rows)
        load.execute()
        connection.close()
        try:
            connect(f"jdbc:derby:directory:{base};shutdown=true")
        except Py4JJavaError as e:  # so Derby reports that a database is closed
            if e.java_exception.getSQLState() != "08006":
                raise


@contextmanager
def _java(own: str):
    """The classes of a Java process with Derby alone, which ends with the block or with this process."""
    import pyspark
    from py4j.java_gateway import JavaGateway

    jars = f"{os.environ.get('SPARK_HOME') or os.path.dirname(pyspark.__file__)}/jars"
    java = f"{os.environ['JAVA_HOME']}/bin/java" if os.environ.get("JAVA_HOME") else "java"
    gateway = JavaGateway.launch_gateway(
        jarpath=glob.glob(f"{jars}/py4j-*.jar")[0],
        classpath=os.pathsep.join(glob.glob(f"{jars}/derby*.jar")),
        javaopts=["-Xmx128m", "-XX:+UseSerialGC", f"-Dderby.stream.error.file={own}/derby.log"],
        java_path=java,
        die_on_exit=True,
        enable_auth=True,
    )
    try:
        yield gateway.jvm
    finally:
        gateway.shutdown()
        gateway.java_process.stdin.close()
        gateway.java_process.wait()
