"""Reading databases over JDBC, in parallel where a column to split by is named."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError
from .config import Source


def read_query(spark: SparkSession, source: Source, sql: str, batch_size: int = 100_000, split_by: str | None = None, bounds: tuple | None = None, parts: int = 1) -> DataFrame:
    """The rows of a query.  With split_by and bounds, `parts` tasks read ranges of that column side by side."""
    url, properties = source.connection()
    reader = spark.read.format("jdbc").option("url", url).options(**properties).option("fetchsize", batch_size)
    if split_by:
        if not bounds or parts < 1:
            raise SourceError("split_by needs the bounds of the column and a number of parts")
        reader = reader.option("dbtable", f"({sql}) q").option("partitionColumn", split_by).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    else:
        reader = reader.option("query", sql)
    try:
        return reader.load()
    except (PySparkException, Exception) as e:  # drivers raise their own kinds through the gateway
        raise SourceError(f"source '{source.name}' could not be read: {str(e).splitlines()[0]}") from e


class Connection:
    """A DB-API connection, as far as push needs one, on a JDBC driver of the driver's JVM; nothing is committed by itself."""

    def __init__(self, spark: SparkSession, source: Source):
        url, properties = source.connection()
        self.jvm = spark.sparkContext._jvm
        own = self.jvm.java.util.Properties()
        for k, v in properties.items():
            if k == "driver":
                self.jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(v)
            else:
                own.setProperty(k, v)
        try:
            self.raw = self.jvm.java.sql.DriverManager.getConnection(url, own)
        except Exception as e:
            raise SourceError(f"source '{source.name}' could not be reached: {str(e).splitlines()[0]}") from e
        self.raw.setAutoCommit(False)

    def cursor(self) -> Cursor:
        return Cursor(self)

    def commit(self) -> None:
        self.raw.commit()

    def rollback(self) -> None:
        self.raw.rollback()

    def close(self) -> None:
        self.raw.close()


class Cursor:
    def __init__(self, connection: Connection):
        self.jvm, self.raw, self.rows = connection.jvm, connection.raw, None

    def _java(self, value: Any) -> Any:
        sql = self.jvm.java.sql
        if isinstance(value, datetime):
            if value.tzinfo:
                return self.jvm.java.time.OffsetDateTime.parse(value.isoformat())
            return sql.Timestamp.valueOf(value.isoformat(sep=" "))
        if isinstance(value, date):
            return sql.Date.valueOf(value.isoformat())
        if isinstance(value, Decimal):
            return self.jvm.java.math.BigDecimal(str(value))
        return bytes(value) if isinstance(value, (bytes, bytearray)) else value

    def _prepared(self, sql: str):
        return self.raw.prepareStatement(sql)

    def _fill(self, statement: Any, args: Sequence) -> None:
        for i, value in enumerate(args, 1):
            statement.setObject(i, self._java(value))

    def execute(self, sql: str, args: Sequence = ()) -> None:
        statement = self._prepared(sql)
        self._fill(statement, args)
        self.rows = statement.getResultSet() if statement.execute() else None

    def fetchone(self) -> tuple | None:
        if self.rows is None or not self.rows.next():
            return None
        return tuple(self.rows.getObject(i) for i in range(1, self.rows.getMetaData().getColumnCount() + 1))

    def executemany(self, sql: str, rows: Iterable[Sequence]) -> None:
        statement = self._prepared(sql)
        for row in rows:
            self._fill(statement, row)
            statement.addBatch()
        statement.executeBatch()
        statement.close()
