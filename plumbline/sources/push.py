"""Writing results back, to allowed schemas only and all or nothing."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import PlumbError, PushRefused, SourceError

#: SQL Server types of Spark types
_SQL = {
    T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "REAL", T.DoubleType: "FLOAT", T.BooleanType: "BIT",
    T.StringType: "NVARCHAR(MAX)", T.VarcharType: "NVARCHAR(MAX)", T.CharType: "NVARCHAR(MAX)", T.DateType: "DATE", T.TimestampNTZType: "DATETIME2", T.TimestampType: "DATETIMEOFFSET", T.BinaryType: "VARBINARY(MAX)",
}


def sql_type(field: T.StructField) -> str:
    if isinstance(field.dataType, T.DecimalType):
        return f"DECIMAL({field.dataType.precision},{field.dataType.scale})"
    try:
        return _SQL[type(field.dataType)]
    except KeyError:
        raise SourceError(f"column '{field.name}' is {field.dataType.simpleString()}, which no column of the target can hold - flatten or drop it") from None


def quoted(name: str) -> str:
    return "[" + name.replace("]", "]]") + "]"


def parse_target(target: str) -> tuple[str, str, str]:
    parts = target.split(".") if isinstance(target, str) else []
    if len(parts) != 3 or not all(p.strip() for p in parts):
        raise PlumbError(f"'{target}' is no target - write Database.schema.table")
    return parts[0], parts[1], parts[2]


def check_allowed(database: str, schema: str, allow: Iterable[str]) -> None:
    allow = list(allow)
    if f"{database}.{schema}".lower() not in (a.lower() for a in allow):
        raise PushRefused(f"{database}.{schema} is not listed under push.allow ({', '.join(allow) or 'which is empty'}) - nothing was written")


def push_rows(connection: Any, database: str, schema: str, table: str, df: DataFrame, if_exists: str = "fail", batch_size: int = 5_000) -> int:
    """Create a table and insert df's rows in one transaction on a DB-API connection.

    Rows are streamed to the driver partition by partition: one connection is
    what makes the write all or nothing.  For results too large for that, write
    to a staging table over JDBC and rename it.
    """
    if if_exists not in ("fail", "replace"):
        raise PlumbError(f"if_exists is 'fail' or 'replace', not {if_exists!r}")
    name = ".".join(map(quoted, (database, schema, table)))
    columns = ", ".join(f"{quoted(f.name)} {sql_type(f)}" for f in df.schema)
    cursor = connection.cursor()
    try:
        cursor.execute(f"SELECT count(*) FROM {quoted(database)}.INFORMATION_SCHEMA.TABLES WHERE TABLE_SCHEMA = ? AND TABLE_NAME = ? AND TABLE_TYPE = 'BASE TABLE'", [schema, table])
        if cursor.fetchone()[0]:
            if if_exists == "fail":
                raise PlumbError(f"{database}.{schema}.{table} exists - pass if_exists='replace' to overwrite it")
            cursor.execute(f"DROP TABLE {name}")
        cursor.execute(f"CREATE TABLE {name} ({columns})")
        insert = f"INSERT INTO {name} ({', '.join(quoted(c) for c in df.columns)}) VALUES ({', '.join('?' * len(df.columns))})"
        total, batch = 0, []
        for row in df.toLocalIterator(prefetchPartitions=True):
            batch.append(tuple(row))
            if len(batch) == batch_size:
                cursor.executemany(insert, batch)
                total, batch = total + len(batch), []
        if batch:
            cursor.executemany(insert, batch)
        connection.commit()
        return total + len(batch)
    except Exception as e:
        try:
            connection.rollback()
        except Exception:  # the first error is the one to tell
            pass
        if isinstance(e, PlumbError):
            raise
        raise SourceError(f"{database}.{schema}.{table} could not be written, nothing has changed: {e}") from e
