"""Landing a stream of record batches as a table, a bounded number of rows at a time."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import PlumbError, SourceError

RESERVED = "_mirror"


def check_landing(table: str) -> str:
    parts = table.split(".")
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise PlumbError(f"'{table}' is no table name - write schema.table")
    if parts[0].lower() == RESERVED and len(parts) > 1:
        raise PlumbError(f"the schema {RESERVED} belongs to the mirror - land into another one")
    return table


def land_batches(spark: SparkSession, batches: Iterable[pa.RecordBatch] | pa.RecordBatchReader, table: str, rows_at_once: int = 100_000) -> int:
    """Replace a table by the batches and return how many rows it has.

    The rows go to a table beside it first, so the old one stays until all have
    arrived; then it steps aside and goes when the new one has its name.  A run
    that was cut off between these two finds it there and puts it back.  The
    driver holds rows_at_once rows and one batch at most.
    """
    check_landing(table)
    old = f"{table}__before"
    if spark.catalog.tableExists(old) and not spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
    side, held, rows, total, schema = f"{table}__landing", [], 0, 0, getattr(batches, "schema", None)
    spark.sql(f"DROP TABLE IF EXISTS {side}")

    def flush(mode: str) -> None:
        spark.createDataFrame(pa.Table.from_batches(held, schema)).write.mode(mode).saveAsTable(side)

    try:
        for batch in batches:
            schema = schema or batch.schema
            held.append(batch)
            rows, total = rows + batch.num_rows, total + batch.num_rows
            if rows >= rows_at_once:
                flush("append")
                held, rows = [], 0
        if held or total == 0:
            if schema is None:
                raise SourceError("the stream has neither rows nor a schema - nothing was landed")
            flush("append")
        if spark.catalog.tableExists(table):
            spark.sql(f"DROP TABLE IF EXISTS {old}")
            spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {side} RENAME TO {table}")
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        return total
    except Exception:
        if spark.catalog.tableExists(old) and not spark.catalog.tableExists(table):
            spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        spark.sql(f"DROP TABLE IF EXISTS {side}")
        raise


def spooled(spark: SparkSession, batches: pa.RecordBatchReader, rows_at_once: int = 100_000) -> DataFrame:
    """A stream of record batches as a DataFrame over files, written rows_at_once rows at a time; the driver holds no more."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    folder, held, rows = f"{top.rstrip('/')}/_streams/{uuid.uuid4().hex}", [], 0

    def flush() -> None:
        spark.createDataFrame(pa.Table.from_batches(held, batches.schema)).write.mode("append").parquet(folder)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= rows_at_once:
            flush()
            held, rows = [], 0
    flush()
    return spark.read.parquet(folder)
