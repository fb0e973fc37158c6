"""Frames of other libraries in and out."""

from __future__ import annotations

import importlib.util
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError
from ..streaming.land import spooled

BACKENDS = ("spark", "pandas", "pyarrow", "polars")


def default_backend() -> str:
    return "spark"


def from_spark(df: DataFrame, backend: str | None = None) -> Any:
    """df as the frame of a backend; local ones hold all rows in the driver."""
    backend = backend or default_backend()
    if backend == "spark":
        return df
    if backend == "pandas":
        return df.toPandas()
    if backend == "pyarrow":
        return df.toArrow()
    if backend == "polars":
        if importlib.util.find_spec("polars") is None:
            raise SourceError("polars is not installed - use spark, pandas or pyarrow")
        import polars

        return polars.from_arrow(df.toArrow())
    raise SourceError(f"unknown frame backend '{backend}' - use one of {', '.join(BACKENDS)}")


def to_spark(spark: SparkSession, frame: Any) -> DataFrame:
    """A DataFrame from what other libraries hand over."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(frame, DataFrame):
        return frame
    if isinstance(frame, pd.DataFrame):
        frame = pa.Table.from_pandas(frame, preserve_index=False)
    elif isinstance(frame, pa.Table):
        pass
    elif isinstance(frame, pa.RecordBatchReader):
        return spooled(spark, frame)
    elif isinstance(frame, pa.RecordBatch):
        frame = pa.Table.from_batches([frame])
    elif hasattr(frame, "collect") and hasattr(frame, "lazy"):
        raise SourceError("a lazy frame has no rows yet - call .collect() first")
    elif hasattr(frame, "__arrow_c_stream__"):
        return spooled(spark, pa.RecordBatchReader.from_stream(frame))
    elif hasattr(frame, "to_pyarrow"):
        frame = frame.to_pyarrow()
    elif hasattr(frame, "to_arrow"):
        frame = frame.to_arrow()
    elif isinstance(frame, list) and frame and all(isinstance(r, dict) for r in frame):
        frame = pa.Table.from_pylist(frame)
    if not isinstance(frame, pa.Table):
        raise SourceError(f"a {type(frame).__name__} is no frame - pass a Spark, pandas or Arrow frame")
    return spark.createDataFrame(frame)
