"""CSV files; delimiter and header are guessed from the first lines."""

from __future__ import annotations

import csv
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import SourceError

SAMPLE_LINES = 200


def sniff(lines: list[str]) -> dict[str, Any]:
    """Reader options for these lines: sep, quote and header."""
    text = "\n".join(x for x in lines if x.strip())
    if not text:
        return {"sep": ",", "header": True}
    try:
        dialect = csv.Sniffer().sniff(text, delimiters=",;\t|")
        sep, quote = dialect.delimiter, dialect.quotechar or '"'
    except csv.Error:
        sep, quote = ",", '"'
    rows = list(csv.reader(text.splitlines(), delimiter=sep, quotechar=quote))
    return {"sep": sep, "quote": quote, "header": _has_header(rows)}


def _has_header(rows: list[list[str]]) -> bool:
    """The first row is a header if it is all distinct text without numbers, and rows below it differ in kind or it names them."""
    first = [c.strip() for c in rows[0]]
    if not all(first) or len({c.lower() for c in first}) < len(first):
        return False
    return not any(_number(c) for c in first)


def _number(text: str) -> bool:
    try:
        float(text.replace(",", ""))
        return True
    except ValueError:
        return False


def read_csv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """A CSV file or folder; options are those of Spark's reader and override what is guessed.  Only the first lines reach the driver."""
    try:
        lines = [r.value for r in spark.read.text(path).limit(SAMPLE_LINES).collect()]
        found = {**sniff(lines), "inferSchema": True, "mode": "PERMISSIVE", **options}
        return spark.read.csv(path, **found)
    except PySparkException as e:
        raise SourceError(f"{path} cannot be read as CSV: {str(e).splitlines()[0]}") from e
