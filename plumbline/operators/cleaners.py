"""Cleaning steps: each takes a DataFrame and returns one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PlumbError

Step = Callable[[DataFrame], DataFrame]

#: strptime codes and the datetime patterns of Spark with the same meaning
PATTERN = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "f": "SSSSSS", "j": "D", "%": "%",
}


def snake_name(name: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", str(name)).strip("_").lower() or "col"


def unique(names: list[str]) -> list[str]:
    """Names with _2, _3 ... after those that came before."""
    seen: set[str] = set()
    out = []
    for name in names:
        k, new = 1, name
        while new in seen:
            k += 1
            new = f"{name}_{k}"
        seen.add(new)
        out.append(new)
    return out


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores, without repeats."""
    return df.toDF(*unique([snake_name(c) for c in df.columns]))


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns and rows of NULLs alone; a frame without rows stays as it is.  Counting takes one job."""
    if not df.columns:
        return df
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in df.columns]).first()
    if counts[0] == 0:
        return df
    return df.select(*[F.col(f"`{c}`") for c, n in zip(df.columns, counts[1:]) if n]).dropna("all")


def strip_strings(df: DataFrame) -> DataFrame:
    """Texts without white space at their ends; empty ones become NULL."""
    kinds = dict(df.dtypes)
    trimmed = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", "")
    return df.withColumns({c: F.when(trimmed(c) != "", trimmed(c)) for c in df.columns if kinds[c] == "string"})


def spark_pattern(format: str) -> str:
    """The datetime pattern of a strptime format."""
    out, i = "", 0
    while i < len(format):
        if format[i] == "%":
            code = format[i + 1 : i + 2]
            if code not in PATTERN:
                raise PlumbError(f"the date format '{format}' has %{code}, which is not known - use %Y %m %d %H %M %S and the like")
            out += PATTERN[code]
            i += 2
        else:
            out += f"'{format[i]}'" if format[i].isalpha() else "''" if format[i] == "'" else format[i]
            i += 1
    return out


def parse_dates(*columns: str, format: str = "%Y-%m-%d") -> Step:
    """A step: texts by their format, numbers as spreadsheet days since 1899-12-30; what cannot be read is NULL."""

    def step(df: DataFrame) -> DataFrame:
        kinds, new = dict(df.dtypes), {}
        for c in columns:
            if c not in kinds:
                raise PlumbError(f"there is no column '{c}' - there are {', '.join(df.columns)}")
            x = F.col(f"`{c}`")
            if kinds[c] == "string":
                new[c] = F.try_to_timestamp(F.trim(x), F.lit(spark_pattern(format))).cast("timestamp_ntz")
            elif kinds[c] not in ("date", "timestamp", "timestamp_ntz"):
                micros = F.round(x.cast("double") * 86_400_000_000).cast("long")
                new[c] = F.expr("timestamp_ntz'1899-12-30 00:00:00'") + F.make_dt_interval(secs=micros / F.lit(1_000_000).cast("decimal(20,6)"))
        return df.withColumns(new)

    return step


def numeric(*columns: str) -> Step:
    """A step: texts as numbers, without currency signs, commas and blanks; what is no number is NULL."""

    def step(df: DataFrame) -> DataFrame:
        kinds, new = dict(df.dtypes), {}
        for c in columns:
            if c not in kinds:
                raise PlumbError(f"there is no column '{c}' - there are {', '.join(df.columns)}")
            x = F.col(f"`{c}`")
            if kinds[c] == "string":
                bare = F.regexp_replace(x, r"[$€£,\s]", "")
                new[c] = F.when(bare.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
            else:
                new[c] = x.cast("double")
        return df.withColumns(new)

    return step


def clean(df: DataFrame, *steps: Step) -> DataFrame:
    """df after all steps, from left to right."""
    return reduce(lambda x, step: step(x), steps, df)
