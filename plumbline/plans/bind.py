"""Checks of a model against the tables it names, before anything is computed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SemanticsError
from .spec import Measure, Model


def parse(spark: SparkSession, text: str) -> list[dict]:
    """The nodes of an aggregate's parse tree, in preorder; reachable from classic sessions only."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(f"SELECT {text}")
    return _flat(json.loads(plan.toJSON()))


def _flat(value) -> list[dict]:
    out = []
    if isinstance(value, dict):
        if "class" in value:
            out.append(value)
        for v in value.values():
            out += _flat(v)
    elif isinstance(value, list):
        for v in value:
            out += _flat(v)
    return out


def _kind(node: dict) -> str:
    return node["class"].rpartition(".")[2]


def parts_of(model: Model) -> list[tuple[str, str, str | None]]:
    """(measure, aggregate, predicate) of all parts."""
    out = []
    for m in model.measures.values():
        out += [(m.name, m.num, None), (m.name, m.den, None)] if m.is_ratio else [(m.name, m.text, m.where)]
    return out


def _readable(read: Callable[[str], DataFrame], table: str, what: str) -> DataFrame:
    try:
        return read(table)
    except PySparkException as e:
        raise SemanticsError(f"{what}: table '{table}' cannot be read - {str(e).splitlines()[0]}") from e


def _need(frame: DataFrame, column: str, table: str, what: str) -> None:
    if column.lower() not in (c.lower() for c in frame.columns):
        raise SemanticsError(f"{what}: table '{table}' has no column '{column}' - it has {', '.join(frame.columns)}")


def _check_part(spark: SparkSession, model: Model, fact: DataFrame, name: str, text: str) -> None:
    where = f"{model.name}.{name}"
    try:
        nodes = parse(spark, text)
    except PySparkException as e:
        raise SemanticsError(f"{where}: '{text}' is no SQL - {str(e).splitlines()[0]}") from e
    if sum(_kind(n) in ("Project",) for n in nodes[:1]) != 1:
        raise SemanticsError(f"{where}: '{text}' is no single expression")
    for n in nodes:
        if _kind(n) == "UnresolvedAttribute" and _dotted(n.get("nameParts")):
            raise SemanticsError(f"{where}: measures name columns of the fact alone, without a table before them: '{text}'")
        if _kind(n) == "UnresolvedRelation":
            table = ".".join(_words(n.get("multipartIdentifier")))
            if table.lower() != model.fact.lower():
                raise SemanticsError(f"{where}: a subquery may read {model.fact} alone, not {table}")
    try:
        frame = fact.select(F.expr(text).alias("value"))
        root = frame._jdf.queryExecution().analyzed()
    except PySparkException as e:
        raise SemanticsError(f"{where}: '{text}' does not fit {model.fact} - {str(e).splitlines()[0]}") from e
    if root.getClass().getSimpleName() != "Aggregate":
        raise SemanticsError(f"{where}: '{text}' is no aggregate - write for example sum(...)")


def _words(value) -> list[str]:
    if isinstance(value, list):
        return [str(v) for v in value]
    return [w.strip() for w in str(value or "").strip("[]").split(",") if w.strip()]


def _dotted(value) -> bool:
    return len(_words(value)) > 1


def check_model(spark: SparkSession, model: Model, read: Callable[[str], DataFrame], data: bool = True) -> list[str]:
    """Warnings; errors are raised.  data: also look at keys, which runs jobs over the dimensions and the fact's keys."""
    fact = _readable(read, model.fact, model.name)
    _need(fact, model.time_column, model.fact, model.name)
    kind = dict(fact.dtypes)[next(c for c in fact.columns if c.lower() == model.time_column.lower())]
    if kind not in ("date", "timestamp", "timestamp_ntz"):
        raise SemanticsError(f"{model.name}: time column '{model.time_column}' is {kind} - a date or timestamp is needed")
    for dim in model.dims.values():
        _need(fact, dim.column, model.fact, f"{model.name}.{dim.name}")
        if dim.shared:
            side = _readable(read, dim.shared.table, f"{model.name}.{dim.name}")
            for column in (dim.shared.key, *dim.shared.attributes.values()):
                _need(side, column, dim.shared.table, f"dimensions.{dim.name}")
    for name, text, _ in parts_of(model):
        _check_part(spark, model, fact, name, text)
    return _check_keys(model, read, fact) if data else []


def orphans(model: Model, read: Callable[[str], DataFrame]) -> DataFrame:
    """Per shared dimension: dimension, key_column, orphan_rows (with a key that its table lacks) and fact_rows."""
    fact, out = read(model.fact), None
    total = fact.agg(F.count(F.lit(1)).alias("fact_rows"))
    for dim in model.dims.values():
        if not dim.shared:
            continue
        # counted by key before anything moves, so that a common key is one row a task
        counts = fact.groupBy(F.col(f"`{dim.column}`").alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__key is not null")
        known = read(dim.shared.table).select(F.col(f"`{dim.shared.key}`").alias("__known"))
        lost = counts.join(known, F.col("__key") == F.col("__known"), "left_anti").agg(F.coalesce(F.sum("__n"), F.lit(0).cast("long")).alias("orphan_rows"))
        row = lost.crossJoin(total).select(F.lit(dim.name).alias("dimension"), F.lit(dim.column).alias("key_column"), "orphan_rows", "fact_rows")  # one row and one row
        out = row if out is None else out.union(row)
    return out if out is not None else total.sparkSession.createDataFrame([], "dimension string, key_column string, orphan_rows long, fact_rows long")


def _check_keys(model: Model, read: Callable[[str], DataFrame], fact: DataFrame) -> list[str]:
    warnings, seen = [], set()
    for dim in model.dims.values():
        if not dim.shared:
            continue
        side = read(dim.shared.table)
        key = F.col(f"`{dim.shared.key}`")
        if (dim.shared.table, dim.shared.key) not in seen:
            seen.add((dim.shared.table, dim.shared.key))
            n, distinct, missing = side.agg(F.count(F.lit(1)), F.count_distinct(key), F.sum(key.isNull().cast("int"))).first()
            if n != distinct:
                raise SemanticsError(f"dimensions.{dim.name}: {dim.shared.table}.{dim.shared.key} is no key - {n - distinct} of {n} rows repeat one or have none ({missing or 0} NULL)")
    for r in orphans(model, read).where("orphan_rows > 0").collect():
        warnings.append(f"{model.name}.{r.dimension}: {r.orphan_rows} of {r.fact_rows} rows ({100 * r.orphan_rows / r.fact_rows:.1f} %) have a {r.key_column} that {model.dims[r.dimension].shared.table} lacks; they fall into the NULL group")
    return warnings


def definition(measure: Measure) -> str:
    return f"{measure.num} / {measure.den}" if measure.is_ratio else measure.text
