"""Comparison lanes: the same aggregate over an earlier window, or over the fiscal year so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..plans.spec import Measure, Model
from .partials import MERGES, taken_apart
from .relation import CELL, PERIOD, AttributeFilter, By, Window, aggregates, attribute_column, in_window, lane, used_attributes, with_dims, with_filters

COMPARISONS = ("prior", "yoy", "fytd")


def offset(comparison: str, grain: str) -> tuple[int, int]:
    """(months, days) that a comparison looks back."""
    return (12, 0) if comparison == "yoy" else cal.STEP[grain]


def shifted(model: Model, measures: list[Measure], by: list[By], filters: list[AttributeFilter], window: Window | None, grain: str, comparison: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """The lane of an earlier window, under its own periods."""
    return lane(model, measures, by, filters, window.earlier(*offset(comparison, grain)) if window else None, grain, read)


def fiscal_to_date(model: Model, measures: list[Measure], by: list[By], filters: list[AttributeFilter], window: Window | None, grain: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """Each period and group over all rows of the period's fiscal year up to the period.

    Rows count by the fiscal year they lie in and by the period they lie in, so
    a week that straddles two years adds to the first one's, and rows of the new
    year roll on to the next week.  The window's end cuts; its begin only says
    which fiscal year is the first that matters, and that bound reaches the scan.

    Rows are aggregated by period and group first.  Sums, counts, least and
    greatest values then run on from period to period within a fiscal year and
    group, and so do distinct counts, a key counting in the first period that has
    it.  Cells that the base lacks fall away beside it.
    """
    rows = _rows_to_date(model, by, filters, window, grain, read)
    texts = [(f"__n{i}" if k == "num" else f"__d{i}" if k == "den" else f"__v{i}", text) for i, m in enumerate(measures) for k, text in ((("num", m.num), ("den", m.den)) if m.is_ratio else (("", m.text),))]
    apart = [taken_apart(text, f"__p{j}_") for j, (_, text) in enumerate(texts)]
    if not all(apart):
        return _met_by_period(rows, model, measures, by, window, grain, read)
    groups = [f"__g{i}" for i in range(len(by))]
    rows = rows.withColumns({g: F.col(f"`{attribute_column(b.dim, b.attribute)}`") for g, b in zip(groups, by)})
    at = ["__row_fy", *groups, "__row_period"]
    named = [(f"__p{j}_{k}", piece) for j, (_, pieces) in enumerate(apart) for k, piece in enumerate(pieces)]
    plain = [(n, piece) for n, piece in named if not piece.distinct]
    cells = rows.groupBy(at).agg(*[F.expr(piece.text).alias(n) for n, piece in plain], F.count(F.lit(1)).alias(CELL))
    kinds = dict(cells.dtypes)
    parts = [cells]
    for n, piece in named:
        if piece.distinct:
            held = rows.where(F.expr(piece.where)) if piece.where else rows
            first = held.withColumn("__key", F.expr(piece.key)).where("__key is not null").groupBy("__row_fy", *groups, "__key").agg(F.min("__row_period").alias("__row_period"))
            parts.append(first.groupBy(at).agg(F.count(F.lit(1)).alias(n)))
            kinds[n] = "bigint"
    # the cells whose value is wanted: a period belongs to the fiscal year of its first day
    parts.append(cells.select(cal.period_of("fy", F.col("__row_period"), model.fiscal_start).alias("__row_fy"), *groups, "__row_period").distinct().withColumn("__wanted", F.lit(True)))
    values = [*[n for n, _ in named], CELL]
    merge = {n: getattr(F, MERGES[piece.function]) for n, piece in named} | {CELL: F.sum}
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    so_far = W.partitionBy("__row_fy", *groups).orderBy("__row_period").rangeBetween(W.unboundedPreceding, W.currentRow)
    run_on = both.withColumns({n: merge[n](n).over(so_far).cast(kinds[n]) for n in values}).where("__wanted and __row_period is not null")
    run_on = run_on.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast(kinds[n])) for n, piece in named if piece.function == "count"})
    run_on = run_on.where(F.col(CELL) > 0)
    return run_on.select(F.col("__row_period").alias(PERIOD), *groups, *[F.expr(template).alias(name) for (name, _), (template, _) in zip(texts, apart)], CELL)


def _rows_to_date(model: Model, by: list[By], filters: list[AttributeFilter], window: Window | None, grain: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """The rows that some period's year to date may hold, with the fiscal year and the period they lie in."""
    if window is not None:
        window = Window(cal.period_start("fy", cal.period_start(grain, window.lo, model.fiscal_start), model.fiscal_start), window.high)
    rows = in_window(read(model.fact), model.time_column, window)
    rows = with_filters(with_dims(rows, model, used_attributes(by, filters), read), filters)
    tc = F.col(f"`{model.time_column}`")
    return rows.withColumns({"__row_fy": cal.period_of("fy", tc, model.fiscal_start), "__row_period": cal.period_of(grain, tc, model.fiscal_start)})


def _met_by_period(rows: DataFrame, model: Model, measures: list[Measure], by: list[By], window: Window | None, grain: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """For aggregates that do not add up, as medians: the rows meet the list of periods, which a calendar bounds, in a broadcast join."""
    periods = in_window(read(model.fact), model.time_column, window).select(cal.period_of(grain, F.col(f"`{model.time_column}`"), model.fiscal_start).alias(PERIOD)).where(F.col(PERIOD).isNotNull()).distinct()
    periods = periods.withColumn("__fy", cal.period_of("fy", F.col(PERIOD), model.fiscal_start))
    joined = rows.join(F.broadcast(periods), (F.col("__row_fy") == F.col("__fy")) & (F.col("__row_period") <= F.col(PERIOD)))
    return joined.groupBy(PERIOD, *[F.col(f"`{attribute_column(b.dim, b.attribute)}`").alias(f"__g{i}") for i, b in enumerate(by)]).agg(*aggregates(measures))


def beside(base: DataFrame, other: DataFrame, comparison: str, grain: str, n_groups: int) -> DataFrame:
    """base with other's columns, prefixed by the comparison; groups match null-safely, periods by date arithmetic."""
    prefix = f"__{comparison}"
    other = other.toDF(*[f"{prefix}{c}" for c in other.columns])
    at = F.col(PERIOD) if comparison == "fytd" else cal.earlier(F.col(PERIOD), *offset(comparison, grain))
    on = F.col(f"{prefix}{PERIOD}") == at
    for i in range(n_groups):
        on = on & F.col(f"__g{i}").eqNullSafe(F.col(f"{prefix}__g{i}"))
    return base.join(other, on, "left").drop(f"{prefix}{PERIOD}", *[f"{prefix}__g{i}" for i in range(n_groups)])
