"""What happens to finished lanes: ratios, suppression, complete periods, names and order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..plans.spec import Measure, Model
from .relation import CELL, PERIOD, By, Window, bound

#: Days by which the last expected census may precede the end of its period.
CADENCE_DAYS = {"daily": 1, "weekly": 7, "monthly": 31}


def only_complete(frame: DataFrame, model: Model, window: Window | None, grain: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """Rows of periods that the data cover to the end and that the window does not cut."""
    tc = f"`{model.time_column}`"
    end = cal.last_day_of(grain, F.col(PERIOD))
    if model.snapshot and model.cadence:
        newest = read(model.fact).groupBy(cal.period_of(grain, F.col(tc), model.fiscal_start).alias("__of")).agg(F.max(tc).alias("__newest"))
        # one row a period, which a calendar bounds
        frame = frame.join(F.broadcast(newest), F.col(PERIOD) == F.col("__of"), "left")
        frame = frame.where(F.col("__newest") > F.date_sub(end, CADENCE_DAYS[model.cadence])).drop("__of", "__newest")
    else:
        frame = frame.where(end <= read(model.fact).select(F.max(tc)).scalar())
    return frame.where(end < bound(window.high)) if window else frame


def _guarded(value: Column, cell: Column, least: int | None, den: Column | None = None) -> Column:
    if least is None:
        return value
    small = cell < least
    return F.when(small if den is None else small | (den < least), None).otherwise(value)


def values(measures: list[Measure], comparisons: list[str], least: int | None, parts: bool = False) -> list[Column]:
    """The output columns of all measures, each followed by its comparisons; parts: with ratios' components."""
    out, hidden = [], []
    for i, m in enumerate(measures):
        for c in ("", *comparisons):
            prefix, name = f"__{c}" if c else "", f"{m.name}_{c}" if c else m.name
            cell = F.col(f"{prefix}{CELL}")
            if m.is_ratio:
                num, den = F.col(f"{prefix}__n{i}"), F.col(f"{prefix}__d{i}")
                value = F.when(den != 0, num.cast("double") / den)
                out.append(_guarded(value, cell, least, den).alias(name))
                hidden += [_guarded(x, cell, least, den).alias(f"__explain_{name}_{part}") for x, part in ((num, "num"), (den, "den"))]
            else:
                out.append(_guarded(F.col(f"{prefix}__v{i}"), cell, least).alias(name))
    return out + hidden if parts else out


def finished(frame: DataFrame, model: Model, measures: list[Measure], by: list[By], comparisons: list[str], window: Window | None, grain: str | None, complete: bool, least: int | None, read: Callable[[str], DataFrame], parts: bool = False) -> DataFrame:
    if complete:
        frame = only_complete(frame, model, window, grain, read)
    keys = ([F.col(PERIOD).alias("period")] if grain else []) + [F.col(f"__g{i}").alias(b.alias) for i, b in enumerate(by)]
    out = frame.select(*keys, *values(measures, comparisons, least, parts))
    return out.orderBy(F.col("period").asc_nulls_last()) if grain else out
