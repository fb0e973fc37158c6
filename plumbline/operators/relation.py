"""One lane of a slice: window, as-at selection, dimensions, context, grouped aggregate - in this order.

The order is the meaning.  The window and the as-at moment come before any
attribute filter, so a filter can never move the census that is read; a
measure's own predicate stays inside its aggregate, apart from the context.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..plans.scope import All, Between, Eq, In, Not
from ..plans.spec import DimUse, Measure, Model

PERIOD, CELL = "__period", "__cell"


@dataclass(frozen=True)
class Window:
    """lo <= time < high."""

    lo: date | datetime
    high: date | datetime

    @classmethod
    def of(cls, condition: Any) -> Window | None:
        """None for no restriction.  A date as upper end means its whole day, a datetime its own microsecond."""
        if not isinstance(condition, Between):
            return None
        step = timedelta(microseconds=1) if isinstance(condition.hi, datetime) else timedelta(days=1)
        return cls(condition.lo, condition.hi + step)

    def earlier(self, months: int, days: int) -> Window:
        return Window(cal.earlier_edge(self.lo, months, days, end=False), cal.earlier_edge(self.high, months, days, end=True))


@dataclass(frozen=True)
class By:
    """A column to group by: a fact column, or an attribute of a shared dimension."""

    alias: str
    dim: DimUse
    attribute: str | None = None

    @property
    def column(self) -> str:
        return attribute_column(self.dim, self.attribute)


@dataclass(frozen=True)
class AttributeFilter:
    key: str
    dim: DimUse
    attribute: str | None
    condition: Any


def attribute_column(dim: DimUse, attribute: str | None) -> str:
    return f"__d_{dim.name}_{attribute}" if dim.shared else dim.column


def bound(value: date | datetime) -> Column:
    """A literal without a time zone, so that the comparison reaches the scan."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


def in_window(frame: DataFrame, column: str, window: Window | None) -> DataFrame:
    if window is None:
        return frame
    c = F.col(f"`{column}`")
    return frame.where((c >= bound(window.lo)) & (c < bound(window.high)))


def predicate(column: str, condition: Any) -> Column | None:
    c = F.col(f"`{column}`")
    lit = lambda v: F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz") if isinstance(v, datetime) else F.lit(v)
    if isinstance(condition, All):
        return None
    if isinstance(condition, Eq):
        return c == lit(condition.value)
    if isinstance(condition, In):
        return c.isin(*[lit(v) for v in condition.values])
    if isinstance(condition, Not):
        return ~c.eqNullSafe(lit(condition.value))
    if isinstance(condition, Between):
        return c.between(lit(condition.lo), lit(condition.hi))
    raise TypeError(f"no predicate for {condition!r}")


def as_at_moments(windowed: DataFrame, model: Model, grain: str | None) -> DataFrame:
    """The last census of each period, or of all rows without a grain."""
    keys = [cal.period_of(grain, F.col(f"`{model.time_column}`"), model.fiscal_start).alias(PERIOD)] if grain else []
    return windowed.groupBy(*keys).agg(F.max(f"`{model.time_column}`").alias("__as_at"))


def as_at_rows(windowed: DataFrame, model: Model, grain: str | None) -> DataFrame:
    """The rows of the last census of each period.  The moments are broadcast: a calendar bounds them, one a period."""
    moments = as_at_moments(windowed, model, grain)
    return windowed.join(F.broadcast(moments.select("__as_at")), windowed[model.time_column] == F.col("__as_at"), "left_semi")


def with_dims(frame: DataFrame, model: Model, used: dict[str, set[str]], read: Callable[[str], DataFrame]) -> DataFrame:
    """Left joins with the used dimensions, in the order of declaration; attributes get names that no measure can mean."""
    for dim in model.dims.values():
        if dim.shared is None or dim.name not in used:
            continue
        key = f"__k_{dim.name}"
        side = read(dim.shared.table).select(
            F.col(f"`{dim.shared.key}`").alias(key),
            *[F.col(f"`{dim.shared.attributes[a]}`").alias(attribute_column(dim, a)) for a in sorted(used[dim.name])],
        )
        frame = frame.join(side, F.col(f"`{dim.column}`") == F.col(key), "left").drop(key)
    return frame


def used_attributes(by: list[By], filters: list[AttributeFilter]) -> dict[str, set[str]]:
    used: dict[str, set[str]] = {}
    for x in [*by, *[f for f in filters if not isinstance(f.condition, All)]]:
        if x.dim.shared:
            used.setdefault(x.dim.name, set()).add(x.attribute)
    return used


def with_filters(frame: DataFrame, filters: list[AttributeFilter]) -> DataFrame:
    for f in filters:
        p = predicate(attribute_column(f.dim, f.attribute), f.condition)
        if p is not None:
            frame = frame.where(p)
    return frame


def aggregates(measures: list[Measure]) -> list[Column]:
    out = []
    for i, m in enumerate(measures):
        if m.is_ratio:
            out += [F.expr(m.num).alias(f"__n{i}"), F.expr(m.den).alias(f"__d{i}")]
        else:
            out.append(F.expr(m.text).alias(f"__v{i}"))
    return [*out, F.count(F.lit(1)).alias(CELL)]


def group_columns(model: Model, by: list[By], grain: str | None) -> list[Column]:
    period = [cal.period_of(grain, F.col(f"`{model.time_column}`"), model.fiscal_start).alias(PERIOD)] if grain else []
    return [*period, *[F.col(f"`{b.column}`").alias(f"__g{i}") for i, b in enumerate(by)]]


def selected_rows(model: Model, by: list[By], filters: list[AttributeFilter], window: Window | None, grain: str | None, read: Callable[[str], DataFrame]) -> DataFrame:
    rows = in_window(read(model.fact), model.time_column, window)
    if model.snapshot:
        rows = as_at_rows(rows, model, grain)
    return with_filters(with_dims(rows, model, used_attributes(by, filters), read), filters)


def lane(model: Model, measures: list[Measure], by: list[By], filters: list[AttributeFilter], window: Window | None, grain: str | None, read: Callable[[str], DataFrame]) -> DataFrame:
    """[__period], __g0.., then __v, or __n and __d, of each measure, and __cell (rows of the group)."""
    rows = selected_rows(model, by, filters, window, grain, read)
    return rows.groupBy(*group_columns(model, by, grain)).agg(*aggregates(measures))
