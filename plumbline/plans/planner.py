"""From a request against a model to a plan; everything that can be wrong is said before a job runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SemanticsError
from ..functions.calendar import check_grain
from ..operators import finish, lanes
from ..operators.relation import AttributeFilter, By, Window, attribute_column, lane, used_attributes, with_dims, with_filters, in_window
from .scope import All, Between, Scope
from .spec import DimUse, Measure, Model


@dataclass(frozen=True)
class Request:
    measures: tuple[str, ...]
    by: tuple[str, ...] = ()
    scope: Scope = field(default_factory=Scope)
    grain: str | None = None
    compare: tuple[str, ...] = ()
    complete_periods: bool = False
    strict: bool = False
    suppress: int | None = None


@dataclass(frozen=True)
class Split:
    """A scope as a model sees it."""

    window: Window | None
    filters: tuple[AttributeFilter, ...]
    applied: tuple[str, ...]
    ignored: tuple[str, ...]
    unfiltered: tuple[str, ...]


def _names(value: Any, what: str) -> tuple[str, ...]:
    value = (value,) if isinstance(value, str) else tuple(value or ())
    if not all(isinstance(v, str) for v in value):
        raise SemanticsError(f"{what} takes names")
    return value


def split_scope(model: Model, scope: Scope, strict: bool) -> Split:
    window, filters, applied, ignored, unfiltered = None, [], [], [], []
    for key, condition in scope.items():
        if key == "time":
            if not isinstance(condition, (All, Between)):
                raise SemanticsError("resolve the context before it is applied")
            window = Window.of(condition)
        else:
            name, _, attribute = (key, "", "") if key in model.dims else key.partition("__")
            dim = model.dims.get(name)
            if dim is None or dim.shared is None and attribute:
                ignored.append(key)
                continue
            if dim.shared is not None:
                if not attribute:
                    raise SemanticsError(f"'{name}' is a shared dimension - write {name}__attribute with one of {', '.join(dim.shared.attributes)}")
                if attribute not in dim.shared.attributes:
                    raise SemanticsError(f"dimension '{name}' has no attribute '{attribute}' - it has {', '.join(dim.shared.attributes)}")
            filters.append(AttributeFilter(key, dim, attribute or None, condition))
        applied.append(key)
        if isinstance(condition, All):
            unfiltered.append(key)
    if strict and ignored:
        raise SemanticsError(f"context entries do not apply to '{model.name}': {', '.join(ignored)} - remove them, or pass strict_context=False")
    return Split(window, tuple(filters), tuple(applied), tuple(ignored), tuple(unfiltered))


def by_column(model: Model, entry: str) -> By:
    if entry == "time" or entry.startswith("time."):
        raise SemanticsError("time does not go into by= - use grain=")
    name, dot, attribute = entry.partition(".")
    dim: DimUse | None = model.dims.get(name)
    if dim is None:
        raise SemanticsError(f"model '{model.name}' has no dimension '{name}' - it has {', '.join(model.dims) or 'none'}")
    if dim.shared is None:
        if dot:
            raise SemanticsError(f"'{name}' is a column of the fact, without attributes - write '{name}'")
        return By(name, dim)
    if not attribute:
        raise SemanticsError(f"'{name}' is a shared dimension - write '{name}.attribute' with one of {', '.join(dim.shared.attributes)}")
    if attribute not in dim.shared.attributes:
        raise SemanticsError(f"dimension '{name}' has no attribute '{attribute}' - it has {', '.join(dim.shared.attributes)}")
    return By(f"{name}.{attribute}", dim, attribute)


def check_request(model: Model, request: Request) -> list[Measure]:
    """The measures asked for, once all guards have passed."""
    if not request.measures:
        raise SemanticsError(f"name at least one measure of {', '.join(model.measures)}")
    for name in request.measures:
        if name not in model.measures:
            raise SemanticsError(f"model '{model.name}' has no measure '{name}' - it has {', '.join(model.measures)}")
    if request.grain is not None:
        check_grain(request.grain)
    elif request.complete_periods:
        raise SemanticsError("complete_periods needs grain=")
    if request.suppress is not None and (isinstance(request.suppress, bool) or not isinstance(request.suppress, int) or request.suppress < 1):
        raise SemanticsError(f"suppress takes a whole number of 1 or more, not {request.suppress!r}")
    measures = [model.measures[n] for n in request.measures]
    _check_compare(model, request, measures)
    seen: dict[str, str] = {}
    columns = (["period"] if request.grain else []) + [by_column(model, b).alias for b in request.by]
    columns += [n for m in measures for n in (m.name, *[f"{m.name}_{c}" for c in request.compare])]
    for c in columns:
        if c.lower() in seen:
            raise SemanticsError(f"two output columns are called '{c}' - names differ by more than case")
        seen[c.lower()] = c
    return measures


def _check_compare(model: Model, request: Request, measures: Sequence[Measure]) -> None:
    compare = request.compare
    if not compare:
        return
    if request.grain is None:
        raise SemanticsError("compare= needs grain=")
    for c in compare:
        if c not in lanes.COMPARISONS:
            raise SemanticsError(f"unknown comparison '{c}' - use {', '.join(lanes.COMPARISONS)}")
    if len(set(compare)) < len(compare):
        raise SemanticsError("compare= names a comparison twice")
    if "yoy" in compare and request.grain == "week":
        raise SemanticsError("a year earlier is no week start - use yoy with another grain")
    for m in measures:
        if m.time_agg == "none":
            raise SemanticsError(f"measure '{m.name}' has time_agg none and takes no comparison")
        if m.time_agg == "last" and "fytd" in compare:
            raise SemanticsError(f"measure '{m.name}' is a stock and does not add up over a year - declare the flow as a model of its own")
        for c in compare:
            if f"{m.name}_{c}" in model.measures:
                raise SemanticsError(f"the column '{m.name}_{c}' would hide the measure of that name")


def plan(model: Model, request: Request, split: Split, read: Callable[[str], DataFrame], parts: bool = False) -> DataFrame:
    """The lazy result of a checked request."""
    measures = check_request(model, request)
    by = [by_column(model, b) for b in request.by]
    filters, window, grain = list(split.filters), split.window, request.grain
    base = lane(model, measures, by, filters, window, grain, read)
    frame = base
    for c in request.compare:
        if c == "fytd":
            other = lanes.fiscal_to_date(model, measures, by, filters, window, grain, read)
        else:
            other = lanes.shifted(model, measures, by, filters, window, grain, c, read)
        frame = lanes.beside(frame, other, c, grain, len(by))
    return finish.finished(frame, model, measures, by, list(request.compare), window, grain, request.complete_periods, request.suppress, read, parts)


def distinct_values(model: Model, attribute: str, scope: Scope, strict: bool, read: Callable[[str], DataFrame]) -> DataFrame:
    """The known values of an attribute, sorted: of the dimension's table, or within a scope of the facts in it (as-at aside)."""
    target = by_column(model, attribute)
    split = split_scope(model, scope, strict)
    scoped = split.window is not None or any(not isinstance(f.condition, All) for f in split.filters)
    if target.dim.shared and not scoped:
        rows = read(target.dim.shared.table).select(F.col(f"`{target.dim.shared.attributes[target.attribute]}`").alias("value"))
    else:
        rows = in_window(read(model.fact), model.time_column, split.window)
        rows = with_filters(with_dims(rows, model, used_attributes([target], list(split.filters)), read), list(split.filters))
        rows = rows.select(F.col(f"`{attribute_column(target.dim, target.attribute)}`").alias("value"))
    return rows.where(F.col("value").isNotNull()).distinct().orderBy("value")
