"""Bound models and slices: the query interface."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SemanticsError
from ..sources.frames import from_spark
from . import audit, bind
from .planner import Request, _names, check_request, distinct_values, plan, split_scope
from .scope import Scope, context
from .spec import Model


@dataclass(frozen=True)
class Explanation:
    """Result rows, and for each row the numerators and denominators of its ratios by output column."""

    rows: list[dict]
    numerators: list[dict]
    denominators: list[dict]
    provenance: audit.Provenance


class Slice:
    """A lazy result.  Mistakes in the request have been raised when it exists."""

    def __init__(self, model: BoundModel, request: Request):
        self._model, self._request = model, request
        check_request(model.model, request)
        self._scope = request.scope.resolve(model.newest)
        self._split = split_scope(model.model, self._scope, request.strict)
        self._captured: dict | None = None
        self.df: DataFrame = plan(model.model, replace(request, scope=self._scope), self._split, model.read)

    @property
    def applied(self) -> tuple[str, ...]:
        return self._split.applied

    @property
    def ignored(self) -> tuple[str, ...]:
        return self._split.ignored

    @property
    def plan_text(self) -> str:
        """The optimised logical plan."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()

    def frame(self, backend: str | None = None) -> Any:
        """The result: a Spark DataFrame, or converted for pandas, pyarrow or polars."""
        self._capture()
        return from_spark(self.df, backend)

    def view(self, name: str) -> DataFrame:
        """Register the result as a temporary view."""
        self.df.createOrReplaceTempView(name)
        return self.df

    def suppress(self, n: int = 5) -> Slice:
        """A new slice whose cells of fewer than n rows are NULL."""
        return Slice(self._model, replace(self._request, suppress=n))

    def explain(self) -> Explanation:
        """Rows with the parts of their ratios, from one execution."""
        m = self._model
        found = [r.asDict() for r in plan(m.model, replace(self._request, scope=self._scope), self._split, m.read, parts=True).collect()]
        mark = "__explain_"
        rows = [{k: v for k, v in r.items() if not k.startswith(mark)} for r in found]
        part = lambda end: [{k[len(mark) : -len(end)]: v for k, v in r.items() if k.startswith(mark) and k.endswith(end)} for r in found]
        return Explanation(rows, part("_num"), part("_den"), self.provenance())

    def _capture(self) -> dict:
        if self._captured is None:
            m = self._model
            self._captured = audit.capture(m.spark, m.model, self._request, self._split, m.read, m.stamp)
        return self._captured

    def provenance(self) -> audit.Provenance:
        out = audit.describe(self._model.spark, self._model.model, self._request, self._split, self._scope.to_dict())
        out.data = self._capture()
        return out


class BoundModel:
    """A model whose tables have been checked."""

    def __init__(self, spark: SparkSession, model: Model, read: Callable[[str], DataFrame] | None = None, stamp: Callable[[str], Any] | None = None, check: bool = True):
        self.spark, self.model = spark, model
        self.read = read or spark.table
        self.stamp = stamp or (lambda table: None)
        self.warnings = bind.check_model(spark, model, self.read) if check else []
        if check:
            self._check_widest()

    def _check_widest(self) -> None:
        """Analyse the widest slice: every measure by every attribute.  What does not fit together is said when the model is bound."""
        by = tuple(x for d in self.model.dims.values() for x in ([f"{d.name}.{a}" for a in d.shared.attributes] if d.shared else [d.name]))
        request = Request(tuple(self.model.measures), by, grain="month")
        try:
            plan(self.model, request, split_scope(self.model, Scope(), False), self.read).schema
        except PySparkException as e:
            raise SemanticsError(f"{self.model.name}: its widest slice cannot be planned - {str(e).splitlines()[0]}") from e

    def newest(self) -> Any:
        return self.read(self.model.fact).agg(F.max(f"`{self.model.time_column}`")).first()[0]

    def _strict(self, strict_context: bool | None) -> bool:
        return self.model.strict if strict_context is None else strict_context

    def slice(
        self,
        measures: str | Sequence[str],
        by: str | Sequence[str] = (),
        context: Scope | dict | None = None,
        grain: str | None = None,
        strict_context: bool | None = None,
        compare: str | Sequence[str] = (),
        complete_periods: bool = False,
    ) -> Slice:
        return Slice(self, Request(_names(measures, "measures"), _names(by, "by="), _as_scope(context), grain, _names(compare, "compare="), complete_periods, self._strict(strict_context)))

    def values_frame(self, attribute: str, context: Scope | dict | None = None, strict_context: bool | None = None) -> DataFrame:
        return distinct_values(self.model, attribute, _as_scope(context).resolve(self.newest), self._strict(strict_context), self.read)

    def values(self, attribute: str, context: Scope | dict | None = None) -> list:
        """An attribute's values, sorted."""
        return [r["value"] for r in self.values_frame(attribute, context).collect()]

    def filter_dim(self, attribute: str, context: Scope | dict | None = None, label: str | None = None) -> Choice:
        """The choice among an attribute's values, for a context."""
        return Choice(label or attribute, {str(v): v for v in self.values(attribute, context)})

    def filter_date(self, label: str | None = None) -> DateRange:
        """The choice among the fact's days, for time= of a context."""
        first, last = self.date_range()
        if first is None:
            raise SemanticsError(f"{self.model.fact} has no {self.model.time_column} to choose from")
        return DateRange(label or self.model.time_column, first, last)

    def date_range(self) -> tuple[Any, Any]:
        """First and last day of the fact, as a date widget needs them."""
        c = F.to_date(f"`{self.model.time_column}`")
        return tuple(self.read(self.model.fact).agg(F.min(c), F.max(c)).first())


@dataclass
class Choice:
    """The options of an attribute, by what is shown; value: those chosen, none for unfiltered.  A context takes it as it is."""

    label: str
    options: dict[str, Any]
    value: list = field(default_factory=list)


@dataclass
class DateRange:
    """The days of the data; value: the range chosen, all of it at first."""

    label: str
    start: Any
    stop: Any
    value: tuple = ()

    def __post_init__(self):
        self.value = self.value or (self.start, self.stop)


def _as_scope(value: Scope | dict | None) -> Scope:
    return value if isinstance(value, Scope) else context(value)
