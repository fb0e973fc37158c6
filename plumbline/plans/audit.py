"""Provenance: what was computed, by which definitions, from which data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import lanes
from ..operators.relation import PERIOD, Window, as_at_moments, in_window
from .bind import definition, parse
from .planner import Request, Split, by_column
from .spec import Measure, Model

#: What of a parse tree's node carries meaning; positions, ids and spacing do not.
_MEANING = ("nameParts", "value", "dataType", "isDistinct", "evalMode", "multipartIdentifier", "name", "num-children", "ignoreNulls")


def _digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


def tree(spark: SparkSession, text: str | None) -> list | None:
    """The meaning of an SQL text: the same for other spacing and case of names, another for other literals or casts."""
    if text is None:
        return None
    out = []
    for node in parse(spark, text):
        kept = {k: node[k] for k in _MEANING if k in node}
        for k in ("nameParts", "multipartIdentifier"):
            if k in kept:
                kept[k] = str(kept[k]).lower()
        if "name" in kept and node["class"].endswith("UnresolvedAttribute"):
            kept["name"] = str(kept["name"]).lower()
        if node["class"].endswith("UnresolvedAlias"):
            continue
        out.append([node["class"].rpartition(".")[2], kept])
    return out


def measure_hash(spark: SparkSession, model: Model, measure: Measure) -> str:
    """Changes with what a measure computes, not with its description."""
    return _digest([tree(spark, x) for x in (measure.expr, measure.where, measure.num, measure.den)] + [measure.time_agg, model.fact.lower()])


def model_hash(model: Model) -> str:
    dims = [[d.name, d.column, d.shared and [d.shared.table, d.shared.key, sorted(d.shared.attributes.items())]] for d in sorted(model.dims.values(), key=lambda d: d.name)]
    return _digest([model.fact, model.snapshot, model.time_column, model.cadence, model.fiscal_start, dims])


@dataclass
class Provenance:
    model: str
    model_hash: str
    measures: list[dict]
    non_additive: list[str]
    context: dict
    applied: list[str]
    ignored: list[str]
    unfiltered: list[str]
    strictness_weakened: bool
    shape: dict
    data: dict = field(default_factory=dict)

    def to_dict(self) -> dict:
        return json.loads(json.dumps(self.__dict__, default=lambda v: v.isoformat() if isinstance(v, date) else str(v)))

    def render(self) -> str:
        lines = [f"model {self.model} ({self.model_hash[:12]})"]
        lines += [f"  {m['name']}: {m['definition']} ({m['hash'][:12]})" for m in self.measures]
        if self.non_additive:
            lines.append(f"do not add up: {', '.join(self.non_additive)}")
        lines.append("applied: " + (", ".join(f"{k}={json.dumps(self.context.get(k), default=str)}" for k in self.applied) or "nothing"))
        if self.ignored:
            lines.append(f"not applicable here: {', '.join(self.ignored)}")
        if self.unfiltered:
            lines.append(f"expressly unfiltered: {', '.join(self.unfiltered)}")
        if self.strictness_weakened:
            lines.append("the model's strict context was switched off for this slice")
        lines += [f"{k}: {json.dumps(v, default=str)}" for k, v in {**self.shape, **self.data}.items() if v not in (None, [], {}, False)]
        return "\n".join(lines)


def describe(spark: SparkSession, model: Model, request: Request, split: Split, context: dict) -> Provenance:
    """All that is known without running anything."""
    chosen = [model.measures[n] for n in request.measures]
    shape = {"by": list(request.by), "grain": request.grain, "compare": list(request.compare), "complete_periods": request.complete_periods, "suppress": request.suppress}
    return Provenance(
        model.name, model_hash(model), [{"name": m.name, "definition": definition(m), "hash": measure_hash(spark, model, m)} for m in chosen],
        [m.name for m in chosen if not m.additive], context, list(split.applied), list(split.ignored), list(split.unfiltered),
        model.strict and not request.strict, shape,
    )


def _day(value: Any) -> Any:
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def capture(spark: SparkSession, model: Model, request: Request, split: Split, read: Callable[[str], DataFrame], stamp: Callable[[str], Any]) -> dict:
    """Facts about the data of this execution: schemas, refresh stamps, coverage of each lane, as-at moments."""
    fact = read(model.fact)
    used = [by_column(model, b).dim for b in request.by] + [f.dim for f in split.filters]
    tables = [model.fact, *sorted({d.shared.table for d in used if d.shared})]
    lo, hi = fact.agg(F.min(f"`{model.time_column}`"), F.max(f"`{model.time_column}`")).first()
    windows: dict[str, Window | None] = {"base": split.window}
    for c in request.compare:
        if c != "fytd":
            windows[c] = split.window.earlier(*lanes.offset(c, request.grain)) if split.window else None
        elif split.window:
            windows[c] = Window(cal.period_start("fy", split.window.lo, model.fiscal_start), split.window.high)
        else:
            windows[c] = None
    first = lo.date() if isinstance(lo, datetime) else lo
    scans = {}
    for name, w in windows.items():
        if w is None:
            scans[name] = {"state": "unbounded"}
            continue
        if first is None:
            scans[name] = {"from": _day(w.lo), "before": _day(w.high), "state": "no data"}
            continue
        begin = w.lo.date() if isinstance(w.lo, datetime) else w.lo
        scans[name] = {"from": _day(w.lo), "before": _day(w.high), "state": "covered" if begin >= first else "partly before the data begin"}
    as_at = {}
    if model.snapshot:
        for name, w in windows.items():
            # one row a period, which a calendar bounds
            rows = as_at_moments(in_window(fact, model.time_column, w), model, request.grain).where("__as_at is not null").collect()
            as_at[name] = sorted(([_day(r[PERIOD]) if request.grain else None, _day(r["__as_at"])] for r in rows), key=str)
    cut = bool(split.window and request.grain and cal.period_end(request.grain, _last(split.window), model.fiscal_start) > _last(split.window))
    return {
        "engine": f"Spark {spark.version}", "tables": {t: [f"{c} {k}" for c, k in read(t).dtypes] for t in tables}, "refreshed": {t: _day(stamp(t)) for t in tables},
        "data_from": _day(lo), "data_to": _day(hi), "scans": scans, "as_at": as_at, "last_period_cut": cut,
    }


def _last(window: Window) -> date:
    from datetime import timedelta

    high = window.high
    return (high - timedelta(microseconds=1)).date() if isinstance(high, datetime) else high - timedelta(days=1)
