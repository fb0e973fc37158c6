"""YAML models: strict reading with an error for everything that is not known."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

import yaml

from ..errors import SemanticsError
from .spec import DimUse, Measure, Model, SharedDim

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
TABLE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*){0,2}")
RESERVED = ("fact", "period", "time")
CADENCES = ("daily", "weekly", "monthly")
_NOT_ADDITIVE = re.compile(r"\bdistinct\b|\bmedian\s*\(|\bmode\s*\(", re.IGNORECASE)
_MODE = re.compile(r"\bmode\s*\(\s*([^(),]+?)\s*\)", re.IGNORECASE)
_FILTERED = re.compile(r"\bfilter\s*\(\s*where\b", re.IGNORECASE)


def _fail(where: str, what: str) -> None:
    raise SemanticsError(f"{where}: {what}")


def _mapping(value: Any, where: str) -> Mapping:
    if not isinstance(value, Mapping):
        _fail(where, f"a mapping is needed, not {value!r}")
    for key in value:
        if not isinstance(key, str):
            _fail(where, f"keys are text, not {key!r} - quote it")
    return value


def _known(value: Mapping, keys: Iterable[str], where: str) -> None:
    keys = list(keys)
    for key in value:
        if key not in keys:
            near = difflib.get_close_matches(key, keys, 1)
            _fail(where, f"unknown key '{key}'" + (f" - did you mean '{near[0]}'?" if near else f" - known: {', '.join(keys)}"))


def _text(value: Any, where: str) -> str:
    if not isinstance(value, str) or not value.strip():
        _fail(where, f"text is needed, not {value!r}")
    return value.strip()


def _aggregate(value: Any, where: str) -> str:
    """SQL of an aggregate; of several most frequent values mode() takes the least, so that results repeat."""
    return _MODE.sub(r"mode(\1, true)", _text(value, where))


def _flag(value: Any, where: str) -> bool:
    if not isinstance(value, bool):
        _fail(where, f"true or false is needed, not {value!r}")
    return value


def _name(value: Any, where: str, reserved: bool = True) -> str:
    value = _text(value, where)
    if not NAME.fullmatch(value):
        _fail(where, f"'{value}' is no plain name - use letters, digits and underscores")
    if reserved and (value.lower() in RESERVED or value.startswith("__")):
        _fail(where, f"the name '{value}' is reserved - choose another")
    return value


def _table(value: Any, where: str) -> str:
    value = _text(value, where)
    if not TABLE.fullmatch(value):
        _fail(where, f"'{value}' is no table name - write schema.table")
    return value


def sum_text(spec: Mapping, where: str, outer: str | None = None) -> tuple[str, str | None]:
    """(aggregate, predicate) of the sum shorthand {sum, nulls, where}."""
    _known(spec, ("sum", "nulls", "where"), where)
    if "sum" not in spec:
        _fail(where, "the shorthand needs sum:")
    x = _text(spec["sum"], f"{where}.sum")
    if re.match(r"distinct\b", x, re.IGNORECASE):
        _fail(where, "sum: takes a row's expression without DISTINCT - write the aggregate as SQL")
    policy = spec.get("nulls", "ignore")
    if policy not in ("ignore", "propagate"):
        _fail(where, f"nulls: is ignore or propagate, not {policy!r}")
    inner = _text(spec["where"], f"{where}.where") if "where" in spec else None
    if inner and outer:
        _fail(where, "where: stands both inside and beside the shorthand - keep one")
    cond = inner or outer
    if policy == "ignore":
        return f"sum({x})", cond
    clause = f" FILTER (WHERE {cond})" if cond else ""
    return f"case when count({x}){clause} = count(*){clause} then sum({x}){clause} end", None


def _part(value: Any, where: str) -> str:
    if isinstance(value, Mapping):
        text, cond = sum_text(_mapping(value, where), where)
        return f"{text} FILTER (WHERE {cond})" if cond else text
    return _aggregate(value, where)


def _measure(name: str, spec: Any, snapshot: bool, where: str) -> Measure:
    spec = _mapping(spec, where)
    _known(spec, ("description", "expr", "ratio", "where", "time_agg", "additive"), where)
    if "description" not in spec:
        _fail(where, "a description is required")
    description = _text(spec["description"], f"{where}.description")
    if ("expr" in spec) == ("ratio" in spec):
        _fail(where, "exactly one of expr: and ratio: is needed")
    expr = cond = num = den = None
    if "expr" in spec:
        cond = _text(spec["where"], f"{where}.where") if "where" in spec else None
        if isinstance(spec["expr"], Mapping):
            expr, cond = sum_text(_mapping(spec["expr"], f"{where}.expr"), f"{where}.expr", cond)
        else:
            expr = _aggregate(spec["expr"], f"{where}.expr")
            if cond and _FILTERED.search(expr):
                _fail(where, "expr: has a FILTER of its own - fold where: into it")
    else:
        if "where" in spec:
            _fail(where, "where: does not go with ratio: - put a predicate in each part")
        ratio = _mapping(spec["ratio"], f"{where}.ratio")
        _known(ratio, ("num", "den"), f"{where}.ratio")
        if set(ratio) != {"num", "den"}:
            _fail(where, "ratio: needs num: and den:")
        num, den = (_part(ratio[k], f"{where}.ratio.{k}") for k in ("num", "den"))
    time_agg = spec.get("time_agg", "last" if snapshot else "sum")
    if time_agg not in ("sum", "last", "none"):
        _fail(where, f"time_agg: is sum, last or none, not {time_agg!r}")
    if snapshot and time_agg == "sum":
        _fail(where, "time_agg: sum does not go with a snapshot - declare the flow as a model of its own")
    declared = _flag(spec["additive"], f"{where}.additive") if "additive" in spec else True
    return Measure(name, description, expr, cond, num, den, time_agg, declared and num is None and not _NOT_ADDITIVE.search(expr or ""))


def _shared(name: str, spec: Any) -> SharedDim:
    where = f"dimensions.{name}"
    _name(name, where)
    spec = _mapping(spec, where)
    _known(spec, ("table", "key_column", "attributes", "hierarchy"), where)
    for key in ("table", "key_column", "attributes"):
        if key not in spec:
            _fail(where, f"{key}: is required")
    attributes = _mapping(spec["attributes"], f"{where}.attributes")
    if not attributes:
        _fail(where, "attributes: must not be empty")
    attributes = {_name(k, f"{where}.attributes"): _name(v, f"{where}.attributes.{k}", False) for k, v in attributes.items()}
    hierarchy = spec.get("hierarchy", [])
    if not isinstance(hierarchy, list) or not all(isinstance(h, str) and h in attributes for h in hierarchy):
        _fail(where, "hierarchy: lists declared attributes, finest first")
    return SharedDim(name, _table(spec["table"], f"{where}.table"), _name(spec["key_column"], f"{where}.key_column", False), attributes, tuple(hierarchy))


def _model(name: str, spec: Any, shared: dict[str, SharedDim], fiscal_start: int) -> Model:
    _name(name, name)
    spec = _mapping(spec, name)
    _known(spec, ("fact", "description", "time", "snapshot", "dimensions", "measures", "strict_context"), name)
    for key in ("fact", "time", "measures"):
        if key not in spec:
            _fail(name, f"{key}: is required")
    time = _mapping(spec["time"], f"{name}.time")
    _known(time, ("column", "cadence"), f"{name}.time")
    if "column" not in time:
        _fail(f"{name}.time", "column: is required")
    cadence = time.get("cadence")
    if cadence is not None and cadence not in CADENCES:
        _fail(f"{name}.time", f"cadence: is one of {', '.join(CADENCES)}, not {cadence!r}")
    snapshot = _flag(spec.get("snapshot", False), f"{name}.snapshot")
    dims: dict[str, DimUse] = {}
    for dim, use in _mapping(spec.get("dimensions") or {}, f"{name}.dimensions").items():
        where = f"{name}.dimensions.{dim}"
        _name(dim, where)
        if isinstance(use, Mapping):
            _known(use, ("shared",), where)
            if "shared" not in use:
                _fail(where, "write {shared: fact_key_column}")
            if dim not in shared:
                _fail(where, f"no shared dimension '{dim}' is declared")
            dims[dim] = DimUse(dim, _name(use["shared"], where, False), shared[dim])
        else:
            if dim in shared:
                _fail(where, f"'{dim}' is a shared dimension - write {{shared: column}} or choose another name")
            dims[dim] = DimUse(dim, _name(use, where, False))
    measures = _mapping(spec["measures"], f"{name}.measures")
    if not measures:
        _fail(name, "at least one measure is needed")
    built = {_name(m, f"{name}.measures"): _measure(m, body, snapshot, f"{name}.measures.{m}") for m, body in measures.items()}
    both = {d.lower() for d in dims} & {m.lower() for m in built}
    if both:
        _fail(name, f"'{sorted(both)[0]}' names both a dimension and a measure")
    description = _text(spec["description"], f"{name}.description") if spec.get("description") is not None else ""
    return Model(
        name, _table(spec["fact"], f"{name}.fact"), _name(time["column"], f"{name}.time.column", False), built, dims, description,
        cadence, snapshot, _flag(spec.get("strict_context", False), f"{name}.strict_context"), fiscal_start,
    )


def models_from(documents: Iterable[tuple[str, Any]], fiscal_start: int = 1) -> dict[str, Model]:
    """Models of parsed YAML documents (origin, content), which are merged."""
    if isinstance(fiscal_start, bool) or not isinstance(fiscal_start, int) or not 1 <= fiscal_start <= 12:
        raise SemanticsError(f"fiscal_year_start is a month from 1 to 12, not {fiscal_start!r}")
    dims: dict[str, Any] = {}
    models: dict[str, Any] = {}
    for origin, content in documents:
        if content is None:
            continue
        for key, body in _mapping(content, origin).items():
            for into, items in ((dims, _mapping(body or {}, f"{origin}: dimensions").items()),) if key == "dimensions" else ((models, ((key, body),)),):
                for name, value in items:
                    if name in into:
                        _fail(origin, f"'{name}' is declared twice")
                    into[name] = value
    shared = {name: _shared(name, spec) for name, spec in dims.items()}
    return {name: _model(name, spec, shared, fiscal_start) for name, spec in models.items()}


def load_models(folder: str | Path, fiscal_start: int = 1) -> dict[str, Model]:
    """Models of all *.yml and *.yaml files in folder."""
    folder = Path(folder)
    files = sorted([*folder.glob("*.yml"), *folder.glob("*.yaml")]) if folder.is_dir() else []
    if not files:
        raise SemanticsError(f"no .yml or .yaml files in {folder} - write a model there")
    parsed = []
    for path in files:
        try:
            parsed.append((path.name, yaml.safe_load(path.read_text(encoding="utf-8"))))
        except (yaml.YAMLError, UnicodeDecodeError, ValueError, RecursionError) as e:
            raise SemanticsError(f"{path.name} is no readable YAML: {e}") from e
    return models_from(parsed, fiscal_start)
