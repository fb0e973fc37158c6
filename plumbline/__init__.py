"""Governed metrics on Spark: models in YAML, sliced by dimension, period and context.

The functions here work on a default workspace, found from the current folder.
"""

from __future__ import annotations

from typing import Any

from .errors import ConfigError, PlumbError, PushRefused, SchemaMismatch, SemanticsError, SourceError
from .operators.cleaners import clean, drop_empty, numeric, parse_dates, snake_names, strip_strings
from .plans.scope import Scope, all_, context, last, not_
from .session import Workspace, session
from .sources import csvfile, xlsx
from .sources.config import find_config
from .sources.frames import from_spark

__all__ = [
    "ConfigError", "PlumbError", "PushRefused", "SchemaMismatch", "Scope", "SemanticsError", "SourceError", "Workspace", "all_", "clean", "connect", "context",
    "drop_empty", "freshness", "land", "last", "mirror", "model", "not_", "numeric", "parse_dates", "pull", "push", "read_csv", "read_excel", "register", "session",
    "slice", "snake_names", "strip_strings", "use", "workspace",
]

_default: Workspace | None = None


def use(config: Any = None, **parts: Any) -> Workspace:
    """Make a workspace the default one."""
    global _default
    _default = config if isinstance(config, Workspace) else Workspace(config, **parts)
    return _default


def workspace() -> Workspace:
    return _default or use()


def connect():
    """The Spark session of the default workspace."""
    return workspace().spark


def mirror(*a: Any, **k: Any) -> Any:
    return workspace().mirror(*a, **k)


def freshness() -> Any:
    return workspace().freshness()


def pull(*a: Any, **k: Any) -> Any:
    return workspace().pull(*a, **k)


def land(*a: Any, **k: Any) -> int:
    return workspace().land(*a, **k)


def register(*a: Any, **k: Any) -> Any:
    return workspace().register(*a, **k)


def push(*a: Any, **k: Any) -> int:
    return workspace().push(*a, **k)


def _project() -> Workspace | None:
    """The default workspace; None where there is no project file at all."""
    if _default is None:
        try:
            find_config()
        except ConfigError:
            return None
    return workspace()


def _read(kind: str, path: Any, land: str | None, backend: str | None, options: dict) -> Any:
    project = _project()
    if project is not None:
        return getattr(project, kind)(path, land=land, backend=backend, **options)
    if land is not None:
        raise ConfigError("land= needs a project file, and there is none")
    spark = session()
    df = csvfile.read_csv(spark, str(path), **options) if kind == "read_csv" else spark.createDataFrame(xlsx.read_sheet(path, **options))
    return from_spark(df, backend)


def read_csv(path: Any, land: str | None = None, backend: str | None = None, **options: Any) -> Any:
    """A CSV file; without a project file too, unless land= is given."""
    return _read("read_csv", path, land, backend, options)


def read_excel(path: Any, land: str | None = None, backend: str | None = None, **options: Any) -> Any:
    """A spreadsheet; without a project file too, unless land= is given."""
    return _read("read_excel", path, land, backend, options)


def model(*a: Any, **k: Any) -> Any:
    return workspace().model(*a, **k)


def slice(*a: Any, **k: Any) -> Any:
    return workspace().slice(*a, **k)
