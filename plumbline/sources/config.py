"""The project file, plumbline.yaml: sources, destination, tables, push targets, models."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..errors import ConfigError

FILE = "plumbline.yaml"
#: codecs that a table may name, and what Spark's Parquet writer calls them
CODECS = {"uncompressed": "none", "snappy": "snappy", "gzip": "gzip", "zstd": "zstd", "brotli": "brotli", "lz4": "lz4", "lz4_raw": "lz4_raw"}
MODES = ("native", "parquet")
FRAMES = ("spark", "pandas", "pyarrow", "polars")
DRIVERS = {"mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "jdbc": None}


@dataclass(frozen=True)
class Source:
    """A database; passwords and DSNs come from the environment when they are needed, never from the file."""

    name: str
    driver: str = "mssql"
    server: str | None = None
    database: str | None = None
    url: str | None = None
    dsn_env: str | None = None
    trusted: bool = False
    user: str | None = None
    password_env: str | None = None
    encrypt: bool = True
    trust_server_certificate: bool = False

    def _secret(self, variable: str) -> str:
        value = os.environ.get(variable)
        if not value:
            raise ConfigError(f"source '{self.name}': the environment variable {variable} is not set")
        return value

    def connection(self) -> tuple[str, dict[str, str]]:
        """(JDBC URL, properties)."""
        properties = {"driver": DRIVERS[self.driver]} if DRIVERS[self.driver] else {}
        if self.dsn_env:
            return self._secret(self.dsn_env), properties
        if self.url:
            url = self.url
        elif self.server and self.database:
            host, _, port = self.server.replace(",", ":").partition(":")
            url = f"jdbc:sqlserver://{host}{':' + port if port else ''};databaseName={self.database};encrypt={str(self.encrypt).lower()}"
            url += ";trustServerCertificate=true" if self.trust_server_certificate else ""
        else:
            raise ConfigError(f"source '{self.name}': server and database are needed, or url, or dsn_env")
        if self.trusted:
            return f"{url};integratedSecurity=true", properties
        if self.user and self.password_env:
            return url, {**properties, "user": self.user, "password": self._secret(self.password_env)}
        if self.url and not self.user:
            return url, properties
        raise ConfigError(f"source '{self.name}': auth needs trusted: true, or user and password_env")


@dataclass(frozen=True)
class TableSpec:
    name: str
    sql: str
    schema: str = "main"
    source: str = ""
    description: str = ""
    mode: str = "native"
    compression: str = "zstd"
    level: int = 9
    batch_size: int = 100_000
    split_by: str | None = None
    bounds: tuple | None = None
    parts: int = 1

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.name}"


@dataclass(frozen=True)
class Config:
    path: Path
    sources: dict[str, Source]
    default_source: str
    store: str
    tables: tuple[TableSpec, ...]
    push_allow: tuple[str, ...] = ()
    frames: str = "spark"
    models_dir: Path = field(default_factory=Path)
    fiscal_start: int = 1


def _mapping(value: Any, where: str) -> dict:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: a mapping is needed, not {value!r}")
    return value


def _choice(value: Any, allowed, where: str) -> str:
    value = str(value).lower()
    if value not in allowed:
        raise ConfigError(f"{where}: '{value}' is not one of {', '.join(allowed)}")
    return value


def _count(value: Any, where: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ConfigError(f"{where}: a whole number of 1 or more is needed, not {value!r}")
    return value


def _source(name: str, raw: Any) -> Source:
    raw = _mapping(raw, f"sources.{name}")
    auth = _mapping(raw.get("auth"), f"sources.{name}.auth")
    driver = _choice(raw.get("driver", "mssql"), DRIVERS, f"sources.{name}.driver")
    return Source(
        name, driver, raw.get("server"), raw.get("database"), raw.get("url"), raw.get("dsn_env"), bool(auth.get("trusted", False)), auth.get("user"), auth.get("password_env"),
        bool(raw.get("encrypt", True)), bool(raw.get("trust_server_certificate", False)),
    )


def _table(raw: Any, number: int, defaults: dict, default_source: str, sources: dict) -> TableSpec:
    raw = _mapping(raw, f"tables[{number}]")
    name = raw.get("name")
    if not isinstance(name, str) or not name:
        raise ConfigError(f"tables[{number}]: a name is needed")
    where = f"table '{name}'"
    src = _mapping(raw.get("source"), where)
    parts = [src.get(k) for k in ("database", "schema", "table")]
    if bool(src.get("query")) == any(parts) or any(parts) and not all(parts):
        raise ConfigError(f"{where}: give either a query, or database, schema and table")
    sql = str(src["query"]).strip() if src.get("query") else "SELECT * FROM {}.{}.{}".format(*[f"[{p}]" for p in parts])
    connection = src.get("connection", default_source)
    if connection not in sources:
        raise ConfigError(f"{where}: no source '{connection}' is declared")
    extract = _mapping(raw.get("extract"), where)
    split_by, bounds = extract.get("split_by"), extract.get("bounds")
    if (split_by is None) != (bounds is None) or bounds is not None and (not isinstance(bounds, list) or len(bounds) != 2):
        raise ConfigError(f"{where}.extract: split_by names a column, bounds its least and greatest value - give both or neither")
    return TableSpec(
        name, sql, str(raw.get("schema", defaults.get("schema", "main"))), connection, str(raw.get("description") or ""),
        _choice(raw.get("mode", defaults.get("mode", "native")), MODES, f"{where}.mode"),
        _choice(raw.get("compression", defaults.get("compression", "zstd")), CODECS, f"{where}.compression"),
        _count(raw.get("compression_level", defaults.get("compression_level", 9)), f"{where}.compression_level"),
        _count(extract.get("batch_size", defaults.get("batch_size", 100_000)), f"{where}.batch_size"),
        split_by, tuple(map(str, bounds)) if bounds else None, _count(extract.get("parts", 8 if split_by else 1), f"{where}.parts"),
    )


def load_config(path: str | Path) -> Config:
    path = Path(path).resolve()
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"{path} cannot be read: {e}") from e
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path} is no valid YAML: {e}") from e
    raw = _mapping(raw, str(path))
    sources = {str(n): _source(str(n), s) for n, s in _mapping(raw.get("sources"), "sources").items()}
    if not sources:
        raise ConfigError("sources: at least one is needed")
    destination = _mapping(raw.get("destination"), "destination")
    if not destination.get("path"):
        raise ConfigError("destination.path is needed")
    store = str(destination["path"])
    store = store if "://" in store else str((path.parent / store).resolve())
    defaults = _mapping(raw.get("defaults"), "defaults")
    frames = _choice(defaults.get("frames", "spark"), FRAMES, "defaults.frames")
    allow = _mapping(raw.get("push"), "push").get("allow") or []
    for entry in allow:
        if not isinstance(entry, str) or len(entry.split(".")) != 2 or not all(entry.split(".")):
            raise ConfigError(f"push.allow: '{entry}' is no Database.schema")
    first = next(iter(sources))
    tables = tuple(_table(t, i, defaults, first, sources) for i, t in enumerate(raw.get("tables") or []))
    if not tables:
        raise ConfigError("tables: at least one is needed")
    names = [t.qualified.lower() for t in tables]
    for n in names:
        if names.count(n) > 1:
            raise ConfigError(f"table {n} is declared twice")
    semantics = _mapping(raw.get("semantics"), "semantics")
    start = semantics.get("fiscal_year_start", 1)
    if isinstance(start, bool) or not isinstance(start, int) or not 1 <= start <= 12:
        raise ConfigError(f"semantics.fiscal_year_start is a month from 1 to 12, not {start!r}")
    return Config(path, sources, first, store, tables, tuple(allow), frames, (path.parent / semantics.get("dir", "semantics")).resolve(), start)


def find_config(start: str | Path | None = None) -> Path:
    """The project file of the folder or the nearest one above it."""
    here = Path(start or Path.cwd()).resolve()
    for folder in (here, *here.parents):
        if (folder / FILE).is_file():
            return folder / FILE
    raise ConfigError(f"there is no {FILE} in {here} or above it - write one, or pass its path")
