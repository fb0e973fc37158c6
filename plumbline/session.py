"""The workspace: one Spark session, one project file, and the verbs on them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import PlumbError
from .plans.modelload import load_models
from .plans.slices import BoundModel, Slice
from .sources import csvfile, jdbc, push, xlsx
from .sources.config import Config, find_config, load_config
from .sources.frames import from_spark, to_spark
from .sources.store import Store
from .streaming.land import check_landing, land_batches

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",  # "Cat 3" in a measure names a column
    "spark.sql.adaptive.enabled": "true",
}


def session(**settings: str) -> SparkSession:
    """The active session, or a new one; either way with this library's settings."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    for k, v in {**SETTINGS, **settings}.items():
        spark.conf.set(k, v)
    return spark


class Workspace:
    def __init__(self, config: Config | str | Path | None = None, spark: SparkSession | None = None, extract: Callable[..., Any] | None = None, connect: Callable[[str], Any] | None = None):
        """extract: stands in for reading a table spec over JDBC.  connect: gives a DB-API connection to push to."""
        self.config = config if isinstance(config, Config) else load_config(config or find_config())
        self.spark = spark or session()
        self.store = Store(self.spark, self.config.store)
        self._extract = extract or (lambda spec: jdbc.read_query(self.spark, self.config.sources[spec.source], spec.sql, spec.batch_size, spec.split_by, spec.bounds, spec.parts))
        self._connect = connect
        self._models: tuple[tuple, dict] | None = None
        self._bound: dict[tuple, BoundModel] = {}

    # ---- data in

    def mirror(self, only: Iterable[str] | None = None, keep_staging: bool = False) -> dict[str, Any]:
        """Build and publish a new version of the mirrored tables."""
        out = self.store.build(self.config.tables, self._extract, only, keep_staging)
        self.store.register()
        self._bound.clear()
        return out

    def freshness(self) -> DataFrame:
        return self.store.freshness()

    def table(self, name: str) -> DataFrame:
        """A mirrored table, or else one of the session's catalog."""
        entry = self.store.manifest()["tables"].get(name if "." in name else f"main.{name}")
        return self.spark.read.parquet(entry["path"]) if entry else self.spark.table(name)

    def pull(self, sql: str, source: str | None = None, backend: str | None = None, **how: Any) -> Any:
        """The rows of a query on a source."""
        return from_spark(jdbc.read_query(self.spark, self._source(source), sql, **how), backend or self.config.frames)

    def land(self, sql: str, table: str, source: str | None = None, **how: Any) -> int:
        """Replace a catalog table by the rows of a query; returns how many there are."""
        return self._save(jdbc.read_query(self.spark, self._source(source), sql, **how), table)

    def land_stream(self, batches: Any, table: str) -> int:
        return land_batches(self.spark, batches, table)

    def register(self, frame: Any, name: str) -> DataFrame:
        df = to_spark(self.spark, frame)
        df.createOrReplaceTempView(name)
        return df

    def read_csv(self, path: str, land: str | None = None, backend: str | None = None, **options: Any) -> Any:
        df = csvfile.read_csv(self.spark, str(path), **options)
        return self._save(df, land) if land else from_spark(df, backend or self.config.frames)

    def read_excel(self, path: str, land: str | None = None, backend: str | None = None, **options: Any) -> Any:
        df = self.spark.createDataFrame(xlsx.read_sheet(path, **options))
        return self._save(df, land) if land else from_spark(df, backend or self.config.frames)

    def _save(self, df: DataFrame, table: str) -> int:
        df.write.mode("overwrite").saveAsTable(check_landing(table))
        return self.spark.table(table).count()

    def _source(self, name: str | None):
        name = name or self.config.default_source
        if name not in self.config.sources:
            raise PlumbError(f"no source '{name}' is declared - there are {', '.join(self.config.sources)}")
        return self.config.sources[name]

    # ---- data out

    def push(self, frame: Any, target: str, if_exists: str = "fail", batch_size: int = 5_000, source: str | None = None) -> int:
        """Write a frame to Database.schema.table of a source, over JDBC unless the workspace was given connect=.

        Refused unless the schema is on the allow-list, before anything connects.
        """
        database, schema, table = push.parse_target(target)
        push.check_allowed(database, schema, self.config.push_allow)
        df = to_spark(self.spark, frame)
        for f in df.schema:
            push.sql_type(f)
        source = self._source(source)
        connection = self._connect(source.name) if self._connect else jdbc.Connection(self.spark, source)
        try:
            return push.push_rows(connection, database, schema, table, df, if_exists, batch_size)
        finally:
            connection.close()

    # ---- models

    def models(self, reload: bool = False) -> dict:
        folder = self.config.models_dir
        files = tuple(sorted((str(p), p.stat().st_mtime_ns) for p in folder.glob("*.y*ml"))) if folder.is_dir() else ()
        if reload or self._models is None or self._models[0] != files:
            self._models = (files, load_models(folder, self.config.fiscal_start))
            self._bound.clear()
        return self._models[1]

    def model(self, name: str, reload: bool = False) -> BoundModel:
        """A model bound to the published version: later builds do not change what its slices read."""
        models = self.models(reload)
        if name not in models:
            raise PlumbError(f"there is no model '{name}' - there are {', '.join(sorted(models))}")
        manifest = self.store.manifest()
        key = (name, manifest["version"])
        if key not in self._bound:
            tables = manifest["tables"]
            entry = lambda t: tables.get(t if "." in t else f"main.{t}")
            read = lambda t: self.spark.read.parquet(entry(t)["path"]) if entry(t) else self.spark.table(t)
            self._bound[key] = BoundModel(self.spark, models[name], read, lambda t: (entry(t) or {}).get("extracted_at"))
        return self._bound[key]

    def slice(self, model: str, measures: Any, **request: Any) -> Slice:
        return self.model(model).slice(measures, **request)

    def validate(self) -> list[str]:
        """Warnings of all models; their structure is checked always, their tables once something is mirrored."""
        models = self.models(reload=True)
        return [w for n in models for w in self.model(n).warnings] if self.store.manifest()["version"] else []
