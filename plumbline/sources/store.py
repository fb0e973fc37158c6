"""The local mirror: immutable versions of tables, published by replacing one pointer.

A build writes its tables below a new version's folder and then swaps the
manifest in one atomic rename.  Until then readers see the old version, whole;
if anything fails, the new folder is deleted and nothing has changed.  Tables
that a partial build leaves out are carried over by pointing at the folders
they already have.
"""

from __future__ import annotations

import json
import time
import uuid
import warnings
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import PlumbError, SourceError
from .config import CODECS, TableSpec
from .frames import to_spark

MANIFEST = "manifest.json"
META = "schema_name string, table_name string, source_sql string, mode string, row_count long, extracted_at string, duration_s double, spec_hash string"


class Files:
    """Small files and renames on whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)

    def read(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @contextmanager
    def held(self, path: str, patience_s: float = 60.0):
        """A lock: the file that only one can create.  Whoever held it for longer than patience_s has died, and it is taken over."""
        system, began = self._system(path), time.time()
        while True:
            try:
                system.create(self._path(path), False).close()
                break
            except Exception as e:
                if not self.exists(path):
                    raise
                if time.time() - began > patience_s:
                    self.delete(path)
                time.sleep(0.2)
                del e
        try:
            yield
        finally:
            self.delete(path)

    def replace(self, path: str, text: str) -> None:
        """Write text so that readers see the old file or the new one."""
        side = f"{path}.{uuid.uuid4().hex}"
        out = self._system(path).create(self._path(side), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system(path).makeQualified(self._path(path)).toUri(), self.conf)
            overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            options = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
            options[0] = overwrite
            context.rename(self._system(path).makeQualified(self._path(side)), self._system(path).makeQualified(self._path(path)), options)
        except Exception:
            self.delete(side)
            raise


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    @property
    def _pointer(self) -> str:
        return f"{self.root}/{MANIFEST}"

    def manifest(self) -> dict[str, Any]:
        """{version, tables: {schema.table: {path, ...meta}}} as published; empty before the first build."""
        return json.loads(self.files.read(self._pointer)) if self.files.exists(self._pointer) else {"version": None, "tables": {}}

    def table(self, name: str) -> DataFrame:
        entry = self.manifest()["tables"].get(name if "." in name else f"main.{name}")
        if entry is None:
            raise PlumbError(f"the mirror has no table '{name}' - it has {', '.join(sorted(self.manifest()['tables'])) or 'none; run mirror() first'}")
        return self.spark.read.parquet(entry["path"])

    def refreshed(self, name: str) -> str | None:
        entry = self.manifest()["tables"].get(name if "." in name else f"main.{name}")
        return entry and entry["extracted_at"]

    def freshness(self) -> DataFrame:
        """What is mirrored, from where and when, by schema and table."""
        tables = self.manifest()["tables"]
        if not tables:
            raise PlumbError("nothing is mirrored yet - run mirror() first")
        rows = [tuple(e[c.split()[0]] for c in META.split(", ")) for _, e in sorted(tables.items())]
        return self.spark.createDataFrame(rows, META).orderBy("schema_name", "table_name")

    def build(self, specs: Iterable[TableSpec], extract: Callable[[TableSpec], Any], only: Iterable[str] | None = None, keep_staging: bool = False) -> dict[str, Any]:
        """Extract the tables (or only those named), write a new version and publish it."""
        specs = list(specs)
        live = self.manifest()
        chosen = {s.qualified for s in specs}
        if only is not None:
            wanted = {o if "." in o else next((s.qualified for s in specs if s.name == o), o) for o in only}
            if unknown := wanted - chosen:
                raise PlumbError(f"no table {', '.join(sorted(unknown))} is declared - there are {', '.join(sorted(chosen))}")
            chosen = wanted | (chosen - set(live["tables"]))
        version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/versions/{version}"
        tables = {s.qualified: live["tables"][s.qualified] for s in specs if s.qualified not in chosen}
        try:
            for s in specs:
                if s.qualified in chosen:
                    tables[s.qualified] = self._write(s, extract, f"{folder}/{s.schema}/{s.name}")
            with self.files.held(f"{self._pointer}.lock"):
                newest = self.manifest()  # another build may have been published meanwhile; what this one carries over is the newest
                tables.update({s.qualified: newest["tables"][s.qualified] for s in specs if s.qualified not in chosen})
                self.files.replace(self._pointer, json.dumps({"version": version, "tables": tables}, indent=1, sort_keys=True))
        except Exception as e:
            if not keep_staging:
                self.files.delete(folder)
            if isinstance(e, PlumbError):
                raise
            raise SourceError(f"the mirror was not changed: {e}") from e
        return {"version": version, "tables": tables}

    def _write(self, spec: TableSpec, extract: Callable[[TableSpec], Any], path: str) -> dict[str, Any]:
        import hashlib

        began = time.time()
        df = to_spark(self.spark, extract(spec))
        writer = df.write.option("compression", CODECS[spec.compression])
        if spec.compression == "zstd":
            writer = writer.option("parquet.compression.codec.zstd.level", spec.level)
        writer.parquet(path)
        rows = self.spark.read.parquet(path).count()  # from the files' footers
        return {
            "path": path, "schema_name": spec.schema, "table_name": spec.name, "source_sql": spec.sql, "mode": spec.mode, "row_count": rows,
            "extracted_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "duration_s": round(time.time() - began, 3), "spec_hash": hashlib.sha256(repr(spec).encode()).hexdigest(),
            "description": spec.description,
        }

    def register(self) -> list[str]:
        """Name the tables of mode native in the session's catalog, with their descriptions, over the published files.

        Their columns and comments can then be asked for in SQL.  A name is dropped
        and made again, which is no one step; slices read the files of their version.
        A table of that name that lies elsewhere is never touched.
        """
        named = []
        for name, entry in sorted(self.manifest()["tables"].items()):
            if entry["mode"] == "native":
                qualified = f"`{entry['schema_name']}`.`{entry['table_name']}`"
                self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{entry['schema_name']}`")
                if self.spark.catalog.tableExists(qualified):
                    told = self.spark.sql(f"DESCRIBE TABLE EXTENDED {qualified}").where("col_name = 'Location'").first()
                    if told is None or self.root.removeprefix("file:").lstrip("/") not in told["data_type"]:
                        warnings.warn(f"the catalog has a table {name} that is not this mirror's - it was left alone", stacklevel=2)
                        continue
                    self.spark.sql(f"DROP TABLE {qualified}")
                self.spark.catalog.createTable(qualified, entry["path"], "parquet", description=entry["description"] or None)
                named.append(name)
        return named

    def vacuum(self) -> list[str]:
        """Delete the folders of versions that the manifest no longer points at."""
        used = {e["path"] for e in self.manifest()["tables"].values()}
        top = f"{self.root}/versions"
        if not self.files.exists(top):
            return []
        gone = []
        for status in self.files._system(top).listStatus(self.files._path(top)):
            folder = status.getPath().toString()
            name = folder.rsplit("/", 1)[1]
            if not any(f"/versions/{name}/" in u for u in used):
                self.files.delete(folder)
                gone.append(name)
        return gone
