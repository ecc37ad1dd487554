"""Writing results, table digests and the model store."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonewright.operators import score
from zonewright.operators.quality import row_digest
from zonewright.sources import readers


def write_predictions(scored: DataFrame, path: str, kind: str = "csv", k: int = 5, keep: Sequence[str] = ("fqdn",)) -> None:
    """The wide top-k table, one file per partition."""
    options = {"header": True, **readers.QUOTING} if kind == "csv" else {}
    score.wide(scored, k, keep).write.mode("overwrite").format(kind).options(**options).save(path)


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "json") -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(n_rows, digest)``: a content hash that ignores row order.

    The digest adds up 48 bits of each row's SHA-256, so it needs no sort.
    """
    part = F.conv(F.substring(row_digest(df, columns), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("digest"))


def latest_versions(registry: DataFrame) -> DataFrame:
    """``(name, version, created_at)``: the newest live version of each model.

    The registry is append-only: an event is ``saved`` or ``deleted``, and the
    last event of a version counts.
    """
    live = live_versions(registry)
    newest = F.max_by(F.struct("version", "created_at"), F.struct("created_at", "version")).alias("v")
    return live.groupBy("name").agg(newest).select("name", "v.version", "v.created_at")


def live_versions(registry: DataFrame) -> DataFrame:
    last = registry.groupBy("name", "version").agg(
        F.max_by("event", F.struct("at", "event")).alias("event"),
        F.max(F.when(F.col("event") == "saved", F.col("at"))).alias("created_at"),
    )
    return last.where("event = 'saved'").drop("event")


def next_patch(version: str) -> str:
    head, _, patch = version.rpartition(".")
    return f"{head}.{int(patch) + 1}"


class ModelStore:
    """Versioned models below one folder, with an append-only registry table.

    Versions: ``semantic`` (patch + 1), ``timestamp`` or ``hash`` (of what the
    model consists of: settings, fitted tables and weights). A live version is
    never overwritten; saving the same content by hash gives the version it has.
    """

    SCHEMA = "name string, version string, event string, at timestamp, path string, metadata string"

    def __init__(self, spark: SparkSession, folder: str, versioning: str = "semantic") -> None:
        if versioning not in ("semantic", "timestamp", "hash"):
            raise ValueError(f"unknown versioning {versioning!r}")
        self.spark, self.folder, self.versioning = spark, folder.rstrip("/"), versioning

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    @property
    def registry(self) -> DataFrame:
        path = f"{self.folder}/registry"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(path)

    def _append(self, **event: Any) -> None:
        row = [tuple(event[f.split()[0]] for f in self.SCHEMA.split(", "))]
        self.spark.createDataFrame(row, self.SCHEMA).write.mode("append").json(f"{self.folder}/registry")

    def versions(self, name: str | None = None) -> dict[str, list[str]]:
        """Live versions by model, oldest first."""
        out: dict[str, list[str]] = {}
        for r in live_versions(self.registry).orderBy("created_at", "version").collect():
            if name in (None, r["name"]):
                out.setdefault(r["name"], []).append(r["version"])
        return out

    def latest(self, name: str) -> str | None:
        return (self.versions(name).get(name) or [None])[-1]

    def _new_version(self, name: str) -> str:
        if self.versioning == "timestamp":
            return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        current = self.latest(name)
        return "1.0.0" if current is None else next_patch(current)

    def _content_hash(self, path: str) -> str:
        """Of a saved model: its settings without names, times and versions of
        the moment, and the rows of its tables in any order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(root, True)
        folders: set[str] = set()
        while files.hasNext():
            file = files.next().getPath()
            if file.getName().startswith("part-"):
                folders.add(file.getParent().toString())
        parts = []
        for folder in folders:
            place = re.sub(r"_[0-9a-f]{12,}", "", folder[folder.index(path.rsplit("/", 1)[1]) :].partition("/")[2])
            if folder.endswith("/metadata"):
                content = json.loads("".join(sorted(r["value"] for r in self.spark.read.text(folder).collect())))
                for key in ("uid", "timestamp", "sparkVersion"):
                    content.pop(key, None)
                text = re.sub(r"_[0-9a-f]{12,}", "", json.dumps(content, sort_keys=True))
            else:
                text = str(tuple(table_digest(self.spark.read.parquet(folder)).first()))
            parts.append(f"{place}|{text}")
        return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()[:12]

    def save(self, model: MLWritable, name: str, version: str | None = None, metadata: dict[str, Any] | None = None) -> str:
        note = json.dumps(metadata or {}, sort_keys=True, default=str)
        if version is None and self.versioning == "hash":
            staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
            model.write().save(staged)
            version = self._content_hash(staged)
            path = f"{self.folder}/{name}/{version}"
            source, target = (self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, path))
            system = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if version in self.versions(name).get(name, ()):
                system.delete(source, True)
                return version
            system.mkdirs(target.getParent())
            if not system.rename(source, target):
                raise OSError(f"cannot move the model to {path}")
        else:
            version = version or self._new_version(name)
            path = f"{self.folder}/{name}/{version}"
            if version in self.versions(name).get(name, ()):
                raise FileExistsError(f"version {version} of model {name!r} is live; delete it first")
            model.write().overwrite().save(path)  # what may be there is no live version
        self._append(name=name, version=version, event="saved", at=datetime.now(timezone.utc), path=path, metadata=note)
        return version

    def load(self, name: str, version: str | None = None) -> PipelineModel:
        version = version or self.latest(name)
        if version is None:
            raise ValueError(f"no versions of model {name!r}")
        path = f"{self.folder}/{name}/{version}"
        if not self._exists(path):
            raise FileNotFoundError(path)
        return PipelineModel.load(path)

    def delete(self, name: str, version: str) -> bool:
        path = f"{self.folder}/{name}/{version}"
        if not self._exists(path):
            return False
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self._append(name=name, version=version, event="deleted", at=datetime.now(timezone.utc), path=path, metadata="{}")
        return True
