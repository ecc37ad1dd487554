"""Shared plumbing of the fitted stages: settings, held state, persistence."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml.param import Param, Params
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only a local session,
    which has no other machine, gets a folder of its own, removed at its end.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="zonewright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder. The part is
    deleted when the driver's Python ends."""
    folder = f"{shared_folder(spark)}/zonewright-{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return  # the session has ended before
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def hold(df: DataFrame) -> DataFrame:
    """Compute a fitted table once: it is written to the shared folder and read
    back, whatever its size. The files' statistics let Spark choose the join."""
    path = scratch_path(df.sparkSession, "held")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_PER_TASK = 1024
SAVED_TOGETHER = 8  # children of a stage


def over_cores(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key`` over the session's cores, in its order, ahead
    of fits that read them many times: an input file may be one task. Few rows
    make fewer tasks, as the fits also have a cost per task."""
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(max(parts, 1), key).sortWithinPartitions(key)


class Stage(Params, MLReadable, MLWritable):
    """Parameters from ``SETTINGS`` (all JSON values), state tables, and the
    fitted models a stage is made of. All of it is saved and loaded."""

    SETTINGS: dict[str, Any] = {}

    def __init__(self, **settings: Any) -> None:
        super().__init__()
        for name, default in self.SETTINGS.items():
            setattr(self, name, Param(self, name, name.replace("_", " ")))
            self._setDefault(**{name: default})
        unknown = set(settings) - set(self.SETTINGS)
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        self._set(**settings)
        self.tables: dict[str, DataFrame] = {}
        self.children: dict[str, MLWritable] = {}

    def get(self, name: str) -> Any:
        return self.getOrDefault(name)

    def settings(self) -> dict[str, Any]:
        return {name: self.get(name) for name in self.SETTINGS}

    def with_settings(self, **settings: Any) -> "Stage":
        other = self.copy()
        other._set(**settings)
        return other

    def write(self) -> MLWriter:
        return _StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StageReader(cls)


class _StageWriter(MLWriter):
    def __init__(self, stage: Stage) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.stage,
            path,
            self.sparkSession,
            extraMetadata={"tables": sorted(self.stage.tables), "children": list(self.stage.children)},
        )
        with ThreadPoolExecutor(SAVED_TOGETHER) as pool:
            saves = [pool.submit(self._save, name, f"{path}/children/{name}") for name in self.stage.children]
        for done in saves:
            done.result()
        for name, table in self.stage.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")

    def _save(self, name: str, path: str) -> None:
        self.stage.children[name].write().overwrite().save(path)  # one kept in files is read by its own save


class _StageReader(MLReader):
    def __init__(self, cls: type[Stage]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Stage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        for name in metadata["tables"]:
            stage.tables[name] = self.sparkSession.read.parquet(f"{path}/tables/{name}")
        for name in metadata["children"]:
            stage.children[name] = DefaultParamsReader.loadParamsInstance(
                f"{path}/children/{name}", self.sparkSession
            )
        return stage
