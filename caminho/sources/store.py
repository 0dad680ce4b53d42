"""Where the reference tables live."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import ArgumentError, ReferenceDataError
from ..plans.stages import TABLES, file_name

RELEASE = "v1"


_MADE: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under ``spark.checkpoint.dir``.

    Where that is unset a local folder serves, but only a session whose executors run on
    this machine; any other raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ArgumentError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}"
    _MADE.append(f"{root.rstrip('/')}/caminho-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder and read back: computed once, whatever reads it."""
    path = scratch(df.sparkSession)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete the scratch folders made so far, but for the first ``keep`` of them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_MADE) > keep:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes in the end the scratch folders that were made within."""
    before = len(_MADE)
    try:
        yield
    finally:
        release(spark, before)


class ReferenceStore:
    """Reference tables under a folder, one directory per release.

    ``root`` may be any path Spark reads; listing, deleting and fetching work on local paths.
    """

    def __init__(self, root: str | None = None, release: str = RELEASE, fetch=None):
        self.root = root or os.environ.get("CAMINHO_DATA", str(Path.home() / ".cache/caminho"))
        self.release, self.fetch = release, fetch

    @property
    def folder(self) -> str:
        """Directory of the release."""
        return f"{self.root}/{self.release}"

    def path(self, table: str) -> str:
        """Path of a table, by its short name or its file name; the name must match whole."""
        names = {**{t: file_name(t) for t in TABLES}, **{file_name(t): file_name(t) for t in TABLES}}
        if table not in names:
            raise ArgumentError(f"no such table: {table}")
        return f"{self.folder}/{names[table]}.parquet"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table; an error that names it if it is missing or damaged."""
        path = self.path(table)
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            raise ReferenceDataError(f"{path} is missing or damaged; delete it and fetch it anew") from e

    def ensure(self, tables: list[str] | None = None) -> list[str]:
        """Fetch the tables that are not there yet, with the ``fetch(name, path)`` given; the paths of all asked for."""
        paths = [self.path(t) for t in (tables or list(TABLES))]
        for path in paths:
            if not Path(path).exists():
                if self.fetch is None:
                    raise ReferenceDataError(f"{path} is missing and nothing is set to fetch it")
                Path(path).parent.mkdir(parents=True, exist_ok=True)
                self.fetch(Path(path).stem, path)
        return paths

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Save a built lattice."""
        for name, table in tables.items():
            with shuffles_released(table.sparkSession):
                table.write.mode("overwrite").parquet(self.path(name))

    def files(self) -> list[str]:
        """Names of the stored tables of this release."""
        return sorted(p.name for p in Path(self.folder).glob("*.parquet"))

    def delete(self) -> None:
        """Remove this release."""
        shutil.rmtree(self.folder, ignore_errors=True)

    def delete_old(self) -> list[str]:
        """Remove the other releases' directories only; their names."""
        old = [p for p in Path(self.root).glob("v*") if p.is_dir() and p.name != self.release]
        for p in old:
            shutil.rmtree(p)
        return sorted(p.name for p in old)
