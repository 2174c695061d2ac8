"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Unicode white space and separators as a character class that Java and RE2 read alike.
BLANK_CLASS = r"\p{Z}\x09-\x0d\x1c-\x1f\x{85}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application, as a zip from the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="kotonami-"), "kotonami.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("kotonami", os.path.relpath(path, here)))
    sc.addPyFile(at)
    _shipped.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local master may do without one; it gets a folder of its own, which goes with the process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="kotonami-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """A folder on whatever file system its path names, by Hadoop's file system API."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str = "") -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def names(self, name: str = "") -> list[str]:
        """Names in the folder, in order; none where it isn't there."""
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def matching(self) -> list[tuple[str, int]]:
        """(path, modification time) of what the path, taken as a pattern, names."""
        fs, path = self._at("")
        return sorted((s.getPath().toString(), s.getModificationTime()) for s in fs.globStatus(path) or ())

    def modified(self, name: str = "") -> int:
        fs, path = self._at(name)
        return fs.getFileStatus(path).getModificationTime() if fs.exists(path) else 0

    def delete(self, name: str = "") -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def read(self, name: str = "") -> str | None:
        """The text of a small file; null where it isn't there."""
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        fs, path = self._at(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def is_blank(col: Column) -> Column:
    """True for text of white space only (the empty text too); null for null."""
    return ~col.rlike(f"[^{BLANK_CLASS}]")
