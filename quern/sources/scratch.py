"""Tables in the folder that all executors share: they cut lineage, and a lost executor costs a reread."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on this machine (tests), a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(_gone, spark, at)
    return at


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _gone(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have been stopped before, and then nothing can be deleted
        delete(spark, path)


class Scratch:
    """Tables of one run, in a folder of their own. What a result still reads stays until the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []
        atexit.register(_gone, spark, self.root)

    def path(self) -> str:
        """A folder that nothing else uses."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def write(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for path in (df._scratch_path for df in dfs):
            delete(self.spark, path)
            self.paths.remove(path)

    def close(self, *keep: DataFrame) -> None:
        """Delete all tables but those of `keep`."""
        kept = {df._scratch_path for df in keep}
        for path in [p for p in self.paths if p not in kept]:
            delete(self.spark, path)
            self.paths.remove(path)


def create_once(spark: SparkSession, path: str) -> bool:
    """Make an empty file, as one step: of all that try, one gets True."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    if fs.getScheme() == "file":
        return sc._jvm.java.io.File(p.toUri().getPath()).createNewFile()
    try:
        fs.create(p, False).close()
    except Exception as e:
        if not fs.exists(p):
            raise e
        return False
    return True


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
