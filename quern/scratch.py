"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from functools import lru_cache

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local_root() -> str:
    root = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


class Scratch:
    """Intermediate tables of one operator call, written under spark.checkpoint.dir.

    A written table cuts the lineage as a checkpoint does: a lost executor costs a re-read, not a recomputation.
    The folder is taken from the session; only where none is set (tests on one machine) a temporary one is made. Results
    are read lazily from these tables, so they stay until `clear`, to be called when results are written elsewhere, or
    until no plan reads them any more and `sweep` is called.
    """

    roots: list[str] = []
    #: By a table's path, the application that wrote it and a weak reference to the list of files that all plans over it share.
    readers: dict[str, tuple[str, JavaObject]] = {}

    def __init__(self, spark: SparkSession, name: str):
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = _local_root()
        self.spark, self.root = spark, f"{root.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
        Scratch.roots.append(self.root)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write `df` and read it back."""
        path = f"{self.root}/{name}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        plan = out._jdf.queryExecution().analyzed()
        if plan.getClass().getSimpleName() == "LogicalRelation":
            Scratch.readers[path] = self.spark.sparkContext.applicationId, self.spark._jvm.java.lang.ref.WeakReference(plan.relation().location())
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
            Scratch.readers.pop(f"{self.root}/{name}", None)

    @classmethod
    def sweep(cls, spark: SparkSession) -> None:
        """Delete the tables that no plan reads any more, and let Spark delete shuffles that no plan needs.

        A result counts as long as there is a DataFrame, view or cached table made of it; one of which only an RDD is
        left does not. What was let go of within the last second may stay until the next call."""
        gc.collect()
        spark._jvm.System.gc()
        for path, (application, files) in list(cls.readers.items()):
            if application == spark.sparkContext.applicationId and files.refersTo(None):
                delete(spark, path)
                del cls.readers[path]

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Delete the tables of all operator calls of this process; their results can't be read after that."""
        cls.readers.clear()
        while cls.roots:
            delete(spark, cls.roots.pop())


def delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
