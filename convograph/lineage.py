"""Cutting lineage through files in the cluster's shared folder."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only where that
    is unset (a local session, as in tests) a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="convograph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _delete(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _delete_at_exit(jvm, conf, folder: str) -> None:
    try:
        _delete(jvm, conf, folder)
    except Exception:  # the JVM has gone, or the folder has
        pass


class Cuts:
    """Tables written by one query, in a folder of its own. A written table survives the loss of executors, has
    a known size, and is read again by any number of later steps. What a query's result reads stays until
    ``close`` or the end of the program; everything else is dropped as soon as no step reads it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: dict[int, tuple[str, DataFrame]] = {}
        sc = spark.sparkContext
        self._jvm, self._conf = sc._jvm, sc._jsc.hadoopConfiguration()
        atexit.register(_delete_at_exit, self._jvm, self._conf, self.folder)

    def cut(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes a table and returns its scan; with ``by``, in a folder for each value of that column, so that a filter on it reads these only."""
        path = f"{self.folder}/{self.count}"
        self.count += 1
        df.write.option("compression", "lz4").parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = path, out
        return out

    def read(self, frames: Sequence[DataFrame]) -> DataFrame:
        """Tables of one schema as one scan, whose plan has the same size for any number of them."""
        return self.spark.read.schema(frames[0].schema).parquet(*(self.tables[id(df)][0] for df in frames))

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of tables that no later step reads; other frames are passed over."""
        for df in frames:
            if table := self.tables.pop(id(df), None):
                _delete(self._jvm, self._conf, table[0])

    def keep(self, *frames: DataFrame) -> None:
        """Drops all tables but these."""
        self.drop(*(t for _, t in list(self.tables.values()) if all(t is not f for f in frames)))

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a table of its own; all others are dropped."""
        out = self.cut(df)
        self.keep(out)
        return out

    def close(self) -> None:
        """Deletes all tables, once the result is no longer read."""
        self.tables.clear()
        _delete(self._jvm, self._conf, self.folder)
