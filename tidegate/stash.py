"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a local one is made, for local masters only: on a
    cluster each executor would write to a disk of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Stash:
    """Tables written once and read many times, so that a lost executor costs a reread and not a recomputation."""

    #: All that were made in this process.
    made: ClassVar[list[Stash]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []
        Stash.made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete stashed tables that no later step reads."""
        self._delete({f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()})

    def drop_but(self, *tables: DataFrame) -> None:
        """Delete all tables of this stash that none of ``tables`` reads."""
        read = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for df in tables for f in df.inputFiles()}
        self._delete({p for p in self.paths if p.rsplit("/", 1)[1] not in read})

    @staticmethod
    def sweep(since: int) -> None:
        """Delete whole all that were made after the first ``since``, for who knows that nothing reads them any more."""
        for own in Stash.made[since:]:
            own._delete({own.root})
        del Stash.made[since:]

    def _delete(self, paths: set[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
