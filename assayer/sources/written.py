"""Intermediate tables of iterative operators, written in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset: an error, but for a local master, whose executors are the driver; it takes a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "assayer-rounds")


class Rounds:
    """Tables of one run: each is written once and read back without its lineage, so a lost executor costs one round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def keep(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this run that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(t)))
            path.getFileSystem(conf).delete(path, True)
