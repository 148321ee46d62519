"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables written to the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage, so a lost executor costs a re-read and not
    a recomputation. ``drop`` removes a table that no later plan reads; the others can go with
    their folder after the job.
    """

    def __init__(self, spark: SparkSession):
        context = spark.sparkContext
        folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="archspan-")
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
