"""Incremental facts: new and changed source files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract import SCHEMA, file_facts

FILES = "path string, language string, repo string, content string"


def update_facts(batch: DataFrame, facts_path: str) -> None:
    """Append the facts of files whose (path, content hash) the table lacks.

    Readers take the newest row of a path: ``current_facts``. A batch that is
    delivered again adds nothing, since its hashes are there.
    """
    spark = batch.sparkSession
    known = spark.read.schema(SCHEMA).option("ignoreMissingFiles", True).parquet(facts_path) if _exists(spark, facts_path) else None
    hashed = batch.withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    if known is not None:
        hashed = hashed.join(known.select("path", "content_hash").distinct(), ["path", "content_hash"], "left_anti")
    file_facts(hashed.select("path", "language", "repo", "content")).withColumn("seen_at", F.current_timestamp()).write.mode("append").parquet(facts_path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def current_facts(spark: SparkSession, facts_path: str) -> DataFrame:
    """Newest facts of each path."""
    rows = spark.read.parquet(facts_path)
    newest = rows.groupBy("path").agg(F.max_by(F.struct(*[f"`{f.name}`" for f in SCHEMA.fields]), F.struct("seen_at", "content_hash")).alias("_r"))
    return newest.select("_r.*")


def follow(spark: SparkSession, files_path: str, facts_path: str, checkpoint: str) -> StreamingQuery:
    """A query that keeps the facts table up with Parquet files of sources added to a folder."""
    stream = spark.readStream.schema(FILES).parquet(files_path)
    return stream.writeStream.foreachBatch(lambda batch, _: update_facts(batch, facts_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
