"""Streaming: scan files as they arrive (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumen import rules
from lumen.functions.cells import extension
from lumen.plans.scan import scan_records
from lumen.sources.unpack import unpack

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, include_all: bool = False) -> DataFrame:
    """New files of a folder, as a stream of binaryFile rows."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return files if include_all else files.where(extension(F.col("path")).isin(rules.SUPPORTED))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, include_all: bool = False) -> StreamingQuery:
    """Scan what has arrived, once, and append findings with the batch they are of; run it again for more.

    A batch that is run again after a failure overwrites its own folder, so findings are written exactly once. Of
    paths scanned several times, latest_findings() keeps those of the last batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        records = unpack(batch)
        scan = scan_records(batch.sparkSession, records)
        roots = scan.artifacts.select("artifact_id", "root_id")
        found = scan.findings.join(roots, "artifact_id")
        found.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/findings/n={number}")
        roots.select("root_id").distinct().withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/roots/n={number}")

    return arriving(spark, folder, include_all).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the last scan of each path."""
    last = spark.read.parquet(f"{out}/roots").groupBy("root_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/findings").join(last, ["root_id", "batch"]).drop("n")


