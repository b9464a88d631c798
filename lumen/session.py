"""Spark session defaults."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library relies on; on a cluster, spark-submit's own settings win."""
    b = SparkSession.builder.appName("lumen").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", os.environ.get("LUMEN_DRIVER_MEMORY", "8g")).config("spark.driver.host", "127.0.0.1")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    importable(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it, wherever the driver was started."""
    try:
        env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    except Exception:  # a remote session ships its own code
        return
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (here, env.get("PYTHONPATH", "")) if x)


def own_folder(spark: SparkSession) -> str:
    """A folder for checkpoints where none is set: only where driver and executors are one machine's processes."""
    import tempfile

    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="lumen-checkpoints-")


def checkpointed(df):
    """df with its lineage cut in the shared checkpoint folder; one of our own only where none is set, in local mode."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark))
    return df.checkpoint()
