"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "ragloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` keys use ``__`` for dots.

    The master and the number of shuffle partitions are left as spark-submit gives them. Where nothing names a master it is a local one with 8 partitions.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    submitted = SparkConf().get("spark.master", None) or os.environ.get("MASTER")
    if master or not submitted:
        builder = builder.master(master or "local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a
    temporary folder; on a cluster, executors could not see it, so that raises.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    path = path or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ragloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished plans deleted now.

    Spark's cleaner drops them when the driver's garbage is collected, which on a large heap may be long after a plan has been cut; call this between phases that shuffle much.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/ragloom-{name}-{uuid.uuid4().hex}"


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, changed until none of the frames has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
